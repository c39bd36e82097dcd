"""Spark operators for visual-defect retrieval data."""
