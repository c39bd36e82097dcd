"""Comparison of all configurations on one query set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import judged, retrieval_metrics
from ..operators.search import compatible_configs, knn


def evaluate_configs(
    configs: DataFrame,
    corpora: DataFrame,
    queries: DataFrame,
    truth: DataFrame,
    k: int = 5,
    label_space: str = "benchmark",
    exclude_self: bool = False,
    run_log: DataFrame | None = None,
) -> DataFrame:
    """Metric row of every configuration whose dimension fits the queries.

    ``corpora`` has ``config, id, embedding, retrieved_type``; all configurations
    are searched in one pass.
    """
    names = compatible_configs(configs, queries).select("config").distinct()
    corpus = corpora.join(names, "config", "left_semi")
    hits = knn(queries, corpus, k, by="config", exclude_self=exclude_self)
    results = hits.join(corpus.select("config", "id", "retrieved_type"), ["config", "id"])
    expected = truth.join(names, F.lit(True))  # the query set under each configuration
    return retrieval_metrics(judged(results, expected, label_space), run_log=run_log)
