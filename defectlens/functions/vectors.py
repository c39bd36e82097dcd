"""Vector arithmetic over ``array<float>`` columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    Inside a lambda an outer expression would be evaluated again for every
    element; as the element of a one-item array it is bound before.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    scaled = lambda w, n: F.when(n > 0, F.transform(w, lambda x: x / n)).otherwise(w)
    return let(as_double(v), lambda w: let(l2_norm(w), lambda n: scaled(w, n)))


def l2sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL when either vector is zero."""
    return dot(a, b) / F.nullif(l2_norm(a) * l2_norm(b), F.lit(0.0))


def similarity_pct(distance: Column) -> Column:
    """Displayed similarity, ``(1 - squared distance) * 100``; may be negative."""
    return (1 - distance) * 100


def fuse_concat(visual: Column, text: Column, visual_weight: float = 0.6, text_weight: float = 0.4) -> Column:
    """Weighted concatenation of two unit vectors, normalised again."""
    if abs(visual_weight + text_weight - 1.0) >= 1e-6:
        raise ValueError("visual_weight + text_weight must be 1")
    scaled = lambda v, w: F.transform(l2_normalize(v), lambda x: x * w)
    return l2_normalize(F.concat(scaled(visual, visual_weight), scaled(text, text_weight)))


def fuse_mean(visual: Column, text: Column, mode: str = "average") -> Column:
    """Average (or 0.6/0.4 mean) of two unit vectors of one space, normalised again."""
    weights = {"average": (0.5, 0.5), "weighted": (0.6, 0.4)}
    if mode not in weights:
        raise ValueError(f"unknown fusion: {mode}")
    wv, wt = weights[mode]
    mixed = F.zip_with(l2_normalize(visual), l2_normalize(text), lambda x, y: x * wv + y * wt)
    return l2_normalize(mixed)


def has_bad_values(v: Column) -> Column:
    """True when an element is missing, NaN or infinite."""
    inf = float("inf")
    return F.exists(
        as_double(v), lambda x: x.isNull() | F.isnan(x) | (x == F.lit(inf)) | (x == F.lit(-inf))
    )


def embedding_kind(v: Column) -> Column:
    return F.when(F.size(v) > 1024, "hybrid").otherwise("visual")
