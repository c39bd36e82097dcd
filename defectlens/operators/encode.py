"""Batch encoding with a caller's encoder, and what follows from it."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .search import knn

Encoder = Callable[[list], np.ndarray]


def hashing_encoder(dim: int = 64) -> Encoder:
    """Word-hash vectors: a stand-in for a model, stable across processes."""

    def run(texts: list) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            h = np.array([zlib.crc32(w.encode()) for w in text.lower().split()], dtype=np.int64)
            if len(h):
                out[i] = np.bincount(h % dim, np.where(h & 0x10000, 1.0, -1.0), dim)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    return run


#: Characters that ``letter_encoder`` counts, one per element.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def letter_encoder(dim: int = 32) -> Encoder:
    """Unit vectors of letter counts (both cases): a stand-in for a model that other engines can repeat."""

    def run(texts: list) -> np.ndarray:
        out = np.array([[t.count(c) + (t.count(c.upper()) if c.isalpha() else 0) for c in LETTERS[:dim]] for t in texts], dtype=float)
        out = out.reshape(len(texts), dim)
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norm, out=out, where=norm > 0)

    return run


def encode(
    df: DataFrame,
    column: str,
    encoder: Callable[[], Encoder],
    dim: int,
    batch_size: int = 16,
    name: str = "embedding",
) -> DataFrame:
    """Adds the vector of ``column`` and ``vector_ok``.

    ``encoder`` builds the model once per task. A batch that fails is retried
    row by row; a row that fails gets zeros and ``vector_ok = false``.
    """

    @F.pandas_udf("embedding array<float>, vector_ok boolean")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = encoder()
        for values in parts:
            rows, flags = [], []
            items = values.tolist()
            for s in range(0, len(items), batch_size):
                for vector in _encode_batch(model, items[s : s + batch_size], dim):
                    rows.append(np.zeros(dim, dtype=np.float32) if vector is None else vector)
                    flags.append(vector is not None)
            yield pd.DataFrame({"embedding": rows, "vector_ok": flags})

    return df.withColumn("_e", run(F.col(column))).select(
        *df.columns, F.col("_e.embedding").alias(name), F.col("_e.vector_ok").alias("vector_ok")
    )


def _encode_batch(model: Encoder, items: list, dim: int) -> list:
    try:
        out = np.asarray(model(items), dtype=np.float32)
        if out.shape != (len(items), dim):
            raise ValueError(f"encoder returned {out.shape}")
        return list(out)
    except Exception:
        if len(items) == 1:
            return [None]
        return [v for item in items for v in _encode_batch(model, [item], dim)]


def encode_consistency(df: DataFrame, column: str, encoder, dim: int, threshold: float = 0.99) -> DataFrame:
    """Encode every row twice and compare the two vectors."""
    once = encode(df, column, encoder, dim, name="_a").drop("vector_ok")
    twice = encode(once, column, encoder, dim, name="_b")
    similar = F.coalesce(V.cosine(F.col("_a"), F.col("_b")), F.lit(1.0))
    return twice.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(similar).alias("mean_similarity"),
        F.count_if(similar <= threshold).alias("n_below"),
        F.count_if(~F.col("vector_ok")).alias("n_failed"),
    )


def search_hybrid(
    queries: DataFrame,
    text: Column,
    corpus: DataFrame,
    encoder: Callable[[], Encoder],
    text_dim: int,
    k: int = 5,
    visual: str = "visual",
    **options,
) -> DataFrame:
    """Describe, encode and fuse each query record, then search the fused corpus."""
    texted = encode(queries.withColumn("_text", text), "_text", encoder, text_dim, name="_t")
    fused = texted.select("query_id", V.fuse_concat(F.col(visual), F.col("_t")).alias("embedding"))
    return knn(fused, corpus, k, **options)


def pool_patches(patches: DataFrame, whole: DataFrame, key: str = "image_id", share: float = 0.6) -> DataFrame:
    """0.6 whole-image vector + 0.4 mean patch vector, normalised.

    The mean is one sum per (image, dimension), combined before the shuffle.
    Images without patches keep their whole-image vector.
    """
    means = (
        patches.select(key, F.posexplode(V.as_double(F.col("embedding"))).alias("_d", "_x"))
        .groupBy(key, "_d")
        .agg(F.avg("_x").alias("_m"))
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("_d", "_m"))).alias("_p"))
        .select(key, F.transform("_p", lambda p: p["_m"]).alias("_patch"))
    )
    mixed = F.zip_with(
        V.as_double(F.col("embedding")), F.col("_patch"), lambda g, p: g * F.lit(share) + p * F.lit(1 - share)
    )
    joined = whole.join(means, key, "left")
    vector = F.when(F.col("_patch").isNull(), V.as_double(F.col("embedding"))).otherwise(V.l2_normalize(mixed))
    return joined.withColumn("embedding", vector).drop("_patch")
