"""Candidate pairs in buckets and classes of linked items. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep


def in_company(bands: DataFrame) -> DataFrame:
    """``bucket``, ``id`` and ``n`` (members) of the rows of ``bands`` whose bucket has more than one member; kept."""
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keep(bands.join(shared, "bucket"))


def leader_pairs(members: DataFrame) -> DataFrame:
    """Distinct pairs ``a`` < ``b`` of each member and the leader of its bucket; kept.

    The leader is the member with the most company in all its buckets, so that the
    text from which others were copied comes first. There are fewer pairs than
    members, however large a bucket is.
    """
    score = members.groupBy("id").agg(F.sum("n").alias("score"))
    scored = members.join(score, "id").select("bucket", "id", "score")
    best = scored.groupBy("bucket").agg(F.max(F.struct("score", "id")).alias("best")).select("bucket", F.col("best.id").alias("leader"))
    met = scored.join(best, "bucket").filter("id <> leader")
    return keep(met.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct())


def unsettled(members: DataFrame, links: DataFrame) -> DataFrame:
    """``bucket``, ``id`` and ``class`` of the buckets of three or more that the links have not joined into one class; kept.

    A bucket of two has been compared; in one class there is nothing left to find.
    """
    found = components(links)
    classed = members.filter("n > 2").join(found, "id", "left").select("bucket", "id", F.coalesce("class", "id").alias("class"))
    several = classed.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high").select("bucket")
    return keep(classed.join(several, "bucket"))


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``class`` (the least id of its component) of every item that has a link.

    Large-star and small-star steps hang each item below the least one known to be
    connected, until nothing changes; minima are taken before the shuffle, so a
    centre with very many links costs no task more than its share.
    """
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.filter("v < u")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        last, edges = edges, keep(small.select("e.u", "e.v").filter("u <> v").distinct())
        after = mark(edges)
        discard(last)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("class")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("class")).unionByName(roots)
