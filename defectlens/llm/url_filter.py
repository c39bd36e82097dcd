"""URL rules by a sort-merge sweep over intervals of reversed-host keys, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hash groups of the first two host labels; fixed, so their counts are a table of bounded size.
GROUPS = 1024


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters lower-cased) and path of a url; both empty for null or without ``://``."""
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substr(whole, at + 3)).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(labels: Column) -> Column:
    """``a.example.org`` as ``org.example.a.``: a host and its subdomains are the keys with its key as prefix."""
    return F.concat(F.array_join(labels, "."), F.lit("."))


def _after(key: Column, last: str) -> Column:
    """The least key above all that begin with ``key``, whose last character is known."""
    return F.concat(F.left(key, F.length(key) - 1), F.lit(last))


def sweep(points: DataFrame, events: DataFrame, parts: int) -> DataFrame:
    """Points (``k``, ``p``, ``g``) with the stack (``stack``) of the rules active at their key.

    ``events`` (``k``, ``g``, ``stack``) push and pop: each holds the stack that is
    active from its key on. Groups ``g`` are cut into buckets by their share of the
    points, so that a hot host is swept by many tasks; events go to every bucket of
    their group (a null group: of all groups). Inside a bucket one sort by key
    merges both sides and the last event's stack is carried on to the points.
    """
    counts = points.groupBy("g").agg(F.count(F.lit(1)).alias("n"))  # at most GROUPS rows
    total = counts.agg(F.sum("n").alias("total"))
    sized = counts.join(F.broadcast(total)).select("g", F.ceil(F.col("n") * parts / F.col("total")).cast("int").alias("cuts"))
    cut = F.pmod(F.xxhash64("p"), F.col("cuts")).cast("int")
    left = points.join(F.broadcast(sized), "g").select("g", cut.alias("c"), "k", F.lit(1).alias("kind"), "p", F.lit(None).cast(events.schema["stack"].dataType).alias("stack"))
    wide = events.join(F.broadcast(sized.withColumnRenamed("g", "h")), F.col("g").isNull() | (F.col("g") == F.col("h")))
    right = wide.select(
        F.col("h").alias("g"),
        F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("c"),
        "k",
        F.lit(0).alias("kind"),
        F.lit(None).cast(points.schema["p"].dataType).alias("p"),
        "stack",
    )
    order = Window.partitionBy("g", "c").orderBy("k", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = left.unionByName(right).select("kind", "p", F.last("stack", ignorenulls=True).over(order).alias("stack"))
    return swept.filter("kind = 1").select("p", "stack")


def _events(rules: DataFrame) -> DataFrame:
    """Push and pop events of the rule hosts. Nested hosts are joined to their ancestors by equality.

    A push holds the rules of the host and of all hosts above it; the pop at the
    interval's end holds those above it only. Where a push and pops share a key the
    longest stack is the one that is active.
    """
    by_host = rules.groupBy("labels").agg(F.collect_list(F.struct("host", "path", "verdict")).alias("own"))
    prefixes = by_host.select(
        F.col("labels").alias("at"),
        F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.slice("labels", 1, i))).alias("labels"),
    )
    chains = prefixes.join(by_host, "labels").groupBy("at").agg(
        F.flatten(F.collect_list("own")).alias("push"),
        F.flatten(F.collect_list(F.when(F.size("labels") < F.size("at"), F.col("own")))).alias("pop"),
    )
    key = _key(F.col("at"))
    both = chains.select(
        F.when(F.size("at") > 1, F.pmod(F.xxhash64(F.slice("at", 1, 2)), F.lit(GROUPS))).alias("g"),
        F.explode(F.array(F.struct(key.alias("k"), F.col("push").alias("stack")), F.struct(_after(key, "/").alias("k"), F.col("pop").alias("stack")))).alias("e"),
    ).select("g", "e.k", "e.stack")
    return both.groupBy("g", "k").agg(F.max_by("stack", F.size("stack")).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", parts: int | None = None) -> DataFrame:
    """``row``, ``host``, ``path``, ``rule`` and ``verdict`` of every row of ``pages``.

    ``rules`` has ``host``, ``path`` and ``verdict``. A rule fits its host and all
    subdomains where the url's path begins with its path; the longest rule (host
    and path together) wins, ``block`` before ``allow`` in a tie; no rule gives
    ``default``. Null urls have an empty host and path. Repeated rules count once.
    The rules of one host travel together, so a host may have many hosts above and
    below it but should have no more path rules than fit into one row.
    """
    spark = pages.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col(f"`{url}`"))
    columns = F.struct(*[F.col(f"`{c}`") for c in pages.columns])
    urls = pages.select(columns.alias("row"), host.alias("host"), path.alias("path"))
    slim = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").distinct()
    slim = slim.withColumn("labels", _labels(F.col("host")))
    labels = _labels(F.col("host"))
    points = urls.select(
        F.pmod(F.xxhash64(F.slice(labels, 1, 2)), F.lit(GROUPS)).alias("g"), _key(labels).alias("k"), F.struct("row", "host", "path").alias("p")
    )
    swept = sweep(points, _events(slim), parts)
    fitting = F.filter("stack", lambda r: F.startswith(F.col("p.path"), r["path"]))
    ranked = F.transform(
        fitting,
        lambda r: F.struct(
            (F.length(r["host"]) + F.length(r["path"])).alias("n"), r["verdict"].alias("verdict"), F.length(r["host"]).alias("h"), F.concat(r["host"], r["path"]).alias("rule")
        ),
    )
    best = F.array_max(ranked)
    return swept.select("p", best.alias("b")).select(
        "p.row", "p.host", "p.path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict")
    )
