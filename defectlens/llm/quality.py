"""Quality rules with host verdicts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, keep, let

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A host whose shrunk failure rate in any rule is above this is rejected with all its documents.
HOST_LIMIT = 0.5
#: Rules whose failures are counted by host.
RULES = ("short", "repeats", "symbols", "lines")


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more: sort, mark equal neighbours, add up without overlap."""

    def of_sorted(s: Column) -> Column:
        twice = F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["w"] == x["w"]) | (F.get(s, j + 1)["w"] == x["w"]), x["i"]))
        return let(
            F.sort_array(F.array_compact(twice)),
            lambda p: F.aggregate(
                F.transform(p, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - at, F.lit(WINDOW)))),
                F.lit(0),
                lambda total, n: total + n,
            ),
        )

    return let(F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), of_sorted)


def _measures(text: Column) -> Column:
    def of_words(words: Column) -> Column:
        n = F.size(words)
        windows = F.when(
            n >= WINDOW,
            F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.array_join(F.slice(words, i, WINDOW), " ")),
        ).otherwise(F.array().cast("array<string>"))
        repeated = let(windows, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), _covered(g)).otherwise(F.lit(0)))
        return F.struct(n.cast("bigint").alias("n_words"), repeated.cast("bigint").alias("n_repeat_words"))

    trimmed = F.btrim(text, F.lit(WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, WHITE, "") != "")
    return F.struct(
        let(words, of_words).alias("by_word"),
        F.length(F.translate(text, WHITE, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
    )


def measure(docs: DataFrame, text: str = "text", carried: list[str] | None = None) -> DataFrame:
    """Columns ``row`` (the input row, or the ``carried`` columns of it), ``m`` (measures) and ``failed`` (one flag per rule).

    A null text counts as empty: no words, so it fails the rule of least words.
    Rows are taken one by one; repeated rows and ids give repeated results.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried or docs.columns]).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    out = rows.select("row", _measures(F.col("t")).alias("x"))
    m = out.select(
        "row",
        F.struct(
            F.col("x.by_word.n_words"), F.col("x.word_chars"), F.col("x.n_symbols"), F.col("x.n_dup_lines"), F.col("x.by_word.n_repeat_words")
        ).alias("m"),
    )
    n = F.col("m.n_words")
    flags = F.struct(
        (n < MIN_WORDS).alias("short"),
        (100 * F.col("m.n_repeat_words") > MAX_REPEAT_PERCENT * n).alias("repeats"),
        (10 * F.col("m.n_symbols") > n).alias("symbols"),
        (10 * F.col("m.n_dup_lines") > n).alias("lines"),
    )
    return m.withColumn("failed", flags)


def host_rates(measured: DataFrame, host: str = "source") -> DataFrame:
    """One row per host: documents, and per rule the failure rate shrunk to an empirical beta prior.

    The prior's mean and variance are those of the hosts' rates (method of
    moments). Without variance every host gets the mean; with more variance than
    a beta can have, hosts keep their own rates. A null host is a host.
    """
    counted = measured.groupBy(F.col(f"row.`{host}`").alias("host")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"failed.{r}").cast("bigint")).alias(f"f_{r}") for r in RULES]
    )
    counted = keep(counted)  # read twice below
    prior = counted.agg(
        *[F.avg(F.col(f"f_{r}") / F.col("n")).alias(f"m_{r}") for r in RULES],
        *[F.var_pop(F.col(f"f_{r}") / F.col("n")).alias(f"v_{r}") for r in RULES],
    )

    def shrunk(r: str) -> Column:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        strength = F.greatest(m * (1 - m) / F.nullif(v, F.lit(0.0)) - 1, F.lit(0.0))
        return F.coalesce((F.col(f"f_{r}") + m * strength) / (F.col("n") + strength), m)

    rates = counted.join(F.broadcast(prior)).select("host", "n", *[shrunk(r).alias(f"r_{r}") for r in RULES])  # one row is broadcast
    worst = F.greatest(*[F.col(f"r_{r}") for r in RULES])
    return rates.withColumn("host_rejected", worst > HOST_LIMIT)


def judge(docs: DataFrame, text: str = "text", host: str = "source", carried: list[str] | None = None) -> DataFrame:
    """``row``, ``m``, ``base_failed`` and ``kept`` of every document. ``carried`` columns, the host's among them, make up ``row``; all by default.

    The measured rows are written once to the shared folder, because host
    verdicts need all of them first. Hosts are counted before the shuffle; a hot
    host's documents are joined back by a join that Spark may split or broadcast.
    """
    measured = keep(measure(docs, text, carried))
    hosts = host_rates(measured, host).select("host", "host_rejected")
    joined = measured.join(hosts, F.col(f"row.`{host}`").eqNullSafe(F.col("host")), "left")
    base = F.col("failed.short") | F.col("failed.repeats")
    return joined.select("row", "m", base.alias("base_failed"), (~base & ~F.col("host_rejected")).alias("kept"))


def filter_documents(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that are kept, with their own columns only."""
    return judge(docs, text, host).filter("kept").select("row.*")
