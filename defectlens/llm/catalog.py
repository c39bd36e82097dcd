"""Queries of the operators over the given tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chunk_dedup, decontaminate, license_scan, line_dedup, ngram_join, packing, pii, quality, shards, token_files, url_filter, whitening
from .common import ready

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ready(spark)
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _license_sql() -> str:
    known = ", ".join(f"({_text(v)}, {_text(k)})" for k, v in license_scan.SENTENCES.items())
    steps, last = [], "s0"
    for i, (licence, names) in enumerate(license_scan.RULES, 1):
        run = _text("".join(f"<{n}>" for n in names))
        steps.append(
            f"s{i} AS (SELECT doc_id, v, n, CASE WHEN contains(rest, {run}) THEN list_append(l, {_text(licence)}) ELSE l END AS l, replace(rest, {run}, '|') AS rest FROM {last})"
        )
        last = f"s{i}"
    left = "length(rest) - length(replace(rest, '<', ''))"
    return f"""
WITH known(k, name) AS (VALUES {known}),
read AS (
  SELECT doc_id, 1 AS v, regexp_replace(coalesce(text, ''), '[ \\t\\r]*\\n+', '. ', 'g') AS x FROM documents
  UNION ALL
  SELECT doc_id, 2, regexp_replace(regexp_replace(coalesce(text, ''), '{license_scan.PARAGRAPH}', '. ', 'g'), '[ \\t\\r\\n]+', ' ', 'g') FROM documents),
cut AS (SELECT doc_id, v, string_split_regex(x, '{license_scan.STOP}') AS l FROM read),
piece AS (SELECT doc_id, v, unnest(l) AS s, unnest(range(len(l))) AS i FROM cut),
hit AS (SELECT p.doc_id, p.v, p.i, k.name FROM piece p JOIN known k ON trim(regexp_replace(lower(p.s), '[^a-z0-9]+', ' ', 'g')) = k.k),
s0 AS (SELECT doc_id, v, count(*) AS n, CAST([] AS VARCHAR[]) AS l, string_agg('<' || name || '>', '' ORDER BY i) AS rest FROM hit GROUP BY doc_id, v),
{", ".join(steps)},
one AS (SELECT doc_id, coalesce(max(n), 0) AS n_sentences,
  array_to_string(list_sort(list_distinct(flatten(list(l)))), '+') AS licences,
  max_by({left}, n * 10 - v) AS n_unmatched FROM {last} GROUP BY doc_id)
SELECT d.doc_id, coalesce(o.licences, '') AS licences, CAST(coalesce(n_sentences, 0) AS BIGINT) AS n_sentences,
  CAST(coalesce(n_unmatched, 0) AS BIGINT) AS n_unmatched
FROM documents d LEFT JOIN one o USING (doc_id)"""


@query("op1_license_scan", _license_sql())
def _op1(table) -> DataFrame:
    found = license_scan.scan(table("documents").select("doc_id", "text"))
    return found.select("row.doc_id", F.array_join("licences", "+").alias("licences"), "n_sentences", "n_unmatched")


# The rules of the query.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


@query(
    "op5_url_filter",
    f"""
WITH rules(h, p, v) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
cut AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut),
urls AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts),
fit AS (SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict
  FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN fit USING (page_id)""",
)
def _op5(table) -> DataFrame:
    pages = table("pages").select("page_id", "url")
    rules = pages.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(map(str, URL_RULES))} AS t(host, path, verdict)")
    return url_filter.judge(pages, rules).select("row.page_id", "host", "path", "rule", "verdict")


def quality_sql(kept_columns: str = "") -> str:
    """The quality query; with ``kept_columns`` the kept documents instead."""
    words = r"[^\x20\x09-\x0D]+"
    rate = ", ".join(f"sum(CAST(f_{r} AS BIGINT)) / count(*) AS r_{r}, sum(CAST(f_{r} AS BIGINT)) AS c_{r}" for r in quality.RULES)
    prior = ", ".join(f"avg(r_{r}) AS m_{r}, var_pop(r_{r}) AS v_{r}" for r in quality.RULES)
    strength = {r: f"greatest(m_{r} * (1 - m_{r}) / nullif(v_{r}, 0) - 1, 0)" for r in quality.RULES}
    shrunk = [f"coalesce((c_{r} + m_{r} * {strength[r]}) / (n + {strength[r]}), m_{r})" for r in quality.RULES]
    final = (
        f"SELECT {kept_columns} FROM judged WHERE kept"
        if kept_columns
        else "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"
    )
    return f"""
WITH d AS (SELECT *, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{words}') AS ws FROM d),
wins AS (SELECT rid, i, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
rep AS (SELECT rid, i FROM wins QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d),
dup AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM ln WHERE regexp_matches(l, '{words}') GROUP BY rid),
m AS (SELECT w.*, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid) LEFT JOIN dup USING (rid)),
f AS (SELECT *, n_words < {quality.MIN_WORDS} AS f_short, 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS f_repeats,
  10 * n_symbols > n_words AS f_symbols, 10 * n_dup_lines > n_words AS f_lines FROM m),
hosts AS (SELECT source AS host, count(*) AS n, {rate} FROM f GROUP BY source),
prior AS (SELECT {prior} FROM hosts),
bad AS (SELECT host, greatest({", ".join(shrunk)}) > {quality.HOST_LIMIT} AS rejected FROM hosts, prior),
judged AS (SELECT f.* EXCLUDE (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words),
  CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  f_short OR f_repeats AS base_failed, NOT (f_short OR f_repeats) AND NOT rejected AS kept
  FROM f JOIN bad ON f.source IS NOT DISTINCT FROM bad.host)
{final}"""


@query("op10_quality_rules", quality_sql())
def _op10(table) -> DataFrame:
    judged = quality.judge(table("documents"), carried=["doc_id", "source"])
    return judged.select("row.doc_id", "m.*", "base_failed", "kept")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_packing")
def _op2(table) -> DataFrame:
    return packing.digests(packing.pack(table("documents"), _tokenizer("byte_bpe_50k.json")))


@query("op6_token_files")
def _op6(table) -> DataFrame:
    docs = table("documents")
    path = token_files.shared_path(docs.sparkSession)
    token_files.write_tokens(docs, path, _tokenizer("word_bpe_49k.json"))
    return token_files.read_tokens(docs.sparkSession, path, F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


@query("op8_line_dedup")
def _op8(table) -> DataFrame:
    report = line_dedup.line_report(table("documents"))
    return report.select("doc_id", "n_lines", F.size("dropped").cast("bigint").alias("n_dropped"), F.array_join("dropped", ",").alias("dropped"))


@query("op9_ngram_join")
def _op9(table) -> DataFrame:
    return ngram_join.classify(table("documents")).drop("node")


@query("op3_decontamination")
def _op3(table) -> DataFrame:
    return decontaminate.find_leaks(table("documents"), table("benchmark"))


@query("op7_substring_dedup")
def _op7(table) -> DataFrame:
    passages = chunk_dedup.repeated_passages(table("documents"))
    start = F.col("start").cast("bigint")
    return passages.select("doc_id", start.alias("start_word"), (F.col("end") - F.col("start")).cast("bigint").alias("n_words"), F.col("firsts").alias("first_doc_ids"))


@query("op4_pii")
def _op4(table) -> DataFrame:
    found = pii.find(table("documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("doc_id", *[count(k) for k in pii.KINDS[:4]], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query("op11_alignment")
def _op11(table) -> DataFrame:
    report = alignment.link_report(table("documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"), ["doc_id"])
    return report.select("row.doc_id", *report.columns[1:])


@query("op12_sharding")
def _op12(table) -> DataFrame:
    docs = table("documents")
    path = shards.shared_path(docs.sparkSession)
    shards.write_shards(docs, path)
    t = F.col("row.text")
    return shards.read_shards(docs.sparkSession, path, docs).select(
        "row.doc_id", shards.size_of(t).alias("size"), F.crc32(F.coalesce(t, F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op13_whitening")
def _op13(table) -> DataFrame:
    found = whitening.components(table("embeddings"), ["vec_id"])
    # the sum outgrows a long at about 1e8 rows; it is null there and exact in the operator
    return found.withColumn("deviation", F.expr("try_cast(deviation as bigint)")).select("row.vec_id", *found.columns[1:])
