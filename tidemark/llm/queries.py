"""Registered queries of the training-data operators, each over its whole tables, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    main_text,
    mixing,
    periodic_runs,
    pieces,
    quality_compression,
    secret_scan,
    simhash_dedup,
    spelling_groups,
    term_simhash,
    token_blocks,
    topk_slices,
    url_filter,
    warc,
)
from .common import prepared, saved

END_ID = 2
#: Domains by label: good, poor (quality 0), toxic; and their target shares of tokens.
DOMAINS = ("good", "poor", "toxic")
TARGETS = (0.94, 0.03, 0.03)
#: Rules (host, path, verdict) of the url filter's report.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, folder: fn(prepared(spark), folder)
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def digits(fp: str) -> Column:
    """A signed long as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled table."""
    known = (labels["toxic"] == 1, labels["quality"] == 0, labels["quality"] == 1)
    number = F.when(known[0], 2).when(known[1], 1).when(known[2], 0)
    return labels.select(labels["doc_id"], number.cast("int").alias("domain"))


@query
def op1_topk_slices(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return topk_slices.top_rows(vectors, vectors.where("vec_id % 50 = 0"), 5)


ORACLES["op1_topk_slices"] = """
WITH fit AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM fit q JOIN fit c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op2_token_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return token_blocks.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)


@query
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    fitted = mixing.fitted(table(spark, folder, "documents"), domains(table(spark, folder, "labels")), TARGETS, "doc_id")
    return fitted.select("doc_id", "tokens", *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)), "rate")


@query
def op4_quality_compression(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality_compression.train(docs, table(spark, folder, "labels"))
    scored = quality_compression.scored(docs, model, "doc_id")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = secret_scan.scan(docs, secret_scan.thresholds(docs), "doc_id")

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = secret_scan.spelled(F.filter("spans", lambda s: s["kind"] < 3))
    counts = (count(i).alias(f"n_{k}") for i, k in enumerate(secret_scan.KINDS))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), secret_scan.spelled(F.col("spans")).alias("spans"))


@query
def op6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every whole text; the digest and the check come from encoding and decoding again."""
    docs = table(spark, folder, "documents")
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.decode(pieces.encode(docs, model, "doc_id"), model)
    spelled = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return coded.select(
        "doc_id", F.size("ids").alias("n_pieces"), F.sha2(spelled, 256).alias("ids_sha256"), F.length("decoded").cast("long").alias("decoded_chars"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query
def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.round_trip(table(spark, folder, "pages"), 0)
    page = F.regexp_extract("metadata.fields", r"^page-id: (-?\d*)", 1)
    refers = F.regexp_extract("response.refers_to", r"^<urn:capture:(-?\d*):", 1)
    return found.select(
        F.when(page != "", page.cast("long")).alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
    )


ORACLES["op7_warc"] = """
WITH own AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), bits AS (
  SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, body, hex,
         list_transform(string_split(hex, ''), lambda c: strpos('0123456789abcdef', c) - 1) AS d
  FROM own
), flat AS (
  SELECT page_id, payload_bytes, body,
         list_transform(range(0, 160), lambda i: CAST(floor(d[CAST(floor(i / 4) AS BIGINT) + 1] / (8 >> (i % 4))) AS BIGINT) % 2) AS b
  FROM bits
), named AS (
  SELECT page_id, payload_bytes, body,
         list_aggregate(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(1 + 16 * b[i + 1] + 8 * b[i + 2] + 4 * b[i + 3] + 2 * b[i + 4] + b[i + 5] AS BIGINT), 1)), 'string_agg', '') AS payload_digest
  FROM flat
), led AS (
  SELECT *, max(page_id) OVER (PARTITION BY body) AS first FROM named
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM led
"""


@query
def op8_term_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """With ``near_docs``: for ids divisible by 20, how many other documents lie within three bits."""
    found = term_simhash.neighbours(saved(term_simhash.edited_pairs(table(spark, folder, "documents")), "fingerprints"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        digits("fp").alias("fingerprint"),
        digits("edited_fp").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "near_docs",
    )


@query
def op9_main_text(spark: SparkSession, folder: str) -> DataFrame:
    found = main_text.main_texts(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op10_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash_dedup.near_components(table(spark, folder, "documents"), radius=3, words=3)
    return found.select("doc_id", digits("fp").alias("fingerprint"), "component_id")


@query
def op11_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    found = url_filter.judged(table(spark, folder, "pages"), URL_RULES, url_filter.VOCABULARY, "page_id")
    return found.select("page_id", "host", "path", "rule", "verdict", F.array_join("terms", " ").alias("terms"), "score")


def _listed(rows: Iterable[tuple]) -> str:
    """Rows of texts and numbers as the body of VALUES."""
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)


ORACLES["op11_url_filter"] = f"""
WITH rules(host, path, verdict) AS (VALUES {_listed(URL_RULES)}),
vocabulary(term, weight) AS (VALUES {_listed(url_filter.VOCABULARY.items())}),
cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), own AS (
  SELECT row_number() OVER () AS r, page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), hits AS (
  SELECT r, string_agg(term, ' ' ORDER BY term) AS terms, CAST(sum(weight) AS BIGINT) AS score
  FROM (SELECT r, ' ' || translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || ' ' AS own FROM own) t
  JOIN vocabulary ON contains(t.own, term) AND regexp_matches(t.own, '[^\\p{{L}}\\p{{N}}]' || term || '[^\\p{{L}}\\p{{N}}]')
  GROUP BY r
), fitting AS (
  SELECT r, arg_max(rules.host || rules.path, length(rules.host || rules.path)) AS rule,
         arg_max(verdict, length(rules.host || rules.path)) AS verdict
  FROM own JOIN rules
    ON (own.host = rules.host OR ends_with(own.host, '.' || rules.host)) AND starts_with(own.path, rules.path)
  GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN score >= {url_filter.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(terms, '') AS terms, coalesce(score, 0) AS score
FROM own LEFT JOIN hits USING (r) LEFT JOIN fitting USING (r)
"""


@query
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.periodic_runs(periodic_runs.looped(table(spark, folder, "documents")), "doc_id")
    ranked = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    spelled = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.withColumn("best", F.array_max(ranked))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(spelled, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op13_spelling_groups(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_groups.grouped(spelling_groups.word_counts(table(spark, folder, "documents")))
