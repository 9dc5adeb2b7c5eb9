"""Registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.llm import (
    alignment, bpe, divergence, language, leaks, packing, quality, rans, sampling, simhash, token_counts, toxicity, vectors,
)
from txnrisk.llm.tables import read

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), BYTE_BPE)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), BYTE_BPE)


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


NEAR_VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT r.a AS vec_id, coalesce(n, 0)::BIGINT AS n_links, r.root AS component_id, r.root = r.a AS kept
FROM (SELECT a, min(b) AS root FROM reach GROUP BY a) r
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON r.a = l.a"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.document_fingerprints(read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(read(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), BYTE_BPE)


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.store_and_read(read(spark, sf_dir, "documents"), WORD_BPE)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ, and the terms that mark each source."""
    return divergence.divergence(read(spark, sf_dir, "documents"))


SOURCE_DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
every AS (
  SELECT g.lang, g.source, term, coalesce(n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
sums AS (SELECT lang, source, sum(n) AS total FROM every GROUP BY lang, source),
p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS p
  FROM every JOIN sums USING (lang, source) JOIN sizes USING (lang)),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(whole) + 5 * any_value(v)) AS q
  FROM every JOIN sizes USING (lang) JOIN (SELECT lang, sum(total) AS whole FROM sums GROUP BY lang) USING (lang)
  GROUP BY lang, term),
differ AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN differ ON differ.lang = a.lang AND differ.source = a.source AND differ.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers, and how usual the links are."""
    return alignment.alignment(read(spark, sf_dir, "documents"), BYTE_BPE, PIECES)


def op13_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside passages of the benchmark, and the items they come from."""
    found = leaks.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


BENCHMARK_LEAKS_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, unnest(list_transform(
    range(1, greatest(1, len(w) - 9) + 1), lambda k: array_to_string(w[k : k + least(len(w), 10) - 1], ' '))) AS key
  FROM i WHERE len(w) > 0),
widths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, n, unnest(range(1, len(w) - n + 2)) AS k,
    unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k : k + n - 1], ' '))) AS key
  FROM d, widths WHERE len(w) >= n),
found AS (SELECT r, k, places.n, item FROM places JOIN windows ON places.key = windows.key AND places.n = windows.n),
hits AS (
  SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + n)) AS at FROM (SELECT DISTINCT r, k, n FROM found))
  GROUP BY r),
names AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS all_items
  FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(all_items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN names USING (r)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality, op2_token_counts, op3_packing, op4_near_vectors, op5_toxicity, op6_fingerprints, op7_simhash,
        op8_language, op9_bpe, op10_token_ids, op11_source_divergence,
        op12_token_alignment, op13_benchmark_leaks,
    )
}
ORACLES: dict[str, str] = {
    "op4_near_vectors": NEAR_VECTORS_SQL, "op11_source_divergence": SOURCE_DIVERGENCE_SQL,
    "op13_benchmark_leaks": BENCHMARK_LEAKS_SQL,
}
