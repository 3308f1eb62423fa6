"""The queries op1 to op13: each operator with production parameters on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, divergence, html_extract, line_dedup, lm_scoring, packing, quality, resampling, simhash, token_counts, toxicity, warc, winnowing

TOKEN_LIMIT = 512
SEQUENCE = 1024


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.token_lengths(table(spark, sf_dir, "documents"), vocabulary())
    return found.select("doc_id", "n_bytes", "n_tokens", token_counts.over(TOKEN_LIMIT))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary(), capacity=SEQUENCE)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    found = toxicity.scored(docs, model)
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", F.size("passages").alias("n_passages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extracted(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.deduplicated(docs, count_col="n_removed")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read_back(warc.archived(table(spark, sf_dir, "pages"), least=0))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=3, width=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"), least=30, most=50)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least=20, seed=42)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compared(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_packing, op3_lm_scoring, op4_toxicity, op5_quality, op6_html, op7_line_dedup, op8_warc, op9_decontamination, op10_simhash, op11_divergence, op12_resampling, op13_fingerprints)}


#: Each base 32 digit is five bits of one of four runs of ten hex digits of the SHA-1.
OP8_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS n, upper(sha1(h)) AS x, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST(concat('0x', substr(x, CAST(1 + 10 * (i // 8) AS BIGINT), 10)) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) AS BIGINT), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to, TRUE AS verified FROM d"""


#: Every group with every kept term of its lang, shares in 128-bit integers.
OP11_SQL = r"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents),
w AS (SELECT id, lang, source, unnest(found) AS term FROM d),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 30),
langs AS (SELECT lang, sum(total) AS n, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS size FROM groups g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (s.size + 5 * l.v) AS p, 1 + (1000000000 * (k.total + 5)) // (l.n + 5 * l.v) AS q
  FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
every AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM every)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= 50"""


def oracle_sql() -> dict[str, str]:
    return {"op8_warc": OP8_SQL, "op11_divergence": OP11_SQL}
