"""The queries of this subpackage over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sahifa.llm import bpe, exact_dedup, html_extract, line_dedup, mixing, ngram_join, quality_rules, secrets, sharding, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.assess(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept", "posterior")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_components(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard(table(spark, sf_dir, "documents"))
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_verdicts(table(spark, sf_dir, "documents")).select(F.col("_id").alias("doc_id"), "n_lines", "n_kept", "dropped")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

OP6_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
o AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS owner FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND page_id IS DISTINCT FROM owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM owner THEN owner END AS refers_to
FROM o
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix:' || CAST(doc_id AS VARCHAR)) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source
), l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(3 * source_size) OVER before, 0) AS DOUBLE))
            / CAST(sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS DOUBLE) AS level,
         CAST(3 * source_size AS DOUBLE) / w AS r
  FROM s WINDOW before AS (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size,
         least(coalesce((SELECT level FROM l AS m WHERE m.level * m.w <= 3 * m.source_size ORDER BY m.r, m.source NULLS LAST LIMIT 1) * w, 3.0 * source_size), 3.0 * source_size) AS target
  FROM l
), q AS (
  SELECT d.*, t.source_size, t.target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS queued
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT q.*, e.e, CASE WHEN target > 0 THEN CAST(e.e * source_size + queued AS DOUBLE) / target ELSE 0 END AS finish
  FROM q JOIN (VALUES (0), (1), (2)) AS e(e) ON e.e = 0 OR (target > 0 AND e.e <= floor(target / source_size) + 1)
), o AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS FIRST, e, k, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM p
)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(size * count(*) FILTER (total <= (SELECT sum(size) FROM d)) AS BIGINT) AS taken
FROM o GROUP BY doc_id, size, source_size, target, source
"""


def queries() -> dict:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_html_extraction": op3_html_extraction,
        "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
        "op5_sharding": op5_sharding,
        "op6_warc": op6_warc,
        "op7_line_dedup": op7_line_dedup,
        "op8_mixing": op8_mixing,
        "op9_bpe": op9_bpe,
        "op10_secrets": op10_secrets,
    }


def oracles() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op6_warc": OP6_SQL, "op8_mixing": OP8_SQL}
