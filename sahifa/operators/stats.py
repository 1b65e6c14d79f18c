"""Counts and sizes of blocks and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sahifa.functions.text import ARABIC, count_matches, or_empty, present
from sahifa.operators.classify import has_metadata
from sahifa.operators.evaluate import english_words


def has(c: str):
    return present(F.col(c)).isNotNull()


def page_counts(blocks: DataFrame) -> DataFrame:
    """Pages of each document: the greatest page number of its blocks."""
    return blocks.groupBy("doc_id").agg(F.coalesce(F.max("page_number"), F.lit(0)).alias("pages"))


def text_stats(blocks: DataFrame) -> DataFrame:
    """Per document: characters, Arabic letters, English words, pages."""
    text = F.concat(or_empty(F.col("ar")), F.lit(" "), or_empty(F.col("en")))
    total = F.length(or_empty(F.col("ar"))) + F.length(or_empty(F.col("en")))
    return blocks.groupBy("doc_id").agg(
        F.sum(total).alias("total_chars"), F.sum(count_matches(text, ARABIC)).alias("arabic_chars"), F.sum(english_words(text)).alias("english_words"), F.coalesce(F.max("page_number"), F.lit(0)).alias("pages")
    )


def chunk_totals(chunks: DataFrame) -> DataFrame:
    """One row: chunks, narrative ones, tables; glossaries count in the total only."""
    of = lambda kind: F.count_if(F.col("chunk_type") == kind)
    return chunks.agg(F.count(F.lit(1)).alias("total_chunks"), of("narrative").alias("narrative_chunks"), of("table").alias("table_chunks"))


def chunk_sizes(chunks: DataFrame) -> DataFrame:
    """One row: average, least and greatest size, bilingual chunks, chunks that may be embedded."""
    size = F.length(or_empty(F.col("ar"))) + F.length(or_empty(F.col("en")))
    return chunks.agg(
        F.avg(size).alias("avg_size"), F.min(size).alias("min_size"), F.max(size).alias("max_size"), F.count_if(has("ar") & has("en")).alias("bilingual"), F.count_if(F.col("embedding_allowed")).alias("embeddable")
    )


def type_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def language_counts(blocks: DataFrame) -> DataFrame:
    """Per type: blocks with Arabic only, with English only, with both."""
    return blocks.groupBy("type").agg(F.count_if(has("ar") & ~has("en")).alias("ar_only"), F.count_if(has("en") & ~has("ar")).alias("en_only"), F.count_if(has("ar") & has("en")).alias("both"))


def language_tuples(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(F.array_join(F.array_sort("language"), ",").alias("languages")).agg(F.count(F.lit(1)).alias("n"))


def page_headings(blocks: DataFrame) -> DataFrame:
    """Per page: headers, and blocks that have a chapter or section."""
    return blocks.groupBy("doc_id", "page_number").agg(F.count_if(F.col("type") == "header").alias("headers"), F.count_if(has_metadata(F.col("chapter"), F.col("section"))).alias("with_metadata"))


def metadata_coverage(blocks: DataFrame) -> DataFrame:
    return blocks.agg(
        F.count(F.lit(1)).alias("blocks"), F.count_if(has("chapter")).alias("with_chapter"), F.count_if(has("section")).alias("with_section"), F.count_if(has_metadata(F.col("chapter"), F.col("section"))).alias("with_either")
    )


def first_rows(df: DataFrame, n: int, order: list[str], per: list[str]) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")
