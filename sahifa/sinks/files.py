"""Pages, blocks and chunks as JSON, and chunks as a report to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sahifa.functions.text import file_name, present
from sahifa.sources.text import pages_of_blocks

RULE = "=" * 80


def write_pages(blocks: DataFrame, path: str) -> None:
    """Nested pages, a JSON object a line."""
    pages_of_blocks(blocks).write.json(path)


def write_blocks(blocks: DataFrame, path: str) -> None:
    blocks.select("doc_id", F.col("page_number").alias("pageNumber"), "type", F.struct("ar", "en").alias("content"), "chapter", "section").write.json(path)


def nested_chunk() -> Column:
    metadata = F.struct("document", "year", "chapter", "section", "page_start", "page_end", "chunk_type", "language", "embedding_allowed")
    return F.struct("chunk_id", F.struct("ar", "en").alias("content"), metadata.alias("metadata"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.select("doc_id", "chunk_seq", nested_chunk().alias("c")).select("doc_id", "chunk_seq", "c.*").write.json(path)


def report_text(number: Column) -> Column:
    """A chunk as the report shows it; missing chapter and section lines are left out."""
    maybe = lambda label, c: F.when(present(F.col(c)).isNotNull(), F.concat(F.lit(f"{label}: "), F.col(c)))
    line = lambda label, c: F.concat(F.lit(f"{label}: "), c.cast("string"))
    return F.concat_ws(
        "\n", F.lit(""), F.lit(RULE), F.concat(F.lit("CHUNK #"), number.cast("string")), F.lit(RULE), line("Chunk ID", F.col("chunk_id")), line("Type", F.col("chunk_type")), line("Document", F.col("document")),
        line("Year", F.col("year")), maybe("Chapter", "chapter"), maybe("Section", "section"), F.concat(F.lit("Pages: "), F.col("page_start").cast("string"), F.lit(" - "), F.col("page_end").cast("string")),
        line("Languages", F.array_join("language", ", ")), line("Embedding Allowed", F.initcap(F.col("embedding_allowed").cast("string"))), F.lit(""), F.lit("--- Arabic Content ---"),
        F.coalesce(present(F.col("ar")), F.lit("(No Arabic content)")), F.lit(""), F.lit("--- English Content ---"), F.coalesce(present(F.col("en")), F.lit("(No English content)")), F.lit(""),
    )


def report_name(document: Column, at: Column) -> Column:
    return F.concat(file_name(document), F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(".txt"))


def write_report(chunks: DataFrame, path: str) -> None:
    """A text file per document folder, its chunks in order and numbered from 1 on."""
    shown = chunks.select("doc_id", "chunk_seq", report_text(F.col("chunk_seq") + 1).alias("value"))
    shown.repartition("doc_id").sortWithinPartitions("doc_id", "chunk_seq").select("value", "doc_id").write.partitionBy("doc_id").text(path)
