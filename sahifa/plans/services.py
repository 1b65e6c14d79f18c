"""The three services from end to end: extract, chunk, and scanned files to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sahifa.config import ChunkConfig, OcrConfig
from sahifa.functions.frames import once
from sahifa.functions.normalise import block_text, english_text
from sahifa.functions.text import present
from sahifa.operators.chunking import Chunker, chunk_blocks
from sahifa.operators.classify import known_type
from sahifa.operators.headings import fill_headings
from sahifa.operators.merging import merge_scanned, repair_fragments
from sahifa.operators.pairing import pair_blocks
from sahifa.sources import pdf


def normalise(blocks: DataFrame) -> DataFrame:
    """Texts of the text layer normalised and torn paragraphs repaired."""
    kind = known_type(F.col("type"))
    has_ar, has_en = present(F.col("ar")).isNotNull(), present(F.col("en")).isNotNull()
    rows = once(blocks.withColumn("type", kind), "ar", F.when(has_ar, block_text(F.col("ar"), F.col("type"))))
    return repair_fragments(once(rows, "en", F.when(has_en, english_text(F.col("en"), F.col("type")))))


def layout(blocks: DataFrame) -> DataFrame:
    """Blocks as extracted to blocks as read: the two languages paired, headings carried on, order as paired."""
    paired = pair_blocks(blocks)
    # The new order of a page is by kind, then by the old order; it takes the place of ``block_seq``.
    ordered = paired.withColumn("block_seq", F.col("rank") * 10_000_000 + F.col("block_seq")).drop("rank")
    return fill_headings(ordered)


def extract(spark: SparkSession, path: str, max_pages: int | None = None) -> DataFrame:
    """PDF files with a text layer to normalised blocks."""
    return normalise(layout(pdf.read_text_layer(spark, path, max_pages)))


def chunk(blocks: DataFrame, config: ChunkConfig = ChunkConfig(), chunker: Chunker = chunk_blocks) -> DataFrame:
    """Normalised blocks to chunks, by any chunker."""
    return chunker(blocks, config)


def process_scanned(spark: SparkSession, path: str, ocr: OcrConfig = OcrConfig(), config: ChunkConfig = ChunkConfig(), chunker: Chunker = chunk_blocks) -> DataFrame:
    """Scanned PDF files to chunks."""
    blocks = merge_scanned(pdf.read_scanned(spark, path, ocr)).withColumn("block_seq", F.col("block_seq") * 2 + F.col("part")).drop("part")
    return chunk(blocks, config, chunker)
