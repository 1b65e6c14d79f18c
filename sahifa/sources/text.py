"""Blocks and pages from plain text, tables of pages, conversations and page-marked files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sahifa.config import BLOCKS, CHUNK, PAGES
from sahifa.functions.text import or_empty, present, strip

PAGE_LINES, LINE_HEIGHT, PAGE_HEIGHT = 20, 50.0, 1000.0


def as_blocks(df: DataFrame) -> DataFrame:
    """``df`` in the columns and types of blocks; columns that it lacks are null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in BLOCKS.fields))


def document_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines that aren't blank, with their place among all lines of the text."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(or_empty(F.col(text_col)), "\n")).alias("seq", "line"))
    return rows.filter(strip(F.col("line")) != "")


def conversation_blocks(conversations: DataFrame) -> DataFrame:
    """A conversation as a document of one page, a block for each turn; the role is the section."""
    return as_blocks(conversations.select(F.col("conv_id").cast("string").alias("doc_id"), F.lit(1).alias("page_number"), F.col("turn").alias("block_seq"), F.lit("paragraph").alias("type"), F.col("text").alias("en"), F.col("role").alias("section")))


def page_marked(text: Column) -> Column:
    """Pages of a text with ``--- Page N ---`` lines, as an array of (page_number, text)."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)--- Page (\d+) ---\n\n(.*?)(?=\n\n--- Page \d+ ---|\z)"), F.lit(0))
    return F.transform(
        found, lambda p: F.struct(F.regexp_extract(p, r"^--- Page (\d+) ---", 1).cast("int").alias("page_number"), strip(F.regexp_replace(p, r"^--- Page \d+ ---\n\n", "")).alias("text"))
    )


def read_page_marked(spark: SparkSession, path: str) -> DataFrame:
    """Page-marked files, one document each; of pages with one number the last counts."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value"))
    rows = files.select("doc_id", F.posexplode(page_marked(F.col("value"))).alias("i", "p")).select("doc_id", "i", "p.*")
    return rows.groupBy("doc_id", "page_number").agg(F.max_by("text", "i").alias("text"))


def blocks_of_pages(pages: DataFrame) -> DataFrame:
    """Nested pages (``doc_id``, ``pageNumber``, ``blocks``) to rows of blocks."""
    rows = pages.select("doc_id", F.col("pageNumber").alias("page_number"), F.posexplode("blocks").alias("block_seq", "b"))
    box = [F.get("b.bbox", F.lit(k)).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))]
    return as_blocks(rows.select("doc_id", "page_number", "block_seq", "b.type", "b.content.ar", "b.content.en", *box, "b.chapter", "b.section"))


def pages_of_blocks(blocks: DataFrame) -> DataFrame:
    """Rows of blocks to nested pages."""
    box = F.when(F.col("x0").isNotNull(), F.array("x0", "y0", "x1", "y1"))
    block = F.struct("type", F.struct("ar", "en").alias("content"), box.alias("bbox"), "chapter", "section")
    rows = blocks.groupBy("doc_id", F.col("page_number").alias("pageNumber")).agg(F.array_sort(F.collect_list(F.struct("block_seq", block.alias("b")))).alias("rows"))
    return rows.select("doc_id", "pageNumber", F.transform("rows", lambda r: r["b"]).alias("blocks"))


def read_json_pages(spark: SparkSession, path: str) -> DataFrame:
    """Files with a list of pages each, as the extraction phase writes them."""
    files = spark.read.schema(PAGES).option("multiLine", True).json(path)
    return blocks_of_pages(files.select(F.input_file_name().alias("doc_id"), "pageNumber", "blocks"))


def read_json_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Files with ``{"chunks": [...]}`` or a bare list of chunks."""
    schema = T.StructType([*CHUNK.fields, T.StructField("chunks", T.ArrayType(CHUNK))])
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("doc_id", F.input_file_name()).withColumn("_row", F.monotonically_increasing_id())
    bare = F.array(F.struct("chunk_id", "content", "metadata"))
    each = rows.select("doc_id", "_row", F.posexplode(F.coalesce("chunks", bare)).alias("_at", "c"))
    flat = each.select("doc_id", F.struct("_row", "_at").alias("chunk_seq"), "c.chunk_id", "c.content.*", "c.metadata.*")
    return flat.withColumn("chunk_id", F.coalesce("chunk_id", F.lit("unknown")))


def original_page(blocks: DataFrame) -> DataFrame:
    """Pages of an original for comparison: block texts longer than two characters, joined by line ends."""
    text = strip(F.coalesce(present(F.col("ar")), F.col("en"), F.lit("")))
    rows = blocks.withColumn("_t", text).filter(F.length("_t") > 2)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_seq", "_t"))), lambda r: r["_t"]), "\n")
    return rows.groupBy("doc_id", "page_number").agg(joined.alias("text"))


