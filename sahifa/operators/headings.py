"""Chapter and section names: reading them from headings and carrying them on to what follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sahifa.functions.text import or_empty, present, strip

CHAPTER, SECTION = "الفصل|Chapter", "القسم|Section"
COLON = "[:：]"


def first_group(text: Column, *patterns: tuple[str, str]) -> Column:
    """Group 1, which can't be empty, of the first pattern that is found; null if none is.

    A pattern that may begin anywhere takes the square of a text's length to fail, so each comes with a cheap one
    that has to be found as well.
    """
    return F.coalesce(*(F.when(or_empty(text).rlike(sign), present(F.regexp_extract(text, pattern, 1))) for sign, pattern in patterns))


def heading_name(text: Column, keyword: str) -> Column:
    """``Chapter 2 : Name`` or ``Name : Chapter``; the first that is found is cleaned, and may then be empty (null)."""
    after = rf"(?iU)(?:{keyword})\s*\d+\s*{COLON}\s*([^\t\n\r\d]+)"
    before = rf"(?iU)([^\t\n\r]+?)\s*{COLON}\s*(?:{keyword})"
    sign = rf"(?iU){COLON}\s*(?:{keyword})"
    name = strip(first_group(text, (rf"(?iu){keyword}", after), (sign, before)))
    return present(strip(F.regexp_replace(F.regexp_replace(name, r"(?U)\s*\d+.*$", ""), r"(?U)\s{2,}", " ")))


def chapter_name(text: Column) -> Column:
    return heading_name(text, CHAPTER)


def section_name(text: Column) -> Column:
    return heading_name(text, SECTION)


def lazy_name(text: Column, english: str, arabic: str) -> Column:
    """The other reading of headings: English up to a number, then Arabic, then either; only stripped."""
    either = f"{english}|{arabic}"
    return strip(
        first_group(
            text,
            (f"(?iu){english}", rf"(?iU){english}\s+\d+\s*:\s*([^0-9]+?)\s+\d+"),
            (arabic, rf"(?U){arabic}\s+\d+\s*:\s*(.+?)(?:\s+\d+|$)"),
            (f"(?iu){either}", rf"(?iU)(?:{either})\s*\d+\s*:\s*(.+)"),
            (rf"(?iU):\s*(?:{either})", rf"(?iU)(.+?)\s*:\s*(?:{either})"),
        )
    )


def lazy_chapter(text: Column) -> Column:
    return lazy_name(text, "Chapter", "الفصل")


def lazy_section(text: Column) -> Column:
    return lazy_name(text, "Section", "القسم")


def fill_headings(blocks: DataFrame) -> DataFrame:
    """``chapter`` and ``section`` from the headers up to and with each block; a chapter ends the section before it.

    A header is read for its Arabic text if it has any, and gives a section only if it gives no chapter.
    """
    order = Window.partitionBy("doc_id").orderBy("page_number", "block_seq").rowsBetween(Window.unboundedPreceding, 0)
    text = F.when(F.col("type") == "header", F.coalesce(present(F.col("ar")), present(F.col("en"))))
    read = blocks.withColumn("_chapter", chapter_name(text)).withColumn("_section", F.when(F.col("_chapter").isNull(), section_name(text)))
    filled = read.withColumn("chapter", F.last("_chapter", ignorenulls=True).over(order)).withColumn("_island", F.count("_chapter").over(order))
    within = Window.partitionBy("doc_id", "_island").orderBy("page_number", "block_seq").rowsBetween(Window.unboundedPreceding, 0)
    return filled.withColumn("section", F.last("_section", ignorenulls=True).over(within)).drop("_chapter", "_section", "_island")


def fill_page_headings(pages: DataFrame) -> DataFrame:
    """For scanned pages (``doc_id``, ``page_number``, ``text``): names up to and with each page, each for itself.

    ``table_chapter`` and ``table_section`` are those before the page: its tables are made before its text is read.
    """
    order = Window.partitionBy("doc_id").orderBy("page_number")
    now, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    read = pages.withColumn("_chapter", chapter_name(F.col("text"))).withColumn("_section", section_name(F.col("text")))
    for kind in ("chapter", "section"):
        read = read.withColumn(kind, F.last(f"_{kind}", ignorenulls=True).over(now)).withColumn(f"table_{kind}", F.last(f"_{kind}", ignorenulls=True).over(before))
    return read.drop("_chapter", "_section")


def last_headings(blocks: DataFrame) -> DataFrame:
    """Per document the last chapter and section that any block has."""
    def last(kind: str) -> Column:
        return F.max_by(F.when(present(F.col(kind)).isNotNull(), F.col(kind)), F.when(present(F.col(kind)).isNotNull(), F.struct("page_number", "block_seq")))

    return blocks.groupBy("doc_id").agg(last("chapter").alias("last_chapter"), last("section").alias("last_section"))
