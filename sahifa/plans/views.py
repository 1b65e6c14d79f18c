"""Bilingual test views of the plain tables, the same in Spark and in SQL.

The tables have no Arabic and no layout, so both are derived: a line is a block, letters are mapped one to one to
Arabic ones, and page, type, box and language follow from a line's place.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sahifa.operators.headings import fill_headings
from sahifa.sources.text import document_lines

LATIN, ARABIC = "abcdefghijklmnopqrstuvwxyz", "ابتثجحخدذرزسشصضطظعغفقكلمنه"
RICH_FROM, RICH_TO = "بتثجح", "أةـىُ"


def to_arabic(c: Column) -> Column:
    return F.translate(F.lower(c), LATIN, ARABIC)


class Views:
    """The views of one directory of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def lines(self) -> DataFrame:
        return document_lines(self.table("documents"))

    @cached_property
    def blocks(self) -> DataFrame:
        """Lines as blocks of bilingual pages of twenty lines, with headings that can be read."""
        seq = F.col("seq")
        page = (F.floor(seq / 20) + 1).cast("int")
        word = F.regexp_extract("line", "[A-Za-z]+", 0)
        kind = F.when(seq % 40 == 33, "toc").when(seq % 10 == 0, "header").when(seq % 10 == 9, "footer").when(seq % 10 == 6, "table").otherwise("paragraph")
        text = F.when(seq % 20 == 0, F.concat(F.lit("Chapter "), page.cast("string"), F.lit(" : "), word)).when(seq % 20 == 10, F.concat(F.lit("Section "), page.cast("string"), F.lit(" : "), word)).otherwise(F.col("line"))
        rows = self.lines.select("doc_id", page.alias("page_number"), seq.alias("block_seq"), kind.alias("type"), text.alias("text"), F.when(seq % 10 == 0, 1).otherwise((F.col("doc_id") + F.floor(seq / 4)) % 3).alias("kind"))
        y0, x0 = (F.col("block_seq") % 20 * 50).cast("double"), F.when(F.col("kind") == 0, 300.0).otherwise(40.0)
        return rows.select(
            "doc_id", "page_number", "block_seq", "type", F.when(F.col("kind") != 1, to_arabic(F.col("text"))).alias("ar"), F.when(F.col("kind") != 0, F.col("text")).alias("en"), x0.alias("x0"), y0.alias("y0"),
            (x0 + 200 + F.col("block_seq") % 7).alias("x1"), (y0 + 30 + F.col("block_seq") % 3 * 20).alias("y1"),
        )

    @cached_property
    def headed(self) -> DataFrame:
        return fill_headings(self.blocks)

    @cached_property
    def rich(self) -> DataFrame:
        """Arabic with hamza carriers, tatweel and diacritics, and with letter groups that the rules rewrite."""
        broken = F.replace(F.replace(F.col("ar"), F.lit("ش"), F.lit("امل")), F.lit("ب"), F.lit("اال"))
        spaced = F.replace(F.replace(F.coalesce("en", "ar"), F.lit(". "), F.lit(" .")), F.lit(", "), F.lit(" \n\n\n\n,"))
        return self.blocks.select("doc_id", "block_seq", "type", F.translate("ar", RICH_FROM, RICH_TO).alias("rich"), broken.alias("broken"), spaced.alias("spaced"))

    @cached_property
    def chunks(self) -> DataFrame:
        """Blocks as chunks with faults: identifiers that repeat, flags that are missing."""
        kind = F.when(F.col("type") == "paragraph", "narrative").when(F.col("type").isin("table", "toc"), F.col("type")).otherwise("glossary")
        allowed = F.when(F.col("block_seq") % 13 != 5, F.col("type").isin("paragraph", "table"))
        en = F.when((F.col("block_seq") % 9 == 4) & F.col("ar").isNotNull(), F.col("ar")).otherwise(F.col("en"))
        return self.headed.select(
            "doc_id", F.col("block_seq").alias("chunk_seq"), F.concat(F.lit("c_"), F.col("doc_id").cast("string"), F.lit("_"), F.floor(F.col("block_seq") / 2).cast("string")).alias("chunk_id"), "ar", en.alias("en"), "chapter", "section",
            F.when(F.col("block_seq") % 19 == 7, 0).otherwise(F.col("page_number")).alias("page_start"), F.col("page_number").alias("page_end"), kind.alias("chunk_type"),
            F.when(F.col("ar").isNotNull() & F.col("en").isNotNull(), F.array(F.lit("en"), F.lit("ar"))).when(F.col("ar").isNotNull(), F.array(F.lit("ar"))).otherwise(F.array(F.lit("en"))).alias("language"),
            allowed.alias("embedding_allowed"),
        )

    @cached_property
    def page_texts(self) -> DataFrame:
        """Texts of pages: their lines, every third one in Arabic and every seventh one numbered, in order."""
        line = F.when(F.col("seq") % 3 == 0, to_arabic(F.col("line"))).when(F.col("seq") % 7 == 1, F.concat("line", F.lit(" .. 12"))).otherwise(F.col("line"))
        rows = self.lines.groupBy("doc_id", (F.floor(F.col("seq") / 20) + 1).cast("int").alias("page_number")).agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("rows"))
        return rows.select("doc_id", "page_number", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"))


# The same views in DuckDB's SQL.
LINES_SQL = r"""
lines AS (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS seq, l AS line
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
  WHERE regexp_matches(l, '\S')
)"""
BLOCKS_SQL = LINES_SQL + rf""", typed AS (
  SELECT doc_id, CAST(1 + seq // 20 AS INTEGER) AS page_number, seq AS block_seq,
         CASE WHEN seq % 40 = 33 THEN 'toc' WHEN seq % 10 = 0 THEN 'header' WHEN seq % 10 = 9 THEN 'footer' WHEN seq % 10 = 6 THEN 'table' ELSE 'paragraph' END AS type,
         CASE WHEN seq % 20 = 0 THEN 'Chapter ' || (1 + seq // 20) || ' : ' || regexp_extract(line, '[A-Za-z]+')
              WHEN seq % 20 = 10 THEN 'Section ' || (1 + seq // 20) || ' : ' || regexp_extract(line, '[A-Za-z]+') ELSE line END AS text,
         CASE WHEN seq % 10 = 0 THEN 1 ELSE (doc_id + seq // 4) % 3 END AS kind
  FROM lines
), blocks AS (
  SELECT doc_id, page_number, block_seq, type, CASE WHEN kind <> 1 THEN translate(lower(text), '{LATIN}', '{ARABIC}') END AS ar, CASE WHEN kind <> 0 THEN text END AS en,
         CASE WHEN kind = 0 THEN 300.0 ELSE 40.0 END::DOUBLE AS x0, (block_seq % 20 * 50)::DOUBLE AS y0,
         (CASE WHEN kind = 0 THEN 300.0 ELSE 40.0 END + 200 + block_seq % 7)::DOUBLE AS x1, (block_seq % 20 * 50 + 30 + block_seq % 3 * 20)::DOUBLE AS y1
  FROM typed
)"""


def name_sql(text: str, keyword: str) -> str:
    """A heading's name, as ``heading_name`` reads it."""
    found = rf"""CASE WHEN regexp_matches({text}, '(?i)(?:{keyword})\s*[0-9]+\s*[:：]\s*([^\t\n\r0-9]+)') THEN regexp_extract({text}, '(?i)(?:{keyword})\s*[0-9]+\s*[:：]\s*([^\t\n\r0-9]+)', 1)
        WHEN regexp_matches({text}, '(?i)([^\t\n\r]+?)\s*[:：]\s*(?:{keyword})') THEN regexp_extract({text}, '(?i)([^\t\n\r]+?)\s*[:：]\s*(?:{keyword})', 1) END"""
    return rf"nullif(trim(regexp_replace(regexp_replace(trim({found}), '\s*[0-9]+.*$', ''), '\s{{2,}}', ' ', 'g')), '')"


HEADED_SQL = BLOCKS_SQL + rf""", read1 AS (
  SELECT *, {name_sql("CASE WHEN type = 'header' THEN coalesce(nullif(ar, ''), nullif(en, '')) END", "الفصل|Chapter")} AS c FROM blocks
), read2 AS (
  SELECT *, CASE WHEN c IS NULL THEN {name_sql("CASE WHEN type = 'header' THEN coalesce(nullif(ar, ''), nullif(en, '')) END", "القسم|Section")} END AS s FROM read1
), islands AS (
  SELECT *, last_value(c IGNORE NULLS) OVER w AS chapter, count(c) OVER w AS island FROM read2 WINDOW w AS (PARTITION BY doc_id ORDER BY page_number, block_seq ROWS UNBOUNDED PRECEDING)
), headed AS (
  SELECT doc_id, page_number, block_seq, type, ar, en, x0, y0, x1, y1, chapter,
         last_value(s IGNORE NULLS) OVER (PARTITION BY doc_id, island ORDER BY page_number, block_seq ROWS UNBOUNDED PRECEDING) AS section
  FROM islands
)"""
CHUNKS_SQL = HEADED_SQL + """, chunks AS (
  SELECT doc_id, block_seq AS chunk_seq, 'c_' || doc_id || '_' || (block_seq // 2) AS chunk_id, ar, CASE WHEN block_seq % 9 = 4 AND ar IS NOT NULL THEN ar ELSE en END AS en, chapter, section,
         CASE WHEN block_seq % 19 = 7 THEN 0 ELSE page_number END AS page_start, page_number AS page_end,
         CASE WHEN type = 'paragraph' THEN 'narrative' WHEN type IN ('table', 'toc') THEN type ELSE 'glossary' END AS chunk_type,
         CASE WHEN ar IS NOT NULL AND en IS NOT NULL THEN ['en', 'ar'] WHEN ar IS NOT NULL THEN ['ar'] ELSE ['en'] END AS language,
         CASE WHEN block_seq % 13 <> 5 THEN type IN ('paragraph', 'table') END AS embedding_allowed
  FROM headed
)"""
RICH_SQL = BLOCKS_SQL + f""", rich AS (
  SELECT doc_id, block_seq, type, translate(ar, '{RICH_FROM}', '{RICH_TO}') AS rich, replace(replace(ar, 'ش', 'امل'), 'ب', 'اال') AS broken,
         replace(replace(coalesce(en, ar), '. ', ' .'), ', ', ' ' || repeat(chr(10), 4) || ',') AS spaced
  FROM blocks
)"""
PAGES_SQL = LINES_SQL + f""", page_texts AS (
  SELECT doc_id, CAST(1 + seq // 20 AS INTEGER) AS page_number,
         string_agg(CASE WHEN seq % 3 = 0 THEN translate(lower(line), '{LATIN}', '{ARABIC}') WHEN seq % 7 = 1 THEN line || ' .. 12' ELSE line END, chr(10) ORDER BY seq) AS text
  FROM lines GROUP BY ALL
)"""
