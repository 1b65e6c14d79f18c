"""Named queries over the test tables, each with the SQL that DuckDB answers it with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sahifa.config import ChunkConfig
from sahifa.functions import language as lang
from sahifa.functions import normalise as norm
from sahifa.functions import rules, text
from sahifa.operators import chunking, classify, evaluate, headings, merging, pairing, quality, stats
from sahifa.plans import services
from sahifa.plans.views import BLOCKS_SQL, CHUNKS_SQL, HEADED_SQL, LINES_SQL, PAGES_SQL, RICH_SQL, Views, name_sql
from sahifa.sinks import files
from sahifa.sources import html
from sahifa.sources import text as sources

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[Views], DataFrame]], Callable[[Views], DataFrame]]:
    """Register a function of the views under its name, with its SQL."""

    def register(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


c = F.col

# SQL of the detectors of language, of stripping and of counting, over any SQL expression.
AR_SQL, EN_SQL = "[؀-ۿ]", "[A-Za-z]"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def count_sql(x: str, cls: str) -> str:
    return f"CAST(len(regexp_extract_all(coalesce({x}, ''), '{cls}')) AS INTEGER)"


def block_sql(x: str) -> str:
    a, e = (f"regexp_matches(coalesce({x}, ''), '{k}')" for k in (AR_SQL, EN_SQL))
    return f"CASE WHEN {a} AND NOT {e} THEN 'ar' WHEN {e} AND NOT {a} THEN 'en' ELSE 'mixed' END"


def wide_sql(x: str) -> str:
    a, e = (f"regexp_matches(coalesce({x}, ''), '{k}')" for k in ("[؀-ۿݐ-ݿࢠ-ࣿ]", EN_SQL))
    return f"CASE WHEN {a} AND {e} THEN 'mixed' WHEN {a} THEN 'ar' WHEN {e} THEN 'en' ELSE 'other' END"


def robust_sql(x: str) -> str:
    a, e = count_sql(x, AR_SQL), count_sql(x, EN_SQL)
    return f"""CASE WHEN length({strip_sql(f"coalesce({x}, '')")}) < 3 OR {a} + {e} = 0 THEN 'mixed' WHEN {a} / ({a} + {e}) > 0.7 THEN 'ar' WHEN {a} / ({a} + {e}) < 0.3 THEN 'en' ELSE 'mixed' END"""


def words_sql(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({x}, ''), '\s+'), lambda w: w <> '')"


BOTH_SQL = "coalesce(ar, '') || ' ' || coalesce(en, '')"


def both() -> Column:
    return F.concat(text.or_empty(c("ar")), F.lit(" "), text.or_empty(c("en")))


# ---- language


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, block_seq, {block_sql('ar')} AS of_ar, {block_sql('en')} AS of_en, {block_sql(BOTH_SQL)} AS of_both FROM blocks")
def detect_language_block(v: Views) -> DataFrame:
    return v.blocks.select("doc_id", "block_seq", lang.block_language(c("ar")).alias("of_ar"), lang.block_language(c("en")).alias("of_en"), lang.block_language(both()).alias("of_both"))


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, block_seq, {wide_sql('ar')} AS of_ar, {wide_sql('en')} AS of_en, {wide_sql(BOTH_SQL)} AS of_both FROM blocks")
def detect_lang_other(v: Views) -> DataFrame:
    return v.blocks.select("doc_id", "block_seq", lang.wide_language(c("ar")).alias("of_ar"), lang.wide_language(c("en")).alias("of_en"), lang.wide_language(both()).alias("of_both"))


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, block_seq, {robust_sql('ar')} AS of_ar, {robust_sql('en')} AS of_en, {robust_sql(BOTH_SQL)} AS of_both FROM blocks")
def detect_language_robust(v: Views) -> DataFrame:
    return v.blocks.select("doc_id", "block_seq", lang.robust_language(c("ar")).alias("of_ar"), lang.robust_language(c("en")).alias("of_en"), lang.robust_language(both()).alias("of_both"))


@query(f"""WITH {BLOCKS_SQL} SELECT doc_id, block_seq, CASE WHEN {strip_sql("coalesce(ar, '')")} <> '' AND {strip_sql("coalesce(en, '')")} = '' THEN 'ar'
    WHEN {strip_sql("coalesce(en, '')")} <> '' AND {strip_sql("coalesce(ar, '')")} = '' THEN 'en' ELSE 'mixed' END AS language FROM blocks""")
def language_presence(v: Views) -> DataFrame:
    return v.blocks.select("doc_id", "block_seq", lang.present_language(c("ar"), c("en")).alias("language"))


@query(rf"""WITH {PAGES_SQL}, l AS (SELECT doc_id, page_number, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql("x")}), lambda x: x <> '') AS ls FROM page_texts)
    SELECT doc_id, page_number, array_to_string(list_filter(ls, lambda x: {wide_sql("x")} = 'ar'), chr(10)) AS ar, array_to_string(list_filter(ls, lambda x: {wide_sql("x")} = 'en'), chr(10)) AS en,
           array_to_string(list_filter(ls, lambda x: {wide_sql("x")} IN ('mixed', 'other')), chr(10)) AS mixed FROM l""")
def split_lines_by_language(v: Views) -> DataFrame:
    parts = v.page_texts.select("doc_id", "page_number", lang.lines_by_language(c("text")).alias("p"))
    return parts.select("doc_id", "page_number", *(F.array_join(f"p.{k}", "\n").alias(k) for k in ("ar", "en", "mixed")))


PARALLEL_SQL = "CASE WHEN ar IS NOT NULL AND en IS NOT NULL THEN en || chr(10) || chr(10) || ar ELSE coalesce(ar, en) END"


@query(f"""WITH {BLOCKS_SQL}, t AS (SELECT doc_id, block_seq, {PARALLEL_SQL} AS t FROM blocks), p AS (SELECT *, strpos(t, chr(10) || chr(10)) AS pos FROM t),
    q AS (SELECT *, CASE WHEN pos > 0 THEN substring(t, 1, pos - 1) ELSE t END AS x, CASE WHEN pos > 0 THEN substring(t, pos + 2) END AS y FROM p)
    SELECT doc_id, block_seq, pos > 0 AND {robust_sql("x")} <> {robust_sql("y")} AND {robust_sql("x")} <> 'mixed' AND {robust_sql("y")} <> 'mixed' AS parallel FROM q""")
def parallel_structure(v: Views) -> DataFrame:
    joined = F.when(c("ar").isNotNull() & c("en").isNotNull(), F.concat("en", F.lit("\n\n"), "ar")).otherwise(F.coalesce("ar", "en"))
    return v.blocks.select("doc_id", "block_seq", lang.is_parallel(joined).alias("parallel"))


# ---- normalisation

DIACRITICS_SQL = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]"


def tight_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"


def scanned_sql(x: str) -> str:
    return strip_sql(tight_sql(f"translate(replace({x}, 'ـ', ''), 'أإآىة', 'ااايه')"))


def literals_sql(x: str, pairs: list[tuple[str, str]]) -> str:
    return reduce(lambda s, p: f"replace({s}, '{p[0]}', '{p[1]}')", pairs, x)


def spacing_sql(x: str) -> str:
    out = rf"regexp_replace(regexp_replace({x}, '[ \t\r\f\v]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    out = rf"regexp_replace(regexp_replace({out}, '\s+([،؟؛.,!])', '\1', 'g'), '([،؟؛.,!])([^\s])', '\1 \2', 'g')"
    return strip_sql(f"""array_to_string(list_transform(string_split({out}, chr(10)), lambda l: {strip_sql("l")}), chr(10))""")


@query(f"WITH {RICH_SQL} SELECT doc_id, block_seq, regexp_replace(translate(replace(rich, 'ـ', ''), 'أإآٱى', 'ااااي'), '{DIACRITICS_SQL}', '', 'g') AS out FROM rich")
def normalize_arabic_basic(v: Views) -> DataFrame:
    return v.rich.select("doc_id", "block_seq", norm.arabic_letters(c("rich")).alias("out"))


@query(f"WITH {RICH_SQL} SELECT doc_id, block_seq, {scanned_sql('rich')} AS out FROM rich")
def normalize_arabic_ocr_basic(v: Views) -> DataFrame:
    return v.rich.select("doc_id", "block_seq", norm.arabic_scanned(c("rich")).alias("out"))


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, block_seq, CASE WHEN {block_sql('coalesce(ar, en)')} = 'en' THEN coalesce(ar, en) ELSE translate(coalesce(ar, en), '?,;', '؟،؛') END AS out FROM blocks")
def normalize_punctuation(v: Views) -> DataFrame:
    one = F.coalesce("ar", "en")
    return v.blocks.select("doc_id", "block_seq", norm.arabic_punctuation(one, lang.block_language(one)).alias("out"))


@query(f"WITH {RICH_SQL} SELECT doc_id, block_seq, {spacing_sql('spaced')} AS out FROM rich")
def normalize_spacing(v: Views) -> DataFrame:
    return v.rich.select("doc_id", "block_seq", norm.spacing(c("spaced")).alias("out"))


@query(
    rf"""WITH {RICH_SQL} SELECT doc_id, block_seq, {strip_sql(tight_sql("spaced"))} AS basic, CASE WHEN {strip_sql("spaced")} = '' THEN ''
    ELSE regexp_replace(regexp_replace({strip_sql(tight_sql("spaced"))}, '\s+([,.;:!?])', '\1', 'g'), '([,.;:!?])([A-Za-z])', '\1 \2', 'g') END AS out FROM rich"""
)
def normalize_english_ocr(v: Views) -> DataFrame:
    return v.rich.select("doc_id", "block_seq", norm.english_scanned_basic(c("spaced")).alias("basic"), norm.english_ocr(c("spaced")).alias("out"))


@query(
    f"""WITH {RICH_SQL} SELECT doc_id, block_seq, {literals_sql("broken", rules.OCR_LITERALS)} AS literal, CASE WHEN {strip_sql("coalesce(broken, '')")} = '' THEN '' ELSE {scanned_sql(literals_sql("broken", rules.OCR_LITERALS))} END AS out FROM rich"""
)
def ocr_literal_fixes(v: Views) -> DataFrame:
    return v.rich.select("doc_id", "block_seq", norm.scanned_repairs(c("broken")).alias("literal"), norm.arabic_ocr(c("broken")).alias("out"))


@query(f"WITH {RICH_SQL} SELECT doc_id, block_seq, {literals_sql('broken', rules.TEXT_LITERALS)} AS out FROM rich")
def subst_literals(v: Views) -> DataFrame:
    return v.rich.select("doc_id", "block_seq", text.replaced(c("broken"), rules.TEXT_LITERALS).alias("out"))


@query()
def ocr_word_rules(v: Views) -> DataFrame:
    return v.rich.select("doc_id", "block_seq", norm.ligatures(c("broken")).alias("ligatures"), norm.arabic_repairs(c("broken")).alias("out"))


@query()
def normalize_blocks(v: Views) -> DataFrame:
    return services.normalise(v.headed).drop("x0", "y0", "x1", "y1")


# ---- classes and filters


@query(f"""WITH {BLOCKS_SQL} SELECT doc_id, block_seq, CASE WHEN page_number % 5 = 0 THEN 'toc' WHEN y0 <= 150 THEN 'header' WHEN y0 >= 850 THEN 'footer' WHEN type = 'table' THEN 'table' ELSE 'paragraph' END AS kind FROM blocks""")
def classify_position(v: Views) -> DataFrame:
    kind = classify.by_position(c("y0"), F.lit(1000.0), c("page_number") % 5 == 0, F.when(c("type") == "table", "table").otherwise("paragraph"))
    return v.blocks.select("doc_id", "block_seq", kind.alias("kind"))


@query(rf"""WITH {PAGES_SQL} SELECT doc_id, page_number, CASE WHEN page_number % 4 = 0 THEN 'table' WHEN regexp_matches(text, '(?i)contents|المحتويات') THEN 'toc' ELSE 'paragraph' END AS unplaced,
    CASE WHEN regexp_matches(text, '(?i)contents|المحتويات') THEN 'toc' WHEN page_number * 100 <= 150 THEN 'header' WHEN page_number * 100 >= 850 THEN 'footer' ELSE 'paragraph' END AS placed FROM page_texts""")
def classify_text(v: Views) -> DataFrame:
    unplaced = classify.by_text(c("text"), c("page_number") % 4 == 0, F.lit(None).cast("double"), F.lit(1000.0))
    placed = classify.by_text(c("text"), F.lit(False), (c("page_number") * 100).cast("double"), F.lit(1000.0))
    return v.page_texts.select("doc_id", "page_number", unplaced.alias("unplaced"), placed.alias("placed"))


@query(rf"""WITH {PAGES_SQL}, l AS (SELECT doc_id, page_number, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql("x")}), lambda x: x <> '') AS ls FROM page_texts)
    SELECT doc_id, page_number, contains(lower(text), 'contents') OR contains(text, 'فهرس') OR contains(text, 'المحتويات')
           OR (len(ls) >= 10 AND len(list_filter(ls, lambda x: regexp_matches(rtrim(x, '. '), '[0-9]$'))) / len(ls) >= 0.4) AS is_toc FROM l""")
def toc_pages(v: Views) -> DataFrame:
    return v.page_texts.select("doc_id", "page_number", classify.is_toc_page(c("text")).alias("is_toc"))


SECTIONS_SQL = " OR ".join(f"contains(coalesce(section, ''), '{w}')" for w in rules.GLOSSARY_SECTIONS)


@query(rf"""WITH {HEADED_SQL}, t AS (SELECT *, coalesce(en, ar) || chr(10) || coalesce(ar, '') AS t FROM headed)
    SELECT doc_id, block_seq, CASE WHEN type IN ('table', 'toc', 'footer', 'header') THEN type
      WHEN {SECTIONS_SQL} OR regexp_matches(t, '(?i)(mm|cm|km|kg|°C|°م)\s*\n') OR regexp_matches(t, '(?i)\b(Centigrade|Millimetre|Kilogram)\b.*\n.*\b(mm|kg|°C)\b')
        OR regexp_matches(t, '(?i)^\s*[A-Z][a-z]+\s+[A-Z]\S*\s*\n') THEN 'glossary' ELSE 'narrative' END AS kind FROM t""")
def content_type(v: Views) -> DataFrame:
    whole = F.concat(F.coalesce("en", "ar"), F.lit("\n"), text.or_empty(c("ar")))
    return v.headed.select("doc_id", "block_seq", classify.chunk_type(whole, c("type"), c("section")).alias("kind"))


@query(f"""WITH {CHUNKS_SQL} SELECT doc_id, chunk_seq, chunk_type IN ('narrative', 'table') AS embeddable FROM chunks""")
def embedding_eligible(v: Views) -> DataFrame:
    return v.chunks.select("doc_id", "chunk_seq", classify.is_embeddable(c("chunk_type")).alias("embeddable"))


@query(f"""WITH {HEADED_SQL} SELECT doc_id, block_seq, CASE WHEN type IN ('header', 'paragraph', 'table', 'toc', 'footer') THEN type ELSE 'paragraph' END AS kind,
    coalesce(nullif(chapter, ''), nullif(section, '')) IS NOT NULL AS has_metadata FROM headed WHERE type NOT IN ('toc', 'header', 'footer', 'table')""")
def chunkable_blocks(v: Views) -> DataFrame:
    kept = v.headed.filter(classify.is_chunkable(c("type")))
    return kept.select("doc_id", "block_seq", classify.known_type(c("type")).alias("kind"), classify.has_metadata(c("chapter"), c("section")).alias("has_metadata"))


@query(f"""WITH {HEADED_SQL} SELECT doc_id, block_seq, chapter, section FROM headed WHERE ar IS NOT NULL OR en IS NOT NULL""")
def section_info(v: Views) -> DataFrame:
    return v.headed.filter(stats.has("ar") | stats.has("en")).select("doc_id", "block_seq", "chapter", "section")


@query(rf"""WITH {RICH_SQL}, t AS (SELECT doc_id, block_seq, {strip_sql("regexp_replace(spaced, '[aeiou]', '1', 'g')")} AS t FROM rich), r AS (
    SELECT doc_id, block_seq, CASE WHEN t = '' THEN 'No text extracted' WHEN length(t) < 10 THEN 'Text too short (' || length(t) || ' chars)'
      WHEN {count_sql("t", "[؀-ۿݐ-ݿࢠ-ࣿ]")} + {count_sql("t", EN_SQL)} < length(t) * 0.3 THEN 'Text appears to be mostly non-letters' ELSE 'OK' END AS reason FROM t)
    SELECT doc_id, block_seq, reason = 'OK' AS valid, reason FROM r""")
def ocr_quality(v: Views) -> DataFrame:
    q = classify.ocr_quality(F.regexp_replace("spaced", "[aeiou]", "1"))
    return v.rich.select("doc_id", "block_seq", q.alias("q")).select("doc_id", "block_seq", "q.valid", "q.reason")


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, block_seq, page_number <= 2 AS first_two, true AS any_page FROM blocks")
def page_limit(v: Views) -> DataFrame:
    return v.blocks.select("doc_id", "block_seq", classify.within_pages(c("page_number"), 2).alias("first_two"), classify.within_pages(c("page_number"), 0).alias("any_page"))


# ---- headings

HEADING_SQL = """h AS (SELECT doc_id, block_seq, CASE block_seq % 4 WHEN 0 THEN en || ' 27 x' WHEN 1 THEN 'Name ' || coalesce(en, '') || ' : Chapter 2' WHEN 2 THEN 'القسم 3 : ' || coalesce(ar, '') ELSE coalesce(en, ar) END AS t FROM blocks)"""


def heading_texts(v: Views) -> DataFrame:
    t = F.when(c("block_seq") % 4 == 0, F.concat("en", F.lit(" 27 x"))).when(c("block_seq") % 4 == 1, F.concat(F.lit("Name "), text.or_empty(c("en")), F.lit(" : Chapter 2")))
    return v.blocks.select("doc_id", "block_seq", t.when(c("block_seq") % 4 == 2, F.concat(F.lit("القسم 3 : "), text.or_empty(c("ar")))).otherwise(F.coalesce("en", "ar")).alias("t"))


@query(f"WITH {BLOCKS_SQL}, {HEADING_SQL} SELECT doc_id, block_seq, {name_sql('t', 'الفصل|Chapter')} AS chapter FROM h")
def parse_chapter(v: Views) -> DataFrame:
    return heading_texts(v).select("doc_id", "block_seq", headings.chapter_name(c("t")).alias("chapter"))


@query(f"WITH {BLOCKS_SQL}, {HEADING_SQL} SELECT doc_id, block_seq, {name_sql('t', 'القسم|Section')} AS section FROM h")
def parse_section(v: Views) -> DataFrame:
    return heading_texts(v).select("doc_id", "block_seq", headings.section_name(c("t")).alias("section"))


def lazy_sql(english: str, arabic: str) -> str:
    patterns = [rf"(?i){english}\s+\d+\s*:\s*([^0-9]+?)\s+\d+", rf"{arabic}\s+\d+\s*:\s*(.+?)(?:\s+\d+|$)", rf"(?i)(?:{english}|{arabic})\s*\d+\s*:\s*(.+)", rf"(?i)(.+?)\s*:\s*(?:{english}|{arabic})"]
    return strip_sql("CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN regexp_extract(t, '{p}', 1)" for p in patterns) + " END")


@query(f"WITH {BLOCKS_SQL}, {HEADING_SQL} SELECT doc_id, block_seq, {lazy_sql('Chapter', 'الفصل')} AS chapter, {lazy_sql('Section', 'القسم')} AS section FROM h")
def parse_heading_lazy(v: Views) -> DataFrame:
    return heading_texts(v).select("doc_id", "block_seq", headings.lazy_chapter(c("t")).alias("chapter"), headings.lazy_section(c("t")).alias("section"))


@query(f"WITH {HEADED_SQL} SELECT doc_id, block_seq, type, chapter, section FROM headed")
def heading_forward_fill(v: Views) -> DataFrame:
    return v.headed.select("doc_id", "block_seq", "type", "chapter", "section")


PAGE_HEAD_SQL = """g0 AS (SELECT doc_id, page_number, string_agg(coalesce(en, ar), ' ' ORDER BY block_seq) AS t FROM blocks WHERE type = 'header' GROUP BY ALL),
    g AS (SELECT doc_id, page_number, CASE WHEN page_number % 2 = 0 THEN t ELSE replace(t, 'Section', 'Part') END AS t FROM g0)"""


@query(f"""WITH {BLOCKS_SQL}, {PAGE_HEAD_SQL}, r AS (SELECT doc_id, page_number, {name_sql("t", "الفصل|Chapter")} AS c, {name_sql("t", "القسم|Section")} AS s FROM g)
    SELECT doc_id, page_number, last_value(c IGNORE NULLS) OVER w AS chapter, last_value(s IGNORE NULLS) OVER w AS section, last_value(c IGNORE NULLS) OVER b AS table_chapter, last_value(s IGNORE NULLS) OVER b AS table_section
    FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY page_number ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def page_heading_fill(v: Views) -> DataFrame:
    rows = v.blocks.filter("type = 'header'").groupBy("doc_id", "page_number").agg(text.joined(F.collect_list(F.struct("block_seq", F.coalesce("en", "ar").alias("text"))), " ").alias("text"))
    # Odd pages lose their section headings, so that sections are carried over pages.
    rows = rows.withColumn("text", F.when(c("page_number") % 2 == 0, c("text")).otherwise(F.replace(c("text"), F.lit("Section"), F.lit("Part"))))
    return headings.fill_page_headings(rows).select("doc_id", "page_number", "chapter", "section", "table_chapter", "table_section")


@query(f"WITH {HEADED_SQL} SELECT doc_id, arg_max(chapter, block_seq) FILTER (chapter <> '') AS last_chapter, arg_max(section, block_seq) FILTER (section <> '') AS last_section FROM headed GROUP BY doc_id")
def last_heading(v: Views) -> DataFrame:
    return headings.last_headings(v.headed)


# ---- layout

CANDIDATES_SQL = """cand AS (
  SELECT a.doc_id, a.page_number, a.block_seq AS ar_seq, e.block_seq AS en_seq, abs((a.x0 + a.x1) / 2 - (e.x0 + e.x1) / 2) AS distance
  FROM (SELECT * FROM blocks WHERE type <> 'table' AND ar <> '' AND en IS NULL) a JOIN (SELECT * FROM blocks WHERE type <> 'table' AND en <> '' AND ar IS NULL) e
    ON a.doc_id = e.doc_id AND a.page_number = e.page_number AND ((a.y1 >= e.y0 AND e.y1 >= a.y0) OR abs((a.y0 + a.y1) / 2 - (e.y0 + e.y1) / 2) <= 10)
)"""


@query(f"WITH {BLOCKS_SQL}, {CANDIDATES_SQL} SELECT * FROM cand")
def aligned_pairs(v: Views) -> DataFrame:
    return pairing.aligned_pairs(v.blocks)


@query(f"""WITH RECURSIVE {BLOCKS_SQL}, {CANDIDATES_SQL}, opt AS (
      SELECT doc_id, page_number, ar_seq, list(struct_pack(e := en_seq, s := 1.0::DOUBLE / (distance + 1.0::DOUBLE)) ORDER BY en_seq) AS opts FROM cand GROUP BY ALL
    ), per AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY ar_seq) AS i FROM opt), fold AS (
      SELECT doc_id, page_number, CAST(0 AS BIGINT) AS i, CAST([] AS INTEGER[]) AS used, CAST(NULL AS INTEGER) AS ar_seq, CAST(NULL AS INTEGER) AS en_seq FROM per WHERE i = 1
      UNION ALL
      SELECT doc_id, page_number, i, CASE WHEN best IS NULL THEN used ELSE list_append(used, best) END, ar_seq, best FROM (
        SELECT p.doc_id, p.page_number, p.i, f.used, p.ar_seq,
               list_reverse_sort(list_transform(list_filter(p.opts, lambda o: NOT list_contains(f.used, o.e)), lambda o: struct_pack(s := o.s, n := -o.e)))[1].n * -1 AS best
        FROM fold f JOIN per p ON p.doc_id = f.doc_id AND p.page_number = f.page_number AND p.i = f.i + 1)
    ) SELECT doc_id, page_number, ar_seq, en_seq FROM fold WHERE en_seq IS NOT NULL""")
def greedy_pairs(v: Views) -> DataFrame:
    return pairing.greedy_pairs(pairing.aligned_pairs(v.blocks))


@query()
def paired_blocks(v: Views) -> DataFrame:
    return pairing.pair_blocks(v.blocks)


@query()
def layout_blocks(v: Views) -> DataFrame:
    return services.layout(v.blocks)


# ---- merging

BREAK_SQL = r"""regexp_matches(p, '[.!?؟…:]$') OR (length(l) < 60 AND (contains(l, 'الفصل') OR contains(l, 'القسم') OR contains(l, 'جدول') OR contains(l, 'الباب') OR contains(l, 'المحور'))) OR regexp_matches(l, '^[0-9]+[.\-):]')"""


@query(rf"""WITH {PAGES_SQL}, l AS (SELECT doc_id, page_number, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql("x")}), lambda x: x <> '')) AS l,
      generate_subscripts(list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql("x")}), lambda x: x <> ''), 1) AS i FROM page_texts),
    b AS (SELECT *, lag(l) OVER (PARTITION BY doc_id, page_number ORDER BY i) AS p FROM l),
    s AS (SELECT *, CASE WHEN p IS NULL THEN '' WHEN {BREAK_SQL} THEN chr(10) ELSE ' ' END AS sep FROM b)
    SELECT doc_id, page_number, string_agg(sep || l, '' ORDER BY i) AS merged FROM s GROUP BY ALL""")
def merge_lines(v: Views) -> DataFrame:
    return v.page_texts.select("doc_id", "page_number", merging.merge_lines(c("text")).alias("merged"))


@query()
def merge_ocr_blocks(v: Views) -> DataFrame:
    return merging.merge_scanned(v.headed)


@query()
def repair_fragments(v: Views) -> DataFrame:
    return merging.repair_fragments(v.headed)


SECTIONS_MERGED_SQL = """ord AS (
  SELECT *, type IN ('paragraph', 'narrative') AS prose, lag(type IN ('paragraph', 'narrative')) OVER w AS before, lag(chapter) OVER w AS c0, lag(section) OVER w AS s0
  FROM headed WINDOW w AS (PARTITION BY doc_id ORDER BY page_number, block_seq)
), grp AS (
  SELECT *, sum(CASE WHEN prose AND before AND chapter IS NOT DISTINCT FROM c0 AND section IS NOT DISTINCT FROM s0 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page_number, block_seq ROWS UNBOUNDED PRECEDING) AS g FROM ord
), merged AS (
  SELECT doc_id, arg_min(page_number, block_seq) AS page_number, CASE WHEN count(*) > 1 THEN max(page_number) END AS page_end, min(block_seq) AS block_seq, arg_min(type, block_seq) AS type,
         string_agg(nullif(ar, ''), chr(10) ORDER BY block_seq) AS ar, string_agg(nullif(en, ''), chr(10) ORDER BY block_seq) AS en, any_value(chapter) AS chapter, any_value(section) AS section
  FROM grp GROUP BY doc_id, g
)"""


@query(f"WITH {HEADED_SQL}, {SECTIONS_MERGED_SQL} SELECT * FROM merged")
def merge_sections(v: Views) -> DataFrame:
    return merging.merge_sections(v.headed)


# ---- chunking

SENTENCES_SQL = rf"""list_filter(list_transform(regexp_split_to_array(text, '[.!?؟]\s+'), lambda s: {strip_sql("s")}), lambda s: s <> '')"""
PACK_SQL = rf"""src AS (SELECT doc_id, {SENTENCES_SQL} AS ss FROM documents), pack AS (
  SELECT doc_id, ss, 1 AS i, ss[1] AS cur, CAST(NULL AS VARCHAR) AS done, 0 AS n FROM src WHERE len(ss) > 0
  UNION ALL
  SELECT doc_id, ss, i + 1, CASE WHEN i = len(ss) THEN NULL WHEN length(cur) + length(ss[i + 1]) > 350 THEN ss[i + 1] ELSE cur || '. ' || ss[i + 1] END,
         CASE WHEN i = len(ss) OR length(cur) + length(ss[i + 1]) > 350 THEN cur END, CASE WHEN i = len(ss) OR length(cur) + length(ss[i + 1]) > 350 THEN n + 1 ELSE n END
  FROM pack WHERE cur IS NOT NULL
), packed AS (SELECT doc_id, CAST(n - 1 AS INTEGER) AS i, done AS chunk FROM pack WHERE done IS NOT NULL)"""


def packed(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", F.posexplode(chunking.pack_sentences(c("text"), 350)).alias("i", "chunk"))


@query(f"WITH RECURSIVE {PACK_SQL} SELECT doc_id, i, chunk FROM packed")
def pack_sentences(v: Views) -> DataFrame:
    return packed(v)


@query(f"""WITH RECURSIVE {PACK_SQL} SELECT d.lang, count(*) AS chunks, round(avg(length(chunk)), 4) AS avg_chars, max(length(chunk)) AS max_chars,
    CAST(count(*) FILTER (regexp_matches(chunk, '(?i)(mm|cm|km|kg|°C|°م)\\s*\\n') OR regexp_matches(chunk, '(?i)\\b(Centigrade|Millimetre|Kilogram)\\b.*\\n.*\\b(mm|kg|°C)\\b') OR regexp_matches(chunk, '(?i)^\\s*[A-Z][a-z]+\\s+[A-Z]\\S*\\s*\\n')) AS BIGINT) AS glossary
    FROM packed JOIN documents d USING (doc_id) GROUP BY d.lang""")
def pack_summary(v: Views) -> DataFrame:
    rows = v.table("documents").select("lang", F.explode(chunking.pack_sentences(c("text"), 350)).alias("chunk"))
    rows = rows.withColumn("kind", classify.chunk_type(c("chunk"), F.lit("paragraph"), F.lit(None).cast("string")))
    return rows.groupBy("lang").agg(
        F.count(F.lit(1)).alias("chunks"), F.round(F.avg(F.length("chunk")), 4).alias("avg_chars"), F.max(F.length("chunk")).cast("long").alias("max_chars"), F.count_if(c("kind") == "glossary").alias("glossary")
    )


def slug_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower(coalesce(nullif({x}, ''), 'unknown')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(f"""WITH {HEADED_SQL} SELECT doc_id, block_seq, {slug_sql("en")} AS slug, 'yearbook2025_' || {slug_sql("chapter")} || '_' || {slug_sql("section")} || '_p' || page_number || '_' || block_seq AS chunk_id,
    'table_' || coalesce(nullif(chapter, ''), 'unknown') || '_' || page_number AS table_id, regexp_replace(replace({strip_sql("regexp_replace(coalesce(en, ar), '[^\\p{L}\\p{N} _-]', '', 'g')")}, ' ', '_'), '', '') AS file_name FROM headed""")
def chunk_ids(v: Views) -> DataFrame:
    return v.headed.select(
        "doc_id", "block_seq", text.slug(c("en")).alias("slug"), text.chunk_id(c("chapter"), c("section"), c("page_number"), c("block_seq").cast("string")).alias("chunk_id"),
        text.table_id(c("chapter"), c("page_number")).alias("table_id"), text.file_name(F.coalesce("en", "ar")).alias("file_name"),
    )


@query()
def chunk_documents(v: Views) -> DataFrame:
    return chunking.chunk_blocks(v.headed.drop("x0", "y0", "x1", "y1")).withColumn("language", F.array_join("language", ","))


@query()
def chunk_documents_strict(v: Views) -> DataFrame:
    config = ChunkConfig(unique_ids=True, merged_page_end=True, own_document=True, document_name="Own", year=2025, overlap=True)
    return chunking.chunk_blocks(v.headed.drop("x0", "y0", "x1", "y1"), config).withColumn("language", F.array_join("language", ","))


@query()
def rejected_chunks(v: Views) -> DataFrame:
    return chunking.rejected(merging.merge_sections(v.headed))


@query()
def merge_small_chunks(v: Views) -> DataFrame:
    rows = v.chunks.withColumn("part", F.lit(0)).withColumn("page_number", c("page_end")).withColumn("block_seq", c("chunk_seq")).withColumn("i", F.lit(0))
    return chunking.merge_small(rows).withColumn("language", F.array_join("language", ","))


FROM_SQL = f"""CASE WHEN contains(o, k) OR len(list_intersect({words_sql("k")}, {words_sql("o")})) / greatest(len(list_distinct({words_sql("k")})), 1) >= 0.6 THEN k ELSE substring(o, 1, length(k)) END"""
ORIGINALS_SQL = """orig AS (SELECT doc_id, block_seq, coalesce(en, ar) AS o, CASE block_seq % 3 WHEN 0 THEN substring(coalesce(en, ar), 3, 60) WHEN 1 THEN substring(coalesce(en, ar), 1, 40) || ' other words that it lacks' ELSE reverse(coalesce(en, ar)) || ' x' END AS k FROM blocks)"""


@query(f"WITH {BLOCKS_SQL}, {ORIGINALS_SQL} SELECT doc_id, block_seq, {FROM_SQL} AS out FROM orig")
def provenance_check(v: Views) -> DataFrame:
    o = F.coalesce("en", "ar")
    k = F.when(c("block_seq") % 3 == 0, F.substring(o, 3, 60)).when(c("block_seq") % 3 == 1, F.concat(F.substring(o, 1, 40), F.lit(" other words that it lacks"))).otherwise(F.concat(F.reverse(o), F.lit(" x")))
    return v.blocks.select("doc_id", "block_seq", chunking.from_original(o, k).alias("out"))


@query()
def split_bilingual(v: Views) -> DataFrame:
    whole = F.concat_ws("\n\n", "ar", "en")
    piece = F.when(c("block_seq") % 2 == 0, whole).otherwise(F.substring(whole, 1, 60))
    return v.blocks.select("doc_id", "block_seq", chunking.split_bilingual(piece, c("ar"), c("en")).alias("s")).select("doc_id", "block_seq", "s.ar", "s.en")


@query(rf"""WITH {CHUNKS_SQL} SELECT doc_id, chunk_seq, (coalesce(ar, '') <> '' OR coalesce(en, '') <> '')
      AND NOT (coalesce(ar, '') <> '' AND coalesce(en, '') <> '' AND (ar = en OR ({robust_sql("ar")} = {robust_sql("en")} AND {robust_sql("ar")} <> 'mixed'))) AND page_start <> 0
      AND NOT (coalesce(ar, '') <> '' AND {count_sql("ar", chr(92) + "s[؀-ۿ]" + chr(92) + "s")} > length(ar) * 0.1) AND NOT (chunk_type = 'narrative' AND length(coalesce(ar, '')) + length(coalesce(en, '')) < 50) AS valid FROM chunks""")
def valid_chunks(v: Views) -> DataFrame:
    return v.chunks.select("doc_id", "chunk_seq", chunking.is_valid(c("ar"), c("en"), c("chunk_type"), c("page_start")).alias("valid"))


# ---- issues

BOTH_THERE_SQL = "coalesce(ar, '') <> '' AND coalesce(en, '') <> ''"
ISSUES_SQL = f"""marked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_id ORDER BY chunk_seq) AS again, len({words_sql(BOTH_SQL)}) AS n_words FROM chunks), issues AS (
  SELECT doc_id, chunk_seq, chunk_id, 'fake_bilingual' AS issue FROM marked WHERE {BOTH_THERE_SQL} AND ar = en
  UNION ALL SELECT doc_id, chunk_seq, chunk_id, 'fake_bilingual' FROM marked WHERE {BOTH_THERE_SQL} AND {robust_sql("ar")} = {robust_sql("en")} AND {robust_sql("ar")} <> 'mixed'
  UNION ALL SELECT doc_id, chunk_seq, chunk_id, 'missing_metadata' FROM marked WHERE coalesce(chapter, '') = '' AND coalesce(section, '') = ''
  UNION ALL SELECT doc_id, chunk_seq, chunk_id, 'duplicate_ids' FROM marked WHERE again > 1
  UNION ALL SELECT doc_id, chunk_seq, chunk_id, 'broken_arabic' FROM marked WHERE contains(ar, 'اجل') OR contains(ar, 'احل') OR contains(ar, 'اال')
  UNION ALL SELECT doc_id, chunk_seq, chunk_id, 'toc_leakage' FROM marked WHERE chunk_type = 'toc'
  UNION ALL SELECT doc_id, chunk_seq, chunk_id, 'missing_embedding_flag' FROM marked WHERE embedding_allowed IS NULL
  UNION ALL SELECT doc_id, chunk_seq, chunk_id, 'low_information' FROM marked WHERE embedding_allowed AND n_words < 30
)"""


@query(f"WITH {CHUNKS_SQL}, {ISSUES_SQL} SELECT * FROM issues")
def quality_issues(v: Views) -> DataFrame:
    return quality.chunk_issues(v.chunks)


@query(f"""WITH {CHUNKS_SQL}, {ISSUES_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY doc_id, chunk_seq) AS r FROM issues), names AS (SELECT unnest({list(quality.ISSUES)}) AS issue)
    SELECT n.issue, count(r.issue) AS n, coalesce(string_agg(chunk_id, ', ' ORDER BY r) FILTER (r <= 5), '') AS examples, count(r.issue) = 0 AS passed FROM names n LEFT JOIN ranked r ON r.issue = n.issue GROUP BY n.issue""")
def quality_summary(v: Views) -> DataFrame:
    return quality.issue_report(quality.chunk_issues(v.chunks))


@query(f"WITH {CHUNKS_SQL}, {ISSUES_SQL} SELECT doc_id, chunk_seq, chunk_id FROM marked WHERE again > 1")
def duplicate_ids(v: Views) -> DataFrame:
    return v.chunks.withColumn("again", quality.is_repeated()).filter("again").select("doc_id", "chunk_seq", "chunk_id")


@query(f"WITH {RICH_SQL} SELECT doc_id, block_seq, coalesce(contains(broken, 'اجل') OR contains(broken, 'احل') OR contains(broken, 'اال'), false) AS broken FROM rich")
def broken_arabic(v: Views) -> DataFrame:
    return v.rich.select("doc_id", "block_seq", quality.is_broken(c("broken")).alias("broken"))


# ---- evaluation

KEPT_SQL = """kept AS (SELECT doc_id, page_number, text AS o, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN substring(text, 1, length(text) // 3) WHEN 2 THEN regexp_replace(text, '[؀-ۿ]', '', 'g') ELSE reverse(text) END AS x FROM page_texts)"""
COMPARED_SQL = rf"""measured AS (
  SELECT doc_id, page_number, length(o) AS a, length(x) AS b, {count_sql("o", AR_SQL)} AS oa, {count_sql("x", AR_SQL)} AS xa, {count_sql("o", "english_words")} AS oe, {count_sql("x", "english_words")} AS xe,
         list_distinct(regexp_extract_all(lower(o), '[\pL\pN\pM_]+')) AS ow, list_distinct(regexp_extract_all(lower(x), '[\pL\pN\pM_]+')) AS xw
  FROM kept WHERE x <> ''
), compared AS (
  SELECT doc_id, page_number, CASE WHEN len(ow) > 0 THEN len(list_intersect(ow, xw)) / len(ow) * 100 ELSE 0 END AS similarity, a AS original_length, b AS extracted_length, abs(a - b) AS length_diff,
         CASE WHEN a > 0 THEN abs(a - b) / a * 100 ELSE 0 END AS length_diff_pct, oa AS original_arabic, xa AS extracted_arabic, oe AS original_english, xe AS extracted_english FROM measured
)"""
WORDS_SQL = r"len(list_filter(regexp_extract_all({x}, '[\pL\pN\pM_]+'), lambda w: regexp_full_match(w, '[a-zA-Z]{{3,}}')))"
for _x in ("o", "x"):
    COMPARED_SQL = COMPARED_SQL.replace(count_sql(_x, "english_words"), WORDS_SQL.format(x=_x))


def kept_pages(v: Views) -> tuple[DataFrame, DataFrame]:
    cut = F.when(c("doc_id") % 4 == 0, c("text")).when(c("doc_id") % 4 == 1, F.substring("text", F.lit(1), F.floor(F.length("text") / 3).cast("int"))).when(c("doc_id") % 4 == 2, F.regexp_replace("text", "[؀-ۿ]", ""))
    return v.page_texts, v.page_texts.withColumn("text", cut.otherwise(F.reverse("text")))


@query(f"WITH {PAGES_SQL}, {KEPT_SQL}, {COMPARED_SQL} SELECT * REPLACE (round(similarity, 4) AS similarity, round(length_diff_pct, 4) AS length_diff_pct) FROM compared")
def text_comparison(v: Views) -> DataFrame:
    rows = evaluate.compare_pages(*kept_pages(v)).drop("issues")
    return rows.withColumn("similarity", F.round("similarity", 4)).withColumn("length_diff_pct", F.round("length_diff_pct", 4))


@query()
def comparison_issues(v: Views) -> DataFrame:
    return evaluate.compare_pages(*kept_pages(v)).select("doc_id", "page_number", F.explode("issues").alias("issue"))


@query(f"""WITH {PAGES_SQL}, {KEPT_SQL}, {COMPARED_SQL}, s AS (
      SELECT count(*) AS pages, avg(similarity) AS sim, avg(length_diff_pct) AS off, CAST(sum(original_arabic) AS BIGINT) AS original_arabic, CAST(sum(original_english) AS BIGINT) AS original_english,
             CAST(sum(extracted_arabic) AS BIGINT) AS extracted_arabic, CAST(sum(extracted_english) AS BIGINT) AS extracted_english FROM compared)
    SELECT pages, round(sim, 4) AS avg_similarity, round(off, 4) AS avg_length_diff, original_arabic, original_english, extracted_arabic, extracted_english,
           CASE WHEN original_arabic > 0 THEN round(extracted_arabic / original_arabic * 100, 4) ELSE 0 END AS arabic_kept_pct, CASE WHEN original_english > 0 THEN round(extracted_english / original_english * 100, 4) ELSE 0 END AS english_kept_pct,
           CASE WHEN sim >= 80 THEN 'EXCELLENT' WHEN sim >= 60 THEN 'GOOD' WHEN sim >= 40 THEN 'FAIR' ELSE 'POOR' END AS grade, CASE WHEN sim >= 70 THEN 'suitable' WHEN sim >= 50 THEN 'acceptable' ELSE 'poor' END AS readiness,
           extracted_arabic < original_arabic * 0.7 AS check_rtl, extracted_english < original_english * 0.7 AS check_method, off > 30 AS check_missing FROM s""")
def evaluation_summary(v: Views) -> DataFrame:
    out = evaluate.summarise(evaluate.compare_pages(*kept_pages(v)))
    return out.select(*(F.round(n, 4).alias(n) if n in ("avg_similarity", "avg_length_diff", "arabic_kept_pct", "english_kept_pct") else c(n) for n in out.columns))


@query(f"WITH {PAGES_SQL}, {KEPT_SQL}, {COMPARED_SQL} SELECT doc_id, page_number, extracted_length FROM compared WHERE page_number IN (1, 3)")
def page_sample(v: Views) -> DataFrame:
    return evaluate.compare_pages(*kept_pages(v), pages=[1, 3]).select("doc_id", "page_number", "extracted_length")


# ---- counts


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, max(page_number) AS pages FROM blocks GROUP BY doc_id")
def page_count(v: Views) -> DataFrame:
    return stats.page_counts(v.blocks)


@query(f"""WITH {BLOCKS_SQL}, t AS (SELECT *, {BOTH_SQL} AS t FROM blocks) SELECT doc_id, CAST(sum(length(coalesce(ar, '')) + length(coalesce(en, ''))) AS BIGINT) AS total_chars, CAST(sum({count_sql("t", AR_SQL)}) AS BIGINT) AS arabic_chars,
    CAST(sum({WORDS_SQL.format(x="t")}) AS BIGINT) AS english_words, max(page_number) AS pages FROM t GROUP BY doc_id""")
def document_stats(v: Views) -> DataFrame:
    return stats.text_stats(v.blocks)


@query(f"WITH {CHUNKS_SQL} SELECT count(*) AS total_chunks, count(*) FILTER (chunk_type = 'narrative') AS narrative_chunks, count(*) FILTER (chunk_type = 'table') AS table_chunks FROM chunks")
def chunk_totals(v: Views) -> DataFrame:
    return stats.chunk_totals(v.chunks)


@query(f"""WITH {CHUNKS_SQL}, s AS (SELECT *, length(coalesce(ar, '')) + length(coalesce(en, '')) AS n FROM chunks) SELECT round(avg(n), 4) AS avg_size, CAST(min(n) AS INTEGER) AS min_size, CAST(max(n) AS INTEGER) AS max_size,
    count(*) FILTER (coalesce(ar, '') <> '' AND coalesce(en, '') <> '') AS bilingual, count(*) FILTER (embedding_allowed) AS embeddable FROM s""")
def chunk_stats(v: Views) -> DataFrame:
    return stats.chunk_sizes(v.chunks).withColumn("avg_size", F.round("avg_size", 4))


@query(f"WITH {BLOCKS_SQL} SELECT type, count(*) AS n FROM blocks GROUP BY type ORDER BY type")
def type_counts(v: Views) -> DataFrame:
    return stats.type_counts(v.blocks).orderBy("type")


@query(f"WITH {BLOCKS_SQL} SELECT type, count(*) FILTER (ar <> '' AND en IS NULL) AS ar_only, count(*) FILTER (en <> '' AND ar IS NULL) AS en_only, count(*) FILTER (ar <> '' AND en <> '') AS both FROM blocks GROUP BY type")
def type_language_counts(v: Views) -> DataFrame:
    return stats.language_counts(v.blocks)


@query(f"WITH {CHUNKS_SQL} SELECT array_to_string(list_sort(language), ',') AS languages, count(*) AS n FROM chunks GROUP BY 1")
def language_tuples(v: Views) -> DataFrame:
    return stats.language_tuples(v.chunks)


@query(f"WITH {HEADED_SQL} SELECT doc_id, page_number, count(*) FILTER (type = 'header') AS headers, count(*) FILTER (coalesce(chapter, '') <> '' OR coalesce(section, '') <> '') AS with_metadata FROM headed GROUP BY ALL")
def headers_per_page(v: Views) -> DataFrame:
    return stats.page_headings(v.headed)


@query(f"WITH {HEADED_SQL} SELECT count(*) AS blocks, count(*) FILTER (chapter <> '') AS with_chapter, count(*) FILTER (section <> '') AS with_section, count(*) FILTER (chapter <> '' OR section <> '') AS with_either FROM headed")
def metadata_coverage(v: Views) -> DataFrame:
    return stats.metadata_coverage(v.headed)


@query(f"WITH {HEADED_SQL} SELECT doc_id, block_seq, type, chapter FROM headed QUALIFY row_number() OVER (PARTITION BY doc_id, type ORDER BY block_seq) <= 3")
def first_samples(v: Views) -> DataFrame:
    return stats.first_rows(v.headed.select("doc_id", "block_seq", "type", "chapter"), 3, ["block_seq"], ["doc_id", "type"])


@query(rf"""WITH {BLOCKS_SQL} SELECT doc_id, block_seq, len({words_sql(BOTH_SQL)}) AS n_words, {count_sql("ar", chr(92) + "s[؀-ۿ]" + chr(92) + "s")} AS isolated, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy,
    least(y0, 400.0) AS top, greatest(y1, 600.0) AS bottom FROM blocks""")
def block_measures(v: Views) -> DataFrame:
    return v.blocks.select(
        "doc_id", "block_seq", text.word_count(c("ar"), c("en")).cast("long").alias("n_words"), text.isolated_letters(c("ar")).alias("isolated"), ((c("x0") + c("x1")) / 2).alias("cx"), ((c("y0") + c("y1")) / 2).alias("cy"),
        F.least("y0", F.lit(400.0)).alias("top"), F.greatest("y1", F.lit(600.0)).alias("bottom"),
    )


# ---- sources, sinks, tables

MATRIX_SQL = "list_transform(string_split(line, '. '), lambda r: string_split(r, ', '))"


def matrix():
    return F.transform(F.split("line", r"\. "), lambda r: F.split(r, ", "))


@query(f"""WITH {LINES_SQL}, m AS (SELECT doc_id, seq, {MATRIX_SQL} AS m FROM lines), w AS (SELECT *, list_max(list_transform(m, lambda r: len(r))) AS w FROM m),
    s AS (SELECT doc_id, seq, w, list_transform(m, lambda r: '| ' || array_to_string(list_concat(r, list_transform(range(w - len(r)), lambda i: '')), ' | ') || ' |') AS rows FROM w)
    SELECT doc_id, seq, array_to_string(list_concat([rows[1], '| ' || array_to_string(list_transform(range(w), lambda i: '---'), ' | ') || ' |'], rows[2:]), chr(10)) AS markdown FROM s""")
def table_markdown(v: Views) -> DataFrame:
    return v.lines.select("doc_id", "seq", text.table_markdown(matrix()).alias("markdown"))


@query(f"WITH {LINES_SQL} SELECT doc_id, seq, array_to_string(list_transform({MATRIX_SQL}, lambda r: array_to_string(r, chr(9))), chr(10)) AS rows FROM lines")
def table_rows(v: Views) -> DataFrame:
    return v.lines.select("doc_id", "seq", text.table_lines(matrix()).alias("rows"))


@query()
def html_blocks(v: Views) -> DataFrame:
    return html.html_blocks(v.table("pages")).select("doc_id", "block_seq", "type", "en")


@query("SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn AS INTEGER) AS block_seq, 'paragraph' AS type, text AS en, role AS section FROM conversations")
def conversation_blocks(v: Views) -> DataFrame:
    return sources.conversation_blocks(v.table("conversations")).select("doc_id", "block_seq", "type", "en", "section")


@query(f"WITH {PAGES_SQL} SELECT doc_id, page_number, {strip_sql('text')} AS text FROM page_texts")
def page_marked_blocks(v: Views) -> DataFrame:
    page = F.concat(F.lit("--- Page "), c("page_number").cast("string"), F.lit(" ---\n\n"), c("text"))
    whole = v.page_texts.groupBy("doc_id").agg(text.joined(F.collect_list(F.struct("page_number", page.alias("text"))), "\n\n").alias("value"))
    return whole.select("doc_id", F.explode(sources.page_marked(c("value"))).alias("p")).select("doc_id", "p.*")


@query(f"WITH {HEADED_SQL} SELECT doc_id::VARCHAR AS doc_id, page_number, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY block_seq) - 1 AS INTEGER) AS block_seq, type, ar, en, x0, y0, x1, y1, chapter, section FROM headed")
def nested_pages(v: Views) -> DataFrame:
    """Blocks to nested pages and back; a block's place is then that on its page."""
    return sources.blocks_of_pages(sources.pages_of_blocks(v.headed))


@query(f"""WITH {BLOCKS_SQL}, t AS (SELECT *, {strip_sql("coalesce(nullif(ar, ''), en, '')")} AS t FROM blocks) SELECT doc_id, page_number, string_agg(t, chr(10) ORDER BY block_seq) AS text FROM t WHERE length(t) > 2 GROUP BY ALL""")
def original_pages(v: Views) -> DataFrame:
    return sources.original_page(v.blocks)


@query(f"""WITH {CHUNKS_SQL} SELECT doc_id, chunk_seq, chr(10) || repeat('=', 80) || chr(10) || 'CHUNK #' || (chunk_seq + 1) || chr(10) || repeat('=', 80) || chr(10) || 'Chunk ID: ' || chunk_id || chr(10) || 'Type: ' || chunk_type || chr(10)
      || 'Document: Book' || chr(10) || 'Year: 2024' || chr(10) || CASE WHEN chapter <> '' THEN 'Chapter: ' || chapter || chr(10) ELSE '' END || CASE WHEN section <> '' THEN 'Section: ' || section || chr(10) ELSE '' END
      || 'Pages: ' || page_start || ' - ' || page_end || chr(10) || 'Languages: ' || array_to_string(language, ', ') || chr(10) || 'Embedding Allowed: ' || 'True' || chr(10) || chr(10)
      || '--- Arabic Content ---' || chr(10) || coalesce(nullif(ar, ''), '(No Arabic content)') || chr(10) || chr(10) || '--- English Content ---' || chr(10) || coalesce(nullif(en, ''), '(No English content)') || chr(10) AS report
    FROM chunks""")
def report_texts(v: Views) -> DataFrame:
    rows = v.chunks.withColumn("document", F.lit("Book")).withColumn("year", F.lit(2024)).withColumn("embedding_allowed", F.lit(True))
    return rows.select("doc_id", "chunk_seq", files.report_text(c("chunk_seq") + 1).alias("report"))

