"""Scalar functions on single values."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sahifa.functions import language, normalise, rules, text
from sahifa.operators import chunking, classify, headings


def of(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


CASES = [
    (language.robust_language, "السكان", "ar"), (language.robust_language, "Population", "en"), (language.robust_language, "المساحة 309.5 km", "ar"), (language.robust_language, "12 345", "mixed"),
    (language.robust_language, "ab", "mixed"), (language.robust_language, "", "mixed"), (language.robust_language, None, "mixed"), (language.block_language, "السكان", "ar"),
    (language.block_language, "المساحة 309.5 km²", "mixed"), (language.block_language, "12 345", "mixed"), (language.wide_language, "12 345", "other"), (language.wide_language, "ݐݑ", "ar"), (language.wide_language, "abc سكان", "mixed"),
    (normalise.spacing, "area 309.5 km , total", "area 309. 5 km, total"), (normalise.spacing, "a\n\n\n\nb  c", "a\n\nb c"), (normalise.spacing, "1,234", "1, 234"), (normalise.spacing, "a!!b", "a! !b"),
    (lambda c: normalise.spacing(c, decimal_safe=True), "area 309.5 km , total", "area 309.5 km, total"), (normalise.arabic_scanned, "أحمد إلى المدينةـ", "احمد الي المدينه"), (normalise.arabic_scanned, "ٱلكتاب", "ٱلكتاب"),
    (normalise.arabic_letters, "أحمد إلى المدينةـ", "احمد الي المدينة"), (normalise.arabic_letters, "ٱلكِتَابُ", "الكتاب"), (normalise.english_ocr, "Oil ,gas ;water:3.5 done", "Oil, gas; water:3.5 done"), (normalise.english_ocr, "e.g.this", "e. g. this"),
    (normalise.scanned_repairs, "احلكومة", "الكومة"), (normalise.scanned_repairs, "مشاال", "مشال"), (normalise.scanned_repairs, "عامل", "عال"), (normalise.scanned_repairs, "الناخ", "المناخ"),
    (text.slug, "General Information", "general_information"), (text.slug, "المناخ", ""), (text.slug, None, "unknown"), (text.slug, "Oil, Gas & Minerals", "oil_gas_minerals"),
    (headings.chapter_name, "Chapter 1 : General Information 27 ةـماـعلا", "General Information"), (headings.chapter_name, "Chapter 2: Climate\t39", "Climate"), (headings.chapter_name, "الفصل 2 : المناخ", "المناخ"),
    (headings.chapter_name, "Climate : Chapter 2", "Climate"), (headings.chapter_name, "no heading", None), (headings.section_name, "Section 1: Main Results", "Main Results"),
    (headings.section_name, "Section 10 : Foreign Trade\t195", "Foreign Trade"), (headings.section_name, "القسم 1 : المناخ", "المناخ"), (text.file_name, " Year Book: 2025! ", "Year_Book_2025"),
    (lambda c: chunking.pack_sentences(c, 8), "aaaa. bbbb. cc. dddddddddd", ["aaaa. bbbb", "cc", "dddddddddd"]), (lambda c: chunking.pack_sentences(c, 100), "One! Two? Three.", ["One. Two. Three."]),
    (lambda c: chunking.pack_sentences(c, 5), "xxxxxxxxxxxx. y", ["xxxxxxxxxxxx", "y"]), (chunking.chunk_text, "x" * 119, []), (chunking.chunk_text, "x" * 120, ["x" * 120]),
    (lambda c: classify.ocr_quality(c)["reason"], "  ", "No text extracted"), (lambda c: classify.ocr_quality(c)["reason"], "short", "Text too short (5 chars)"), (lambda c: classify.ocr_quality(c)["reason"], "1234567890 ab", "Text appears to be mostly non-letters"),
]


@pytest.mark.parametrize(("fn", "value", "expected"), CASES)
def test_case(spark, fn, value, expected):
    assert of(spark, value, fn) == expected


def test_table_markdown(spark):
    assert of(spark, [["h1", "h2"], ["a"]], text.table_markdown, "array<array<string>>") == "| h1 | h2 |\n| --- | --- |\n| a |  |"
    assert of(spark, [], text.table_markdown, "array<array<string>>") == "" == of(spark, None, text.table_markdown, "array<array<string>>")


def test_position_bands(spark):
    rows = spark.createDataFrame([(150.0,), (151.0,), (849.0,), (850.0,)], "y double")
    found = [r[0] for r in rows.select(classify.by_position(F.col("y"), F.lit(1000.0), F.lit(False), F.lit("paragraph"))).collect()]
    assert found == ["header", "paragraph", "paragraph", "footer"]


def test_toc_needs_ten_lines_and_two_in_five(spark):
    page = lambda n, of: "\n".join([f"line .. {i}" for i in range(n)] + ["words"] * (of - n))
    assert [of(spark, page(*p), classify.is_toc_page) for p in ((4, 10), (3, 10), (9, 9))] == [True, False, False]


@pytest.fixture(scope="module")
def arabic_rules():
    """The rules in Python's own engine, whose word boundaries they are written for."""
    b = r"\b"
    python = lambda p: p.replace(rules.BEGIN, b).replace(rules.END, b).replace(rules.WORD, r"\w")
    turn = lambda r: re.sub(r"\$(\d)", r"\\\1", r)

    def repair(t):
        for p, r in rules.LIGATURE_PREFIXES:
            t = re.sub(python(p), turn(r), t)
        for find, new in rules.LIGATURE_WORDS + rules.TEXT_LITERALS:
            t = t.replace(find, new)
        for p, r in rules.TEXT_CHARACTERS + rules.TEXT_WORDS + rules.TEXT_TAIL:
            t = re.sub(python(p), turn(r), t)
        return t

    return repair


def test_word_rules_equal_python(spark, arabic_rules):
    keys = [k for k, _ in rules.TEXT_LITERALS + rules.OCR_LITERALS] + ["يف", "اهم", "اين", "ديسمرب", "باكتوبر", "توزيعxاهتا", "كتاباهتم", "اا", "الصائية"]
    texts = [*keys, *(f"و{k} {k}، x{k}ة {k}" for k in keys), "قال يف البيت", "a اا b"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").coalesce(1).select(normalise.arabic_repairs(F.col("x"))).collect()]
    assert got == [arabic_rules(t) for t in texts]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("اأىةـ \n\tb", max_size=20), min_size=1, max_size=20))
def test_scanned_normalisation_is_idempotent(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "x string").select(normalise.arabic_scanned(F.col("x")).alias("a"))
    assert df.filter(normalise.arabic_scanned(F.col("a")) != F.col("a")).count() == 0
