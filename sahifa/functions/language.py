"""The detectors of language. They differ in alphabet and in what they call undecided, and are kept apart for that."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sahifa.functions.text import ARABIC, LATIN, count_matches, lines, or_empty, present, strip

WIDE_ARABIC = r"[؀-ۿݐ-ݿࢠ-ࣿ]"
MIN_CHARS, MOSTLY, HARDLY = 3, 0.7, 0.3


def block_language(c: Column) -> Column:
    """``ar`` or ``en`` if only letters of one are there, else ``mixed``."""
    ar, en = or_empty(c).rlike(ARABIC), or_empty(c).rlike(LATIN)
    return F.when(ar & ~en, "ar").when(en & ~ar, "en").otherwise("mixed")


def wide_language(c: Column) -> Column:
    """As ``block_language`` over a wider Arabic alphabet; ``other`` without letters of either."""
    ar, en = or_empty(c).rlike(WIDE_ARABIC), or_empty(c).rlike(LATIN)
    return F.when(ar & en, "mixed").when(ar, "ar").when(en, "en").otherwise("other")


def robust_language(c: Column) -> Column:
    """By the share of Arabic letters: above 0.7 ``ar``, below 0.3 ``en``; ``mixed`` between, or with too little text."""
    ar, en = count_matches(c, ARABIC), count_matches(c, LATIN)
    share = ar / (ar + en)
    short = F.length(strip(or_empty(c))) < MIN_CHARS
    return F.when(short | (ar + en == 0), "mixed").when(share > MOSTLY, "ar").when(share < HARDLY, "en").otherwise("mixed")


def present_language(ar: Column, en: Column) -> Column:
    """By which of two texts is there after stripping."""
    has_ar, has_en = present(strip(or_empty(ar))).isNotNull(), present(strip(or_empty(en))).isNotNull()
    return F.when(has_ar & ~has_en, "ar").when(has_en & ~has_ar, "en").otherwise("mixed")


def lines_by_language(c: Column) -> Column:
    """Struct of the lines of a text in Arabic, in English, and in both or neither."""
    of = lambda *kinds: F.filter(lines(c), lambda line: wide_language(line).isin(*kinds))
    return F.struct(of("ar").alias("ar"), of("en").alias("en"), of("mixed", "other").alias("mixed"))


def language_array(language: Column) -> Column:
    return F.when(language == "mixed", F.array(F.lit("ar"), F.lit("en"))).otherwise(F.array(language))


def is_parallel(c: Column) -> Column:
    """Whether the first blank line parts two texts of different languages, neither mixed."""
    parts = F.split(or_empty(c), "\n\n", 2)
    one, two = robust_language(F.get(parts, F.lit(0))), robust_language(F.get(parts, F.lit(1)))
    return or_empty(c).contains("\n\n") & (one != two) & (one != "mixed") & (two != "mixed")
