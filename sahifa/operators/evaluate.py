"""How much of an original text an extraction has kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sahifa.functions.text import ARABIC, count_matches, or_empty, percent_off, present

LENGTH_ISSUE, KEPT_ISSUE, KEPT_ADVICE, LENGTH_ADVICE = 50, 0.5, 0.7, 30
GRADES, READY = ((80, "EXCELLENT"), (60, "GOOD"), (40, "FAIR")), ((70, "suitable"), (50, "acceptable"))


def english_words(c: Column) -> Column:
    """Words of three or more letters between word boundaries, as digits and underlines are parts of words."""
    return count_matches(c, r"(?U)\b[a-zA-Z]{3,}\b")


def word_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(or_empty(c)), F.lit(r"(?U)\w+"), F.lit(0)))


def compare(original: Column, extracted: Column) -> Column:
    """Struct of lengths, letters, words, similarity (per cent of the original's words) and issues; zeros if either is absent."""
    there = present(original).isNotNull() & present(extracted).isNotNull()
    a, b = F.length(or_empty(original)), F.length(or_empty(extracted))
    counts = {name: (count_matches(or_empty(c), ARABIC), english_words(or_empty(c))) for name, c in (("original", original), ("extracted", extracted))}
    off = percent_off(a, b)
    words = word_set(original)
    similarity = F.when(F.size(words) > 0, F.size(F.array_intersect(words, word_set(extracted))) / F.size(words) * 100).otherwise(0.0)
    issues = [F.when(off > LENGTH_ISSUE, F.concat(F.lit("Significant length difference: "), F.format_string("%.1f", off), F.lit("%")))]
    for place, name in enumerate(("Arabic", "English")):
        before, after = counts["original"][place], counts["extracted"][place]
        fewer = F.concat(F.lit(f"{name} text significantly reduced: "), before.cast("string"), F.lit(" -> "), after.cast("string"))
        issues.append(F.when((before > 0) & (after == 0), F.lit(f"{name} text missing in extraction")).when((before > 0) & (after < before * KEPT_ISSUE), fewer))
    zero = lambda c: F.when(there, c).otherwise(0)
    return F.struct(
        F.when(there, similarity).otherwise(0.0).alias("similarity"), a.alias("original_length"), b.alias("extracted_length"), zero(F.abs(a - b)).alias("length_diff"),
        F.when(there, off).otherwise(0.0).alias("length_diff_pct"), *(zero(counts[n][k]).alias(f"{n}_{kind}") for k, kind in enumerate(("arabic", "english")) for n in ("original", "extracted")),
        F.when(there, F.array_compact(F.array(*issues))).otherwise(F.array().cast("array<string>")).alias("issues"),
    )


def compare_pages(original: DataFrame, extracted: DataFrame, pages: list[int] | None = None) -> DataFrame:
    """Comparison of the pages (``doc_id``, ``page_number``, ``text``) that both have; all or the given ones."""
    if pages is not None:
        original = original.filter(F.col("page_number").isin(pages))
    other = extracted.filter(present(F.col("text")).isNotNull()).select("doc_id", "page_number", F.col("text").alias("_extracted"))
    return original.join(other, ["doc_id", "page_number"]).select("doc_id", "page_number", compare(F.col("text"), F.col("_extracted")).alias("c")).select("doc_id", "page_number", "c.*")


def summarise(comparisons: DataFrame) -> DataFrame:
    """One row: averages, totals, retention, grade, readiness and advice."""
    kept = lambda kind: F.when(F.col(f"original_{kind}") > 0, F.col(f"extracted_{kind}") / F.col(f"original_{kind}") * 100).otherwise(0.0)
    totals = [F.coalesce(F.sum(f"{n}_{k}"), F.lit(0)).alias(f"{n}_{k}") for n in ("original", "extracted") for k in ("arabic", "english")]
    one = comparisons.agg(F.count(F.lit(1)).alias("pages"), F.avg("similarity").alias("avg_similarity"), F.avg("length_diff_pct").alias("avg_length_diff"), *totals)
    similarity = F.col("avg_similarity")
    grade, ready = F.lit("POOR"), F.lit("poor")
    for least, name in reversed(GRADES):
        grade = F.when(similarity >= least, name).otherwise(grade)
    for least, name in reversed(READY):
        ready = F.when(similarity >= least, name).otherwise(ready)
    low = lambda kind: F.col(f"extracted_{kind}") < F.col(f"original_{kind}") * KEPT_ADVICE
    return one.select(
        "*", kept("arabic").alias("arabic_kept_pct"), kept("english").alias("english_kept_pct"), grade.alias("grade"), ready.alias("readiness"),
        low("arabic").alias("check_rtl"), low("english").alias("check_method"), (F.col("avg_length_diff") > LENGTH_ADVICE).alias("check_missing"),
    )
