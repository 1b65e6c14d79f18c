"""Issues of chunks, in a long table of (``doc_id``, ``issue``, ``chunk_id``), and reports of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sahifa.functions import rules
from sahifa.functions.language import robust_language
from sahifa.functions.text import or_empty, present, word_count

ISSUES = ("fake_bilingual", "missing_metadata", "duplicate_ids", "broken_arabic", "toc_leakage", "missing_embedding_flag", "low_information")
SMALL_WORDS = 30


def is_broken(ar: Column) -> Column:
    found = F.lit(False)
    for mark in rules.BROKEN_ARABIC:
        found |= or_empty(ar).contains(mark)
    return found


def is_repeated(scope: tuple[str, ...] = ("doc_id",)) -> Column:
    """Whether a chunk's identifier has been seen before it in its document."""
    return F.row_number().over(Window.partitionBy(*scope, "chunk_id").orderBy("chunk_seq")) > 1


def chunk_issues(chunks: DataFrame) -> DataFrame:
    """One row per issue of each chunk; texts that are equal and of one language make ``fake_bilingual`` twice."""
    ar, en = or_empty(F.col("ar")), or_empty(F.col("en"))
    both = (ar != "") & (en != "")
    same_language = robust_language(ar).eqNullSafe(robust_language(en)) & (robust_language(ar) != "mixed")
    rows = chunks.withColumn("_again", is_repeated()).withColumn("_words", word_count(F.col("ar"), F.col("en")))
    tests = [
        ("fake_bilingual", both & (ar == en)),
        ("fake_bilingual", both & same_language),
        ("missing_metadata", present(F.col("chapter")).isNull() & present(F.col("section")).isNull()),
        ("duplicate_ids", F.col("_again")),
        ("broken_arabic", is_broken(ar)),
        ("toc_leakage", F.col("chunk_type") == "toc"),
        ("missing_embedding_flag", F.col("embedding_allowed").isNull()),
        ("low_information", F.coalesce(F.col("embedding_allowed"), F.lit(False)) & (F.col("_words") < SMALL_WORDS)),
    ]
    found = F.filter(F.array(*(F.when(test, name) for name, test in tests)), lambda i: i.isNotNull())
    return rows.select("doc_id", "chunk_seq", "chunk_id", F.explode(found).alias("issue"))


def issue_report(issues: DataFrame, examples: int = 5) -> DataFrame:
    """Per issue its count, the first chunks that have it, and whether it is absent; all issues are in the report."""
    spark = issues.sparkSession
    names = spark.createDataFrame([(n,) for n in ISSUES], "issue string")
    # A bounded list of examples: the first by order, found by a rank rather than by gathering all.
    first = Window.partitionBy("issue").orderBy("doc_id", "chunk_seq")
    top = issues.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= examples)
    shown = top.groupBy("issue").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "chunk_id"))), lambda r: r["chunk_id"]), ", ").alias("examples"))
    counts = issues.groupBy("issue").agg(F.count(F.lit(1)).alias("n"))
    report = names.join(counts, "issue", "left").join(shown, "issue", "left")
    return report.select("issue", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("examples", F.lit("")).alias("examples"), F.coalesce(F.col("n") == 0, F.lit(True)).alias("passed"))
