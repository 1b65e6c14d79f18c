"""Pairing the Arabic and English blocks of a page that stand side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sahifa.functions.text import present

TOLERANCE = 10.0


def aligned(a: str, b: str, tolerance: float = TOLERANCE) -> Column:
    """Whether the vertical ranges of two boxes (structs) touch, or their centres are near."""
    ay0, ay1, by0, by1 = F.col(f"{a}.y0"), F.col(f"{a}.y1"), F.col(f"{b}.y0"), F.col(f"{b}.y1")
    return ((ay1 >= by0) & (by1 >= ay0)) | (F.abs((ay0 + ay1) / 2 - (by0 + by1) / 2) <= tolerance)


def side(c: str) -> Column:
    """Whether a block has Arabic only, English only, both or nothing; a table is its own kind."""
    ar, en = present(F.col("ar")).isNotNull(), present(F.col("en")).isNotNull()
    return F.when(F.col("type") == "table", "table").when(ar & en, "both").when(ar, "ar").when(en, "en").otherwise("none").alias(c)


def box(alias: str) -> Column:
    return F.struct("x0", "y0", "x1", "y1").alias(alias)


def aligned_pairs(blocks: DataFrame) -> DataFrame:
    """All aligned (Arabic, English) blocks of a page with the distance of their centres: an equi-join on the page."""
    rows = blocks.select("doc_id", "page_number", "block_seq", side("side"), box("b")).filter(F.col("b.y0").isNotNull())
    ar = rows.filter("side = 'ar'").select("doc_id", "page_number", F.col("block_seq").alias("ar_seq"), F.col("b").alias("a"))
    en = rows.filter("side = 'en'").select("doc_id", "page_number", F.col("block_seq").alias("en_seq"), F.col("b").alias("e"))
    distance = F.abs((F.col("a.x0") + F.col("a.x1")) / 2 - (F.col("e.x0") + F.col("e.x1")) / 2)
    return ar.join(en, ["doc_id", "page_number"]).filter(aligned("a", "e")).select("doc_id", "page_number", "ar_seq", "en_seq", distance.alias("distance"))


def greedy_pairs(candidates: DataFrame) -> DataFrame:
    """One-to-one pairs: Arabic blocks in order, each taking the nearest English block that is left, the first of equals.

    What is nearest is 1 / (distance + 1) in doubles, so far distances can be equal there. A fold over a page's
    Arabic blocks; the state is the pairs so far.
    """
    per_ar = candidates.groupBy("doc_id", "page_number", "ar_seq").agg(F.array_sort(F.collect_list(F.struct("en_seq", (1.0 / (F.col("distance") + 1.0)).alias("score")))).alias("options"))
    per_page = per_ar.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("ar_seq", "options"))).alias("todo"))
    folded = """
        aggregate(todo, CAST(array() AS ARRAY<STRUCT<ar_seq: INT, en_seq: INT>>), (done, a) ->
            transform(array(aggregate(filter(a.options, o -> NOT exists(done, d -> d.en_seq = o.en_seq)),
                CAST(named_struct('en_seq', NULL, 'score', 0D) AS STRUCT<en_seq: INT, score: DOUBLE>),
                (best, o) -> IF(o.score > best.score, named_struct('en_seq', o.en_seq, 'score', o.score), best))),
                best -> IF(best.en_seq IS NULL, done, concat(done, array(named_struct('ar_seq', a.ar_seq, 'en_seq', best.en_seq)))))[0])"""
    return per_page.select("doc_id", "page_number", F.explode(F.expr(folded)).alias("p")).select("doc_id", "page_number", "p.ar_seq", "p.en_seq")


def pair_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with each pair as one, in a page's new order: bilingual, Arabic (paired or not), English, empty, tables.

    A pair has the Arabic block's type unless that is a paragraph, then the English one's, and a box around both.
    """
    pairs = greedy_pairs(aligned_pairs(blocks))
    rows = blocks.withColumn("_side", side("_side"))
    en = rows.join(pairs, (rows["doc_id"] == pairs["doc_id"]) & (rows["page_number"] == pairs["page_number"]) & (rows["block_seq"] == pairs["en_seq"])).select(
        rows["doc_id"].alias("_d"), rows["page_number"].alias("_p"), F.col("ar_seq"), F.struct(rows["type"], rows["en"], rows["x0"], rows["y0"], rows["x1"], rows["y1"], F.col("en_seq")).alias("e")
    )
    whole = rows.join(en, (F.col("doc_id") == F.col("_d")) & (F.col("page_number") == F.col("_p")) & (F.col("block_seq") == F.col("ar_seq")), "left")
    used = en.select(F.col("_d").alias("_ud"), F.col("_p").alias("_up"), F.col("e.en_seq").alias("_us"))
    whole = whole.join(used, (F.col("doc_id") == F.col("_ud")) & (F.col("page_number") == F.col("_up")) & (F.col("block_seq") == F.col("_us")), "left_anti")
    paired = F.col("e").isNotNull()
    ranks = F.create_map(*(F.lit(x) for pair in (("both", 0), ("ar", 1), ("en", 2), ("none", 3), ("table", 4)) for x in pair))
    return whole.select(
        "doc_id", "page_number", "block_seq", ranks[F.col("_side")].alias("rank"), F.when(paired & (F.col("type") == "paragraph"), F.col("e.type")).otherwise(F.col("type")).alias("type"),
        "ar", F.when(paired, F.col("e.en")).otherwise(F.col("en")).alias("en"),
        *(F.when(paired, F.least(c, f"e.{c}")).otherwise(F.col(c)).alias(c) for c in ("x0", "y0")), *(F.when(paired, F.greatest(c, f"e.{c}")).otherwise(F.col(c)).alias(c) for c in ("x1", "y1")),
    )
