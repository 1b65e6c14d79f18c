"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, followed by the same queue again for as many rounds as
``max_repeats`` allows. A place in a queue has the virtual finish time (tokens of its source up to and with it) /
(target of the source). All places are ordered globally by finish time, and the mix is the longest start of that
order whose tokens do not exceed the budget. Every source so runs through its target at the same rate, and the cut
leaves each within about one document of its target.

Targets share the budget by weight; a source's target stops at ``max_repeats`` times its tokens, and the excess is
shared by weight among the others until none is above. In order of stop / weight the sources that stop are a start
of the list, so two running sums give the level of all others at once.

Defined cases: a null text has no tokens; a null source is a source of its own, last; sources go by code point; a
document without tokens takes none; rows that repeat in everything are documents of their own; an empty table gives
an empty result; a budget of no tokens takes nothing; only the identifier, text and source columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sahifa.cluster import materialize
from sahifa.llm.ranks import ordered_sums

SEED, WEIGHTS, MAX_REPEATS = "mix", (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str):
    """Words of a text: runs of anything but the six ASCII white space characters; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, share: float = 1.0) -> DataFrame:
    """(source, size, queue) rows to one row per source with ``source_size`` and ``target``.

    The table has a row for each source; its windows run in one task, whatever the number of documents.
    """
    everything = Window.orderBy(F.col("source").isNull(), "source")
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights)))
    per_source = per_source.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1).cast("long"))
    stop = F.col("source_size") * F.lit(max_repeats)
    by_stop = Window.orderBy(stop / F.col("_weight"), F.col("source").isNull(), "source")
    before, whole = by_stop.rowsBetween(Window.unboundedPreceding, -1), by_stop.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum(stop).over(before), F.lit(0))
    weight_left = F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), F.lit(0))
    levels = per_source.withColumn("_level", left / weight_left)
    # The level is that of the first source that doesn't stop below it; if all stop, none has any left over.
    fits = levels.withColumn("_fits", F.col("_level") * F.col("_weight") <= stop)
    level = F.first(F.when(F.col("_fits"), F.col("_level")), ignorenulls=True).over(whole)
    targets = fits.withColumn("target", F.least(F.coalesce(level * F.col("_weight"), stop.cast("double")), stop.cast("double")))
    return targets.select("source", "source_size", "target")


def queue_places(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """One row per input row: identifier, source, ``size``, ``text_key`` and ``queued``, its queue's tokens up to it."""
    shuffle_key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = df.select(F.col(source_col).cast("string").alias("source"), shuffle_key.alias("_key"), F.col(id_col).alias("_id"), n_words(text_col).alias("size"), F.xxhash64(text_col).alias("text_key"))
    return ordered_sums(materialize(rows, "sizes"), ["source", "_key", "_id", "size", "text_key"], "size", "source", "queued")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, share: float = 1.0, seed: str = SEED) -> DataFrame:
    """One row per input row: identifier, ``source``, ``text_key``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``."""
    queued = materialize(queue_places(df, id_col, text_col, source_col, seed), "queues")
    targets = materialize(source_targets(queued, weights, max_repeats, share), "targets")
    named = targets.select(F.col("source").alias("_source"), "source_size", "target")
    # A row for each source, so small next to the documents; Spark broadcasts it when its written size is small.
    rows = queued.join(named, queued["source"].eqNullSafe(named["_source"])).drop("_source")
    # A row's number keeps rows apart that are equal in everything; it's written with the places and stays what it is.
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    rounds = F.when(F.col("target") > 0, F.least(F.floor(F.col("target") / F.col("source_size")) + 1, F.lit(max_repeats - 1))).otherwise(F.lit(0))
    places = rows.withColumn("_round", F.explode(F.sequence(F.lit(0), rounds.cast("int"))))
    finish = F.when(F.col("target") > 0, (F.col("_round") * F.col("source_size") + F.col("queued")) / F.col("target")).otherwise(F.lit(0.0))
    places = materialize(places.withColumn("_finish", finish), "places")
    ordered = ordered_sums(places, ["_finish", "source", "_round", "_key", "_id", "size", "text_key", "queued", "_row"], "size", None, "_total")
    budget = F.lit(share) * F.lit(targets.agg(F.sum("source_size")).first()[0] or 0)
    # A round only follows the one before it, so the rounds that a row is in are a number of copies.
    same = ["_row", "_id", "source", "text_key", "size", "source_size", "target"]
    taken = ordered.groupBy(*same).agg(F.sum((F.col("_total") <= budget).cast("int")).alias("copies"))
    return taken.select(F.col("_id").alias(id_col), "source", "text_key", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def apply_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``df`` as the mix takes it: each row as often as its copies say, none being left out.

    Rows that repeat identifier, source and text can't be told apart: together they are taken as often as the mix
    takes them, each as often as the others or once more.
    """
    names = df.columns
    rows = df.toDF(*(f"_c{i}" for i in range(len(names))))
    place = {n: f"_c{i}" for i, n in enumerate(names)}
    keys = [F.col(id_col).alias("_k_id"), F.col("source").alias("_k_source"), F.col("text_key").alias("_k_text")]
    same = mix(df, id_col, text_col, source_col, **how).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("copies").alias("_sum"))
    same = materialize(same.filter("_sum > 0"), "copies").withColumn("_copies", F.floor(F.col("_sum") / F.col("_n")).cast("int")).withColumn("_over", F.pmod("_sum", "_n"))
    match = F.col(place[id_col]).eqNullSafe(F.col("_k_id")) & F.col(place[source_col]).cast("string").eqNullSafe(F.col("_k_source")) & (F.xxhash64(place[text_col]) == F.col("_k_text"))
    out = [F.col(place[n]).alias(n) for n in names]
    repeated = lambda x: x.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*out)
    even = repeated(rows.join(same.filter("_over = 0"), match))
    uneven = same.filter("_over > 0")
    if uneven.isEmpty():
        return even
    # Which of the equal rows are taken once more is told by their places in one order, found without a task for each group.
    group = F.xxhash64("_k_id", "_k_source", "_k_text").cast("string")
    told = materialize(rows.join(uneven, match).withColumn("_group", group).withColumn("_row", F.monotonically_increasing_id()), "told")
    ranks = ordered_sums(told.select("_group", "_row"), ["_group", "_row"], None, "_group", "_rank").select("_row", "_rank")
    more = told.join(ranks, "_row").withColumn("_copies", F.col("_copies") + (F.col("_rank") <= F.col("_over")).cast("int")).filter("_copies > 0")
    return even.unionByName(repeated(more))
