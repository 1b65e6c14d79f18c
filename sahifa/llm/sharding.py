"""Sharding along a Hilbert curve.

Several dimensions of the metadata are quantised to cells of 2^BITS a side: source, language, length of the text and
identifier. Documents are ordered by the index of their cell on the Hilbert curve through all cells, then by
identifier, and the order is cut into runs of equal counts. A run is a small region in all dimensions at once, so
files written by run have narrow ranges of each dimension and readers can skip them by any.

The law that holds is ``rows``: counts are at most one apart, for any sizes and any hot source. Copies lie wherever
their identifiers put them. Defined cases: a null text has no bytes; null sources, languages and identifiers have the
first cell of their dimension; rows that repeat in everything may take each other's places; an empty table gives an
empty result; columns other than those named as parameters are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sahifa.cluster import materialize
from sahifa.llm.arrow import map_slices
from sahifa.llm.ranks import ordered_sums

#: Bits of a cell in each dimension; with four dimensions an index has 32.
BITS = 8


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of each row of ``cells`` (rows by dimensions, each entry below 2**bits).

    From the highest bit down, every dimension's bit decides how the cells below it are reflected or exchanged with
    the first dimension; what is left is a Gray code of the index, most significant bit first across dimensions.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for d in range(dims):
            on = (x[d] >> bit) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(on, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= turn
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for d in range(dims):
            index = (index << 1) | ((x[d] >> bit) & 1)
    return index


def scaled(column, low, high):
    """A number's cell between the least and the greatest of its column, by equal steps."""
    span = F.greatest(high.cast("double") - low.cast("double"), F.lit(1.0))
    return F.coalesce(F.floor((column.cast("double") - low.cast("double")) / span * ((1 << BITS) - 1)), F.lit(0)).cast("int")


def curve_places(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row per input row: identifier, ``size``, ``text_crc32``, ``curve`` and ``place`` (from 1 on, no gaps)."""
    cells = [F.coalesce(F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(1 << BITS)), F.lit(0)).cast("int").alias(f"_c{i}") for i, c in enumerate(categories)]
    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    rows = df.select(
        F.col(id_col).alias("_id"), (n_bytes + 16).alias("size"), F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).alias("text_crc32"), *cells,
        F.least(F.floor(F.log2(n_bytes + 1) * 10), F.lit((1 << BITS) - 1)).cast("int").alias("_length"),
    )
    rows = materialize(rows, "cells")
    # One row: joined to all, it costs nothing.
    ends = rows.agg(F.min("_id").alias("_low"), F.max("_id").alias("_high")).first()
    names = [f"_c{i}" for i in range(len(categories))] + ["_length", "_cell"]
    numbered = rows.withColumn("_cell", scaled(F.col("_id"), F.lit(ends["_low"]), F.lit(ends["_high"])) if ends["_low"] is not None else F.lit(0))

    def run(batch):
        stack = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1) if batch.num_rows else np.zeros((0, len(names)), np.int64)
        return {"_id": batch.column("_id"), "size": batch.column("size"), "text_crc32": batch.column("text_crc32"), "curve": hilbert_index(stack)}

    schema = T.StructType([rows.schema["_id"], T.StructField("size", T.LongType()), T.StructField("text_crc32", T.LongType()), T.StructField("curve", T.LongType())])
    curve = materialize(map_slices(numbered, run, schema), "curve")
    placed = ordered_sums(curve, ["curve", "_id", "text_crc32", "size"], None, None, "place")
    return placed.withColumnRenamed("_id", id_col)


def shard(df: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """``curve_places`` with ``shard`` (0 on) and ``slot`` (place in the shard, 0 on)."""
    total = max(1, df.count())
    cut = curve_places(df, id_col, text_col, categories).withColumn("shard", F.expr(f"CAST((place - 1) * {n_shards}L DIV {total}L AS INT)"))
    return cut.withColumn("slot", F.expr(f"place - 1 - (shard * {total}L + {n_shards - 1}L) DIV {n_shards}L"))


def write_shards(df: DataFrame, path: str, n_shards: int = 40, id_col: str = "doc_id", **names) -> None:
    """Write whole rows as Parquet, a folder for each shard, in the order of the curve. Identifiers must be unique."""
    places = shard(df, n_shards, id_col, **names).select(F.col(id_col).alias("_id"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    rows = df.join(places, df[id_col] == places["_id"]).drop("_id")
    rows.repartitionByRange(n_shards, "_shard", "_slot").sortWithinPartitions("_shard", "_slot").drop("_slot").write.partitionBy("_shard").parquet(path)
