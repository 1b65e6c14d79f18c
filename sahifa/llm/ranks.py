"""Places in a global order, without ever sorting in one task.

Rows are dealt by range, sorted within partitions and numbered there; the partitions' totals, a row for each, then
give what comes before each partition. A table to be ordered is small in width: texts are never carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sahifa.cluster import materialize
from sahifa.llm.arrow import map_stream


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ordered_sums(df: DataFrame, order: list[str], value: str | None, group: str | None, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows up to and with this one, in ``order``, within ``group``.

    ``value`` None counts rows, so that ``out`` is a place from 1 on. ``group`` must be the first of ``order``, and
    so a group's rows lie in neighbouring partitions, however many it has; None is one group. ``df`` should be a
    written table, as dealing by range reads it twice. Rows that are equal in all of ``order`` may take each other's
    places.
    """
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField(out, T.LongType())])

    def run(batches):
        part, last, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64) if value else np.ones(n, np.int64)
            sums, starts, carried = np.cumsum(values), np.zeros(1, np.int64), total
            if group:
                keys = batch.column(group)
                codes = pc.fill_null(keys.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
                starts = np.concatenate([starts, np.flatnonzero(codes[1:] != codes[:-1]) + 1])
                carried = total if last == (keys[0].as_py(),) else 0
                last = (keys[n - 1].as_py(),)
            base = np.concatenate([[-carried], sums[starts[1:] - 1]])
            sums = sums - np.repeat(base, np.diff(np.append(starts, n)))
            total = int(sums[-1])
            yield {name: batch.column(name) for name in names} | {"_part": [part] * n, out: sums}

    dealt = df.repartitionByRange(partitions(df), *order).sortWithinPartitions(*order)
    local = materialize(map_stream(dealt, run, schema), "ranks")
    keys = ["_part", *([group] if group else [])]
    totals = local.groupBy(*keys).agg(F.max(out).alias("_total"))
    before = Window.partitionBy(*([group] if group else [])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each partition, and one more for each further group that a partition has.
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    renamed = offsets.select(*(F.col(k).alias(f"_o{k}") for k in keys), "_before")
    match = local["_part"] == renamed["_o_part"]
    if group:
        match &= local[group].eqNullSafe(renamed[f"_o{group}"])
    else:
        renamed = F.broadcast(renamed)  # a row for each partition
    return local.join(renamed, match).select(*names, (F.col(out) + F.col("_before")).alias(out))
