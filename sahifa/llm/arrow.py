"""Arrow-batch plumbing shared by the operators that run Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sahifa.cluster import expose

#: Rows handed to a row function at a time, so that what it makes of them stays small next to an Arrow batch.
SLICE = 200


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, list]], schema: T.StructType) -> DataFrame:
    """Apply ``fn`` to slices of at most SLICE rows; it returns the result's columns as lists or arrays."""
    expose(df.sparkSession)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                out = fn(batch.slice(at, SLICE))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def map_stream(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, list]]], schema: T.StructType) -> DataFrame:
    """Apply ``fn`` to the batches of a partition as a stream; it yields the result's columns."""
    expose(df.sparkSession)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def field(df: DataFrame, name: str, as_name: str | None = None) -> T.StructField:
    return T.StructField(as_name or name, df.schema[name].dataType, True)
