"""Helpers on whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with column ``name``, whose expression is evaluated once however often the column is used.

    The optimiser puts a projected expression into each place that uses it; it doesn't look through a generator, and
    a generator over an array of one leaves each row as it is.
    """
    return df.select(*(c for c in df.columns if c != name), F.explode(F.array(value)).alias(name))
