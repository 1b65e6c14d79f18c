"""Connected components of a graph given as links, with DataFrame functions only.

Each round every node that still has links hooks to its smallest neighbour if that is smaller; the chains of hooks
are shortened by doubling until each points at its root; then links are drawn between roots, and those within a root
go. A round at least halves the nodes that have links. Each step is a written table, so a lost executor costs a
step. A node with very many links is met in an aggregate, which combines before it shuffles, and in joins, whose
large partitions Spark splits. Tables of few rows are dealt to few tasks, by their counted rows.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sahifa.cluster import materialize

#: Rows of a few numbers that are worth a task of their own; fewer share one.
TASK_ROWS = 20_000


def narrowed(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more tasks than the rows that its last step reads are worth, all sides counted. No row moves for it."""
    return df.coalesce(rows // TASK_ROWS + 1)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``node``, ``component``): the smallest node that each node of a link reaches. Null ends are left out.

    Links may repeat, run both ways or lead to their own node. No links give no rows.
    """
    whole = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    live = materialize(whole.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    ends = 2 * live.count()
    labels = materialize(narrowed(live.select(F.explode(F.array("a", "b")).alias("node")).distinct(), ends).withColumn("component", F.col("node")), "labels")
    nodes, live = labels.count(), live.filter("a <> b")
    while left := live.count():
        less = partial(narrowed, rows=2 * left)
        ways = live.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*")
        hooks = materialize(less(ways.groupBy("node").agg(F.min("other").alias("up")).select("node", F.least("node", "up").alias("up"))), "hooks")
        while True:
            over = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
            # Roots hook to themselves, so every hook finds a row.
            further = materialize(less(hooks.join(over, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved"))), "hooks")
            hooks = further.drop("moved")
            if further.filter("moved").isEmpty():
                break
        to = hooks.select(F.col("node").alias("component"), "up")
        labels = materialize(narrowed(labels.join(to, "component", "left").select("node", F.coalesce("up", "component").alias("component")), nodes + 2 * left), "labels")
        one = live.join(hooks.select(F.col("node").alias("a"), F.col("up").alias("x")), "a")
        both = one.join(hooks.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
        live = materialize(less(both.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()), "links")
    return labels
