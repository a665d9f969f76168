"""Connected components of a link table, on the cluster: nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored


FILE_ROWS = 200_000  # of a written table; a table of more rows has more files and tasks


def connected_components(edges: DataFrame) -> DataFrame:
    """(a long, b long) links -> (node, component): the smallest node that links reach.

    Smallest neighbouring label plus pointer jumping: each round takes the least label among a node's neighbours and
    itself, then that label's own label, so rounds grow with the logarithm of a chain's length. Sums and minima are
    combined before the shuffle, and the joins have one row per node on one side, so a hub with a third of all links
    only makes the other side skewed, which adaptive execution splits. Nulls and loops are ignored; an empty table
    gives an empty table.
    """
    both = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = stored(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    few = -(-both.count() // FILE_ROWS) or 1  # files of a round's table: its rows are fewer than the links
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component"))
    labels = stored(labels.coalesce(few))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "m").alias("c1"))
        jump = labels.select(F.col("node").alias("root"), F.col("component").alias("up"))
        moved = step.join(jump, step.c1 == jump.root).select("node", "old", F.least("c1", "up").alias("component"))
        new = stored(moved.coalesce(few))
        changed = new.where("component <> old").limit(1).count()
        release(labels)
        labels = new
        if not changed:
            release(both)
            return labels.select("node", "component")
