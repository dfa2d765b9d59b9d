"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tasks import BROADCAST_ROWS, gathered, rows_of, stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the smallest node reachable.

    Each round takes the smallest label among a node's own and its neighbours' and then that
    label's own label, so long chains shrink by halves. Labels are staged between rounds;
    nothing but counts reaches the driver. ``edges``, staged, is read once a round. Labels are
    broadcast if they are few, so that a round shuffles the neighbours' labels alone.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    nodes = 2 * rows_of(edges)
    few = nodes <= BROADCAST_ROWS
    first = both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root"))
    labels = stage(gathered(first, nodes), "labels")
    while True:
        of = F.broadcast(labels) if few else labels
        near = (
            both.join(of.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near")))
        lower = near.join(of, "node").select("node", "root", F.least("root", "near").alias("low"))
        up = of.select(F.col("node").alias("low"), F.col("root").alias("up"))
        jumped = lower.join(F.broadcast(up) if few else up, "low").select(
            "node", F.least("low", "up").alias("root"), F.col("root").alias("was"))
        moved = stage(gathered(jumped, nodes), "labels")
        labels = moved.select("node", "root")
        if not moved.where("root != was").limit(1).count():
            return labels
