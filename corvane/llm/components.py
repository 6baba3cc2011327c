"""Connected components of a link table by iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def thinned(links: DataFrame) -> DataFrame:
    """x, y: links that connect the same nodes, about one for each node.

    Tasks that see the same group link its nodes to different small nodes. A
    node keeps the link to the smallest of those; the others are linked to that
    one instead, and such links between small nodes are few. links: x, y.
    """
    own = links.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    own = own.groupBy("x").agg(F.collect_set("y").alias("to")).withColumn("y", F.array_min("to"))
    moved = own.select("x", "y", F.explode("to").alias("z"))
    return moved.select(F.when(F.col("z") == F.col("y"), F.col("x")).otherwise(F.col("z")).alias("x"), "y").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node reachable) for every node that has a link.

    Minimum labels move over links and then along labels (pointer jumping), so
    the rounds grow with the logarithm of a component's diameter. Links and
    labels stay in the cluster; each round is a written table, and the driver
    sees only whether a label changed. A node's smaller neighbours are collected
    once, so callers keep them few (one for each cell that a node is in). Minima are aggregated before they
    are shuffled; large nodes meet only in joins, which AQE splits. Self links
    give a component of one node; null ends are left out; no links, no rows.
    """
    ends = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    alone = ends.where("x = y")
    ends = written(thinned(ends), "thin-links")
    both = written(ends.union(ends.select("y", "x")).union(alone).distinct(), "links")
    labels = written(both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("node"), F.min("y")).alias("root")), "labels")
    while True:
        # the smallest label among a node's neighbours, then the label of that label
        met = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("root").alias("met"))
        hooked = labels.join(met, F.col("node") == F.col("x"), "left").select("node", F.col("root").alias("was"), F.least("root", "met").alias("root"))
        at = labels.select(F.col("node").alias("at"), F.col("root").alias("jump"))
        moved = hooked.join(at, F.col("root") == F.col("at"), "left").select("node", "was", F.least("root", "jump").alias("root"))
        moved = written(moved, "labels")
        labels = moved.select("node", "root")
        if moved.where("root < was").isEmpty():
            return labels
