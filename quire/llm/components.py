"""Connected components of links between long ids, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) to (node, label): the smallest node reachable. Nodes without links are absent.

    Each round takes the smallest label among a node's neighbours and then the
    label of that label, so that chains halve; every round is written out, so a
    lost executor costs one round at most. Nulls, repeated links and loops are
    ignored.
    """
    one = links.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    both = cut(one.unionAll(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    kept = labels
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("was"), F.least("label", "m").alias("now"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("top"))
        new = cut(step.join(up, step.now == up.up, "left").select("node", "was", F.least("now", F.coalesce("top", "now")).alias("label")), "labels")
        drop(kept)
        kept, labels = new, new.select("node", "label")
        if new.where("was <> label").isEmpty():
            drop(both)
            return labels
