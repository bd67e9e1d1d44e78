"""Connected components of an edge table with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Labels each node of `edges` (a, b: long) with the smallest node it can reach: columns node, comp.

    Label propagation with pointer jumping: each round a node takes the smallest label of its neighbours
    and then the label of that label, so a chain of n nodes needs about log n rounds. Each round is
    written to the shared folder; nothing but one changed-row flag reaches the driver.
    """
    both = scratch.keep(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges"
    )
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), f"{name}-0")
    round_ = 0
    while True:
        round_ += 1
        near = (
            both.join(labels.select(F.col("node").alias("b"), "comp"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        )
        hop = labels.select(F.col("node").alias("comp"), F.col("comp").alias("hop"))
        moved = (
            labels.join(near, "node").join(hop, "comp")
            .select("node", F.col("comp").alias("old"), F.least("comp", "near", "hop").alias("comp"))
        )
        moved = scratch.keep(moved, f"{name}-{round_}")
        still = moved.where("comp <> old").limit(1).count()
        labels = moved.select("node", "comp")
        if round_ > 1:
            scratch.drop(f"{name}-{round_ - 2}")
        if not still:
            return labels
