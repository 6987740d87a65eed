"""Connected components of a link table: least labels with pointer jumping, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, table


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): for every node that occurs in `links` (long ids) the smallest node it reaches.

    Each round a node takes the least label among itself and its neighbours (grouped with map-side
    combine, so a hub is no single task), then the label of its label; rounds are about logarithmic.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = table(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    labels = table(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("comp")), "cc-labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("v"), F.col("comp").alias("c")), "v").groupBy("u").agg(F.min("c").alias("c"))
        # what a node learns goes to its old label too, so that whole trees hang over at once
        step = labels.join(near, labels.node == near.u).select("node", "comp", F.least("comp", "c").alias("new"))
        told = step.select(F.col("node").alias("node"), "new").unionByName(step.select(F.col("comp").alias("node"), "new")).groupBy("node").agg(F.min("new").alias("new"))
        jump = told.select(F.col("node").alias("new"), F.col("new").alias("far"))
        hop = told.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("comp"))
        nxt = table(hop, "cc-labels")
        changed = nxt.join(labels.withColumnRenamed("comp", "old"), "node").where("comp <> old").limit(1).count()
        discard(labels)
        labels = nxt
        if not changed:
            discard(edges)
            return labels
