"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of the links (a, b): label is the smallest node it reaches.

    Each round points every node at its smallest neighbour, follows the pointers
    to their ends and contracts the graph. Links and labels stay tables in the
    shared folder; nothing but an emptiness test reaches the driver.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(both.where("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        ends = written(edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "ends")
        while True:
            on = ends.select(F.col("node").alias("label"), F.col("label").alias("far"))
            jumped = written(ends.join(on, "label").select("node", F.col("far").alias("label"), F.col("label").alias("was")), "ends")
            ends = jumped.select("node", "label")
            if jumped.where("label <> was").isEmpty():
                break
        if labels is None:
            labels = ends
        else:
            on = ends.select(F.col("node").alias("label"), F.col("label").alias("far"))
            labels = written(
                labels.join(on, "label", "left").select("node", F.coalesce("far", "label").alias("label")), "labels"
            )
        left = ends.select(F.col("node").alias("a"), F.col("label").alias("la"))
        right = ends.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        edges = written(
            edges.join(left, "a").join(right, "b").where("la <> lb")
            .select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(),
            "edges",
        )
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
