"""Connected components by joins: labels go down to the smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every id in links (a, b); component: the smallest id reachable.

    Each round a node takes the smallest label of its neighbours and then the
    label of that label, so a chain halves. The two sides of every join are
    exchanged, so that a hub with very many links can be split, and minima are
    taken before the shuffle. Links with a null or with a = b are ignored.
    Only one count a round reaches the driver.
    """
    both = links.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
    edges = written(both.select(F.col("e.a").alias("src"), F.col("e.b").alias("dst")), "edges")
    labels = written(
        edges.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("least")).select("node", F.least("node", "least").alias("component")),
        "labels",
    )
    while True:
        near = edges.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("low"))
        hop = labels.select(F.col("node").alias("low"), F.col("component").alias("next"))
        step = written(low.join(hop, "low").select("node", "old", F.least("low", "next").alias("component")), "labels")
        labels = step.select("node", "component")
        if step.where("old <> component").isEmpty():
            return labels
