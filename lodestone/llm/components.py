"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import durable


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); a component is named by its smallest node.

    Each round points every node to its smallest neighbour, follows the
    pointers one step further, and keeps the links between what the nodes
    point to. The links shrink until none is left. All tables are Spark's; only
    whether links are left comes to the driver.
    """
    ends = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = durable(ends.where("a != b").distinct())
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label"))
    while not edges.isEmpty():
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("v")).agg(F.min("b").alias("b"))
        first = durable(near.select("v", F.least("v", "b").alias("p")))
        again = first.select(F.col("v").alias("w"), F.col("p").alias("q"))
        to = durable(first.join(again, F.col("p") == F.col("w")).select("v", F.col("q").alias("p")))
        labels = durable(labels.join(to, F.col("label") == F.col("v"), "left").select("node", F.coalesce("p", "label").alias("label")))
        left = edges.join(to.select(F.col("v").alias("a"), F.col("p").alias("x")), "a").join(to.select(F.col("v").alias("b"), F.col("p").alias("y")), "b")
        edges = durable(left.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return labels.select("node", F.col("label").alias("component"))
