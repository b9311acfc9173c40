"""Connected components of edge tables, by rounds of minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wavemill.operators.order import written


def _cut(df: DataFrame) -> DataFrame:
    return written(df, "graph")


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node reachable, for nodes with an edge."""
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = _cut(pairs.union(pairs.select("b", "a").toDF("a", "b")).distinct())
    labels = _cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(labels.toDF("b", "c"), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("m"))
        low = labels.join(near, "node").select("node", F.least("component", "m").alias("component"), F.col("component").alias("was"))
        jump = low.select(F.col("node").alias("component"), F.col("component").alias("to"))
        after = _cut(low.join(jump, "component", "left").select("node", F.coalesce("to", "component").alias("component"), "was"))
        labels = after.select("node", "component")
        if after.where("component <> was").isEmpty():
            return labels
