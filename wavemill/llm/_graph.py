"""Connected components by DataFrame rounds; no edge or label passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wavemill.llm._store import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for each node with an edge.

    In each round every node hooks onto the neighbour of least random rank (or stays), ranks being a
    hash of round and node, so that chains of hooks are short whatever the order of ids; hooks are
    followed for four steps, and the edges are contracted to what the nodes reach. Edges within a group
    vanish, so rounds shrink geometrically on stars and chains alike and end when none is left. A hub's
    edges meet only in partial minima and in equi-joins that adaptive execution may split.
    Nodes without an edge are absent. Null ends are ignored.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = materialise(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    step = 0
    while not now.isEmpty():
        step += 1
        rank = lambda c: F.xxhash64(F.lit(step), c)  # noqa: B023, E731  used within the round
        best = now.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("n"))).alias("m"))
        hook = best.select("a", F.when(F.col("m.r") < rank("a"), F.col("m.n")).otherwise(F.col("a")).alias("p"))
        for _ in range(2):
            up = hook.select(F.col("a").alias("p"), F.col("p").alias("q"))
            hook = materialise(hook.join(up, "p").select("a", F.col("q").alias("p")), "hooks")
        roots = roots.join(hook.select(F.col("a").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        ends = now.join(hook, "a").select(F.col("p").alias("x"), "b").join(hook.select(F.col("a").alias("b"), F.col("p").alias("y")), "b")
        now = materialise(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
    roots = materialise(roots, "roots")
    return materialise(roots.join(roots.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component"), "components")
