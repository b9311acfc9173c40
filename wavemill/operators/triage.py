"""Events in dense places: mean distance to the nearest others, set against what is usual at their depth."""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame, Window, functions as F

from wavemill.operators.joins import knn
from wavemill.operators.order import written


def usual_distance(points: DataFrame, depth: str, distance: str, width: float, sigma: float) -> DataFrame:
    """(edge, usual): mean distance in depth bins of ``width`` from the least depth on, smoothed by a Gaussian of ``sigma`` depths.

    Edge k carries the mean of the bin before it, [edge k - 1, edge k); the first edge and empty bins carry the largest distance.
    Weights go to four sigma, and nothing lies beyond the edges. Depths from the last edge on are in no bin. The bins are as many
    as the probe is deep over ``width``, so edges, not events, meet in the smoothing.
    """
    low, high, most = points.agg(F.min(depth), F.max(depth), F.max(distance)).first()
    if low is None:
        return points.sparkSession.createDataFrame([], "edge double, usual double")
    steps = max(1, int(-(-(high - low) // width)))  # edges low, low + width .. below high
    at = F.floor((F.col(depth) - low) / width) + 1
    means = points.groupBy(at.cast("long").alias("k")).agg(F.avg(distance).alias("mean"))
    edges = points.sparkSession.range(steps).withColumnRenamed("id", "k").join(F.broadcast(means), "k", "left")  # a row per bin
    s = sigma / width
    reach = int(4 * s + 0.5)
    weights = [exp(-0.5 * (i / s) ** 2) if s > 0 else 1.0 for i in range(-reach, reach + 1)]
    weights = [w / sum(weights) for w in weights]
    spread = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in zip(range(-reach, reach + 1), weights, strict=True)]))
    parts = edges.select("k", F.coalesce("mean", F.lit(float(most))).alias("mean"), spread.alias("s"))
    parts = parts.select((F.col("k") + F.col("s.i")).alias("k"), (F.col("mean") * F.col("s.w")).alias("v")).where(F.col("k").between(0, steps - 1))
    return parts.groupBy("k").agg(F.sum("v").alias("usual")).select((low + F.col("k") * width).alias("edge"), "usual")


def region_adaptive(
    events: DataFrame,
    key: str,
    x: str,
    z: str,
    size: str,
    scales: tuple[float, float, float] = (1, 1, 50),
    log_c: float = 5,
    percent: float = 80,
    least: float = 3,
    width: float = 5,
    region: float | None = 25,
) -> DataFrame:
    """(key, distance, score, kept) for events whose ``size`` exceeds ``least``: their mean distance to the five nearest in
    (x, z, log(log_c + size)), its logarithm less that of what is usual at the depth less log(scale * log(size)), and whether that
    is within the percentile. The usual distance is interpolated between edges, and extended by the last two beyond them;
    where that isn't positive, and for sizes of at most 1, the score is null and the event isn't kept. At distance 0 it is minus
    infinity. Without ``region`` there is no depth term. Keys are unique; a lone event and rows with nulls or no numbers are left out."""
    e = events.select(F.col(key).alias("id"), *[F.col(c).cast("double").alias(n) for c, n in ((x, "x"), (z, "z"), (size, "a"))])
    for c in ("x", "z", "a"):
        e = e.where(F.col(c).isNotNull() & ~F.isnan(c))
    e = e.where(F.col("a") > least)
    features = e.select("id", (F.col("x") * scales[0]).alias("f0"), (F.col("z") * scales[1]).alias("f1"), (F.log(log_c + F.col("a")) * scales[2]).alias("f2"))
    near = knn(features, "id", ["f0", "f1", "f2"], 5).groupBy("id").agg(F.avg("distance").alias("distance"))
    e = written(e.join(near, "id"), "distances")
    usual: Column = F.lit(1.0)
    if region is not None:
        edges = usual_distance(e, "z", "distance", width, region)
        over = Window.orderBy("edge")  # a row per depth bin
        nxt = edges.select(
            "edge", "usual", F.lead("edge").over(over).alias("e1"), F.lead("usual").over(over).alias("u1"),
            F.lag("edge").over(over).alias("e0"), F.lag("usual").over(over).alias("u0"), F.min("edge").over(Window.partitionBy()).alias("low"),
            F.max("edge").over(Window.partitionBy()).alias("high"),
        )
        slope = F.coalesce((F.col("u1") - F.col("usual")) / (F.col("e1") - F.col("edge")), (F.col("usual") - F.col("u0")) / (F.col("edge") - F.col("e0")), F.lit(0.0))
        lines = nxt.select(F.round((F.col("edge") - F.col("low")) / width).cast("long").alias("k"), "edge", "usual", slope.alias("slope"), "low", "high")
        box = lines.agg(F.min("low").alias("low"), F.max("k").alias("top")).first()
        if box.low is not None:
            e = e.withColumn("k", F.least(F.floor((F.col("z") - box.low) / width), F.lit(box.top)).cast("long")).join(F.broadcast(lines.drop("low", "high")), "k")
            usual = F.col("usual") + F.col("slope") * (F.col("z") - F.col("edge"))
    score = F.log("distance") - F.log(usual) - F.log(scales[2] * F.log("a"))
    closest = F.when(F.col("distance") == 0, float("-inf")).otherwise(score)
    e = e.withColumn("score", F.when((usual > 0) & (F.col("a") > 1), closest))
    e = written(e.select("id", "distance", "score"), "scores")
    limit = e.agg(F.percentile("score", F.lit(percent / 100)).alias("limit"))
    kept = F.coalesce(F.col("score") <= F.col("limit"), F.lit(False))
    return e.crossJoin(F.broadcast(limit)).select(F.col("id").alias(key), "distance", "score", kept.alias("kept"))  # one row
