"""Grouped operators: templates, counts, robust scales, rasters and unit statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

NOISE = -1


def sample_per_group(df: DataFrame, key: str, row_id: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows per group, by an arithmetic hash of the id, so the choice doesn't depend on partitions."""
    h = F.pmod((F.col(row_id) + seed) * 2654435761, F.lit(2147483647))
    w = Window.partitionBy(key).orderBy(h, row_id)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def templates(df: DataFrame, unit: str, snippet: str, reducer: str = "median", least: int = 1) -> DataFrame:
    """(unit, t, v, n): element-wise median or mean of each unit's snippets; noise has none."""
    long = df.where(F.col(unit) > NOISE).select(unit, F.posexplode(snippet).alias("t", "x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    f = F.median("x") if reducer == "median" else F.avg("x")
    return long.groupBy(unit, F.col("t").cast("long").alias("t")).agg(f.alias("v"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def template_arrays(long: DataFrame, unit: str) -> DataFrame:
    """templates() as one array per unit."""
    return long.groupBy(unit).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda s: s["v"]).alias("template"))


def template_snr(long: DataFrame, unit: str) -> DataFrame:
    """Peak-to-peak of the template times the root of its count."""
    return long.groupBy(unit).agg((F.max("v") - F.min("v")).alias("ptp"), F.max("n").alias("n")).withColumn("snr", F.col("ptp") * F.sqrt("n"))


def counts_with_zeros(df: DataFrame, label: str, size: int) -> DataFrame:
    """(label, n) for labels 0 to size - 1."""
    spine = df.sparkSession.range(size).select(F.col("id").alias(label))
    n = df.where(F.col(label) > NOISE).groupBy(F.col(label).cast("long").alias(label)).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(n, label, "left").select(label, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def mad(df: DataFrame, keys: list[str], value: str, scale: float = 1.0, centre: str = "median") -> DataFrame:
    """Median absolute deviation from the median (or the mean) per group, times ``scale``."""
    mid = df.groupBy(*keys).agg((F.avg if centre == "mean" else F.median)(value).alias("centre"))
    return df.join(mid, keys).groupBy(*keys).agg((F.median(F.abs(F.col(value) - F.col("centre"))) * scale).alias("mad"))


def chunked_rms(df: DataFrame, key: str, t: str, value: str, width: int) -> DataFrame:
    """Median over time chunks of the chunk's root mean square."""
    part = df.groupBy(key, F.floor(F.col(t) / width).alias("chunk")).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    return part.groupBy(key).agg(F.median("rms").alias("rms"), F.count(F.lit(1)).alias("chunks"))


def standardise(df: DataFrame, keys: list[str], value: str, least_sd: float = 0.1) -> DataFrame:
    """z scores per group from one aggregation; groups of a spread below ``least_sd`` give 0."""
    s = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.join(s, keys).withColumn("z", F.when(F.col("_s") < least_sd, 0.0).otherwise((F.col(value) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def unit_statistics(df: DataFrame, unit: str, t: str, amplitude: str) -> DataFrame:
    """Count, rate per second over the whole recording, median amplitude, and contiguity of labels."""
    total = df.agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    out = df.where(F.col(unit) > NOISE).groupBy(unit).agg(F.count(F.lit(1)).alias("n"), F.median(amplitude).alias("median_amplitude"))
    return out.crossJoin(F.broadcast(total)).withColumn("rate", F.col("n") / ((F.col("_b") - F.col("_a")) / 1e6)).drop("_a", "_b")


def raster(df: DataFrame, depth: Column, t: Column, amplitude: str) -> DataFrame:
    """(d, t, total, n, mean) over whole bins of depth and time."""
    g = df.groupBy(F.floor(depth).cast("long").alias("d"), F.floor(t).cast("long").alias("t"))
    return g.agg(F.sum(amplitude).alias("total"), F.count(F.lit(1)).alias("n"), F.avg(amplitude).alias("mean"))


def smooth_raster(cells: DataFrame, sigma: float, reach: int) -> DataFrame:
    """Gaussian smoothing of ``mean`` along depth over the cells that exist."""
    other = cells.select(F.col("t").alias("t"), F.explode(F.sequence(F.col("d") - reach, F.col("d") + reach)).alias("d0"), F.col("d").alias("d1"), F.col("mean").alias("v"))
    w = F.exp(-F.pow(F.col("d1") - F.col("d0"), 2) / (2 * sigma * sigma))
    near = other.withColumn("w", w).groupBy("t", F.col("d0").alias("d")).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("smooth"))
    return cells.join(near, ["t", "d"])


def weighted_centroids(df: DataFrame, key: str, weight: str, xs: list[str]) -> DataFrame:
    return df.groupBy(key).agg(*[(F.sum(F.col(weight) * F.col(x)) / F.sum(weight)).alias(f"{x}_centre") for x in xs], F.sum(weight).alias("mass"))


def channel_snr(df: DataFrame, unit: str, channel: str, value: str, depth: str) -> tuple[DataFrame, DataFrame]:
    """Per unit and channel mean * sqrt(count); per unit the centre of mass in depth and the main channel."""
    per = df.groupBy(unit, channel).agg((F.avg(value) * F.sqrt(F.count(F.lit(1)))).alias("snr"), F.first(depth).alias(depth))
    com = per.groupBy(unit).agg((F.sum(F.col("snr") * F.col(depth)) / F.sum("snr")).alias("centre"), F.max_by(channel, F.struct("snr", channel)).alias("main"))
    return per, com


def clean_small_units(df: DataFrame, unit: str, least: int) -> DataFrame:
    """Rows of units with fewer than ``least`` become noise; a unit's size is an aggregate, so no unit gathers in one task."""
    big = df.where(F.col(unit) > NOISE).groupBy(unit).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(unit, F.lit(True).alias("_keep"))
    return df.join(big, unit, "left").withColumn("label", F.when(F.col("_keep"), F.col(unit)).otherwise(F.lit(NOISE)).cast("long")).drop("_keep")


def superres_labels(df: DataFrame, unit: str, depth: str, bin_: float, least: int) -> DataFrame:
    """Sub-units by depth bins about the unit's median: floor((z - median + bin / 2) / bin); thin bins are noise."""
    mid = df.groupBy(unit).agg(F.median(depth).alias("_m"))
    sub = df.join(mid, unit).withColumn("sub", F.floor((F.col(depth) - F.col("_m") + bin_ / 2) / bin_).cast("long")).drop("_m")
    n = sub.groupBy(unit, "sub").agg(F.count(F.lit(1)).alias("_n"))
    return sub.join(n, [unit, "sub"]).withColumn("sub", F.when(F.col("_n") >= least, F.col("sub"))).drop("_n")


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """Kruskal-Wallis H with mid-ranks, without tie correction: ranks come from counts per value, not from one sorted task."""
    per = df.groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    # Ranks over distinct values: bucket totals first, then a window within buckets.
    cut = per.withColumn("b", F.floor(F.col(value) / 10.0))
    below = cut.groupBy("b").agg(F.sum("c").alias("t")).withColumn("base", F.coalesce(F.sum("t").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("b").orderBy(value)
    ranks = cut.join(below, "b").withColumn("rank", F.col("base") + F.sum("c").over(w) - (F.col("c") - 1) / 2).select(value, "rank")
    g = df.join(ranks, value).groupBy(group).agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("m"))
    n = F.sum("m")
    return g.agg((12 / (n * (n + 1)) * F.sum(F.col("r") * F.col("r") / F.col("m")) - 3 * (n + 1)).alias("h"), F.count(F.lit(1)).alias("groups"), n.alias("n"))


def iqr_filter(df: DataFrame, columns: list[str], k: float = 1.5) -> DataFrame:
    """Rows within k interquartile ranges of the quartiles on every column; each column has its own fences."""
    q = df.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(f"_{c}") for c in columns])
    on = F.lit(True)
    for c in columns:
        lo, hi = F.col(f"_{c}")[0], F.col(f"_{c}")[1]
        on = on & F.col(c).between(lo - k * (hi - lo), hi + k * (hi - lo))
    return df.crossJoin(F.broadcast(q)).where(on).drop(*[f"_{c}" for c in columns])  # one row of fences
