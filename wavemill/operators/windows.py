"""Sequential operators as window plans.

Windows run inside a key. Where a rule reaches a bounded time, ``halo`` cuts a key's rows into time
chunks with margins first, so that one long series is many partitions of work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window, WindowSpec


def halo(df: DataFrame, t: str, width: int, margin: int) -> DataFrame:
    """Each row once in its own chunk (core) and once in any neighbour that it is within ``margin`` of."""
    c = F.floor(F.col(t) / width)
    low, high = F.floor((F.col(t) - margin) / width), F.floor((F.col(t) + margin) / width)
    return df.withColumn("chunk", F.explode(F.sequence(low, high))).withColumn("core", F.col("chunk") == c)


def local_extrema(df: DataFrame, key: str, order: list[str], value: str, reach: int = 5, threshold: float | None = None, sign: str = "pos", ties: str = "strict") -> DataFrame:
    """Rows whose value exceeds ``reach`` rows on either side; series ends are no extrema. ``ties='first'`` lets the first of equals pass."""
    v = {"pos": F.col(value), "neg": -F.col(value), "both": F.abs(value)}[sign]
    w = Window.partitionBy(key).orderBy(*order)
    before, after = F.max("_v").over(w.rowsBetween(-reach, -1)), F.max("_v").over(w.rowsBetween(1, reach))
    out = df.withColumn("_v", v).withColumn("_b", before).withColumn("_a", after).withColumn("_end", F.lead("_v").over(w).isNull() | F.lag("_v").over(w).isNull())
    later = F.col("_v") > F.col("_a") if ties == "strict" else F.col("_v") >= F.col("_a")
    out = out.where((F.col("_v") > F.col("_b")) & later & ~F.col("_end"))
    if threshold is not None:
        out = out.where(F.col("_v") > threshold)
    return out.drop("_v", "_b", "_a", "_end")


def suppress_in_time(df: DataFrame, key: str, t: str, energy: str, radius: int, chunk: int | None = None) -> DataFrame:
    """Keeps rows whose energy is the largest within ``radius`` of time; equals stay."""
    if chunk is None:
        w = Window.partitionBy(key).orderBy(t).rangeBetween(-radius, radius)
        return df.withColumn("_m", F.max(energy).over(w)).where(F.col(energy) >= F.col("_m") - 1e-8).drop("_m")
    cut = halo(df, t, chunk, radius)
    w = Window.partitionBy(key, "chunk").orderBy(t).rangeBetween(-radius, radius)
    return cut.withColumn("_m", F.max(energy).over(w)).where(F.col("core") & (F.col(energy) >= F.col("_m") - 1e-8)).drop("_m", "chunk", "core")


def rolling_range(df: DataFrame, key: str, order: list[str], value: str, half: int = 12) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-half, half)
    return df.withColumn("rolling_range", F.max(value).over(w) - F.min(value).over(w))


def islands(df: DataFrame, key: str | None, n: str) -> DataFrame:
    """Runs of consecutive integers: (key,) first, last, size."""
    keys = [key] if key else []
    rows = df.select(*keys, n).distinct()
    w = Window.partitionBy(*keys).orderBy(n)
    runs = rows.withColumn("_g", F.col(n) - F.row_number().over(w))
    return runs.groupBy(*keys, "_g").agg(F.min(n).alias("first"), F.max(n).alias("last"), F.count(F.lit(1)).alias("size")).drop("_g")


def sessions(df: DataFrame, key: str, order: list[str], t: str, gap: int) -> DataFrame:
    """Adds the number of the run of rows that follow each other within ``gap``."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.coalesce((F.col(t) - F.lag(t).over(w) > gap).cast("long"), F.lit(0))
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).drop("_new")


def intervals(df: DataFrame, key: str, order: list[str], t: str) -> DataFrame:
    return df.withColumn("interval", F.col(t) - F.lag(t).over(Window.partitionBy(key).orderBy(*order)))


def refractory_rates(df: DataFrame, key: str, order: list[str], t: str, dead: int, bands: tuple[float, float, float] = (0.01, 0.05, 0.75)) -> DataFrame:
    """Violations per unit and the policy its rate asks for: keep, drop_violations, split or discard."""
    d = intervals(df, key, order, t)
    out = d.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("interval") < dead, 1)).alias("violations")).withColumn("rate", F.col("violations") / F.col("n"))
    low, mid, high = bands
    policy = F.when(F.col("rate") < low, "keep").when(F.col("rate") < mid, "drop_violations").when(F.col("rate") < high, "split").otherwise("discard")
    return out.withColumn("policy", policy)


def dense_labels(df: DataFrame, label: str, to: str = "dense", noise: int = -1) -> DataFrame:
    """Labels renumbered 0.. in order; noise stays. Only the distinct labels are ranked, then joined back."""
    kinds = df.where(F.col(label) > noise).select(label).distinct()
    ranks = kinds.withColumn(to, (F.row_number().over(Window.orderBy(label)) - 1).cast("long"))
    return df.join(ranks, label, "left").withColumn(to, F.coalesce(to, F.lit(noise).cast("long")))


def rank_by_depth(units: DataFrame, unit: str, depth: str, to: str = "rank") -> DataFrame:
    """Units ranked by falling depth, the unit's name breaking ties; one row per unit is ranked."""
    return units.withColumn(to, (F.row_number().over(Window.orderBy(F.col(depth).desc(), unit)) - 1).cast("long"))


def second_difference(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("second_difference", F.lag(value).over(w) - 2 * F.col(value) + F.lead(value).over(w))


def trend(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    return df.groupBy(key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("n"))


def ks_counts(df: DataFrame, bin_: str, a: str, b: str, partition: list[str] | None = None) -> DataFrame:
    """Largest difference of two cumulated shares over bins, scaled by sqrt of their mean count."""
    keys = partition or []
    w = Window.partitionBy(*keys).orderBy(bin_)
    run = df.withColumn("_a", F.sum(a).over(w)).withColumn("_b", F.sum(b).over(w))
    tot = run.groupBy(*keys).agg(F.sum(a).alias("_ta"), F.sum(b).alias("_tb"))
    both = run.join(tot, keys) if keys else run.crossJoin(tot)  # one row of totals
    return both.groupBy(*keys).agg((F.max(F.abs(F.col("_a") / F.col("_ta") - F.col("_b") / F.col("_tb"))) * F.sqrt(F.max(F.col("_ta") + F.col("_tb")) / 2)).alias("ks"))


def sorted_check(df: DataFrame, order: WindowSpec, t: str) -> DataFrame:
    return df.select((F.col(t) >= F.lag(t).over(order)).alias("ok")).agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("is_sorted"))


def chatterjee_xi(df: DataFrame, key: str, x: str, y: str, tie: str) -> DataFrame:
    """Rank dependence of y on x per key: 1 - 3 * sum |r(i+1) - r(i)| / (n^2 - 1)."""
    wy, wx = Window.partitionBy(key).orderBy(y, tie), Window.partitionBy(key).orderBy(x, tie)
    r = df.select(key, x, tie, F.row_number().over(wy).alias("_r"))
    d = r.withColumn("_d", F.abs(F.lead("_r").over(wx) - F.col("_r")))
    n = F.count(F.lit(1))
    return d.groupBy(key).agg(n.alias("n"), (1 - 3 * F.sum("_d") / (n * n - 1)).alias("xi")).where("n > 1")


def ramp(height: Column, low: float, high: float) -> Column:
    """Linear from 0 at low to 1 at high, flat outside."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (height - low) / (high - low)))


def suppress_space_time(df: DataFrame, id_: str, t: str, place: list[str], v: str, window: float, radius: float) -> DataFrame:
    """Rows without a larger value within ``window`` in time and ``radius`` in space; of equal values the earlier stays, then the lesser id.

    Rows meet on buckets of time and of the first coordinate, so a busy channel is many tasks.
    """
    b = df.select(F.col(id_).alias("_i"), F.col(t).alias("_t"), F.col(v).alias("_v"), *[F.col(c).alias(f"_{c}") for c in place])
    cell = lambda c, w: F.floor(F.col(c) / w)
    near = lambda c, w: F.explode(F.array(*[F.floor(F.col(c) / w) + k for k in (-1, 0, 1)]))
    left = df.withColumns({"_bt": cell(t, window), "_bx": cell(place[0], radius)})
    right = b.withColumn("_nt", near("_t", window)).withColumn("_nx", near(f"_{place[0]}", radius))
    d2 = sum((F.pow(F.col(c) - F.col(f"_{c}"), 2) for c in place), F.lit(0.0))
    beats = (F.col("_v") > F.col(v)) | ((F.col("_v") == F.col(v)) & ((F.col("_t") < F.col(t)) | ((F.col("_t") == F.col(t)) & (F.col("_i") < F.col(id_)))))
    on = (F.col("_bt") == F.col("_nt")) & (F.col("_bx") == F.col("_nx")) & (F.abs(F.col(t) - F.col("_t")) <= window) & (d2 <= radius * radius) & beats
    return left.join(right, on, "left_anti").drop("_bt", "_bx")


def event_windows(chunks: DataFrame, events: DataFrame, t: str, size: int, before: int, after: int, key: list[str] = ()) -> DataFrame:
    """events with ``window``: samples t - before to t + after - 1 of a recording, null beyond its ends.

    ``chunks`` has (keys, chunk, samples), chunk c holding samples c * size on. An event fetches the chunks that its window
    crosses by an equi-join, so a recording is never gathered.
    """
    spans = F.explode(F.sequence(F.floor((F.col(t) - before) / size), F.floor((F.col(t) + after - 1) / size)))
    ask = events.withColumn("_row", F.monotonically_increasing_id()).withColumn("chunk", spans)
    got = ask.join(chunks.select(*key, "chunk", "samples"), [*key, "chunk"], "left")
    parts = F.map_from_entries(F.collect_list(F.struct("chunk", "samples")))
    rows = got.groupBy("_row", *[F.col(c) for c in events.columns]).agg(parts.alias("_parts"))
    at = lambda i: F.get(F.element_at("_parts", F.floor(i / size)), F.pmod(i, F.lit(size)).cast("int"))
    return rows.withColumn("window", F.transform(F.sequence(F.col(t) - before, F.col(t) + after - 1), at)).drop("_row", "_parts")


def halving_ks(df: DataFrame, bin_: str, a: str, b: str) -> DataFrame:
    """The largest ks_counts over the first n, n / 2, n / 4, ... bins (4 at least), and the prefix that has it. One row per bin is ranked."""
    ranked = df.withColumn("_p", F.row_number().over(Window.orderBy(bin_))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    sizes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: F.floor(F.col("_n") / F.pow(F.lit(2), i)).cast("long")), lambda s: s >= 4)
    parts = ranked.withColumn("prefix", F.explode(F.array_distinct(F.array_union(sizes, F.array("_n"))))).where("_p <= prefix")
    out = ks_counts(parts, bin_, a, b, ["prefix"])
    return out.orderBy(F.col("ks").desc(), F.col("prefix").desc()).limit(1)
