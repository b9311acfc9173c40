"""Registration of drifting rasters: lags by windows of cross-products, displacement by a small solve, correction by interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wavemill.operators.joins import interpolate
from wavemill.operators.order import written
from wavemill.operators.solve import differences, solve


def pair_lags(cells: DataFrame, reach: int, span: int | None = None, keys: list[str] = ()) -> DataFrame:
    """(keys, i, j, lag, c): normalised cross-correlation of depth profiles (keys, t, d, mean) of every pair of time bins up to ``span`` apart, at its best lag.

    Cells meet on the depth they share after a shift, so only overlapping profiles are compared.
    """
    keys = list(keys)
    a = cells.select(*keys, F.col("t").alias("i"), F.col("d").alias("da"), F.col("mean").alias("va"))
    b = cells.select(*keys, F.col("t").alias("j"), F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), (F.col("d") - k).alias("da")) for k in range(-reach, reach + 1)])).alias("s"), F.col("mean").alias("vb")).select(*keys, "j", "s.*", "vb")
    pairs = a.join(b, [*keys, "da"]).where("i < j")
    if span is not None:
        pairs = pairs.where(F.col("j") - F.col("i") <= span)
    n = cells.groupBy(*keys, "t").agg(F.sum(F.col("mean") * F.col("mean")).alias("p"))
    c = pairs.groupBy(*keys, "i", "j", "lag").agg(F.sum(F.col("va") * F.col("vb")).alias("s"))
    c = c.join(n.select(*keys, F.col("t").alias("i"), F.col("p").alias("pi")), [*keys, "i"]).join(n.select(*keys, F.col("t").alias("j"), F.col("p").alias("pj")), [*keys, "j"]).withColumn("c", F.col("s") / F.sqrt(F.col("pi") * F.col("pj")))
    best = c.groupBy(*keys, "i", "j").agg(F.max(F.struct(F.round("c", 9).alias("c"), (-F.abs("lag")).alias("near"), F.col("lag"))).alias("b"))
    return best.select(*keys, "i", "j", F.col("b.lag").cast("long").alias("lag"), F.col("b.c").alias("c"))


def _span(pairs: DataFrame) -> tuple[int, int, int] | None:
    """(first bin, last bin, largest distance of a pair's bins), or None without pairs."""
    r = pairs.agg(F.min(F.least("i", "j")), F.max(F.greatest("i", "j")), F.max(F.abs(F.col("j") - F.col("i")))).first()
    return None if r[0] is None else (r[0], r[1], max(1, r[2]))


def solve_displacement(pairs: DataFrame, least: float = 0.0, *, sigma: float | None = None, rounds: int = 5, smooth: float = 0.0) -> DataFrame:
    """(t, displacement): least squares of c * (p(j) - p(i) - lag), centred, over pairs of c above ``least``.

    With ``sigma``, pairs whose weighted residual is more than ``sigma`` standard deviations from the mean are left out of
    the next fit, in ``rounds`` fits, each judging all pairs anew. ``smooth`` weighs squared steps between neighbouring bins.
    """
    rows = written(pairs.where(F.col("c") > least).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("lag").cast("double").alias("lag"), "c"), "pairs")
    spark, bounds = pairs.sparkSession, _span(rows)
    if bounds is None:
        return spark.createDataFrame([], "t long, displacement double")
    first, last, m = bounds
    kept = rows
    for k in range(rounds if sigma else 1):
        entries, right = differences(kept, F.col("i") - first, F.col("j") - first, F.col("lag"), F.col("c") * F.col("c"))
        if smooth:
            steps = spark.range(last - first)
            entries = entries.unionByName(differences(steps, F.col("id"), F.col("id") + 1, F.lit(0.0), F.lit(float(smooth)))[0])
        x = written(solve(entries, right, m).select((F.col("i") + first).alias("t"), "x"), "displacement")
        if not sigma or k == rounds - 1:
            break
        at = lambda t, n: x.select(F.col("t").alias(t), F.col("x").alias(n))  # noqa: B023, E731  used within the round
        r = rows.join(at("i", "_xi"), "i", "left").join(at("j", "_xj"), "j", "left").withColumn("_r", F.col("c") * (F.coalesce("_xj", F.lit(0.0)) - F.coalesce("_xi", F.lit(0.0)) - F.col("lag")))
        r = written(r.select("i", "j", "lag", "c", "_r"), "residuals")
        mean, sd = r.agg(F.avg("_r"), F.stddev_pop("_r")).first()
        kept = r.where(F.abs(F.col("_r") - mean) <= sigma * sd).drop("_r") if sd else rows
    centre = x.agg(F.avg("x").alias("_m"))
    return x.crossJoin(F.broadcast(centre)).select("t", (F.col("x") - F.col("_m")).alias("displacement"))  # one row


def windowed_lags(cells: DataFrame, windows: DataFrame, reach: int, span: int) -> DataFrame:
    """(w, i, j, lag, c): pair_lags of the raster (t, d, mean) seen through each depth window (w, d, weight), of few windows."""
    seen = cells.join(windows, "d").select("w", "t", "d", (F.col("mean") * F.col("weight")).alias("mean")).where("mean <> 0")
    return pair_lags(seen, reach, span, ["w"])


def register_windows(lags: DataFrame, *, least: float = 0.0, time_prior: float = 1.0, space_prior: float = 1.0, before: DataFrame | None = None) -> DataFrame:
    """(t, w, displacement) from lags (w, i, j, lag, c) of depth windows 0, 1, 2 ..: all windows and times in one system.

    The objective is the sum of c^2 * (p(w, j) - p(w, i) - lag)^2 over pairs of c >= ``least``, time_prior / 4 times squared steps in
    time, and space_prior / 8 times squared differences of a step between neighbouring windows. ``before`` has displacements
    (t, w, displacement) of earlier bins: they stay, pairs with one end there pull the other, and only later bins are solved for,
    so a recording can be registered block by block. Without it each window is centred.
    """
    spark = lags.sparkSession
    rows = lags.where(F.col("c") >= least).select(F.col("w").cast("long").alias("w"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("lag").cast("double").alias("lag"), (2 * F.col("c") * F.col("c")).alias("u"))
    right_more = None
    if before is not None:
        old = written(before.select(F.col("t").cast("long").alias("t"), F.col("w").cast("long").alias("w"), F.col("displacement").alias("p")), "before")
        end = old.agg(F.max("t")).first()[0]
        rows = rows.where(F.greatest("i", "j") > end)
        # turned so that j is the later end
        turned = rows.select("w", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.when(F.col("i") < F.col("j"), F.col("lag")).otherwise(-F.col("lag")).alias("lag"), "u")
        pull = turned.where(F.col("i") <= end).join(old.select(F.col("t").alias("i"), "w", "p"), ["i", "w"])
        last_known = old.where(F.col("t") == end).select((F.col("t") + 1).alias("j"), "w", F.col("p").alias("to"), F.lit(time_prior / 2).alias("u"))
        right_more = pull.select("j", "w", (F.col("p") + F.col("lag")).alias("to"), "u").unionByName(last_known)
        rows = turned.where(F.col("i") > end)
        right_more = written(right_more, "pull")
    rows = written(rows, "pairs")
    ends = rows.select(F.col("i").alias("t"), "w").unionByName(rows.select(F.col("j").alias("t"), "w"))
    if right_more is not None:
        ends = ends.unionByName(right_more.select(F.col("j").alias("t"), "w"))
    first, last, most = ends.agg(F.min("t"), F.max("t"), F.max("w")).first()
    if first is None:
        return spark.createDataFrame([], "t long, w long, displacement double")
    k, span = most + 1, (rows.agg(F.max(F.abs(F.col("j") - F.col("i")))).first()[0] or 1)
    name = lambda t, w: (F.col(t) - first) * k + (F.col(w) if isinstance(w, str) else w)
    entries, right = differences(rows, name("i", "w"), name("j", "w"), F.col("lag"), F.col("u"))
    bins = spark.range(first, last).select(F.col("id").alias("t"), (F.col("id") + 1).alias("t1"))
    steps = bins.withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(most))))
    entries = entries.unionByName(differences(steps, name("t", "w"), name("t1", "w"), F.lit(0.0), F.lit(time_prior / 2))[0])
    if most and space_prior:
        corner = [("t", "w", 1.0), ("t1", "w", -1.0), ("t", "w1", -1.0), ("t1", "w1", 1.0)]
        mixed = steps.where(F.col("w") < most).withColumn("w1", F.col("w") + 1)
        cells = [F.struct(name(a[0], a[1]).alias("i"), name(b[0], b[1]).alias("j"), F.lit(space_prior / 4 * a[2] * b[2]).alias("a")) for x, a in enumerate(corner) for b in corner[: x + 1]]
        entries = entries.unionByName(mixed.select(F.inline(F.array(*cells))))
    if right_more is not None:
        own = right_more.withColumn("n", name("j", "w"))
        entries = entries.unionByName(own.select(F.col("n").alias("i"), F.col("n").alias("j"), F.col("u").alias("a")))
        right = right.unionByName(own.select(F.col("n").alias("i"), (F.col("u") * F.col("to")).alias("b")))
    m = max(2, span) * k  # pairs of one block or of neighbours
    x = solve(entries, right, int(m)).select((F.floor(F.col("i") / k) + first).alias("t"), (F.col("i") % k).alias("w"), "x")
    if right_more is not None:
        return x.select("t", "w", F.col("x").alias("displacement"))
    x = written(x, "displacement")
    centre = x.groupBy("w").agg(F.avg("x").alias("_m"))
    return x.join(F.broadcast(centre), "w").select("t", "w", (F.col("x") - F.col("_m")).alias("displacement"))  # a row per window


def displacement_at(events: DataFrame, motion: DataFrame, centres: list[float], t: str, depth: str, to: str = "displacement", width: float = 1.0) -> DataFrame:
    """events with the displacement at their time and depth: linear between the middles of time bins (bin k starts at k * width) and
    between the windows' ``centres``, clamped at the ends of both. Null times and depths give null."""
    at = motion.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("w", "displacement"))).alias("p")).select("t", F.col("p.displacement").alias("p"))  # few windows
    ends = at.agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    place = F.col(t) / width - 0.5
    e = events.crossJoin(F.broadcast(ends)).withColumn("_b", F.greatest("_lo", F.least("_hi", F.floor(place))))  # one row
    e = e.withColumn("_f", F.greatest(F.lit(0.0), F.least(F.lit(1.0), place - F.col("_b")))).withColumn("_b1", F.least("_hi", F.col("_b") + 1))
    e = e.join(at.select(F.col("t").alias("_b"), F.col("p").alias("_p0")), "_b", "left").join(at.select(F.col("t").alias("_b1"), F.col("p").alias("_p1")), "_b1", "left")
    both = F.zip_with("_p0", "_p1", lambda a, b: a + F.col("_f") * (b - a))
    e = e.withColumn("_p", both)
    value = F.get("_p", len(centres) - 1)
    for n in range(len(centres) - 2, -1, -1):
        lo, hi = float(centres[n]), float(centres[n + 1])
        part = (F.col(depth) - lo) / (hi - lo)
        value = F.when(F.col(depth) < hi, F.get("_p", n) + F.greatest(part, F.lit(0.0)) * (F.get("_p", n + 1) - F.get("_p", n))).otherwise(value)
    return e.select(*[F.col(f"`{c}`") for c in events.columns if c != to], F.when(F.col(depth).isNotNull() & F.col(t).isNotNull(), value).alias(to))


def correct_depths(events: DataFrame, motion: DataFrame, t: str, depth: str, to: str = "corrected") -> DataFrame:
    """depth less the displacement at the event's time, interpolated between bins and clamped at the ends."""
    out = interpolate(events, motion, t, "t_knot", "displacement", "_p")
    return out.withColumn(to, F.col(depth) - F.col("_p")).drop("_p")


def depth_windows(spark, low: float, high: float, n: int, sigma: float, step: float = 1.0) -> DataFrame:
    """(w, d, weight): gaussian windows over depth, normalised at each depth."""
    grid = spark.range(int((high - low) / step) + 1).select((F.lit(low) + F.col("id") * step).alias("d"))
    win = spark.range(n).select(F.col("id").alias("w"), (F.lit(low) + (F.col("id") + 0.5) * (high - low) / n).alias("centre"))
    raw = grid.crossJoin(F.broadcast(win)).withColumn("g", F.exp(-F.pow(F.col("d") - F.col("centre"), 2) / (2 * sigma * sigma)))
    total = raw.groupBy("d").agg(F.sum("g").alias("s"))
    return raw.join(total, "d").select("w", "d", (F.col("g") / F.col("s")).alias("weight"))
