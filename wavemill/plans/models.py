"""Queries whose kernels are fitted or sequential; they have no SQL twin and are tested on known answers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from wavemill import catalog as C
from wavemill.operators import deconv as Q, density as N, filters as L, kernels as K, latent as H, motion as M, splits as D
from wavemill.operators.windows import halo


@C.register()
def dip_test(spark, sf) -> DataFrame:
    return D.dip_test(C.stream(spark, sf), "ch", "v")


@C.register()
def split_by_dip(spark, sf) -> DataFrame:
    """Parts of each unit's amplitudes."""
    return D.split(C.stream(spark, sf), ["unit"], "v").groupBy("unit", "part").agg(F.count("*").alias("n"))


@C.register()
def coordinate_splits(spark, sf) -> DataFrame:
    """Parts that all snippets' values split into, place by place."""
    values = C.snippets(spark, sf).select(F.posexplode("x").alias("place", "v"))
    return D.parts(values, ["place"], "v").select("place", C.r6("low"), C.r6("high"), "size")


@C.register()
def split_units_until_stable(spark, sf) -> DataFrame:
    """Units of snippets split along amplitude, place of the peak and centre of mass in turn until no part splits."""
    size = F.transform("x", lambda v: F.abs(v))
    total = F.aggregate(size, F.lit(0.0), lambda s, v: s + v)
    centre = F.aggregate(F.transform(size, lambda v, i: v * i), F.lit(0.0), lambda s, v: s + v) / total
    rows = C.snippets(spark, sf).select("vec_id", "unit", F.array_max("x").alias("high"), F.array_min("x").alias("low"), centre.alias("centre"))
    return D.split_until_stable(rows, "unit", ["high", "low", "centre"]).select("vec_id", "unit", "part")


@C.register()
def density_clusters(spark, sf) -> DataFrame:
    """Snippets by place of their mean energy and log amplitude."""
    energy = F.transform("x", lambda v: v * v)
    total = F.aggregate(energy, F.lit(0.0), lambda s, v: s + v)
    centre = F.aggregate(F.transform(energy, lambda v, i: v * i), F.lit(0.0), lambda s, v: s + v) / total
    rows = C.snippets(spark, sf).select("vec_id", centre.alias("z"), (50 * F.log(5 + F.array_max("x") - F.array_min("x"))).alias("size"))
    return N.cluster(rows, "vec_id", ["z", "size"], reach=4.0, samples=10, least=25).select("vec_id", "cluster", C.r6("strength"))


@C.register()
def isotonic_fit(spark, sf) -> DataFrame:
    monthly = C.stream(spark, sf).groupBy("unit", F.floor(F.col("t") / (30 * C.DAY)).alias("month")).agg(F.avg("v").alias("mean"))
    return K.isotonic_fit(monthly, "unit", "month", "mean")


@C.register()
def enforce_refractory(spark, sf) -> DataFrame:
    return K.enforce_refractory(C.stream(spark, sf).select("event_id", "unit", "t", "v"), "unit", "t", "v", "event_id", 6 * C.HOUR)


@C.register()
def temporal_pca(spark, sf) -> DataFrame:
    s = C.snippets(spark, sf)
    mean, axes, _ = K.principal_axes(s, "x", 3)
    return K.project(s, "x", mean, axes).select("vec_id", "unit", F.transform("scores", lambda v: F.round(v, 6)).alias("scores"))


@C.register()
def latent_imputation(spark, sf) -> DataFrame:
    """Each snippet with every seventh value hidden, from another place on by id: root mean square of what is hidden and of its error."""
    s = C.snippets(spark, sf)
    hide = lambda i: (i + F.col("vec_id")) % 7 == 0
    s = s.withColumn("part", F.transform("x", lambda v, i: F.when(~hide(i), v)))
    got = H.fill(s, "part", H.fit(s, "part", 4, rounds=15))
    rms = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda t, v: t + v * v) / F.size(a))
    hidden = F.filter(F.transform("x", lambda v, i: F.when(hide(i), v)), lambda v: v.isNotNull())
    error = F.filter(F.transform("x", lambda v, i: F.when(hide(i), v - F.col("filled")[i])), lambda v: v.isNotNull())
    return got.select("vec_id", "unit", C.r6(rms(hidden), "hidden"), C.r6(rms(error), "error"))


@C.register()
def linkage_merge(spark, sf) -> DataFrame:
    pairs = C.template_shift_distance(spark, sf).toPandas()  # a row per pair of units
    units = sorted(set(pairs.a) | set(pairs.b))
    d = np.zeros((len(units), len(units)))
    for a, b, x in pairs.itertuples(index=False):
        d[units.index(a), units.index(b)] = d[units.index(b), units.index(a)] = x
    labels = K.linkage_merge(d, float(np.quantile(pairs.distance, 0.2)))
    return spark.createDataFrame([(int(u), int(v)) for u, v in zip(units, labels, strict=True)], "unit long, merged long")


@C.register()
def matching_pursuit(spark, sf) -> DataFrame:
    shape = np.array([[1.0, 3.0, 1.0], [2.0, 2.0, 2.0]]) * 20
    return K.pursue(C.stream(spark, sf), "unit", ["t", "event_id"], "v", shape, 2000.0)


def _hourly(spark, sf) -> DataFrame:
    """(ch, n, x, late): events per hour and channel from the first event's hour on, with 0 where there is none."""
    e = C.stream(spark, sf).select("ch", F.floor(F.col("t") / C.HOUR).alias("h"))
    low, high = e.agg(F.min("h"), F.max("h")).first()
    grid = spark.range(high - low + 1).withColumnRenamed("id", "n").crossJoin(F.broadcast(e.select("ch").distinct()))  # few channels
    counts = e.groupBy("ch", (F.col("h") - low).alias("n")).agg(F.count(F.lit(1)).cast("double").alias("x"))
    return grid.join(counts, ["ch", "n"], "left").select("ch", "n", F.coalesce("x", F.lit(0.0)).alias("x"), (F.pmod(F.crc32(F.col("ch").cast("binary")), F.lit(12)) / 12).alias("late"))


@C.register()
def zero_phase_filter(spark, sf) -> DataFrame:
    """Hourly counts between one wave in ten days and one in eight hours."""
    band = L.butterworth(3, "bandpass", 24.0, 0.1, 3.0)
    return L.zero_phase(_hourly(spark, sf), ["ch"], "n", "x", band).select("ch", "n", C.r6("filtered"))


@C.register()
def phase_shifted(spark, sf) -> DataFrame:
    """Hourly counts of channels that are read one after the other, moved to a common time."""
    return L.phase_shift(_hourly(spark, sf), ["ch"], "n", "x", "late").select("ch", "n", C.r6("shifted"))


def _frames(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(frames (n, x): all channels' hourly counts in standard deviations; templates (unit, x): a channel's mean course from four
    hours before its count stands 2.5 deviations out to seven hours after, on all channels)."""
    hours = _hourly(spark, sf)
    level = hours.groupBy("ch").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    names = level.select("ch", F.row_number().over(Window.orderBy("ch")).alias("unit"))  # few channels
    z = F.when(F.col("sd") > 0, (F.col("x") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    hours = hours.join(F.broadcast(level), "ch").join(F.broadcast(names), "ch").select("unit", "n", z.alias("z"))
    row = F.array_sort(F.collect_list(F.struct("unit", "z")))
    frames = hours.groupBy("n").agg(F.transform(row, lambda r: r.z).alias("x"))
    starts = hours.where("z >= 2.5").select("unit", "n", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k"))
    around = starts.select("unit", (F.col("n") - 4 + F.col("k")).alias("n"), "k").join(frames, "n")
    mean = around.select("unit", "k", F.posexplode("x").alias("c", "v")).groupBy("unit", "k", "c").agg(F.avg("v").alias("v"))
    lines = mean.groupBy("unit", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda r: r.v).alias("v"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda r: r.v)
    return frames, lines.groupBy("unit").agg(whole.alias("x")).where(F.size("x") == 12)


@C.register()
def template_pursuit(spark, sf) -> DataFrame:
    """Courses of the channels' bursts found in the hourly counts of all channels, in chunks of 50 days."""
    frames, templates = _frames(spark, sf)
    got = Q.pursue(frames, templates, "n", "x", 4.0, chunk=1200, rank=3, visible=0.5, ridge=0.1, spread=1.0)
    return got.select("start", "unit", "shift", C.r6("scale"), C.r6("gain"), "round")


@C.register()
def rigid_registration(spark, sf) -> DataFrame:
    lags = M.pair_lags(C.cells(spark, sf), 3, span=8)
    return M.solve_displacement(lags).select("t", F.round("displacement", 6).alias("displacement"))


@C.register()
def drift_corrected_depth(spark, sf) -> DataFrame:
    motion = M.solve_displacement(M.pair_lags(C.cells(spark, sf), 3, span=8)).select((F.col("t") * 7 * C.DAY).alias("t_knot"), "displacement")
    return M.correct_depths(C.stream(spark, sf).select("event_id", "t", "v"), motion, "t", "v").select("event_id", F.round("corrected", 6).alias("corrected"))


@C.register()
def robust_registration(spark, sf) -> DataFrame:
    """As rigid_registration, without pairs whose residual stands out, in five fits."""
    lags = M.pair_lags(C.cells(spark, sf), 3, span=8)
    return M.solve_displacement(lags, sigma=2.0, smooth=0.1).select("t", F.round("displacement", 6).alias("displacement"))


def _windows(spark, sf, n: int = 3):
    """(cells, depth windows, their centres) of the raster."""
    cells = C.cells(spark, sf)
    low, high = cells.agg(F.min("d"), F.max("d")).first()
    step = (high - low) / n
    return cells, M.depth_windows(spark, float(low), float(high), n, step / 2), [low + (k + 0.5) * step for k in range(n)]


@C.register()
def nonrigid_registration(spark, sf) -> DataFrame:
    cells, windows, _ = _windows(spark, sf)
    motion = M.register_windows(M.windowed_lags(cells, windows, 3, 8))
    return motion.select("t", "w", F.round("displacement", 6).alias("displacement"))


@C.register()
def nonrigid_corrected_depth(spark, sf) -> DataFrame:
    cells, windows, centres = _windows(spark, sf)
    motion = M.register_windows(M.windowed_lags(cells, windows, 3, 8))
    at = M.displacement_at(C.stream(spark, sf).select("event_id", "t", "v"), motion, centres, "t", "v", width=7 * C.DAY)
    return at.select("event_id", F.round(F.col("v") - F.col("displacement"), 6).alias("corrected"))


@C.register(
    f"""WITH {C.RASTER}, j AS (SELECT a.t AS i, b.t AS j, CAST(k AS BIGINT) AS lag, sum(a.mean * b.mean) AS s FROM c a JOIN range(-3, 4) r(k) ON true JOIN c b ON b.d - k = a.d AND a.t < b.t AND b.t - a.t <= 8 GROUP BY ALL),
p AS (SELECT t, sum(mean * mean) AS p FROM c GROUP BY t), q AS (SELECT i, j, lag, round(s / sqrt(x.p * y.p), 9) AS c FROM j JOIN p x ON x.t = i JOIN p y ON y.t = j),
z AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY c DESC, abs(lag), lag DESC) AS r FROM q) SELECT i, j, lag, round(c, 6) AS c FROM z WHERE r = 1"""
)
def pairwise_displacement(spark, sf) -> DataFrame:
    return M.pair_lags(C.cells(spark, sf), 3, span=8).select("i", "j", "lag", F.round("c", 6).alias("c"))


@C.register(f"WITH {C.EV} SELECT CAST(floor(t / {C.DAY}) AS BIGINT) AS chunk, count(*) AS n FROM e GROUP BY 1")
def halo_chunks(spark, sf) -> DataFrame:
    cut = halo(C.stream(spark, sf), "t", C.DAY, 2 * C.HOUR)
    return cut.where("core").groupBy(F.col("chunk").cast("long").alias("chunk")).agg(F.count("*").alias("n"))
