"""How clean a unit is by its correlogram, and the score from which on its events are clean.

A correlogram is an array of 2 * bins + 1 counts, lag 0 in the middle. Refractory units have few events at small lags; the middle
is compared with the rate at larger ones. Chances are told by their normal deviate ``z``: p = Phi(z), so p < alpha is
z < Phi^-1(alpha), which keeps every step an expression.
"""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, functions as F

from wavemill.operators.joins import band_join
from wavemill.operators.order import numbered, written

LEVELS = 1024  # score levels that one window sums up at once
MIDDLE = 10  # half widths that are tried


def metrics(k: Column, bins: int, compat: bool = False) -> Column:
    """struct(rate, ratio, z) of a correlogram of ``bins`` >= 50 lags either way.

    ``rate`` is the largest mean count of three ranges of lags: the outer half of either side, 11 to 50 before, 11 to 49 after.
    For half widths i of 1 to 10 the middle's mean count without lag 0 and the deviate of its size against a Poisson count of that
    rate are taken; the least of either counts, the ratio in units of ``rate``. Without a rate, z is null (p = 1) and the
    ratio 0 if a middle is empty, else 1. ``compat`` multiplies half a middle's sum by i where its mean is meant.
    """
    if bins < 50:
        raise ValueError("at least 50 lags either way")
    at = lambda lag: F.element_at(k, bins + 1 + lag).cast("double")
    mean = lambda lags: reduce(lambda a, b: a + b, map(at, lags)) / len(lags)
    outer = [*range(-bins + 1, bins // 2 - bins), *range(3 * bins // 2 - bins, bins)]
    rate = F.greatest(mean(outer), mean(range(-50, -10)), mean(range(11, 50)))
    sums, total = [], F.lit(0.0)
    for i in range(1, MIDDLE + 1):
        total = total + at(-i) + at(i)
        sums.append(total)
    means = F.least(*[s / 2 * i if compat else s / (2 * i) for i, s in enumerate(sums, 1)])
    z = F.least(*[(s / 2 - rate * i) / F.sqrt(rate * i) for i, s in enumerate(sums, 1)])
    ratio = F.when(rate > 0, means / rate).otherwise(F.when(means == 0, 0.0).otherwise(1.0))
    return F.struct(rate.alias("rate"), ratio.alias("ratio"), F.when(rate > 0, z).alias("z"))


def cuts(
    events: DataFrame,
    unit: str,
    t: str,
    score: str,
    event_id: str,
    width: float,
    bins: int = 50,
    most: float = 0.2,
    alpha: float = 0.05,
    compat: bool = False,
) -> DataFrame:
    """(unit, cut, n, kept, rate, ratio, z), a row per unit: events are let in from the best score down until the middle of their
    autocorrelogram is both surely thinner than its surroundings (p < ``alpha``) and not below the ratio ``most``; ``cut`` is the
    score at which that happens, the least score if it never does. Figures are those at the cut.

    A pair of events counts from the worse of its two scores on, so each pair is met once and correlograms are running sums over
    levels; a unit's levels are summed in blocks, and no level without a new pair can be the first that fails. Event ids must be
    unique. Events with a null or no number in unit, time or score are left out.
    """
    e = events.select(F.col(unit).alias("unit"), F.col(t).alias("ta"), F.col(score).cast("double").alias("sa"), F.col(event_id).alias("ia"))
    e = e.where("unit is not null and ta is not null and sa is not null and not isnan(sa)")
    other = e.select(F.col("unit").alias("_u"), F.col("ta").alias("tb"), F.col("sa").alias("sb"), F.col("ia").alias("ib"))
    pairs = band_join(e, other, "ta", "tb", width * bins, [("unit", "_u")]).where((F.col("ia") < F.col("ib")) & (F.abs(F.col("tb") - F.col("ta")) < width * bins))
    pairs = pairs.select("unit", F.least("sa", "sb").alias("level"), F.rint(F.abs(F.col("tb") - F.col("ta")) / width).cast("int").alias("lag"))
    lags = [f"_{i}" for i in range(1, bins + 1)]
    levels = pairs.where("lag > 0").groupBy("unit", "level").agg(*[F.count_if(F.col("lag") == i).alias(c) for i, c in enumerate(lags, 1)])
    rows = numbered(levels, ["unit", F.col("level").desc()]).withColumn("_block", F.floor(F.col("_at") / LEVELS))
    sums = rows.groupBy("unit", "_block").agg(*[F.sum(c).alias(c) for c in lags])
    before = Window.partitionBy("unit").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    heads = sums.select("unit", "_block", F.array(*[F.coalesce(F.sum(c).over(before), F.lit(0)) for c in lags]).alias("_head"))
    inside = Window.partitionBy("unit", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.select("unit", "level", "_block", F.array(*[F.sum(c).over(inside) for c in lags]).alias("_sum")).join(heads, ["unit", "_block"])
    half = running.select("unit", "level", F.zip_with("_head", "_sum", lambda a, b: a + b).alias("_half"))
    k = F.concat(F.reverse("_half"), F.array(F.lit(0).cast("long")), F.col("_half"))
    found = half.select("unit", "level", k.alias("_k")).select("unit", "level", metrics(F.col("_k"), bins, compat).alias("m"))
    bad = (F.col("m.z") < NormalDist().inv_cdf(alpha)) & (F.col("m.ratio") >= most)
    best = found.groupBy("unit").agg(F.max(F.when(bad, F.struct("level", "m"))).alias("_bad"), F.min(F.struct("level", "m")).alias("_last"))
    best = written(best, "cuts")
    scores = e.join(best, "unit", "left").groupBy("unit").agg(
        F.first("_bad").alias("_bad"),
        F.first("_last").alias("_last"),
        F.min("sa").alias("_least"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("_bad").isNull() | (F.col("sa") >= F.col("_bad.level"))).alias("kept"),
    )
    at = lambda c: F.coalesce(f"_bad.m.{c}", f"_last.m.{c}", F.lit(0.0)).alias(c)
    z = F.coalesce("_bad.m.z", "_last.m.z").alias("z")
    return scores.select("unit", F.coalesce("_bad.level", "_least").alias("cut"), "n", "kept", at("rate"), at("ratio"), z)
