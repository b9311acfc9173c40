"""Splits of one-dimensional samples where their density dips, group by group, without holding a group in one task.

All rows are sorted once by group and value and numbered, so a group, and any part of it between two cuts, is a range of
numbers. The dip statistic of n values needs only about sqrt(n / 2) of their order statistics: those are looked up by an
equi-join on the number, and the fits run on them. A cut makes two new ranges, tested in the next round; rounds end when
no range splits.

The statistic: spacings of order statistics give a step density, with steps of few values at the ends and many in the
middle; its best unimodal fit predicts counts; the score is the largest Kolmogorov-Smirnov distance, scaled by the square
root of the count, between counts and prediction over halved stretches from either end up to the mode. The cut lies where
the density is furthest below the fit in that stretch, by an antimodal fit of the difference.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wavemill.operators.kernels import by_group
from wavemill.operators.order import numbered, written

THRESHOLD, LEAST = 1.5, 10


def rising(y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing weighted fit of y, and for each prefix the squared error of its own fit."""
    n = len(y)
    total, weight, square, size = (np.zeros(n) for _ in range(4))
    error, top, sum_error = np.zeros(n), -1, 0.0
    for i in range(n):
        top += 1
        total[top], weight[top], square[top], size[top] = y[i] * w[i], w[i], y[i] * y[i] * w[i], 1
        while top and total[top - 1] * weight[top] >= total[top] * weight[top - 1]:
            for k in (top - 1, top):
                sum_error -= square[k] - total[k] ** 2 / weight[k]
            for a in (total, weight, square, size):
                a[top - 1] += a[top]
            top -= 1
            sum_error += square[top] - total[top] ** 2 / weight[top]
        error[i] = sum_error
    return np.repeat(total[: top + 1] / weight[: top + 1], size[: top + 1].astype(int)), error


def unimodal(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Best weighted fit that rises and then falls."""
    n = len(y)
    up = np.append(0, rising(y, w)[1])  # of the first k
    down = np.append(rising(y[::-1], w[::-1])[1][::-1], 0)  # of those from k on
    k = int(np.argmin(up + down))
    left = rising(y[:k], w[:k])[0] if k else y[:0]
    right = rising(y[k:][::-1], w[k:][::-1])[0][::-1] if k < n else y[:0]
    return np.concatenate([left, right])


def antimodal(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Best weighted fit that falls and then rises."""
    return -unimodal(-y, w)


def knot_places(n: int) -> np.ndarray:
    """Places among n sorted values whose gaps hold about 1, 2, .. and .., 2, 1 parts of them."""
    if n < 2:
        return np.arange(n)
    for bins in range(int(np.ceil(np.sqrt(n / 2))), 0, -1):
        half = (bins + 1) // 2
        part = np.concatenate([np.arange(1, half + 1), np.arange(bins - half, 0, -1)]) * 1.0
        part *= (n - 1) / part.sum()
        if part.min() >= 1:
            break
    places = np.floor(np.cumsum(np.append(0, part)) + 1e-9).astype(np.int64)
    places[-1] = n - 1
    return places


def _farthest(count: np.ndarray, made: np.ndarray) -> tuple[float, int]:
    """The largest scaled distance of cumulated shares over prefixes of n, n / 2, n / 4 .. bins (4 at least), and that prefix."""
    best, size = (-1.0, len(count)), len(count)
    while size >= 4 or size == len(count):
        a, b = count[:size].sum(), made[:size].sum()
        if a > 0 and b > 0:
            d = np.abs(np.cumsum(count[:size]) / a - np.cumsum(made[:size]) / b).max() * np.sqrt((a + b) / 2)
            best = max(best, (float(d), size), key=lambda x: x[0])
        size //= 2
        if not size:
            break
    return best


def dip(value: np.ndarray, place: np.ndarray) -> tuple[float, int]:
    """(score, gap) from sorted values at given places; the cut lies between values gap and gap + 1. Equal values count as one
    knot; with fewer than four gaps the score is 0 and the gap -1."""
    last = np.append(value[1:] != value[:-1], True)
    first = np.append(True, last[:-1])
    if last.sum() < 5:
        return 0.0, -1
    x, where = value[first], place[last]
    where[0] = place[0]
    count, width = np.diff(where).astype(float), np.diff(x)
    density = count / width
    fit = unimodal(density, np.maximum(count, 1e-9))
    peak = int(np.argmax(fit))
    made = fit * width
    left, n_left = _farthest(count[: peak + 1], made[: peak + 1])
    right, n_right = _farthest(count[peak:][::-1], made[peak:][::-1])
    part = slice(0, n_left) if left > right else slice(len(count) - n_right, len(count))
    gap = part.start + int(np.argmin(antimodal(density[part] - fit[part], width[part])))
    return max(left, right), int(np.flatnonzero(first)[gap + 1] - 1)


def _sorted(df: DataFrame, group: list[str], value: str) -> DataFrame:
    rows = df.select(*group, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    return written(numbered(rows, [*group, "_v"]), "values")


def _tested(ranges: DataFrame, rows: DataFrame) -> DataFrame:
    """ranges (group, first, size, ..) with score, the places around the gap and the cut between them."""
    def places(frames):
        for p in frames:
            for i in range(0, len(p), 100):  # a range's knots are about the square root of its size
                q = p[i : i + 100]
                at = [knot_places(int(n)) + int(k) for n, k in zip(q["size_"], q["first_"], strict=True)]
                many = [len(x) for x in at]
                yield pd.DataFrame({"first": np.repeat(q["first_"].to_numpy(), many), "size": np.repeat(q["size_"].to_numpy(), many), "_at": np.concatenate(at)})

    small = ranges.select(F.col("first").alias("first_"), F.col("size").alias("size_"))
    knots = small.mapInPandas(places, "first long, size long, _at long").join(rows.select("_at", "_v"), "_at")

    def run(p: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out = []
        for first, v, at in zip(p["first"].to_numpy()[starts], np.split(p["_v"].to_numpy(), starts[1:]), np.split(p["_at"].to_numpy(), starts[1:]), strict=True):
            score, gap = dip(v, at.copy())
            out.append((first, score, int(at[gap]), int(at[gap + 1]), (v[gap] + v[gap + 1]) / 2) if gap >= 0 else (first, score, None, None, None))
        return pd.DataFrame(out, columns=["first", "score", "low", "high", "cut"]).astype({"low": "Int64", "high": "Int64", "cut": "Float64"})

    scores = by_group(knots, ["first"], ["_at"], run, "first long, score double, low long, high long, cut double")
    return ranges.join(scores, "first", "left")


def dip_test(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, score, cut) per group; null and NaN values are left out, and the cut is null where a group has fewer than five knots."""
    rows = _sorted(df, [group], value)
    whole = written(rows.groupBy(group).agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("size")), "groups")
    return _tested(whole, rows).select(group, F.col("size").alias("n"), F.coalesce("score", F.lit(0.0)).alias("score"), "cut")


def parts(df: DataFrame, group: list[str], value: str, *, threshold: float = THRESHOLD, least: int = LEAST, diameter: float = 0.0) -> DataFrame:
    """(group.., low, high, size): the parts that each group's values split into, low < value <= high.

    A range splits at its cut if the score reaches ``threshold``, both sides have ``least`` values or more, and the cut is
    ``diameter`` or more from the range's bounds (those of a whole group are infinite).
    """
    rows = _sorted(df, group, value)
    infinite = F.lit(float("inf"))
    whole = rows.groupBy(*group).agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("size"))
    now, done = written(whole.withColumn("lo", -infinite).withColumn("hi", infinite), "ranges"), []
    names = [*group, "first", "size", "lo", "hi"]
    while True:
        large = now.where(F.col("size") >= 2 * least)
        done.append(now.where(F.col("size") < 2 * least).select(*names))
        tested = written(_tested(large, rows), "tested")
        may = (F.col("score") >= threshold) & (F.col("cut") - F.col("lo") >= diameter) & (F.col("hi") - F.col("cut") >= diameter)
        may = F.coalesce(may, F.lit(False))
        # values between the places around the gap that are left of the cut
        gap = tested.where(may).select("first", F.explode(F.expr("sequence(low, high)")).alias("_at"), "cut")
        left = gap.join(rows.select("_at", "_v"), "_at").where("_v <= cut").groupBy("first").agg((F.max("_at") + 1).alias("_end"))
        cutting = tested.join(left, "first", "left").withColumn("_left", F.col("_end") - F.col("first"))
        ok = may & (F.col("_left") >= least) & (F.col("size") - F.col("_left") >= least)
        cutting = written(cutting.withColumn("_ok", F.coalesce(ok, F.lit(False))), "cuts")
        done.append(cutting.where("NOT _ok").select(*names))
        split = cutting.where("_ok")
        a = split.select(*group, "first", F.col("_left").alias("size"), "lo", F.col("cut").alias("hi"))
        b = split.select(*group, F.col("_end").alias("first"), (F.col("size") - F.col("_left")).alias("size"), F.col("cut").alias("lo"), "hi")
        now = written(a.unionByName(b), "ranges")
        if now.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*group, F.col("lo").alias("low"), F.col("hi").alias("high"), "size")


def split(df: DataFrame, group: list[str], value: str, to: str = "part", **rule) -> DataFrame:
    """df with ``to``: 0, 1, 2 .. by rising value within a group; null and NaN values are part 0. A group's cuts, few as its parts
    are, are joined to its rows."""
    cuts = parts(df, group, value, **rule).where(F.col("low") > float("-inf")).groupBy(*group).agg(F.collect_list("low").alias("_cuts"))
    part = F.size(F.filter("_cuts", lambda c: F.col(value).cast("double") > c))
    safe = F.when(F.col("_cuts").isNull() | F.isnan(F.col(value).cast("double")) | F.col(value).isNull(), F.lit(0)).otherwise(part)
    return df.join(cuts, group, "left").withColumn(to, safe.cast("long")).drop("_cuts")


def split_until_stable(df: DataFrame, group: str, values: list[str], to: str = "part", most_rounds: int | None = None, **rule) -> DataFrame:
    """df with ``to``: each group split along every value in turn, and all that came of it along every value again, until none splits.

    ``to`` numbers a group's parts by a path of cuts, so rows of one part share it and rows of two parts don't.
    """
    out, rounds = df.withColumn(to, F.lit("")), 0
    while most_rounds is None or rounds < most_rounds:
        rounds += 1
        before = out.select(group, to).distinct().count()
        for v in values:
            out = split(out, [group, to], v, "_p", **rule).withColumn(to, F.concat(to, F.col("_p").cast("string"), F.lit("."))).drop("_p")
        out = written(out, "split")
        if out.select(group, to).distinct().count() == before:
            break
    return out
