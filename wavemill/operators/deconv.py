"""Multichannel template matching on long recordings: low-rank templates, rounds of greedy subtraction, chunks that prove themselves.

A recording is a table of frames (place in samples, array of channel values). Templates are compressed one by one and convolved
pair by pair in tasks; what a chunk needs of them is broadcast up to ``MOST_NUMBERS``, a size that depends on the probe and not on
the recording. Chunks are matched with margins, each on its own. Two neighbours agree when their logs of matches, rounds
included, are equal around the border; where all agree, the chunks' cores together are the matching of the whole recording (each
decision rests on matches within ``reach`` alone, so by induction over rounds no decision differs). Where two don't, both are
matched again with twice the margin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wavemill.operators.order import written

MOST_NUMBERS = 1 << 26  # template and pair values that may be broadcast: 512 MB
WIDTH = 4  # places either way of a peak from which the sub-sample curve is made
BANK = "unit long, channels array<int>, temporal array<array<double>>, spatial array<array<double>>, norm double, parts int"
PAIRS = "a long, b long, shift int, values array<double>"
MATCHES = "start long, unit long, shift int, scale double, gain double, round int"


def shifted(curves: np.ndarray, by: float) -> np.ndarray:
    """Columns moved later by a part of a sample, as band-limited periodic curves."""
    n = len(curves)
    turn = np.exp(-2j * np.pi * np.fft.rfftfreq(n) * by)
    return np.fft.irfft(np.fft.rfft(curves, axis=0) * turn[:, None], n, axis=0)


def shifts(parts: int, finest: int) -> list[int]:
    """Sub-sample places of a unit within half a sample, counted in 1/finest: every (finest / parts)-th."""
    step = finest // parts
    return [s * step for s in range(-(parts // 2), (parts + 1) // 2)]


def compress(templates: DataFrame, rank: int = 5, visible: float = 1.0, finest: int = 8) -> DataFrame:
    """Rows (unit, x: samples of channel arrays) to ``BANK``: channels whose peak-to-peak exceeds ``visible``, the strongest
    ``rank`` components on them (temporal ones hold the weights), the norm of what they make, and the unit's sub-sample parts:
    4^floor(log2 of the largest peak-to-peak), at most ``finest``. Units without a visible channel are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for unit, x in zip(p["unit"], p["x"], strict=True):
                x = np.stack([np.asarray(row, float) for row in x])
                height = np.ptp(x, axis=0)
                seen = np.flatnonzero(height > visible)
                if len(seen):
                    u, s, v = np.linalg.svd(x[:, seen], full_matrices=False)
                    k = min(rank, len(s))
                    parts = int(np.clip(4.0 ** np.floor(np.log2(height.max())), 1, finest))
                    out.append((unit, seen, list(u[:, :k] * s[:k]), list(v[:k]), float((s[:k] ** 2).sum()), parts))
            yield pd.DataFrame(out, columns=["unit", "channels", "temporal", "spatial", "norm", "parts"])

    return templates.select("unit", "x").mapInPandas(run, BANK)


def pair_convolutions(bank: DataFrame, finest: int = 8) -> DataFrame:
    """For units that share a channel and each shift of b: at lag l from -(n - 1) to n - 1 the product of a with b placed l
    earlier, summed over shared channels (``PAIRS``). Pairs meet on their channels; both sides are factors, not templates."""
    seen = bank.select("unit", F.explode("channels").alias("channel"))
    near = seen.withColumnRenamed("unit", "a").join(seen.withColumnRenamed("unit", "b"), "channel").select("a", "b").distinct()
    side = lambda s: bank.select(*[F.col(c).alias(f"{s}_{c}") for c in bank.columns])
    rows = near.join(side("a"), F.col("a") == F.col("a_unit")).join(side("b"), F.col("b") == F.col("b_unit"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for r in p.itertuples(index=False):
                _, at, bt = np.intersect1d(r.a_channels, r.b_channels, return_indices=True)
                space = np.stack(list(r.a_spatial))[:, at] @ np.stack(list(r.b_spatial))[:, bt].T
                ta, tb = np.stack(list(r.a_temporal)) @ space, np.stack(list(r.b_temporal))
                for s in shifts(r.b_parts, finest):
                    moved = shifted(tb, s / finest)
                    values = sum(np.correlate(moved[:, q], ta[:, q], "full") for q in range(ta.shape[1]))
                    out.append((r.a, r.b, s, values))
            yield pd.DataFrame(out, columns=["a", "b", "shift", "values"])

    return rows.mapInPandas(run, PAIRS)


@dataclass
class Bank:
    """What a task needs of all templates."""

    units: np.ndarray
    factors: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # channels, temporal (n x r), spatial (r x channels)
    norms: np.ndarray
    parts: list[int]
    pairs: dict[tuple[int, int], list[tuple[int, np.ndarray]]]  # (b, shift) -> [(a, values)]
    finest: int

    @property
    def size(self) -> int:
        return len(self.factors[0][1])

    @property
    def reach(self) -> int:
        """Places that a decision may rest on, either way: the peak's neighbourhood, the refinement and two templates."""
        return 3 * self.size + WIDTH


def load(bank: DataFrame, pairs: DataFrame, finest: int = 8) -> Bank | None:
    """The bank on the driver, None without units. ValueError beyond ``MOST_NUMBERS``: such a probe should be matched by regions."""
    cells = lambda c: F.coalesce(F.sum(F.size(c) * F.size(F.element_at(c, 1))), F.lit(0))
    total = bank.select((cells("temporal") + cells("spatial")).alias("n")).first().n
    total += pairs.select(F.coalesce(F.sum(F.size("values")), F.lit(0)).alias("n")).first().n
    if total > MOST_NUMBERS:
        raise ValueError(f"templates of {total} numbers, at most {MOST_NUMBERS}: match the recording's regions one by one")
    rows = bank.orderBy("unit").collect()
    if not rows:
        return None
    index, met = {r.unit: k for k, r in enumerate(rows)}, {}
    for r in pairs.orderBy("b", "shift", "a").collect():
        met.setdefault((index[r.b], r["shift"]), []).append((index[r.a], np.array(r["values"])))
    factors = [(np.array(r.channels), np.array(r.temporal), np.array(r.spatial)) for r in rows]
    return Bank(np.array([r.unit for r in rows]), factors, np.array([r.norm for r in rows]), [r.parts for r in rows], met, finest)


def products(x: np.ndarray, bank: Bank) -> np.ndarray:
    """<x, template> at each unit and start. Every value is summed in one order wherever a window begins, so windows agree to the bit."""
    n = bank.size
    out = np.zeros((len(bank.units), len(x) - n + 1))
    for k, (channels, temporal, spatial) in enumerate(bank.factors):
        for r in range(len(spatial)):
            line = np.zeros(len(x))
            for c, w in zip(channels, spatial[r], strict=True):
                line += w * x[:, c]
            for i in range(n):
                out[k] += temporal[i, r] * line[i : i + out.shape[1]]
    return out


def peaks(best: np.ndarray, threshold: float, radius: int) -> np.ndarray:
    """Places above the threshold and above all within the radius; the first of equals."""
    at = np.flatnonzero(best > threshold)
    if not len(at):
        return at
    padded = np.concatenate([np.full(radius, -np.inf), best, np.full(radius, -np.inf)])
    around = np.lib.stride_tricks.sliding_window_view(padded, 2 * radius + 1)[at]
    before, after = around[:, :radius].max(1, initial=-np.inf), around[:, radius + 1 :].max(1, initial=-np.inf)
    return at[(before < best[at]) & (after <= best[at])]


def refine(conv: np.ndarray, norm: float, parts: int, finest: int, ridge: float, spread: float) -> tuple[int, float]:
    """(shift, scale) that gain most, from a unit's products WIDTH places either way of the peak, as a band-limited curve between them.

    With ``ridge`` the scale is (c + 1/ridge) / (norm + 1/ridge), kept within 1/(1 + spread) .. 1 + spread; without, it is 1."""
    m, best = 2 * WIDTH + 1, (-np.inf, 0, 1.0)
    for s in sorted(shifts(parts, finest), key=lambda s: (abs(s), s)):
        u = np.pi * (WIDTH + s / finest - np.arange(m))
        weight = np.array([1.0 if abs(v) < 1e-12 else np.sin(v) / (m * np.sin(v / m)) for v in u])
        c = conv[WIDTH] if s == 0 else float((weight * conv).sum())
        if ridge > 0:
            a, b = norm + 1 / ridge, c + 1 / ridge
            scale = float(np.clip(b / a, 1 / (1 + spread), 1 + spread))
            value = 2 * scale * b - scale * scale * a
        else:
            scale, value = 1.0, 2 * c - norm
        if value > best[0]:
            best = (value, s, scale)
    return best[1], best[2]


def match(x: np.ndarray, bank: Bank, threshold: float, dead: int = 10, ridge: float = 0.0, spread: float = np.inf) -> list[tuple]:
    """(start, unit, shift, scale, gain, round) of all matches in one stretch of frames.

    A round takes every peak of the largest gain 2 <x, t> - |t|^2 over units, refines it, and subtracts all of the round's
    templates from all products. A match blocks its unit ``dead`` places either way, so rounds end."""
    n, out, turn = bank.size, [], 0
    if len(x) < n:
        return out
    conv = products(x, bank)
    blocked, last = np.zeros(conv.shape, bool), conv.shape[1] - 1
    unit, best, changed = np.zeros(last + 1, int), np.zeros(last + 1), np.ones(last + 1, bool)
    while True:
        at, turn = np.flatnonzero(changed), turn + 1
        gain = np.where(blocked[:, at], -np.inf, 2 * conv[:, at] - bank.norms[:, None])
        unit[at], best[at] = gain.argmax(0), gain.max(0)
        changed[:] = False
        found = [(int(p), int(unit[p])) for p in peaks(best, threshold, n - 1)]
        if not found:
            return out
        around = [conv[k, np.clip(np.arange(p - WIDTH, p + WIDTH + 1), 0, last)] for p, k in found]
        chosen = [refine(c, bank.norms[k], bank.parts[k], bank.finest, ridge, spread) for c, (_, k) in zip(around, found, strict=True)]
        for (p, k), (shift, scale) in zip(found, chosen, strict=True):
            out.append((p, int(bank.units[k]), shift, scale, float(best[p]), turn))
            low, high = max(0, p - n + 1), min(last, p + n - 1)
            for a, values in bank.pairs[k, shift]:
                conv[a, low : high + 1] -= scale * values[low - p + n - 1 : high - p + n]  # what a at place j shares with k at p is lag j - p
            near = slice(max(0, p - dead), p + dead + 1)
            blocked[k, near] = True
            changed[low : high + 1] = changed[near] = True


def _logs(frames: DataFrame, chunk: int, margin: int, ends: tuple[int, int], bank, arguments: dict, only: DataFrame | None = None) -> DataFrame:
    """Each chunk's matches with its margin, or those of the chunks in ``only``: (_chunk, MATCHES); a chunk without any gives nulls."""
    first, last = ends
    inside = F.sequence(F.floor((F.col("_n") - margin) / chunk), F.floor((F.col("_n") + margin) / chunk))
    rows = frames.withColumn("_chunk", F.explode(inside))
    rows = rows.where((F.col("_chunk") >= first // chunk) & (F.col("_chunk") <= last // chunk))
    if only is not None:
        rows = rows.join(only, "_chunk", "left_semi")

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        (c,) = key
        low, high = max(first, c * chunk - margin), min(last + 1, (c + 1) * chunk + margin)
        wide = bank.value.factors
        x = np.zeros((high - low, max(int(f[0].max()) for f in wide) + 1))
        for at, row in zip(p["_n"] - low, p["_x"], strict=True):
            row = np.asarray(row, float)[: x.shape[1]]
            x[at, : len(row)] = row
        got = [(c, low + s, *rest) for s, *rest in match(x, bank.value, **arguments)] or [(c, None, None, None, None, None, None)]
        return pd.DataFrame(got, columns=["_chunk", "start", "unit", "shift", "scale", "gain", "round"]).astype(
            {"start": "Int64", "unit": "Int64", "shift": "Int32", "round": "Int32"}
        )

    return rows.groupBy("_chunk").applyInPandas(run, "_chunk long, " + MATCHES)


def pursue(
    frames: DataFrame,
    templates: DataFrame,
    place: str,
    values: str,
    threshold: float,
    chunk: int = 30_000,
    rank: int = 5,
    visible: float = 1.0,
    finest: int = 8,
    dead: int = 10,
    ridge: float = 0.0,
    spread: float = float("inf"),
    margin: int | None = None,
) -> DataFrame:
    """``MATCHES`` of the recording, equal to matching it whole in one piece (to the bit: windows sum in one order).

    ``templates`` are rows (unit, x: samples of channel arrays), all of one length. Frames and values that are missing, null
    or no number count as zeros; of repeated places, one with the greatest array is kept. An empty recording or no visible unit gives no rows.
    """
    spark = frames.sparkSession
    few = written(compress(templates.where(F.col("unit").isNotNull() & F.col("x").isNotNull()), rank, visible, finest), "bank")
    bank = load(few, written(pair_convolutions(few, finest), "pairs"), finest)
    clean = lambda v: F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = frames.select(F.col(place).cast("long").alias("_n"), F.transform(values, clean).alias("_x"))
    rows = rows.where("_n is not null").groupBy("_n").agg(F.coalesce(F.max("_x"), F.array().cast("array<double>")).alias("_x"))
    first, last = rows.agg(F.min("_n"), F.max("_n")).first()
    if bank is None or first is None:
        return spark.createDataFrame([], MATCHES)
    rows, shared = written(rows, "frames"), spark.sparkContext.broadcast(bank)
    arguments = dict(threshold=threshold, dead=dead, ridge=ridge, spread=spread)
    reach = max(bank.reach, bank.size + dead)
    margin = max(margin or 0, reach + bank.size)
    logs = written(_logs(rows, chunk, margin, (first, last), shared, arguments), "matches")
    while True:
        # border b parts chunks b - 1 and b; either has logged what lies within the reach of it
        near = logs.where("start is not null").withColumn("_border", F.explode(F.sequence(F.col("_chunk"), F.col("_chunk") + 1)))
        near = near.where(F.col("start").between(F.col("_border") * chunk - reach, F.col("_border") * chunk + reach))
        near = near.where((F.col("_border") > first // chunk) & (F.col("_border") <= last // chunk))
        side = (F.col("_border") - F.col("_chunk")) * 2 - 1  # 1 from the left, -1 from the right
        odd = near.groupBy("_border", "start", "unit", "shift", "scale", "gain", "round").agg(F.sum(side).alias("_net")).where("_net <> 0")
        again = written(odd.select(F.explode(F.array(F.col("_border") - 1, F.col("_border"))).alias("_chunk")).distinct(), "again")
        if again.isEmpty():
            break
        margin = min(2 * margin, max(margin, last - first + 1))  # windows of the whole recording agree, so this ends
        new = _logs(rows, chunk, margin, (first, last), shared, arguments, again)
        logs = written(logs.join(again, "_chunk", "left_anti").unionByName(new), "matches")
    return logs.where(F.floor(F.col("start") / chunk) == F.col("_chunk")).drop("_chunk")


def used_templates(matches: DataFrame, bank: DataFrame, finest: int = 8) -> DataFrame:
    """The moved templates that matches used: (unit, shift, n, channels, x: samples of the channels' values, after compression)."""
    used = matches.groupBy("unit", "shift").agg(F.count(F.lit(1)).alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            x = [list(shifted(np.stack(list(t)), s / finest) @ np.stack(list(v))) for t, v, s in zip(p["temporal"], p["spatial"], p["shift"], strict=True)]
            yield p[["unit", "shift", "n", "channels"]].assign(x=x)

    return used.join(bank, "unit").mapInPandas(run, "unit long, shift int, n long, channels array<int>, x array<array<double>>")
