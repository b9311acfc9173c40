"""Recursive filters over long series in chunks, with the state carried from chunk to chunk by a scan.

A series is rows (key.., n, value) with n = 0, 1, 2 .. A filter is a linear state space, so a chunk turns the state s into
A^L s + f, f being what its own samples leave from a state of 0. Three passes give exactly what one pass over the whole
series gives: f per chunk; a scan of these maps, which compose, in groups of groups; the output per chunk from its state.
Zero-phase filtering runs forward and backward over a series extended by its odd reflection at both ends, each run
starting in the steady state of its first sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wavemill.operators.order import written

CHUNK, GROUP, BLOCK = 1 << 14, 512, 64


def butterworth(order: int, kind: str, rate: float, low: float | None = None, high: float | None = None) -> np.ndarray:
    """Sections (b0, b1, b2, 1, a1, a2) of a Butterworth filter: ``kind`` is lowpass (high), highpass (low) or bandpass (both), in units of ``rate``."""
    proto = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    warp = lambda f: 2 * np.tan(np.pi * f / rate)
    if kind == "lowpass":
        poles, zeros, gain = warp(high) * proto, 0, warp(high) ** order
    elif kind == "highpass":
        poles, zeros, gain = warp(low) / proto, order, 1.0
    else:
        half, mid = (warp(high) - warp(low)) / 2 * proto, warp(low) * warp(high)
        root = np.sqrt(half * half - mid)
        poles, zeros, gain = np.concatenate([half + root, half - root]), order, (warp(high) - warp(low)) ** order
    gain = gain * np.real(2.0**zeros / np.prod(2 - poles))
    z = (2 + poles) / (2 - poles)
    upper = sorted(z[z.imag > 1e-12], key=lambda p: (abs(p), p.real))
    real = sorted(z[np.abs(z.imag) <= 1e-12].real)
    pairs = [(-2 * p.real, abs(p) ** 2) for p in upper] + [(-(a + b), a * b) for a, b in zip(real[::2], real[1::2], strict=False)]
    top = {"lowpass": (1, 2, 1), "highpass": (1, -2, 1), "bandpass": (1, 0, -1)}[kind]
    out = [[*top, 1.0, a1, a2] for a1, a2 in pairs]
    if len(real) % 2:
        out.append([1.0, 1.0 if kind == "lowpass" else -1.0, 0.0, 1.0, -real[-1], 0.0])
    out = np.array(out, float)
    out[0, :3] *= gain
    return out


@dataclass
class Space:
    """A cascade of sections as s' = A s + B x, y = C s + D x, and its matrices over blocks of BLOCK samples."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float

    @classmethod
    def of(cls, sections: np.ndarray) -> Space:
        k = 2 * len(sections)
        a, b, c, d = np.zeros((k, k)), np.zeros(k), np.zeros(k), 1.0
        for i, (b0, b1, b2, _, a1, a2) in enumerate(sections):
            own_a, own_b = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
            at = slice(2 * i, 2 * i + 2)
            a[at, at] = own_a
            a[at] += np.outer(own_b, c)
            b[at] = own_b * d
            c = b0 * c
            c[2 * i] = 1.0
            d = b0 * d
        return cls(a, b, c, d)

    def steady(self) -> np.ndarray:
        """The state that a constant input of 1 keeps."""
        return np.linalg.solve(np.eye(len(self.b)) - self.a, self.b)

    def power(self, n: int) -> np.ndarray:
        return np.linalg.matrix_power(self.a, n)

    def _block(self, n: int):
        seen, reach = np.zeros((n, len(self.b))), np.zeros((len(self.b), n))
        row, col = self.c.copy(), self.b.copy()
        for i in range(n):
            seen[i], reach[:, n - 1 - i] = row, col
            row, col = row @ self.a, self.a @ col
        impulse = np.append(self.d, seen[: n - 1] @ self.b)
        i, j = np.indices((n, n))
        return seen, reach, np.where(i >= j, impulse[np.maximum(i - j, 0)], 0.0)

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(output, last state) from a first state."""
        out, n = np.empty(len(x)), len(x) // BLOCK * BLOCK
        if n:
            seen, reach, own = self._block(BLOCK)
            whole = x[:n].reshape(-1, BLOCK)
            y, step, jump = whole @ own.T, whole @ reach.T, self.power(BLOCK)
            states = np.empty((len(whole), len(self.b)))
            for i in range(len(whole)):
                states[i] = state
                state = jump @ state + step[i]
            out[:n] = (y + states @ seen.T).ravel()
        if n < len(x):
            seen, reach, own = self._block(len(x) - n)
            out[n:], state = own @ x[n:] + seen @ state, self.power(len(x) - n) @ state + reach @ x[n:]
        return out, state


def _states(maps: DataFrame, keys: list[str], space: Space, begin: DataFrame) -> DataFrame:
    """(keys, c, state): each chunk's first state from maps (keys, c, size, f) and the first chunk's (keys, state)."""
    ks = "".join(f"`{k}` {maps.schema[k].dataType.simpleString()}, " for k in keys)

    def compose(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("c")
        f, total = np.zeros(len(space.b)), 0
        for n, own in zip(p["size"], p["f"], strict=True):
            f, total = space.power(int(n)) @ f + np.asarray(own), total + int(n)
        return pd.DataFrame({**{k: [p[k].iloc[0]] for k in keys}, "c": [int(p["c"].iloc[0]) // GROUP], "size": [total], "f": [f.tolist()]})

    def expand(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("c")
        state, out = np.asarray(p["state"].iloc[0]), []
        for n, own in zip(p["size"], p["f"], strict=True):
            out.append(state.tolist())
            state = space.power(int(n)) @ state + np.asarray(own)
        return pd.DataFrame({**{k: p[k].to_numpy() for k in keys}, "c": p["c"].to_numpy(), "state": out})

    many = (maps.agg(F.max("c")).first()[0] or 0) >= GROUP  # one number
    if many:
        grouped = maps.groupBy(*keys, F.floor(F.col("c") / GROUP).alias("_g")).applyInPandas(compose, f"{ks}c long, size long, f array<double>")
        first = _states(written(grouped, "maps"), keys, space, begin).withColumnRenamed("c", "_g")
        rows = maps.withColumn("_g", F.floor(F.col("c") / GROUP)).join(first, [*keys, "_g"])
        return rows.groupBy(*keys, "_g").applyInPandas(expand, f"{ks}c long, state array<double>")
    rows = maps.join(begin, keys) if keys else maps.crossJoin(F.broadcast(begin))  # a row per series
    return rows.groupBy(*keys).applyInPandas(expand, f"{ks}c long, state array<double>")


def recursive(df: DataFrame, keys: list[str], n: str, value: str, sections: np.ndarray, to: str, *, steady: bool = False, backward: bool = False, chunk: int = CHUNK) -> DataFrame:
    """(keys, n, to): the filter's output along n, or from the last n on. ``steady`` starts each series in the steady state of its
    first sample, otherwise in 0. n must be consecutive; rows without a value or place are left out, which closes no gap."""
    space = Space.of(sections)
    sign = -1 if backward else 1
    rows = df.select(*keys, F.col(n).cast("long").alias("n"), F.col(value).cast("double").alias("x")).where("n IS NOT NULL AND x IS NOT NULL").withColumn("o", sign * F.col("n"))
    first = rows.groupBy(*keys).agg(F.min(F.struct("o", "x")).alias("h")).select(*keys, F.col("h.o").alias("o0"), F.col("h.x").alias("x0"))
    rows = rows.join(F.broadcast(first), keys) if keys else rows.crossJoin(F.broadcast(first))  # a row per series
    rows = written(rows.select(*keys, "n", "o", "x", F.floor((F.col("o") - F.col("o0")) / chunk).alias("c")), "series")
    ks = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)

    def leave(p: pd.DataFrame) -> pd.DataFrame:
        x = p.sort_values("o")["x"].to_numpy()
        f = space.run(x, np.zeros(len(space.b)))[1]
        return pd.DataFrame({**{k: [p[k].iloc[0]] for k in keys}, "c": [p["c"].iloc[0]], "size": [len(x)], "f": [f.tolist()]})

    maps = written(rows.groupBy(*keys, "c").applyInPandas(leave, f"{ks}c long, size long, f array<double>"), "maps")
    start = space.steady() if steady else np.zeros(len(space.b))
    begin = first.select(*keys, F.array(*[F.col("x0") * float(v) for v in start]).alias("state"))
    states = written(_states(maps, keys, space, begin), "states")

    def run(p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("o")
        y = space.run(p["x"].to_numpy(), np.asarray(s["state"].iloc[0]))[0] if len(p) else np.zeros(0)
        return pd.DataFrame({**{k: p[k].to_numpy() for k in keys}, "n": p["n"].to_numpy(), to: y})

    return rows.groupBy(*keys, "c").cogroup(states.groupBy(*keys, "c")).applyInPandas(run, f"{ks}n long, `{to}` double")


def zero_phase(df: DataFrame, keys: list[str], n: str, value: str, sections: np.ndarray, to: str = "filtered", *, pad: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(keys, n, to): filtered forward and backward, so nothing is delayed, over series with n = 0, 1, 2 .. extended by ``pad`` samples of
    their odd reflection (three per coefficient by default; a shorter series is reflected once)."""
    zeros = int(min((sections[:, 2] == 0).sum(), (sections[:, 5] == 0).sum()))
    pad = 3 * (2 * len(sections) + 1 - zeros) if pad is None else pad
    rows = df.select(*keys, F.col(n).cast("long").alias("n"), F.col(value).cast("double").alias("x")).where("n IS NOT NULL AND x IS NOT NULL")
    ends = rows.groupBy(*keys).agg(F.min_by("x", "n").alias("x0"), F.max_by("x", "n").alias("x1"), F.max("n").alias("top"))
    rows = written(rows, "samples")
    near = rows.join(F.broadcast(ends), keys) if keys else rows.crossJoin(F.broadcast(ends))  # a row per series
    before = near.where((F.col("n") >= 1) & (F.col("n") <= pad)).select(*keys, (-F.col("n")).alias("n"), (2 * F.col("x0") - F.col("x")).alias("x"))
    after = near.where((F.col("n") < F.col("top")) & (F.col("n") >= F.col("top") - pad)).select(*keys, (2 * F.col("top") - F.col("n")).alias("n"), (2 * F.col("x1") - F.col("x")).alias("x"))
    wide = rows.unionByName(before).unionByName(after)
    once = written(recursive(wide, keys, "n", "x", sections, "y", steady=True, chunk=chunk), "forward")
    back = recursive(once, keys, "n", "y", sections, to, steady=True, backward=True, chunk=chunk)
    return back.join(F.broadcast(ends.select(*keys, "top")), keys).where("n BETWEEN 0 AND top").select(*keys, F.col("n").alias(n), to) if keys else back.crossJoin(F.broadcast(ends.select("top"))).where("n BETWEEN 0 AND top").select(F.col("n").alias(n), to)


def phase_shift(df: DataFrame, keys: list[str], n: str, value: str, shift: str, to: str = "shifted", *, chunk: int = CHUNK, margin: int = 1 << 10) -> DataFrame:
    """(keys, n, to): each series delayed by ``shift`` samples, a column constant within a series that may be fractional, by turning the
    phases of its spectrum. Chunks overlap by ``margin`` samples on either side, which the result doesn't show; a series of one chunk
    is turned whole, so it wraps around as a periodic one does."""
    rows = df.select(*keys, F.col(n).cast("long").alias("n"), F.col(value).cast("double").alias("x"), F.col(shift).cast("double").alias("s")).where("n IS NOT NULL AND x IS NOT NULL")
    low, high = F.floor((F.col("n") - margin) / chunk), F.floor((F.col("n") + margin) / chunk)
    cut = rows.withColumn("c", F.explode(F.sequence(F.greatest(low, F.lit(0).cast("long")), high)))
    ks = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)

    def turn(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("n")
        x = p["x"].to_numpy()
        y = np.fft.irfft(np.fft.rfft(x) * np.exp(-2j * np.pi * np.fft.rfftfreq(len(x)) * p["s"].iloc[0]), len(x))
        core = (p["n"] // chunk == p["c"]).to_numpy()
        return pd.DataFrame({**{k: p[k].to_numpy()[core] for k in keys}, n: p["n"].to_numpy()[core], to: y[core]})

    return cut.groupBy(*keys, "c").applyInPandas(turn, f"{ks}`{n}` long, `{to}` double")
