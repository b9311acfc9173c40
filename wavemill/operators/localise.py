"""Places of events from their amplitudes over channels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def centre_of_mass(amplitudes: str, places: list[tuple[float, float]]) -> tuple[Column, Column]:
    """Magnitude-weighted mean of the channels' places; null where all magnitudes are 0."""
    a = F.transform(amplitudes, F.abs)
    total = F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    out = []
    for k in (0, 1):
        at = F.array(*[F.lit(float(p[k])) for p in places])
        moment = F.aggregate(F.zip_with(a, at, lambda v, x: v * x), F.lit(0.0), lambda s, v: s + v)
        out.append(moment / F.when(total > 0, total))
    return out[0], out[1]


def fit_point_sources(amp: np.ndarray, places: np.ndarray, rounds: int = 60) -> np.ndarray:
    """(rows, 4): x, z, y and strength of the sources strength / |r| that fit rows of amplitudes best, y being the distance from the plane.

    Levenberg-Marquardt on all rows at once, from the centre of mass; log-strength and log-distance keep both positive. The
    damping of a row falls when a step helps and grows when it doesn't.
    """
    amp = np.abs(amp).astype(np.float64)
    n = len(amp)
    weight = amp / np.maximum(amp.sum(1, keepdims=True), 1e-12)
    p = np.concatenate([weight @ places, np.full((n, 1), np.log(20.0)), np.log(np.maximum(amp.max(1, keepdims=True) * 20.0, 1e-6))], 1)

    def model(p):
        dx, dz = places[None, :, 0] - p[:, :1], places[None, :, 1] - p[:, 1:2]
        y2 = np.exp(2 * p[:, 2:3])
        r2 = dx * dx + dz * dz + y2
        return np.exp(p[:, 3:4]) / np.sqrt(r2), dx, dz, y2, r2

    damping = np.full(n, 1e-2)
    out, *rest = model(p)
    cost = ((amp - out) ** 2).sum(1)
    for _ in range(rounds):
        dx, dz, y2, r2 = rest
        jac = np.stack([out * dx / r2, out * dz / r2, -out * y2 / r2, out], 2)
        gram, right = np.einsum("nci,ncj->nij", jac, jac), np.einsum("nci,nc->ni", jac, amp - out)
        diag = np.einsum("nii->ni", gram)
        step = np.linalg.solve(gram + (damping[:, None] * np.maximum(diag, 1e-9))[:, :, None] * np.eye(4), right[:, :, None])[:, :, 0]
        step = np.clip(step, [-50, -50, -1, -1], [50, 50, 1, 1])
        tried = p + step
        tried[:, 2] = np.clip(tried[:, 2], 0.0, 7.0)
        new, *new_rest = model(tried)
        new_cost = ((amp - new) ** 2).sum(1)
        better = new_cost <= cost
        p[better], cost[better], out[better] = tried[better], new_cost[better], new[better]
        rest = [np.where(better.reshape(-1, *[1] * (a.ndim - 1)), b, a) for a, b in zip(rest, new_rest, strict=True)]
        damping = np.clip(np.where(better, damping / 3, damping * 4), 1e-9, 1e9)
    return np.stack([p[:, 0], p[:, 1], np.exp(p[:, 2]), np.exp(p[:, 3])], 1)


def locate(df: DataFrame, key: str, amplitudes: str, places: list[tuple[float, float]]) -> DataFrame:
    """(key, x, z, y, strength) of each row's point source. Rows whose amplitudes are null or of another length than places get nulls."""
    kind, where = df.schema[key].dataType.simpleString(), np.array(places, float)

    def run(batches):
        for batch in batches:
            rows = batch.column(1).to_pylist()
            good = np.array([r is not None and len(r) == len(where) and None not in r for r in rows], bool)
            out = np.full((len(rows), 4), np.nan)
            if good.any():
                out[good] = fit_point_sources(np.array([r for r, g in zip(rows, good, strict=True) if g], float), where)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(out[:, k], from_pandas=True) for k in range(4)]], [key, "x", "z", "y", "strength"])

    return df.select(key, amplitudes).mapInArrow(run, f"`{key}` {kind}, x double, z double, y double, strength double")
