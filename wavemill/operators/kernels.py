"""Kernels that are sequential inside a group: Arrow batches per unit, numpy inside. Groups are units or chunks of bounded size."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def isotonic(y: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """Non-decreasing least-squares fit by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, m in zip(y, np.ones(len(y)) if w is None else w, strict=True):
        blocks.append([float(v), float(m), 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            m = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / m, m, a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def by_group(df: DataFrame, keys: list[str], order: list[str], run, schema: str) -> DataFrame:
    """``run``(rows of one group, in order, keys and all) for each group. Groups are dealt whole into sorted partitions and taken batch
    by batch, so many small groups cost what their rows cost; no more than a batch and the group that it cuts is held."""

    def batches(frames):
        rest = None
        for p in frames:
            p = p if rest is None else pd.concat([rest, p], ignore_index=True)
            cut = np.flatnonzero(np.any([(p[k].ne(p[k].shift()) & ~(p[k].isna() & p[k].shift().isna())).to_numpy() for k in keys], axis=0))
            if len(p) and (not len(cut) or cut[0]):
                cut = np.concatenate([[0], cut])
            if len(cut) > 1:
                yield from whole(p.iloc[: cut[-1]], cut[:-1])
            rest = p.iloc[cut[-1] :].reset_index(drop=True) if len(cut) else p
        if rest is not None and len(rest):
            yield from whole(rest, np.array([0]))

    def whole(p, starts):
        got = run(p, starts)
        if len(got):
            yield got

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(batches, schema)


def isotonic_fit(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """df with ``fit``, the non-decreasing fit of y over x per key."""

    def run(p: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        v = p[y].to_numpy()
        return p.assign(fit=np.concatenate([isotonic(part) for part in np.split(v, starts[1:])]))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return by_group(df, [key], [x, y], run, f"{fields}, fit double")


def best_subset(t: np.ndarray, score: np.ndarray, dead: int) -> np.ndarray:
    """Mask of the largest subset whose neighbours are ``dead`` or more apart; of those, the one of least score; of those, the one whose last event is earliest."""
    n, before, score = len(t), np.searchsorted(t, t - dead, "right").tolist(), score.tolist()
    best: list[tuple[int, float, int]] = [(0, 0.0, -1)]
    take: list[bool] = []
    for i in range(n):
        j = before[i]
        with_, without = (best[j][0] + 1, best[j][1] - score[i]), best[-1][:2]
        take.append(with_ > without)
        best.append((*(with_ if take[-1] else without), j))
    keep, i = np.zeros(n, bool), n
    while i:
        if take[i - 1]:
            keep[i - 1], i = True, best[i][2]
        else:
            i -= 1
    return keep


def enforce_refractory(df: DataFrame, unit: str, t: str, score: str, row_id: str, dead: int) -> DataFrame:
    """Rows kept after each run of events closer than ``dead`` was reduced to its best subset. Only runs of two or more reach Python."""
    from wavemill.operators.windows import sessions

    runs = sessions(df, unit, [t, row_id], t, dead - 1)
    size = runs.groupBy(unit, "run").agg(F.count(F.lit(1)).alias("_n"))
    runs, names = runs.join(size, [unit, "run"]), df.columns
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)

    def run(p: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        at, v = p[t].to_numpy(), p[score].to_numpy()
        keep = np.concatenate([best_subset(x, y, dead) for x, y in zip(np.split(at, starts[1:]), np.split(v, starts[1:]), strict=True)])
        return p.loc[keep, names]

    crowded = by_group(runs.where("_n > 1").drop("_n"), [unit, "run"], [t, row_id], run, fields)
    return runs.where("_n = 1").select(*df.columns).unionByName(crowded)


def principal_axes(df: DataFrame, array: str, rank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, axes, variances): one aggregation of sums and cross products per Arrow batch, then a small eigenproblem."""

    def run(batches):
        for b in batches:
            x = np.stack([np.asarray(v, float) for v in b[array]]) if len(b) else np.zeros((0, 0))
            if len(x):
                yield pd.DataFrame({"n": [len(x)], "s": [x.sum(0).tolist()], "g": [(x.T @ x).ravel().tolist()]})

    part = df.select(array).mapInPandas(run, "n long, s array<double>, g array<double>")
    add = lambda c: part.select(F.posexplode(c).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i")
    n = part.agg(F.sum("n")).first()[0]
    s = np.array([r.v for r in add("s").collect()])  # as long as one array
    g = np.array([r.v for r in add("g").collect()]).reshape(len(s), len(s))
    value, vector = np.linalg.eigh(g / n - np.outer(s / n, s / n))
    top = np.argsort(value)[::-1][:rank]
    axes = vector[:, top].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return s / n, axes, value[top]


def project(df: DataFrame, array: str, mean: np.ndarray, axes: np.ndarray, to: str = "scores") -> DataFrame:
    """Scores of each array on the axes, as JVM expressions."""
    row = [F.aggregate(F.zip_with(F.zip_with(array, F.lit([float(m) for m in mean]), lambda x, m: x - m), F.lit([float(v) for v in a]), lambda x, v: x * v), F.lit(0.0), lambda s, x: s + x) for a in axes]
    return df.withColumn(to, F.array(*row))


def matching_pursuit(trace: np.ndarray, templates: np.ndarray, threshold: float, dead: int = 5) -> list[tuple[int, int, float]]:
    """Greedy (start, template, gain) list: the objective 2 <x, t> - |t|^2 is searched, the best template subtracted, until none exceeds the threshold.

    Places are taken from a heap, and after a match only the gains of places that overlap it are computed anew. A match
    blocks its own place, so there are as many matches as places and templates at most.
    """
    x, out = trace.astype(float).copy(), []
    size = templates.shape[1]
    norms = (templates**2).sum(1)
    if len(x) < size:
        return out
    view = np.lib.stride_tricks.sliding_window_view(x, size)  # sees what is subtracted
    gain = 2 * templates @ view.T - norms[:, None]
    blocked = np.zeros(gain.shape, bool)
    heap = [(-float(gain[k, i]), int(k), int(i)) for k, i in np.argwhere(gain > threshold)]
    heapq.heapify(heap)
    while heap:
        g, k, i = heapq.heappop(heap)
        if blocked[k, i] or -g != gain[k, i]:  # taken, or changed since
            continue
        x[i : i + size] -= templates[k]
        blocked[k, max(0, i - dead) : i + dead + 1] = True
        out.append((i, k, -g))
        lo, hi = max(0, i - size + 1), i + size
        gain[:, lo:hi] = 2 * templates @ view[lo:hi].T - norms[:, None]
        for kk, j in np.argwhere((gain[:, lo:hi] > threshold) & ~blocked[:, lo:hi]):
            heapq.heappush(heap, (-float(gain[kk, lo + j]), int(kk), int(lo + j)))
    return out


def pursue(df: DataFrame, key: str, order: str | list[str], value: str, templates: np.ndarray, threshold: float) -> DataFrame:
    """Matching pursuit per series: (key, start, template, gain); start counts rows in order. A series is one task, so that no
    match is lost at a cut; time is n log n and memory linear in its rows."""
    kind = df.schema[key].dataType.simpleString()
    by = [order] if isinstance(order, str) else order

    def run(p: pd.DataFrame) -> pd.DataFrame:
        got = matching_pursuit(p.sort_values(by)[value].to_numpy(), templates, threshold)
        return pd.DataFrame([(p[key].iloc[0], *g) for g in got], columns=[key, "start", "template", "gain"])

    return df.select(*dict.fromkeys([key, *by, value])).groupBy(key).applyInPandas(run, f"{key} {kind}, start long, template long, gain double")


def linkage_merge(distance: np.ndarray, threshold: float, method: str = "complete") -> np.ndarray:
    """Cluster labels of a small distance matrix by agglomeration under the threshold."""
    groups, big = [[i] for i in range(len(distance))], {"complete": np.max, "average": np.mean, "single": np.min}[method]
    while len(groups) > 1:
        best = min(((float(big(distance[np.ix_(a, b)])), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j), key=lambda x: x)
        if best[0] > threshold:
            break
        groups[best[1]] += groups.pop(best[2])
    out = np.zeros(len(distance), int)
    for k, g in enumerate(sorted(groups, key=min)):
        out[g] = k
    return out


def block_tridiagonal(diagonal: list[np.ndarray], below: list[np.ndarray], rhs: list[np.ndarray]) -> list[np.ndarray]:
    """Solution of a symmetric block-tridiagonal system by forward elimination and back substitution."""
    d, r = [diagonal[0]], [rhs[0]]
    for k in range(1, len(diagonal)):
        m = np.linalg.solve(d[-1].T, below[k - 1].T).T
        d.append(diagonal[k] - m @ below[k - 1].T)
        r.append(rhs[k] - m @ r[-1])
    x = [np.linalg.solve(d[-1], r[-1])]
    for k in range(len(diagonal) - 2, -1, -1):
        x.insert(0, np.linalg.solve(d[k], r[k] - below[k].T @ x[0]))
    return x
