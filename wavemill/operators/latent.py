"""Latent factors of arrays with missing entries, fitted on statistics by pattern of what is there.

Rows with the same places present enter a fit only through their number, sum and outer products, so these are summed once on
executors and rounds of expectation and maximisation run over patterns, not rows. The driver holds the model and one set of sums,
channels x (factors + 1)^2. The patterns' table takes channels^2 numbers a pattern; it is small where channels go missing
together, as on a probe, and at worst has a row for each row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from wavemill.operators.order import written


@dataclass
class Model:
    """x = mean + weights @ u + noise, u standard normal; ``fit`` also keeps the log likelihood before each round."""

    weights: np.ndarray
    mean: np.ndarray
    noise: float
    history: list[float]


def clean(x: str) -> Column:
    """Arrays of doubles with nulls for what is no number."""
    return F.transform(x, lambda v: F.when(~F.isnan(v.cast("double")), v.cast("double")))


def summed(parts: DataFrame, by: list[str], x: str) -> DataFrame:
    """Arrays of one length per group added place by place, with partial sums before the shuffle."""
    flat = parts.select(*by, F.posexplode(x).alias("_at", "_v")).groupBy(*by, "_at").agg(F.sum("_v").alias("_v"))
    return flat.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda r: r["_v"]).alias(x))


def statistics(rows: DataFrame, x: str) -> DataFrame:
    """(seen: places present, sums: [n, sum of each, outer products]) per pattern; rows without any entry are left out."""
    v = rows.select(clean(x).alias("x"))
    places = F.filter(F.transform("x", lambda v, i: F.when(v.isNotNull(), i)), lambda i: i.isNotNull())
    v = v.select(places.alias("seen"), F.filter("x", lambda v: v.isNotNull()).alias("x")).where(F.size("seen") > 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for seen, g in p.assign(key=[tuple(s) for s in p["seen"]]).groupby("key"):
                m = np.stack(list(g["x"]))
                out.append((list(seen), np.concatenate([[float(len(m))], m.sum(0), (m.T @ m).ravel()])))
            yield pd.DataFrame(out, columns=["seen", "sums"])

    return summed(v.mapInPandas(run, "seen array<int>, sums array<double>"), ["seen"], "sums")


def _round(patterns: DataFrame, model: Model) -> np.ndarray:
    """Per channel [products of (u, 1) with itself, with x, x^2, n] over rows that have it; a last row has the first over all rows, and the likelihood."""
    shared = patterns.sparkSession.sparkContext.broadcast((model.weights, model.mean, model.noise))  # channels x factors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, mean, noise = shared.value
        c, r = w.shape
        total = np.zeros((c + 1, (r + 1) ** 2 + (r + 1) + 3))
        for p in batches:
            for seen, sums in zip(p["seen"], p["sums"], strict=True):
                seen, k = np.asarray(seen), len(seen)
                n, s, ss = sums[0], sums[1 : k + 1], sums[k + 1 :].reshape(k, k)
                wo, mo = w[seen], mean[seen]
                inverse = np.linalg.inv(wo.T @ wo + noise * np.eye(r))
                b = inverse @ wo.T
                s1, s2 = s - n * mo, ss - np.outer(s, mo) - np.outer(mo, s) + n * np.outer(mo, mo)
                u = b @ s1
                square = np.empty((r + 1, r + 1))
                square[:r, :r], square[:r, r], square[r, :r], square[r, r] = n * noise * inverse + b @ s2 @ b.T, u, u, n
                with_x = np.column_stack([s2 @ b.T + np.outer(mo, u), s])
                cov = wo @ wo.T + noise * np.eye(k)
                like = -0.5 * (n * (k * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1]) + np.trace(np.linalg.solve(cov, s2)))
                total[seen, : (r + 1) ** 2] += square.ravel()
                total[seen, (r + 1) ** 2 : -3] += with_x
                total[seen, -3] += np.diag(ss)
                total[seen, -2] += n
                total[c, : (r + 1) ** 2] += square.ravel()
                total[c, -1] += like
        yield pd.DataFrame({"all": [1], "sums": [total.ravel()]})

    got = summed(patterns.mapInPandas(run, "all int, sums array<double>"), ["all"], "sums").first().sums
    shared.unpersist()
    return np.array(got).reshape(len(model.mean) + 1, -1)


def fit(rows: DataFrame, x: str, factors: int, rounds: int = 50, tolerance: float = 1e-7, seed: int = 0) -> Model:
    """The likeliest model by rounds that never lower the likelihood, until it gains less than ``tolerance`` of its size.

    Nulls and NaN are missing. A channel that no row has gets weights and mean 0. ValueError if nothing is present."""
    patterns = written(statistics(rows, x), "patterns")
    c = patterns.agg(F.max(F.element_at("seen", -1))).first()[0]
    if c is None:
        raise ValueError("no entry is present")
    c += 1
    start = _round(patterns, Model(np.zeros((c, 1)), np.zeros(c), 1.0, []))[:-1]
    n, sums, squares = np.maximum(start[:, -2], 1), start[:, 5], start[:, -3]
    mean, variance = sums / n, np.maximum(squares / n - (sums / n) ** 2, 0)
    spread = np.sqrt(variance)[:, None] / np.sqrt(factors)
    model = Model(np.random.default_rng(seed).normal(0, 1, (c, factors)) * spread, mean, max(float(variance.mean()) / 2, 1e-12), [])
    for _ in range(rounds):
        t = _round(patterns, model)
        model.history.append(float(t[-1, -1]))
        if len(model.history) > 1 and model.history[-1] - model.history[-2] < tolerance * abs(model.history[-1]):
            break
        r1 = factors + 1
        square, with_x, squares, n = t[:-1, : r1 * r1].reshape(c, r1, r1), t[:-1, r1 * r1 : -3], t[:-1, -3], t[:-1, -2]
        both = np.zeros((c, r1))
        for k in np.flatnonzero(n > 0):
            both[k] = np.linalg.lstsq(square[k], with_x[k], rcond=None)[0]
        rest = squares - 2 * (both * with_x).sum(1) + np.einsum("ki,kij,kj->k", both, square, both)
        whole = t[-1, : r1 * r1].reshape(r1, r1) / t[-1, r1 * r1 - 1]  # factors get a mean and covariance too, folded into the model: faster
        centre, cov = whole[:-1, -1], whole[:-1, :-1] - np.outer(whole[:-1, -1], whole[:-1, -1])
        model = Model(both[:, :-1] @ np.linalg.cholesky(cov), both[:, -1] + both[:, :-1] @ centre, max(float(rest.sum() / n.sum()), 1e-12), model.history)
    return model


def fill(rows: DataFrame, x: str, model: Model, to: str = "filled", scores: str = "scores") -> DataFrame:
    """``rows`` with ``to``: x whose missing entries are what the present ones make likeliest, and ``scores``: the factors' means.

    Arrays are cut or filled to the model's channels; a null or empty array gives the mean and scores of 0."""
    shared = rows.sparkSession.sparkContext.broadcast((model.weights, model.mean, model.noise))

    @F.pandas_udf("filled array<double>, scores array<double>")
    def run(xs: pd.Series) -> pd.DataFrame:
        w, mean, noise = shared.value
        c, r = w.shape
        v = np.full((len(xs), c), np.nan)
        for i, a in enumerate(xs):
            a = np.asarray([] if a is None else a, float)[:c]
            v[i, : len(a)] = a
        seen, u = ~np.isnan(v), np.zeros((len(v), r))
        kinds, which = np.unique(seen, axis=0, return_inverse=True)
        for k, o in enumerate(kinds):
            at = np.flatnonzero(which.ravel() == k)
            b = np.linalg.solve(w[o].T @ w[o] + noise * np.eye(r), w[o].T)
            u[at] = (v[np.ix_(at, np.flatnonzero(o))] - mean[o]) @ b.T
        return pd.DataFrame({"filled": list(np.where(seen, v, mean + u @ w.T)), "scores": list(u)})

    got = rows.withColumn("_got", run(clean(x)))
    return got.withColumns({to: F.col("_got.filled"), scores: F.col("_got.scores")}).drop("_got")
