import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.operators import latent as L


def made(n=600, c=8, r=2, noise=0.1):
    g = np.random.default_rng(3)
    w, mean = g.normal(0, 1, (c, r)), g.normal(0, 2, c)
    whole = mean + g.normal(0, 1, (n, r)) @ w.T + g.normal(0, noise, (n, c))
    masks = g.random((12, c)) < 0.3
    masks[:, 0] = False
    return w, mean, whole, masks[g.integers(0, 12, n)]


def likelihood(x, gone, m):
    """Row by row, by the dense covariance."""
    total, cov = 0.0, m.weights @ m.weights.T + m.noise * np.eye(len(m.mean))
    for v, hidden in zip(x, gone, strict=True):
        o = np.flatnonzero(~hidden)
        d, k = v[o] - m.mean[o], cov[np.ix_(o, o)]
        total -= 0.5 * (len(o) * np.log(2 * np.pi) + np.linalg.slogdet(k)[1] + d @ np.linalg.solve(k, d))
    return total


def test_fit_and_fill(spark):
    w, mean, x, gone = made()
    rows = [(i, [None if h else float(v) for v, h in zip(a, b, strict=True)]) for i, (a, b) in enumerate(zip(x, gone, strict=True))]
    df = spark.createDataFrame(rows, "id long, x array<double>").repartition(3)
    m = L.fit(df, "x", 2, rounds=20)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(m.history, m.history[1:]))  # never falls
    before = L.fit(df, "x", 2, rounds=3)
    after = L.fit(df, "x", 2, rounds=4)
    assert np.isclose(after.history[3], likelihood(x, gone, before)) and likelihood(x, gone, m) >= m.history[-1] - 1e-4
    assert likelihood(x, gone, m) > likelihood(x, gone, L.Model(w, mean, 0.01, []))  # likelier than what made the rows
    assert np.abs(m.weights @ m.weights.T - np.cov(x.T)).max() < 0.1 and abs(m.noise - 0.01) < 0.001
    cov = m.weights @ m.weights.T + m.noise * np.eye(8)
    error = []
    for r in L.fill(df, "x", m).collect():
        o, h = np.flatnonzero(~gone[r.id]), np.flatnonzero(gone[r.id])
        want = x[r.id].copy()
        want[h] = m.mean[h] + (cov - m.noise * np.eye(8))[np.ix_(h, o)] @ np.linalg.solve(cov[np.ix_(o, o)], x[r.id, o] - m.mean[o])
        assert np.allclose(r.filled, want) and len(r.scores) == 2
        error += list(np.array(r.filled)[h] - x[r.id, h])
    assert np.sqrt(np.mean(np.square(error))) < 0.4  # against a spread of about 1.4


def test_odd_rows(spark):
    _, _, x, gone = made(60)
    rows = [(i, [None if h else float(v) for v, h in zip(a, b, strict=True)]) for i, (a, b) in enumerate(zip(x, gone, strict=True))]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    m = L.fit(df, "x", 1, rounds=3)
    nan = df.withColumn("x", F.transform("x", lambda v: F.coalesce(v, F.lit(float("nan"))))).withColumns({"seen": F.lit(1), "filled": F.lit(2), "sums": F.lit("")})
    nan = nan.unionByName(spark.createDataFrame([(100, None, 1, 2, ""), (101, [], 1, 2, ""), (102, [None] * 8, 1, 2, "")], "id long, x array<double>, seen int, filled int, sums string"))
    again = L.fit(nan, "x", 1, rounds=3)
    assert np.allclose(again.weights, m.weights) and np.allclose(again.mean, m.mean) and np.isclose(again.noise, m.noise)
    odd = {r.id: r for r in L.fill(nan, "x", m, to="whole").collect()}
    assert all(np.allclose(odd[i].whole, m.mean) and odd[i].scores == [0.0] for i in (100, 101, 102))
    unseen = L.fit(df.withColumn("x", F.transform("x", lambda v, i: F.when(i != 4, v))), "x", 1, rounds=2)
    assert unseen.mean[4] == 0 and unseen.weights[4, 0] == 0
    with pytest.raises(ValueError):
        L.fit(df.limit(0), "x", 1)
