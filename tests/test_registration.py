import numpy as np
import pytest

from wavemill.operators import motion as M, solve as S


@pytest.mark.parametrize(("m", "stretch"), [(1, 4), (3, 12), (7, 1024)])
def test_elimination_equals_a_dense_solve(spark, m, stretch):
    rng = np.random.default_rng(m)
    n, full, entries = 150, np.zeros((150, 150)), []
    for i in range(n):
        for j in range(i + 1, min(n, (i // m + 2) * m)):
            if rng.random() < 0.7:
                a = float(rng.normal())
                full[i, j] = full[j, i] = a
                entries.append((i, j, a) if rng.random() < 0.5 else (j, i, a))
    weight = np.abs(full).sum(1) + 1
    full += np.diag(weight)
    entries += [(i, i, float(w) / 2) for i, w in enumerate(weight)] * 2 + [(3, 3, None), (None, 4, 1.0)]
    b = rng.normal(size=n)
    e = spark.createDataFrame(entries, "i long, j long, a double").repartition(3)
    r = spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)] + [(5, None)], "i long, b double")
    got = {x.i: x.x for x in S.solve(e, r, m, stretch).collect()}
    want = np.linalg.solve(full, b)
    assert sorted(got) == list(range(n)) and max(abs(got[i] - want[i]) for i in got) < 1e-6
    assert S.solve(e.limit(0), r.limit(0), m).collect() == []
    with pytest.raises(ValueError):
        S.solve(spark.createDataFrame([(0, 5 * m, 1.0)], "i long, j long, a double"), r, m)


def pairs_of(p: np.ndarray, span: int, rng, wrong: float = 0.0):
    out = []
    for i in range(len(p)):
        for j in range(i + 1, min(len(p), i + span + 1)):
            bad = 25.0 if rng.random() < wrong else 0.0
            out.append((i, j, float(p[j] - p[i] + rng.normal(0, 0.1) + bad), float(rng.uniform(0.5, 1)), bool(bad)))
    return out


def dense(rows, n: int) -> np.ndarray:
    a, b = np.zeros((n, n)), np.zeros(n)
    for i, j, lag, c, *_ in rows:
        w = c * c
        a[i, i] += w
        a[j, j] += w
        a[i, j] -= w
        a[j, i] -= w
        b[j] += w * lag
        b[i] -= w * lag
    x = np.linalg.lstsq(a, b, rcond=None)[0]
    return x - x.mean()


def test_outliers_are_trimmed(spark):
    rng = np.random.default_rng(1)
    n = 1400
    p = np.cumsum(rng.normal(0, 0.3, n))
    rows = pairs_of(p, 6, rng, 0.03)
    df = spark.createDataFrame([r[:4] for r in rows], "i long, j long, lag double, c double")
    run = lambda **k: np.array([r.displacement for r in M.solve_displacement(df, **k).orderBy("t").collect()])
    assert np.abs(run() - dense(rows, n)).max() < 1e-4
    kept, x = rows, None
    for _ in range(5):
        x = dense(kept, n)
        res = np.array([c * (x[j] - x[i] - lag) for i, j, lag, c, _ in rows])
        kept = [r for r, z in zip(rows, (res - res.mean()) / res.std(), strict=True) if abs(z) <= 2.5]
    got = run(sigma=2.5)
    assert np.abs(got - x).max() < 1e-4
    clean = dense([r for r in rows if not r[4]], n)
    assert np.abs(got - clean).max() < 0.5 < np.abs(run() - clean).max()


def laplacian(n: int) -> np.ndarray:
    g = np.eye(n) - 0.5 * np.eye(n, k=1) - 0.5 * np.eye(n, k=-1)
    g[0, 0] = g[-1, -1] = 0.5
    return g


def system(rows, n: int, k: int, time_prior: float, space_prior: float):
    """Matrix and right side of all windows over all times, by Kronecker products; unknown w * n + t."""
    a = np.kron(np.eye(k), time_prior * laplacian(n)) + space_prior * np.kron(laplacian(k), laplacian(n))
    b = np.zeros(n * k)
    for w, i, j, lag, c in rows:
        for x, y, d in ((i, j, lag), (j, i, -lag)):
            x, y, u = w * n + x, w * n + y, c * c
            a[x, x] += u
            a[y, y] += u
            a[x, y] -= u
            a[y, x] -= u
            b[y] += u * d
            b[x] -= u * d
    return a, b


def test_windows_in_one_system(spark):
    rng = np.random.default_rng(3)
    n, k = 60, 3
    true = np.stack([np.cumsum(rng.normal(0, 0.2, n)) + 0.03 * w * np.arange(n) for w in range(k)])
    rows = [(w, i, j, lag, c) for w in range(k) for i, j, lag, c, _ in pairs_of(true[w], 4, rng) if not (w == 1 and 20 < i < 30)]
    df = spark.createDataFrame(rows, "w long, i long, j long, lag double, c double")
    got = np.zeros((k, n))
    for r in M.register_windows(df, time_prior=0.7, space_prior=1.3).collect():
        got[r.w, r.t] = r.displacement
    a, b = system(rows, n, k, 0.7, 1.3)
    want = np.linalg.lstsq(a, b, rcond=None)[0].reshape(k, n)
    assert np.abs(got - (want - want.mean(1, keepdims=True))).max() < 1e-5
    assert np.abs(got - (true - true.mean(1, keepdims=True))).max() < 1.0
    # block by block: the first half is known and stays
    before = spark.createDataFrame([(t, w, float(true[w, t])) for w in range(k) for t in range(30)], "t long, w long, displacement double")
    online = np.zeros((k, n))
    for r in M.register_windows(df, time_prior=0.7, space_prior=0.0, before=before).collect():
        online[r.w, r.t] = r.displacement
    a, b = system(rows, n, k, 0.7, 0.0)
    old = np.array([t < 30 for _ in range(k) for t in range(n)])
    x = np.linalg.solve(a[~old][:, ~old], (b - a[:, old] @ true.ravel()[old])[~old])
    # pairs within the known half only add to known rows, so the later half's equations are the same
    assert np.abs(online[:, 30:].ravel() - x).max() < 1e-5 and not online[:, :30].any()
    assert M.register_windows(df.limit(0)).collect() == []


def test_drift_that_differs_by_depth_is_recovered(spark):
    """A random profile whose upper half moves one way and whose lower half the other, one bin at a time."""
    rng = np.random.default_rng(8)
    size, times = 240, 24
    profile = rng.random(2 * size + 200)
    rows = []
    for t in range(times):
        up, down = t // 3, -(t // 4)
        for d in range(size):
            move = down if d < size // 2 else up
            base = d - move + (0 if d < size // 2 else size + 100) + 50
            rows.append((t, d, float(profile[base])))
    cells = spark.createDataFrame(rows, "t long, d long, mean double")
    windows = M.depth_windows(spark, 0.0, float(size - 1), 2, 25.0).selectExpr("w", "CAST(d AS LONG) AS d", "weight").where("weight > 0.999")
    motion = M.register_windows(M.windowed_lags(cells, windows, 4, 3), least=0.8, time_prior=0.01, space_prior=0.01)
    got = np.zeros((2, times))
    for r in motion.collect():
        got[r.w, r.t] = r.displacement
    want = np.stack([-(np.arange(times) // 4), np.arange(times) // 3]) * 1.0
    assert np.abs(got - (want - want.mean(1, keepdims=True))).max() < 0.3


def test_displacement_between_bins_and_windows(spark):
    p = np.array([[0.0, 1, 4], [10, 20, 30]])
    motion = spark.createDataFrame([(t + 5, w, float(p[w, t])) for w in range(2) for t in range(3)], "t long, w long, displacement double")
    rng = np.random.default_rng(0)
    at = [(float(x), float(y), "s") for x, y in zip(rng.uniform(4, 9, 60), rng.uniform(-10, 60, 60), strict=True)] + [(None, 1.0, ""), (5.0, None, "")]
    df = spark.createDataFrame(at, "t double, depth double, displacement string")
    for r in M.displacement_at(df, motion, [10.0, 50.0], "t", "depth").collect():
        if r.t is None or r.depth is None:
            assert r.displacement is None
            continue
        ends = [np.interp(r.t, [5.5, 6.5, 7.5], row) for row in p]
        assert np.isclose(r.displacement, np.interp(r.depth, [10, 50], ends))
