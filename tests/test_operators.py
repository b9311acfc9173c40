"""Known answers, and each query against its SQL twin on the smallest tables."""

import itertools
import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from wavemill import catalog
from wavemill.operators import joins as J, kernels as K, localise as P, motion as M, windows as W
from wavemill.sources import flatbinary
from wavemill.streaming import online

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def rows(df, cols):
    plain = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else [plain(x) for x in v] if isinstance(v, (list, np.ndarray)) else float(v) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else v
    return sorted((tuple(str(plain(v)) for v in r) for r in df[cols].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_extrema_and_suppression(spark):
    v = [-10.0 if t == 20 else -8.0 if t == 40 else 0.0 for t in range(60)]
    df = spark.createDataFrame([(1, t, x) for t, x in enumerate(v)], "k int, t long, v double")
    assert [r.t for r in W.local_extrema(df, "k", ["t"], "v", threshold=5, sign="neg").orderBy("t").collect()] == [20, 40]
    e = spark.createDataFrame([(1, 20, 10.0), (1, 25, 9.0), (1, 30, 9.0)], "k int, t long, e double")
    for chunk in (None, 4, 10, 1000):
        assert sorted(r.t for r in W.suppress_in_time(e, "k", "t", "e", 7, chunk).collect()) == [20, 30]


def test_agreement_and_correlogram(spark):
    s = lambda ts, lo: spark.createDataFrame([(t, lo + i) for i, t in enumerate(ts)], "t long, id long")
    got = J.agreement(s([0, 100, 205], 0), s([3, 103, 400], 10), "t", 12).orderBy("id_a").collect()
    assert [(r.id_a, r.id_b) for r in got] == [(0, 10), (1, 11)]
    a, b = s([0, 1, 2], 0).toDF("ta", "ia"), s([0, 1, 2], 0).toDF("tb", "ib")
    assert {r.lag: r.n for r in J.correlogram(a, b, "ta", "tb", 1, 2).collect()} == {-2: 0, -1: 2, 0: 3, 1: 2, 2: 0}


def test_interpolation_and_islands(spark):
    q, k = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (0.5,)], "x double"), spark.createDataFrame([(0.5, 1.0), (1.5, 3.0)], "kx double, ky double")
    assert {r.x: r.y for r in J.interpolate(q, k, "x", "kx", "ky", "y").collect()} == {0.0: 1.0, 0.5: 1.0, 1.0: 2.0, 2.0: 3.0}
    n = spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 8, 10)], "n long")
    assert sorted((r.first, r.last) for r in W.islands(n, None, "n").collect()) == [(1, 3), (7, 8), (10, 10)]


def test_kernels():
    assert K.isotonic(np.array([3.0, 1.0, 2.0])).tolist() == [2.0, 2.0, 2.0]
    assert K.best_subset(np.array([0, 5, 100]), np.array([1.0, 2.0, 1.0]), 10).tolist() == [True, False, True]
    t = np.sort(np.random.default_rng(0).integers(0, 60, 11))
    s = np.random.default_rng(1).random(11)
    sets = [c for k in range(12) for c in itertools.combinations(range(11), k) if all(t[j] - t[i] >= 7 for i, j in itertools.pairwise(c))]
    best = min(sets, key=lambda c: (-len(c), sum(s[i] for i in c)))
    assert np.flatnonzero(K.best_subset(t, s, 7)).tolist() == list(best)
    rng = np.random.default_rng(2)
    got = K.matching_pursuit(np.array([0, 0, 1, 3, 1, 0, 0, 0, 1, 3, 1.0]), np.array([[1.0, 3.0, 1.0]]), 5)
    assert sorted(g[0] for g in got) == [2, 8]
    d = [np.eye(2) * 4 for _ in range(4)]
    low, r = [np.eye(2) * -1 for _ in range(3)], [np.arange(2.0) + k for k in range(4)]
    full = np.zeros((8, 8))
    for k in range(4):
        full[2 * k : 2 * k + 2, 2 * k : 2 * k + 2] = d[k]
        if k:
            full[2 * k : 2 * k + 2, 2 * k - 2 : 2 * k] = low[k - 1]
            full[2 * k - 2 : 2 * k, 2 * k : 2 * k + 2] = low[k - 1].T
    assert np.allclose(np.concatenate(K.block_tridiagonal(d, low, r)), np.linalg.solve(full, np.concatenate(r)))
    assert K.linkage_merge(np.array([[0, 1, 9], [1, 0, 9], [9, 9, 0.0]]), 2).tolist() == [0, 0, 1]


def test_known_shift_is_recovered(spark):
    shape = {10: 1.0, 11: 4.0, 12: 2.0, 15: 3.0}
    shift = [0, 1, 2, 1, 0]
    cells = spark.createDataFrame([(t, d + s, v) for t, s in enumerate(shift) for d, v in shape.items()], "t long, d long, mean double")
    p = {r.t: r.displacement for r in M.solve_displacement(M.pair_lags(cells, 3)).collect()}
    assert np.allclose([p[t] - p[0] for t in range(5)], shift)


def test_flat_binary_round_trip(spark, tmp_path):
    x = np.arange(70, dtype=np.int16).reshape(-1, 7)
    x.tofile(tmp_path / "r.bin")
    flatbinary.register(spark)
    df = spark.read.format("flatbinary").option("path", str(tmp_path / "r.bin")).options(channels=5, sync=2, dtype="int16", chunk=3).load()
    got = df.orderBy("sample", "channel").toPandas()
    assert (got.v.to_numpy().reshape(-1, 5) == x[:, :5]).all()
    with pytest.raises(ValueError):
        flatbinary.length_in_samples(11, 5)


def test_stream_equals_batch(spark, sf, tmp_path):
    e = catalog.stream(spark, sf).select("unit", "t", "event_id").orderBy("t")
    src = str(tmp_path / "in")
    e.coalesce(1).write.parquet(src)
    s = spark.readStream.schema(e.schema).parquet(src)
    q = online.refractory_stream(s, "unit", "t", "event_id", 6 * catalog.HOUR).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    last, want = {}, set()
    for r in e.orderBy("t", "event_id").collect():
        if r.unit not in last or r.t - last[r.unit] >= 6 * catalog.HOUR:
            last[r.unit] = r.t
            want.add(r.event_id)
    assert {r.event_id for r in spark.table("kept").collect()} == want


def test_append_resumes(spark, tmp_path):
    df = spark.range(10).select("id", (catalog.F.col("id") * 10).alias("t"))
    path = str(tmp_path / "sink")
    assert online.append_new(spark, df.where("t < 50"), "t", path) == 5
    assert online.append_new(spark, df, "t", path) == 5 and online.append_new(spark, df, "t", path) == 0
    assert spark.read.parquet(path).count() == 10


def test_peaks_before_the_middle_are_aligned(spark, sf):
    got = {r.vec_id: r for r in catalog.QUERIES["peak_alignment_whole"](spark, sf).collect()}
    rows = catalog.snippets(spark, sf).collect()
    assert len(got) == len(rows) and any(r.shift < 0 for r in got.values()) and any(r.shift > 0 for r in got.values())
    for r in rows:
        x = np.array(r.x)
        k = int(x.argmax()) - 32
        k = k if abs(k) <= 16 else 0
        want = np.pad(x, (max(0, -k), max(0, k)), mode="linear_ramp")[max(0, k) :][: len(x)]
        assert got[r.vec_id].shift == k and np.allclose(got[r.vec_id].aligned, want, atol=2e-6)


def plain_pursuit(x, templates, threshold, dead=5):
    """Every gain computed anew in each round, without a bound on rounds."""
    x, size, norms, out = x.astype(float).copy(), templates.shape[1], (templates**2).sum(1), []
    blocked = np.zeros((len(templates), len(x) - size + 1), bool)
    while True:
        gain = np.where(blocked, -np.inf, 2 * templates @ np.lib.stride_tricks.sliding_window_view(x, size).T - norms[:, None])
        k, i = np.unravel_index(int(np.argmax(gain)), gain.shape)
        if gain[k, i] <= threshold:
            return out
        x[i : i + size] -= templates[k]
        blocked[k, max(0, i - dead) : i + dead + 1] = True
        out.append((int(i), int(k)))


def test_pursuit_goes_on_until_no_gain_is_left(spark):
    one = np.array([[1.0, 3.0, 1.0]])
    assert sorted(g[0] for g in K.matching_pursuit(np.tile([0, 0, 1, 3, 1, 0, 0, 0], 700), one, 5)) == [8 * i + 2 for i in range(700)]
    two = np.array([[1.0, 3.0, 1.0], [2.0, -2.0, 2.0]])
    for seed in range(5):
        x = np.random.default_rng(seed).integers(0, 8, 900).astype(float) * 1.37 + np.random.default_rng(seed + 9).random(900)
        got = [(i, k) for i, k, _ in K.matching_pursuit(x, two, 3.0)]
        assert len(got) > 200 and got == plain_pursuit(x, two, 3.0)
    day = 86_400_000_000
    rows = [(1, i, (59 * 24 + 22 + i) * day // 24, v) for i, v in enumerate([0.0, 1.0, 3.0, 1.0, 0.0])]  # over a boundary of 60 days
    df = spark.createDataFrame(rows, "unit long, event_id long, t long, v double")
    assert [r.start for r in K.pursue(df, "unit", ["t", "event_id"], "v", one, 5).collect()] == [1]


def test_pursuit_takes_a_unit_whole(spark, sf):
    e, shape = catalog.stream(spark, sf).toPandas(), np.array([[1.0, 3.0, 1.0], [2.0, 2.0, 2.0]]) * 20
    want = {(u, i, k) for u, p in e.groupby("unit") if len(p) >= 3 for i, k in plain_pursuit(p.sort_values(["t", "event_id"]).v.to_numpy(), shape, 2000.0)}
    assert {(r.unit, r.start, r.template) for r in catalog.QUERIES["matching_pursuit"](spark, sf).collect()} == want


def test_clamp_covers_the_whole_array(spark, sf):
    x = {r.vec_id: np.array(r.x) for r in catalog.snippets(spark, sf).collect()}
    for r in catalog.QUERIES["monotone_clamp_whole"](spark, sf).collect():
        m, v = np.abs(r.clamped), x[r.vec_id]
        assert len(m) == len(v) and (np.diff(m[:21]) >= 0).all() and (np.diff(m[44:]) <= 0).all()
        assert np.allclose(r.clamped[20:45], v[20:45], atol=1e-6)


def test_overlap_has_every_customer(spark, sf):
    units = {r[0] for r in catalog.table(spark, sf, "orders").select("o_custkey").distinct().collect()}
    assert {r.a for r in catalog.QUERIES["channel_overlap_whole"](spark, sf).select("a").distinct().collect()} == units


def test_point_sources_are_located(spark):
    rng = np.random.default_rng(3)
    places = [((i % 4) * 16.0, (i // 4) * 20.0) for i in range(64)]
    at = np.array(places)
    truth = np.column_stack([rng.uniform(5, 45, 40), rng.uniform(60, 240, 40), rng.uniform(8, 50, 40), rng.uniform(50, 400, 40)])
    r = np.sqrt((at[None, :, 0] - truth[:, :1]) ** 2 + (at[None, :, 1] - truth[:, 1:2]) ** 2 + truth[:, 2:3] ** 2)
    rows = [(i, (truth[i, 3] / r[i]).tolist()) for i in range(40)] + [(90, None), (91, [1.0])]
    got = {x.k: x for x in P.locate(spark.createDataFrame(rows, "k long, a array<double>"), "k", "a", places).collect()}
    for i, t in enumerate(truth):
        assert np.allclose([got[i].x, got[i].z, got[i].y, got[i].strength], t, rtol=1e-3, atol=1e-2)
    assert got[90].x is None and got[91].strength is None


def test_nearest_points_beyond_the_first_grid(spark, monkeypatch):
    """Two far clusters and a lone point: searches widen until each has its neighbours; brute force over all pairs."""
    rng = np.random.default_rng(6)
    pts = [*rng.uniform(0, 3, (30, 2)).tolist(), *rng.uniform(900, 903, (3, 2)).tolist(), [5000.0, -40.0], [1.0, 1.0], [1.0, 1.0]]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "k long, x double, z double")
    got, evenly = (sorted((r.k, r["rank"], r.other) for r in J.knn(df, "k", ["x", "z"], 4, cell).collect()) for cell in (0.5, None))
    want = []
    for i, p in enumerate(pts):
        d = sorted((math.sqrt((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2), j) for j, q in enumerate(pts) if j != i)
        want += [(i, n + 1, j) for n, (_, j) in enumerate(d[:4])]
    assert got == sorted(want) and evenly == got
    monkeypatch.setattr(J, "BLOCK", 7)
    assert sorted((r.k, r["rank"], r.other) for r in J.knn(df, "k", ["x", "z"], 4).collect()) == got
    assert J.knn(df.limit(0), "k", ["x", "z"], 4).count() == 0


def test_interpolation_by_stretches(spark, monkeypatch):
    monkeypatch.setattr(J, "KNOTS", 3)
    rng = np.random.default_rng(1)
    kx = np.sort(rng.uniform(-5, 100, 60)) ** 2 * np.sign(rng.uniform(-1, 3, 60))
    ky, x = rng.normal(size=60), np.concatenate([rng.uniform(-3000, 11000, 300), kx])
    for keys in ([], ["u"]):
        q = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(x)], "u int, x double")
        k = spark.createDataFrame([(int(i % 2), float(a), float(b)) for i, (a, b) in enumerate(zip(kx, ky))], "u int, kx double, ky double")
        for r in J.interpolate(q, k if keys else k.drop("u"), "x", "kx", "ky", "y", keys).collect():
            mine = np.arange(60) % 2 == r.u if keys else np.ones(60, bool)
            order = np.argsort(kx[mine])
            assert abs(r.y - np.interp(r.x, kx[mine][order], ky[mine][order])) < 1e-9
    empty = J.interpolate(q, k.limit(0), "x", "kx", "ky", "y", ["u"]).collect()
    assert len(empty) == len(x) and all(r.y is None for r in empty)
