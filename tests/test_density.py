import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.operators import density as D


def mutual(v: np.ndarray, k: int, reach: float) -> np.ndarray:
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    core = np.sort(d, 1)[:, k - 1]
    m = np.maximum(d, np.maximum(core[:, None], core[None]))
    m[m > reach] = np.inf
    return m


def components(m: np.ndarray, points: np.ndarray, below: float) -> list[np.ndarray]:
    left, out = set(points.tolist()), []
    while left:
        seen = [left.pop()]
        for i in seen:
            near = [j for j in np.flatnonzero(m[i] < below).tolist() if j in left]
            left.difference_update(near)
            seen += near
        out.append(np.array(sorted(seen)))
    return out


def bottleneck(m: np.ndarray, points: np.ndarray) -> float:
    """The heaviest edge that a spanning tree of the points needs."""
    best, left, worst = m[points[0]][points].copy(), np.ones(len(points), bool), 0.0
    left[0] = False
    while left.any():
        i = int(np.where(left, best, np.inf).argmin())
        worst, left[i] = max(worst, best[i]), False
        best = np.minimum(best, m[points[i]][points])
    return worst


def brute(v: np.ndarray, k: int, least: int, reach: float) -> list:
    """Labels from the whole matrix, by taking out all edges of the largest weight at once."""
    m, label = mutual(v, k, reach), [None] * len(v)

    def grow(points, birth):
        """(stability, members) of the best clusters within these points."""
        mine, stable = points, 0.0
        own = []
        while True:
            w = bottleneck(m, mine)
            rate = 1 / w
            pieces = components(m, mine, w)
            large = [p for p in pieces if len(p) >= least]
            own += [p for q in pieces if len(q) < least for p in q.tolist()]
            if len(large) != 1:
                stable += len(mine) * (rate - birth)
                break
            stable += (len(mine) - len(large[0])) * (rate - birth)
            mine = large[0]
        below = [grow(p, rate) for p in large]
        if below and sum(s for s, _ in below) > stable:
            return sum(s for s, _ in below), [c for _, cs in below for c in cs]
        return stable, [points.tolist()]

    for tree in components(m, np.arange(len(v)), np.inf):
        if len(tree) >= least:
            for c in grow(tree, 1 / reach)[1]:
                for p in c:
                    label[p] = c[0]
    return label


def clouds(seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal((0, 0), 0.6, (130, 2)), rng.normal((3.5, 0), 0.6, (130, 2)), rng.normal((2, 4), 0.3, (80, 2)), rng.normal((20, 20), 1, (60, 2)), rng.uniform(-3, 8, (100, 2))])


@pytest.mark.parametrize(("reach", "block"), [(5.0, 512), (2.0, 40)])
def test_labels_equal_the_whole_tree(spark, reach, block):
    v = clouds(int(reach))
    df = spark.createDataFrame([(i, float(x), float(y), "c") for i, (x, y) in enumerate(v)], "name long, x double, y double, core string")
    got = {r["name"]: r.cluster for r in D.cluster(df, "name", ["x", "y"], reach=reach, samples=8, least=25, block=block).collect()}
    want = brute(v, 8, 25, reach)
    assert got == dict(enumerate(want)) and len(set(want) - {None}) >= 3 and None in want


def test_forest_is_the_whole_minimum(spark):
    v = clouds(9)[::3]
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(v)], "id long, x double, y double")
    forest = D.mutual_forest(D.core_distances(df, ["x", "y"], 3.0, 5, 30), ["x", "y"], 3.0, 30).collect()
    m = mutual(v, 5, 3.0)
    whole = D.spanning_edges(m, 3.0)
    assert sorted((r.a, r.b) for r in forest) == sorted((a, b) for a, b, _ in whole) and np.isclose(sum(r.w for r in forest), sum(w for *_, w in whole))


def test_odd_points(spark):
    rows = [(i, 0.0, 0.0) for i in range(30)] + [(None, 1.0, 1.0), (40, None, 1.0), (41, float("nan"), 1.0), (42, 100.0, 100.0), (0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = {r.id: (r.cluster, r.strength) for r in D.cluster(df, "id", ["x", "y"], reach=1.0, samples=5, least=10).collect()}
    assert got == {i: (0, 1.0) for i in range(30)} | {42: (None, 0.0)}
    assert D.cluster(df.limit(0), "id", ["x", "y"], reach=1.0).collect() == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_weights_part_at_once(spark, seed):
    rng = np.random.default_rng(seed)
    v = np.argwhere(rng.random((20, 20)) < 0.45).astype(float)  # nearly all edges are equal
    v = np.concatenate([v, v[::7], v[::11]])[rng.permutation(len(v) + len(v[::7]) + len(v[::11]))]
    df = spark.createDataFrame([(i + (1 << 60), float(x), float(y)) for i, (x, y) in enumerate(v)], "id long, n double, radius double")
    got = {r.id - (1 << 60): r.cluster for r in D.cluster(df, "id", ["n", "radius"], reach=3.0, samples=4, least=7, block=40).collect()}
    assert got == {i: None if c is None else c + (1 << 60) for i, c in enumerate(brute(v, 4, 7, 3.0))}


@pytest.mark.parametrize("axes", [1, 3])
def test_forest_on_other_axes(spark, axes):
    rng = np.random.default_rng(axes)
    v = np.concatenate([rng.normal(0, 1, (90, axes)), rng.normal(6, 0.5, (60, axes)), np.argwhere(np.ones((4,) * axes)) + 12.0])
    xs = ["x", "y", "z"][:axes]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(v)], "id long, " + ", ".join(f"{x} double" for x in xs))
    m = mutual(v, 4, 9.0)
    whole = sorted((a, b) for a, b, _ in D.spanning_edges(m, 9.0))
    for left in (0, 1000):  # edges that the last group may hold
        forest = D.mutual_forest(D.core_distances(df, xs, 9.0, 4, 20), xs, 9.0, 20, left).collect()
        assert sorted((r.a, r.b) for r in forest) == whole


def test_places_without_end(spark):
    rows = [(i, float(i % 4), float(i // 4)) for i in range(16)] + [(20, float("inf"), 0.0), (21, 1.0, -float("inf")), (22, 900.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    for reach in (5.0, float("inf")):
        got = {r.id: r.cluster for r in D.cluster(df, "id", ["x", "y"], reach=reach, samples=2, least=5, block=4).collect()}
        assert got == {i: 0 for i in range(16)} | {20: None, 21: None, 22: 0 if reach > 5 else None}


def test_work_grows_with_the_points(spark):
    """Rows that tasks read and write: all points lie within reach of each other."""
    sizes = []
    for n in (2000, 8000):
        v = np.random.default_rng(n).normal(0, 1, (n, 2))
        df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(v)], "id long, x double, y double")
        places, _ = D._places(df, ["x", "y"])
        cuts = D._cuts(places, ["x", "y"], 128)
        cores = D._cores(places, ["x", "y"], 20.0, 10, cuts)
        sights = D._sights(cores, ["x", "y"], 20.0, cuts)
        rims = D._rims(cores, ["x", "y"], 20.0, sights).count()
        visits = D._dealt(cores.select(F.col("home").alias("id"), "x", "y", F.col("seen").alias("radius")), ["x", "y"], cuts).count()
        sizes.append((visits, sights.count(), rims))
        assert visits < 6 * n and sizes[-1][1] < 24 * n and rims < n / 4, sizes
