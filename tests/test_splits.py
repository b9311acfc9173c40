import itertools

import numpy as np
import pytest

from wavemill.operators import splits as S


def fits(y, w):
    """Least squared error of every way to pool a sequence into non-decreasing blocks."""
    best = (np.inf, None)
    for cuts in itertools.product((0, 1), repeat=len(y) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(y)]
        means = [np.average(y[a:b], weights=w[a:b]) for a, b in itertools.pairwise(at)]
        if all(a <= b + 1e-12 for a, b in itertools.pairwise(means)):
            f = np.repeat(means, np.diff(at))
            e = float((w * (f - y) ** 2).sum())
            best = min(best, (e, f), key=lambda x: x[0])
    return best


def test_monotone_fits_match_every_pooling():
    rng = np.random.default_rng(0)
    for n in range(1, 8):
        for _ in range(12):
            y, w = rng.normal(size=n).round(1), rng.integers(1, 5, n) * 1.0
            fit, error = S.rising(y, w)
            assert np.allclose(fit, fits(y, w)[1])
            assert np.allclose(error, [fits(y[: k + 1], w[: k + 1])[0] for k in range(n)])
            err = lambda f: float((w * (f - y) ** 2).sum())
            down = lambda a, b: fits(-a, b)[0] if len(a) else 0.0
            up = lambda a, b: fits(a, b)[0] if len(a) else 0.0
            assert np.isclose(err(S.unimodal(y, w)), min(up(y[:k], w[:k]) + down(y[k:], w[k:]) for k in range(n + 1)))
            assert np.isclose(err(S.antimodal(y, w)), min(down(y[:k], w[:k]) + up(y[k:], w[k:]) for k in range(n + 1)))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 57, 1000, 12_345])
def test_knots_part_the_places(n):
    at = S.knot_places(n)
    gap = np.diff(at)
    assert at[0] == 0 and at[-1] == n - 1 and (gap >= 1).all()
    if n > 100:
        assert abs(len(gap) - np.sqrt(n / 2)) < 2 and gap[len(gap) // 2] > 5 * gap[0] / 2 and abs(gap[0] - gap[-1]) <= 1


def local(x, threshold=1.5, least=10, diameter=0.0):
    """The same tree of cuts over whole arrays."""
    x, out, left = np.sort(x), [], [(-np.inf, np.inf)]
    while left:
        lo, hi = left.pop()
        y = x[(x > lo) & (x <= hi)]
        if len(y) >= 2 * least:
            at = S.knot_places(len(y))
            score, gap = S.dip(y[at], at.copy())
            if gap >= 0 and score >= threshold:
                cut = (y[at[gap]] + y[at[gap + 1]]) / 2
                if cut - lo >= diameter and hi - cut >= diameter and min((y <= cut).sum(), (y > cut).sum()) >= least:
                    left += [(lo, cut), (cut, hi)]
                    continue
        out.append((lo, hi, len(y)))
    return sorted(out)


def samples():
    rng = np.random.default_rng(0)
    return {
        0: rng.normal(0, 1, 2000),
        1: np.concatenate([rng.normal(0, 1, 1500), rng.normal(8, 1, 1500)]),
        2: np.concatenate([rng.normal(m, 0.5, 600) for m in (0, 4, 9, 15)]),
        3: rng.integers(0, 5, 400) * 1.0,
        4: np.array([1.0, 2, 3]),
        5: rng.exponential(3, 2000),
        6: np.zeros(50),
    }


def test_parts_equal_the_local_tree(spark):
    data = samples()
    rows = [(k, float(x), "extra") for k, v in data.items() for x in v] + [(7, None, ""), (8, float("nan"), ""), (1, None, ""), (1, float("nan"), "")]
    df = spark.createDataFrame(rows, "g long, x double, first string")
    for rule in ({}, {"least": 700}, {"diameter": 4.5}):
        got = {}
        for r in S.parts(df, ["g"], "x", **rule).collect():
            got.setdefault(r.g, []).append((r.low, r.high, r.size))
        assert {k: sorted(v) for k, v in got.items()} == {k: local(v, **rule) for k, v in data.items()}
    assert [len(local(data[k])) for k in (0, 1, 2, 5)] == [1, 2, 4, 1]  # the mixtures as made
    out = S.split(df, ["g"], "x").groupBy("g", "part").count().collect()
    assert {(r.g, r.part): r["count"] for r in out if r.g in (1, 7, 8)} == {(1, 0): 1502, (1, 1): 1500, (7, 0): 1, (8, 0): 1}
    scores = {r.g: r for r in S.dip_test(df, "g", "x").collect()}
    assert scores[1].score > 10 and 2 < scores[1].cut < 6 and scores[0].score < 1.5 and (scores[4].score, scores[4].cut, scores[6].cut) == (0.0, None, None)
    assert S.parts(df.limit(0), ["g"], "x").collect() == [] and S.dip_test(df.limit(0), "g", "x").collect() == []


def test_groups_split_along_all_axes(spark):
    """Four clouds at the corners of a square, in one of two groups: one axis parts two and two."""
    rng = np.random.default_rng(5)
    rows = [(0, 10 * c + k, *(float(v) for v in rng.normal((9 * a, 9 * b), 1))) for c, (a, b) in enumerate(itertools.product((0, 1), repeat=2)) for k in range(200)]
    rows = [(u, i // 1000 + n, x, y) for n, (u, i, x, y) in enumerate(rows)] + [(1, 10_000 + k, *(float(v) for v in rng.normal(size=2))) for k in range(300)]
    df = spark.createDataFrame(rows, "unit long, id long, x double, y double")
    got = S.split_until_stable(df, "unit", ["x", "y"]).groupBy("unit", "part").count().collect()
    assert all(190 < r["count"] < 210 for r in got if r.unit == 0)
    assert sum(r.unit == 0 for r in got) == 4 and sum(r.unit == 1 for r in got) == 1
