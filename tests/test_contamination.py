from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.operators import contamination as Q


def correlogram(t, width, bins=50):
    k = np.zeros(2 * bins + 1)
    for i, a in enumerate(t):
        for j, b in enumerate(t):
            if i != j and abs(a - b) < width * bins:
                k[int(np.rint((a - b) / width)) + bins] += 1
    k[bins] = 0
    return k


def plain(k, compat=False):
    """(rate, ratio, p) by the definition, with places counted in the array."""
    m = len(k) // 2
    rate = max(np.mean(np.r_[k[1 : m // 2], k[3 * m // 2 : 2 * m]]), k[m - 50 : m - 10].mean(), k[m + 11 : m + 50].mean())
    means, chances = [], []
    for i in range(1, 11):
        s = k[m - i : m + i + 1].sum()
        means.append(s / 2 * i if compat else s / (2 * i))
        chances.append(1.0 if rate == 0 else NormalDist(rate * i, np.sqrt(rate * i)).cdf(s / 2))
    return rate, (min(means) / rate if rate else float(min(means) > 0)), min(chances)


def swept(t, s, width, most, alpha, compat=False):
    """Every prefix's correlogram made anew, from the best score down."""
    for level in sorted(set(s), reverse=True):
        k = correlogram(t[s >= level], width)
        rate, ratio, p = plain(k, compat)
        if p < alpha and ratio >= most:
            return level, int((s >= level).sum()), rate, ratio, p
    return min(s), len(s), rate, ratio, p


@pytest.fixture(scope="module")
def made():
    """Units with a dead time, whose worse scores come at random times; ties, a hot unit, single events, equal times."""
    g, rows = np.random.default_rng(2), []
    for u, (n, dirt) in enumerate([(150, 40), (300, 90), (120, 0), (90, 90), (1, 0), (3, 2)]):
        t = np.cumsum(12 + g.exponential(15, n)).round()
        s = np.concatenate([g.integers(50, 100, n), g.integers(0, 70, dirt)]) / 10
        rows += [(u, float(a), float(b)) for a, b in zip(np.concatenate([t, g.uniform(0, max(t.max(), 50), dirt).round()]), s, strict=True)]
    return [(i, *r) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("most", "compat", "levels"), [(0.2, False, 1024), (0.1, False, 3), (0.2, True, 7)])
def test_cuts_equal_every_prefix(spark, made, monkeypatch, most, compat, levels):
    monkeypatch.setattr(Q, "LEVELS", levels)
    df = spark.createDataFrame(made, "id long, u int, t double, s double").repartition(3)
    got = {r.unit: r for r in Q.cuts(df, "u", "t", "s", "id", 2.0, most=most, compat=compat).collect()}
    assert set(got) == set(range(6))
    cut = 0
    for u in got:
        t, s = (np.array([r[c] for r in made if r[1] == u]) for c in (2, 3))
        level, kept, rate, ratio, p = swept(t, s, 2.0, most, 0.05, compat)
        r = got[u]
        assert (r.cut, r.n, r.kept) == (level, len(s), kept)
        assert np.isclose(r.rate, rate) and np.isclose(r.ratio, ratio)
        assert np.isclose(NormalDist().cdf(r.z) if r.z is not None else 1.0, p)
        cut += kept < len(s)
    assert cut >= 1


def test_metrics_of_uneven_sides(spark):
    g = np.random.default_rng(4)
    ks = [g.poisson(9, 121), g.poisson(3, 121) * (np.abs(np.arange(-60, 61)) > 4), np.zeros(121, int), (np.abs(np.arange(-60, 61)) < 11).astype(int)]
    df = spark.createDataFrame([(i, [int(v) for v in k]) for i, k in enumerate(ks)], "i int, k array<long>")
    for compat in (False, True):
        for r in df.select("i", Q.metrics(F.col("k"), 60, compat).alias("m")).collect():
            k = ks[r.i].astype(float)
            k[60] = 0
            rate, ratio, p = plain(k, compat)
            assert np.isclose(r.m.rate, rate) and np.isclose(r.m.ratio, ratio)
            assert np.isclose(1.0 if r.m.z is None else NormalDist().cdf(r.m.z), p)
    with pytest.raises(ValueError):
        Q.metrics(F.col("k"), 49)


def test_odd_events(spark, made):
    df = spark.createDataFrame(made, "id long, u int, t double, s double")
    odd = df.unionByName(spark.createDataFrame([(9001, None, 1.0, 1.0), (9002, 0, None, 1.0), (9003, 0, 1.0, None), (9004, 0, 1.0, float("nan"))], df.schema))
    odd = odd.withColumns({"unit": F.lit("x"), "level": F.lit(1), "_at": F.lit(2)})
    keys = lambda d: sorted(map(tuple, Q.cuts(d, "u", "t", "s", "id", 2.0).select("unit", "cut", "n", "kept").collect()))
    assert keys(odd) == keys(df)
    assert Q.cuts(df.limit(0), "u", "t", "s", "id", 2.0).count() == 0
