import numpy as np
from pyspark.sql import functions as F

from wavemill.operators import triage as T


def brute(x, z, a, percent, width, region):
    """(distance, score, kept) by the definition: all distances, a dense smoothing matrix, lines between edges."""
    f = np.stack([x, z, 50 * np.log(5 + a)], 1)
    d = np.sort(np.sqrt(((f[:, None] - f[None]) ** 2).sum(2)), 1)[:, 1:6].mean(1)
    usual = np.ones(len(x))
    if region:
        edges = np.arange(z.min(), z.max(), width)
        level = np.full(len(edges), d.max())
        for k in range(1, len(edges)):
            inside = (z >= edges[k - 1]) & (z < edges[k])
            if inside.any():
                level[k] = d[inside].mean()
        s = region / width
        lag = np.arange(len(edges))[:, None] - np.arange(len(edges))
        reach = int(4 * s + 0.5)
        weight = np.where(np.abs(lag) <= reach, np.exp(-0.5 * (lag / s) ** 2), 0) / np.exp(-0.5 * (np.arange(-reach, reach + 1) / s) ** 2).sum()
        smooth = weight @ level
        usual = np.interp(z, edges, smooth)
        beyond = z > edges[-1]
        usual[beyond] = smooth[-1] + (z[beyond] - edges[-1]) * (smooth[-1] - smooth[-2]) / width
    score = np.log(d) - np.log(usual) - np.log(50 * np.log(a))
    return d, score, score <= np.percentile(score, percent)


def made(n=400):
    g = np.random.default_rng(8)
    z = np.concatenate([g.normal(100, 8, n // 2), g.uniform(0, 303, n - n // 2)])
    return g.uniform(0, 50, n), z, g.uniform(1, 30, n)


def test_regions_equal_brute_force(spark):
    x, z, a = made()
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(x, z, a, strict=True))], "id long, x double, z double, a double").repartition(3)
    use = np.flatnonzero(a > 3)
    for percent, width, region in ((80, 5, 25), (60, 10, 12), (80, 5, None)):
        want = brute(x[use], z[use], a[use], percent, width, region)
        got = {r.id: r for r in T.region_adaptive(df, "id", "x", "z", "a", percent=percent, width=width, region=region).collect()}
        assert sorted(got) == use.tolist()
        assert np.allclose([got[i].distance for i in use], want[0]) and np.allclose([got[i].score for i in use], want[1])
        assert [got[i].kept for i in use] == want[2].tolist()


def test_odd_events(spark):
    schema = "id long, x double, z double, a double"
    same = [(i, 1.0, 2.0, 5.0) for i in range(8)]
    df = spark.createDataFrame(same + [(90, None, 1.0, 9.0), (91, 1.0, float("nan"), 9.0), (92, 1.0, 1.0, 2.0)], schema).withColumns({"k": F.lit(1), "edge": F.lit(2), "f0": F.lit("")})
    got = T.region_adaptive(df, "id", "x", "z", "a", region=None).collect()
    assert sorted(r.id for r in got) == list(range(8)) and all(r.distance == 0 and r.score == float("-inf") and r.kept for r in got)
    assert T.region_adaptive(df.limit(0), "id", "x", "z", "a").count() == 0
    assert T.region_adaptive(df.where("id = 0"), "id", "x", "z", "a").count() == 0
    small = T.region_adaptive(df.where("id < 8").withColumn("a", F.lit(0.5)), "id", "x", "z", "a", least=0, region=None).collect()
    assert all(r.score is None and not r.kept for r in small)
