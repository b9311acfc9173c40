import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.operators import deconv as Q


def planted(seed: int, length: int, n: int = 16, channels: int = 6, units: int = 4, events: int = 60):
    """(recording, templates): courses of rank 2 on three channels each, many of them overlapping, under little noise."""
    g = np.random.default_rng(seed)
    shape = np.hanning(n)[:, None]
    t = np.zeros((units, n, channels))
    for k in range(units):
        at = g.choice(channels, 3, replace=False)
        curve = np.stack([np.sin(np.arange(n) * (0.4 + 0.2 * k)), np.cos(np.arange(n) * (0.3 + 0.1 * k))], 1) * shape
        t[k][:, at] = curve @ g.normal(0, 3, (2, 3))
    x = g.normal(0, 0.2, (length, channels))
    for p, k in zip(g.integers(0, length - n, events), g.integers(0, units, events), strict=True):
        x[p : p + n] += t[k]
    return x, t


def tables(spark, x, t):
    frames = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "n long, x array<double>").repartition(3)
    return frames, spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(t)], "unit long, x array<array<double>>")


def direct(x, t, threshold, dead, finest=1, ridge=0.0, spread=np.inf):
    """The same rounds by the definition: moved templates are taken from the recording itself and every product is made anew."""
    x, out, n, blocked = x.copy(), [], t.shape[1], set()
    norms, last, turn = (t**2).sum((1, 2)), len(x) - t.shape[1], 0
    while True:
        turn += 1
        conv = np.array([[(x[p : p + n] * s).sum() for p in range(last + 1)] for s in t])
        gain = 2 * conv - norms[:, None]
        for k, p in blocked:
            gain[k, p] = -np.inf
        best, unit = gain.max(0), gain.argmax(0)
        found = [p for p in range(last + 1) if best[p] > threshold and best[p] == best[max(0, p - n + 1) : p + n].max()]
        if not found:
            return out
        for p in found:
            k = unit[p]
            window = conv[k, np.clip(np.arange(p - Q.WIDTH, p + Q.WIDTH + 1), 0, last)]
            parts = int(np.clip(4.0 ** np.floor(np.log2(np.ptp(t[k], axis=0).max())), 1, finest))
            shift, scale = Q.refine(window, norms[k], parts, finest, ridge, spread)
            out.append((p, int(k), shift, scale, best[p], turn))
            x[p : p + n] -= scale * Q.shifted(t[k], shift / finest)
            blocked |= {(k, q) for q in range(max(0, p - dead), min(last, p + dead) + 1)}


def rows(df):
    return sorted((r.start, r.unit, r["shift"], r.scale, r.gain, r.round) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"finest": 8, "ridge": 0.05, "spread": 0.5}])
def test_chunks_equal_direct_subtraction(spark, options):
    x, t = planted(3, 900)
    frames, templates = tables(spark, x, t)
    want = sorted(direct(x, t, 12.0, 5, **{"finest": 1, **options}))
    assert len(want) > 40 and max(w[5] for w in want) > 2  # overlaps are in it
    for chunk in (70, 333, 5000):
        got = rows(Q.pursue(frames, templates, "n", "x", 12.0, chunk, rank=6, visible=0.0, dead=5, **{"finest": 1, **options}))
        assert [g[:3] + g[5:] for g in got] == [w[:3] + w[5:] for w in want]
        assert np.allclose([g[3:5] for g in got], [w[3:5] for w in want])


def test_disagreeing_borders_are_matched_again(spark, monkeypatch):
    """A row of close events hands differences on beyond the first margin; cut anywhere, the matches stay those of the whole."""
    g = np.random.default_rng(5)
    x, t = planted(5, 1200, events=0)
    for p in range(0, 1180, 6):
        x[p : p + 16] += t[g.integers(0, 4)][: len(x) - p]
    frames, templates = tables(spark, x, t)
    asked, plain = [], Q._logs
    monkeypatch.setattr(Q, "_logs", lambda *a: (asked.append(a[2]), plain(*a))[1])
    whole = rows(Q.pursue(frames, templates, "n", "x", 12.0, 5000, rank=6, visible=0.0, finest=4))
    assert len(asked) == 1
    assert rows(Q.pursue(frames, templates, "n", "x", 12.0, 150, rank=6, visible=0.0, finest=4)) == whole
    assert len(asked) > 2  # one cut wasn't enough at first


def test_compression_and_pairs(spark):
    x, t = planted(7, 50)
    _, templates = tables(spark, x, t)
    bank = Q.compress(templates, rank=2, visible=0.0, finest=4).cache()
    for r in bank.collect():
        whole = np.zeros(t.shape[1:])
        whole[:, r.channels] = np.array(r.temporal) @ np.array(r.spatial)
        assert np.allclose(whole, t[r.unit]) and np.isclose(r.norm, (t[r.unit] ** 2).sum())
    n, near = t.shape[1], {(a, b) for a in range(4) for b in range(4) if (np.abs(t[a]).sum(0) * np.abs(t[b]).sum(0)).sum() > 0}
    got = Q.pair_convolutions(bank, 4).collect()
    assert {(r.a, r.b) for r in got} == near
    for r in got:
        wide = np.zeros((3 * n, t.shape[2]))
        wide[n : 2 * n] = Q.shifted(t[r.b], r["shift"] / 4)
        want = [(wide[n + lag : 2 * n + lag] * t[r.a]).sum() for lag in range(1 - n, n)]
        assert np.allclose(r["values"], want)
    matches = spark.createDataFrame([(5, 1, 1), (9, 1, 1), (9, 2, 0)], "start long, unit long, shift int")
    used = {(r.unit, r["shift"]): r for r in Q.used_templates(matches, bank, 4).collect()}
    assert set(used) == {(1, 1), (2, 0)} and used[1, 1].n == 2
    assert np.allclose(np.array(used[1, 1].x), Q.shifted(t[1][:, used[1, 1].channels], 0.25))
    loud = Q.compress(templates, rank=1, visible=1e9)
    assert loud.count() == 0


def test_sub_sample_places(spark):
    """Events between samples are found with their place and size."""
    x, t = planted(14, 600, events=0)
    assert (t**2).sum((1, 2)).min() > 60  # all well above the threshold
    x *= 0.05
    truth = [(50, 0, 0.25, 1.0), (150, 1, -0.25, 1.2), (260, 2, 0.375, 0.9), (400, 3, 0.0, 1.1)]
    for p, k, s, a in truth:
        x[p : p + 16] += a * Q.shifted(t[k], s)
    frames, templates = tables(spark, x, t)
    got = rows(Q.pursue(frames, templates, "n", "x", 30.0, 100, rank=6, visible=0.0, ridge=0.2, spread=0.5))
    assert [g[1] for g in got] == [0, 1, 2, 3]
    for (p, _, s, a), g in zip(truth, got, strict=True):
        assert abs(g[0] + g[2] / 8 - p - s) <= 0.13 and abs(g[3] - a) < 0.1


def test_odd_rows(spark):
    x, t = planted(3, 300, events=10)
    frames, templates = tables(spark, x, t)
    arguments = dict(threshold=12.0, chunk=64, rank=6, visible=0.0, finest=1)
    want = rows(Q.pursue(frames, templates, "n", "x", **arguments))
    assert want
    odd = frames.unionByName(frames.limit(20)).withColumn("unit", F.lit(1)).withColumn("_chunk", F.lit("clash"))
    odd = odd.unionByName(spark.createDataFrame([(None, [1.0], 1, ""), (7, None, 1, ""), (500, [None, float("nan")], 1, "")], odd.schema))
    assert rows(Q.pursue(odd, templates.unionByName(spark.createDataFrame([(9, None)], templates.schema)), "n", "x", **arguments)) == want
    assert rows(Q.pursue(frames.limit(0), templates, "n", "x", **arguments)) == []
    assert rows(Q.pursue(frames, templates.limit(0), "n", "x", **arguments)) == []
