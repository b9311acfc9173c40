import numpy as np
import pytest

from wavemill.operators import filters as L


def step_by_step(x: np.ndarray, sections: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Each section's difference equation, a sample at a time."""
    s, out = state.copy(), []
    for v in x:
        for k, (b0, b1, b2, _, a1, a2) in enumerate(sections):
            y = b0 * v + s[k, 0]
            s[k] = b1 * v - a1 * y + s[k, 1], b2 * v - a2 * y
            v = y
        out.append(v)
    return np.array(out)


def settled(sections: np.ndarray) -> np.ndarray:
    """State after a long constant input of 1."""
    out, v = np.zeros((len(sections), 2)), 1.0
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sections):
        y = v * (b0 + b1 + b2) / (1 + a1 + a2)
        out[k] = y - b0 * v, b2 * v - a2 * y
        v = y
    return out


def both_ways(x: np.ndarray, sections: np.ndarray, pad: int) -> np.ndarray:
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    once = step_by_step(wide, sections, settled(sections) * wide[0])
    back = step_by_step(once[::-1], sections, settled(sections) * once[-1])[::-1]
    return back[pad : pad + len(x)]


def test_designs():
    low = L.butterworth(2, "lowpass", 2.0, high=0.2)
    assert np.allclose(low, [[0.06745527, 0.13491055, 0.06745527, 1, -1.1429805, 0.4128016]])
    response = lambda s, f: np.abs(np.prod([np.polyval(q[:3], np.exp(2j * np.pi * f)) / np.polyval(q[3:], np.exp(2j * np.pi * f)) for q in s]))
    for order in (1, 2, 3, 4):
        band, high, low = L.butterworth(order, "bandpass", 1.0, 0.05, 0.2), L.butterworth(order, "highpass", 1.0, low=0.1), L.butterworth(order, "lowpass", 1.0, high=0.1)
        for s, edges, top in ((band, (0.05, 0.2), None), (high, (0.1,), 0.4999), (low, (0.1,), 1e-6)):
            assert np.allclose([response(s, f) for f in edges], np.sqrt(0.5))
            assert top is None or np.isclose(response(s, top), 1, atol=1e-6)
            assert all((np.abs(np.roots(q[3:])) < 1).all() for q in s)


@pytest.mark.parametrize(("kind", "order"), [("bandpass", 3), ("highpass", 3)])
def test_chunks_equal_the_whole_series(spark, monkeypatch, kind, order):
    monkeypatch.setattr(L, "GROUP", 4)  # states pass through several levels
    sections = L.butterworth(order, kind, 1.0, 0.02, 0.2)
    rng = np.random.default_rng(0)
    data = {1: rng.normal(size=3001).cumsum() / 10, 2: rng.normal(size=700) + 5}
    rows = [(k, i, float(v), 0.0) for k, x in data.items() for i, v in enumerate(x)] + [(1, None, 3.0, 0.0), (1, 5000, None, 0.0)]
    df = spark.createDataFrame(rows, "k long, n long, x double, filtered double").repartition(5)
    got = {(r.k, r.n): r.filtered for r in L.zero_phase(df, ["k"], "n", "x", sections, pad=27, chunk=100).collect()}
    assert len(got) == 3701
    for k, x in data.items():
        want = both_ways(x, sections, 27)
        assert np.abs(np.array([got[k, i] for i in range(len(x))]) - want).max() < 1e-9
    one = L.recursive(df.where("k = 2"), [], "n", "x", sections, "y", chunk=64).orderBy("n").collect()
    assert np.abs(np.array([r.y for r in one]) - step_by_step(data[2], sections, np.zeros((len(sections), 2)))).max() < 1e-9
    assert L.zero_phase(df.limit(0), ["k"], "n", "x", sections).collect() == []


def test_shift_by_parts_of_a_sample(spark):
    n = np.arange(4000)
    wave = lambda t: np.sin(2 * np.pi * t / 40) + 0.5 * np.cos(2 * np.pi * t / 16)
    rows = [(k, int(i), float(wave(i)), s) for k, s in ((1, 0.25), (2, -1.5)) for i in n]
    df = spark.createDataFrame(rows, "k long, n long, x double, s double")
    whole = {(r.k, r.n): r.shifted for r in L.phase_shift(df, ["k"], "n", "x", "s").collect()}
    cut = {(r.k, r.n): r.shifted for r in L.phase_shift(df, ["k"], "n", "x", "s", chunk=1000, margin=400).collect()}
    for k, s in ((1, 0.25), (2, -1.5)):
        assert np.abs(np.array([whole[k, i] for i in n]) - wave(n - s)).max() < 1e-9  # 4000 holds whole waves
        inner = n[500:-500]
        assert np.abs(np.array([cut[k, i] for i in inner]) - wave(inner - s)).max() < 2e-3
    assert len(cut) == len(rows)
