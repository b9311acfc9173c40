import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.llm import periodic, queries


def brute(w: list, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of runs, by looking at every period."""
    got = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                got.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in got.items())


def split(text: str | None) -> list[str]:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def without(w: list, found: list) -> str:
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in dropped)


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_match_every_period(least):
    rng = np.random.default_rng(least)
    for _ in range(150):
        docs = []
        for _ in range(rng.integers(1, 6)):
            n = int(rng.integers(0, 90))
            w = rng.integers(0, rng.integers(1, 6), n).tolist()
            if n > 3 and rng.random() < 0.5:
                p, a = int(rng.integers(1, n // 3 + 1)), int(rng.integers(0, n // 2))
                w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            docs.append(w)
        code = np.array([x + 1 for w in docs for x in w], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        row = np.array([r for r, w in enumerate(docs) for _ in w], np.int64)
        got = periodic.runs(code, row, least)
        assert [[tuple(x) for x in got[1:, got[0] == r].T.tolist()] for r in range(len(docs))] == [brute(w, least) for w in docs]


def test_odd_rows(spark):
    a, b = "a", "a b"
    for _ in range(6):
        a, b = b, f"{b} {a}"
    texts = [None, "", " \t\n ", "x", "a " * 12, "a " * 11, "A a " * 9, "x y " * 40_000, "the cat sat\n" * 5 + "end", "é é é é " * 8, b, "b" * 100_000, "q r s t u v w q r s t u v w"]
    texts += texts[4:9]
    df = spark.createDataFrame([(i if i != 2 else None, t, 1, "old") for i, t in enumerate(texts)], "doc_id long, text string, runs int, collapsed string")
    for d in (df.coalesce(1), df.repartition(5)):
        got = {r.id: r for r in periodic.find_runs(d).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            r, w = got[i if i != 2 else None], split(t)
            assert r.n_words == len(w)
            if len(w) < 1000:
                found = brute(w)
                assert [tuple(x) for x in r.runs] == found and r.collapsed == without(w, found)
        assert [tuple(x) for x in got[7].runs] == [(0, 80_000, 2)] and got[7].collapsed == "x y"
    assert periodic.find_runs(df.limit(0)).collect() == []


def test_query_on_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()}
    seen = 0
    for r in queries.op12_periodic_runs(spark, sf).collect():
        w, h = split(texts.pop(r.doc_id)), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        found = brute(w) if len(w) < 3000 else None
        if found is None:
            continue
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r.n_runs, (r.start, r.length, r.period), r.runs_sha256, r.collapsed_sha256) == (len(found), best, sha(listed), sha(without(w, found)))
        assert r.exponent_milli == (best[1] * 1000 // best[2] if found else None)
        seen += bool(found)
    assert not texts and seen > 3


def test_planting_leaves_rows_without_words_or_id(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    rows = [(ids[0], None, 5), (ids[1], " ", 5), (None, "a b c", 5), (ids[2], "", 5), (ids[3], "solo", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    assert {(r.doc_id, r.text) for r in queries.planted(df).collect()} == {r[:2] for r in rows}
    assert queries.planted(df.where(F.lit(False))).collect() == []
