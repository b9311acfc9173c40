import random
import re

import pytest

from wavemill.llm.decontam import contamination

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII))


def brute(docs, bench, window=13):
    out = []
    for i, t in docs:
        w, hit, ids = split(t), set(), set()
        for item, b in bench:
            b = split(b)
            n = min(window, len(b))
            runs = {tuple(b[j : j + n]) for j in range(len(b) - n + 1)} if n else set()
            for j in range(len(w) - n + 1):
                if n and tuple(w[j : j + n]) in runs:
                    hit.update(range(j, j + n))
                    ids.add(str(item))
        out.append((i, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


def tables():
    rng = random.Random(5)
    words = ["ab", "cd", "é", "ef", "gh", "9x"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bench = [(i, text(rng.choice([13, 20, 40, 7, 5, 3, 12]))) for i in range(25)] + [(100, None), (101, " .. "), (102, "Ab, cd. " * 12)]
    docs = []
    for i in range(60):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            b = (rng.choice(bench)[1] or "").split(" ")
            lo = rng.randint(0, max(0, len(b) - 14))
            parts += [", ".join(b[lo : lo + rng.randint(10, 40)]).upper(), text(rng.randint(0, 9))]
        docs.append((i, "\n".join(parts)))
    return [*docs, (200, None), (201, ""), (202, "ab cd " * 20_000), (203, bench[0][1]), (203, bench[0][1])], bench


@pytest.mark.parametrize("bound", [500_000, 0])
def test_matches_brute_force(spark, bound):
    docs, bench = tables()
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_words int")
    b = spark.createDataFrame([(i, t, "x") for i, t in bench], "item_id long, text string, doc_id string")
    got = contamination(d, b, broadcast_windows=bound).collect()
    assert sorted([(r.id, r.n_words, r.n_hit, r.item_ids) for r in got], key=str) == brute(docs, bench)
    assert all(sum(s["last"] - s["first"] for s in r.spans) == r.n_hit for r in got)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in contamination(d, b).collect()] == [(1, 3, 0, [])]
    assert contamination(d.limit(0), b).collect() == []
