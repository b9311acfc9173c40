import random
import re

import pytest

from wavemill.llm.minhash import near_duplicates

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, k=5, percent=85):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            inter = len(sets[a] & sets[b])
            union = len(sets[a]) + len(sets[b]) - inter
            if union and 100 * inter >= percent * union and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    rows, n = [], 0
    for _ in range(25):
        base = [word() for _ in range(rng.randint(1, 160))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            rows.append((n, " ".join(w) if rng.random() < 0.8 else "\n".join(w).upper()))
            n += 1
    return [*rows, (n, None), (n + 1, ""), (n + 2, "one"), (n + 3, "ONE"), (n + 4, " \t\n"), (n + 5, "word " * 50_000)]


@pytest.mark.parametrize("block", [256, 2])
def test_matches_brute_force(spark, block):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    assert got(near_duplicates(df, block=block)) == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")
    out = sorted(map(tuple, near_duplicates(df).collect()), key=str)
    assert out == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, 1, True)], key=str)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
