import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from wavemill.llm import _text, queries, resample


def features(text: str | None) -> list[str]:
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if x]
    return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def bucket(f: str) -> int:
    return zlib.crc32(f.encode()) % 10_000


def brute(docs: list, target: list, least: int = 20, percent: int = 5) -> list[tuple]:
    s, t = (Counter(bucket(f) for _, x in rows for f in features(x)) for rows in (docs, target))
    n_s, n_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000))))
    out = []
    for i, x in docs:
        f, h = features(x), int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(y)) for y in f)
        words = sum(" " not in y for y in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(tuple(r[:5]) for r in out)


def test_crc_of_joined_spans():
    rng = np.random.default_rng(1)
    parts = [bytes(rng.integers(97, 123, rng.integers(1, 9)).tolist()) for _ in range(200)] + [b"x" * 255, b"y" * 256, b"z" * 254, b"q" * 3000, "é".encode() * 100]
    parts = [parts[i] for i in rng.permutation(len(parts))]
    buf = np.frombuffer(b" ".join(parts), np.uint8)
    s, e, _ = _text.words(buf, np.array([0, len(buf)]), resample.PART)
    assert resample.word_crcs(buf, s, e).tolist() == [zlib.crc32(p) for p in parts]
    for k in (1, 2, 3):
        first = np.arange(len(parts) - k + 1)
        assert resample.gram_crcs(buf, s, e, first, k).tolist() == [zlib.crc32(b" ".join(parts[i : i + k])) for i in first]


def test_query_on_whole_table(spark, sf):
    rows = [[tuple(r) for r in queries.table(spark, sf, n).select(c, "text").collect()] for n, c in (("documents", "doc_id"), ("benchmark", "item_id"))]
    assert sorted(map(tuple, queries.op13_importance_resampling(spark, sf).collect())) == brute(*rows)


def test_odd_rows(spark):
    lines = "One line here\nTWO\n\nthree, four\r\nfive six\n"
    texts = [None, "", "\n\n \n", "x", "a\nb\nc\nd", "a\n\nb c", lines * 30, lines * 30, lines, "é日本\nß", "w" * 300 + "\n" + "v" * 300 + " z\ny", "no newline " * 20_000, "0 1 " * 40]
    docs = [(i, t) for i, t in enumerate(texts)]
    target = [(0, "one line HERE two"), (1, None), (2, ""), (1, "a b c")]
    df = spark.createDataFrame([(*r, 5, "x") for r in docs], "doc_id long, text string, n_words int, rank string")
    to = spark.createDataFrame(target, "item_id long, text string")
    for d in (df.coalesce(1), df.repartition(6)):
        got = resample.resample(d, to, percent=50).select("doc_id", "n_features", "weight", "score", "rank").collect()
        assert sorted(map(tuple, got)) == brute(docs, target, percent=50)
    assert resample.bucket_counts(df).sum() == sum(len(features(t)) for t in texts)
    twice = df.where("doc_id >= 6").unionAll(df.where("doc_id >= 6")).unionAll(df.where("doc_id = 8").withColumn("doc_id", F.lit(None).cast("long")))
    got = resample.resample(twice, to.limit(0), percent=100).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 1 + sum(r.n_words >= 20 and r.doc_id is not None for r in got))) and len(got) == 15
    assert [r.score for r in got if r.doc_id is None] == [None]
    assert resample.resample(df.limit(0), to).collect() == []


def test_text_column_of_another_name(spark):
    df = spark.createDataFrame([(1, "a b", "left as it is")], "doc_id long, body string, text string")
    assert [(r.text, r.n_features) for r in resample.resample(df, df, text="body").collect()] == [("left as it is", 3)]
