import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from wavemill.llm import licenses, pieces, quality, rollup, warc
from wavemill.llm._store import new_path
from wavemill.llm.queries import remainder


def test_warc_round_trip(spark):
    long, odd = "p" * 1500, "é\r\n\r\n" * 400
    rows = [(1, "http://a", long), (2, "http://b", long), (3, None, "short"), (4, "http://c", "short"), (5, "x\r\ny", odd), (6, "u", None), (7, "u", ""), (9, "u", long)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    path = new_path(spark, "warc-test")
    warc.write_archives(df, path, segment_bytes=2000)
    got = {r.record_id: r for r in warc.read_archives(spark.read.parquet(path)).collect()}
    assert len(got) == len(rows)
    for i, _, t in rows:
        r, b = got[f"urn:page:{i}"], (t or "").encode()
        assert (r.payload_bytes, r.payload_digest, r.digest_ok) == (len(b), hashlib.sha1(b).hexdigest(), True)
        again = i in (1, 2)
        assert r.record_type == ("revisit" if again else "response") and r.refers_to == ("urn:page:9" if again else None)
        assert again or bytes(r.payload) == b
    whole = b"".join(bytes(r.data) for r in spark.read.parquet(path).collect())
    assert gzip.decompress(whole).count(b"WARC/1.1\r\n") == len(rows)
    assert warc.read_archives(spark.read.parquet(path).limit(0)).collect() == []


def test_warc_rejects_damage():
    good = warc.write_record("response", "urn:x", "u", b"payload", hashlib.sha1(b"payload").hexdigest())
    with pytest.raises(ValueError):
        list(warc.members(good[:-9]))
    bad = warc.parse_record(next(warc.members(warc.write_record("response", "urn:x", "u", b"payload", "0" * 40))))
    assert not bad["digest_ok"]


def test_pieces_are_lossless_and_reproducible(spark):
    texts = ["", None, "a", "  two  spaces ", "▁marker▁ here", "日本語 \U0001f600 é\x00\n\t", "word " * 30_000, "x" * 5000]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, pieces string")
    one = pieces.decode(pieces.encode(df)).orderBy("doc_id").collect()
    assert [r.decoded for r in one] == [t or "" for t in texts]
    two = pieces.encode(df.repartition(3), chunk_bytes=10).orderBy("doc_id").collect()
    assert [r.pieces for r in one] == [r.pieces for r in two]
    other = pieces.encode(df, seed=99).where("doc_id = 6").first().pieces
    assert other != one[6].pieces
    assert pieces.encode(df.limit(0)).collect() == []


def test_sampling_follows_the_lattice():
    import numpy as np

    p = pieces.load(pieces.default_model(), 1.5)
    text, n = b"there", 4000
    buf, off = np.frombuffer(text * n, np.uint8), np.arange(n + 1) * len(text)
    row, piece = pieces.encode_chunk(p, buf, off, np.arange(n).astype(np.uint64), 5)
    seen = {}
    for r in np.split(piece, np.flatnonzero(np.diff(row)) + 1):
        seen[tuple(r.tolist())] = seen.get(tuple(r.tolist()), 0) + 1
    spelled = {p.bytes_of[i]: int(i) for i in p.ids}

    def paths(rest):
        if not rest:
            yield (), 0.0
        for k in range(1, len(rest) + 1):
            if rest[:k] in spelled:
                for tail, w in paths(rest[k:]):
                    yield (spelled[rest[:k]], *tail), w + p.weight[spelled[rest[:k]]]

    every = dict(paths(b" " + text))
    total = sum(np.exp(w) for w in every.values())
    assert set(seen) <= set(every)
    for path, w in every.items():
        share = np.exp(w) / total
        assert abs(seen.get(path, 0) / n - share) < 4 * np.sqrt(share / n) + 2e-3


def test_rollup_is_idempotent_and_additive(spark):
    t = rollup.Rollup(spark, new_path(spark, "rollup-test"))
    assert t.totals().collect() == []
    rows = spark.createDataFrame([("s", "en", "v1", 10, 50), ("s", "en", "v1", 5, 20), (None, "fr", "v1", None, 7)], "source string, lang string, tokenizer string, tokens long, characters long")
    assert t.commit("a", rollup.signed(rows, 1)) and not t.commit("a", rollup.signed(rows, 1))
    assert t.commit("b", rollup.signed(rows.limit(1).where("tokens = 10"), -1))
    got = lambda: sorted(map(tuple, t.totals().collect()), key=str)
    want = [("s", "en", "v1", 1, 5, 20), (None, "fr", "v1", 1, 0, 7)]
    assert got() == sorted(want, key=str)
    t.compact("x")
    assert got() == sorted(want, key=str) and t.batches() == ["to-x"]
    assert not t.commit("b", rollup.signed(rows, 1))
    assert t.commit("c", rollup.revised(rows.where("tokens = 5"), rows.where("tokens = 5").withColumn("tokens", F.lit(9).cast("long"))))
    assert ("s", "en", "v1", 1, 9, 20) in got()


def test_token_counts_match_the_tokenizer(spark):
    texts = ["hello world", None, "", "a" * 3000, "été  \n\t x"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, tokens int")
    enc = rollup._encoding("byte_bpe_50k")
    got = {r.doc_id: r.tokens for r in rollup.count_tokens(df, "byte_bpe_50k").collect()}
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}


def test_quality_learns_from_positives_and_unlabelled(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.learn(docs, labels, training=lambda c: remainder(c, 4) != 2)
    got = quality.score(docs.select("doc_id", "text"), model).where(remainder("doc_id", 4) == 2).join(labels, "doc_id").collect()
    right = sum((r.score >= quality.THRESHOLD) == (r.quality == 1) for r in got)
    assert right / len(got) > 0.85
    good = [r.score for r in got if r.quality == 1]
    assert sum(s >= quality.THRESHOLD for s in good) / len(good) > 0.95


def test_quality_scores_do_not_depend_on_neighbours(spark):
    import numpy as np

    texts = ["", "!", "a!", "!!", "abc def", "", "é", "x" * 3000, "Ab 12 $$ end!", "!lead", "\n\n", "z"]
    raw = [t.encode() for t in texts]
    chunk = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    alone = [quality.features(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0] for r in raw]
    assert np.array_equal(quality.features(*chunk), np.stack(alone))

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    one, two = (quality.learn(d, labels) for d in (docs.repartition(1), docs.repartition(7)))
    assert np.array_equal(one.weight, two.weight) and (one.prior, one.at) == (two.prior, two.at)
    got = [{r.doc_id: r.score for r in quality.score(d.select("doc_id", "text"), one).collect()} for d in (docs, docs.repartition(7))]
    assert got[0] == got[1]


def test_quality_risk_is_least(spark):
    """The fit against small steps away from it, the risk computed row by row."""
    import numpy as np

    rng = np.random.default_rng(3)
    x_p, x_u = (np.c_[np.rint(rng.normal(m, 40, (n, 5))), np.full(n, quality.UNIT)] / quality.UNIT for m, n in ((60, 80), (-10, 300)))
    second = lambda x: x.T @ x
    for prior in (0.2, 0.6, 0.9):
        w = quality.nonnegative_fit(second(x_p), second(x_u), prior) / quality.FINE

        def risk(v, prior=prior):
            p, u = x_p @ v, x_u @ v
            loss = prior * ((1 - p) ** 2).mean() + max(0.0, ((1 + u) ** 2).mean() - prior * ((1 + p) ** 2).mean())
            return loss + quality.RIDGE * (v @ v)

        assert all(risk(w) <= risk(w + s * d) + 1e-9 for d in np.r_[np.eye(6), rng.normal(size=(40, 6))] for s in (-1e-2, -1e-3, 1e-3, 1e-2))


def test_quality_edge_cases(spark):
    df = spark.createDataFrame([(1, None, 3.0), (2, "", 3.0), (2, "", 3.0), (3, "x y " * 50_000, 3.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.learn(df, labels)
    got = quality.score(df, model).collect()
    assert len(got) == 4 and all(r.score == 0.5 for r in got)
    assert quality.score(df.limit(0), model).collect() == []


def test_licenses_are_found_and_inherited(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c.py", "plain words here"), (3, "a/b/d/NOTICE", "Licensed under the\nApache License, Version 2.0."),
        (4, "a/b/d/e.py", None), (5, "z/f.py", ""), (6, None, "text " * 300 + "\nThis work is licensed under the GNU General Public License, version 3.\n" + "more " * 400), (7, "a", "x"),
    ]
    df = spark.createDataFrame([(*r, "l") for r in rows], "doc_id long, path string, text string, license string")
    got = {r.id: (r.own_license, r.license, r.inherited_from) for r in licenses.scan(df).collect()}
    assert got == {
        1: ("MIT", "MIT", None), 2: (None, "MIT", "a"), 3: ("Apache-2.0", "Apache-2.0", None), 4: (None, "Apache-2.0", "a/b/d"), 5: (None, None, None), 6: ("GPL-3.0-only", "GPL-3.0-only", None), 7: (None, None, None),
    }
    assert licenses.scan(df.limit(0)).collect() == []


def test_warc_repeated_ids_and_long_payloads(spark):
    import random

    rng = random.Random(3)
    noise = "".join(chr(rng.randrange(33, 0x800)) for _ in range(400_000))  # far beyond one inflation step
    rows = [(1, "u", "p" * 1500), (1, "u", "abc"), (2, "u", "p" * 1500), (3, "u", noise), (4, "u", noise)]
    path = new_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = {(r.record_id, r.payload_bytes): r for r in warc.read_archives(spark.read.parquet(path)).collect()}
    kinds = {k: (r.record_type, r.refers_to) for k, r in got.items()}
    size = len(noise.encode())
    name = lambda i: next(k[0] for k in kinds if k[0].endswith(f"page:{i}"))
    assert kinds == {(name(1), 1500): ("revisit", name(2)), (name(1), 3): ("response", None), (name(2), 1500): ("response", None), (name(3), size): ("revisit", name(4)), (name(4), size): ("response", None)}
    assert got[name(4), size].payload == noise.encode()


def test_a_batch_committed_during_a_compaction_counts_once(spark, monkeypatch):
    row = lambda n: rollup.signed(spark.createDataFrame([("s", "l", "t", n, n)], "source string, lang string, tokenizer string, tokens long, characters long"), 1)
    r = rollup.Rollup(spark, new_path(spark, "rollup-test"))
    r.commit("a", row(10))
    first = rollup.Rollup._sum
    monkeypatch.setattr(rollup.Rollup, "_sum", lambda self, now: self.commit("b", row(5)) and first(self, now) or first(self, now))
    r.compact("x")
    monkeypatch.setattr(rollup.Rollup, "_sum", first)
    assert r.totals().first().tokens == 15 and r.batches() == ["b", "to-x"]


def test_license_cosines_match_brute_force(spark):
    """Every passage against every template from dictionaries, document frequencies of all words included."""
    import math
    import random
    import re
    from collections import Counter

    rng = random.Random(4)
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 900)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "software", "the", "license", "of", "copy"])
    filler = lambda n: " ".join(word() for _ in range(n))
    wrapped = "\r\n".join(f"# {x}" for x in ["Licensed under the", "Apache License, Version 2.0."])
    texts = [None, "", mit, filler(400), filler(200) + " " + mit + " " + filler(300), f"#!/bin/sh\r\n#\r\n{wrapped}\r\n#\r\nrun = 1\r\n", filler(30) + "\n \t \nReleased under the MIT License.\n", "x " * 60_000 + "Licensed under CC BY 4.0."]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("path", F.lit("a/b"))
    split = lambda t: [w for w in (x.rstrip(".") for x in re.split(r"[\s!\"#$%&'()*+,\-/:;<=>?@\[\\\]^`{|}~]+", t.lower())) if w]
    rows = [split(t or "") for t in texts]
    seen = Counter(w for r in rows for w in set(r))
    idf = lambda w: max(math.log((1 + len(texts)) / (1 + seen[w])), 0) + 0.1
    vector = lambda ws: {w: c * idf(w) for w, c in Counter(ws).items()}
    sides = [(n, vector(split(t))) for n, t in licenses.TEMPLATES]

    def cosine(a, b):
        dot = sum(v * b.get(w, 0) for w, v in a.items())
        return dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())) if dot else 0.0

    def passages(t):
        lines = [split(x) for x in t.split("\n")]
        runs = [[]]
        for x in lines:
            runs.append([]) if not x else runs[-1].extend(x)
        whole = [w for x in lines for w in x]
        out = [*lines, *runs, whole]
        for size in licenses.WINDOWS:
            if len(whole) > size:
                out += [whole[i : i + size] for i in range(0, len(whole), size // 2)] + [whole[: size // 2]]
        return [x for x in out if x]

    got = {r.id: r for r in licenses.own_licenses(df).collect()}
    for i, t in enumerate(texts):
        found = [(cosine(vector(p), v), n) for p in passages(t or "") for n, v in sides]
        top = max((c for c, _ in found if c >= licenses.THRESHOLD), default=0.0)
        assert abs(got[i].similarity - top) < 1e-5, i
        assert got[i].license in ({n for c, n in found if c > top - 1e-5} if top else {None}), i
    assert [got[i].license for i in (2, 3, 4, 5, 6, 7)] == ["MIT", None, "MIT", "Apache-2.0", "MIT", "CC-BY-4.0"]
    assert got[2].share == 1


def test_templates_come_from_a_folder(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("You may do with this what you like on any day but Sunday")
    templates = licenses.read_templates(spark, str(tmp_path))
    df = spark.createDataFrame([(1, "a/LICENSE", "you may do with this what you like, on any day but sunday"), (2, "a/b.c", "code")], "doc_id long, path string, text string")
    assert {r.id: r.license for r in licenses.scan(df, templates=templates).collect()} == {1: "Own-1.0", 2: "Own-1.0"}
