import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from wavemill.llm import media as M


def test_payloads_survive_and_scalar_reader_agrees(monkeypatch):
    rng = np.random.default_rng(4)
    data = M.pack(rng.integers(0, 256, 192 * 7, dtype=np.uint8).tobytes(), 1000)
    fast = M.decode_coefficients(data)
    assert M.unpack(fast)[0] == 1000
    whole = M._lookup
    monkeypatch.setattr(M, "_LOOKS", {})
    monkeypatch.setattr(M, "_lookup", lambda c, s: whole(c, s) | {"single": None})
    slow = M.decode_coefficients(data)
    for a, b in zip(fast["parts"], slow["parts"], strict=True):
        assert (a["coef"] == b["coef"]).all()
    assert (M.to_rgb(fast) == M.to_rgb(slow)).all()


def test_inverse_transform_matches_the_definition():
    rng = np.random.default_rng(5)
    coef, quant = rng.integers(-60, 60, (2, 3, 64)), np.arange(1, 65)
    got = M.samples(coef, quant)
    c = lambda u: 1 / np.sqrt(2) if u == 0 else 1
    for r, k, x, y in ((0, 0, 0, 0), (1, 2, 3, 5), (0, 1, 7, 2)):
        block = np.zeros(64)
        block[M.ZIGZAG] = coef[r, k] * quant
        want = sum(c(u) * c(v) / 4 * block[8 * v + u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) + 128
        assert abs(got[8 * r + y, 8 * k + x] - min(255, max(0, want))) <= 2


def test_chroma_is_upsampled():
    part = lambda h, rows, cols, q: {"h": h, "v": h, "q": q, "rows": rows, "cols": cols, "coef": np.zeros((rows, cols, 64), np.int32)}
    frame = {"height": 16, "width": 16, "hm": 2, "vm": 2, "quant": {0: np.ones(64, np.int64)}, "parts": [part(2, 2, 2, 0), part(1, 1, 1, 0), part(1, 1, 1, 0)]}
    frame["parts"][2]["coef"][0, 0, 0] = 400
    rgb = M.to_rgb(frame)
    assert rgb.shape == (16, 16, 3) and (rgb[..., 0] > 180).all() and (rgb[..., 1] < 128).all()


def test_rows_of_any_text(spark):
    rows = [(1, "abc"), (1, "abc"), (2, None), (3, ""), (4, "x" * 192), (5, "é\n" * 150_000)]
    df = spark.createDataFrame([(i, t, "f") for i, t in rows], "doc_id long, text string, feature string")
    got = M.read_media(M.store_texts(df), tensors=True).collect()
    assert len(got) == len(rows)
    for r in got:
        b = (dict(rows)[r.id] or "").encode()
        p = b + b" " * (-len(b) % 192 or (192 if not b else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert len(r.rgb) == 3 * r.height * r.width
    assert len({r.media_sha256 for r in got if r.id == 1}) == 1
    assert M.read_media(M.store_texts(df.limit(0))).collect() == []


def test_query_stores_media_and_shows_tensor_digests(spark, sf, monkeypatch):
    from wavemill.llm import queries

    stored = []
    keep = queries.materialise
    monkeypatch.setattr(queries, "materialise", lambda df, name, *codec: stored.append(name) or keep(df, name, *codec))
    small = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(20)
    monkeypatch.setattr(queries, "table", lambda *_: small)
    got = {r.doc_id: r.rgb_sha256 for r in queries.op6_media_columns(spark, sf).collect()}
    want = {r.id: hashlib.sha256(r.rgb).hexdigest() for r in M.read_media(M.store_texts(small), tensors=True).collect()}
    assert stored == ["media"] and len(got) == 20 and got == want


def test_token_counts_have_two_versions(spark, sf):
    from wavemill.llm import queries

    got = queries.op3_token_counts(spark, sf).groupBy("tokenizer").agg(F.sum("documents"), F.sum("tokens"), F.sum("characters")).collect()
    one, two = sorted(tuple(r) for r in got)
    assert (one[0], two[0]) == ("byte_bpe_50k", "byte_bpe_multi_50k") and (one[1], one[3]) == (two[1], two[3]) and one[2] != two[2]
