import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from wavemill.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind: str, m: str) -> bool:
    d = [int(c) for c in m if c.isdigit()]
    if kind == "ip":
        return all(int(p[-4300:]) <= 255 for p in m.split("."))
    if kind == "card":
        total = sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(reversed(d)))
        return 14 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def brute(text: str | None) -> list[tuple[str, int, int]]:
    got = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if holds(kind, m.group())]
    return [(kind, s, e) for s, _, kind, e in sorted(got)]


def spans(texts: list, model) -> list[list[tuple]]:
    raw = [(t or "").encode() for t in texts]
    row, s, e, k, base = pii.all_spans(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), model)
    return [[(pii.KINDS[k[i]], int(s[i]), int(e[i]), bool(base[i])) for i in np.flatnonzero(row == r)] for r in range(len(texts))]


def test_patterns_match_regular_expressions():
    rng = random.Random(4)
    bits = ["a", "é", "@", "@", ".", ".", "-", " ", "  ", "+", "+1", "(", ")", "12", "0", "255", "256", "4111111111111111", "1.2.3.4", "x@y.z", "\n", "%", "00", "_", "4111 1111 1111 1111", "+1 (017) 555-7713", "5"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += [None, "", "1" * 5000, "1." * 5001, "@" * 3000, "a" * 5000 + "@b.c", "a@b" * 900, "+1" * 900, "1 " * 3000, "0" * 5000 + ".1.1.1"]
    model = pii.train(steps=1)
    got = spans(texts, model)
    assert [[x[:3] for x in row if x[3]] for row in got] == [brute(t) for t in texts]


def test_decoding_is_exact():
    """Against Viterbi over whole texts, word by word."""
    model = pii.train()
    rng = random.Random(2)
    bits = [w for r in pii.LABELLED for w in pii.marked(r)[0].split()]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(300)] + ["12 " * 200]
    raw = [t.encode() for t in texts]
    buf, offsets = pii.parted(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    s, e, row, key, digits, size, known = pii.word_types(buf, offsets, model.hashes)
    feats = [pii.type_features(bytes(buf[s[i] : e[i]]), digits[i], size[i], model.words[known[i]] if known[i] >= 0 else "") for i in range(len(s))]
    own = np.zeros((len(s), 3, len(model.kinds) + 1))
    for i, f in enumerate(feats):
        for side in range(3):
            own[i, side] = sum((model.weight[model.index[k]] for k in (f"{side} {x}" for x in f) if k in model.index), np.zeros(own.shape[2]))
    want = []
    for r in range(len(texts)):
        at = np.flatnonzero(row == r)
        score = own[at, 0].copy()
        score[1:] += own[at[:-1], 1]
        score[:-1] += own[at[1:], 2]
        best, back = model.move[0] + score[0], []
        for x in score[1:]:
            through = best[:, None] + model.move
            back.append(through.argmax(0))
            best = through.max(0) + x
        path = [int((best + model.move[:, 0]).argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        want += [(int(s[a]), t) for a, t in zip(at, reversed(path), strict=True) if t]
    ws, _, _, tag = model.decode(buf, offsets)
    assert list(zip(ws.tolist(), tag.tolist(), strict=True)) == want and len(want) > 200


def test_likelihood_gradient():
    """Steps on the field's likelihood end where small changes of the weights don't raise it."""
    rng = np.random.default_rng(0)
    x, row = rng.integers(0, 2, (30, 4)).astype(float), np.repeat(np.arange(6), 5)
    tag = (x[:, 0] + x[:, 1]).astype(int)
    w, move = pii.ascend(x, tag, row, 3, 1500)

    def objective(w, move):
        total = -pii.RIDGE / 2 * ((w * w).sum() + (move * move).sum())
        for r in range(6):
            s, t = x[row == r] @ w, [0, *tag[row == r], 0]
            total += sum(s[i, t[i + 1]] for i in range(5)) + sum(move[a, b] for a, b in zip(t[:-1], t[1:], strict=True))
            f = move[0] + s[0]
            for v in s[1:]:
                f = np.log(np.exp(f[:, None] + move).sum(0)) + v
            total -= np.log(np.exp(f + move[:, 0]).sum())
        return total

    top = objective(w, move)
    for _ in range(60):
        d, g = rng.normal(size=w.shape) * 0.05, rng.normal(size=move.shape) * 0.05
        assert objective(w + d, move + g) <= top + 1e-6


def test_field_on_held_out_sentences(spark):
    rows, right, found, true = list(pii.LABELLED), 0, 0, 0
    for part in range(4):
        model = pii.train(spark.createDataFrame([(r,) for i, r in enumerate(rows) if i % 4 != part], "sentence string"))
        held = [pii.marked(r) for r in rows[part::4]]
        for (text, marks), got in zip(held, spans([t for t, _ in held], model), strict=True):
            got = {(s, e) for _, s, e, _ in got}
            want = {(s, e) for s, e, _ in marks}
            right, found, true = right + len(got & want), found + len(got), true + len(want)
    assert right / found > 0.85 and right / true > 0.7, (right, found, true)


def test_field_adds_spans_and_spares_prose(spark, sf):
    model = pii.train()
    texts = ["call (017) 555-7713 now", 'Und token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"!! x', "her ssn is 111-22-3333, I hear", "é at 10:45 on 2010-05-11, 12 eggs for 3.50", "room (101), 1999 and 1234567"]
    assert [[(k, t[s:e]) for k, s, e, _ in row] for t, row in zip(texts, spans(texts, model), strict=True)] == [
        [("phone", "(017) 555-7713")], [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")], [("ssn", "111-22-3333")], [], [],
    ]
    plain = [r.text for r in queries.table(spark, sf, "documents").where(~F.rlike("text", F.lit("[0-9@]"))).collect()]
    assert len(plain) > 50 and not any(spans(plain, model))


def test_query_on_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()}
    for r in queries.op11_personal_data(spark, sf).collect():
        base = brute(texts.pop(r.doc_id))
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in base) for k in pii.BASE]
        assert set(listed.split(",")) - {""} <= set(r.spans.split(","))
    assert not texts


def test_odd_rows(spark):
    texts = [None, "", " ", "x@y.z", "x@y.z", "12 " * 60_000, "w" * 200_000, "a1B2" * 50_000, "é" * 3 + " +1 (017) 555-7713", "\n\n1.2.3.4\n"]
    df = spark.createDataFrame([(i if i else None, t, 7, "s") for i, t in enumerate(texts)], "doc_id long, text string, id int, spans string")
    model = pii.train()
    for d in (df.coalesce(1), df.repartition(5)):
        got = {r.id: [tuple(x) for x in r.spans] for r in pii.find_pii(d, model).collect()}
        assert len(got) == len(texts)
        assert all([x[:3] for x in got[i or None] if x[3]] == ([] if i in (6, 7) else brute(t)) for i, t in enumerate(texts))  # the pattern's own search of those takes too long
    assert pii.find_pii(df.limit(0), model).collect() == []
    assert not any(spans(["ssn 111-22-3333", ""], pii.train(spark.createDataFrame([(None,), ("",)], "sentence string"))))
