import random

import pytest

from wavemill.llm import lines as L


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(spark, docs, percent=85, distance=3, min_words=5):
    """All pairs of distinct lines, with the operator's SimHash bits but no buckets."""
    norm = lambda line: " ".join(line.lower().replace("\t", " ").split(" ")).split()
    df = spark.createDataFrame(docs, "id long, text string")
    marks = {r.line: r.bits & (2**64 - 1) for r in L.line_table(df).select("h1", "line").distinct().join(L.simhashes(L.line_table(df)), "h1").collect()}
    names = sorted(marks)
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if abs(len(a) - len(b)) <= max(len(a), len(b)) * (100 - percent) // 100 and min(len(a.split()), len(b.split())) >= min_words and (marks[a] ^ marks[b]).bit_count() <= distance:
                longer = max(len(a), len(b))
                if edit(a, b) <= longer * (100 - percent) // 100:
                    root[find(b)] = find(a)
    first, out = {}, {}
    for i, t in sorted((d for d in docs if d[1] is not None)):
        for k, line in enumerate(t.split("\n")):
            if norm(line):
                first.setdefault(find(" ".join(norm(line))), (i, k))
    for i, t in docs:
        out[i] = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not norm(x) or first[find(" ".join(norm(x)))] == (i, k))
    return out


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeéE") for _ in range(rng.randint(2, 8)))
    pool = [[word() for _ in range(rng.choice([1, 3, 6, 60, 150]))] for _ in range(14)]
    out = []
    for i in range(40):
        text = []
        for _ in range(rng.randint(1, 6)):
            w = list(rng.choice(pool))
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] += rng.choice(["", "s", "x"])
            text.append(" ".join(w) if rng.random() < 0.7 else "\t".join(w).upper())
            if rng.random() < 0.2:
                text.append("")
        out.append((i, "\n".join(text)))
    return [*out, (90, None), (91, ""), (92, "\n\n"), (93, "again and again and again\n" * 300), (94, " ".join(word() for _ in range(20_000)))]


def test_matches_brute_force(spark, docs):
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_lines int")
    got = {r.doc_id: r.text for r in L.dedup_lines(df, meet="simhash").collect()}
    assert got == brute(spark, docs)


def test_blocks_match_brute_force_without_any_hash(spark, docs):
    """The rule itself over all pairs of lines; the fixture's lines differ in up to two words."""
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_lines int")
    got = {r.doc_id: r.text for r in L.dedup_lines(df).collect()}
    assert got == brute(spark, docs, distance=64, min_words=1)


def test_near_lines_meet_and_counts_add_up(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = L.dedup_lines(df).collect()
    before = dict(docs)
    assert len(got) == len(docs)
    for r in got:
        if before[r.doc_id]:
            assert r.n_lines == len(before[r.doc_id].split("\n"))
        assert r.n_removed <= r.n_lines


def test_empty_table_and_shared_ids(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(1, "one line\nmore"), (None, "one line"), (2, "One  line")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in L.dedup_lines(df).collect()) == [("1", "one line\nmore"), ("2", ""), ("None", "one line")]


def test_blocks_reach_the_edit_rule(spark):
    """Recall against the rule itself, edit similarity of 85 %: brute force over all pairs, no bits of the operator's."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuv") for _ in range(rng.randint(2, 8)))
    pairs = []
    for n in (1, 2, 3, 4, 6, 10, 20, 40, 80):
        for _ in range(12):
            a = [word() for _ in range(n)]
            b, at = list(a), rng.randrange(n)
            b[at] = b[at][:-1] + "xyz"[rng.randrange(3)] if n < 8 else word()
            pairs.append((" ".join(a), " ".join(b)))
    near = [(a, b) for a, b in pairs if a != b and edit(a, b) <= max(len(a), len(b)) * 15 // 100]
    assert {len(a.split()) for a, _ in near} >= {2, 3, 4, 6, 10, 20, 40, 80}
    df = spark.createDataFrame([(2 * i + j, x) for i, p in enumerate(near) for j, x in enumerate(p)], "doc_id long, text string")
    found = {r.doc_id for r in L.dedup_lines(df).where("n_removed = 1").collect()}
    assert len(found & {2 * i + 1 for i in range(len(near))}) >= 0.97 * len(near)
    # Nothing else goes: every removed line is similar to another line.
    texts = [x for p in near for x in p]
    assert all(any(edit(texts[k], x) <= max(len(texts[k]), len(x)) * 15 // 100 for j, x in enumerate(texts) if j != k and abs(len(x) - len(texts[k])) <= 15) for k in found)


def test_a_hot_bucket_is_compared_in_blocks(spark, monkeypatch):
    """Lines that share their first half, in pairs that are similar: each pair is found whatever the bucket's size."""
    monkeypatch.setattr(L, "BLOCK", 7)
    rng = random.Random(8)
    head = "the same beginning of every single line here and "
    tails = ["".join(rng.choice("abcdefghijklmnop") for _ in range(60)) for _ in range(60)]
    rows = [(2 * i + j, head + t[:20] + "zz"[:j] + t[20:40] + "yy"[:j] + t[40:]) for i, t in enumerate(tails) for j in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in L.dedup_lines(df).where("n_removed = 1").collect()) == [2 * i + 1 for i in range(60)]


def test_blocks_join_unspaced_and_tiny_lines(spark):
    df = spark.createDataFrame([(1, "これは一つの文です。とても長い行"), (2, "これは一つの文てす。とても長い行"), (3, "abcdefg"), (4, "abcXefg"), (5, "abcdef"), (6, "zzz")], "doc_id long, text string")
    assert sorted(r.doc_id for r in L.dedup_lines(df).where("n_removed = 0").collect()) == [1, 3, 6]


def many_headed_lines():
    """Lines of one first half, in pairs that are similar but differ all over their second half, so that they share no other block."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuv") for _ in range(6))
    head = "every one of these lines begins with such words and then "
    out = []
    for i in range(50):
        words = [word() for _ in range(9)]
        out += [(2 * i, head + " ".join(words)), (2 * i + 1, head + " ".join(w[:3] + "z" + w[4:] for w in words))]
    return out


@pytest.mark.parametrize("block", [7, 256])
def test_lines_of_one_bucket_are_all_compared(spark, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    rows = many_headed_lines()
    texts = [t for _, t in rows]
    assert all(edit(texts[i], texts[i + 1]) <= 17 <= len(texts[i]) * 15 // 100 for i in range(0, 100, 2))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in L.dedup_lines(df).where("n_removed = 1").collect()) == list(range(1, 100, 2))


def test_marks_pass_all_similar_lines(spark):
    """Each edit changes four marks at most."""
    rng = random.Random(4)
    rows = []
    for i in range(200):
        a = [rng.choice("abcdefgh ié字") for _ in range(rng.randint(14, 300))]
        b = list(a)
        for _ in range(rng.randint(1, len(a) * 15 // 100)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "y"])
        rows.append(("".join(a), "".join(b)))
    marks = lambda c: {r[0]: r[1:] for r in spark.createDataFrame(rows, "a string, b string").select(c, *L._marks(c)).collect()}
    left, right = marks("a"), marks("b")
    for a, b in rows[:60]:
        assert sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(left[a], right[b], strict=True)) <= 4 * edit(a, b)


def test_a_large_group_of_near_lines_makes_few_links(spark, monkeypatch):
    """Variants of one line, most pairs of them similar and many not: rows of links grow with the lines, not with their square."""
    rng, counts = random.Random(6), {}
    kept = L.materialise

    def counted(df, name, codec=None):
        out = kept(df, name, codec)
        counts[name] = counts.get(name, 0) + (out.count() if name in ("stars", "joined", "pairs", "rest") else 0)
        return out

    monkeypatch.setattr(L, "materialise", counted)
    head, base = "the common beginning of a line that was copied ", "and then changed in many places by hand until hardly two of them agreed any more"
    rows = []
    for i in range(300):
        b = list(base)
        for at in rng.sample(range(len(b)), 11):
            b[at] = rng.choice("qxzjvw")
        rows.append((i, head + "".join(b)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert L.dedup_lines(df).where("n_removed = 0").count() == 1
    assert sum(counts.values()) <= 8 * len(rows)


@pytest.mark.parametrize("words", [8, 9, 12, 20, 43])
def test_three_changed_letters_leave_a_block_alone(spark, words):
    """Letters changed, added or taken away in three words, the first, the last and one of an inner quarter: the other inner quarter is the same."""
    rng = random.Random(words)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuv") for _ in range(rng.randint(5, 9)))
    pairs = []
    for _ in range(40):
        a = [word() for _ in range(words)]
        b = list(a)
        inner = words // 4
        for at in [0, words - 1, rng.choice([*range(inner, words // 2)] if len(pairs) % 2 else [*range(words // 2, words // 2 + inner)])]:
            i = rng.randrange(1, len(b[at]))
            b[at] = b[at][:i] + rng.choice(["", "x", "yz"]) + b[at][i + 1 :]
        pairs.append((" ".join(a), " ".join(b)))
    near = [(a, b) for a, b in pairs if a != b and edit(a, b) <= max(len(a), len(b)) * 15 // 100]
    df = spark.createDataFrame([(2 * i + j, x) for i, p in enumerate(near) for j, x in enumerate(p)], "doc_id long, text string")
    assert len(near) >= 20
    assert sorted(r.doc_id for r in L.dedup_lines(df).where("n_removed = 1").collect()) == [2 * i + 1 for i in range(len(near))]
