"""Personal data in whole texts: spans of fixed patterns, and more by a linear-chain conditional random field.

The patterns (email, ip, card, phone) are found with array operations on a chunk of bytes, so their time is linear
in any text. The field tags each word (run of non-blank bytes) with a kind or none. A word's features come from its
type: its shape (letters, digits, marks; runs of a class count up to four), how many digits and bytes it has, and
which word of the labelled table it is; its neighbours' types count too. Weights and transitions are trained on the
driver from a labelled table of at most MOST_LABELLED sentences by full-batch steps on the regularised likelihood.

Decoding is exact. A word whose best other tag can't make up for its lead as "none", whatever its neighbours' tags,
is none on every best path; bounds by type tell that for nearly all of prose. Viterbi runs on the stretches between,
all stretches of a chunk at once. Spans of the field are kept where they meet no pattern's span and hold what their
kind needs (``plausible``); no data leaves the task but the spans.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wavemill.llm import _text
from wavemill.llm.pii_labels import LABELLED

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "secret")
MOST_LABELLED = 10_000
STEPS, RATE, RIDGE = 250, 0.1, 0.05
CHUNK, ROWS, KEPT_TYPES = 1 << 20, 1 << 14, 1 << 16
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LABEL = _DIGIT.copy()
_LABEL[65:91] = _LABEL[97:123] = _LABEL[45] = True
_LOCAL = _LABEL.copy()
_LOCAL[[46, 95, 37, 43]] = True
_DIAL = _DIGIT.copy()
_DIAL[[32, 40, 41, 46, 45]] = True


def parted(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the same texts with a newline after each."""
    n = len(offsets) - 1
    out = np.full(len(buf) + n, 10, np.uint8)
    out[np.arange(len(buf)) + np.repeat(np.arange(n), np.diff(offsets))] = buf
    return out, offsets + np.arange(n + 1)


def luhn(digits: bytes) -> bool:
    d = [c - 48 for c in digits[::-1]]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def base_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, kind) of the patterns' spans in bytes, texts being parted by newlines; leftmost, non-overlapping within a kind."""
    out: list[tuple[int, int, int]] = []
    raw = buf.tobytes()
    b = np.append(buf, np.full(2, 10, np.uint8))
    digit = _DIGIT[b]
    edge = np.flatnonzero(digit[1:] != digit[:-1]) + 1
    edge = np.append(0, edge) if digit[0] else edge
    first, last = edge[0::2], edge[1::2]  # digit runs; the text's end is no digit

    def chains(joins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First run and number of runs of each chain of digit runs with one joining byte between them."""
        link = (first[1:] == last[:-1] + 1) & joins[b[last[:-1]]]
        head = np.flatnonzero(np.append(True, ~link)) if len(first) else np.zeros(0, np.int64)
        return head, np.diff(head, append=len(first))

    at = np.flatnonzero(b == 64)
    if len(at):
        outside, no_label = np.flatnonzero(~_LOCAL[b]), np.flatnonzero(~_LABEL[b])
        lefts = np.append(-1, outside)[np.searchsorted(outside, at)] + 1
        rights = no_label[np.searchsorted(no_label, at + 1)]
        done = 0
        for p, left, q in zip(at.tolist(), lefts.tolist(), rights.tolist(), strict=True):
            left, dots = max(left, done), 0
            while q > p + 1 and b[q] == 46 and _LABEL[b[q + 1]]:
                q, dots = int(no_label[np.searchsorted(no_label, q + 1)]), dots + 1
            if left < p and dots:
                out.append((left, q, 0))
                done = q
    dot, joint = np.zeros(256, bool), np.zeros(256, bool)
    dot[46] = joint[32] = joint[45] = True
    head, size = chains(dot)
    for h, n in zip(head[size >= 4].tolist(), size[size >= 4].tolist(), strict=True):
        for i in range(h, h + n - n % 4, 4):
            parts = [raw[first[k] : last[k]].lstrip(b"0") for k in range(i, i + 4)]
            if all(len(x) <= 3 and int(x or b"0") <= 255 for x in parts):
                out.append((int(first[i]), int(last[i + 3]), 1))
    head, size = chains(joint)
    if len(head):
        count = np.add.reduceat(last - first, head)
        for h, n in zip(head[(count >= 14) & (count <= 19)].tolist(), size[(count >= 14) & (count <= 19)].tolist(), strict=True):
            s, e = int(first[h]), int(last[h + n - 1])
            if luhn(re.sub(rb"[ -]", b"", raw[s:e])):
                out.append((s, e, 2))
    plus = np.flatnonzero((b[:-1] == 43) & digit[1:])
    if len(plus):
        beyond, where = np.flatnonzero(~_DIAL[b]), np.flatnonzero(digit)
        stop = beyond[np.searchsorted(beyond, plus + 1)]
        end = where[np.searchsorted(where, stop) - 1] + 1
        n = np.searchsorted(where, end) - np.searchsorted(where, plus)
        ok = (end >= plus + 4) & (n >= 10) & (n <= 15)
        out += [(s, e, 3) for s, e in zip(plus[ok].tolist(), end[ok].tolist(), strict=True)]
    got = np.array(sorted(out), np.int64).reshape(-1, 3)
    return got[:, 0], got[:, 1], got[:, 2]


# Words and their types ------------------------------------------------------------------------------------------------

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = ord("X"), ord("x"), ord("d"), ord("x")
_MARK = np.zeros(256, bool)
_MARK[33:128] = True
_MARK[48:58] = _MARK[65:91] = _MARK[97:123] = False


def shape(word: bytes) -> str:
    """Byte classes of a word, runs of a class up to four."""
    return re.sub(r"(.)\1{4,}", r"\1\1\1\1", _CLASS[np.frombuffer(word, np.uint8)].tobytes().decode("ascii"), flags=re.S)


def bucket(n: np.ndarray) -> np.ndarray:
    """0, 1, 2, 3, 4, 5-6, 7-8, 9-12, 13-15, 16-19, 20-39, 40 and more."""
    return np.searchsorted([1, 2, 3, 4, 5, 7, 9, 13, 16, 20, 40], n, "right")


def type_features(word: bytes, digits: int, size: int, known: str) -> list[str]:
    s = shape(word)
    low = re.sub(r"(.)\1+", r"\1", s.replace("X", "x"), flags=re.S)
    core = low.strip("\"'.,;:!?*#$%&<>[]{}")
    out = [f"shape {s[:60]}", f"low {low[:40]}", f"core {core[:40]}", f"digits {digits}", f"digits {digits} core {core[:40]}", f"size {size}", "bias"]
    out += [f"has {c}" for c in sorted(set(re.sub("[Xxd]", "", core)))]
    if known:
        out.append(f"word {known}")
    if re.search("xdx|dxd", core):
        out.append("mixed")
    return out


def word_types(buf: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, row, type key, digit bucket, size bucket, place in ``known`` or -1) of each word. ``known`` are sorted hashes of words.
    Texts are parted by newlines, so a run of a class ends with its word."""
    s, e, row = _text.words(buf, offsets)
    cls = _CLASS[buf]
    keep = np.ones(len(buf), bool)
    if len(buf) > 4:
        same = cls[1:] == cls[:-1]
        keep[4:] = ~(same[:-3] & same[1:-2] & same[2:-1] & same[3:])
    place = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    shapes = _text.spans(_text.prefix(cls[keep], fold=False), place[s], place[e])
    total = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_DIGIT[buf], out=total[1:])
    digits, size = bucket(total[e] - total[s]), bucket(e - s)
    a, z = s.copy(), e.copy()
    if len(s):
        for _ in range(3):  # marks at the ends
            a = np.where((a < z) & _MARK[buf[np.minimum(a, len(buf) - 1)]], a + 1, a)
            z = np.where((a < z) & _MARK[buf[np.maximum(z - 1, 0)]], z - 1, z)
    word = _text.spans(_text.prefix(buf), a, z)
    at = np.minimum(np.searchsorted(known, word), max(len(known) - 1, 0))
    at = np.where(known[at] == word, at, -1) if len(known) else np.full(len(s), -1)
    key = _text.mix(shapes + ((digits * 16 + size) * 65_536 + at + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return s, e, row, key, digits, size, at


# The field ------------------------------------------------------------------------------------------------------------


@dataclass
class Field:
    """Weights by feature for a word itself, the word before and the word after (rows of ``weight``), transitions, and known words."""

    kinds: tuple[str, ...]
    index: dict[str, int]
    weight: np.ndarray
    move: np.ndarray
    words: list[str]
    hashes: np.ndarray
    cache: dict[int, np.ndarray] = field(default_factory=dict)

    def emissions(self, key, word) -> np.ndarray:
        """(types, 3, tags): what a word of each type adds to its own tag, the next word's and the one before's. ``word(i)`` gives features."""
        if len(self.cache) > KEPT_TYPES:
            self.cache.clear()
        out = np.zeros((len(key), 3, len(self.kinds) + 1))
        for i, k in enumerate(key.tolist()):
            if (got := self.cache.get(k)) is None:
                got = np.zeros(out.shape[1:])
                for f in word(i):
                    for side in range(3):
                        if (at := self.index.get(f"{side} {f}")) is not None:
                            got[side] += self.weight[at]
                self.cache[k] = got
            out[i] = got
        return out

    def decode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, row, tag) of words that aren't none; tag k is kinds[k - 1]."""
        s, e, row, key, digits, size, at = word_types(buf, offsets, self.hashes)
        none = (np.zeros(0, np.int64),) * 4
        if not len(s):
            return none
        kind, example, of = np.unique(key, return_index=True, return_inverse=True)
        names = lambda i: type_features(bytes(buf[s[example[i]] : e[example[i]]]), digits[example[i]], size[example[i]], self.words[at[example[i]]] if at[example[i]] >= 0 else "")
        own = self.emissions(kind, names)
        lead = (own[:, :, 1:] - own[:, :, :1]).max(2)  # at most so much better than none
        step = self.move
        most = float((step[:, None, 1:] + step[1:, :].T[None] - step[:, None, :1] - step[0][None, :, None]).max())
        n = len(s)
        joined = row[1:] == row[:-1]
        bound = lead[of, 0]
        bound[1:] += np.where(joined, lead[of[:-1], 1], 0)
        bound[:-1] += np.where(joined, lead[of[1:], 2], 0)
        open_ = np.flatnonzero(bound + most > -1e-9)
        if not len(open_):
            return none
        score = own[of[open_], 0]
        before, after = open_[(open_ > 0) & np.append(False, joined)[open_]], open_[(open_ < n - 1) & np.append(joined, False)[open_]]
        score[np.searchsorted(open_, before)] += own[of[before - 1], 1]
        score[np.searchsorted(open_, after)] += own[of[after + 1], 2]
        begin = np.ones(len(open_), bool)
        begin[1:] = (open_[1:] != open_[:-1] + 1) | (row[open_[1:]] != row[open_[:-1]])
        tag = viterbi(score, np.flatnonzero(begin), self.move)
        got = open_[tag > 0]
        return s[got], e[got], row[got], tag[tag > 0]


def viterbi(score: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best tags of stretches of rows, each between two words of tag 0; of equal paths the one of lower tags from the end on."""
    length = np.diff(start, append=len(score))
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    alive = len(start) - np.cumsum(np.bincount(length))  # stretches longer than 0, 1, 2 ..
    best = move[0] + score[start]
    back, ends = [], np.zeros(len(start), np.int64)
    for t in range(int(length[0])):
        now = int(alive[t])
        if t:
            through = best[:now, :, None] + move[None]
            back.append(through.argmax(1).astype(np.int8))
            best = through.max(1) + score[start[:now] + t]
        stop = int(alive[t + 1]) if t + 1 < len(alive) else 0
        ends[stop:now] = (best[stop:now] + move[:, 0]).argmax(1)
        best = best[:stop] if stop < now else best
    out = np.zeros(len(score), np.int64)
    for t in range(int(length[0]) - 1, -1, -1):
        now = int(alive[t])
        out[start[:now] + t] = ends[:now]
        if t:
            ends[:now] = back[t - 1][np.arange(now), ends[:now]]
    return out


def marked(row: str) -> tuple[str, list[tuple[int, int, str]]]:
    """A labelled sentence's text and its spans in code points."""
    text, spans, done = "", [], 0
    for m in re.finditer(r"<(\w+)>(.*?)</\1>", row):
        text += row[done : m.start()]
        spans.append((len(text), len(text) + len(m[2]), m[1]))
        text, done = text + m[2], m.end()
    return text + row[done:], spans


def train(labelled: DataFrame | None = None, *, column: str = "sentence", steps: int = STEPS) -> Field:
    """Fits the field on a table of marked sentences, by default the one of this module. Null and empty rows are left out, marks of
    kinds that aren't in KINDS count as none, and an empty table tags nothing. More than MOST_LABELLED rows are refused."""
    rows = list(LABELLED) if labelled is None else [r[0] for r in labelled.select(column).limit(MOST_LABELLED + 1).collect()]
    if len(rows) > MOST_LABELLED:
        raise ValueError(f"the labelled table holds more than {MOST_LABELLED} rows")
    pairs = [marked(r) for r in sorted(r for r in rows if r)]
    raw = [t.encode() for t, _ in pairs]
    buf, offsets = parted(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    s, e, row, *_ = word_types(buf, offsets, np.zeros(0, np.uint64))
    if not len(s):
        return Field(KINDS, {}, np.zeros((0, len(KINDS) + 1)), np.zeros((len(KINDS) + 1,) * 2), [], np.zeros(0, np.uint64))
    strip = lambda w: w.decode().translate({i: i + 32 for i in range(65, 91)}).strip("".join(map(chr, np.flatnonzero(_MARK))))
    words = sorted({x for a, z in zip(s, e, strict=True) if (x := strip(bytes(buf[a:z]))).isalpha()})
    code = [x.encode() for x in words]
    flat, at = np.frombuffer(b"".join(code), np.uint8), np.cumsum([0, *map(len, code)])
    hashes = _text.spans(_text.prefix(flat), at[:-1], at[1:])
    order = np.argsort(hashes)
    words, hashes = [words[i] for i in order], hashes[order]
    s, e, row, _, digits, size, known = word_types(buf, offsets, hashes)
    feats = [type_features(bytes(buf[s[i] : e[i]]), digits[i], size[i], words[known[i]] if known[i] >= 0 else "") for i in range(len(s))]
    tag = np.zeros(len(s), np.int64)
    for i in range(len(s)):
        char = lambda b, r=row[i]: len(raw[r][: b - offsets[r]].decode(errors="ignore"))
        for a, z, k in pairs[row[i]][1]:
            if k in KINDS and char(s[i]) < z and char(e[i]) > a:
                tag[i] = 1 + KINDS.index(k)
    index: dict[str, int] = {}
    entry = []
    for i in range(len(s)):
        for side, j in ((0, i), (1, i - 1), (2, i + 1)):
            if 0 <= j < len(s) and row[j] == row[i]:
                entry += [(i, index.setdefault(f"{side} {f}", len(index))) for f in feats[j]]
    x = np.zeros((len(s), len(index)))
    x[tuple(np.array(entry).T)] = 1
    weight, move = ascend(x, tag, row, len(KINDS) + 1, steps)
    return Field(KINDS, index, weight, move, words, hashes)


def ascend(x: np.ndarray, tag: np.ndarray, row: np.ndarray, tags: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions of most regularised log likelihood, by moment-scaled gradient steps over all sentences at once."""
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    length = np.diff(first, append=len(row))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    alive = [int((length > t).sum()) for t in range(int(length[0]))]
    theta = np.zeros((x.shape[1] + tags, tags))
    m, v, gold = np.zeros_like(theta), np.zeros_like(theta), np.eye(tags)[tag]
    edges = np.zeros((tags, tags))  # a sentence stands between two words of tag 0
    for a, n in zip(first, length, strict=True):
        path = [0, *tag[a : a + n].tolist(), 0]
        np.add.at(edges, (path[:-1], path[1:]), 1)
    for k in range(1, steps + 1):
        w, move = theta[:-tags], theta[-tags:]
        score = x @ w
        fore, aft = np.zeros_like(score), np.zeros_like(score)
        for t, n in enumerate(alive):
            at = first[:n] + t
            fore[at] = score[at] + (move[0] if not t else _lse(fore[at - 1][:, :, None] + move, 1))
        for t in range(len(alive) - 1, -1, -1):
            n = alive[t]
            at, more = first[:n] + t, alive[t + 1] if t + 1 < len(alive) else 0
            aft[at] = move[:, 0]
            if more:
                nxt = first[:more] + t + 1
                aft[nxt - 1] = _lse(move + (score[nxt] + aft[nxt])[:, None, :], 2)
        z = _lse(fore + aft, 1)
        share = np.exp(fore + aft - z[:, None])
        expected = np.zeros((tags, tags))
        expected[0] += share[first].sum(0)
        last = first + length - 1
        expected[:, 0] += share[last].sum(0)
        inner = np.flatnonzero(np.append(False, row[1:] == row[:-1]))
        expected += np.exp(fore[inner - 1][:, :, None] + move + (score[inner] + aft[inner])[:, None, :] - z[inner][:, None, None]).sum(0)
        grad = np.concatenate([x.T @ (gold - share), edges - expected]) - RIDGE * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return theta[:-tags], theta[-tags:]


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)


# Spans ----------------------------------------------------------------------------------------------------------------


def trimmed(raw: bytes, s: int, e: int) -> tuple[int, int]:
    """A span without marks around it; a bracket stays with its partner."""
    lead, tail = b"\"'<[{*#$%&,;=", b"\"'>]}*#$%&.,;:!?="
    while s < e:
        inner = raw[s:e]
        if inner[0] in lead or (inner[0] == 40 and b")" not in inner):
            s += 1
        elif inner[-1] in tail or (inner[-1] == 41 and b"(" not in inner):
            e -= 1
        else:
            break
    return s, e


def plausible(kind: str, word: bytes) -> bool:
    """What a span of a kind must hold."""
    digits = re.sub(rb"\D", b"", word)
    if kind == "email":
        return re.search(rb"@|\bat\b", word, re.I) is not None and re.search(rb"\.|\bdot\b", word, re.I) is not None
    if kind == "ip":
        return re.fullmatch(rb"[0-9A-Fa-f]{0,4}(:[0-9A-Fa-f]{0,4}){2,7}", word) is not None and (b"::" in word or word.count(b":") == 7)
    if kind == "card":
        return 13 <= len(digits) <= 19 and re.fullmatch(rb"[\d .-]+", word) is not None and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15 and re.fullmatch(rb"\+?[\d ().-]+", word) is not None
    if kind == "ssn":
        return re.fullmatch(rb"\d{3}-\d{2}-\d{4}", word) is not None
    return len(word) >= 16 and bool(digits) and re.search(rb"[A-Za-z]", word) is not None and b" " not in word


def all_spans(buf: np.ndarray, offsets: np.ndarray, model: Field) -> tuple[np.ndarray, ...]:
    """(row, start, end, kind, from a pattern) by row, start and kind; start and end in code points of the row's text."""
    apart, edge = parted(buf, offsets)
    s, e, kind = base_spans(apart)
    base = np.ones(len(s), bool)
    ws, we, wrow, tag = model.decode(apart, edge)
    if len(ws):
        raw, more = apart.tobytes(), []
        taken = np.zeros(len(apart) + 1, np.int64)
        np.add.at(taken, s, 1)
        np.add.at(taken, e, -1)
        taken = np.append(0, np.cumsum(np.cumsum(taken) > 0))
        blank = np.append(0, np.cumsum(~_text.BLANK[apart]))
        new = np.ones(len(ws), bool)
        new[1:] = (wrow[1:] != wrow[:-1]) | (tag[1:] != tag[:-1]) | (blank[ws[1:]] != blank[we[:-1]])
        head = np.flatnonzero(new)
        for a, z, k in zip(ws[head].tolist(), we[np.append(head[1:], len(ws)) - 1].tolist(), tag[head].tolist(), strict=True):
            a, z = trimmed(raw, a, z)
            if k == 1 + KINDS.index("secret") and b"=" in raw[a:z]:  # name="value"
                a, z = trimmed(raw, a + raw[a:z].rindex(b"=") + 1, z)
            if a < z and taken[z] == taken[a] and plausible(model.kinds[k - 1], raw[a:z]):
                more.append((a, z, k - 1))
        if more:
            s, e, kind = (np.append(x, y) for x, y in zip((s, e, kind), np.array(more, np.int64).T, strict=True))
            base = np.append(base, np.zeros(len(more), bool))
    order = np.lexsort((~base, kind, s))
    s, e, kind, base = s[order], e[order], kind[order], base[order]
    row = np.searchsorted(edge, s, "right") - 1
    point = np.append(0, np.cumsum((apart & 0xC0) != 0x80))
    return row, point[s] - point[edge[row]], point[e] - point[edge[row]], kind, base


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])


def find_pii(docs: DataFrame, model: Field | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, spans) per row: array of (kind, start, end, base) by start and then kind as in KINDS; places count code points, the end is
    exclusive, and ``base`` tells a pattern's span from the field's.

    Null and empty texts have no span. Rows with a null or repeated id are rows like others. Other columns are dropped. Texts of any
    length are taken whole. A kind's pattern spans don't overlap; those of two kinds may.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train())  # weights of a bounded table

    def run(batches):
        field_ = shared.value
        for batch in batches:
            for lo, hi, buf, offsets in _text.chunks(batch.column("_text"), CHUNK, ROWS):
                row, start, end, kind, base = all_spans(buf, offsets, field_)
                each = np.zeros(hi - lo + 1, np.int32)
                np.cumsum(np.bincount(row, minlength=hi - lo), out=each[1:])
                names = pa.DictionaryArray.from_arrays(pa.array(kind, pa.int64()), pa.array(KINDS)).cast(pa.string())
                found = pa.StructArray.from_arrays([names, pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(base, pa.bool_())], fields=list(SPAN))
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(each), found)], ["id", "spans"])
        _text.release()

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    return rows.mapInArrow(run, f"id {kind}, spans array<struct<kind: string, start: long, end: long, base: boolean>>")
