"""Runs of repeated words in texts: maximal stretches of least period q that are at least two periods long.

Each text is a sequence of words, and all work is inside the task that holds it: texts don't meet, so nothing
is shuffled. Texts of about CHUNK bytes are handled at once as one array of words, in these steps:

1. A run of ``least`` words or more repeats some ``least // 2`` words at its period's distance. Texts that
   repeat none (by a sort of rolling hashes; equal stretches always have equal hashes) have no run and are done.
2. Suffix array by prefix doubling: ranks of stretches of 1, 2, 4 .. words, where only what is still tied is
   sorted again. The ranks of each length are kept; they tell whether two stretches are equal, and so give
   longest common prefixes and extensions by halving steps.
3. Each LCP interval of depth d is the set of suffixes with a common prefix of d words. It has one child per
   next word. The suffixes of all children but the largest are looked at: suffix i starts a square of period d
   that can't move right where the inverse suffix array has i + d in the interval, in another child, and
   i - d starts one where it has i - d there. That is n log n looks, and no tree is built.
4. Each square is moved left as far as its words allow; where it ends up and its end bound a run. Squares of a
   multiple of the period give the same stretch, so the least period of a stretch stays.

Words are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wavemill.llm import _text

LEAST = 12
CHUNK, ROWS = 1 << 20, 1 << 13
#: So many suffixes are looked at at once.
LOOKS = 1 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def repeating(code: np.ndarray, row: np.ndarray, rows: int, size: int) -> np.ndarray:
    """Mask of rows in which a stretch of ``size`` words occurs twice; a row without any may rarely be in it, none is missed."""
    out = np.zeros(rows, bool)
    if len(code) <= size:
        return out
    up, down = _text.powers(len(code) + 1)
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(code * up[: len(code)], out=sums[1:])
    at = np.arange(len(code) - size + 1)
    at = at[row[at] == row[at + size - 1]]
    salt = _text.mix(row[at].astype(np.uint64) + np.uint64(1))
    key = _text.mix((sums[at + size] - sums[at]) * down[at]) ^ salt
    order = np.argsort(key)
    twice = order[1:][key[order[1:]] == key[order[:-1]]]
    out[row[at[twice]]] = True
    return out


def rank_levels(code: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
    """Ranks of stretches of 1, 2, 4 .. words, until all differ. Equal ranks at a level mean equal stretches of one row; a stretch
    cut by its row's end differs from all others. Each has a place more, of rank -1."""
    n = len(code)
    order = np.argsort(code, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    new = np.ones(n, bool)
    new[1:] = (code[order[1:]] != code[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
    first = np.flatnonzero(new)
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = np.repeat(first, np.diff(first, append=n))
    levels, size = [rank], 1
    tied = order[np.repeat(np.diff(first, append=n) > 1, np.diff(first, append=n))]
    while len(tied):
        rank = levels[-1].copy()
        after = np.minimum(tied + size, n)
        inside = (after < n) & (row[np.minimum(after, n - 1)] == row[tied])
        own = rank[tied].astype(np.int64)
        key = own * (n + 2) + np.where(inside, rank[after], -1) + 1
        o = np.argsort(key, kind="stable")
        tied, key, own = tied[o], key[o], own[o]
        head, sub = np.ones(len(o), bool), np.ones(len(o), bool)
        head[1:], sub[1:] = own[1:] != own[:-1], key[1:] != key[:-1]
        at = np.arange(len(o))
        start = np.flatnonzero(sub)
        count = np.diff(start, append=len(o))
        place = np.repeat(start, count) - np.maximum.accumulate(np.where(head, at, 0))
        rank[tied] = own + place
        levels.append(rank)
        tied = tied[np.repeat(count > 1, count)]
        size *= 2
    return levels


def common_prefixes(levels: list[np.ndarray], sa: np.ndarray) -> np.ndarray:
    """For each place of the suffix array, how many words its suffix shares with the one before; 0 at first."""
    out = np.zeros(len(sa), np.int32)
    at = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    a, b, got = sa[at - 1], sa[at], np.zeros(len(at), np.int32)
    for h in range(len(levels) - 1, -1, -1):
        same = levels[h][a + got] == levels[h][b + got]
        got[same] += 1 << h
    out[at] = got
    return out


def intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, low, high): for each place with a common prefix, the widest range of suffixes that share as much."""
    n = len(lcp)
    at = np.flatnonzero(lcp > 0)
    table = [np.append(lcp, 0)]  # least of 1, 2, 4 .. values on; what passes the end counts as 0
    longest = int(np.diff(np.flatnonzero(np.append(lcp, 0) == 0)).max(initial=1))
    while 1 << len(table) <= longest:
        t, step = table[-1], 1 << (len(table) - 1)
        nxt = np.zeros_like(t)
        nxt[:-step] = np.minimum(t[:-step], t[step:])
        table.append(nxt)
    v, high, low = lcp[at], at.copy(), at.copy()
    for k in range(len(table) - 1, -1, -1):
        high += np.where(table[k][np.minimum(high, n)] >= v, 1 << k, 0)
        back = low - (1 << k) + 1
        ok = (back >= 0) & (table[k][np.maximum(back, 0)] >= v)
        low -= np.where(ok, 1 << k, 0)
    return at, low, high  # suffixes low .. high - 1


def squares(sa: np.ndarray, isa: np.ndarray, lcp: np.ndarray):
    """Yields (start, period) arrays of the squares that can't move right, some twice."""
    n = len(sa)
    at, low, high = intervals(lcp)
    if not len(at):
        return
    depth = lcp[at]
    o = np.lexsort((at, depth, low))
    at, low, high, depth = at[o], low[o], high[o], depth[o]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (depth[1:] != depth[:-1])
    group = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    # children: one from low to the first place of a group, then one from each place to the next or the interval's end
    where = np.arange(len(at)) + group + 1
    begin = np.zeros(len(at) + len(head), np.int64)
    begin[where], begin[head + np.arange(len(head))] = at, low[head]
    end = np.empty_like(begin)
    end[:-1] = begin[1:]
    last = np.append(head[1:], len(at)) - 1 + np.arange(len(head)) + 1
    end[last] = high[head]
    family = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(at))) + 1)
    size = end - begin
    start = np.append(0, last[:-1] + 1)
    top = np.maximum.reduceat(size, start)
    big = np.flatnonzero(size == top[family])
    keep = np.ones(len(size), bool)
    keep[big[np.unique(family[big], return_index=True)[1]]] = False
    begin, end, family, size = begin[keep], end[keep], family[keep], size[keep]
    lo, hi, d = low[head][family], high[head][family], depth[head][family].astype(np.int64)
    total = np.cumsum(size)
    done = 0
    while done < len(size):
        stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + LOOKS, "right")))
        child = np.repeat(np.arange(done, stop), size[done:stop])
        r = begin[child] + np.arange(len(child)) - np.repeat(np.cumsum(size[done:stop]) - size[done:stop], size[done:stop])
        i = sa[r]
        for other, begins in ((i + d[child], i), (i - d[child], i - d[child])):
            ok = (other >= 0) & (other < n)
            k = isa[np.where(ok, other, 0)]
            ok &= (k >= lo[child]) & (k < hi[child]) & ((k < begin[child]) | (k >= end[child]))
            if ok.any():
                yield begins[ok], d[child][ok]
        done = stop


def runs(code: np.ndarray, row: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(4, m): row, start within the row, length and least period of every run of ``least`` words or more, in order of row, start
    and period. ``row`` doesn't fall."""
    none = np.zeros((4, 0), np.int64)
    if not len(code):
        return none
    rows = int(row[-1]) + 1
    some = repeating(code, row, rows, max(1, least // 2))
    if not some.any():
        return none
    mine = some[row]
    code, row = code[mine], row[mine]
    levels = rank_levels(code, row)
    isa = levels[-1][:-1]
    sa = np.empty(len(isa), np.int64)
    sa[isa] = np.arange(len(isa))
    found = list(squares(sa, isa, common_prefixes(levels, sa)))
    if not found:
        return none
    i, d = (np.concatenate(x) for x in zip(*found, strict=True))
    first = np.searchsorted(row, np.arange(rows))  # where each row starts
    base, s = first[row[i]], i.copy()
    for h in range(len(levels) - 1, -1, -1):
        back = s - (1 << h)
        ok = back >= base
        back = np.where(ok, back, 0)
        s = np.where(ok & (levels[h][back] == levels[h][np.minimum(back + d, len(code))]), back, s)
    e = i + 2 * d
    long = e - s >= np.maximum(least, 2 * d)
    s, e, d = s[long], e[long], d[long]
    o = np.lexsort((d, e, s))
    s, e, d = s[o], e[o], d[o]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    s, e, d = s[new], e[new], d[new]
    o = np.lexsort((d, s))
    s, e, d = s[o], e[o], d[o]
    return np.stack([row[s], s - first[row[s]], e - s, d])


def collapsed(buf: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """Words joined by one space, a string per row."""
    size = end - start + 1
    total = np.cumsum(size)
    sep = total - 1
    index = np.repeat(start - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)
    padded = np.append(buf, np.uint8(32))
    out = padded[np.minimum(index, len(buf))]
    out[sep] = 32
    count = np.bincount(row, minlength=rows)
    closing = sep[np.cumsum(count)[count > 0] - 1]
    keep = np.ones(len(out), bool)
    keep[closing] = False
    length = np.bincount(row, weights=size, minlength=rows).astype(np.int64) - (count > 0)
    offsets = np.zeros(rows + 1, np.int64)
    np.cumsum(length, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(rows, pa.py_buffer(offsets), pa.py_buffer(out[keep])).cast(pa.string())


def find_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(id, n_words, runs, collapsed) per row: every run of ``least`` words or more as (start, length, period) in order of start and
    period, and the text's words without those that lie in a run after its first period, joined by one space.

    Words are maximal runs of bytes other than blank and the controls 9 to 13. Null and empty texts have no words, no run and an
    empty collapsed text. Rows with a null or repeated id are rows like others; other columns, whatever their names, are dropped.
    A text of any length is one task's work: memory grows with its words and the logarithm of its longest repeat.
    """

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offsets in _text.chunks(batch.column("_text"), CHUNK, ROWS):
                n = hi - lo
                s, e, row = _text.words(buf, offsets)
                code = _text.spans(_text.prefix(buf, fold=False), s, e)
                got = runs(code, row, least)
                first = np.searchsorted(row, np.arange(n + 1))
                keep = np.ones(len(row), bool)
                if got.shape[1]:
                    step = np.zeros(len(row) + 1, np.int64)
                    begin = first[got[0]] + got[1]
                    np.add.at(step, begin + got[3], 1)
                    np.add.at(step, begin + got[2], -1)
                    keep = np.cumsum(step)[:-1] == 0
                each = np.zeros(n + 1, np.int32)
                np.cumsum(np.bincount(got[0], minlength=n), out=each[1:])
                fields = pa.StructArray.from_arrays([pa.array(x) for x in got[1:]], fields=list(RUN))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(lo, n), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(each), fields), collapsed(buf, s[keep], e[keep], row[keep], n)],
                    ["id", "n_words", "runs", "collapsed"],
                )
        _text.release()

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    return rows.mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
