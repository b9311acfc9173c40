"""Language-model scores from sharded Elias-Fano tries of word trigrams with absolute discounting.

A text is a sequence of words and one end. A word seen c times among N training tokens of V kinds has
probability (c - D) / N; words never seen share one unknown class of probability D * V / N. A bigram or
trigram seen LEAST_COUNT times or more, whatever the size of the corpus, has its own discounted share of
its context plus the context's spare mass times the shorter gram's probability; others have the spare
mass times it alone (interpolated back-off). Every training token counts.

Nothing that grows with the corpus is gathered or broadcast:

1. Documents become chunks of token numbers. Each chunk's distinct words go to the vocabulary's shards by
   hash, and come back with their counts and corpus-wide numbers.
2. Each chunk sends its trigrams to shards by the middle word, and by the first word too where the middle
   one is frequent, those trained on marked. A word that occurs once is in no bigram of LEAST_COUNT, so it
   is sent as 0.
3. A shard holds its blocks as they came, packed (about SHARD_TOKENS tokens of some bytes each), counts them
   into its trie, then answers them: the sum of a document's log-probabilities, in whole quanta, so sums
   are exact in any order. Only a pair of first and middle word that alone makes up more than a shard
   makes one larger.
4. The sums meet by chunk.

Blocks are columns of bytes, compressed; a row of the shuffle is a block of some thousand tokens.
"""

from __future__ import annotations

import json
import mmap
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wavemill.llm import _text
from wavemill.llm._store import materialise

LEAST_COUNT, DISCOUNT, QUANTUM, LEAST_BITS = 2, 0.75, 2.0**-11, 21
#: Bytes of text that are split at once, tokens of a chunk at least, and tokens of a shard on average.
SPLIT_BYTES, CHUNK_TOKENS, SHARD_TOKENS = 2 << 20, 5 << 18, 1 << 20
#: Stands for the end of a text; a blank, so no word is spelled like it.
END = b"\n"
#: First word of a row of a frequent middle word's bigram counts.
ALL = 0xFFFFFFFF
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_SELECT = np.array([[([j for j in range(8) if i >> j & 1] + [8] * 8)[k] for k in range(8)] for i in range(256)], np.uint8)


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary with counts of ones per 64."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, rank: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.rank = n, low_bits, low, high, rank

    @staticmethod
    def build(values: np.ndarray) -> EliasFano:
        v = values.astype(np.uint64)
        n = len(v)
        top = int(v[-1]) + 1 if n else 1
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = ((v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        low = np.packbits(np.concatenate([bits, np.zeros(-len(bits) % 64 + 64, np.uint8)]), bitorder="little").view(np.uint64)
        ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(ones[-1]) + 1 if n else 0) // 64 * 64 + 64, np.uint8)
        unary[ones] = 1
        high = np.packbits(unary, bitorder="little")
        rank = np.concatenate([[0], np.cumsum(_POP[high].reshape(-1, 8).sum(1))]).astype(np.int64)
        return EliasFano(n, width, low, high, rank)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.rank, i, "right") - 1
        left = i - self.rank[word]
        octets = self.high.reshape(-1, 8)[word]
        upto = np.cumsum(_POP[octets], axis=1, dtype=np.int64)
        octet = (upto <= left[:, None]).sum(1)
        row = np.arange(len(i))
        left = left - np.where(octet > 0, upto[row, np.maximum(octet - 1, 0)], 0)
        at = word * 64 + octet * 8 + _SELECT[octets[row, octet], left]
        out = (at - i).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bit = i * self.low_bits
            a, s = bit >> 6, (bit & 63).astype(np.uint64)
            pair = self.low[a] >> s
            over = self.low[a + 1] << ((np.uint64(64) - s) & np.uint64(63))
            out |= (pair | np.where(s > 0, over, np.uint64(0))) & np.uint64((1 << self.low_bits) - 1)
        return out.astype(np.int64)

    def all(self) -> np.ndarray:
        """The whole sequence."""
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (at - np.arange(self.n)) << self.low_bits
        if self.low_bits:
            bit = np.arange(self.n) * self.low_bits
            a, s = bit >> 6, (bit & 63).astype(np.uint64)
            over = np.where(s > 0, self.low[a + 1] << ((np.uint64(64) - s) & np.uint64(63)), np.uint64(0))
            out |= (((self.low[a] >> s) | over) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)
        return out


class Level:
    """Children of parents: a monotone sequence of parent << bits | symbol, and pointers to where each parent's children start."""

    def __init__(self, seq: EliasFano, ptr: EliasFano, bits: int):
        self.seq, self.ptr, self.bits, self._plain, self.expected = seq, ptr, bits, None, 0

    @staticmethod
    def build(parent: np.ndarray, symbol: np.ndarray, parents: int, bits: int) -> Level:
        return Level(EliasFano.build((parent.astype(np.int64) << bits) | symbol), EliasFano.build(np.searchsorted(parent, np.arange(parents + 1))), bits)

    def find(self, parent: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Place of each parent's child, -1 where there is none (or no parent): the successor within the parent's range.

        Where more than a quarter of what the level holds is asked for, in this batch or in all that are ``expected``, the level is
        decoded once and searched as it is.
        """
        out = np.full(len(parent), -1)
        ask = np.flatnonzero((parent >= 0) & (symbol >= 0))
        if not len(ask) or not self.seq.n:
            return out
        want = (parent[ask] << self.bits) | symbol[ask]
        if self._plain is None and 4 * max(len(ask), self.expected) > self.seq.n:
            self._plain = self.seq.all()
        if self._plain is not None:
            at = np.minimum(np.searchsorted(self._plain, want), self.seq.n - 1)
            hit = self._plain[at] == want
            out[ask[hit]] = at[hit]
            return out
        lo, hi = self.ptr[parent[ask]], self.ptr[parent[ask] + 1]
        end = hi.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self.seq[mid] < want[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        some = np.flatnonzero(lo < end)
        hit = some[self.seq[lo[some]] == want[some]]
        out[ask[hit]] = lo[hit]
        return out


class Trie:
    """Trigrams by their middle word: ``heads`` are middle words, under a head stand its successors (``two``, bigrams) and its
    predecessors (``pre``, contexts of two words), and under a context its successors (``three``). Quantised: a bigram's and a
    trigram's log10 probability, a head's and a context's spare mass. ``words`` maps corpus-wide numbers to the trie's own."""

    LEVELS, VALUES = ("words", "heads", "two", "pre", "three"), ("p2", "p3", "spare1", "spare2")

    def __init__(self, levels: dict[str, Level], values: dict[str, np.ndarray]):
        self.levels, self.values = levels, values

    @staticmethod
    def build(b: np.ndarray, a: np.ndarray, c: np.ndarray, n: np.ndarray, q1: np.ndarray, discount: float = DISCOUNT, least: int = LEAST_COUNT) -> Trie:
        """From counts n of trigrams (a, b, c), 0 for a rare or missing word, and each c's quantised probability q1. Rows may repeat.
        Where a head has rows with a = ALL, those are its bigram counts; else they are the sums over a."""
        order = np.lexsort((c, a, b))
        b, a, c, n, q1 = b[order].astype(np.int64), a[order].astype(np.int64), c[order].astype(np.int64), n[order].astype(np.int64), q1[order]
        first = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (a[1:] != a[:-1]) | (c[1:] != c[:-1]))) if len(b) else np.zeros(0, np.int64)
        b, a, c, q1 = b[first], a[first], c[first], q1[first]
        n = np.add.reduceat(n, first) if len(first) else n
        whole = a == ALL
        hot = np.unique(b[whole])
        pick = whole | ~np.isin(b, hot)
        order = np.flatnonzero(pick)[np.lexsort((c[pick], b[pick]))]
        first = np.flatnonzero(np.append(True, (b[order][1:] != b[order][:-1]) | (c[order][1:] != c[order][:-1]))) if len(order) else np.zeros(0, np.int64)
        b2, c2, q2 = b[order][first], c[order][first], q1[order][first]
        n2 = np.add.reduceat(n[order], first) if len(first) else n[:0]

        def shares(parent, n, kept):  # discounted shares, and each parent's spare mass
            total = np.bincount(parent, n)
            own = np.where(kept, n - discount, 0.0)
            return own / total[parent] if len(n) else own, (total - np.bincount(parent, own)) / np.maximum(total, 1)

        heads, at = np.unique(b2, return_inverse=True)
        keep2 = (c2 > 0) & (n2 >= least)
        share, spare1 = shares(at, n2, keep2) if len(b2) else (n2, n2)
        p2 = share + (spare1[at] if len(b2) else 0) * 10.0 ** (-QUANTUM * q2.astype(np.float64))
        some = np.unique(at[keep2])  # heads with bigrams
        head_of, spare1 = heads[some], spare1[some] if len(some) else np.zeros(0)
        two_b, two_c, p2 = b2[keep2], c2[keep2], p2[keep2]
        # Contexts of two words.
        t = np.flatnonzero(~whole & (a > 0))
        b, a, c, n = b[t], a[t], c[t], n[t]
        start = np.append(True, (b[1:] != b[:-1]) | (a[1:] != a[:-1])) if len(b) else np.zeros(0, bool)
        ctx = np.cumsum(start) - 1
        keep3 = (c > 0) & (n >= least)
        share, spare2 = shares(ctx, n, keep3) if len(b) else (n, n)
        with3 = np.unique(ctx[keep3])
        pre_b, pre_a = b[start][with3], a[start][with3]
        three_ctx, b3, c3 = np.searchsorted(with3, ctx[keep3]), b[keep3], c[keep3]
        # A trigram's bigram occurs as often at least, so it is an entry.
        pair = (two_b << 32) | two_c
        below = p2[np.searchsorted(pair, (b3 << 32) | c3)] if len(b3) else np.zeros(0)
        p3 = share[keep3] + (spare2[ctx[keep3]] if len(b3) else 0) * below
        spare2 = spare2[with3] if len(with3) else np.zeros(0)
        words = np.unique(np.concatenate([head_of, two_c, pre_a, c3]))
        bits = max(LEAST_BITS, len(words).bit_length())
        loc = lambda x: np.searchsorted(words, x)
        zero = lambda x: np.zeros(len(x), np.int64)
        levels = {
            "words": Level.build(zero(words), words, 1, 40), "heads": Level.build(zero(head_of), loc(head_of), 1, bits),
            "two": Level.build(np.searchsorted(head_of, two_b), loc(two_c), len(head_of), bits), "pre": Level.build(np.searchsorted(head_of, pre_b), loc(pre_a), len(head_of), bits),
            "three": Level.build(three_ctx, loc(c3), len(pre_b), bits),
        }
        values = {"p2": p2, "p3": p3, "spare1": spare1, "spare2": spare2}
        return Trie(levels, {k: quantise(np.asarray(v, np.float64)) for k, v in values.items()})

    def expect(self, queries: int) -> None:
        """Says how many queries are to come in all, in however many batches."""
        for level in self.levels.values():
            level.expected = queries

    def cost(self, b: np.ndarray, a: np.ndarray, c: np.ndarray, q1: np.ndarray) -> np.ndarray:
        """Quanta of -log10 p(c | a b), of corpus-wide numbers; q1: those of p(c)."""
        lv, v = self.levels, self.values

        def child(level, parent, symbol):  # equal neighbours are looked up once
            new = np.flatnonzero(np.append(True, (parent[1:] != parent[:-1]) | (symbol[1:] != symbol[:-1]))) if len(parent) else np.zeros(0, np.int64)
            return np.repeat(level.find(parent[new], symbol[new]), np.diff(np.append(new, len(parent))))

        local = lambda x: child(lv["words"], np.where(x > 0, 0, -1), x)
        b, a, c = (local(x.astype(np.int64)) for x in (b, a, c))
        head = child(lv["heads"], np.where(b >= 0, 0, -1), b)
        two, ctx = child(lv["two"], head, c), child(lv["pre"], head, a)
        three = child(lv["three"], ctx, c)
        get = lambda name, at: np.where(at >= 0, v[name][at], 0).astype(np.int64) if len(v[name]) else np.zeros(len(at), np.int64)
        bigram = np.where(two >= 0, get("p2", two), get("spare1", head) + q1)
        return np.where(three >= 0, get("p3", three), get("spare2", ctx) + bigram)

    def to_bytes(self) -> bytes:
        """One flat string: a header, then the arrays, each at a multiple of 8."""
        arrays, head = [], {}
        for name in self.LEVELS:
            lv = self.levels[name]
            head[name] = [lv.bits, *[[e.n, e.low_bits, *[_put(arrays, x) for x in (e.low, e.high, e.rank)]] for e in (lv.seq, lv.ptr)]]
        for name in self.VALUES:
            head[name] = _put(arrays, self.values[name])
        meta = json.dumps(head).encode()
        return len(meta).to_bytes(8, "little") + meta + b" " * (-len(meta) % 8) + b"".join(x.tobytes() + bytes(-x.nbytes % 8) for x in arrays)

    @staticmethod
    def load(data: bytes | mmap.mmap) -> Trie:
        """Levels as views of a memory map: of a file's, or of an anonymous one that gets the bytes."""
        room = data
        if not isinstance(data, mmap.mmap):
            room = mmap.mmap(-1, len(data))
            room.write(data)
        size = int.from_bytes(room[:8], "little")
        head, base = json.loads(room[8 : 8 + size]), 8 + size + -size % 8
        get = lambda spec: np.frombuffer(room, spec[0], spec[1], base + spec[2])
        level = lambda x: Level(*[EliasFano(e[0], e[1], *map(get, e[2:])) for e in x[1:]], x[0])
        return Trie({n: level(head[n]) for n in Trie.LEVELS}, {n: get(head[n]) for n in Trie.VALUES})


def _put(arrays: list, a: np.ndarray) -> list:
    at = sum(x.nbytes + -x.nbytes % 8 for x in arrays)
    arrays.append(np.ascontiguousarray(a))
    return [a.dtype.str, len(a), at]


def quantise(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-30)) / QUANTUM), 0, 65535).astype(np.uint16)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte by byte of their items, compressed."""
    body = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() for x in columns)
    head = json.dumps([len(columns[0]), *[x.dtype.str for x in columns]]).encode()
    return len(head).to_bytes(2, "little") + head + (pa.Codec("zstd", 1).compress(body, asbytes=True) if body else b"")


def unpack(data: bytes) -> list[np.ndarray]:
    size = int.from_bytes(data[:2], "little")
    n, *kinds = json.loads(data[2 : 2 + size])
    kinds = [np.dtype(k) for k in kinds]
    body = pa.Codec("zstd").decompress(data[2 + size :], n * sum(k.itemsize for k in kinds), asbytes=True) if n else b""
    out, at = [], 0
    for k in kinds:
        out.append(np.ascontiguousarray(np.frombuffer(body, np.uint8, n * k.itemsize, at).reshape(k.itemsize, n).T).view(k).reshape(n))
        at += n * k.itemsize
    return out


def pack_grams(b: np.ndarray, a: np.ndarray, c: np.ndarray, x: np.ndarray, q1: np.ndarray) -> bytes:
    """Rows (b, a, c, x, q1); c and q1 stand once in a list of their pairs."""
    pairs, at = np.unique((c.astype(np.uint64) << np.uint64(16)) | q1, return_inverse=True)
    rows = pack(b, a, at.astype(np.uint16 if len(pairs) < 1 << 16 else np.uint32), x)
    return len(rows).to_bytes(4, "little") + rows + pack((pairs >> np.uint64(16)).astype(np.uint32), (pairs & np.uint64(0xFFFF)).astype(np.uint16))


def unpack_grams(data: bytes) -> list[np.ndarray]:
    size = int.from_bytes(data[:4], "little")
    (b, a, at, x), (c, q1) = unpack(data[4 : 4 + size]), unpack(data[4 + size :])
    return [b, a, c[at], x, q1[at]]


def _tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each row's words and its end, in order."""
    h, row = _text.word_hashes(buf, offsets)
    end = np.frombuffer(END, np.uint8)
    n = len(offsets) - 1
    h = np.concatenate([h, np.repeat(_text.spans(_text.prefix(end), np.array([0]), np.array([1])), n)])
    row = np.concatenate([row, np.arange(n)])
    order = np.argsort(row, kind="stable")
    return h[order], row[order]


def chunk_table(docs: DataFrame, trained: Column) -> DataFrame:
    """(chunk, words, tokens, docs, doc_id, n_tokens, n_train): distinct words' hashes in order; each token's place among them; per document its
    length and whether it is trained on; the documents' ids; and counts of tokens. A chunk holds whole documents."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["chunk", "words", "tokens", "docs", "doc_id", "n_tokens", "n_train"]

    def row_of(held):
        words, place = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        size, good = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
        ids = pa.chunked_array([x[3] for x in held]).combine_chunks()
        cells = [pa.array([held[0][4]], pa.int64()), pa.array([pack(words)], pa.binary()), pa.array([pack(place.astype(np.uint32))], pa.binary()), pa.array([pack(size.astype(np.uint32), good)], pa.binary())]
        cells += [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([len(place)], pa.int64()), pa.array([int(size[good > 0].sum())], pa.int64())]
        return pa.RecordBatch.from_arrays(cells, names)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for lo, hi, buf, offsets in _text.chunks(batch.column("text"), SPLIT_BYTES):
                h, row = _tokens(buf, offsets)
                part = batch.slice(lo, hi - lo)
                held.append((h, np.bincount(row, minlength=hi - lo), part.column("trained").to_numpy(zero_copy_only=False).astype(np.uint8), part.column("doc_id"), part.column("id")[0].as_py()))
                n += len(h)
                if n >= CHUNK_TOKENS:
                    yield row_of(held)
                    held, n = [], 0
        if held:
            yield row_of(held)

    source = docs.select(F.monotonically_increasing_id().alias("id"), "doc_id", "text", F.coalesce(trained, F.lit(False)).alias("trained"))
    return source.mapInArrow(run, f"chunk long, words binary, tokens binary, docs binary, doc_id array<{kind}>, n_tokens long, n_train long")


def _groups(batches, key: str) -> Iterator[tuple[int, Iterator[dict]]]:
    """Runs of rows with one key, as they stream by."""
    rows = (r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist())
    ahead = next(rows, None)
    while ahead is not None:
        now = ahead[key]

        def run():
            nonlocal ahead
            while ahead is not None and ahead[key] == now:  # noqa: B023
                row, ahead = ahead, None
                yield row
                ahead = next(rows, None)

        group = run()
        yield now, group
        for _ in group:
            pass


def _table(rows: list[tuple], spec: str, kinds: dict) -> pa.RecordBatch:
    names = [x.split()[0] for x in spec.split(", ")]
    basic = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    types = [kinds.get(x.split()[0]) or basic[x.split()[1]] for x in spec.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _dealt(df: DataFrame, n: int, key: str, *then: str) -> DataFrame:
    return df.repartition(n, key).sortWithinPartitions(key, *then)


def counts(chunks: DataFrame, shards: int) -> DataFrame:
    """(chunk, shard, data, kinds): numbers and training counts of a chunk's words, in the order of shards the chunk's own order. Words not seen in
    training get 0. ``kinds``, summed over all rows, is the number of words seen."""
    spec = "shard int, chunk long, words binary, n binary"

    def send(batches):
        for batch in batches:
            for r in batch.to_pylist():
                (words,), (place,), (size, good) = unpack(r["words"]), unpack(r["tokens"]), unpack(r["docs"])
                n = np.bincount(place[np.repeat(good > 0, size)], minlength=len(words)).astype(np.uint32)
                # Hashes are in order, so shards are ranges of them.
                cut = np.searchsorted(((words >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32), np.arange(shards + 1))
                for s, (lo, hi) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                    if hi > lo:
                        yield _table([(s, r["chunk"], pack(words[lo:hi]), pack(n[lo:hi]))], spec, {})

    out = "chunk long, shard int, data binary, kinds long"

    def count(batches):
        for shard, group in _groups(batches, "shard"):
            rows = [(r["chunk"], unpack(r["words"])[0], unpack(r["n"])[0]) for r in group]
            words, at = np.unique(np.concatenate([w for _, w, _ in rows]), return_inverse=True)
            c = np.bincount(at, np.concatenate([n for _, _, n in rows])).astype(np.int64)
            rank = np.empty(len(words), np.int64)
            rank[np.argsort(-c, kind="stable")] = np.arange(len(words))
            number = np.where(c > 0, 1 + rank * shards + shard, 0)
            if len(number) and number.max() >= ALL:
                raise ValueError("more kinds of words than 32-bit numbers")
            upto, kinds = 0, int((c > 0).sum())
            for chunk, w, _ in rows:
                mine = at[upto : upto + len(w)]
                upto += len(w)
                yield _table([(chunk, shard, pack(number[mine].astype(np.uint32), np.minimum(c[mine], ALL).astype(np.uint32)), kinds)], out, {})
                kinds = 0

    return _dealt(chunks.select("chunk", "words", "tokens", "docs").mapInArrow(send, spec), shards, "shard").mapInArrow(count, out)


def _mix(x: np.ndarray) -> np.ndarray:
    return _text.mix(x.astype(np.uint64) + np.uint64(_text.BASE))


def blocks(chunks: DataFrame, counted: DataFrame, shards: int, total: int, kinds: int, shard_tokens: int) -> DataFrame:
    """(shard, kind, chunk, data, doc_id) for each chunk: kind 0, bigram counts of frequent middle words; 1, a shard's trigrams, those trained on
    marked; 2, for the last step, what is known of the documents without a shard."""
    id_type = chunks.schema["doc_id"].dataType.simpleString()
    whole = F.lit(None).cast("binary")
    first = chunks.select("chunk", F.lit(-1).alias("shard"), "tokens", "docs", "doc_id")
    then = counted.select("chunk", "shard", F.col("data").alias("tokens"), whole.alias("docs"), F.lit(None).cast(id_type).alias("doc_id"))
    both = _dealt(first.unionByName(then), max(1, shards), "chunk", "shard")
    spec = "shard int, kind int, chunk long, data binary, doc_id ids"

    def run(batches):
        for chunk, group in _groups(batches, "chunk"):
            head, *rest = list(group)
            yield from one(chunk, head, [unpack(r["tokens"]) for r in rest])

    def row(shard, kind, chunk, *columns):
        return _table([(shard, kind, chunk, pack_grams(*columns), None)], spec, {"doc_id": held[0]})

    held: list = [None]

    def one(chunk, head, parts):
        number, c = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.uint32) for k in (0, 1))
        (place,), (size, good) = unpack(head["tokens"]), unpack(head["docs"])
        doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
        p1 = np.where(c > 0, (c - DISCOUNT) / max(total, 1), DISCOUNT * kinds / total if total else 1.0)
        q1 = quantise(p1)
        base = np.bincount(doc, np.log10(c + 1.0)[place], len(size)) - size * np.log10(total + kinds + 1)
        seen = np.bincount(doc, (c > 0)[place], len(size)).astype(np.uint32)
        known = np.where(c >= LEAST_COUNT, number, 0)
        own, small = np.unique(known, return_inverse=True)  # places in own are smaller numbers of the same order
        small = small.astype(np.int32)
        w = small[place]
        rare = 0 if len(own) and own[0] == 0 else -1
        b, a = np.full(len(w), -2, np.int32), np.full(len(w), -2, np.int32)
        b[1:] = np.where(doc[1:] == doc[:-1], w[:-1], -2)
        a[2:] = np.where(doc[2:] == doc[:-2], w[:-2], -2)
        asks = (b >= 0) & (b != rare)
        alone = np.bincount(doc[~asks], q1[place[~asks]], len(size)).astype(np.uint64)
        facts = pack(base, size, seen, good, alone)
        ids = head["doc_id"]
        yield _table([(int(_mix(np.array([chunk]))[0] % np.uint64(shards)), 2, chunk, facts, ids)], spec, {"doc_id": held[0]})
        t = np.flatnonzero(asks)
        if not len(t):
            return
        # Numbers of own, shifted so that 0 is a missing or rare word.
        full = np.append(0, own) if rare < 0 else own
        lift = 1 if rare < 0 else 0
        b, a, z = b[t] + lift, np.where(a[t] >= 0, a[t] + lift, 0), w[t] + lift
        q, d = q1[place[t]], (doc[t].astype(np.uint32) << np.uint32(1)) | good[doc[t]]  # the lowest bit: trained on
        del w, asks, doc, place, t
        bits = len(full).bit_length()
        order = np.argsort((b.astype(np.int64) << 2 * bits) | (a.astype(np.int64) << bits) | z) if 3 * bits < 64 else np.lexsort((z, a, b))
        b, a, z, q, d = (x[order] for x in (b, a, z, q, d))
        del order
        # Frequent middle words have a number of shards, dealt by the first word.
        often = np.zeros(len(full), np.int64)
        often[small + lift] = np.where(c >= LEAST_COUNT, c, 0)
        spread = (-(-often // shard_tokens)).clip(1)
        fb, fa, fz = full[b].astype(np.uint32), full[a].astype(np.uint32), full[z].astype(np.uint32)
        place_of = lambda x, part: (_mix(x.astype(np.uint64) * np.uint64(0x100000001B3) ^ _mix(part)) % np.uint64(shards)).astype(np.int64)
        to = place_of(fb, np.where(spread[b] > 1, (_mix(fa) % spread[b].astype(np.uint64)).astype(np.int64), 0)).astype(np.int32)
        new = np.append(True, (b[1:] != b[:-1]) | (a[1:] != a[:-1]) | (z[1:] != z[:-1]))
        gram = np.cumsum(new) - 1
        n = np.bincount(gram, d & 1)
        heads = np.flatnonzero(new)
        some, q0 = n > 0, np.where(fz[heads] > 0, q[heads], 0)
        wide = np.flatnonzero(some & (spread[b[heads]] > 1))
        if len(wide):
            hb, hz, hn, hq = b[heads][wide].astype(np.int64), z[heads][wide].astype(np.int64), n[wide], q0[wide]
            key, at, inverse = np.unique((hb << bits) | hz, return_index=True, return_inverse=True)
            sums, times = np.bincount(inverse, hn).astype(np.uint32), spread[hb[at]]
            who = np.repeat(np.arange(len(key)), times)
            part = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
            # Two of a word's places may be one shard, which gets the counts once.
            goes = np.unique(who * shards + place_of(full[hb[at]].astype(np.uint32)[who], part))
            who, shard = np.divmod(goes, shards)
            hb, hz = full[hb[at]].astype(np.uint32)[who], full[hz[at]].astype(np.uint32)[who]
            yield from dealt(chunk, 0, shard, hb, np.full(len(who), ALL, np.uint32), hz, sums[who], hq[at][who])
        yield from dealt(chunk, 1, to, fb, fa, fz, d, q)

    def dealt(chunk, kind, to, *columns):
        order = np.argsort(to.astype(np.uint16) if shards < 1 << 16 else to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(shards + 1))
        columns = [x[order] for x in columns]
        for s in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            yield row(s, kind, chunk, *[x[cut[s] : cut[s + 1]] for x in columns])

    def typed(batches):
        def seen():
            for batch in batches:
                held[0] = batch.schema.field("doc_id").type
                yield batch

        yield from run(seen())

    return both.mapInArrow(typed, spec.replace("ids", id_type))


def answers(sent: DataFrame, shards: int) -> DataFrame:
    """(chunk, kind, data, doc_id): kind 0 is what blocks says of documents, 1 a shard's sums for a chunk's documents."""
    id_type = sent.schema["doc_id"].dataType.simpleString()
    spec = "chunk long, kind int, data binary, doc_id ids"

    def run(batches):
        kinds = {}

        def seen():
            for batch in batches:
                kinds["doc_id"] = batch.schema.field("doc_id").type
                yield batch

        for _, group in _groups(seen(), "shard"):
            counted, held = [], []
            for r in group:
                if r["kind"] == 2:
                    yield _table([(r["chunk"], 0, r["data"], r["doc_id"])], spec, kinds)
                elif r["kind"] == 0:
                    counted.append(unpack_grams(r["data"]))
                else:  # stays packed
                    held.append((r["chunk"], r["data"]))
            asked = 0
            for _, data in held:
                b, a, c, x, q1 = unpack_grams(data)
                asked += len(b)
                t = np.flatnonzero(x & 1)
                if len(t):
                    counted.append(_folded(b[t], a[t], c[t], np.ones(len(t), np.int64), np.where(c[t] > 0, q1[t], 0)))
                if sum(len(p[0]) for p in counted[1:]) > max(1 << 22, len(counted[0][0]) if counted else 0):  # equal trigrams of chunks fall together
                    counted = [_merged(counted)]
            columns = [np.concatenate([p[k] for p in counted]) for k in range(5)] if counted else [np.zeros(0, np.uint32)] * 4 + [np.zeros(0, np.uint16)]
            trie, counted = Trie.load(Trie.build(*columns).to_bytes()), []
            trie.expect(asked)
            for chunk, data in held:
                b, a, c, x, q1 = unpack_grams(data)
                sums = np.bincount(x >> 1, trie.cost(b, a, c, q1))
                some = np.flatnonzero(sums)
                yield _table([(chunk, 1, pack(some.astype(np.uint32), sums[some].astype(np.uint64)), None)], spec, kinds)
        _text.release()

    return _dealt(sent, shards, "shard", "kind").mapInArrow(run, spec.replace("ids", id_type))


def _folded(b: np.ndarray, a: np.ndarray, c: np.ndarray, n: np.ndarray, q1: np.ndarray) -> list[np.ndarray]:
    """Equal neighbours (b, a, c) as one, with their sum."""
    first = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (a[1:] != a[:-1]) | (c[1:] != c[:-1])))
    return [b[first], a[first], c[first], np.add.reduceat(n, first), q1[first]]


def _merged(parts: list) -> list[np.ndarray]:
    b, a, c, n, q1 = (np.concatenate([x[k] for x in parts]) for k in range(5))
    order = np.lexsort((c, a, b))
    return _folded(*(x[order] for x in (b, a, c, n.astype(np.int64), q1)))


def totals(answered: DataFrame, parts: int) -> DataFrame:
    """(doc_id, trained, n_tokens, n_known, base_score, quanta) of each document."""
    kind = answered.schema["doc_id"].dataType.elementType.simpleString()
    spec = f"doc_id {kind}, trained boolean, n_tokens long, n_known long, base_score double, quanta long"

    def run(batches):
        id_type = []

        def seen():
            for batch in batches:
                id_type.append(batch.schema.field("doc_id").type.value_type)
                yield batch

        for _, group in _groups(seen(), "chunk"):
            for r in group:
                if r["kind"] == 0:
                    ids, (base, size, known, good, quanta) = r["doc_id"], unpack(r["data"])
                    quanta = quanta.astype(np.int64)
                else:
                    at, sums = unpack(r["data"])
                    quanta[at] += sums.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type[-1]), pa.array(good > 0), *[pa.array(x.astype(np.int64)) for x in (size, known)], pa.array(base), pa.array(quanta)], [x.split()[0] for x in spec.split(", ")])

    return _dealt(answered, parts, "chunk", "kind").mapInArrow(run, spec)


def score(docs: DataFrame, training: Callable[[str], Column], doc_id: str = "doc_id", text: str = "text", *, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, trained, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    ``training`` gives the condition on the name of the id column that a training row meets. Null texts
    are empty and have an end alone. Repeated rows count and score as often as they occur. Without
    training rows every token is unknown, and both scores are 0. Other columns are ignored.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    chunks = materialise(chunk_table(docs, training("doc_id")), "chunks")
    n_all, n = chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0))).first()
    shards = max(1, -(-n_all // shard_tokens))
    counted = materialise(counts(chunks, shards), "counts")
    v = counted.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
    answered = materialise(answers(blocks(chunks, counted, shards, n, v, shard_tokens), shards), "answers")
    out = totals(answered, shards)
    return out.select("doc_id", "trained", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", (-QUANTUM * F.col("quanta")).alias("score"))
