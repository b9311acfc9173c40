"""SentencePiece segmentation by sampling, and lossless decoding.

The pieces of a public model span a lattice over each blank-led stretch of a text: an arc is a piece,
weighted by the piece's rank. Forward filtering sums the weights of all paths to each byte; backward
sampling draws one path from its end, with draws that are a hash of seed, row key and place, so the
same row gives the same pieces on any cluster. Characters that no piece spells become byte pieces.

Stretches repeat, so a task filters each distinct one once and remembers it for its later chunks (up to
REMEMBERED arcs, then it starts anew; what is remembered never changes a result, since chances are
integers). Draws are made for all occurrences in lockstep. Spaces are pieces' own spaces, so decoding
returns the text byte for byte.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wavemill.llm import _text

SEED, SHARPNESS, BYTE_WEIGHT, PIECES_AT_ONCE = 17, 1.5, -30.0, 1 << 16
REMEMBERED = 500_000
#: Chances are multiples of 2**-UNIT.
UNIT = 28
HEAD = 4


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Byte strings and log-weights of a model's pieces. The marker of spaces is a space here."""

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_of, self.byte_id, spelled = [b""] * n, np.zeros(256, np.int32), {}
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:-1], 16)
                self.bytes_of[i], self.byte_id[value] = bytes([value]), i
            elif not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i)):
                self.bytes_of[i] = model.id_to_piece(i).replace("▁", " ").encode()
                spelled.setdefault(self.bytes_of[i], i)
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.joined = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        ids = np.array(list(spelled.values()), np.int32)
        keys = raw_spans(raw_prefix(self.joined), self.starts[ids], self.starts[ids] + self.lengths[ids])
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        assert len(np.unique(keys)) == len(keys)
        self.weight = -sharpness * np.log(np.arange(n) + 2.0)
        self.weight[self.byte_id] = BYTE_WEIGHT
        self.sizes = sorted({len(b) for b in spelled})
        bits = 20
        self.bits, self.table = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.table[(self.keys >> self.bits).astype(np.int64)] = True
        # By the hash of a place's first HEAD bytes: the longest piece that may start there.
        long = ids[self.lengths[ids] > HEAD]
        heads = raw_spans(raw_prefix(self.joined), self.starts[long], self.starts[long] + HEAD)
        self.reach = np.zeros(1 << bits, np.int16)
        np.maximum.at(self.reach, (heads >> self.bits).astype(np.int64), self.lengths[long].astype(np.int16))
        self.memory = Memory()

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece ids of hashes, -1 where there is none; most misses end at a bit table."""
        out = np.full(len(keys), -1, np.int32)
        maybe = np.flatnonzero(self.table[(keys >> self.bits).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == keys[maybe]
        out[maybe[hit]] = self.ids[at[hit]]
        return out


def raw_prefix(buf: np.ndarray) -> np.ndarray:
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_text.BYTE_CODE[buf] * _text.powers(len(buf) + 1)[0][: len(buf)], out=out[1:])
    return out


raw_spans = _text.spans


@lru_cache(maxsize=2)
def load(path: str, sharpness: float) -> Pieces:
    return Pieces(path, sharpness)


def stretches(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row): runs of spaces with the run of other bytes after them; no piece crosses their bounds."""
    blank = buf == 32
    first = np.zeros(len(buf), bool)
    first[1:] = blank[1:] & ~blank[:-1]
    first[offsets[:-1][offsets[:-1] < len(buf)]] = True
    starts = np.flatnonzero(first)
    return starts, np.append(starts[1:], len(buf)).astype(np.int64), np.searchsorted(offsets, starts, "right") - 1


def arcs(p: Pieces, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Arcs (stretch, place of start, length, piece) of distinct stretches, by stretch and then end."""
    sums, size = raw_prefix(buf), ends - starts
    who = np.repeat(np.arange(len(starts)), size)
    place = np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size)
    here, left = starts[who] + place, size[who] - place
    out = []
    first = buf[here]
    lead = (first & 0xC0) != 0x80
    width = np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4)))
    alone = np.zeros(len(who), bool)  # characters that a piece of their own spells
    ok, reach = np.flatnonzero(lead), None
    for n in p.sizes:
        if n > HEAD and reach is None:
            ok = ok[left[ok] > HEAD]
            reach = p.reach[(raw_spans(sums, here[ok], here[ok] + HEAD) >> p.bits).astype(np.int64)]
        more = left[ok] >= n if reach is None else (left[ok] >= n) & (reach >= n)
        ok, reach = ok[more], reach if reach is None else reach[more]
        if len(ok):
            got = p.find(raw_spans(sums, here[ok], here[ok] + n))
            hit = got >= 0
            out.append((who[ok[hit]], place[ok[hit]], np.full(int(hit.sum()), n), got[hit]))
            alone[ok[hit & (width[ok] == n)]] = True
    # Each byte of a character that no piece spells.
    at = np.maximum.accumulate(np.where(lead, np.arange(len(who)), 0)) if len(who) else np.zeros(0, np.int64)
    bare = np.flatnonzero(~alone[at])
    out.append((who[bare], place[bare], np.ones(len(bare), np.int64), p.byte_id[first[bare]]))
    w, s, n, i = (np.concatenate([o[k] for o in out]) for k in range(4))
    base = np.concatenate([[0], np.cumsum(size + 1)])
    order = np.argsort(((base[w] + s + n) << 16) | n, kind="stable")  # runs that are in order already, merged
    return w[order], s[order], n[order], i[order]


def filtered(p: Pieces, size: np.ndarray, arc: tuple) -> tuple[np.ndarray, np.ndarray]:
    """For arcs ordered by (stretch, end): cumulative chances among the arcs into the same end in units of 2**-UNIT, and the arcs' end nodes.

    Ends are handled in lockstep: step e fills place e of every stretch that is long enough.
    """
    w, s, n, i = arc
    base = np.concatenate([[0], np.cumsum(size + 1)])
    alpha = np.full(base[-1], -np.inf)
    alpha[base[:-1]] = 0.0
    node, start, weight = base[w] + s + n, base[w] + s, p.weight[i]
    order = np.argsort((s + n).astype(np.uint16) if len(n) and (s + n).max() < 1 << 16 else s + n, kind="stable")
    bounds = np.searchsorted((s + n)[order], np.arange(1, (int(size.max()) if len(size) else 0) + 2))
    chance = np.zeros(len(w), np.int64)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        a = order[lo:hi]
        if not len(a):
            continue
        to = node[a]
        got = alpha[start[a]] + weight[a]
        cut = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        group = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(a))))
        top = np.maximum.reduceat(got, cut)
        part = np.exp(got - top[group])
        total = np.add.reduceat(part, cut)
        alpha[to[cut]] = top + np.log(total)
        run = np.cumsum((part / total[group] * (1 << UNIT)).astype(np.int64))
        chance[a] = run - np.append(0, run)[cut][group]
    return chance, node


class Memory:
    """Stretches filtered so far: by hash, the node of their start; by node, the arcs that end there."""

    def __init__(self):
        none = np.zeros(0, np.int64)
        self.keys, self.base, self.into = np.zeros(0, np.uint64), none, np.zeros(1, np.int64)
        self.level, self.length, self.piece = none, np.zeros(0, np.int32), np.zeros(0, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Start nodes of hashes, -1 where unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.base[at], -1)

    def add(self, keys: np.ndarray, size: np.ndarray, arc: tuple, chance: np.ndarray, node: np.ndarray) -> None:
        nodes = len(self.into) - 1
        base = np.concatenate([[0], np.cumsum(size + 1)])
        into = np.cumsum(np.bincount(node, minlength=base[-1])[: base[-1]])
        keys, starts = np.concatenate([self.keys, keys]), np.concatenate([self.base, base[:-1] + nodes])
        order = np.argsort(keys, kind="stable")
        self.keys, self.base = keys[order], starts[order]
        self.into = np.concatenate([self.into, into + len(self.level)])
        self.level = np.concatenate([self.level, ((node + nodes) << UNIT) + chance])
        self.length, self.piece = np.concatenate([self.length, arc[2].astype(np.int32)]), np.concatenate([self.piece, arc[3]])


def encode_chunk(p: Pieces, buf: np.ndarray, offsets: np.ndarray, keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, piece) of all rows in order. Each row that isn't empty gets a leading space."""
    size = np.diff(offsets)
    extra = (size > 0).astype(np.int64)
    to = np.concatenate([[0], np.cumsum(size + extra)])
    wide = np.full(to[-1], 32, np.uint8)
    wide[np.arange(len(buf)) + np.repeat(np.cumsum(extra), size)] = buf
    st, en, row = stretches(wide, to)
    names, first, kind = np.unique(raw_spans(raw_prefix(wide), st, en), return_index=True, return_inverse=True)
    if len(p.memory.level) > REMEMBERED:
        p.memory = Memory()
    m = p.memory
    fresh = np.flatnonzero(m.find(names) < 0)
    if len(fresh):
        us, ue = st[first[fresh]], en[first[fresh]]
        arc = arcs(p, wide, us, ue)
        m.add(names[fresh], ue - us, arc, *filtered(p, ue - us, arc))
    # Arcs are ordered by node, so those into a node are a slice; draw along all occurrences at once.
    start = m.find(names)[kind]
    at = en - st
    live = np.argsort(start, kind="stable")  # neighbours search the same stretch of memory
    got_who, got_at, got_piece = [], [], []
    salt = _text.mix(keys + np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64)))[row] + (st - to[row]).astype(np.uint64) * np.uint64(_text.BASE)
    while len(live):
        here = start[live] + at[live]
        draw = (_text.mix(salt[live] ^ _text.mix(at[live].astype(np.uint64) + np.uint64(1))) >> np.uint64(64 - UNIT)).astype(np.int64)
        # The level of the last arc into a node may fall short of its whole, by rounding down.
        a = np.clip(np.searchsorted(m.level, (here << UNIT) + draw, "right"), m.into[here], m.into[here + 1] - 1)
        got_who.append(live)
        at[live] -= m.length[a]
        got_at.append(at[live])
        got_piece.append(m.piece[a])
        live = live[at[live] > 0]
    who, pos, piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (got_who, got_at, got_piece))
    order = np.argsort(st[who] + pos, kind="stable") if len(who) else np.zeros(0, np.int64)
    return row[who[order]], piece[order]


def encode(docs: DataFrame, model: str | None = None, *, key: str = "doc_id", text: str = "text", to: str = "pieces", seed: int = SEED, sharpness: float = SHARPNESS, chunk_bytes: int = 1 << 18) -> DataFrame:
    """docs with a column of sampled piece ids (array<int>); a column of that name is replaced.

    Null and empty texts give no pieces. The draw depends on seed, the key cast to string (null: its
    own value) and the text alone, so repeated rows are segmented alike and order doesn't matter.
    """
    path = model or default_model()
    others = [c for c in docs.columns if c != to]

    def run(batches):
        p = load(path, sharpness)
        for batch in batches:
            keys = batch.column("_key").to_numpy(zero_copy_only=False).view(np.uint64)
            for lo, hi, buf, offsets in _text.chunks(batch.column(given), chunk_bytes):
                row, piece = encode_chunk(p, buf, offsets, keys[lo:hi], seed)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=hi - lo))]).astype(np.int32)
                cols = [batch.column(c).slice(lo, hi - lo) for c in others]
                yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(ends), pa.array(piece.astype(np.int32)))], [*others, to])
        p.memory = Memory()
        _text.release()

    given = text if text in others else "_text"  # the text travels once
    extra = [] if given == text else [F.col(text).alias("_text")]
    source = docs.select(*[F.col(f"`{c}`") for c in others], F.xxhash64(F.col(key).cast("string")).alias("_key"), *extra)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != to)
    return source.mapInArrow(run, f"{fields}, `{to}` array<int>")


def decode(docs: DataFrame, model: str | None = None, *, pieces: str = "pieces", to: str = "decoded") -> DataFrame:
    """docs with the text that the pieces spell. No pieces (or null) spell the empty text."""
    path = model or default_model()
    others = [c for c in docs.columns if c != to]

    def run(batches):
        p = load(path, SHARPNESS)
        for batch in batches:
            col = batch.column(pieces)
            counts = np.nan_to_num(np.asarray(pa.compute.list_value_length(col).to_numpy(zero_copy_only=False), float)).astype(np.int64)
            ids, upto = col.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(counts)])
            lo = 0
            while lo < len(counts):  # whole rows of about PIECES_AT_ONCE pieces
                hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PIECES_AT_ONCE, "right")) - 1)
                some = ids[upto[lo] : upto[hi]]
                size = p.lengths[some]
                done = np.concatenate([[0], np.cumsum(size)])
                flat = p.joined[np.arange(done[-1]) + np.repeat(p.starts[some] - done[:-1], size)]
                ends = done[upto[lo : hi + 1] - upto[lo]]
                texts = [flat[a + 1 : b].tobytes() if b > a else b"" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in others), pa.array(texts, pa.binary()).cast(pa.string())], [*others, to])
                lo = hi
        _text.release()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != to)
    return docs.select(*[F.col(f"`{c}`") for c in others]).mapInArrow(run, f"{fields}, `{to}` string")
