"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidates, exact confirmation.

1. Each document's set of distinct shingle hashes is cut by the high bits of the hash into
   ``bands * rows`` bins; a bin's value is its least hash. Empty bins borrow from a bin that a
   fixed sequence of draws names (optimal densification).
2. Documents with equal sets fall together first; one of them stands for the class.
3. A band of bins is a bucket key. Each bucket links its members to its least member only.
4. Links are confirmed on full sets, in blocks of bounded size: a bucket of m gives m - 1 candidates.
5. Where a bucket still holds several components, the members outside its centre's component are
   compared with the rest in blocks, so no link inside a bucket is lost and nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wavemill.llm import _text
from wavemill.llm._graph import components
from wavemill.llm._store import materialise

SHINGLE, PERCENT, BANDS, ROWS, BLOCK = 5, 85, 24, 5, 256
_PLACE = np.random.default_rng(271_828).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of k-word shingles for each row; fewer words count as one shingle."""
    h, row = _text.word_hashes(buf, offsets)
    n = len(h)
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    acc = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        acc += _text.mix(h[j : n - k + 1 + j] + _PLACE[j]) * _PLACE[j + k]
    acc = _text.mix(acc)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= k:
            yield np.unique(acc[lo : hi - k + 1])
        elif hi > lo:
            part = sum((_text.mix(h[lo + j : lo + j + 1] + _PLACE[j]) * _PLACE[j + k] for j in range(hi - lo)), np.zeros(1, np.uint64))
            yield _text.mix(part + np.uint64(hi - lo))
        else:
            yield np.zeros(0, np.uint64)


def one_permutation(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """(sets, bins) of least hashes; rows of empty sets are 0. Empty bins are densified."""
    edges = np.array([(i << 64) // bins for i in range(bins)] , dtype=np.uint64)
    out, have = np.zeros((len(sets), bins), np.uint64), np.zeros((len(sets), bins), bool)
    for i, s in enumerate(sets):
        if len(s):
            at = np.searchsorted(s, edges)
            have[i] = np.append(at[1:], len(s)) > at
            out[i] = s[np.minimum(at, len(s) - 1)]
    todo_r, todo_b = np.nonzero(~have & have.any(1)[:, None])
    step = 0
    while len(todo_r):
        step += 1
        draw = (_text.mix(np.arange(bins, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(step)) % np.uint64(bins)).astype(np.int64)[todo_b]
        hit = have[todo_r, draw]
        out[todo_r[hit], todo_b[hit]] = out[todo_r[hit], draw[hit]]
        todo_r, todo_b = todo_r[~hit], todo_b[~hit]
    out[~have.any(1)] = 0
    return out


def band_keys(bins: np.ndarray, bands: int) -> np.ndarray:
    rows = bins.shape[1] // bands
    key = np.zeros((len(bins), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        key = _text.mix(key * np.uint64(_text.BASE) + bins[:, j::rows][:, :bands])
    return key.view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, k1, k2, keys): the set's size, a 128-bit name of it, and its bucket keys (none for an empty set)."""

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offsets in _text.chunks(batch.column(1)):
                sets = list(shingle_sets(buf, offsets, shingle))
                size = np.array([len(s) for s in sets])
                full = size > 0
                keys = band_keys(one_permutation(sets, bands * rows), bands)[full].ravel()
                name = [np.array([f(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for f in (lambda s: s, lambda s: _text.mix(s ^ np.uint64(_text.BASE)))]
                ends = np.append(0, np.cumsum(full * bands)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(size), *map(pa.array, name), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))], ["id", "n_shingles", "k1", "k2", "keys"])
        _text.release()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_shingles long, k1 long, k2 long, keys array<long>")


def full_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, body): the sorted shingle hashes as bytes."""

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offsets in _text.chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([s.tobytes() for s in shingle_sets(buf, offsets, shingle)], pa.binary())], ["id", "body"])
        _text.release()

    return docs.select(id_col, text_col).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, body binary")


def links_in_block(table: pa.Table, percent: int) -> pa.Table:
    """Confirmed links of one block: each row of side 0 with each row whose side or place is later and whose component differs.

    At most one link per pair of components is given, which is all that connecting them takes.
    """
    none = pa.table({"a": pa.array([], table["id"].type), "b": pa.array([], table["id"].type)})
    bodies = [np.frombuffer(x.as_py(), np.uint64) for x in table["body"]]
    size = np.array([len(b) for b in bodies], np.int64)
    side, comp = table["side"].to_numpy(), np.unique(table["component"].to_numpy(), return_inverse=True)[1]
    left, n = np.flatnonzero(side == 0), len(bodies)
    if not len(left) or n < 2:
        return none
    # Only shingles of some left row count; a matrix product in slices of columns gives the sizes of intersections.
    vocab = np.unique(np.concatenate([bodies[i] for i in left]))
    at, who = [], []
    for i, b in enumerate(bodies):
        if len(vocab):
            p = np.searchsorted(vocab, b)
            hit = vocab[np.minimum(p, len(vocab) - 1)] == b
            at.append(p[hit])
            who.append(np.full(int(hit.sum()), i))
    at, who = np.concatenate(at), np.concatenate(who)
    order = np.argsort(at, kind="stable")
    at, who = at[order], who[order]
    row_of = np.full(n, -1)
    row_of[left] = np.arange(len(left))
    both, width = np.zeros((len(left), n), np.float32), 4096
    for c in range(0, len(vocab), width):
        lo, hi = np.searchsorted(at, [c, c + width])
        m = np.zeros((n, min(width, len(vocab) - c)), np.float32)
        m[who[lo:hi], at[lo:hi] - c] = 1
        both += m[left] @ m.T
    both = both.astype(np.int64)
    union = size[left][:, None] + size[None, :] - both
    ok = (100 * both >= percent * union) & (union > 0) & (comp[left][:, None] != comp[None, :])
    i, j = np.nonzero(ok)
    if not len(i):
        return none
    first = np.unique(np.minimum(comp[left[i]], comp[j]) * np.int64(n) + np.maximum(comp[left[i]], comp[j]), return_index=True)[1]
    return pa.table({"a": table["id"].take(pa.array(left[i[first]])), "b": table["id"].take(pa.array(j[first]))})


def confirm(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of blocks (k1, k2, k3, side, id, component), each of a bounded number of rows."""
    kind = sets.schema["id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        return links_in_block(table, percent)

    return blocks.join(sets, "id").select("k1", "k2", "k3", "side", "id", "component", "body").groupBy("k1", "k2", "k3").applyInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs.

    Two documents are linked when 100 * |A & B| >= percent * |A | B| over their distinct shingles
    (lower-cased A-Z, words between blanks). component_id is the least id reachable; kept marks it.
    Null and empty texts have an empty set and stand alone. Texts of fewer words than a shingle are
    one shingle. A repeated row gives a row each time; rows that share an id share its links. A null
    id stands alone. Other columns of docs are ignored. At similarity s a pair shares some bucket
    with probability 1 - (1 - s**rows)**bands: 0.999999 at 0.85 with the defaults.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks = materialise(sketches(docs, "id", "text", shingle, bands, rows), "sketches")
    full = marks.where("n_shingles > 0 AND id IS NOT NULL")
    classes = materialise(full.groupBy("k1", "k2", "n_shingles").agg(F.min("id").alias("rep")), "classes")
    reps = full.join(classes, ["k1", "k2", "n_shingles"]).where("id = rep").dropDuplicates(["k1", "k2", "n_shingles"])
    keyed = reps.select("rep", F.explode("keys").alias("key"))
    centres = keyed.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("most")).where("centre < most").select("key", "centre")
    buckets = materialise(keyed.join(centres, "key").select("key", "centre", "rep").distinct(), "buckets")
    stars = materialise(buckets.where("rep <> centre").groupBy("centre", "rep").agg(F.lit(1).alias("one")).drop("one"), "stars")

    wanted = buckets.select(F.col("rep").alias("id")).distinct()
    sets = materialise(full_sets(docs.join(wanted, "id", "left_semi"), "id", "text", shingle), "sets")

    salt = lambda c, n: F.pmod(F.xxhash64(c, F.lit(7)), n)
    sized = stars.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("parts"))
    members = stars.join(sized, "centre").select(F.col("centre").alias("k1"), salt("rep", F.col("parts")).alias("k2"), F.lit(0).alias("k3"), F.lit(1).alias("side"), F.col("rep").alias("id"), F.col("rep").alias("component"))
    heads = sized.select(F.col("centre").alias("k1"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("k2"), F.lit(0).alias("k3"), F.lit(0).alias("side"), F.col("centre").alias("id"), F.col("centre").alias("component"))
    links = materialise(confirm(members.unionByName(heads), sets, percent), "links")

    # What the stars left open: buckets that hold more than one component.
    first = components(links)
    named = buckets.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_ = named.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("names")).where("c0 < c1")
    open_ = open_.groupBy("n", "names").agg(F.min("key").alias("key"))  # buckets with the same members are compared once
    heart = first.withColumnRenamed("node", "centre").withColumnRenamed("component", "main")
    rest = materialise(named.join(open_.select("key"), "key").join(heart, "centre", "left").select("key", "rep", "component", (F.col("component") == F.coalesce("main", "centre")).alias("inner")), "open")
    count = rest.groupBy("key").agg(F.ceil(F.sum(F.when(F.col("inner"), 1).otherwise(0)) / F.lit(block)).alias("ins"), F.ceil(F.sum(F.when(F.col("inner"), 0).otherwise(1)) / F.lit(block)).alias("outs"))
    placed = rest.join(count, "key").withColumn("own", salt("rep", F.when(F.col("inner"), F.col("ins")).otherwise(F.col("outs"))))
    upto = lambda a, b: F.sequence(a.cast("long"), b.cast("long"))
    grid = lambda df, k2, k3, side: df.select(F.col("key").alias("k1"), k2.cast("long").alias("k2"), k3.cast("long").alias("k3"), F.lit(side).alias("side"), F.col("rep").alias("id"), "component")
    outer, inner = placed.where("NOT inner AND outs > 0"), placed.where("inner")
    # Rows outside meet each part of those inside (k3 >= 0), and each other (k3 = -1 - part).
    blocks = (
        grid(outer.where("ins > 0").withColumn("x", F.explode(upto(F.lit(0), F.col("ins") - 1))), F.col("own"), F.col("x"), 0)
        .unionByName(grid(inner.where("outs > 0").withColumn("x", F.explode(upto(F.lit(0), F.col("outs") - 1))), F.col("x"), F.col("own"), 1))
        .unionByName(grid(outer.withColumn("x", F.explode(upto(F.col("own"), F.col("outs") - 1))), F.col("own"), -1 - F.col("x"), 0))
        .unionByName(grid(outer.withColumn("x", F.explode(upto(F.lit(0), F.col("own")))).where("x < own"), F.col("x"), -1 - F.col("own"), 1))
    )
    more = confirm(blocks, sets, percent)
    whole = components(links.unionByName(more))

    mine = marks.join(classes, ["k1", "k2", "n_shingles"], "left").withColumn("rep", F.coalesce("rep", "id"))
    tied = whole.withColumnRenamed("node", "rep")
    return mine.join(tied, "rep", "left").select("id", "n_shingles", F.coalesce("component", "rep").alias("component_id"), F.coalesce(F.col("id") == F.coalesce("component", "rep"), F.lit(True)).alias("kept"))
