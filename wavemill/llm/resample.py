"""Importance resampling towards a target: hashed n-gram weights and a seeded draw of the highest perturbed scores.

Features are runs of 1 to GRAMS words; a feature's bucket is its crc32 modulo BUCKETS. A bucket's gain says how
much likelier it is in the target than in the corpus, a text's weight is the sum of its features' gains, and
seeded Gumbel noise on top makes the highest scores a draw without replacement in proportion to exp(weight / SCALE).

Corpus counts deduplicate segments: newlines part words, so texts are cut into lines there and equal lines are
counted together in one aggregation. Each distinct line's features are found once and count as often as the line
occurs; the n-grams that cross lines are added by a second pass that looks at nothing else. The driver and the
tasks that score get one number per bucket, whatever the corpus.

A crc of joined strings follows from the parts' crcs and lengths, so an n-gram is a few table lookups and no
n-gram is ever made as a string, but for words over LONGEST bytes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wavemill.llm import _text
from wavemill.llm._store import materialise

BUCKETS, GRAMS, SCALE = 10_000, 3, 1000
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
LONGEST, CHUNK, ROWS = 255, 1 << 20, 1 << 14
#: Bytes that part words once A-Z are lower-cased: all ASCII but digits and letters.
PART = np.arange(256) < 128
PART[48:58] = PART[97:123] = False


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ ((c & np.uint32(1)) * np.uint32(0xEDB88320))
    return c


BYTE = _byte_table()


def _shift_table() -> np.ndarray:
    """[n, k, b]: what byte k of a crc turns to after n zero bytes; the shifted crc is the xor over k."""
    out = np.empty((LONGEST + 2, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, len(out)):
        out[n] = (out[n - 1] >> np.uint32(8)) ^ BYTE[out[n - 1] & np.uint32(255)]
    return out


SHIFT = _shift_table().reshape(-1)


def shifted(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """crc32 of a followed by b is shifted(crc32(a), len(b)) ^ crc32(b)."""
    at = by * 1024
    out = SHIFT[at + (crc & np.uint32(255))]
    for k in (1, 2, 3):
        out ^= SHIFT[at + 256 * k + ((crc >> np.uint32(8 * k)) & np.uint32(255))]
    return out


def word_crcs(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of each span of bytes."""
    size = end - start
    order = np.argsort(-np.minimum(size, LONGEST + 1), kind="stable")
    begin, falling = start[order], size[order]
    n_long = int((falling > LONGEST).sum())
    out, falling, at = np.full(len(size), 0xFFFFFFFF, np.uint32), falling[n_long:], begin[n_long:]
    c = out[n_long:]
    left = len(at) - np.cumsum(np.bincount(falling, minlength=1))  # spans longer than 0, 1, 2 ..
    for i, k in enumerate(left[:-1].tolist()):
        c[:k] = BYTE[(c[:k] ^ buf[at[:k] + i]) & np.uint32(255)] ^ (c[:k] >> np.uint32(8))
    c ^= np.uint32(0xFFFFFFFF)
    for i in range(n_long):
        out[i] = zlib.crc32(buf[begin[i] : begin[i] + size[order[i]]].tobytes())
    back = np.empty_like(out)
    back[order] = out
    return back


def gram_crcs(buf: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, words: int, crc: np.ndarray | None = None) -> np.ndarray:
    """crc32 of each run of ``words`` spans from ``first`` on, joined by one space."""
    size = end - start
    crc = word_crcs(buf, start, end) if crc is None else crc
    out = crc[first]
    blank = np.uint32(zlib.crc32(b" "))
    for k in range(1, words):
        n, c = size[first + k], crc[first + k]
        out = shifted(out, np.minimum(n, LONGEST) + 1) ^ shifted(np.full(len(n), blank), np.minimum(n, LONGEST)) ^ c
    if words > 1 and (size > LONGEST).any():
        for i in np.flatnonzero(np.logical_or.reduce([size[first + k] > LONGEST for k in range(1, words)])).tolist():
            out[i] = zlib.crc32(b" ".join(buf[start[w] : end[w]].tobytes() for w in range(first[i], first[i] + words)))
    return out


def _words(batch: pa.RecordBatch):
    """Yields (first row, rows, lower-cased bytes, starts, ends, rows of words) of whole rows."""
    for lo, hi, buf, offsets in _text.chunks(batch.column("_text"), CHUNK, ROWS):
        buf = _text.FOLD[buf]
        yield (lo, hi - lo, buf, *_text.words(buf, offsets, PART))


def _counted(rows: DataFrame, per_chunk) -> DataFrame:
    """(bucket, n) of features: a task adds up its chunks before it sends a number per bucket."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for chunk in _words(batch):
                for crc, times in per_chunk(batch, *chunk):
                    np.add.at(total, (crc % np.uint32(BUCKETS)).astype(np.int64), times)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])
        _text.release()

    return rows.mapInArrow(run, "bucket int, n long")


def _within(batch, lo, n, buf, start, end, row):
    """Features of distinct lines, each as often as its line occurs."""
    times = batch.column("times").to_numpy()[lo : lo + n]
    crc = word_crcs(buf, start, end)
    for k in range(GRAMS):
        first = np.flatnonzero(row[k:] == row[: len(row) - k])
        yield gram_crcs(buf, start, end, first, k + 1, crc), times[row[first]]


def _across(batch, lo, n, buf, start, end, row):
    """n-grams whose first and last word are in different lines of one text."""
    line = np.searchsorted(np.flatnonzero(buf == 10), start)
    for k in range(1, GRAMS):
        first = np.flatnonzero((row[k:] == row[: len(row) - k]) & (line[k:] != line[: len(row) - k]))
        need, place = np.unique(first[:, None] + np.arange(k + 1), return_inverse=True)
        place = place.reshape(-1, k + 1)[:, 0] if len(first) else np.zeros(0, np.int64)
        yield gram_crcs(buf, start[need], end[need], place, k + 1), 1


def bucket_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Features of all rows by bucket; null and empty texts have none. The lines of a text meet in one aggregation by the line."""
    texts = docs.select(F.col(f"`{text}`").alias("_text")).where("_text <> ''")
    lines = texts.select(F.explode(F.split("_text", "\n")).alias("_text")).where("_text <> ''").groupBy("_text").agg(F.count(F.lit(1)).alias("times"))
    both = _counted(lines, _within).unionAll(_counted(texts.where("instr(_text, '\n') > 0"), _across))
    got = both.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row per bucket at most
    out = np.zeros(BUCKETS, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(SCALE * log ratio) of smoothed shares by bucket, target over corpus."""
    up, down = (target + 1.0) * (corpus.sum() + float(BUCKETS)), (corpus + 1.0) * (target.sum() + float(BUCKETS))
    return np.floor(SCALE * np.log(up / down)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text") -> DataFrame:
    """docs with ``n_words``, ``n_features`` and ``weight``, columns of these names replaced; null and empty texts have 0 of each."""
    new = ["n_words", "n_features", "weight"]
    others = [c for c in docs.columns if c not in new and c != text]
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # a number per bucket

    def run(batches):
        for batch in batches:
            for lo, n, buf, start, end, row in _words(batch):
                crc, total = word_crcs(buf, start, end), np.zeros(n, np.int64)
                words, features = np.bincount(row, minlength=n), np.zeros(n, np.int64)
                for k in range(GRAMS):
                    first = np.flatnonzero(row[k:] == row[: len(row) - k])
                    value = shared.value[gram_crcs(buf, start, end, first, k + 1, crc) % np.uint32(BUCKETS)]
                    total += np.bincount(row[first], weights=value, minlength=n).astype(np.int64)
                    features += np.maximum(words - k, 0)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, n) for c in others), pa.array(words.astype(np.int64)), pa.array(features), pa.array(total)], [*others, *new])
        _text.release()

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in others)
    return docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").alias("_text")).mapInArrow(run, f"{fields}n_words long, n_features long, weight long")


def noise(doc_id: str, seed: int = SEED) -> Column:
    """floor(SCALE * Gumbel noise) from a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(doc_id).cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(scored: DataFrame, doc_id: str = "doc_id", *, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Adds ``rank``: 1, 2, 3 .. for the floor(percent * N / 100) highest scores of the N rows with enough words and a score, ties to the
    smaller id; null for others. Repeated ids are rows of their own, those of equal score too take ranks in any order.

    Rows are sorted by range over all tasks and numbered from each range's first place on, so no task holds all.
    """
    may = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    rows = scored.drop("rank").withColumn("_out", (~may).cast("int"))
    by = [F.col("_out"), F.col("score").desc(), F.col(doc_id)]
    place = F.monotonically_increasing_id()  # the partition times 2^33, plus the place in it
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_place", place)
    rows = materialise(rows.select("*", F.shiftright("_place", 33).alias("_part"), F.col("_place").bitwiseAND((1 << 33) - 1).alias("_at")).drop("_place"), "sorted")
    sizes = sorted((r._part, r.n, r.m) for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("_out")).alias("m")).collect())  # a row per partition
    before, total, ends = {}, 0, 0
    for part, n, m in sizes:
        before[part], total, ends = total, total + n, ends + m
    starts = rows.sparkSession.createDataFrame(list(before.items()), "_part long, _before long")
    rank = (F.col("_before") + F.col("_at") + 1).cast("long")
    ranked = rows.join(F.broadcast(starts), "_part")
    return ranked.withColumn("rank", F.when((F.col("_out") == 0) & (rank <= percent * ends // 100), rank)).drop("_out", "_part", "_at", "_before")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", *, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without the text, with n_words, n_features, weight, score and rank. Gains come from all rows of docs and target; an empty
    target or corpus has counts of 0. Null and empty texts weigh 0; a row without an id has no score. Repeated rows count and are
    ranked each. Other columns stay, but for those of the new names."""
    gain = gains(bucket_counts(docs, text), bucket_counts(target, text))
    scored = weigh(docs.drop("score", "rank"), gain, text).withColumn("score", F.col("weight") + noise(doc_id, seed))
    return draw(scored, doc_id, least_words=least_words, percent=percent)
