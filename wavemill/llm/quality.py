"""Quality scores by positive-unlabelled learning with the non-negative risk.

A linear model z over hashed byte trigrams and shape statistics is fitted on trusted positives P and
unlabelled text U. With class prior p and the squared loss the risk is
p * E_P[(1 - z)^2] + max(0, E_U[(1 + z)^2] - p * E_P[(1 + z)^2]). It depends on the rows only through
the means of x and x * x' over P and over U, so these are summed over *every* training row in one pass
each, and the driver gets a matrix of fixed size whatever the corpus. The maximum is the largest, over
theta in 0..1, of theta times its second part, so the minimum is found exactly: theta is 1, or the
point where the second part is 0.

The prior is estimated from P and U alone: the least ratio of U's mass to P's over score thresholds of
a first model, fitted on one half of the rows and counted on the other. The score is placed so that
KEPT_POSITIVES of positives that weren't fitted on get THRESHOLD or more.

Features and weights are integers (in units of 1 / UNIT and 1 / FINE), so sums are exact and a text's
score doesn't depend on how rows are parted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wavemill.llm import _text

BUCKETS, THRESHOLD, KEPT_POSITIVES, RIDGE, STEEPNESS = 1 << 8, 0.7, 0.998, 1e-3, 8.0
UNIT, MOST, FINE = 256, 1024, 1 << 24
#: Bound of the labelled ids that are broadcast.
MOST_LABELS = 1 << 18
#: Histograms of z: so many bins over -SPAN..SPAN.
BINS, SPAN = 1 << 14, 4.0
_SHAPE = 12


def features(buf: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """A row per text, whole numbers of units: log-scaled, length-normed counts of hashed byte trigrams, then shape
    statistics, then the constant. Empty texts are all 0 but for the constant. A text's row depends on that text alone."""
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, buckets + _SHAPE))
    out[:, -1] = UNIT
    if not len(buf):
        return out
    row = np.repeat(np.arange(n), size)
    first, last = offsets[:-1][size > 0], offsets[1:][size > 0] - 1
    b = buf.astype(np.uint32)
    before, further = np.zeros_like(b), np.zeros_like(b)  # what stands before in the same text, else 0
    before[1:] = b[:-1]
    before[first] = 0
    further[1:] = before[:-1]
    further[first] = 0
    gram = b | before << np.uint32(8) | further << np.uint32(16)
    gram *= np.uint32(2654435761)
    slot = (gram >> np.uint32(32 - int(buckets).bit_length() + 1)).astype(np.int64)
    for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if hi > lo:
            c = np.log1p(np.bincount(slot[lo:hi], minlength=buckets))
            out[i, :buckets] = c * (UNIT / np.sqrt((c * c).sum()))
    s, e, word_row = _text.words(buf, offsets)
    h, _ = _text.word_hashes(buf, offsets)
    count = np.bincount(word_row, minlength=n)
    words = np.maximum(count, 1)
    chars = np.maximum(size, 1)
    share = lambda mask: np.bincount(row[mask], minlength=n) / chars
    mark = (buf > 32) & (buf < 128) & ~(((buf | 32) >= 97) & ((buf | 32) <= 122)) & ~((buf >= 48) & (buf <= 57))
    after = np.zeros(len(mark), bool)
    after[:-1] = mark[1:]
    after[last] = False
    key = np.sort((word_row.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    fresh = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    kinds = np.bincount((fresh >> np.uint64(40)).astype(np.int64), minlength=n)
    long = np.bincount(word_row, weights=e - s, minlength=n) / words
    out[:, buckets:-1] = UNIT * np.stack([
        share(mark), share((buf >= 65) & (buf <= 90)), share((buf >= 48) & (buf <= 57)), share(buf >= 128), share(buf == 10), share(buf == 32),
        kinds / words, long / 10, np.log1p(count) / 10, np.log1p(size) / 10, share(mark & after),
    ], 1)
    return np.minimum(np.rint(out), MOST)


@dataclass
class Model:
    """z is x @ weight in units of 1 / (UNIT * FINE); ``at``: the z of score THRESHOLD."""

    weight: np.ndarray
    prior: float
    at: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.weight) / (UNIT * FINE)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weight.any():
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(STEEPNESS * (self.margin(x) - self.at) + np.log(THRESHOLD / (1 - THRESHOLD)), -40, 40)))


def moments(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """(2, 2, d, d) sums of x * x' over rows (text, half, positive): of all rows and of the positive ones, by half. The last
    column has the sums of x and the count."""
    d = buckets + _SHAPE
    upper = np.triu_indices(d)

    def run(batches):
        total = np.zeros((4, d, d))
        for batch in batches:
            half, positive = batch.column("half").to_numpy(), batch.column("positive").to_numpy(zero_copy_only=False)
            for lo, hi, buf, offsets in _text.chunks(batch.column("text"), 1 << 19, 512):
                x = features(buf, offsets, buckets)
                for k in (0, 1):
                    part, good = x[half[lo:hi] == k], x[(half[lo:hi] == k) & positive[lo:hi]]
                    total[k] += part.T @ part
                    total[2 + k] += good.T @ good
        for k in range(4):
            some = np.flatnonzero(total[k][upper])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)), pa.array(total[k][upper][some].astype(np.int64))], ["kind", "cell", "sum"])
        _text.release()

    sums = rows.select("text", "half", "positive").mapInArrow(run, "kind int, cell int, sum long").groupBy("kind", "cell").agg(F.sum("sum").alias("sum")).toArrow()
    out = np.zeros((4, d, d))
    kind, cell, value = (sums.column(c).to_numpy() for c in ("kind", "cell", "sum"))
    out[kind, upper[0][cell], upper[1][cell]] = value
    return (np.maximum(out, out.transpose(0, 2, 1)) / (UNIT * UNIT)).reshape(2, 2, d, d)


def histogram(rows: DataFrame, model: Model) -> np.ndarray:
    """(2, BINS) counts of z over rows (text, positive): of all rows and of the positive ones."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches):
        total = np.zeros(2 * BINS, np.int64)
        for batch in batches:
            positive = batch.column("positive").to_numpy(zero_copy_only=False)
            for lo, hi, buf, offsets in _text.chunks(batch.column("text"), 1 << 19, 512):
                z = shared.value.margin(features(buf, offsets, len(shared.value.weight) - _SHAPE))
                place = np.clip((z + SPAN) * (BINS / (2 * SPAN)), 0, BINS - 1).astype(np.int64)
                total += np.bincount(np.concatenate([place, place[positive[lo:hi]] + BINS]), minlength=2 * BINS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bin", "n"])
        _text.release()

    sums = rows.select("text", "positive").mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * BINS, np.int64)
    out[sums.column("bin").to_numpy()] = sums.column("n").to_numpy()
    return out.reshape(2, BINS)


def nonnegative_fit(pos: np.ndarray, unl: np.ndarray, prior: float, ridge: float = RIDGE) -> np.ndarray:
    """Weights of least non-negative risk plus ridge * |w|^2, from the moment matrices of P and U."""
    b, a = pos / pos[-1, -1], unl / unl[-1, -1]
    mp, mu, eye = b[:, -1], a[:, -1], ridge * np.eye(len(a))

    def least(theta: float) -> np.ndarray:
        return np.linalg.solve((1 - theta) * prior * b + theta * a + eye, prior * (1 + theta) * mp - theta * mu)

    def negative(w: np.ndarray) -> float:
        return float(w @ a @ w + 2 * mu @ w + 1 - prior * (w @ b @ w + 2 * mp @ w + 1))

    lo, hi = 0.0, 1.0
    if negative(least(1.0)) >= 0:
        lo = 1.0
    for _ in range(40 if lo < 1 else 0):  # the part falls as theta grows
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if negative(least(mid)) >= 0 else (lo, mid)
    return np.rint(least(lo) * FINE)


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives in U, from histograms of a score over P and U that it wasn't fitted on: the least U-mass over
    P-mass above a threshold that keeps a tenth of P or more. U's mass gets a one-sided error bound, which lifts the estimate
    on few rows; it is held to 0.05..0.95, and at 0.95 the fit treats U as nearly all positive. ``Model.prior`` reports it."""
    n_pos, n_unl = pos.sum(), unl.sum()
    if min(n_pos, n_unl) < 10:
        return 0.5
    p, u = pos[::-1].cumsum() / n_pos, unl[::-1].cumsum() / n_unl
    slack = 1 / np.sqrt(n_unl) + 1 / np.sqrt(n_pos)
    return float(np.clip(((u + slack * np.sqrt(u)) / np.maximum(p, 1e-9))[p >= 0.1].min(), 0.05, 0.95))


def fit(rows: DataFrame, *, prior: float | None = None, buckets: int = BUCKETS) -> Model:
    """Fits on every row of (text, half, positive); half is 0 or 1. Without rows or without positive ones the model gives 0.5 to all."""
    unl, pos = moments(rows, buckets)
    if not pos.any():
        return Model(np.zeros(buckets + _SHAPE), 0.5)
    halves = pos[0].any() and pos[1].any()  # one half is fitted on, the other counted
    own_p, own_u = (pos[0], unl[0]) if halves else (pos.sum(0), unl.sum(0))
    rest = rows.where("half = 1") if halves else rows
    if prior is None:
        prior = estimate_prior(*histogram(rest, Model(nonnegative_fit(own_p, own_u, 0.5), 0.5))[::-1])
    model = Model(nonnegative_fit(own_p, unl.sum(0), prior), prior)
    kept = histogram(rest.where("positive"), model)[1][::-1].cumsum()[::-1]
    place = int(np.flatnonzero(kept >= KEPT_POSITIVES * kept[0])[-1])
    return Model(model.weight, prior, place * 2 * SPAN / BINS - SPAN)


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 for each row; null counts as empty, and a column of that name is replaced."""
    others = [c for c in docs.columns if c != to]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offsets in _text.chunks(batch.column("_text"), 1 << 19, 512):
                s = shared.value.score(features(buf, offsets, len(shared.value.weight) - _SHAPE))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in others), pa.array(s)], [*others, to])
        _text.release()

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != to)
    return docs.select(*[F.col(f"`{c}`") for c in others], F.col(text).alias("_text")).mapInArrow(run, f"{fields}`{to}` double")


def learn(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", training: Callable[[str], Column] | None = None, most_labels: int = MOST_LABELS, buckets: int = BUCKETS) -> Model:
    """Trusted positives are training rows labelled 1; unlabelled text is every training row, its label unseen.

    ``training`` gives a condition on the name of a column of ids. Labels 0 and null are never looked at. A document with
    several labels counts as positive if any is 1. Beyond ``most_labels`` positive ids a share of about as many is
    taken by hash, so that they can be broadcast; the documents are all read.
    """
    keep = training or (lambda _: F.lit(True))
    good = labels.where(F.col(quality) == 1).select(F.col(doc_id).alias("_id")).where(keep("_id")).distinct()
    share = min(1.0, most_labels / max(1, good.count()))
    if share < 1:
        good = good.where(F.xxhash64("_id", F.lit(13)) <= F.lit(int(share * 2**64) - 2**63 - 1))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).where(keep("_id"))
    rows = rows.join(F.broadcast(good.withColumn("_good", F.lit(True))), "_id", "left")  # most_labels ids at most, or nearly
    half = F.pmod(F.xxhash64("_id", "text", F.lit(11)), F.lit(2)).cast("int")
    return fit(rows.select("text", half.alias("half"), F.coalesce("_good", F.lit(False)).alias("positive")), buckets=buckets)
