"""Symmetric block-tridiagonal systems as DataFrames, eliminated chunk by chunk.

Unknown i is in block i // m, and only unknowns of one block or of neighbouring blocks share an entry. Every G-th block is
a separator. The unknowns between two separators meet no others, so each stretch is a task: it is eliminated, and what it
adds to its separators is a block-tridiagonal system again, G times as small. Levels end when all fits one stretch; the
solution then goes back level by level. A task holds (G - 1) * m unknowns, whatever the system's size, and the driver none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from wavemill.operators.order import written

#: Unknowns that a task eliminates, about.
STRETCH = 1024
RIDGE = 1e-12


def _dense(p: pd.DataFrame, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Matrix of entries between rows and cols; entries (i, j, a) count both ways."""
    out = np.zeros((len(rows), len(cols)))
    if not len(rows) or not len(cols):
        return out
    for a, b in (("i", "j"), ("j", "i")):
        i, j = p[a].to_numpy(), p[b].to_numpy()
        use = np.isin(i, rows) & np.isin(j, cols) & ((p["i"] != p["j"]).to_numpy() | (a == "i"))
        np.add.at(out, (np.searchsorted(rows, i[use]), np.searchsorted(cols, j[use])), p["a"].to_numpy()[use])
    return out


def _stretch(p: pd.DataFrame, inner) -> tuple[np.ndarray, ...]:
    """(inside, around, own matrix, coupling, right side) of a stretch's entries; those with j = -1 are the right side's."""
    right, entries = p[p["j"] < 0], p[p["j"] >= 0]
    names = np.unique(np.concatenate([p["i"].to_numpy(), entries["j"].to_numpy()]))
    mine = inner(names)
    inside, around = names[mine], names[~mine]
    b = np.zeros(len(inside))
    np.add.at(b, np.searchsorted(inside, right["i"].to_numpy()), right["a"].to_numpy())
    own = _dense(entries, inside, inside)
    own += RIDGE * max(1.0, np.abs(np.diag(own)).max(initial=0)) * np.eye(len(inside))
    return inside, around, own, _dense(entries, inside, around), b


def solve(entries: DataFrame, right: DataFrame, m: int, stretch: int = STRETCH) -> DataFrame:
    """(i, x) for each unknown i >= 0 of entries (i, j, a) and right side (i, b). Each pair is given once, in either order, and
    what is given for one place adds up.

    Unknowns that nothing ties down are held near 0 by a small ridge. Rows with a null are left out. An entry between blocks
    that aren't neighbours is refused.
    """
    g = max(4, stretch // m)
    e = entries.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("a").cast("double").alias("a")).dropna()
    r = right.select(F.col("i").cast("long").alias("i"), F.lit(-1).cast("long").alias("j"), F.col("b").cast("double").alias("a")).dropna()
    low, high = F.least("i", "j"), F.greatest("i", "j")
    e = e.groupBy(low.alias("j"), high.alias("i")).agg(F.sum("a").alias("a")).select("i", "j", "a")
    now = written(e.unionByName(r.groupBy("i", "j").agg(F.sum("a").alias("a"))), "system")
    block = lambda c: F.floor(F.col(c) / m) if isinstance(c, str) else F.floor(c / m)
    if not now.where((F.col("j") >= 0) & (block("i") - block("j") > 1)).isEmpty():
        raise ValueError("an entry joins blocks that aren't neighbours")
    levels: list[DataFrame] = []
    while True:
        last = now.agg(F.max(block("i"))).first()[0]  # one number
        if last is None:
            return now.select("i", F.col("a").alias("x"))
        if last < g:
            break
        separator = lambda c: block(c) % g == g - 1
        chunk = lambda c: F.floor(block(c) / g)
        both = F.when(F.col("j") < 0, separator("i")).otherwise(separator("i") & separator("j"))
        # an entry belongs to the stretch of the end that is no separator
        owner = F.when(separator("i"), chunk("j")).otherwise(chunk("i"))
        owned = written(now.where(~both).select(owner.alias("c"), "i", "j", "a"), "stretches")
        levels.append(owned)

        def forward(p: pd.DataFrame) -> pd.DataFrame:
            _, around, own, link, b = _stretch(p, lambda n: (n // m) % g != g - 1)
            x = np.linalg.solve(own, np.column_stack([link, b]))
            s, t = -link.T @ x[:, :-1], -link.T @ x[:, -1]
            k, j = np.tril_indices(len(around))
            return pd.DataFrame({"i": np.concatenate([around[k], around]), "j": np.concatenate([around[j], np.full(len(around), -1)]), "a": np.concatenate([s[k, j], t])})

        added = owned.groupBy("c").applyInPandas(forward, "i long, j long, a double")
        coarse = now.where(both).unionByName(added).groupBy("i", "j").agg(F.sum("a").alias("a"))
        small = lambda c: (chunk(c) * m + F.col(c) % m).cast("long")
        now = written(coarse.select(small("i").alias("i"), F.when(F.col("j") < 0, F.col("j")).otherwise(small("j")).alias("j"), "a"), "system")

    def whole(p: pd.DataFrame) -> pd.DataFrame:
        inside, _, own, _, b = _stretch(p, lambda n: np.ones(len(n), bool))
        return pd.DataFrame({"i": inside, "x": np.linalg.solve(own, b)})

    x = written(now.groupBy().applyInPandas(whole, "i long, x double"), "solution")  # at most a stretch of unknowns
    for owned in reversed(levels):
        full = F.floor(F.col("i") / m) * g + (g - 1)
        x = x.select((full * m + F.col("i") % m).cast("long").alias("i"), "x")
        c = F.floor(F.floor(F.col("i") / m) / g)
        known = x.withColumn("c", F.explode(F.array(c, c + 1)))

        def back(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            if not len(p):
                return pd.DataFrame({"i": np.zeros(0, np.int64), "x": np.zeros(0)})
            inside, around, own, link, b = _stretch(p, lambda n: (n // m) % g != g - 1)
            at = pd.Series(q["x"].to_numpy(), index=q["i"].to_numpy()).reindex(around).fillna(0.0).to_numpy()
            return pd.DataFrame({"i": inside, "x": np.linalg.solve(own, b - link @ at)})

        inner = owned.groupBy("c").cogroup(known.groupBy("c")).applyInPandas(back, "i long, x double")
        x = written(x.unionByName(inner), "solution")
    return x


def differences(pairs: DataFrame, i: Column, j: Column, lag: Column, weight: Column) -> tuple[DataFrame, DataFrame]:
    """(entries, right side) of the normal equations of weight * (x_j - x_i - lag)^2, summed over rows."""
    p = pairs.select(i.alias("_i"), j.alias("_j"), lag.alias("_d"), weight.alias("_w"))
    three = F.array(F.struct(F.col("_i").alias("i"), F.col("_i").alias("j"), F.col("_w").alias("a")), F.struct(F.col("_j").alias("i"), F.col("_j").alias("j"), F.col("_w").alias("a")), F.struct(F.col("_i").alias("i"), F.col("_j").alias("j"), (-F.col("_w")).alias("a")))
    pull = F.col("_w") * F.col("_d")
    two = F.array(F.struct(F.col("_j").alias("i"), pull.alias("b")), F.struct(F.col("_i").alias("i"), (-pull).alias("b")))
    return p.select(F.inline(three)), p.select(F.inline(two))
