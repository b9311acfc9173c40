"""Structured Streaming forms: detection statistics by watermark, refractory dedup with state, and resumable appends."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, ts: str, keys: list[str], value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums in tumbling windows; rows later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def refractory_stream(events: DataFrame, unit: str, t: str, row_id: str, dead: int) -> DataFrame:
    """(unit, t, row_id) of events that follow the unit's last kept one by ``dead`` or more. A unit's state is one number; rows of a batch are taken in time order."""
    kind = events.schema[unit].dataType.simpleString()

    def step(key, batches, state: GroupState):
        last = state.get[0] if state.exists else None
        p = pd.concat(list(batches)).sort_values([t, row_id])
        keep = []
        for x, r in zip(p[t].tolist(), p[row_id].tolist(), strict=True):
            if last is None or x - last >= dead:
                keep.append((key[0], x, r))
                last = x
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(keep, columns=[unit, t, row_id])

    return events.groupBy(unit).applyInPandasWithState(step, f"{unit} {kind}, {t} long, {row_id} long", "last long", "append", GroupStateTimeout.NoTimeout)


def append_new(spark: SparkSession, source: DataFrame, t: str, path: str) -> int:
    """Appends rows later than the sink's newest; returns the number of rows. A sink that doesn't exist yet takes all."""
    fs = spark._jvm.org.apache.hadoop.fs
    at = fs.Path(path)
    new = source
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        mark = spark.read.parquet(path).agg(F.max(t)).first()[0]
        new = source if mark is None else source.where(F.col(t) > F.lit(mark))
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n
