"""Global order without a single-task window: rows sorted by range and numbered from each range's first place on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: computed once, and kept when executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by: list, to: str = "_at") -> DataFrame:
    """df, written, with ``to``: 0, 1, 2 .. in the order of ``by`` (columns or sort expressions). Rows that tie come in any order,
    which then stays. The driver sees one count per partition."""
    place = F.monotonically_increasing_id()  # the partition times 2^33, plus the place in it
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_place", place)
    rows = written(rows.select("*", F.shiftright("_place", 33).alias("_range"), F.col("_place").bitwiseAND((1 << 33) - 1).alias("_in")).drop("_place"), "sorted")
    total, starts = 0, []
    for r in sorted(rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((r[0], total))
        total += r[1]
    first = df.sparkSession.createDataFrame(starts, "_range long, _first long")  # a row per partition
    return rows.join(F.broadcast(first), "_range").withColumn(to, F.col("_first") + F.col("_in")).drop("_range", "_in", "_first")
