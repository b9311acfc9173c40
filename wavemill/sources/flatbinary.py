"""A Spark source for flat row-major recordings: (sample, channel) numbers without a header."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def length_in_samples(size: int, channels: int, dtype: str = "float32", sync: int = 0) -> int:
    """Samples in a file of ``size`` bytes; a size that isn't whole raises."""
    width = np.dtype(dtype).itemsize * (channels + sync)
    if size % width:
        raise ValueError(f"{size} bytes aren't a whole number of samples of {width} bytes")
    return size // width


class _Range(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.channels = options["path"], int(options["channels"])
        self.dtype, self.sync = options.get("dtype", "float32"), int(options.get("sync", 0))
        self.rows, self.start, self.stop = int(options.get("chunk", 30_000)), int(options.get("start", 0)), options.get("stop")

    def partitions(self):
        n = length_in_samples(os.stat(self.path).st_size, self.channels, self.dtype, self.sync)
        stop = n if self.stop is None else min(n, int(self.stop))
        return [_Range(a, min(a + self.rows, stop)) for a in range(self.start, stop, self.rows)]

    def read(self, partition):
        import pyarrow as pa

        wide = self.channels + self.sync
        with open(self.path, "rb") as f:
            f.seek(partition.start * wide * np.dtype(self.dtype).itemsize)
            x = np.fromfile(f, self.dtype, (partition.stop - partition.start) * wide).reshape(-1, wide)[:, : self.channels]
        sample = np.repeat(np.arange(partition.start, partition.start + len(x)), self.channels)
        channel = np.tile(np.arange(self.channels, dtype=np.int32), len(x))
        yield pa.RecordBatch.from_arrays([pa.array(sample), pa.array(channel), pa.array(x.ravel().astype(np.float32))], ["sample", "channel", "v"])


class FlatBinary(DataSource):
    """spark.read.format("flatbinary").option("channels", 4)...load(path): sample, channel, v.

    Options: channels; dtype (float32); sync, trailing columns that are dropped; start and stop samples; chunk, samples per partition.
    The path must be visible to the executors, as on a shared mount.
    """

    @classmethod
    def name(cls):
        return "flatbinary"

    def schema(self):
        return "sample long, channel int, v float"

    def reader(self, schema):
        return _Reader(self.options)


def register(spark) -> None:
    spark.dataSource.register(FlatBinary)
