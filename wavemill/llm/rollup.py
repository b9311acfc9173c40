"""Token counts kept by deltas: additive totals by source, language and tokenizer version.

A rollup is a folder of committed batches. A batch is a table of signed rows (an insert is +1 document
and +n tokens, a delete the negative, a revision a pair of them), summed to one row per key before it
is written. Its folder is named after its batch id alone, and Spark's committer shows it as a whole or
not at all: a batch that is committed again, after a lost executor or a repeated request, finds its
success marker and adds nothing. Totals are the sum over batches; compaction folds old ones into one.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wavemill.llm._store import materialise  # noqa: F401  for callers that commit several batches of one count

KEYS = ["source", "lang", "tokenizer"]
MEASURES = ["documents", "tokens", "characters"]
SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long, characters long"


@lru_cache(maxsize=4)
def _encoding(name: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", to: str = "tokens") -> DataFrame:
    """docs with the number of byte-level BPE tokens of each whole text; null and empty texts have 0. A column of that name is replaced."""
    others = [c for c in docs.columns if c != to]

    def run(batches):
        enc = _encoding(tokenizer)
        for batch in batches:
            n = [len(enc.encode_ordinary(t.as_py())) if t.as_py() else 0 for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(n, pa.int64())], [*others, to])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != to)
    return docs.select(*[F.col(f"`{c}`") for c in others], F.col(text).alias("_text")).mapInArrow(run, f"{fields}`{to}` long")


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """Deltas of rows (source, lang, tokenizer, tokens, characters); sign is 1 for inserts and -1 for deletes."""
    s = F.lit(sign).cast("long")
    return rows.select(*KEYS, s.alias("documents"), (s * F.coalesce("tokens", F.lit(0))).alias("tokens"), (s * F.coalesce("characters", F.lit(0))).alias("characters"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Deltas that replace old counts by new ones."""
    return signed(old, -1).unionByName(signed(new, 1))


class Rollup:
    """Totals at ``path``, a folder in any store that Spark reads. Null keys are keys of their own. An empty rollup has no rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _status(self, pattern: str) -> list[str]:
        jvm = self.spark._jvm.org.apache.hadoop.fs
        at = jvm.Path(f"{self.path}/{pattern}")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at)
        return [] if found is None else [str(x.getPath().getParent().getName()) for x in found]

    def batches(self) -> list[str]:
        """Ids of the batches that count now."""
        have = self._status("batch=*/_SUCCESS")
        folded = {x for name in have if name.startswith("batch=to-") for x in self._folded(name)}
        return sorted(x.removeprefix("batch=") for x in have if x.removeprefix("batch=") not in folded)

    def _folded(self, name: str) -> list[str]:
        return [r[0] for r in self.spark.read.schema("id string").json(f"{self.path}/folded/{name.removeprefix('batch=')}").collect()]  # a name per batch

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Adds a batch; false if it was committed before, in which case nothing changes."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch_id):
            raise ValueError("a batch id is letters, digits, dots, dashes and underscores")
        known = self._status(f"batch={batch_id}/_SUCCESS") or any(batch_id in self._folded(x) for x in self._status("batch=to-*/_SUCCESS"))
        if known:
            return False
        sums = deltas.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES]).where(" OR ".join(f"{m} <> 0" for m in MEASURES))
        sums.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")  # what a failed try left is overwritten
        return True

    def compact(self, name: str) -> None:
        """Folds the batches that count at the start into one; one committed meanwhile stays by itself. Names stay known, so none can be committed again."""
        now = self.batches()
        if now and not self._status(f"batch=to-{name}/_SUCCESS"):
            gone = {y for x in now if x.startswith("to-") for y in self._folded(f"batch={x}")} | set(now)
            self.spark.createDataFrame([(x,) for x in sorted(gone)], "id string").coalesce(1).write.mode("overwrite").json(f"{self.path}/folded/to-{name}")
            self._sum(now).write.mode("overwrite").parquet(f"{self.path}/batch=to-{name}")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens, characters), without keys whose counts are all 0."""
        return self._sum(self.batches())

    def _sum(self, now: list[str]) -> DataFrame:
        if not now:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/batch={x}" for x in now])
        return rows.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES]).where(" OR ".join(f"{m} <> 0" for m in MEASURES))
