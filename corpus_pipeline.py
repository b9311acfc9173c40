"""Corpus pipeline: quality, line dedup, near-duplicates, decontamination, sampled SentencePiece segmentation.

Each stage takes all that the one before kept; what a stage returns is written to the shared folder as
Parquet and read back for the next.

All stages keep rows with a null id, and rows that share an id stand or fall together (but for lines). Null and
empty texts, and texts of blanks alone, pass the last four stages; the first scores them like any other. Columns
beyond COLUMNS are dropped, whatever their names. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wavemill.llm import decontam, lines, minhash, pieces, quality
from wavemill.llm._store import materialise
from wavemill.llm.queries import remainder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score below the threshold. The model learns from labels outside the held-out quarter."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"), training=lambda c: remainder(c, 4) != 2)
    scored = quality.score(docs.select(*COLUMNS), model, to="_score")
    return scored.where(F.col("_score") >= quality.THRESHOLD).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out and sets n_chars anew. A document of which no word is left, though it had some, goes."""
    out = lines.dedup_lines(docs.select(*COLUMNS))
    worded = F.rlike(F.coalesce("text", F.lit("")), F.lit(r"[^\s]"))
    size = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.where((F.col("n_removed") == 0) | worded).withColumn("n_chars", size).select(*COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group, and documents without words."""
    groups = minhash.near_duplicates(docs).where("NOT kept").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(groups, "doc_id", "left_anti").select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = found.where(decontam.contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("id").alias("doc_id")).distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples a segmentation of each text, decodes it and compares; all documents stay."""
    out = pieces.decode(pieces.encode(docs.select(*COLUMNS)))
    lossless = F.col("decoded") == F.coalesce("text", F.lit(""))
    return out.select(*COLUMNS, "pieces", F.size("pieces").cast("long").alias("n_pieces"), lossless.alias("lossless"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: Learned scores and sampled pieces aren't expressible in SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, "stage")
    return docs
