"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every run of ``window`` words has a fingerprint: the least hash of its k-grams. A document's run can
equal a benchmark run only if the fingerprints are equal, so runs of neighbouring positions share
theirs (winnowing), and any shared span of ``window`` words or more is met. Fingerprint hits extend to
the whole run, which is confirmed by a 128-bit hash of its words; confirmed runs merge into spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from wavemill.llm._store import materialise

WINDOW, GRAM = 13, 5
#: Benchmark windows up to this number are broadcast (about 60 bytes each); more are joined by shuffle.
BROADCAST_WINDOWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words once A-Z are lower-cased.
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: str) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), PARTS), "")


def _each(n: Column, f) -> Column:
    """[f(1), ..., f(n)]; empty if n < 1."""
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), f)).otherwise(F.array().cast("array<long>"))


def _fingerprints(df: DataFrame, length: int, gram: int, name: str) -> DataFrame:
    """Adds the fingerprint of each run of ``length`` words of column w."""
    k = min(gram, length)
    df = df.withColumn("_g", _each(F.size("w") - (k - 1), lambda i: F.xxhash64(F.slice("w", i, k))))
    # _g is named twice, so the optimiser keeps it as a column and doesn't compute it anew inside the lambda.
    return df.withColumn(name, _each(F.size("_g") - (length - k), lambda i: F.array_min(F.slice("_g", i, length - k + 1)))).drop("_g")


def _key(length: Column) -> list[Column]:
    run = F.slice("w", F.col("at") + 1, length)
    return [F.xxhash64(run).alias("h1"), F.xxhash64(F.lit(1), run).alias("h2")]


def contamination(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", *, window: int = WINDOW, gram: int = GRAM, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(id, n_words, n_hit, item_ids array<string>, spans array<struct<first,last>>) for each row of docs.

    A window is ``window`` consecutive words of an item; an item of fewer words is one window. n_hit
    counts the document's words inside any window's occurrence. Null and empty texts have no words and
    no hits; items without words or id are ignored. item_ids are distinct and sorted as strings.
    Repeated rows give a row each. Other columns are ignored; an empty benchmark hits nothing.
    """
    items = bench.select(F.col(item_id).cast("string").alias("item"), word_array(text_col).alias("w")).where("item IS NOT NULL AND size(w) > 0")
    # Items of equal words share their windows.
    classes = materialise(items.groupBy("w").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("n", F.least(F.size("w"), F.lit(window))), "items")
    classes = classes.withColumn("cls", F.xxhash64("w"))
    lengths = sorted(r[0] for r in classes.select("n").distinct().collect()) or [window]  # at most `window` numbers
    runs = None
    for n in lengths:
        part = _fingerprints(classes.where(F.col("n") == n), n, gram, "fps").select("cls", "w", "n", F.posexplode_outer("fps").alias("at", "fp")).select("cls", "n", "fp", *_key(F.lit(n)))
        runs = part if runs is None else runs.unionByName(part)
    runs = materialise(runs.distinct(), "runs")
    small = (lambda df: F.broadcast(df)) if runs.count() <= broadcast_windows else (lambda df: df)

    base = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text_col).alias("row"), word_array(text_col).alias("w"))
    for n in lengths:
        base = _fingerprints(base, n, gram, f"fp{n}")
    # One array of all fingerprints by length; its last entry, null, stands for the document itself.
    base = base.withColumn("fps", F.concat(*[F.col(f"fp{n}") for n in lengths], F.array(F.lit(None).cast("long"))))
    at, length, before = F.col("pos"), F.lit(lengths[-1]), F.lit(0)
    for i, n in enumerate(lengths[:-1]):
        size = F.greatest(F.size("w") - (n - 1), F.lit(0))
        length = F.when(F.col("pos") < before + size, F.lit(n)) if i == 0 else length.when(F.col("pos") < before + size, F.lit(n))
        at = F.when(F.col("pos") < before + size, F.col("pos") - before) if i == 0 else at.when(F.col("pos") < before + size, F.col("pos") - before)
        before = before + size
    if len(lengths) > 1:
        length, at = length.otherwise(F.lit(lengths[-1])), at.otherwise(F.col("pos") - before)
    # The outer form: for the inner one a filter on the array is inferred, pushed below it and computed again.
    seen = base.select("id", "row", "w", F.posexplode_outer("fps").alias("pos", "fp")).withColumn("n", length).withColumn("at", at)
    seen = seen.select("id", "row", F.size("w").alias("n_words"), "at", "n", "fp", F.coalesce("fp", "row").alias("probe"), *_key(F.col("n")))
    known = runs.select(F.col("fp").alias("probe"), F.col("n").alias("bn")).distinct()
    hit = seen.join(small(known), (seen.probe == known.probe) & (seen.n == known.bn) & seen.fp.isNotNull(), "left").where("fp IS NULL OR bn IS NOT NULL").drop("bn", "probe")
    exact = runs.select("h1", "h2", F.col("n").alias("bn")).distinct()
    same = (hit.h1 == exact.h1) & (hit.h2 == exact.h2) & (hit.n == exact.bn) & hit.fp.isNotNull()
    hits = hit.join(small(exact), same, "left").where("fp IS NULL OR bn IS NOT NULL").select("id", "row", "n_words", "at", "n", hit.h1, hit.h2, F.col("fp").isNull().alias("whole"))
    hits = materialise(hits, "hits")

    rows = hits.where("whole").groupBy("id", "row").agg(F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("copies"))
    found = hits.where("NOT whole").select("id", "row", F.col("at").cast("long").alias("first"), (F.col("at") + F.col("n")).cast("long").alias("last"), "n", "h1", "h2").distinct()
    order = Window.partitionBy("id", "row").orderBy("first", "last")
    apart = found.withColumn("new", F.coalesce(F.col("first") > F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    spans = apart.withColumn("island", F.sum(F.col("new").cast("long")).over(order)).groupBy("id", "row", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    spans = spans.groupBy("id", "row").agg(F.sum(F.col("last") - F.col("first")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))
    owners = found.select("id", "row", "n", "h1", "h2").distinct().join(runs.select("n", "h1", "h2", "cls").distinct(), ["n", "h1", "h2"]).select("id", "row", "cls").distinct()
    owners = owners.join(classes.select("cls", "items"), "cls").groupBy("id", "row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("item_ids"))
    side = lambda df: df.withColumnsRenamed({"id": "_id", "row": "_row"})
    tied = F.col("id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row"))
    out = rows.join(side(spans), tied, "left").drop("_id", "_row").join(side(owners), tied, "left").drop("_id", "_row")
    none = F.array().cast(spans.schema["spans"].dataType)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        "id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.coalesce("spans", none).alias("spans")
    )


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """A document counts as contaminated when a twentieth of its words or more is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
