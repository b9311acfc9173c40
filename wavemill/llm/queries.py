"""Registered queries of the corpus operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wavemill.llm import decontam, licenses, lines, lm, media, minhash, periodic, pieces, pii, quality, resample, rollup, warc
from wavemill.llm._store import materialise, new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, n: int):
    """crc32 of an id's decimal text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, table(spark, sf_dir, "labels"), training=lambda c: remainder(c, 4) != 2)
    scored = quality.score(docs, model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each of two tokenizer versions these batches: all documents; exact copies taken out but for the least id; texts whose runs of blanks
    and marks shrink counted anew; a repeat of the first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    one = docs.groupBy(F.sha2("text", 256).alias("name"), F.length("text").alias("characters")).agg(F.min("doc_id").alias("least"))
    tidy = F.regexp_replace("text", r"([%&$#*!|])\1+", "$1")
    base = docs.withColumn("tidy", F.when(tidy != F.col("text"), tidy)).withColumn("name", F.sha2("text", 256))
    kept = one.select(F.col("least").alias("doc_id"))
    totals = rollup.Rollup(spark, new_path(spark, "rollup"))
    for version, mark in (("byte_bpe_50k", ""), ("byte_bpe_multi_50k", "multi-")):
        counted = rollup.count_tokens(base, version).withColumn("characters", F.length("text").cast("long"))
        counted = rollup.count_tokens(counted, version, text="tidy", to="tidy_tokens").withColumn("tidy_characters", F.length("tidy").cast("long"))
        counted = materialise(counted.select("doc_id", "source", "lang", "name", "tokens", "characters", "tidy_tokens", "tidy_characters").withColumn("tokenizer", F.lit(version)), "counted")
        again = counted.where("tidy_characters IS NOT NULL").join(kept, "doc_id", "left_semi")
        totals.commit(f"{mark}0-insert", rollup.signed(counted, 1))
        totals.commit(f"{mark}1-copies", rollup.signed(counted.join(kept, "doc_id", "left_anti"), -1))
        totals.commit(f"{mark}2-tidied", rollup.revised(again, again.drop("tokens", "characters").withColumnsRenamed({"tidy_tokens": "tokens", "tidy_characters": "characters"})))
        totals.commit(f"{mark}0-insert", rollup.signed(counted, 1))
    return totals.totals()


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    found = warc.read_archives(spark.read.parquet(path), keep_payload=False)
    name = lambda c: F.regexp_extract(c, r"page:(-?\d+)$", 1)
    number = lambda c: F.when(name(c) != "", name(c)).cast("long")
    return found.select(
        number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"), F.col("digest_ok").alias("verified"),
    )


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored form is written to the shared folder, and what is decoded is read back from there."""
    stored = materialise(media.store_texts(table(spark, sf_dir, "documents")), "media", "zstd")
    return media.read_media(stored, digest=True).withColumnRenamed("id", "doc_id")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents"), lambda c: remainder(c, 7) != 2)
    return scored.withColumn("held_out", ~F.col("trained")).drop("trained")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.decode(pieces.encode(docs))
    return out.select(
        "doc_id", F.size("pieces").cast("long").alias("n_pieces"), F.length(F.col("text").cast("binary")).cast("long").alias("n_bytes"),
        F.sha2(F.array_join(F.col("pieces").cast("array<string>"), ","), 256).alias("pieces_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), decontam.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand in directories by source and language."""
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))
    return licenses.scan(docs).withColumnRenamed("id", "doc_id")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest are of the patterns' spans; ``spans`` holds those of the field too."""
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x.base)
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    counts = [F.expr(f"CAST(size(filter(spans, x -> x.base AND x.kind = '{k}')) AS LONG) AS n_{k}") for k in pii.BASE]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def planted(docs: DataFrame) -> DataFrame:
    """The contract's repeats: with h the id's crc32 and n words, where h % 10 is 0 each word from a = h / 10 % n on becomes that of the
    p words from a on whose turn it is, p = 1 + (n - a) / (3 + h / 10 % 8). Other texts, and those without words or id, stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.when(h % 10 == 0, F.col("text")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = docs.select("doc_id", "text", words.alias("w"), F.floor(h / 10).alias("g")).withColumn("n", F.size("w"))
    a = F.expr("CAST(g % n AS INT)")
    cut = cut.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", F.expr("CAST(1 + floor((n - a) / (3 + g % 8)) AS INT)"))
    again = F.expr("concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), CAST(ceil((n - a) / p) AS INT))), 1, n - a))")
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(planted(table(spark, sf_dir, "documents")))
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    found = found.select(F.col("id").alias("doc_id"), "runs", "collapsed", best.alias("b"), listed.alias("listed"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.period")).alias("period"),
        F.expr("b.length * 1000 div -b.period").alias("exponent_milli"), F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample.resample(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_warc": op4_warc,
    "op6_media_columns": op6_media_columns,
    "op7_lm_scoring": op7_lm_scoring,
    "op9_sentencepiece": op9_sentencepiece,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op10_license_scan": op10_license_scan,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op11_personal_data": op11_personal_data,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_importance_resampling": op13_importance_resampling,
}
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(string_split_regex({_FOLD}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_BLANK = rf"list_filter(string_split_regex({_FOLD}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLES: dict[str, str] = {
    "op4_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS top FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to, true AS verified FROM f""",
}

ORACLES["op8_benchmark_decontamination"] = f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    bi AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
    bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bi),
    di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw)),
    h AS (SELECT doc_id, i, di.n, item_id FROM di JOIN bw ON di.n = bw.n AND array_to_string(w[i:i + di.n - 1], ' ') = g),
    c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
    t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""
ORACLES["op5_minhash_near_dedup"] = f"""
    WITH RECURSIVE d AS (SELECT doc_id, {_BLANK} AS w FROM documents),
    x AS (SELECT doc_id, w, least(5, len(w)) AS n, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS g FROM x), z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    e AS (SELECT a, b FROM p JOIN z za ON za.doc_id = a JOIN z zb ON zb.doc_id = b WHERE 100 * shared >= 85 * (za.n + zb.n - shared)),
    r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
    SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
    FROM d LEFT JOIN z USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, z.n"""
_CRC_TABLE = "list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)))"
ORACLES["op12_periodic_runs"] = rf"""
    WITH t AS (SELECT {_CRC_TABLE} AS tab),
    c AS (SELECT doc_id, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
          lambda s, b: xor(s >> 8, tab[(xor(s, b) & 255) + 1])), 4294967295) AS h FROM documents, t),
    d AS (SELECT doc_id, h, h // 10 AS g, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM c),
    e AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a FROM d), f AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e),
    x AS (SELECT doc_id, a, p, w, unnest(range(n)) AS i FROM f), v AS (SELECT doc_id, i, CASE WHEN i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS v FROM x),
    k AS (SELECT doc_id, i, concat_ws(' ', v, lead(v, 1) OVER o, lead(v, 2) OVER o, lead(v, 3) OVER o, lead(v, 4) OVER o, lead(v, 5) OVER o) AS k FROM v
          WINDOW o AS (PARTITION BY doc_id ORDER BY i) QUALIFY lead(v, 5) OVER o IS NOT NULL),
    j AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.k = b.k AND a.i < b.i),
    z AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS z FROM j),
    m AS (SELECT doc_id, q, min(i) AS s, count(*) + 5 + q AS l FROM z GROUP BY doc_id, q, z),
    r AS (SELECT doc_id, s, l, min(q) AS q FROM m WHERE l >= 12 AND l >= 2 * q GROUP BY doc_id, s, l),
    y AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed,
          arg_min(struct_pack(s := s, l := l, q := q), struct_pack(l := -l, s := s, q := q)) AS b FROM r GROUP BY doc_id),
    u AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM r),
    o AS (SELECT doc_id, string_agg(v, ' ' ORDER BY i) AS kept FROM v ANTI JOIN u USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.q AS period, 1000 * b.l // b.q AS exponent_milli,
           sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM d LEFT JOIN y USING (doc_id) LEFT JOIN o USING (doc_id)"""
ORACLES["op13_importance_resampling"] = rf"""
    WITH t AS (SELECT {_CRC_TABLE} AS tab),
    d AS (SELECT 0 AS side, doc_id, {_WORDS} AS w FROM documents UNION ALL SELECT 1, item_id, {_WORDS} FROM benchmark),
    g AS (SELECT side, doc_id, n, unnest(list_transform(range(1, greatest(len(w) - n + 2, 1)), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS f FROM d, range(1, 4) r(n)),
    f AS (SELECT DISTINCT f FROM g), h AS (SELECT f, hex(f) AS h FROM f),
    b AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda k: CAST('0x' || h[2 * k + 1:2 * k + 2] AS BIGINT))),
          lambda s, b: xor(s >> 8, tab[(xor(s, b) & 255) + 1])), 4294967295) % 10000 AS b FROM h, t),
    c AS (SELECT side, doc_id, b, count(*) AS n FROM g JOIN b USING (f) GROUP BY ALL),
    s AS (SELECT b, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM c GROUP BY b),
    z AS (SELECT CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM s),
    a AS (SELECT b, CAST(floor(1000 * ln((s.t + 1) * (z.s + 10000) / ((s.s + 1) * (z.t + 10000)))) AS BIGINT) AS gain FROM s, z),
    w AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM c JOIN a USING (b) WHERE side = 0 GROUP BY doc_id),
    v AS (SELECT d.doc_id, len(d.w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
          coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || d.doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN w USING (doc_id) WHERE side = 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY words >= 20) AS n FROM v)
    SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND r <= 5 * n // 100 THEN r END AS rank FROM k"""
