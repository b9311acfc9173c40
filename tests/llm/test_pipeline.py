import corpus_pipeline as C


def test_stages_keep_columns_and_only_drop(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for i, (_, stage) in enumerate(C.STAGES):
        out = C.materialise(stage(spark, docs, sf), "test-stage")
        after = out.count()
        assert after <= before and set(C.COLUMNS) <= set(out.columns)
        if i < len(C.STAGES) - 1:
            assert out.columns == C.COLUMNS
        docs, before = out, after
    assert docs.where("NOT lossless").count() == 0
    assert docs.groupBy("doc_id").count().where("count > 1").count() == 0


def test_stages_handle_odd_rows(spark, sf):
    """Null and empty texts, blanks alone, a very long text, repeated rows, ids shared and null, columns of clashing names, and no rows."""
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    prose = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 400").orderBy("doc_id").limit(3).collect()]
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, "long words here " * 20_000), (5, prose[0]), (5, prose[0]), (6, prose[0]), (None, prose[0])]
    rows += [(7, prose[1]), (8, prose[1] + " and three words"), (9, bench), (10, prose[2]), (None, None)]
    spec = "doc_id long, text string, lang string, source string, n_chars long, pieces string, score string"
    docs = spark.createDataFrame([(i, t, None, "s", 0 if t is None else len(t), "x", "y") for i, t in rows], spec)
    everything = sorted((str(i), t or "") for i, t in rows)
    gone = {
        "quality classifier": None,  # what it drops depends on the model
        "line dedup": {"6", "8"},  # copies later in order lose every line
        "MinHash near-dedup": {"6", "8"},
        "benchmark decontamination": {"9"},
        "SentencePiece encoding and decoding": set(),
    }
    for name, stage in C.STAGES:
        out = stage(spark, docs, sf)
        assert set(out.columns[:5]) == set(C.COLUMNS) and stage(spark, docs.limit(0), sf).count() == 0
        got = sorted((str(r.doc_id), r.text or "") for r in out.collect())
        if gone[name] is None:
            assert set(got) <= set(everything)
        else:
            assert got == [x for x in everything if x[0] not in gone[name]], name


def test_quality_stage_drops_what_the_operator_rejects(spark, sf):
    from wavemill.llm import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in C.quality_classifier(spark, docs, sf).collect()}
    assert kept == {r.doc_id for r in queries.op1_quality_classifier(spark, sf).where("predicted = 1").collect()}
