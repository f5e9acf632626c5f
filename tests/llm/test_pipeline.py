import corpus_pipeline

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        now = docs.count()
        assert 0 < now < before or name == "mix"
        before = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.count() == before


def test_run_agrees_with_itself(spark):
    a, b = (sorted(map(str, corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "bucket").collect())) for _ in range(2))
    assert a == b and a


def test_stages_take_odd_rows(spark, docs, rows, empty, tmp_path):
    """Nulls, blanks, long texts, repeated rows, columns whose names the operators use, tables without rows."""
    labels = spark.createDataFrame([(k, int(k % 9 > 0), int(k % 7 == 0)) for k in range(60)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now, none = docs, empty
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now, none = stage(spark, now, str(tmp_path)).cache(), stage(spark, none, str(tmp_path)).cache()
        assert now.columns == docs.columns == none.columns and none.count() == 0, name
        left = now.select("doc_id", "text").collect()
        assert 0 < len(left) <= len(rows) or name == "mix"
        if name == "near_dedup":
            ids = [r.doc_id for r in left if r.doc_id is not None]
            assert len(ids) == len(set(ids)) and sum(r.text is None or not r.text.strip() for r in left if r.doc_id is not None) <= 1
    assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() == now.count()
    assert corpus_pipeline.STAGES[-1][1](spark, none, str(tmp_path)).count() == 0
