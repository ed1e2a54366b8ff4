import corpus_fixture as C

import corpus_pipeline
from ravelgrid.llm import near_copies, pii, quality


def test_stages_equal_one_by_one(spark, tmp_path):
    docs = C.frame(spark)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.fit_documents(docs, labels)
    good = {r.doc_id for r in quality.score_documents(docs, model).filter("predicted = 1").collect()}
    kept = quality.keep_good(docs, model)
    first = {}
    for r in near_copies.groups(kept).collect():
        first[r.rep] = min(first.get(r.rep, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    want = {None if none else i for none, i in first.values()}
    assert {r.doc_id for r in got} == want <= good
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "pii", "mixing", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert pii.redact(docs).count() == docs.count()


def test_empty_documents(spark, tmp_path):
    C.frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_sequences_follow_the_source_schedule(spark, tmp_path):
    """Sources of consecutive sequences have their weights, though ids go by source."""
    rows = [(i, " ".join(["word"] * (9 + i % 3)), "en", "abc"[i // 1600], 50) for i in range(4800)]
    stage = dict(corpus_pipeline.STAGES)["best_fit_packing"]
    got = stage(spark, C.frame(spark, rows), str(tmp_path)).collect()
    assert len(got) == 4800
    order = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    assert sorted({r.sequence_id for r in got}) == list(range(1 + order[-1].sequence_id))
    for lo in range(0, 4800, 400):
        some = [r.doc_id // 1600 for r in order[lo : lo + 400]]
        assert all(abs(some.count(k) / 400 - 1 / 3) < 0.1 for k in range(3))
