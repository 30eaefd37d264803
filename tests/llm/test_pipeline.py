"""The pipeline's stages on the small tables and on odd rows."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_work_on_what_is_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF).cache()
        if i < 4:
            assert docs.columns == columns
        if i < 2:
            assert 0 < docs.count() < n
            n = docs.count()
        if i == 0:
            kept = {r.doc_id for r in docs.collect()}
            assert all(d in kept for d, q in labels.items() if q == 1)
    assert docs.where("not exact").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
