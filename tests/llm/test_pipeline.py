import cases

import corpus_pipeline
from postweave.llm import packing
from test_tokens import check_packing


def test_stages_on_awkward_documents(spark, tmp_path):
    docs = cases.documents(spark)
    columns = docs.columns
    for name, function in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        function(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == columns
    rows = docs.collect()
    assert rows and check_packing(rows, packing.CAPACITY) <= len(rows)


def test_run_equals_its_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.near_dedup(spark, corpus_pipeline.quality_rules(spark, docs, sf), sf)
    mixed = corpus_pipeline.mix(spark, corpus_pipeline.secrets(spark, kept, sf), sf)
    want = cases.tuples(packing.pieces(mixed), "doc_id", "piece", "length", "ids_crc32")
    assert cases.tuples(corpus_pipeline.run(spark, sf), "doc_id", "piece", "length", "ids_crc32") == want


def test_empty_table(spark):
    docs = cases.documents(spark, [])
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, docs, "").count() == 0
