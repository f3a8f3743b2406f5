import os

import corpus_pipeline
from markhive.llm import mixing, ngram_join, quality, toxicity
from pyspark.sql import functions as F

from .conftest import ODD, SCHEMA

SF = "/root/testdata/sf0.01"


def test_stages_and_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "ngram_jaccard_join", "source_mixing", "sentencepiece"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_whole_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    left = docs.join(toxicity.judged(docs, labels).where("predicted = 0").select("doc_id"), "doc_id")
    left = left.join(quality.assess(left).where("kept").select("doc_id"), "doc_id")
    left = left.join(ngram_join.groups(left, 5, 80).where("doc_id = component_id").select("doc_id"), "doc_id").cache()
    want = mixing.mixed_documents(left)
    got = corpus_pipeline.run(spark, SF).cache()
    assert got.groupBy("doc_id").count().exceptAll(want.groupBy("doc_id").count()).count() == 0
    assert got.count() == want.count() > 0
    assert got.select("doc_id", "text").distinct().exceptAll(left.select("doc_id", F.replace("text", F.lit("▁"), F.lit(" ")))).count() == 0
    assert got.where("n_tokens <> size(ids)").count() == 0


def test_odd_and_empty_tables(spark, tmp_path):
    for name, rows in (("odd", ODD), ("empty", [])):
        d = os.path.join(tmp_path, name)
        spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit(1)).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 0, 1), (4, 1, 0)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        out = corpus_pipeline.run(spark, d)
        assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "text"]
        assert {r.doc_id for r in out.collect()} <= {7, 8}
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, d).columns == docs.columns


def test_no_document_of_a_repeated_id_is_lost(spark, tmp_path):
    words = lambda k: " ".join(f"{k}{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(100))
    rows = [(1, words("a")), (5, words("a")), (5, words("b")), (6, words("c")), (6, words("d"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    kept = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, "")
    assert sorted((r.doc_id, r.text[0]) for r in kept.collect()) == [(1, "a"), (5, "b"), (6, "c"), (6, "d")]
