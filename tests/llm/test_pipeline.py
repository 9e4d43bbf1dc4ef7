import corpus_pipeline
from rillwork.llm import langid, ngram_join, quality


def test_stages_chain_and_keep_columns(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("n", docs_extra())
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, d), f"test-{name}")
        assert docs.columns == columns, name
        seen.append(docs.count())
    assert seen[0] >= seen[1] >= seen[2] >= seen[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert last.count() == seen[4]


def docs_extra():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_stages_agree_with_their_operators(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    by_language = {r.doc_id for r in langid.identify(docs).where(f"lang_pred <> 'und' and score > {corpus_pipeline.LEAST_LANGUAGE}").collect()}
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, d).collect()} == by_language
    assert {r.doc_id for r in corpus_pipeline.good(spark, docs, d).collect()} == {r.doc_id for r in quality.score_documents(docs, labels).where("predicted = 1").collect()}
    classes = ngram_join.similar_classes(docs)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, d).collect()} == {r.doc_id for r in classes.where("doc_id = component_id").collect()}


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.n_tokens > 0 for r in rows)
