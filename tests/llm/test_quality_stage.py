"""The pipeline's quality stage against labels."""

import duckdb

import corpus_pipeline


def test_menu_text_goes_and_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, sf).select("doc_id").collect()}
    rows = duckdb.sql(f"select doc_id, quality, text from '{sf}/labels.parquet' join '{sf}/documents.parquet' using (doc_id)").fetchall()
    menu = {d for d, q, t in rows if q == 0 and t.count(" | ") > 10}
    assert menu and not kept & menu
    from topiclog.llm.quality_rules import apply_rules, references

    failed = {r.doc_id for r in apply_rules(docs, references(docs)).collect() if r.base_failed}
    assert {d for d, q, _ in rows if q == 1} - failed <= kept
