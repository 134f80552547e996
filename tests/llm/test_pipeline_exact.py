"""Stages of the pipeline on their own input, held to exact sets of documents."""

from __future__ import annotations

import corpus_pipeline
from test_pipeline import SF
from test_simhash import slow_components, slow_fingerprint


def test_near_dedup_keeps_the_first_of_each_group(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text rlike '[A-Za-z]'")
    table = docs.orderBy("doc_id").collect()
    roots = slow_components([slow_fingerprint(d["text"]) for d in table])
    want = [d["doc_id"] for i, d in enumerate(table) if roots[i] == i]
    got = corpus_pipeline.near_dedup(spark, docs, SF)
    assert sorted(r["doc_id"] for r in got.collect()) == want


def test_redaction_keeps_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.redact_pii(spark, docs, SF)
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
