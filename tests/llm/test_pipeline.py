"""The pipeline against a brute-force version of its stages."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers as P
from pyspark.sql import functions as F
from test_pii import BASE, redacted, slow_find
from test_simhash import slow_components, slow_fingerprint

from chronofold.llm import bpe, mixture

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] and len(BASE) == 4 and re
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF).collect()
    table = [r.asDict() for r in docs.orderBy("doc_id").collect()]
    table = [d for d in table if any(c.isalpha() for c in d["text"] or "")]
    roots = slow_components([slow_fingerprint(d["text"]) for d in table])
    table = [d for i, d in enumerate(table) if roots[i] == i]
    own = bpe.tokenizer(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    spans = slow_find([d["text"] for d in table])
    by_id = {d["doc_id"]: own.ids_digest(own.encode(redacted(d["text"], s))) for d, (s, _) in zip(table, spans, strict=True)}
    assert {r["doc_id"] for r in got} <= set(by_id)
    assert all(r["ids_sha256"] == by_id[r["doc_id"]] for r in got)
    copies, size, source = Counter(r["doc_id"] for r in got), {d["doc_id"]: len(d["text"].split()) for d in table}, {d["doc_id"]: d["source"] for d in table}
    assert max(copies.values()) <= 3
    taken, sizes = defaultdict(int), defaultdict(int)
    for i in size:
        sizes[source[i]] += size[i]
        taken[source[i]] += size[i] * copies[i]
    want = {r["source"]: r["target"] for r in mixture.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
    assert all(abs(taken[s] - want[s]) <= 0.25 * want[s] + 50 for s in want)


def test_columns_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.where(F.lit(False)), SF).count() == 0
