"""op8 and the pipeline's first stage learn from every labelled text: against plain versions over all rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_langid import plain_grams

from chronofold.llm import langid

SF = "/root/testdata/sf0.01"


def plain_cluster(v, k, rounds=12):
    """Spherical k-means of rows in memory, started from the row nearest to the mean and rows far from those chosen."""
    chosen = [int((v @ v.mean(axis=0)).argmax())]
    while len(chosen) < min(k, len(v)):
        chosen.append(int((v @ v[chosen].T).max(axis=1).argmin()))
    c = v[chosen]
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        c = np.stack([v[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    return c


def plain_pieces(text):
    """The pieces of a text's letters and spaces, by definition."""
    s = ""
    for c in text.lower() + " ":
        s += c if c.isalpha() else " " if s and s[-1] != " " else ""
    n = 1
    while n < len(s):
        yield from (s[i : i + n] for i in range(0, len(s), n))
        n *= 2


def taught(spark):
    """Training documents, of which English has over 256, with copies, a language of two texts and texts that lie far off."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(~langid.held_out(F.col("doc_id"))).select("text", "lang")
    odd = [("".join(chr(0x4E00 + (i * 37 + j * j) % 400) for j in range(60 + i)), "en") for i in range(30)]
    odd += [("Съешь ещё этих булок", "ru"), ("да выпей чаю", "ru"), ("123", "en"), (None, "en"), ("no label", None)]
    return docs.union(docs.limit(40)).union(spark.createDataFrame(odd, docs.schema))


def test_model_is_of_all_rows(spark):
    docs = taught(spark)
    model = langid.fit(docs)
    rows = sorted({(r["lang"], r["text"]) for r in docs.collect() if r["lang"] and r["text"] and any(c.isalpha() for c in r["text"])})
    assert sum(lang == "en" for lang, _ in rows) > 256
    tf = np.array([langid.counts(text) for _, text in rows])
    idf = np.log((1 + len(rows)) / (1 + (tf > 0).sum(axis=0))) + 1
    assert np.allclose(model.idf, idf, rtol=1e-6)
    v, labels = langid.vectors(tf, idf).astype(np.float64), np.array([lang for lang, _ in rows])
    assert model.langs == tuple(x for x in sorted(set(labels)) for _ in range(min(3, (labels == x).sum())))
    for x in set(labels):
        got = sorted(model.centroids[[y == x for y in model.langs]].tolist())  # of two texts, both are as near to the mean
        assert np.allclose(got, sorted(plain_cluster(v[labels == x], 3).tolist()), atol=1e-4), x


def test_no_training_text_is_rejected(spark):
    docs = taught(spark).where("lang is not null and text rlike '[^0-9]'")
    assert langid.predict(docs, langid.fit(docs)).where("rejected").count() == 0


@pytest.mark.parametrize("block", [1, 4, 64, 1 << 15])
def test_pieces_by_definition(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    langid._logs.cache_clear()
    texts = ["", "123", "a", "ab", " a", "a b c  d", "Ünïcode straße, naïve!", "12 the cat sat on the mat, the cat sat", "aaaa aaaa " * 9, "x1y2z3" * 11, "我们今天去了"]
    tf = np.array([langid.counts(t) for t in texts if langid.counts(t) is not None])
    model = langid.train(tf, ["one", "two"] * (len(tf) // 2) + ["one"] * (len(tf) % 2))
    for text in texts:
        want, got = np.zeros((2, langid.CLASSES), int), np.zeros((langid.CLASSES, 2, langid.STEPS + 1), np.int64)
        model.distances(text, "one", got)
        far = [[], []]
        if plain_grams(text):
            for whole, piece in [(1, text), *((0, x) for x in plain_pieces(text))]:
                if grams := plain_grams(piece):
                    want[whole, len(grams).bit_length()] += 1
                    far[whole].append(1 - max(c @ langid.vectors(langid.counts(piece)[None], model.idf)[0] for c, x in zip(model.centroids, model.langs, strict=True) if x == "one"))
        assert (got.sum(axis=2).T == want).all(), text
        for whole in (0, 1):
            steps = np.repeat(np.arange(langid.STEPS + 1), got[:, whole].sum(axis=0)) / langid.STEPS
            assert np.allclose(steps, np.clip(sorted(far[whole]), 0, 1), atol=1.01 / langid.STEPS), text
    langid._logs.cache_clear()


def test_tasks_send_few_rows(spark, monkeypatch):
    """Of sums and distances a task sends on a few hundred rows, however its texts differ."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").where("lang is not null and text is not null").repartition(16)
    made, before = [], type(docs).mapInArrow

    def counted(self, *args):
        made.append((got := before(self, *args)).count())
        return got

    model = langid.fit(docs)
    monkeypatch.setattr(type(docs), "mapInArrow", counted)
    got = langid._distances(docs, model)
    want = np.zeros_like(got)
    for r in docs.collect():
        model.distances(r["text"], r["lang"], want)
    assert (got == want).all()
    assert len(made) == 1 and made[0] <= 16 * 300


def test_training_rows_hold_what_occurs(spark):
    """What each round reads of a text grows with its different n-grams; 4096 bytes a text before."""
    texts = ["the cat", "a" * 700, "ab " * 255, "ab " * 256, "the dog and the cat " * 3000]
    table = spark.createDataFrame([(x, "en") for x in texts], "text string, lang string").coalesce(1)
    got = langid._with_counts(table).toArrow()
    want = [langid.counts(x) for x in texts]
    for i, tf in enumerate(want):
        size = sum(len(got[c][i].as_py()) for c in got.column_names if c != "lang")
        assert size <= 3 * np.count_nonzero(tf) + 8 * (tf >= 255).sum()
    rows = langid._rows(got.combine_chunks().to_batches()[0], {"en": 0})
    assert all((rows.dense(i) == tf).all() for i, tf in enumerate(want))


def test_texts_cut_together(monkeypatch):
    """Pieces count the same, whatever texts are beside theirs."""
    rnd = np.random.default_rng(3)
    texts = ["".join(rnd.choice(list("abcde fgh, éß我"), n)) for n in [1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33, 64, 65, 100, 129, 1000, 40000, 70000]]
    texts += ["".join(chr(0x4E00 + i) for i in range(20000)), "xy " * 30000, "123", ""]
    tf = np.array([x for t in texts if (x := langid.counts(t)) is not None])
    model = langid.train(tf, ["one"] * len(tf))
    shape = (langid.CLASSES, 2, langid.STEPS + 1)
    want, got = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
    for t in texts:
        model.distances(t, "one", want)
    model.spread(texts, "one", got)
    assert (got == want).all()
    monkeypatch.setattr(langid, "TOGETHER", 50)
    monkeypatch.setattr(langid, "PLACES", 64)
    got[:] = 0
    model.spread(reversed(texts), "one", got)
    assert (got == want).all()
