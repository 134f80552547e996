"""op8 against a plain version of TF-IDF, centroids and rejection, and held-out accuracy."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import rows

from chronofold.llm import langid

SF = "/root/testdata/sf0.001"


def plain_grams(text):
    """Buckets of all n-grams, by definition."""
    s, out = " ", Counter()
    for c in text.lower():
        if c.isalpha():
            s += c
        elif s[-1] != " ":
            s += " "
    s = s if s[-1] == " " else s + " "
    if len(s) == 1:
        return out
    m = 1 << 32
    for i in range(len(s) - 1):
        two = (ord(s[i]) * 0x9E3779B1 + ord(s[i + 1]) * 0x85EBCA77) % m
        out[(two * 0x165667B1 % m) >> 20] += 1
        if i + 2 < len(s):
            three = (two * 0xC2B2AE3D + ord(s[i + 2]) * 0x27D4EB2F + 1) % m
            out[(three * 0x165667B1 % m) >> 20] += 1
    return out


def plain_vector(grams, idf):
    v = {k: (1 + math.log(n)) * float(idf[k]) for k, n in grams.items()}
    length = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / length for k, x in v.items()}


def plain_predict(model, text):
    grams = plain_grams(text or "")
    if not grams:
        return "und", 0.0, True
    v = plain_vector(grams, model.idf)
    cosines = [sum(x * float(c[k]) for k, x in v.items()) for c in model.centroids]
    best = max(range(len(cosines)), key=lambda i: cosines[i])
    return model.langs[best], cosines[best], 1 - cosines[best] > model.reach[len(grams).bit_length()]


TEXTS = ["", "123 !?", "a", "A b", "  x ", "Ünïcode straße, naïve!", "İstanbul ΣΑΣ", "我们今天去了", "a" * 5000, "ab cd " * 700, "no\u00a0break\tTab\nline 4u"]


@pytest.mark.parametrize("strip", [1 << 20, 1, 2, 3, 7])
def test_counts_equal_plain_ngrams(monkeypatch, strip):
    monkeypatch.setattr(langid, "STRIP", strip)
    for text in TEXTS:
        got = langid.counts(text)
        assert ({} if got is None else {int(i): int(got[i]) for i in np.flatnonzero(got)}) == dict(plain_grams(text))


def test_whole_texts_cross_strips():
    text = ("the quick brown fox " * 60000)[: (1 << 20) + 30000]
    got = langid.counts(text)
    assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == dict(plain_grams(text))


def test_training_equals_plain_version():
    rnd = np.random.default_rng(5)
    texts = ["".join(rnd.choice(list("abc dé" if i % 2 else "xyz q"), 80)) for i in range(24)]
    langs = ["one" if i % 2 else "two" for i in range(24)]
    model = langid.train(np.array([langid.counts(t) for t in texts]), langs, k=1)
    grams = [plain_grams(t) for t in texts]
    for k in range(0, langid.DIM, 37):
        assert math.isclose(model.idf[k], math.log((1 + 24) / (1 + sum(k in g for g in grams))) + 1, rel_tol=1e-5)
    for c, lang in zip(model.centroids, model.langs, strict=True):
        total = Counter()
        for g, x in zip(grams, langs, strict=True):
            if x == lang:
                for k, y in plain_vector(g, model.idf).items():
                    total[k] += y
        length = math.sqrt(sum(x * x for x in total.values()))
        assert np.allclose(c, [total[k] / length for k in range(langid.DIM)], atol=1e-5)


def test_reach_by_definition():
    n = np.zeros((langid.CLASSES, 2, langid.STEPS + 1), np.int64)
    n[3, 0, 900], n[3, 0, 990], n[5, 1, 700], n[4, 0, 100] = 99, 1, 1, 3
    got = langid.reach(n) - langid.MARGIN
    assert np.allclose(got[:4], 0.9) and np.allclose(got[4:], 0.7)
    assert (langid.reach(n * 0) == 2).all()


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 30 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    model = langid.fit(docs.where(~langid.held_out(docs["doc_id"])))
    for r in got:
        lang, score, rejected = plain_predict(model, r["text"])
        assert (r["lang_pred"], r["rejected"]) == (lang, rejected) and abs(r["score"] - score) < 1e-4
    assert not any(r["rejected"] for r in got if any(c.isalpha() for c in r["text"] or ""))
    assert langid.identify(docs.limit(0)).count() == 0
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()


def test_rejection(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out(docs["doc_id"])))
    assert model.predict(None) == ("und", 0.0, True) and model.predict("123 !? \n")[0] == "und"
    far = ["我们今天去了图书馆看书，然后回家吃饭。" * 30, "Съешь же ещё этих мягких французских булок да выпей чаю, в чащах юга жил бы цитрус. " * 4]
    rnd = np.random.default_rng(1)
    far += ["".join(rnd.choice(list("abcdefghijklmnopqrstuvwxyz  "), 3000)), "".join(rnd.choice(list("0123456789abcdef"), 3000))]
    assert all(model.predict(x)[2] for x in far)
    assert not model.predict("the")[2]
    long = " ".join(r["text"] for r in docs.where("lang = 'en'").orderBy("doc_id").limit(60).collect())
    odd = spark.createDataFrame([(None, None, None, "x"), (1, "", "en", "y"), (2, long, None, "z"), (2, long, None, "z"), (3, far[0], "en", "w")], "doc_id bigint, text string, lang string, score string")
    assert rows(langid.predict(odd.drop("score"), model).select("lang_pred", "rejected")) == sorted([("en", False)] * 2 + [("und", True)] * 2 + [(model.predict(far[0])[0], True)], key=str)
    with pytest.raises(ValueError):
        langid.predict(odd, model)


def test_edge_tables(spark):
    odd = spark.createDataFrame([(None, None, None, "x"), (1, "", "en", "y"), (4, "the cat sat", None, "z")], "doc_id bigint, text string, lang string, score string")
    assert rows(langid.identify(odd).select("lang_pred", "rejected")) == [("und", True)] * 3  # nothing to learn from
    taught = odd.union(spark.createDataFrame([(i, f"the dog and the cat number {'x' * i}", "en", "s") for i in range(5, 12)], odd.schema))
    taught = taught.withColumnRenamed("score", "lang_pred").selectExpr("*", "1 as rejected", "2 as h", "3 as n", "4 as bound")
    kept = langid.keep_known(taught)
    assert kept.columns == taught.columns and kept.count() == 8
    assert {r["lang_pred"] for r in langid.identify(taught).collect()} == {"en", "und"}
