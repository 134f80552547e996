"""op5 against brute force over windows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from chronofold.llm import substring


def slow(docs, window=35):
    words = [(t or "").encode().split() for t in docs]
    count = Counter(tuple(w[s : s + window]) for w in words for s in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if count[tuple(w[s : s + window])] > 1:
                gone[s : s + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, docs, block=substring.BLOCK):
    df = spark.createDataFrame([(i, t, "m", 1) for i, t in enumerate(docs)], "doc_id bigint, text string, m string, th int")
    got = {r["doc_id"]: r for r in substring.remove_repeats(df, block=block).collect()}
    want = slow(docs)
    assert [(got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) for i in range(len(docs))] == want
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in got.values())
    return want


def corpus(rnd, n=60):
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [rnd.choices(vocabulary, k=rnd.choice([34, 35, 36, 60, 120])) for _ in range(6)]
    docs = [None, "", "short", "a " * 34, "b " * 36, "c " * 200, "x y " * 90, "c " * 80]
    for _ in range(n):
        w = []
        for _ in range(rnd.randint(1, 5)):
            w += rnd.choice(passages) if rnd.random() < 0.4 else rnd.choices(vocabulary, k=rnd.randint(1, 80))
        if rnd.random() < 0.3:
            w[rnd.randrange(len(w))] = "edited"
        docs.append(" \n"[rnd.random() < 0.2].join(w))
    return docs + docs[-4:] + [docs[-1] + " tail", "head " + docs[-2]]


def test_corpora_equal_brute_force(spark):
    for seed in range(3):
        want = check(spark, corpus(random.Random(seed)))
        assert 0 < sum(x[1] for x in want) < sum(x[0] for x in want)


def test_large_blocks(spark):
    """Reference blocks over their size: divided by a second minimiser, and dealt out in parts where that one is hot too."""
    rnd = random.Random(9)
    line = [f"l{i}" for i in range(34)]
    docs = [" ".join([*rnd.choices(["p", "q"], k=3), *line, *rnd.choices(["r", "s", "t"], k=3)]) for _ in range(50)]
    check(spark, docs, 3)
    vocabulary = [f"w{i}" for i in range(30)]
    ways = [rnd.choices(vocabulary, k=40) for _ in range(4)]
    docs = [" ".join([*rnd.choice(ways)[: rnd.randint(20, 40)], *line[:9], *rnd.choice(ways)[: rnd.randint(5, 40)]] * rnd.randint(1, 2)) for _ in range(80)]
    check(spark, docs, 3)
    check(spark, corpus(random.Random(7)), 1)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["a", "b"]), max_size=90).map(" ".join), min_size=1, max_size=6))
def test_two_letter_worlds(spark, docs):
    check(spark, docs)


def test_edges_of_tables(spark):
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    text = " ".join(map(str, range(50)))
    df = spark.createDataFrame([(None, text), (None, text), (None, None), (1, "z " + text)], "doc_id bigint, text string")
    assert sorted(r["n_removed"] for r in substring.remove_repeats(df).collect()) == [0, 50, 50, 50]


def test_greedy_parse_crosses_factor_ends():
    """Two references: after the first factor's end the parse goes on window by window and finds the second."""
    h = np.arange(200, dtype=np.uint64) * np.uint64(7919)
    words = [h[:100], h[:60], h[30:100]]
    windows = [substring.gram_hashes(w, 35) for w in words]
    index = {}
    for i, w in enumerate(windows):
        for j, x in enumerate(w.tolist()):
            index.setdefault(x, []).append((i, j))
    index = {k: v[:2] for k, v in index.items()}
    found = substring.factor(0, words, windows, index)
    assert sorted(s for a, b in found for s in range(a, b + 1)) == [*range(26), *range(30, 66)]


def test_sliding_min_and_powers():
    x = np.random.default_rng(1).integers(0, 1000, 300).astype(np.uint64)
    for n in (1, 2, 3, 28, 35):
        assert (substring._sliding_min(x, n) == [x[i : i + n].min() for i in range(len(x) - n + 1)]).all()
    power, inverse = substring._powers_to(50)
    assert (power[:50] * inverse[:50] == 1).all()
