"""op1 against brute force, and its edge cases."""

from __future__ import annotations

import random

import numpy as np
import xxhash
from conftest import rows

from chronofold.llm import simhash

KIND = "doc_id bigint, text string, lang string, fp string, component_id string"


def slow_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(fps))]


def test_texts_against_brute_force(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    base = [" ".join(rnd.choices(words, k=400)) for _ in range(4)]
    docs = [None, "", " \t\n", "One", "one", "ONE two", "Ünïcode É É", "a b c"]
    for b in base:
        for _ in range(12):
            w = b.split()
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            docs.append(" ".join(w))
    docs += docs[-3:]
    df = spark.createDataFrame([(i, t, "en", "x", "y") for i, t in enumerate(docs)], KIND)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    fps = [slow_fingerprint(t) for t in docs]
    assert [int(got[i]["fingerprint"], 16) for i in range(len(docs))] == fps
    want = slow_components(fps)
    assert [got[i]["component_id"] for i in range(len(docs))] == want
    assert len(set(want)) < len(docs) - 3


def test_links_of_planted_distances(spark):
    """Chains at distance 1 to 4 in either half, in blocks of two, against brute force."""
    rnd = random.Random(2)
    fps = []
    for _ in range(12):
        x = rnd.getrandbits(64)
        for _ in range(8):
            fps.append(x)
            for bit in rnd.sample(range(64), rnd.randint(1, 4)):
                x ^= 1 << bit
    fps = sorted(set(fps))
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp bigint")
    for block in (2, 2048):
        edges = rows(simhash.links(df, block))
        index = {int(np.uint64(f).astype(np.int64)): i for i, f in enumerate(fps)}
        parent = list(range(len(fps)))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            assert bin((a ^ b) & (1 << 64) - 1).count("1") <= 3
            x, y = sorted((find(index[a]), find(index[b])))
            parent[y] = x
        assert [find(i) for i in range(len(fps))] == slow_components(fps)


def test_anchors_cover(spark):
    """Any two fingerprints within three bits meet at the home anchor of either."""
    rnd = random.Random(3)
    xs = [rnd.getrandbits(64) for _ in range(60)]
    pairs = []
    for x in xs:
        y = x
        for bit in rnd.sample(range(64), 3):
            y ^= 1 << bit
        pairs += [x, y]
    df = spark.createDataFrame([(i, int(np.uint64(x).astype(np.int64))) for i, x in enumerate(pairs)], "i int, fp bigint")
    of = {}
    for r in simhash.anchored(df).collect():
        of.setdefault(r["fp"], []).append(r)
    got = {r["i"]: of[r["fp"]] for r in df.collect()}
    for i in range(0, len(pairs), 2):
        near = {a["anchor"] for a in got[i + 1]}
        assert any(a["home"] and a["anchor"] in near for a in got[i])
        assert len({a["anchor"] for a in got[i]}) == len(got[i]) <= 32


def test_edges_of_tables(spark):
    empty = spark.createDataFrame([], KIND)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.near_dedup(empty).count() == 0
    df = spark.createDataFrame([(None, "x y z", "a", "b", "c"), (None, "x y z", "a", "b", "c"), (7, "x y z", None, None, None), (None, None, None, None, None), (3, "", "a", "b", "c")], KIND)
    assert rows(simhash.near_duplicates(df).select("doc_id", "component_id")) == sorted([(None, 7), (None, 7), (7, 7), (None, 3), (3, 3)], key=str)
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns and rows(kept.select("doc_id")) == [(3,), (7,)]


def test_very_long_text():
    text = b"a b c d " * 100_000
    assert simhash.fingerprint(text) == simhash.fingerprint(text, 3)
    assert simhash.fingerprint(b"") == 0
