"""op2 against tiktoken, and streaming decoding at every cut."""

from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from conftest import rows

from chronofold.llm import bpe

FILES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module", params=FILES)
def pair(request):
    data = open(P.path(request.param), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return bpe.Tokenizer(data, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts(pair):
    own, library = pair
    rnd = random.Random(4)
    texts = ["", " ", "\n\n  x", "don't'll", "<|endoftext|>", "a" * 5000, "ab" * 3000, " " * 2000, "!" * 999, "漢字" * 700, "👍" * 400]
    texts += ["".join(rnd.choice("abcdehilnorst ABC é漢👍\n\t.,!'0123") for _ in range(rnd.randint(0, 200))) for _ in range(800)]
    for t in texts:
        ids = own.encode(t)
        assert ids == library.encode_ordinary(t)
        assert own.decode(ids) == t


def test_pairs_fit_as_merging_says(pair):
    t = pair[0].transducer
    rnd, ids = random.Random(5), list(t.bytes_of)
    for _ in range(20000):
        a, b = rnd.choice(ids), rnd.choice(ids)
        x, y = t.bytes_of[a], t.bytes_of[b]
        assert t.fits(a, b) == (t.merged(x + y)[0] == [x, y])


def test_window_cuts_change_nothing(pair, monkeypatch):
    own, library = pair
    monkeypatch.setattr(bpe, "WINDOW", 8)
    rnd = random.Random(6)
    for _ in range(300):
        w = "".join(rnd.choice("abcdehilnorstu") for _ in range(rnd.randint(30, 200)))
        assert list(own.transducer.encode(w.encode())) == library.encode_ordinary(w)


def test_decoder_cuts_anywhere():
    raw = "aé漢👍z".encode() + b"\xff\xe6\xbc" + "x".encode() + b"\xf0\x9f"
    want = raw.decode("utf-8", "replace")
    for size in range(1, 9):
        d = bpe.Utf8Decoder()
        assert "".join([*(d.feed(raw[i : i + size]) for i in range(0, len(raw), size)), d.finish()]) == want


def test_encode_and_decode_frames(spark):
    df = spark.createDataFrame([(1, "Hello wörld", "a"), (2, None, "b"), (None, "", None), (1, "Hello wörld", "a")], "doc_id bigint, text string, n string")
    path = P.path(FILES[0])
    got = bpe.encode(df, path, P.PATTERN)
    assert got.count() == 4
    one = got.where("doc_id = 1").first()
    assert one["n_tokens"] == len(one["ids"])
    assert one["ids_sha256"] == hashlib.sha256(" ".join(map(str, one["ids"])).encode()).hexdigest()
    assert one["decoded_sha256"] == hashlib.sha256("Hello wörld".encode()).hexdigest()
    assert got.where("doc_id = 2").first()["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows(bpe.decode(got.select("doc_id", "ids"), path, P.PATTERN)) == sorted([(1, "Hello wörld"), (2, ""), (None, ""), (1, "Hello wörld")], key=str)
    assert bpe.encode(df.limit(0), path, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(df.withColumnRenamed("n", "n_tokens"), path, P.PATTERN)
