"""op6 to op10 against brute force, oracles and held-out accuracy."""

from __future__ import annotations

import hashlib
import pathlib
import random
import struct
import zlib

import duckdb
import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from chronofold.llm import common, hamming, media, queries, rollup
from chronofold.sources import commits

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert rows(df.select(columns)) == sorted(map(tuple, want), key=str)


def test_word_count(spark):
    texts = [None, "", " a\tb\x0bc \n", "é é x", "a" * 1000, "\x1cx \x85"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(common.word_count(F.col("text"))).collect()] == [len((t or "").encode().split()) for t in texts]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (7, 7), (5, 1), (8, 9)] + [(100, i) for i in range(101, 160)] + [(i, i + 1) for i in range(200, 240)]
    got = dict(rows(common.components(spark.createDataFrame(edges, "a bigint, b bigint"))))
    assert got == {**{i: 1 for i in range(2, 6)}, 9: 8, **{i: 100 for i in range(101, 160)}, **{i: 200 for i in range(201, 241)}}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_rollup_is_idempotent(spark, root):
    kind = "op string, source string, lang string, tokenizer string, tokens bigint, old_tokens bigint"
    t = rollup.TokenRollup(spark, root)
    assert t.totals().count() == 0
    first = spark.createDataFrame([("insert", "a", "en", "v1", 10, None), ("insert", "a", "en", "v1", 5, None), ("insert", None, None, "v1", None, None)], kind)
    second = spark.createDataFrame([("revise", "a", "en", "v1", 7, 10), ("delete", "a", "en", "v1", 5, None)], kind)
    assert t.commit("1", first) and t.commit("2", second) and not t.commit("2", second) and not t.commit("1", second)
    assert rows(t.totals()) == sorted([("a", "en", "v1", 1, 7), (None, None, "v1", 1, 0)], key=str)
    assert rows(rollup.TokenRollup(spark, root).totals()) == rows(t.totals())
    assert t.commit("empty", first.limit(0)) and t.totals().count() == 2
    with pytest.raises(Exception, match="unknown op"):
        t.commit("3", spark.createDataFrame([("x", "a", "en", "v1", 1, 1)], kind))


def test_rollup_survives_a_writer_that_dies(spark, root, monkeypatch):
    kind = "op string, source string, lang string, tokenizer string, tokens bigint, old_tokens bigint"
    rows_ = spark.createDataFrame([("insert", "a", "en", "v1", 10, None)], kind)
    t = rollup.TokenRollup(spark, root)
    with monkeypatch.context() as m:  # dies between the marker's contents and its name
        m.setattr(commits.Commits, "_give", lambda *_: (_ for _ in ()).throw(RuntimeError("dead")))
        with pytest.raises(RuntimeError):
            t.commit("1", rows_)
    assert t.totals().count() == 0 and not t.committed("1")
    (pathlib.Path(root.removeprefix("file://")) / "commits" / b"2".hex()).touch()  # an empty marker is no commit
    assert t.totals().count() == 0
    for batch in "12":
        assert t.commit(batch, rows_) and not t.commit(batch, rows_)
    assert rows(t.totals()) == [("a", "en", "v1", 2, 20)]


def test_rollup_compacts(spark, root):
    kind = "op string, source string, lang string, tokenizer string, tokens bigint, old_tokens bigint"
    t = rollup.TokenRollup(spark, root)
    assert t.compact() == 0
    for i in range(4):
        assert t.commit(f"b{i}", spark.createDataFrame([("insert", "a", "en", "v1", i, None), ("insert", "b", None, "v1", 1, None)], kind))
        if i % 2:
            before = rows(t.totals())
            assert t.compact() == i + 1 and rows(t.totals()) == before and len(t._folders()[1]) == 1
    assert not t.commit("b0", spark.createDataFrame([("insert", "a", "en", "v1", 1, None)], kind))
    assert rows(t.totals()) == sorted([("a", "en", "v1", 4, 6), ("b", None, "v1", 4, 4)], key=str)


def slow_top_k(points, queried, k):
    out = []
    for q, c in points:
        if q in queried:
            near = sorted((bin((c ^ d) & (1 << 64) - 1).count("1"), i) for i, d in points if i != q)[:k]
            out += [(q, r, i, d) for r, (d, i) in enumerate(near, 1)]
    return sorted(out)


def test_hamming_top_k(spark):
    rnd = random.Random(11)
    codes = [rnd.getrandbits(64) for _ in range(60)]
    points = [(i, rnd.choice(codes) ^ (1 << rnd.randrange(64) if rnd.random() < 0.5 else 0)) for i in range(300)]
    points += [(i, codes[0]) for i in range(300, 400)]
    points = [(i, int(np.uint64(c).astype(np.int64))) for i, c in points]
    df = spark.createDataFrame([*points, (None, 5), (1000, None)], "id bigint, code bigint")
    for shard in (65536, 10):
        assert sorted(rows(hamming.top_k(df, F.col("id") % 20 == 0, 5, shard))) == slow_top_k(points, {i for i, _ in points if i % 20 == 0}, 5)
    few = spark.createDataFrame([(0, 1), (1, 3)], "id bigint, code bigint")
    assert rows(hamming.top_k(few, F.col("id") == 0)) == [(0, 1, 1, 1)]
    assert hamming.top_k(few.limit(0), F.lit(True)).count() == 0


def test_hamming_segments_and_far_queries(spark):
    """Codes that share a segment's value lie in one bucket, searched in parts; a query far from all grows its radius to the end."""
    rnd = random.Random(12)
    points = [(i, rnd.getrandbits(48) << 16 | 7) for i in range(200)] + [(200, 0), (220, (1 << 64) - 1)]
    points = [(i, int(np.uint64(c).astype(np.int64))) for i, c in points]
    df = spark.createDataFrame(points, "id bigint, code bigint")
    assert sorted(rows(hamming.top_k(df, F.col("id") % 20 == 0, 3, 16))) == slow_top_k(points, {i for i, _ in points if i % 20 == 0}, 3)
    for n, m in ((0, 8), (2, 8), (500, 7), (1 << 16, 4), (1 << 21, 3), (1 << 40, 2)):
        got = hamming.cuts(n)
        assert len(got) == m and [a for a, _ in got] == [sum(w for _, w in got[:s]) for s in range(m)] and sum(w for _, w in got) == 64


def test_sign_code(spark):
    v = [1.0, -1.0, 0.0, None, 2.0] + [-1.0] * 58 + [3.0] + [9.0] * 4
    df = spark.createDataFrame([(v,), (None,)], "v array<float>")
    assert [r[0] for r in df.select(hamming.sign_code(F.col("v"))).collect()] == [int(np.uint64(1 | 16 | 1 << 63).astype(np.int64)), None]


def test_media_formats():
    rng = np.random.default_rng(3)
    p = rng.integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert (media.decode(media.encode_ppm(p)) == p).all() and (media.decode(media.encode_bmp(p)) == p).all()
    assert (media.decode(b"P2\n# c\n2 2\n9\n1 2\n3 4\n")[:, :, 0] == [[1, 2], [3, 4]]).all()
    assert (media.decode(b"P1\n3 1\n1 0 1\n")[:, :, 0] == [[0, 1, 0]]).all()
    assert (media.decode(b"P4\n3 2\n\xa0\x40")[:, :, 0] == [[0, 1, 0], [1, 0, 1]]).all()
    assert (media.decode(b"P5 2 1 65535\n\x01\x00\x00\x02")[:, :, 0] == [[256, 2]]).all()
    for bad in (b"", b"P6\n4 4\n255\nxx", b"GIF89a", b"P9"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_media_brightness_and_bad_palettes(spark):
    """A sample of a file's own full brightness is white in the tile; a pixel beyond its palette makes the file unreadable."""
    white = [b"P5 1 1 65535\n\xff\xff", b"P5 1 1 15\n\x0f", b"P2 1 1 9\n9", b"P4 1 1\n\x00", b"P6 1 1 255\n\xff\xff\xff"]
    head = struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 8, 0, 4, 0, 0, 1, 0)
    bad = b"BM" + struct.pack("<IHHI", 62, 0, 0, 58) + head + b"\x00\x00\x00\x00" + b"\x07\x00\x00\x00"
    files = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate([*white, bad, b"P5 1 1 0\n\x00"])], "id int, media binary")
    got = {r["id"]: r for r in media.with_features(files).collect()}
    for i in range(len(white)):
        assert set(got[i]["tile"][-64:]) == {255}
    assert got[5]["height"] is None and got[6]["height"] is None


def slow_dhash(pixels):
    """The difference hash from plainly averaged cells."""
    small = slow_resize(pixels, 8, 9)
    luma = small @ np.array([0.299, 0.587, 0.114])
    return "".join(f"{int(''.join(str(int(round(r[j + 1] * 256) > round(r[j] * 256))) for j in range(8)), 2):02x}" for r in luma)


def slow_resize(pixels, height, width):
    p = pixels.astype(float)
    h, w, c = p.shape
    out = np.zeros((height, width, c))
    for i in range(height):
        for j in range(width):
            total = area = 0
            for y in range(h):
                dy = max(0.0, min(y + 1, (i + 1) * h / height) - max(y, i * h / height))
                for x in range(w):
                    a = dy * max(0.0, min(x + 1, (j + 1) * w / width) - max(x, j * w / width))
                    total, area = total + a * p[y, x], area + a
            out[i, j] = total / area
    return out


def test_area_resize(monkeypatch):
    p = np.random.default_rng(4).integers(0, 256, (11, 13, 3)).astype(np.uint8)
    for size in ((8, 9), (3, 4), (20, 20), (1, 1)):
        for strip in (4096, 3, 1):
            monkeypatch.setattr(media, "STRIP", strip)
            assert np.allclose(media.area_resize(p, *size), slow_resize(p, *size))


def test_text_media(spark):
    texts = [None, "", "x" * 192, "é" * 97, "same", "same", "long " * 40000]
    df = spark.createDataFrame([(i, t, "w") for i, t in enumerate(texts)], "doc_id bigint, text string, width string")
    got = {r["doc_id"]: r for r in media.text_media(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        pixels = np.frombuffer(padded, np.uint8).reshape(-1, 64, 3)
        if len(raw) < 1000:
            samples = np.rint(slow_resize(pixels, 8, 8)).astype(np.uint8)
            npy = b"\x93NUMPY\x01\x00v\x00" + b"{'descr': '|u1', 'fortran_order': False, 'shape': (8, 8, 3), }".ljust(117) + b"\n" + samples.tobytes()
            assert got[i]["feature"] == f"{slow_dhash(pixels)}:{hashlib.sha256(npy).hexdigest()}"
    assert got[4][1:] == got[5][1:] and got[0][1:] == got[1][1:]
    assert media.text_media(df.limit(0)).count() == 0
    named = df.selectExpr("concat('d', doc_id) as doc_id", "text")
    assert {r["doc_id"] for r in media.text_media(named).collect()} == {f"d{i}" for i in range(len(texts))}
    files = spark.createDataFrame([(bytearray(media.store(b"hello")),), (bytearray(b"no"),), (None,)], "media binary")
    assert [r["height"] for r in media.with_features(files).collect()] == [1, None, None]
