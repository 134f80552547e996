"""Exact top-k search for binary codes by incremental multi-index hashing.

A code of 64 bits is cut into m segments of about log2(n) bits, n being the number of different
codes, so that a value of a segment has a few codes however many there are. If two codes differ in
at most m (r + 1) - 1 bits, one segment of them differs in at most r. So one index by (segment,
value) over all codes is probed at segment radius 0, 1, 2, ...; each candidate is verified by its
full Hamming distance; and once the k-th distance found is at most m (r + 1) - 1, no code outside
can come before it and the query is done. Nothing is approximate.

The index is distributed: a bucket holds the values of a segment that share their first bits, about
SHARD codes. At each radius a query that is not done goes only to buckets that can hold a value that
far from its own, and streams past them; a bucket of far more codes (a value that many codes share)
is searched in parts. What they find is merged into the best of each query by a ranked window, which
tells who is done.

Equal codes are one entry with its number of rows and smallest id, so a code that a third of all
rows have is one entry; ids are joined to what was found at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm import common

#: Codes of a bucket (a part of it has at most twice as many, but for chance), neighbours.
SHARD, K = 32768, 10
#: Bits of a segment's value that a bucket indexes directly.
DENSE = 20


def sign_code(vector: Column) -> Column:
    """64 bits of the signs of a vector's first 64 entries: bit i is 1 if entry i is above 0. Null for a null vector; bits that a shorter vector lacks, and null entries, are 0."""
    bits = F.transform(F.slice(vector, 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def cuts(n: int) -> list[tuple[int, int]]:
    """The segments, as first bit and number of bits, for n codes: about log2(n) bits each, 8 at least and 32 at most."""
    m = min(8, max(2, round(64 / np.log2(max(n, 2)))))
    widths = [64 // m + (s < 64 % m) for s in range(m)]
    return [(sum(widths[:s]), w) for s, w in enumerate(widths)]


@lru_cache(64)
def _masks(bits: int, radius: int) -> np.ndarray:
    """All values of so many bits with `radius` of them set."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(bits), radius)], np.int64)


def segment(codes: np.ndarray, cut: tuple[int, int]) -> np.ndarray:
    return ((codes >> np.uint64(cut[0])) & np.uint64((1 << cut[1]) - 1)).astype(np.int64)


class Bucket:
    """Codes by the value of segment s, whose first `prefix` bits are the same for all."""

    def __init__(self, codes: np.ndarray, cut: list[tuple[int, int]], s: int, prefix: int) -> None:
        self.codes, self.cut, self.s, self.low = codes, cut, s, cut[s][1] - prefix
        value = segment(codes, cut[s])
        self.prefix, value = int(value[0]) >> self.low, value & (1 << self.low) - 1
        self.order = np.argsort(value, kind="stable")
        self.start = np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << self.low))])
        self.there = np.flatnonzero(np.diff(self.start))

    def at(self, code: np.uint64, radius: int) -> np.ndarray:
        """Positions of codes whose segment is exactly `radius` away, by probing or, if that is less, by going over the values there are."""
        value, start = int(segment(code, self.cut[self.s])), self.start
        radius -= (value >> self.low ^ self.prefix).bit_count()
        value &= (1 << self.low) - 1
        if not 0 <= radius <= self.low:
            return self.order[:0]
        if comb(self.low, radius) < len(self.there):
            values = value ^ _masks(self.low, radius)
            values = values[start[values] < start[values + 1]]
        else:
            values = self.there[np.bitwise_count(self.there ^ value) == radius]
        n = start[values + 1] - start[values]
        first = np.repeat(start[values] - np.cumsum(n) + n, n)
        return self.order[first + np.arange(n.sum())]

    def search(self, code: np.uint64, radius: int, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances of the k best codes at this radius of the segment that no other segment finds before."""
        got = self.at(code, radius)
        differ = self.codes[got] ^ code
        new = np.ones(len(got), bool)
        for t, cut in enumerate(self.cut):  # found before: by an earlier segment at this radius, or any at a smaller one
            if t != self.s:
                away = np.bitwise_count(segment(differ, cut))
                new &= (away >= radius) if t > self.s else (away > radius)
        got, distance = got[new], np.bitwise_count(differ[new]).astype(np.int64)
        if len(got) > k:
            near = distance <= np.searchsorted(np.cumsum(np.bincount(distance)), k)
            got, distance = got[near], distance[near]
        best = np.lexsort((first[got], distance))[:k]
        return got[best], distance[best]


def _probed(sorted_rows: DataFrame, radius: int, cut: list[tuple[int, int]], prefix: int, k: int) -> DataFrame:
    """Best codes at this radius for the queries of each bucket part. In a partition a part's entries come first and are indexed; its queries stream past, any number of them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, bucket, first, n = None, [], None, None, None
        for b in batches:
            keys = np.stack([b.column(x).to_numpy() for x in ("s", "bucket", "p", "asks")], axis=1)
            columns = [b.column(x).to_numpy() for x in ("code", "first", "n")]
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for i, j in zip(edges, edges[1:]):
                if i == j:
                    continue
                *key, asks = keys[i].tolist()
                if key != at:
                    at, held, bucket = key, [], None
                if not asks:
                    held.append([x[i:j].copy() for x in columns])
                elif held:
                    if bucket is None:
                        code, first, n = (np.concatenate(x) for x in zip(*held))
                        bucket = Bucket(code.view(np.uint64), cut, key[0], prefix)
                    asked = columns[0][i:j]
                    got = [bucket.search(q, radius, first, k) for q in asked.view(np.uint64)]
                    where = np.concatenate([w for w, _ in got])
                    out = [np.repeat(asked, [len(w) for w, _ in got]), code[where], first[where], n[where], np.concatenate([d for _, d in got]).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["code", "found", "first", "n", "distance"])

    return sorted_rows.mapInArrow(each, "code bigint, found bigint, first bigint, n bigint, distance int")


def _placed(codes: DataFrame, cut: list[tuple[int, int]], prefix: int) -> DataFrame:
    """The rows once for each segment s, with the first bits of its value as `bucket`."""
    part = F.array(*(F.struct(F.lit(s).alias("s"), F.expr(f"cast(shiftrightunsigned(code, {at + w - prefix}) & {(1 << prefix) - 1}L as int)" if prefix else "0").alias("bucket")) for s, (at, w) in enumerate(cut)))
    return codes.withColumn("at", F.explode(part)).select("*", "at.*").drop("at")


def _reached(placed: DataFrame, prefix: int, radius: int) -> DataFrame:
    """Queries at every bucket whose first bits are at most `radius` from their own."""
    if sum(comb(prefix, r) for r in range(radius + 1)) <= 4096:
        flips = F.lit([int(x) for r in range(min(radius, prefix) + 1) for x in _masks(prefix, r)])
    else:
        flips = F.expr(f"filter(sequence(0, {(1 << prefix) - 1}), x -> bit_count(x) <= {radius})")
    return placed.withColumn("flip", F.explode(flips)).withColumn("bucket", F.col("bucket").bitwiseXOR(F.col("flip").cast("int"))).drop("flip")


def top_k(rows: DataFrame, is_query: Column, k: int = K, shard: int = SHARD) -> DataFrame:
    """For each query row the k nearest other rows: query_id, rank (from 1), id, distance; ties by id.

    rows: id (bigint, unique) and code (bigint). Rows with a null id or code are neither found nor
    searched for. With fewer than k other rows a query gets them all; a repeated id counts once for
    each code it has.
    """
    rows = common.written(rows.select("id", "code", is_query.alias("q")).where("id is not null and code is not null").distinct(), "codes")
    entries = common.written(rows.groupBy("code").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.max("q").alias("q")), "entries")
    different, there = entries.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    need, cut = min(k + 1, there), cuts(different)
    widest = cut[0][1]
    prefix = min(cut[-1][1], max(0, int(np.ceil(np.log2(max(different, 1) / shard))), widest - DENSE))
    index = common.written(_placed(entries.select("code", "first", "n"), cut, prefix), "index")
    buckets = index.groupBy("s", "bucket").agg(F.ceil(F.count("*") / (2 * shard)).cast("int").alias("parts"))
    buckets = common.written(buckets, "buckets")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # told, as a few bucket parts are much work though small by bytes
    left, best, done = entries.where("q").select("code"), None, []
    by_code = Window.partitionBy("code")
    for radius in range(widest + 1):
        asked = common.written(_reached(_placed(left, cut, prefix), prefix, radius).join(buckets, ["s", "bucket"]), "asked")
        if asked.isEmpty():
            break
        zero = F.lit(0).cast("bigint")
        parts = F.explode(F.expr("sequence(0, parts - 1)"))
        queries = asked.select("s", "bucket", parts.alias("p"), F.lit(1).alias("asks"), "code", zero.alias("first"), zero.alias("n"))
        held = index.join(asked.select("s", "bucket", "parts").distinct(), ["s", "bucket"])
        held = held.select("s", "bucket", F.expr("pmod(xxhash64(code), parts)").cast("int").alias("p"), F.lit(0).alias("asks"), "code", "first", "n")
        parted = queries.union(held).repartition(tasks, "s", "bucket", "p").sortWithinPartitions("s", "bucket", "p", "asks")
        found = _probed(parted, radius, cut, prefix, k + 1)
        found = found if best is None else found.union(best)
        found = found.withColumn("rank", F.row_number().over(by_code.orderBy("distance", "first"))).where(F.col("rank") <= k + 1).drop("rank")
        covered = F.sum(F.when(F.col("distance") < len(cut) * (radius + 1), F.col("n"))).over(by_code)
        found = common.written(found.withColumn("done", F.coalesce(covered >= need, F.lit(False))), "found")
        done.append(found.where("done").drop("done"))
        best = found.where("not done").drop("done")
        left = common.written(left.join(done[-1].select("code").distinct(), "code", "left_anti"), "left")
    if not done:
        return rows.limit(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), "id", F.lit(0).alias("distance"))
    near = done[0]
    for more in done[1:]:
        near = near.union(more)
    smallest = rows.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k + 1)
    near = near.select("code", "found", "distance").join(smallest.select(F.col("code").alias("found"), "id"), "found")
    near = near.withColumn("n", F.row_number().over(by_code.orderBy("distance", "id"))).where(F.col("n") <= k + 1)
    near = near.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("near"))
    asked = rows.where("q").select(F.col("id").alias("query_id"), "code").join(near, "code")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    return asked.select("query_id", F.posexplode(others).alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.id", "x.distance")
