"""SimHash near-dedup by anchor-point covering.

A fingerprint is 64 bits. Two that differ in at most three bits differ in at most one bit of one
of their halves. On the lower 31 bits of a half the anchors are the words of the perfect Hamming
code [31, 26]: covering radius 1, so each fingerprint has one home anchor at distance 0 or 1. It
is replicated to every anchor within radius + threshold = 1 + 1 (1 anchor if it is itself a code
word, else 16). A linked pair then meets at the home anchor of either. The spare bit of each half
takes no part in the choice of candidates, only in the comparison.

Compared per anchor: distinct fingerprints only (copies are one), anchors that are somebody's
home only. An anchor with more than BLOCK fingerprints is dealt out as pairs of blocks, each a
group of bounded size; no pair is skipped. A group returns a spanning forest of its links, never
all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from chronofold.llm import common

#: Most fingerprints of an anchor that are compared in one group; beyond it, blocks of this size in pairs.
BLOCK = 2048
#: Shingles whose bits are counted at once, which bounds memory for very long texts.
AT_ONCE = 1 << 16
THRESHOLD = 3


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of a UTF-8 text: A-Z lower-cased, shingles of words, repeats included.

    Fewer words than a shingle has: the whole sequence. No words: 0. A bit is 1 if set in over
    half the hashes.
    """
    w = text.lower().split()  # on bytes: A-Z only
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, n)
    count = np.zeros(64, np.int64)
    for i in range(0, n, AT_ONCE):
        part = h[i : i + AT_ONCE]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


@arrow_udf(T.LongType())
def fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Fingerprints of texts as (signed) longs. Only the texts are sent to Python, nothing of them comes back."""
    for batch in texts:
        yield pa.array(np.fromiter((fingerprint(x) for x in common.utf8(batch)), np.uint64, len(batch)).view(np.int64))


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """The rows with their fingerprint as a (signed) long in column `name`, which must be new."""
    return docs.withColumn(name, fingerprints(F.col(text)))


def anchored(fps: DataFrame) -> DataFrame:
    """(fp, anchor, home) for every anchor within radius 2 of each half; bit 40 tells the halves' anchors apart.

    A half with syndrome s has its home where bit s is flipped (none for 0), and 15 anchors more where
    bits i and i ^ s are, all i without s's highest bit. Plain arithmetic after the explodes, so that
    it is compiled.
    """
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt out anew, by another hash than the one it came by: what comes in is small by bytes and would be merged into a few tasks
    got = fps.select("fp").repartition(n, F.xxhash64("fp")).select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    got = got.withColumn("x", F.expr("shiftrightunsigned(fp, half * 32) & 2147483647"))
    masks = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]
    got = got.withColumn("s", F.expr(" | ".join(f"shiftleft(cast(bit_count(x & {m}L) % 2 as int), {k})" for k, m in enumerate(masks))))
    got = got.withColumn("b", F.expr("case when s >= 16 then 4 when s >= 8 then 3 when s >= 4 then 2 when s >= 2 then 1 else 0 end"))
    got = got.withColumn("t", F.explode(F.expr("sequence(0, if(s = 0, 0, 15))")))
    got = got.withColumn("i", F.expr("shiftleft(shiftright(t, b), b + 1) | (t & (shiftleft(1, b) - 1))"))
    flip = "if({0} = 0, 0L, shiftleft(1L, {0} - 1))"
    return got.select("fp", F.expr(f"(x ^ {flip.format('i')} ^ {flip.format('(i ^ s)')}) | shiftleft(cast(half as bigint), 40)").alias("anchor"), F.expr("i = 0").alias("home"))


def _forest(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links in each group, compared row by row against what is not yet reached."""
    for b in groups:
        left, right = [], []
        for row in b.column("fps"):
            fp = row.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            rest = np.ones(len(fp), bool)
            while rest.any():
                front = [int(np.flatnonzero(rest)[0])]
                rest[front[0]] = False
                while front:
                    at = front.pop()
                    near = np.flatnonzero(rest)
                    near = near[np.bitwise_count(fp[near] ^ fp[at]) <= THRESHOLD]
                    if len(near):
                        rest[near] = False
                        front.extend(near.tolist())
                        left.append(np.full(len(near), fp[at]))
                        right.append(fp[near])
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], names=["a", "b"])


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within the threshold. fps: distinct, in column fp."""
    at = anchored(fps)
    live = at.groupBy("anchor").agg(F.count("*").alias("n"), F.max("home").alias("h")).where("n > 1 and h").drop("h")
    live = common.written(live, "anchors")  # so that the join has exchanges of its own on both sides, and a hot anchor can be split
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    dealt = at.join(live, "anchor").select("anchor", "fp", blocks.alias("k")).withColumn("i", own)
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    groups = dealt.groupBy("anchor", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q")).agg(F.collect_list("fp").alias("fps"))
    return groups.where("size(fps) > 1").select("fps").mapInArrow(_forest, "a long, b long").distinct()


def near_components(ids: DataFrame) -> DataFrame:
    """(id, fp) rows with component_id, the smallest id of any row reachable over links, itself included.

    Rows of one fingerprint are one node, so exact copies cost nothing. Null ids count as larger
    than all; component_id is null only if no row of the component has an id. An empty table gives
    an empty result.
    """
    nodes = ids.groupBy("fp").agg(F.min("id").alias("first"))
    of = common.components(links(nodes.select("fp")))
    nodes = nodes.join(of.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    return ids.join(nodes.join(least, "root").select("fp", "component_id"), "fp")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint zero and are linked like others. Other columns are
    ignored, whatever their names.
    """
    thin = with_fingerprints(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))).select("id", "fp")
    found = near_components(common.written(thin, "fingerprints"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents with one row of each component left: that with the smallest id (nulls last).

    Columns stay as they are, whatever they are called. Repeated rows and null ids are told apart by a row number, fixed by
    writing the table once, so exactly one row stays of each component.
    """
    rows = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    wide = common.written(docs.select(F.monotonically_increasing_id().alias("at"), rows.alias("row"), fingerprints(F.col(text)).alias("fp")), "documents")
    key = F.col(f"row.`{doc_id}`")
    ids = wide.select("fp", F.struct(key.isNull().alias("n"), key.alias("d"), F.col("at").alias("r")).alias("id"))
    nodes = ids.groupBy("fp").agg(F.min("id").alias("first"))
    of = common.components(links(nodes.select("fp")))
    nodes = nodes.join(of.withColumnRenamed("node", "fp"), "fp", "left")
    first = nodes.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    return wide.join(first.select(F.col("first.r").alias("at")), "at", "left_semi").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
