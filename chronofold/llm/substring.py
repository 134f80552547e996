"""Substring dedup by relative Lempel-Ziv parsing.

A word goes if a window of WINDOW words around it occurs anywhere else. Each document is factored
against reference blocks; factors of at least a window's length are duplicate spans, and the windows
that cross a factor's end are checked by starting the next factor there.

Which blocks matter to a document follows from minimisers. The smallest hash among the GRAM-word
grams of a window is the same wherever the window occurs, so all occurrences of a window lie in the
reference block of that hash. A run is a stretch of windows with one minimiser, its passage the
words under it (about 48). Runs are a fifteenth of the windows, and only they are shuffled.

1. Runs of all documents, counted by minimiser. A minimiser that one run alone has, once, is done.
2. Runs whose whole passage occurs again are one factor: all its windows are duplicates.
3. Of the other passages, one of each text goes to its reference block and is parsed greedily
   against an index of the block. This settles the ends of duplicate spans and the surroundings of
   edits.
4. A block over BLOCK passages (a gram that very many texts have) is divided first: its passages are
   cut into runs by minimisers of FINE words, again equal runs are one factor, and one run of each
   text goes to the smaller block of both minimisers. Should such a block be over BLOCK too, it is
   split, and each passage is parsed against every part.

Words are compared by 64-bit hashes, whole windows by all their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm import common

WINDOW, GRAM = 35, 8
#: Words of the grams that divide a block of too many passages.
FINE = 24
#: Most passages of a reference block that one task indexes at once (and as many again to parse).
BLOCK = 1024
#: Tasks over which the passages of one block are dealt before its size is known.
SALTS = 64
#: Fixed odd multipliers for sums over words.
_BASE = 0x9E3779B97F4A7C15
_FACTORS = [pow(_BASE, i + 1, 1 << 64) | 1 for i in range(max(WINDOW, GRAM))]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words."""
    total = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        total += h[i : i + len(total)] * np.uint64(_FACTORS[i])
    return _mixed(total)


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive entries, by doubling."""
    have = 1
    while have * 2 <= n:
        x, have = np.minimum(x[:-have], x[have:]), have * 2
    return np.minimum(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least n of each; kept up to a million."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    size = max(n, 1 << 14)
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(size, np.uint64(base))
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if size <= 1 << 20:
        _powers = made
    return made


def runs(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Stretches of windows with one minimiser: it, the passage's hash, first and last window, whether the gram recurs in the document."""
    if len(h) < window:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int32),) * 2 + (np.zeros(0, bool),)
    g = gram_hashes(h, gram)
    least = _sliding_min(g, window - gram + 1)
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [len(least) - 1]])
    power, inverse = _powers_to(len(h))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[: len(h)], dtype=np.uint64)])
    passage = _mixed((sums[last + window] - sums[first]) * inverse[first] + (last - first).astype(np.uint64) * np.uint64(_FACTORS[1]))
    ordered = np.sort(g)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    m = least[first]
    return m, passage, first.astype(np.int32), last.astype(np.int32), np.isin(m, twice) if len(twice) else np.zeros(len(m), bool)


def _runs_of(docs: DataFrame) -> DataFrame:
    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [runs(word_hashes(x.split())) for x in common.utf8(b.column("text"))]
        ends = pa.array(np.cumsum([0, *(len(r[0]) for r in got)]), pa.int32())
        flat = [np.concatenate([r[i] for r in got]) if got else np.zeros(0) for i in range(5)]
        kinds = (np.int64, np.int64, np.int32, np.int32, bool)
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.view(k) if k is np.int64 else x.astype(k))) for x, k in zip(flat, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), *lists], names=["doc_id", "th", "m", "ph", "lo", "hi", "again"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.by_batch(docs, each, f"doc_id {kind}, th bigint, m array<bigint>, ph array<bigint>, lo array<int>, hi array<int>, again array<boolean>")


def _covered(n: int, spans: list[tuple[int, int]], window: int = WINDOW) -> np.ndarray:
    """Which of n words are under a duplicate window; spans: first and last window."""
    edge = np.zeros(n + 1, np.int64)
    if spans:
        a = np.array(spans, np.int64).reshape(-1, 2)
        np.add.at(edge, a[:, 0], 1)
        np.add.at(edge, a[:, 1] + window, -1)
    return np.cumsum(edge[:-1]) > 0


_RESULT = "n_words bigint, n_removed bigint, kept_sha256 string, kept string"


def _result(text: bytes, spans: list[tuple[int, int]], texts: bool) -> tuple:
    words = text.split()
    gone = _covered(len(words), spans)
    kept = b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x] if spans else words)
    return len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None


_RESULT_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string())
_PASSAGE = pa.struct([("m", pa.int64()), ("ph", pa.int64()), ("alone", pa.bool_()), ("lo", pa.int32()), ("words", pa.binary())])
_SPAN = pa.struct([("lo", pa.int32()), ("hi", pa.int32())])


def _first_pass(planned: DataFrame, texts: bool) -> DataFrame:
    """Results of documents that are settled; text and spans so far of the others; passages for the blocks."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows, passages, open_text, open_spans = [], [], [], []
                for raw, spans, wanted in zip(common.utf8(b.column("text")), b.column("spans"), b.column("wanted"), strict=True):
                    spans = [(x["lo"], x["hi"]) for x in spans.as_py() or ()]
                    wanted = wanted.as_py() or ()
                    h = word_hashes(raw.split()) if wanted else None
                    passages.append([{k: x[k] for k in ("m", "ph", "alone", "lo")} | {"words": h[x["lo"] : x["hi"] + WINDOW].tobytes()} for x in wanted])
                    unsettled = any(x["alone"] for x in wanted)
                    rows.append((None,) * 4 if unsettled else _result(raw, spans, texts))
                    open_text.append(raw if unsettled else None)
                    open_spans.append([{"lo": x, "hi": y} for x, y in spans] if unsettled else [])
                columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _RESULT_KINDS, strict=True)]
                columns += [pa.array(open_text, pa.binary()), pa.array(open_spans, pa.list_(_SPAN)), pa.array(passages, pa.list_(_PASSAGE))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), *columns], names=["doc_id", "th", "n_words", "n_removed", "kept_sha256", "kept", "open", "spans", "passages"])

    kind = planned.schema["doc_id"].dataType.simpleString()
    return planned.mapInArrow(each, f"doc_id {kind}, th bigint, {_RESULT}, open binary, spans array<struct<lo:int,hi:int>>, passages array<struct<m:bigint,ph:bigint,alone:boolean,lo:int,words:binary>>")


def factor(member: int, words: list[np.ndarray], windows: list[np.ndarray], index: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """Greedy parse of one passage against an indexed block: factors of a window or more, as first and last window.

    The index has for each window's hash two occurrences, so that one is always elsewhere. After a
    factor the parse goes on with the first window that crosses its end; any reference will do for a
    factor, as what a longer one had covered is found from there.
    """
    out, at, own = [], 0, words[member]
    while at < len(windows[member]):
        where = next((x for x in index[int(windows[member][at])] if x != (member, at)), None)
        length = 0
        if where is not None:
            other = words[where[0]][where[1] :]
            n = min(len(own) - at, len(other))
            differ = np.flatnonzero(own[at : at + n] != other[:n])
            length = int(differ[0]) if len(differ) else n
        if length >= WINDOW:
            out.append((at, at + length - WINDOW))
            at += length - WINDOW + 1
        else:
            at += 1
    return out


def _finer(members: DataFrame) -> DataFrame:
    """The passages cut into runs by minimisers of FINE words, m2; ph and lo are the runs' own."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                rows, fine, passage, start, words = [], [], [], [], []
                for i, (raw, lo) in enumerate(zip(b.column("words"), b.column("lo").to_pylist(), strict=True)):
                    h = np.frombuffer(raw.as_py(), np.uint64)
                    m, ph, first, last, _ = runs(h, WINDOW, FINE)
                    rows.append(np.full(len(m), i))
                    fine.append(m)
                    passage.append(ph)
                    start.append(first + lo)
                    words.extend(h[x : y + WINDOW].tobytes() for x, y in zip(first.tolist(), last.tolist(), strict=True))
                if words:
                    kept = b.select(["doc_id", "th", "m", "alone"]).take(pa.array(np.concatenate(rows)))
                    found = [pa.array(np.concatenate(fine).view(np.int64)), pa.array(np.concatenate(passage).view(np.int64)), pa.array(np.concatenate(start).astype(np.int32)), pa.array(words, pa.binary())]
                    yield pa.RecordBatch.from_arrays([*kept.columns, *found], names=[*kept.schema.names, "m2", "ph", "lo", "words"])

    kind = members.schema["doc_id"].dataType.simpleString()
    return members.select("doc_id", "th", "m", "alone", "lo", "words").mapInArrow(each, f"doc_id {kind}, th bigint, m bigint, alone boolean, m2 bigint, ph bigint, lo int, words binary")


def _sized(members: DataFrame, block: int) -> DataFrame:
    """The passages with k, how many parts of `block` passages theirs makes. Only blocks of several parts are joined, by a salt, so that none meets in one task."""
    large = members.groupBy("m").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = large.select("m", F.ceil(F.col("n") / block).cast("int").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("ph"), F.lit(SALTS)).cast("int"))
    return salted.join(large, ["m", "salt"], "left").drop("salt").withColumn("k", F.coalesce("k", F.lit(1)))


def _divided(members: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """The passages of large blocks as runs in smaller blocks, one of each text, and the spans that equal runs settle."""
    runs_ = common.written(_finer(members).withColumn("m", F.xxhash64("m", "m2")).drop("m2"), "finer")
    one = F.first(F.struct("doc_id", "th", "alone", "lo", "words")).alias("one")  # with n > 1 only its words count, and they are equal
    texts = common.written(runs_.groupBy("m", "ph").agg(F.count("*").alias("n"), one), "finer-texts")
    equal = runs_.where("alone").select("m", "ph", "doc_id", "th", "lo", (F.col("lo") + (F.length("words") / 8 - WINDOW).cast("int")).alias("hi"))
    equal = equal.join(texts.where("n > 1").select("m", "ph"), ["m", "ph"]).select("doc_id", "th", "lo", "hi")
    return texts.select("m", "ph", "one.doc_id", "one.th", (F.col("one.alone") & (F.col("n") == 1)).alias("alone"), "one.lo", "one.words"), equal


def _parse_blocks(groups: DataFrame) -> DataFrame:
    """Duplicate spans of the passages that are alone in their text, in each block."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes, los, his = [], [], [], []
            for group in b.column("block"):
                block = group.as_py()
                words = [np.frombuffer(x["words"], np.uint64) for x in block]
                windows = [gram_hashes(h, WINDOW) for h in words]
                index: dict[int, list[tuple[int, int]]] = {}
                for i, w in enumerate(windows):
                    for j, x in enumerate(w.tolist()):
                        seen = index.setdefault(x, [])
                        if len(seen) < 2:
                            seen.append((i, j))
                for i, x in enumerate(block):
                    if x["alone"]:
                        for a, z in factor(i, words, windows, index):
                            ids.append(x["doc_id"])
                            hashes.append(x["th"])
                            los.append(x["lo"] + a)
                            his.append(x["lo"] + z)
            kind = b.schema.field("block").type.value_type.field("doc_id").type
            columns = [pa.array(ids, kind), pa.array(hashes, pa.int64()), pa.array(los, pa.int32()), pa.array(his, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "lo", "hi"])

    kind = groups.schema["block"].dataType.elementType["doc_id"].dataType.simpleString()
    return groups.mapInArrow(each, f"doc_id {kind}, th bigint, lo int, hi int")


def _last_pass(opened: DataFrame, texts: bool) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw, spans, more in zip(b.column("open"), b.column("spans"), b.column("more"), strict=True):
                both = [*(spans.as_py() or ()), *(more.as_py() or ())]
                rows.append(_result(raw.as_py(), [(x["lo"], x["hi"]) for x in both], texts))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, k) for x, k in zip(columns, _RESULT_KINDS, strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    kind = opened.schema["doc_id"].dataType.simpleString()
    return opened.mapInArrow(each, f"doc_id {kind}, {_RESULT}")


def _same(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Joins by document: id (null-safe) and hash of the text. Rows that agree in both are one text, so they share spans."""
    b = b.withColumnsRenamed({"doc_id": "__id", "th": "__th"})
    return a.join(b, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), how).drop("__id", "__th")


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", texts: bool = True, block: int = BLOCK) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256 and, with texts, kept (the words left, one space between).

    Null and empty texts have no words. Repeated rows count as occurrences of each other. Documents
    of fewer words than a window lose none. Other columns are ignored, whatever their names.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("th", F.xxhash64("text"))
    lists = common.written(_runs_of(docs), "runs")
    each = lists.select("doc_id", "th", F.explode(F.arrays_zip("m", "ph", "lo", "hi", "again")).alias("r")).select("doc_id", "th", "r.*")
    counted = each.groupBy("m").agg(F.count("*").alias("n"), F.max("again").alias("any"), F.min("ph").alias("p"), F.max("ph").alias("q"))
    live = each.join(counted.where("n > 1 or any"), "m").drop("any")
    live = common.written(live.withColumn("same", F.expr("n > 1 and p = q")).drop("n", "p", "q", "again"), "live")

    mixed = live.where("not same")
    rep = F.min(F.struct("doc_id", "th", "lo", "hi")).alias("rep")
    # written, so that the join below has exchanges of its own on both sides and a hot passage can be split
    passages = common.written(mixed.groupBy("m", "ph").agg(F.count("*").alias("n"), rep), "passages")
    repeated = mixed.join(passages.where("n > 1").select("m", "ph"), ["m", "ph"]).select("doc_id", "th", "lo", "hi")
    spans = live.where("same").select("doc_id", "th", "lo", "hi").union(repeated).withColumn("w", F.lit(None).cast("struct<m:bigint,ph:bigint,alone:boolean,lo:int,hi:int>"))
    wanted = passages.select("rep.doc_id", "rep.th", F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"), F.struct("m", "ph", (F.col("n") == 1).alias("alone"), "rep.lo", "rep.hi").alias("w"))
    plan = spans.union(wanted).groupBy("doc_id", "th").agg(F.collect_list(F.when(F.col("w").isNull(), F.struct("lo", "hi"))).alias("spans"), F.collect_list("w").alias("wanted"))
    first = common.written(_first_pass(_same(docs, plan, "left"), texts), "first-pass")

    members = _sized(first.select("doc_id", "th", F.explode("passages").alias("x")).select("doc_id", "th", "x.*"), block)
    members = common.written(members, "members")
    fine, equal = _divided(members.where("k > 1"), block)
    columns = ["doc_id", "th", "m", "ph", "alone", "lo", "words", "k"]
    dealt = members.where("k = 1").select(columns).union(_sized(fine, block).select(columns)).withColumn("i", F.pmod(F.xxhash64("ph"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    blocks = dealt.groupBy("m", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.collect_list(F.struct("doc_id", "th", "alone", "lo", "words")).alias("block"))
    found = _parse_blocks(blocks.select("block")).union(equal).groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("more"))
    rest = _last_pass(_same(first.where("open is not null").select("doc_id", "th", "open", "spans"), found, "left"), texts)
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if texts else [])]
    return first.where("open is null").select(columns).union(rest.select(columns))
