"""Language ID: nearest centroid over normalised TF-IDF n-gram vectors.

A text's letters, lower-cased, with one space for each run of other characters (and one at either
end), give character n-grams of 2 and 3, hashed to DIM buckets. A vector has (1 + log tf) * idf of
each bucket, with length 1. Each language has a few centroids, from spherical k-means over its
training vectors. A text goes to the language of the centroid of largest cosine; of equal ones the
first by language. It is rejected if it has no letter, or lies farther from that centroid, by a
margin, than training texts of its length do: all whole ones, and most pieces. Short texts lie far
from every centroid, and so do words repeated over and over. So the reach is learned for each power
of two of the number of different n-grams, from all pieces of every length that the texts are cut into.

Fitting takes every labelled text: frequencies, each round of k-means and the reach are sums over
all of them. The sums are of integers, so they don't depend on how rows are dealt out. The driver gets
sums and histograms, whose size is fixed by the number of languages, and of each language one row for
each centroid. Prediction runs over whole texts, in strips that share their border, so memory stays
bounded and no n-gram is lost.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from chronofold.llm import common

#: Buckets of n-grams (a power of two); centroids of a language; rounds of k-means at most.
DIM, CENTROIDS, ROUNDS = 4096, 3, 12
#: Characters of a text that are turned to n-grams at once.
STRIP = 1 << 20
#: Characters of a text whose pieces are cut at once (a power of two); rows of counts that are weighed at once.
BLOCK, SLICE = 1 << 15, 256
#: Characters, with what fills up texts to powers of two, that are sorted at once (2**17 at most); characters of texts that are cut together.
PLACES, TOGETHER = 1 << 16, 1 << 21
#: Pieces from this power of two on are counted by sorting; of shorter ones, each different one is looked at once.
SHORT = 3
#: Weights are summed as integers, in parts of 1; a product of two is exact in float64.
UNIT = 1 << 26
#: What a text may lie farther (1 - cosine) from its centroid than training texts of its length; the share of pieces that counts.
MARGIN, SHARE = 0.1, 0.99
#: Powers of two that the number of different n-grams can have.
CLASSES = DIM.bit_length() + 1
#: Steps of the histogram of distances, which go from 0 to 1.
STEPS = 1000
#: Numbers of a task's sums that make one row.
WIDE = 32
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _squeezed(text: str) -> Iterator[np.ndarray]:
    """Strips of the text's letters, lower-cased, with one space for each run of others between and after them."""
    text, letter, before = text.lower(), _letters(), False
    for i in range(0, len(text), STRIP):
        raw = np.frombuffer(text[i : i + STRIP].encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letter[raw]
        follows = np.concatenate([[before], is_letter[:-1]])
        new, before = np.where(is_letter, raw, np.uint32(32))[is_letter | follows], bool(is_letter[-1])
        yield np.append(new, np.uint32(32)) if before and i + STRIP >= len(text) else new


def _two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)


def _three(two: np.ndarray, c: np.ndarray) -> np.ndarray:
    return two * np.uint32(0xC2B2AE3D) + c * np.uint32(0x27D4EB2F) + np.uint32(1)


def _bucket(gram: np.ndarray) -> np.ndarray:
    return (gram * np.uint32(0x165667B1) >> np.uint32(33 - DIM.bit_length())).view(np.int32)


def _buckets(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of 2 and of 3 that begin at each character."""
    two = _two(a[:-1], a[1:])
    return _bucket(two), _bucket(_three(two[:-1], a[2:]))


def counts(text: str) -> np.ndarray | None:
    """How often each bucket's n-grams occur; None without a letter."""
    total, tail = np.zeros(DIM, np.int64), np.array([32], np.uint32)
    for new in _squeezed(text):
        # the last two characters are carried over; n-grams that end in them are counted
        a = np.concatenate([tail, new])
        two, three = _buckets(a)
        for grams in (two[len(two) - len(new) :], three):
            total += np.bincount(grams, minlength=DIM)
        tail = a[-2:]
    return total if total.any() else None


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of counts as TF-IDF of length 1."""
    v = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0).astype(np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _vector(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A row of counts as TF-IDF of length 1."""
    v, at = np.zeros(DIM, np.float32), np.flatnonzero(tf)
    v[at] = (1 + np.log(tf[at])).astype(np.float32) * idf[at]
    return v / max(np.linalg.norm(v), 1e-12)


def _length_class(tf: np.ndarray) -> int:
    return int(np.count_nonzero(tf)).bit_length()


@lru_cache(1)
def _logs() -> np.ndarray:
    """1 + log of how often an n-gram can occur in a block, and 0 of 0."""
    return np.append(0.0, 1 + np.log(np.arange(1, 2 * BLOCK + 4)))


@lru_cache(1)
def _twos(block: int) -> np.ndarray:
    """How often 2 divides each place of a block, and of two more; 31 for the first place, which every size begins at."""
    n = np.arange(block + 3)
    return np.array([31, *((n[1:] & -n[1:]).astype(np.float64).view(np.int64) >> 52) - 1023])


def _columns(pieces: np.ndarray) -> list[np.ndarray]:
    """Buckets of all n-grams of rows of so many characters, in columns; DIM where there is none.

    A piece has one space at either end, its own or one more; one that is a space itself has no n-gram.
    """
    x, space = list(np.ascontiguousarray(pieces.T)), np.array([32], np.uint32)
    two = [_two(a, b) for a, b in zip(x[:-1], x[1:], strict=True)]
    found = [_bucket(g) for g in two] + [_bucket(_three(g, c)) for g, c in zip(two[:-1], x[2:], strict=True)]
    begun = _two(space, x[0])
    before = [begun, _three(begun, x[1] if len(x) > 1 else space)]
    after = [_two(x[-1], space), *(_three(g, space) for g in two[-1:])]
    found += [np.where(x[0] == 32, np.int32(DIM), _bucket(g)) for g in before]
    return found + [np.where(x[-1] == 32, np.int32(DIM), _bucket(g)) for g in after]


def _different(pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of up to four characters, and how often each occurs."""
    code, width = pieces, 21
    if pieces.shape[1] == 4:
        there = np.unique(pieces)
        if len(there) > 1 << 16:
            return pieces, np.ones(len(pieces), np.int64)
        number = np.zeros(int(there[-1]) + 1, np.uint32)
        number[there] = np.arange(len(there))
        code, width = number.take(pieces), 16
    one = np.zeros(len(pieces), np.uint64)
    for x in code.T:
        one = one << np.uint64(width) | x
    one, n = np.unique(one, return_counts=True)
    code = np.stack([one >> np.uint64(width * i) & np.uint64((1 << width) - 1) for i in reversed(range(pieces.shape[1]))], axis=1)
    return (there.take(code) if width == 16 else code.astype(np.uint32)), n


class _Pieces:
    """Counts how far pieces of texts of one language lie from the nearest of its centroids, into n by class, whole (1) or not (0), and step.

    An n-gram that a piece has t times weighs 1 + log t. Sums along the text weigh it t, for all sizes at once;
    what remains is to set right those that a piece has more than once. Weights are in whole UNITs, so sums are
    exact and a piece counts the same, whatever is beside it.
    """

    def __init__(self, own: np.ndarray, idf: np.ndarray, n: np.ndarray) -> None:
        idf = idf.astype(np.float64)
        self.weights, self.n = np.zeros((len(own) + 1, DIM + 1)), n  # of each centroid, and of the square of the length
        self.weights[:-1, :-1], self.weights[-1, :-1] = np.rint(own * idf * UNIT), np.rint(idf * idf * UNIT)
        self.logs = [_logs()] * len(own) + [_logs() ** 2]
        self.texts: dict[tuple[int, int, bool], list[np.ndarray]] = {}
        self.short: dict[tuple[int, int], list[np.ndarray]] = {}
        self.size = 0

    def add(self, x: np.ndarray, width: int, sizes: int, whole: bool) -> None:
        """Characters, 2**width at most, that are cut by so many sizes: 1, 2, 4, ...; whole also counts all of them as a text."""
        self.texts.setdefault((width, sizes, whole), []).append(x)
        self.size += len(x)
        if self.size >= TOGETHER:
            self.flush()

    def flush(self) -> None:
        for (width, sizes, whole), texts in self.texts.items():
            some = max(1, PLACES >> width)
            for i in range(0, len(texts), some):
                self._cut(texts[i : i + some], width, sizes, whole)
        for (_, whole), pieces in self.short.items():
            different, times = _different(np.concatenate(pieces))
            for i in range(0, len(times), BLOCK):
                self._short(different[i : i + BLOCK], times[i : i + BLOCK], whole)
        self.texts, self.short, self.size = {}, {}, 0

    def _count(self, sums: list[np.ndarray], grams: np.ndarray, whole: int, times: np.ndarray | None = None) -> None:
        """Counts pieces by their sums for each centroid and for the length, and the number of their different n-grams."""
        at = np.flatnonzero(grams)
        dot = np.maximum.reduce([x[at] for x in sums[:-1]])
        step = _step(1 - dot / UNIT / np.sqrt(sums[-1][at] / UNIT))
        kind = _CLASS[grams[at]] * (STEPS + 1) + step
        n = np.bincount(kind, None if times is None else times[at], CLASSES * (STEPS + 1))
        self.n[:, whole] += n.astype(np.int64).reshape(CLASSES, -1)

    def _short(self, pieces: np.ndarray, times: np.ndarray, whole: int) -> None:
        columns = _columns(pieces)
        grams, sums = np.zeros(len(pieces), np.int64), [np.zeros(len(pieces)) for _ in self.weights]
        for i, x in enumerate(columns):
            first, tf = x < DIM, np.zeros(len(x), np.int64)
            for j, y in enumerate(columns):
                tf += (same := x == y)
                if j < i:
                    first &= ~same
            grams += first
            for weights, total, log in zip(self.weights, sums, self.logs, strict=True):
                total += np.rint(weights.take(x) * log.take(tf)) * first
        self._count(sums, grams, whole, times)

    def _cut(self, texts: list[np.ndarray], width: int, sizes: int, whole: bool) -> None:
        x, long = np.concatenate(texts), np.array([len(t) for t in texts])
        begin = np.cumsum(long) - long
        off = np.arange(len(x)) - np.repeat(begin, long)
        left = np.repeat(long, long) - off  # characters from here on
        for k in range(min(sizes, SHORT)):
            self._shorter(x, off, left, 1 << k, 0)
        powers = [(k, 0) for k in range(SHORT, sizes)]
        if whole and (1 << width) > 1 << (SHORT - 1):
            powers.append((width, 1))
        elif whole:
            self._shorter(x, off, left, 1 << width, 1)
        if not powers:
            return
        # buckets of the n-grams from each character on; after the last ones of a text they mean nothing
        last, space = left == 1, np.array([32], np.uint32)
        follows = np.append(x[1:], space)
        follows[last] = 32
        two, begun = _two(x, follows), _two(space, x)
        inner, inner3 = _bucket(two), _bucket(_three(two, np.append(follows[1:], space)))
        before, before3 = _bucket(begun), _bucket(_three(begun, follows))
        after, after3 = _bucket(_two(x, space)), _bucket(_three(np.append(begun[:1], two[:-1]), space))
        # each n-gram with the sizes that it counts for, from one power of two to another; 31 is none
        twos, place = _twos(BLOCK), (np.repeat(np.arange(len(texts)), long) << width | off) << 10
        ends, letter = twos.take(off + 1), x != 32
        first = np.flatnonzero(letter & (off & ((1 << SHORT) - 1) == 0))
        end = np.flatnonzero(letter & ((ends >= SHORT) | last))
        end3 = end[off[end] > 0]
        until, since = np.where(last, 31, ends), np.where(last, twos.take(off) + 1, 0)
        found = [inner.astype(np.int64) << 27 | place | np.where(last, 31, ends + 1) << 5 | 31]
        found.append(inner3.astype(np.int64) << 27 | place | np.where(left < 3, 31, np.maximum(ends, twos.take(off + 2)) + 1) << 5 | 31)
        for bucket, at, sizes_of in (
            (before, first, twos.take(off[first])),
            (before3, first, twos.take(off[first])),
            (after, end, until[end]),
            (after3, end3, since[end3] << 5 | until[end3]),
        ):
            found.append(bucket[at].astype(np.int64) << 27 | place[at] | sizes_of)
        keys = np.concatenate(found)
        keys.sort()
        since, until = (keys >> 5 & 31).astype(np.int8), (keys & 31).astype(np.int8)
        keys = (keys >> 10).astype(np.int32)  # bucket << 17 | place
        along = []
        for weights in self.weights:
            along.append(np.zeros(len(x) + 1))
            np.cumsum(weights.take(inner) + weights.take(inner3), out=along[-1][1:])
        first = np.flatnonzero(off & ((1 << SHORT) - 1) == 0)
        for k, kind in powers:
            first = first[off[first] & ((1 << k) - 1) == 0]
            self._sized(k, kind, x, first, place[first] >> (10 + k), along, (inner, before, before3, after, after3), keys[(since <= k) & (until >= k)])

    def _shorter(self, x: np.ndarray, off: np.ndarray, left: np.ndarray, n: int, whole: int) -> None:
        """Keeps the pieces of n characters, and the shorter last ones, for flush."""
        if n == 1:
            self.short.setdefault((1, whole), []).append(x[:, None])
            return
        begin = np.flatnonzero(off & (n - 1) == 0)
        size = np.minimum(left[begin], n)
        for m in range(1, n + 1):
            if len(at := begin[size == m]):
                self.short.setdefault((m, whole), []).append(x[at[:, None] + np.arange(m)])

    def _sized(self, k: int, whole: int, x: np.ndarray, first: np.ndarray, piece: np.ndarray, along: list[np.ndarray], buckets: tuple, keys: np.ndarray) -> None:
        """Counts pieces of 2**k characters, which begin at first: keys are bucket << 17 | place of their n-grams, in order."""
        inner, before, before3, after, after3 = buckets
        last = np.append(first[1:], len(x)) - 1
        size = last - first
        opens, closes = x[first] != 32, x[last] != 32
        closes3, back = closes & (size > 0), np.maximum(last - 1, first)
        grams = size + np.maximum(size - 1, 0) + 2 * opens + closes + closes3
        # n-grams that a piece has more than once, and how often
        keys >>= k
        again = np.flatnonzero(keys[1:] == keys[:-1])
        new = np.ones(len(again), bool)
        np.not_equal(again[1:], again[:-1] + 1, out=new[1:])
        start = np.flatnonzero(new)
        times = np.append(start[1:], len(again))[: len(start)] - start + 1
        key = keys.take(again.take(start))
        bucket, of = key >> (17 - k), key & ((1 << (17 - k)) - 1)
        most, sums = int(piece[-1]) + 1, []
        grams = grams - np.bincount(of, times - 1, most)[piece].astype(np.int64)
        for weights, total, log in zip(self.weights, along, self.logs, strict=True):
            got = total[back] - total[first] + weights.take(inner[back]) * (size > 0)
            got += (weights.take(before[first]) + weights.take(before3[first])) * opens
            got += weights.take(after[last]) * closes + weights.take(after3[last]) * closes3
            more = np.rint(weights.take(bucket) * (log.take(times) - times))
            sums.append(got + np.bincount(of, more, most)[piece])
        self._count(sums, grams, whole)


@dataclass(frozen=True)
class Model:
    """centroids: rows of length 1. langs: the language of each. reach: how far texts may lie, by log2 of their different n-grams.

    Its size is fixed by the number of languages.
    """

    idf: np.ndarray
    centroids: np.ndarray
    langs: tuple[str, ...]
    reach: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine, and whether the text is rejected."""
        tf = counts(text or "")
        if tf is None or not self.langs:
            return UNKNOWN, 0.0, True
        cosine = self.centroids @ _vector(tf, self.idf)
        best = int(cosine.argmax())
        score = float(min(1.0, max(0.0, cosine[best])))
        return self.langs[best], score, bool(1 - score > self.reach[_length_class(tf)])

    def distances(self, text: str, lang: str, n: np.ndarray) -> None:
        """Counts how far the text (1) and its pieces (0) lie from the nearest centroid of its language, by class and step.

        The pieces are consecutive ones of 1, 2, 4, ... letters and spaces between them, the last of each
        length being what is left, as long as that cuts the text. Texts over STRIP are cut strip by strip.
        """
        self.spread([text], lang, n)

    def spread(self, texts: Iterable[str], lang: str, n: np.ndarray) -> None:
        """As distances, of texts of one language."""
        own = self.centroids[[x == lang for x in self.langs]]
        pieces = _Pieces(own, self.idf, n)

        def add(tf: np.ndarray, whole: int) -> None:
            far = 1 - float((own @ _vector(tf, self.idf)).max())
            n[_length_class(tf), whole, _step(far)] += 1

        for text in texts:
            short = len(text) <= BLOCK and len(text.lower()) < min(BLOCK, STRIP)  # in one block with the space after it
            if not short and (tf := counts(text)) is not None:
                add(tf, 1)
            for x in _squeezed(text):
                sizes = (len(x) - 1).bit_length() if len(x) else 0
                if short:
                    if len(x):
                        pieces.add(x, sizes, sizes, True)
                    continue
                for i in range(0, len(x), BLOCK):
                    pieces.add(x[i : i + BLOCK], BLOCK.bit_length() - 1, min(sizes, BLOCK.bit_length()), False)
                for size in (1 << k for k in range(BLOCK.bit_length(), sizes)):
                    for i in range(0, len(x), size):
                        a = x[i : i + size]
                        two, three = _buckets(np.concatenate([[32] * int(a[0] != 32), a, [32] * int(a[-1] != 32)]).astype(np.uint32))
                        if len(two):
                            add(np.bincount(two, minlength=DIM) + np.bincount(three, minlength=DIM), 0)
        pieces.flush()


def _step(far: np.ndarray | float) -> np.ndarray:
    return np.ceil(np.clip(far, 0.0, 1.0) * STEPS).astype(np.int64)


#: The class of each number of different n-grams.
_CLASS = np.array([i.bit_length() for i in range(DIM + 1)])


def _packed(tf: np.ndarray) -> bytes:
    """A row of counts, in the shortest integers that hold them."""
    return tf.astype(np.min_scalar_type(int(tf.max()))).tobytes()


def _unpacked(tf: bytes) -> np.ndarray:
    return np.frombuffer(tf, f"u{len(tf) // DIM}")


@lru_cache(1)
def _few() -> np.ndarray:
    """1 + log of counts up to 255, and 0 of 0."""
    return np.append(0.0, 1 + np.log(np.arange(1, 256)))


@dataclass(frozen=True)
class _Rows:
    """Training rows: the language of each, where it begins in what follows, the buckets that it has, in order, and how often."""

    lang: np.ndarray
    begin: np.ndarray
    at: np.ndarray
    n: np.ndarray

    def each(self, of_rows: np.ndarray) -> np.ndarray:
        """A value of each row, for each of its buckets."""
        return np.repeat(of_rows, np.diff(self.begin, append=len(self.at)))

    def dense(self, i: int) -> np.ndarray:
        tf, part = np.zeros(DIM, np.int64), slice(self.begin[i], self.begin[i + 1] if i + 1 < len(self.begin) else None)
        tf[self.at[part]] = self.n[part]
        return tf


def _weights(rows: _Rows, idf: np.ndarray) -> np.ndarray:
    """Counts as TF-IDF of length 1, in whole UNITs."""
    v = _few().take(np.minimum(rows.n, 255))
    if len(many := np.flatnonzero(rows.n > 255)):
        v[many] = 1 + np.log(rows.n[many].astype(np.float64))
    v *= idf.take(rows.at)
    v *= rows.each(UNIT / np.sqrt(np.add.reduceat(v * v, rows.begin)))
    return np.rint(v, out=v)


def _cosines(rows: _Rows, v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosine of each row with its language's centroids c[., lang], all in whole UNITs: exact, so whatever is beside a row."""
    at = rows.each(rows.lang * DIM) + rows.at
    return np.stack([np.add.reduceat(v * x.reshape(-1).take(at), rows.begin) for x in c])


def _frequencies(rows: _Rows) -> np.ndarray:
    """In how many rows each bucket occurs."""
    return np.bincount(rows.at, minlength=DIM)


def _moved(rows: _Rows, idf: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Sums of the rows that are nearest to each centroid, the first of equal ones, in UNITs."""
    v = _weights(rows, idf)
    own = _cosines(rows, v, c).argmax(axis=0) if len(c) > 1 else 0
    return np.bincount(rows.each((own * c.shape[1] + rows.lang) * DIM) + rows.at, v, c.size).astype(np.int64)


def _nearness(rows: _Rows, idf: np.ndarray, c: np.ndarray, sign: int) -> np.ndarray:
    """Each row's cosine with the nearest of the centroids, times the sign."""
    return sign * _cosines(rows, _weights(rows, idf), c).max(axis=0)


def _least(slices: Iterator[_Rows], f: Callable, args: tuple) -> dict[int, tuple[float, bytes]]:
    """Of each language the row with the least f, of equal ones the first by its counts."""
    best = {}
    for rows in slices:
        of = f(rows, *args)
        for x in set(rows.lang.tolist()):
            low = of[rows.lang == x].min()
            here = min((float(low), _packed(rows.dense(i))) for i in np.flatnonzero((rows.lang == x) & (of == low)))
            best[x] = min(best.get(x, here), here)
    return best


#: Columns of a table of training rows: buckets in 2 bytes, counts in 1, and in 8 those that 255 stands for.
_TRAINING = "lang string, at binary, n binary, many binary"


def _thin(tf: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """A row of counts as at, n and many."""
    at = np.flatnonzero(tf)
    n = tf[at]
    return at.astype(np.uint16).tobytes(), np.minimum(n, 255).astype(np.uint8).tobytes(), n[n >= 255].astype(np.int64).tobytes()


def _rows(part: pa.RecordBatch, numbers: dict[str, int]) -> _Rows:
    """Rows of such a table."""
    at, n, many = (part.column(x).to_pylist() for x in ("at", "n", "many"))
    long, n = np.array([len(x) for x in n]), np.frombuffer(b"".join(n), np.uint8).astype(np.int64)
    n[n == 255] = np.frombuffer(b"".join(many), np.int64)
    lang = np.array([numbers[x] for x in part.column("lang").to_pylist()], np.int64)
    return _Rows(lang, np.cumsum(long) - long, np.frombuffer(b"".join(at), np.uint16).astype(np.int64), n)


def _wide(n: np.ndarray) -> pa.RecordBatch:
    """Sums as rows of WIDE numbers, without the rows that are all 0."""
    n = np.pad(n.reshape(-1), (0, -n.size % WIDE)).reshape(-1, WIDE)
    block = np.flatnonzero(n.any(axis=1))
    columns = [pa.array(block), *(pa.array(x) for x in np.ascontiguousarray(n[block].T))]
    return pa.RecordBatch.from_arrays(columns, names=["block", *(f"n{i}" for i in range(WIDE))])


def _summed(rows: DataFrame, each: Callable, size: int) -> np.ndarray:
    """The sum of what each(batches) gives for every task: so many whole numbers, which are sent on as _wide."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _wide(each(batches))

    names, n = [f"n{i}" for i in range(WIDE)], np.zeros(size + -size % WIDE, np.int64)
    got = rows.mapInArrow(one, ", ".join(f"{x} bigint" for x in ["block", *names]))
    got = got.groupBy("block").agg(*(F.sum(x).alias(x) for x in names)).toArrow()
    n.reshape(-1, WIDE)[got["block"].to_numpy()] = np.stack([got[x].to_numpy() for x in names], axis=1)
    return n[:size]


class _Array:
    """Training rows in memory: numbers of languages, and counts."""

    def __init__(self, lang: np.ndarray, tf: np.ndarray) -> None:
        self.slices = []
        for i in range(0, len(tf), SLICE):
            row, at = np.nonzero(part := tf[i : i + SLICE])
            self.slices.append(_Rows(lang[i : i + SLICE], np.searchsorted(row, np.arange(len(part))), at, part[row, at]))

    def total(self, size: int, f: Callable, *args) -> np.ndarray:
        return sum((f(x, *args) for x in self.slices), np.zeros(size, np.int64))

    def least(self, f: Callable, *args) -> dict[int, np.ndarray]:
        return {x: _unpacked(tf) for x, (_, tf) in _least(iter(self.slices), f, args).items()}


class _Table:
    """Training rows in a table of _TRAINING."""

    def __init__(self, rows: DataFrame, langs: list[str]) -> None:
        self.rows, self.numbers = rows, {x: i for i, x in enumerate(langs)}

    def _run(self, f: Callable, args: tuple, then: Callable[[Callable], object]) -> object:
        """What then makes of a function from batches to f(slices, args)."""
        numbers, shared = self.numbers, self.rows.sparkSession.sparkContext.broadcast(args)

        def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[_Rows]:
            for b in batches:
                yield from (_rows(b.slice(i, SLICE), numbers) for i in range(0, len(b), SLICE))

        got = then(lambda batches: f(slices(batches), shared.value))
        shared.destroy()
        return got

    def total(self, size: int, f: Callable, *args) -> np.ndarray:
        def each(slices: Iterator, args: tuple) -> np.ndarray:
            n = np.zeros(size, np.int64)
            for x in slices:
                n += f(x, *args)
            return n

        return self._run(each, args, lambda of: _summed(self.rows, of, size))

    def least(self, f: Callable, *args) -> dict[int, np.ndarray]:
        def each(slices: Iterator, args: tuple) -> Iterator[pa.RecordBatch]:
            got = [(x, score, tf) for x, (score, tf) in _least(slices, f, args).items()]
            columns = zip(zip(*got, strict=True), (pa.int32(), pa.float64(), pa.binary()), strict=True) if got else ()
            if columns := [pa.array(x, t) for x, t in columns]:
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "score", "tf"])

        # one row a language
        got = self._run(each, args, lambda of: self.rows.mapInArrow(of, "lang int, score double, tf binary").groupBy("lang").agg(F.min(F.struct("score", "tf")).alias("best")).collect())
        return {r["lang"]: _unpacked(bytes(r["best"]["tf"])) for r in got}


def _learned(rows: _Array | _Table, sizes: dict[str, int], k: int) -> Model:
    """A model of all rows, of which each language has so many, with a reach of anything.

    Spherical k-means by language: started from the row nearest to the mean and from rows far from those
    chosen; deterministic. It ends when no centroid moves, after ROUNDS at most.
    """
    langs = sorted(sizes)
    if not langs:
        return Model(np.ones(DIM, np.float32), np.zeros((0, DIM), np.float32), (), np.full(CLASSES, 2.0))
    idf = (np.log((1 + sum(sizes.values())) / (1 + rows.total(DIM, _frequencies))) + 1).astype(np.float32)

    def whole(c: np.ndarray) -> np.ndarray:
        return np.rint(c.astype(np.float64) * UNIT)

    def moved(c: np.ndarray) -> np.ndarray:
        total = rows.total(c.size, _moved, idf, whole(c)).reshape(c.shape).astype(np.float64)
        return np.where(total.any(axis=2, keepdims=True), total / np.maximum(np.linalg.norm(total, axis=2, keepdims=True), 1e-12), c).astype(np.float32)

    mean = moved(np.zeros((1, len(langs), DIM), np.float32))
    c = np.zeros((k, len(langs), DIM), np.float32)  # one of zeros is never nearer than one before it
    for j in range(k):
        found = rows.least(_nearness, idf, *((whole(c[:j]), 1) if j else (whole(mean), -1)))
        for x, tf in found.items():
            if j < sizes[langs[x]]:
                c[j, x] = vectors(tf[None].astype(np.int64), idf)[0]
    for _ in range(ROUNDS):
        before, c = c, moved(c)
        if (before == c).all():
            break
    own = [(x, j) for x, lang in enumerate(langs) for j in range(min(k, sizes[lang]))]
    return Model(idf, np.stack([c[j, x] for x, j in own]), tuple(langs[x] for x, _ in own), np.full(CLASSES, 2.0))


def train(tf: np.ndarray, langs: list[str], k: int = CENTROIDS) -> Model:
    """A model of rows of counts and their languages, with a reach of anything."""
    sizes = {x: langs.count(x) for x in sorted(set(langs))}
    numbers = {x: i for i, x in enumerate(sizes)}
    return _learned(_Array(np.array([numbers[x] for x in langs], np.int64), tf), sizes, k)


def reach(n: np.ndarray) -> np.ndarray:
    """Reach by class of counted distances: the farthest whole text, or what SHARE of the pieces keep within, and the margin.

    A shorter text may always lie as far as a longer one. A class longer than all that was seen has the
    reach of the longest seen.
    """
    seen = np.flatnonzero(n.any(axis=(1, 2)))
    if not len(seen):
        return np.full(CLASSES, 2.0)
    far = np.zeros(CLASSES)
    for c in seen:
        for whole, share in ((0, SHARE), (1, 1.0)):
            total = n[c, whole].cumsum()
            if total[-1]:
                far[c] = max(far[c], np.searchsorted(total, share * total[-1]) / STEPS)
    far[seen[-1] + 1 :] = far[seen[-1]]
    return np.maximum.accumulate(far[::-1])[::-1] + MARGIN


def _with_counts(docs: DataFrame) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), SLICE):
                part = b.slice(i, SLICE)
                got = [(lang, *_thin(tf)) for lang, x in zip(part.column("lang"), part.column("text"), strict=True) if (tf := counts(x.as_py())) is not None]
                if got:
                    types = (part.schema.field("lang").type, pa.binary(), pa.binary(), pa.binary())
                    columns = [pa.array(x, t) for x, t in zip(zip(*((lang.as_py(), *y) for lang, *y in got), strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "at", "n", "many"])

    return docs.select("lang", "text").mapInArrow(each, _TRAINING)


def _distances(docs: DataFrame, model: Model) -> np.ndarray:
    """What Model.distances counts, over all rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        n = np.zeros((CLASSES, 2, STEPS + 1), np.int64)
        for b in batches:
            langs = b.column("lang").to_pylist()
            for x in set(langs):
                shared.value.spread((b.column("text")[i].as_py() for i, y in enumerate(langs) if x == y), x, n)
        return n

    n = _summed(docs.select("lang", "text"), each, CLASSES * 2 * (STEPS + 1))
    shared.destroy()
    return n.reshape(CLASSES, 2, STEPS + 1)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", k: int = CENTROIDS) -> Model:
    """Learns from all labelled rows.

    Rows without a language, without a text or without a letter teach nothing; repeated texts of a
    language count once. Texts whose hash comes once are left where they are; only others meet. Counts are written, as
    each round reads them; the labelled rows are read four times. No labelled row at all gives a model
    that rejects everything. Languages are taken to be few (hundreds).
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    rows = rows.withColumn("h", F.xxhash64("text"))
    again = common.written(rows.groupBy("lang", "h").count().where("count > 1").select("lang", "h"), "again")
    texts = rows.join(again, ["lang", "h"], "left_anti").select("lang", "text")
    texts = texts.union(rows.join(again, ["lang", "h"], "left_semi").select("lang", "text").distinct())
    near = common.written(_with_counts(texts), "training")
    sizes = {r["lang"]: r["count"] for r in near.groupBy("lang").count().collect()}  # one row a language
    model = _learned(_Table(near, sorted(sizes)), sizes, k)
    if sizes:
        model = Model(model.idf, model.centroids, model.langs, reach(_distances(texts, model)))
    for x in (near, again):
        common.drop_written(x)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 by 3. A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def guess(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """Struct of lang_pred, score and rejected of a text. Only the text is sent to Python, nothing of it comes back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def each(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for batch in texts:
            got = list(zip(*(m.predict(x.as_py()) for x in batch), strict=True)) or [()] * 3
            columns = [pa.array(x, t) for x, t in zip(got, (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.StructArray.from_arrays(columns, names=["lang_pred", "score", "rejected"])

    return each(F.col(text))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows with lang_pred, score and rejected, which must be new names; no column but the text is looked at."""
    new = ("lang_pred", "score", "rejected")
    if clash := set(new) & set(docs.columns):
        raise ValueError(f"columns named like new ones: {sorted(clash)}")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    got = docs.select(whole.alias("row"), guess(docs, model, text).alias("guess"))
    return got.select("row.*", *(F.col(f"guess.{c}").alias(c) for c in new))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of each document, learning from those not held out.

    lang_pred is und for a null or empty text and for one without a letter; otherwise a learned
    language, also where the text is rejected for its distance. Very long texts are read in strips.
    Repeated rows are documents of their own and get the same guess. Ties of centroids go to the first
    language. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    model = fit(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    got = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), guess(docs, model).alias("guess"))
    return got.select("doc_id", "held_out", "guess.lang_pred", "guess.score", "guess.rejected")


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, in their columns, whatever these are called."""
    model = fit(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    return docs.where(~guess(docs, model)["rejected"])
