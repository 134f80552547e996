"""Byte-level BPE: encoding by a lazily determinised finite-state transducer, streaming decoding.

Encoding. A token sequence is the BPE encoding of its bytes exactly if each adjacent pair of it is
the encoding of that pair's bytes. So each prefix of a word has one last token: the one among the
tokens that end there which fits the last token of the prefix before it. The merges are compiled to

- an automaton over bytes whose states are the beginnings of vocabulary entries; a state knows the
  longest such beginning that the input ends in, and with it all tokens that end there. It is
  determinised lazily: a transition is computed when first taken.
- registers: the last token of each position that a vocabulary entry can still reach back to, a
  number bounded by the longest entry.

Tokens go out when all open positions have them in common, which is a few bytes later: the bounded
lookahead. Time is linear in the text, also for a word of a million letters. Whether two tokens fit
is found from their merges next to the seam, when first asked, and kept.

Words that come often are kept as a whole (their output from the start state), in a bounded table.

Decoding. Ids become bytes by a table; a state machine over UTF-8 lead and continuation bytes holds
back an unfinished character at a chunk's end, so chunks may cut anywhere.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.llm import common

#: Bounds on what a Python worker keeps: checked pairs, whole words. States are bounded by the vocabulary.
MAX_PAIRS, MAX_WORDS = 1_000_000, 150_000
#: Positions after which a long word's settled tokens go out.
WINDOW = 1024
#: Ids that the streaming decoder takes at once.
CHUNK = 1 << 16


class Transducer:
    """Encodes single words (matches of the pattern) by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.beginnings = {b[:k] for b in ranks for k in range(len(b) + 1)}
        self.state_of: dict[bytes, int] = {b"": 0}
        self.beginning = [b""]
        self.length = {i: len(b) for b, i in ranks.items()}
        #: By token: whether it can follow another; -1 is a word's start.
        self.after: dict[int, dict[int, bool]] = {}
        self.asked = 0
        #: By state: the tokens that end there, longest first, with minus their lengths and what they can follow.
        self.ends: list[list[tuple[int, int, dict[int, bool]]]] = [[]]
        #: (state, byte) -> state, as state * 256 + byte.
        self.moves: dict[int, int] = {}
        self.seams: dict[tuple[int, bool], list[tuple[bytes, int, float]]] = {}

    def move(self, state: int, byte: int) -> int:
        """Computes and keeps a transition."""
        w = self.beginning[state] + bytes((byte,))
        while w not in self.beginnings:
            w = w[1:]
        to = self.state_of.get(w)
        if to is None:
            to = self.state_of[w] = len(self.beginning)
            self.beginning.append(w)
            tokens = [(self.ranks[w[i:]], i - len(w)) for i in range(len(w)) if w[i:] in self.ranks]
            self.ends.append([(t, back, self.after.setdefault(t, {})) for t, back in tokens])
        self.moves[state << 8 | byte] = to
        return to

    def merged(self, word: bytes, at_right: bool | None = None) -> tuple[list[bytes], list[tuple[bytes, int]]]:
        """BPE by definition: merge the pair of lowest rank, leftmost first. Returns the parts that remain.

        With them, the parts that stood at the word's end (at_right) or start, each with the time
        from which it did: the highest rank merged so far, -1 at first.
        """
        parts, ranks, time = [word[i : i + 1] for i in range(len(word))], self.ranks, -1
        edge = -1 if at_right else 0
        seam = [(parts[edge], time)]
        while len(parts) > 1:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            time = max(time, rank)
            if parts[edge] != seam[-1][0]:
                seam.append((parts[edge], time))
        return parts, seam

    def seam(self, token: int, at_right: bool) -> list[tuple[bytes, int, float]]:
        """The parts of a token at one of its ends with the times from and until which they are there; empty if BPE never makes it."""
        found = self.seams.get((token, at_right))
        if found is None:
            parts, seam = self.merged(self.bytes_of[token], at_right)
            until = [t for _, t in seam[1:]] + [float("inf")]
            found = [(b, t, u) for (b, t), u in zip(seam, until, strict=True)] if len(parts) == 1 else []
            self.seams[token, at_right] = found
        return found

    def fits(self, a: int, b: int) -> bool:
        """Whether BPE leaves a b apart: no merge across the seam comes before those inside."""
        self.asked += 1
        if self.asked > MAX_PAIRS:
            self.asked = 1
            for seen in self.after.values():
                seen.clear()
        found = bool(self.seam(b, False))
        if a >= 0 and found:
            left, right = self.seam(a, True), self.seam(b, False)
            found, i, j = bool(left), 0, 0
            while found and i < len(left) and j < len(right):
                (x, since_x, until_x), (y, since_y, until_y) = left[i], right[j]
                rank = self.ranks.get(x + y)
                # of equal ranks the leftmost is merged first: inside a, then across, then inside b
                if rank is not None and max(since_x, since_y, rank) < until_x and max(since_x, since_y, rank) <= until_y:
                    found = False
                i, j = (i + 1, j) if until_x <= until_y else (i, j + 1)
        self.after.setdefault(b, {})[a] = found
        return found

    def encode(self, word: bytes) -> tuple[int, ...]:
        moves, ends, settled = self.moves.get, self.ends, []
        state, last = 0, [-1]  # by position: its last token
        add = last.append
        for byte in word:
            to = moves(state << 8 | byte)
            state = self.move(state, byte) if to is None else to
            for token, back, seen in ends[state]:
                before = last[back]
                fits = seen.get(before)
                if self.fits(before, token) if fits is None else fits:
                    add(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            if len(last) > WINDOW:
                cut = self.settled(state, last)
                settled += self.chain(last, cut)
                last = last[cut:]
                add = last.append
        return (*settled, *self.chain(last, len(last) - 1))

    def settled(self, state: int, last: list[int]) -> int:
        """The last position that the ways of all open positions have in common."""
        end, w = len(last) - 1, self.beginning[state]
        way: set[int] | None = None
        for at in (end, *(end - len(w) + i for i in range(len(w)) if w[i:] in self.beginnings)):
            own = {at}
            while at:
                at -= self.length[last[at]]
                own.add(at)
            way = own if way is None else way & own
        return max(way or {0})

    def chain(self, last: list[int], at: int) -> list[int]:
        """The tokens on the way to a position."""
        out, length = [], self.length
        while at:
            out.append(last[at])
            at -= length[last[at]]
        return out[::-1]


class Utf8Decoder:
    """Decodes UTF-8 in chunks that may end inside a character."""

    #: For the five upper bits of a byte: length of the character that it starts; 0 for one that goes on.
    LENGTH = (1,) * 16 + (0,) * 8 + (2,) * 4 + (3,) * 2 + (4, 1)

    def __init__(self, errors: str = "replace") -> None:
        self.held, self.errors = b"", errors

    def feed(self, chunk: bytes) -> str:
        data = self.held + chunk
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            length = self.LENGTH[data[-back] >> 3]
            if length:
                cut -= back if length > back else 0
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", self.errors)

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", self.errors)


class Tokenizer:
    """Splits by a pattern and encodes each match; decodes ids. Special tokens are ordinary text."""

    def __init__(self, file: bytes, pattern: str) -> None:
        pairs = [line.split() for line in file.splitlines() if line]
        ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.transducer, self.split = Transducer(ranks), regex.compile(pattern).findall
        size = max(ranks.values()) + 1
        self.bytes_of = [b""] * size
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.digits = [str(i) for i in range(size)]
        #: Words of late and those of before, each up to MAX_WORDS: what is used stays.
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, add = self.words.get, out.extend
        for w in self.split(text):
            ids = known(w)
            if ids is None:
                ids = self.older.get(w) or self.transducer.encode(w.encode())
                if len(w) <= 32:
                    if len(self.words) >= MAX_WORDS:
                        self.words, self.older = {}, self.words
                        known = self.words.get
                    self.words[w] = ids
            add(ids)
        return out

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        ids, state, table = list(ids), Utf8Decoder(), self.bytes_of.__getitem__
        for i in range(0, len(ids), CHUNK):
            yield state.feed(b"".join(map(table, ids[i : i + CHUNK])))
        yield state.finish()

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))

    def ids_digest(self, ids: list[int]) -> str:
        """SHA-256 of the decimal ids, one space between."""
        h, digits = hashlib.sha256(), self.digits.__getitem__
        for i in range(0, len(ids), CHUNK):
            h.update((" " * (i > 0) + " ".join(map(digits, ids[i : i + CHUNK]))).encode())
        return h.hexdigest()

    def decoded_digest(self, ids: list[int]) -> str:
        h = hashlib.sha256()
        for part in self.decode_stream(ids):
            h.update(part.encode())
        return h.hexdigest()


@lru_cache(1)
def tokenizer(file: bytes, pattern: str) -> Tokenizer:
    """One a Python worker, kept from task to task."""
    return Tokenizer(file, pattern)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str | None = "ids") -> DataFrame:
    """The rows without their text, with its tokens: n_tokens, ids_sha256, decoded_sha256 and, if named, the ids.

    vocabulary: path of a file of ranks, on the driver; its contents (one file, a fixed size) are
    broadcast. The text is read back from the ids: decoded_sha256 is of the decoded bytes. A null
    text is empty: 0 tokens. Every input row gives one row; other columns stay, so they must not be
    called like a new one.
    """
    rest = [f for f in docs.schema.fields if f.name != text]
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    new += [T.StructField(ids, T.ArrayType(T.IntegerType(), False))] if ids else []
    if clash := {f.name for f in rest} & {f.name for f in new}:
        raise ValueError(f"columns named like new ones: {sorted(clash)}")
    file = docs.sparkSession.sparkContext.broadcast(_read(vocabulary))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(file.value, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):  # bounds the ids held at once
                b = batch.slice(i, 1024)
                n, ids_digest, decoded, all_ids = [], [], [], []
                for x in b.column(text):
                    found = t.encode(x.as_py() or "")
                    n.append(len(found))
                    ids_digest.append(t.ids_digest(found))
                    decoded.append(t.decoded_digest(found))
                    if ids:
                        all_ids.append(np.array(found, np.int32))
                columns = [pa.array(n, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(decoded, pa.string())]
                columns += [pa.array(all_ids, pa.list_(pa.int32()))] if ids else []
                yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in rest), *columns], names=[f.name for f in [*rest, *new]])

    return docs.select(*(F.col(f"`{f.name}`") for f in rest), F.col(f"`{text}`")).mapInArrow(each, T.StructType([*rest, *new]))


def decode(tokens: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """The rows with the text of their ids in place of the ids. Null ids give an empty text; malformed bytes U+FFFD."""
    rest = [f for f in tokens.schema.fields if f.name != ids]
    file = tokens.sparkSession.sparkContext.broadcast(_read(vocabulary))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(file.value, pattern)
        for b in batches:
            texts = pa.array([t.decode(x.as_py() or ()) for x in b.column(ids)], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in rest), texts], names=[*(f.name for f in rest), text])

    return tokens.mapInArrow(each, T.StructType([*rest, T.StructField(text, T.StringType())]))
