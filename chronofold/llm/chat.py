"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation, read by a deterministic parser:

    conversation = turn*
    turn = "[INST] " body " [/INST]"                           role user
         | "[OUT] " body " </s>"                               role assistant
         | "<<SYS>> " body " <</SYS>>"                         role system
         | "[ROLE] " body " [TEXT] " body " [/ROLE]"           any other role, named by the first body

A control string counts only without a backslash before it. A turn is rendered plainly and parsed
again; if what comes back is not the turn, control strings in its bodies get one backslash more,
until it is identical. The parser takes one backslash away again. Bodies are set off by spaces, so
nothing can form across a border.

Turns of a conversation come to one task, sorted, and pass through it one by one: a conversation of
any length needs the memory of one turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The control strings of the template, by role; "" stands for any other role.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>"), "system": ("<<SYS>>", "<</SYS>>"), "": ("[ROLE]", "[/ROLE]")}
BETWEEN = "[TEXT]"
#: Also escaped in texts, though the template has no use for it.
FOREIGN = ("<s>",)

_CONTROL = re.compile(r"(\\*)(" + "|".join(re.escape(x) for x in (*(m for pair in MARKS.values() for m in pair), BETWEEN, *FOREIGN)) + ")")
_OPENS = {pair[0]: role for role, pair in MARKS.items()}


def escape(body: str) -> str:
    """One backslash more before each control string."""
    return _CONTROL.sub(r"\\\1\2", body)


def unescape(body: str) -> str:
    return _CONTROL.sub(lambda m: m[1][1:] + m[2], body)


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Each turn's role and text, and where its body stands (code points). ValueError if it isn't of the grammar."""
    controls = ((m.start(), m.end(), m[2]) for m in _CONTROL.finditer(formatted) if not m[1])
    at = 0
    for start, end, mark in controls:
        if start != at or mark not in _OPENS:
            raise ValueError(f"a turn must start at {at}")
        role = _OPENS[mark]
        body, (stop, after, closing) = end + 1, next(controls, (0, 0, ""))
        if not role:
            if closing != BETWEEN:
                raise ValueError(f"no role's end after {end}")
            role, body = unescape(formatted[body : stop - 1]), after + 1
            if role and role in MARKS:
                raise ValueError(f"role {role!r} has a form of its own")
            stop, after, closing = next(controls, (0, 0, ""))
        if closing != MARKS.get(role, MARKS[""])[1] or stop - 1 < body or formatted[stop - 1] != " " or formatted[body - 1] != " ":
            raise ValueError(f"no turn's end after {end}")
        yield role, unescape(formatted[body : stop - 1]), body, stop - 1
        at = after
    if at != len(formatted):
        raise ValueError(f"a turn must start at {at}")


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and where its body stands, escaped as often as it takes to read the turn back."""
    opening, closing = MARKS.get(role, MARKS[""])
    name, body = role, text
    while True:
        head = f"{opening} " if role in MARKS and role else f"{opening} {name} {BETWEEN} "
        piece = f"{head}{body} {closing}"
        try:
            back = list(parse(piece))
        except ValueError:
            back = []
        if [x[:2] for x in back] == [(role, text)]:
            return piece, back[0][2], back[0][3]
        name, body = escape(name), escape(body)


def _sorted(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """A conversation's rows in one partition, by turn; ties by role, then text. Null roles and texts are empty."""
    got = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return got.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a turn, in order within its conversation: conv_id, position, piece, loss_start, loss_end.

    The pieces of a conversation, joined, are its formatted text; the loss mask is the code points
    from loss_start to loss_end of it (assistants' bodies; null for other roles). Null ids are one
    conversation, null turns come first, repeated rows are turns of their own.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, position, offset = (), 0, 0
        for b in batches:
            out: list[tuple] = []
            for conv, by, what in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now != (conv,):
                    now, position, offset = (conv,), 0, 0
                piece, start, end = render(by, what)
                out.append((conv, position, piece, *((offset + start, offset + end) if by == "assistant" else (None, None))))
                position, offset = position + 1, offset + len(piece)
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (b.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["conv_id", "position", "piece", "loss_start", "loss_end"])

    rows = _sorted(turns, conv_id, turn, role, text)
    return rows.mapInArrow(each, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, position bigint, piece string, loss_start bigint, loss_end bigint")


def read_back(pieces: DataFrame) -> DataFrame:
    """What parsing format_turns()' pieces gives back, one row a conversation, as digests.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. The pieces must come
    as format_turns() returns them (a conversation in one partition, in order).
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, offset, n, loss_chars = (), 0, 0, 0
        turns = loss = hashlib.sha256()
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kind = None

        def row() -> tuple:
            return (*now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), offset)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            kind, out = b.schema.field("conv_id").type, []
            for conv, piece, start, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end")), strict=True):
                if now != (conv,):
                    out += [row()] if now else []
                    now, offset, n, loss_chars, turns, loss = (conv,), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, text, _, _ in parse(piece):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                if start is not None:
                    masked = unescape(piece[start - offset : end - offset])
                    loss.update(masked.encode())
                    loss_chars += len(masked)
                offset += len(piece)
            if out:
                yield batch(out)
        if now:
            yield batch([row()])

    kind = pieces.schema["conv_id"].dataType.simpleString()
    return pieces.mapInArrow(each, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
