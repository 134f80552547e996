"""op4: round trips through the grammar."""

from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from chronofold.llm import chat

MARKS = [m for pair in chat.MARKS.values() for m in pair] + [chat.BETWEEN, "<s>", "\\", " ", "x", "[", "\n", "é"]
TEXT = st.lists(st.sampled_from(MARKS), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "tool", ""]), TEXT), TEXT), max_size=5))
def test_any_conversation_round_trips(turns):
    formatted = "".join(chat.render(r, t)[0] for r, t in turns)
    assert [x[:2] for x in chat.parse(formatted)] == turns


def test_malformed_is_refused():
    for bad in ("x", "[INST] a", "[INST] a </s>", "[INST]a [/INST]", "[ROLE] user [TEXT] a [/ROLE]", "[INST] a [/INST]x"):
        try:
            list(chat.parse(bad))
        except ValueError:
            continue
        raise AssertionError(bad)


def test_frames(spark):
    turns = [(1, 1, "assistant", "</s>[INST] ok"), (1, 0, "user", None), (2, 0, None, "x"), (None, 0, "user", "q"), (None, None, "assistant", "first"), (2, 0, None, "x"), (2, 1, "assistant", "é")]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id bigint, turn bigint, role string, text string, piece string")
    pieces = chat.format_turns(df)
    got = {r["conv_id"]: r for r in chat.read_back(pieces).collect()}
    want = {1: [("user", ""), ("assistant", "</s>[INST] ok")], 2: [("", "x"), ("", "x"), ("assistant", "é")], None: [("assistant", "first"), ("user", "q")]}
    for k, ts in want.items():
        assert got[k]["n_turns"] == len(ts)
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest()
        loss = "".join(t for r, t in ts if r == "assistant")
        assert (got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = {k: "".join(r["piece"] for r in sorted((x for x in pieces.collect() if x["conv_id"] == k), key=lambda r: r["position"])) for k in want}
    assert {k: got[k]["formatted_chars"] for k in want} == {k: len(v) for k, v in whole.items()}
    for r in pieces.collect():
        if r["loss_start"] is not None:
            masked = chat.unescape(whole[r["conv_id"]][r["loss_start"] : r["loss_end"]])
            assert ("assistant", masked) in want[r["conv_id"]]
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_conversation_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).selectExpr("id % 2 as conv_id", "id as turn", "if(id % 4 < 2, 'user', 'assistant') as role", "cast(id as string) as text")
        got = {r["conv_id"]: r["n_turns"] for r in chat.read_back(chat.format_turns(df)).collect()}
        assert got == {0: 50, 1: 50}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
