from __future__ import annotations

import random

from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronofold import verify
from chronofold.operators import fold, upcast
from chronofold.plans import projections

BANK = projections.Accounts()


def log(spark, events):
    """events: (stream, type, amount) in global order."""
    seen: dict[str, int] = {}
    out = []
    for i, (a, kind, amount) in enumerate(events, 1):
        seen[a] = seen.get(a, 0) + 1
        out.append(("t", a, seen[a], i, kind, amount, i * 1000))
    return spark.createDataFrame(out, "tenant_id string, aggregate_id string, aggregate_nonce bigint, global_nonce bigint, event_type string, amount bigint, timestamp_unix_ms bigint")


DEMO = [("a1", "AccountOpened", 100000), ("a2", "AccountOpened", 500000), ("a1", "MoneyDeposited", 50000), ("a1", "MoneyWithdrawn", 20000), ("a2", "MoneyDeposited", 100000), ("a2", "AccountClosed", 0)]


def test_bank_demo(spark):
    got = projections.account_summary(log(spark, DEMO), BANK).select("aggregate_id", "balance", "transactions", "status")
    assert rows(got) == [("a1", 130000, 2, "Open"), ("a2", 600000, 1, "Closed")]
    got = projections.transaction_history(log(spark, DEMO), BANK).where("aggregate_id = 'a1'").orderBy("global_nonce").select("type", "balance_after")
    assert [tuple(r) for r in got.collect()] == [("deposit", 150000), ("withdrawal", 130000)]


def plain(events):
    state, history = {}, []
    for i, (a, kind, amount) in enumerate(events, 1):
        if kind == "AccountOpened":
            state[a] = [amount, 0, "Open"]
        elif a in state and kind in ("MoneyDeposited", "MoneyWithdrawn"):
            state[a][0] += amount if kind == "MoneyDeposited" else -amount
            state[a][1] += 1
        elif a in state and kind == "AccountClosed":
            state[a][2] = "Closed"
    base = {}
    for i, (a, kind, amount) in enumerate(events, 1):
        if kind == "AccountOpened":
            base[a] = amount
        elif kind in ("MoneyDeposited", "MoneyWithdrawn"):
            base[a] = base.get(a, 0) + (amount if kind == "MoneyDeposited" else -amount)
            history.append((a, i, base[a]))
    return sorted((a, *s) for a, s in state.items()), sorted(history)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.sampled_from([*BANK.types, "Other"]), st.integers(0, 1000)), min_size=1, max_size=30))
def test_account_folds_equal_a_loop(spark, events):
    df = log(spark, events)
    summary, history = plain(events)
    assert rows(projections.account_summary(df, BANK).select("aggregate_id", "balance", "transactions", "status")) == sorted(summary, key=str)
    assert rows(projections.transaction_history(df, BANK).select("aggregate_id", "global_nonce", "balance_after")) == sorted(history, key=str)


def test_clamped_counter_equals_a_loop(spark):
    rnd = random.Random(5)
    steps = [rnd.choice([1, -1, -1, 2]) for _ in range(200)]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(steps)], "k int, global_nonce bigint, c bigint")
    n, want = 0, []
    for s in steps:
        n = max(0, n + s)
        want.append(n)
    for stretch in (1_000_000, 16, 1):
        got = fold.clamped_count(df, ["k"], F.col("c"), stretch=stretch).orderBy("global_nonce").collect()
        assert [r["clamped"] for r in got] == want


def test_general_fold_history_and_determinism(spark):
    df = log(spark, DEMO)
    step = fold.dispatch({"AccountOpened": lambda s, e: e["amount"], "MoneyDeposited": lambda s, e: s + e["amount"], "MoneyWithdrawn": lambda s, e: s - e["amount"]})
    args = (["aggregate_id"], "aggregate_nonce", ["event_type", "amount"], F.lit(0).cast("bigint"), step)
    assert rows(fold.fold(df, *args)) == [("a1", 130000, 3), ("a2", 600000, 3)]
    assert rows(fold.fold(df, *args, up_to=2)) == [("a1", 150000, 2), ("a2", 600000, 2)]
    steps = fold.history(df, *args).select("aggregate_id", "aggregate_nonce", "state")
    assert rows(steps)[:3] == [("a1", 1, 100000), ("a1", 2, 150000), ("a1", 3, 130000)]
    assert verify.deterministic(lambda x: projections.account_summary(x, BANK), df)
    assert verify.rebuilds(lambda x: projections.account_summary(x, BANK), df, projections.account_summary(df, BANK))
    bad = fold.violations(df, F.sum("amount").over(fold.by_stream(["aggregate_id"])), F.col("state") < 600000, ["aggregate_id"])
    assert {r["aggregate_id"] for r in bad.collect()} == {"a2"}


def test_machine_refuses(spark):
    df = log(spark, [("o", "OrderCreated", 0), ("o", "OrderShipped", 0), ("o", "OrderConfirmed", 0), ("o", "OrderShipped", 0), ("o", "OrderCancelled", 0)])
    assert rows(projections.states(df, projections.ORDER).select("state")) == [("SHIPPED",)]
    assert rows(projections.refused(df, projections.ORDER).select("aggregate_nonce", "event_type")) == [(2, "OrderShipped"), (5, "OrderCancelled")]


def test_upcasters(spark):
    df = spark.createDataFrame([("A", 1, {"x": "1"}), ("A", 2, {"x": "2", "y": "7"}), ("B", 1, {"x": "3"})], "event_type string, event_version int, payload map<string,string>")
    chain = [upcast.Upcaster("A", 2, upcast.with_fields(z=lambda p: p["y"])), upcast.Upcaster("A", 1, upcast.with_fields(y=F.lit("new")))]
    got = sorted((r["event_version"], r["payload"]["x"], r["payload"].get("y"), r["payload"].get("z")) for r in upcast.upcast(df, chain).collect())
    assert got == [(1, "3", None, None), (3, "1", "new", "new"), (3, "2", "7", "7")]
    assert upcast.missing(chain, {"A": 4}) == [("A", 3)] and chain[0].is_incremental


def test_differences(spark):
    a = spark.createDataFrame([(1, "x", 2), (2, "y", 3)], "id int, s string, n int")
    b = spark.createDataFrame([(1, "x", 5)], "id int, s string, n int")
    assert rows(verify.differences(a, b, ["id"])) == [(1, "n", "2", "5"), (2, "n", "3", None), (2, "s", "y", None)]
    assert verify.purity("import os.path\nfrom requests import get\nimport json") == ["os.path", "requests"]
