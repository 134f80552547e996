"""Operators over whole tables: nothing is left out by an id, a depth or a rank."""

from __future__ import annotations

from itertools import accumulate

from conftest import rows
from pyspark.sql import functions as F

from chronofold.functions import values
from chronofold.operators import dlq, fold, graph, lineage
from chronofold.plans import queries

SF = "/root/testdata/sf0.001"


def test_history_is_one_fold_a_stream(spark):
    amounts = [(i * 37) % 101 - 50 for i in range(1000)]
    kinds = "k string, n bigint, amount bigint, headers map<string,string>"
    df = spark.createDataFrame([("a", i, x, {}) for i, x in enumerate(amounts)] + [(None, 0, 5, None)], kinds)
    got = fold.history(df.repartition(3), ["k"], "n", ["amount"], F.lit(0).cast("bigint"), lambda s, e: s + e["amount"])
    assert got.columns == [*df.columns, "state"]
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()  # no list of earlier events in each row
    want = [("a", i, s) for i, s in enumerate(accumulate(amounts))] + [(None, 0, 5)]
    assert rows(got.select("k", "n", "state")) == sorted(want, key=str)


def test_replay_has_every_event(spark):
    got = queries.replay_all_streams(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/events.parquet").count()
    assert rows(got) == rows(queries.step_by_step_replay(spark, SF))


def test_descendants_to_the_end(spark):
    edges = spark.createDataFrame([(f"e{i}", f"e{i + 1}") for i in range(110)] + [("x", "y"), ("y", "x")], "parent string, child string")
    got = lineage.descendants(spark, edges, spark.createDataFrame([("e0",), ("x",)], "id string"))
    assert rows(got) == sorted([("e0", f"e{i}", i) for i in range(1, 111)] + [("x", "y", 1)], key=str)


def test_chains_hold_every_caused_event(spark):
    got = queries.causation_chains(spark, SF)
    own = got.select(F.col("root").alias("id")).union(got.select("id")).distinct()
    alone = spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_id").cast("string").alias("id")).join(own, "id", "left_anti")
    caused = queries._caused(spark, SF)
    assert got.count() == got.select("id").distinct().count() == caused.where("causation_id is not null").count()
    assert alone.join(caused.where("causation_id is not null"), F.col("id") == F.col("event_id")).isEmpty()
    assert got.agg(F.max("steps")).first()[0] > 5


def test_value_functions_on_every_event(spark):
    assert queries.value_functions_all(spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()
    late = spark.createDataFrame([(1,), (9,), (10,), (61,), (5000,), (10**15,)], "n bigint").select(values.backoff_ms(F.col("n")).alias("ms"), values.backoff_ms(F.col("n"), multiplier=1.01).alias("slow"))
    assert [r["ms"] for r in late.collect()] == [100, 25600, 30000, 30000, 30000, 30000]
    assert [r["slow"] for r in late.collect()] == [100, 108, 109, 181, 30000, 30000]


def test_cycles_of_many_nodes(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 14) for i in range(14)], "src int, dst int")
    assert rows(graph.cycles(spark, ring)) == [(" -> ".join(map(str, range(14))), 14)]


def test_latest_messages_are_of_the_newest_pending(spark):
    kinds = "id string, projection_name string, error string, status string, seq bigint, at bigint"
    letters = [(f"i{i}", "p", f"m{i}", "pending" if i % 2 else "resolved", 1, i) for i in range(20)]
    df = spark.createDataFrame([*letters, ("j", "q", "only", "pending", 1, 3)], kinds).withColumn("last_failed_at", F.timestamp_seconds("at"))
    got = {r["projection_name"]: r["messages"] for r in dlq.latest_messages(df).collect()}
    assert got == {"p": ["m19", "m17", "m15", "m13", "m11"], "q": ["only"]}
