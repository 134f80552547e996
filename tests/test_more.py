from __future__ import annotations

import json

from conftest import rows
from pyspark.sql import functions as F

from chronofold import verify
from chronofold.operators import envelope, graph, lineage, readmodel, rebuild
from chronofold.operators import checkpoints as cp
from chronofold.sources import log as reading

SF = "/root/testdata/sf0.001"


def test_create_and_serialise(spark):
    df = spark.createDataFrame([("t", "a", 1, "x"), ("t", "a", 2, None)], "tenant_id string, aggregate_id string, i bigint, v string")
    e = envelope.create(df, F.lit("Made"), F.struct("v"), F.lit(5).cast("bigint"), "i")
    got = e.orderBy("i").collect()
    assert [r["aggregate_nonce"] for r in got] == [6, 7] and got[0]["event_id"] != got[1]["event_id"]
    assert json.loads(bytes(got[0]["payload"])) == {"v": "x"} and json.loads(bytes(got[1]["payload"])) == {}
    text = json.loads(envelope.to_json(e).where("json like '%\"v\":\"x\"%'").first()["json"])
    assert text["type"] == "Made" and text["metadata"]["tenant_id"] == "t" and text["data"] == {"v": "x"}


def test_decode_falls_back(spark):
    df = spark.createDataFrame([("A", '{"n": 1}'), ("A", '{"m": 1}'), ("B", '{"n": 2}'), ("A", "{")], "event_type string, payload string")
    got = envelope.decode(df, {"A": "n int"}).select("is_generic", "as_A.n", "fields")
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(["(False, 1, None)", "(True, None, {'m': '1'})", "(True, None, {'n': '2'})", "(True, None, {})"])


def test_rebuild_beside_and_swap(spark, root):
    log = reading.without_nonce(spark, SF)
    v = rebuild.Versioned(spark, root)
    assert v.current() is None
    v.swap(v.build(lambda df: df.groupBy("event_type").count(), log))
    before = rows(v.read())
    folder = v.build(lambda df: df.groupBy("tenant_id").count(), log)
    assert rows(v.read()) == before
    v.swap(folder)
    assert v.read().columns == ["tenant_id", "count"]


def test_reprocess(spark):
    log = spark.createDataFrame([("1", 5), ("2", -1), ("3", 7)], "event_id string, n int")
    pending = spark.createDataFrame([("1",), ("2",)], "event_id string")
    good, bad = rebuild.reprocess(pending, log, lambda e: e.withColumn("error", F.when(F.col("n") < 0, "negative")))
    assert rows(good) == [("1",)] and rows(bad) == [("2", "negative")]


def test_read_model_changes(spark):
    kind = "projection string, key string, data map<string,string>, seq bigint"
    changes = readmodel.save(spark.createDataFrame([], kind + ", deleted boolean"), spark.createDataFrame([("p", "abc-1", {"s": "b"}, 1), ("p", "abc-2", {"s": "a"}, 1), ("p", "xyz-1", {}, 1), ("q", "abc-1", {"s": "z"}, 1)], kind))
    now = readmodel.current(changes)
    assert readmodel.by_prefix(now, "p", "abc").count() == 2 and readmodel.get(now, "q", "abc-1").first()["data"] == {"s": "z"}
    p = now.where("projection = 'p'")
    assert [r["key"] for r in readmodel.query(p, order_by="s").collect()] == ["xyz-1", "abc-2", "abc-1"]
    assert [r["key"] for r in readmodel.query(p, order_by="-s", limit=1, offset=1).collect()] == ["abc-2"]
    assert [r["key"] for r in readmodel.query(p, {"s": None}).collect()] == ["xyz-1"]
    assert readmodel.current(readmodel.delete_all(changes, "p", 9)).count() == 1


def test_start_positions_and_gate(spark):
    log = reading.without_nonce(spark, SF)
    positions = spark.createDataFrame([("a", 990), ("b", 0)], "projection_name string, position bigint")
    types = spark.createDataFrame([("a", "view"), ("b", "purchase")], "projection_name string, event_type string")
    got = cp.pending(log, positions, types)
    assert got.where("projection_name = 'a' and (global_nonce <= 990 or event_type <> 'view')").isEmpty()
    assert got.where("projection_name = 'b'").count() == log.where("event_type = 'purchase'").count()
    assert cp.minimum(positions).first()["start"] == 0
    head = spark.createDataFrame([(995,)], "head bigint")
    assert rows(cp.advanced(positions, head)) == [("a", 995), ("b", 995)]


def test_lineage_and_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "parent string, child string")
    got = lineage.descendants(spark, edges, spark.createDataFrame([("a",)], "id string"), 2)
    assert rows(got.select("id", "steps")) == [("b", 1), ("c", 2)]
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("d", "d")], "src string, dst string")
    assert {r["cycle"] for r in graph.cycles(spark, links).collect()} == {"a -> b", "a -> b -> c", "d"}
    v = spark.createDataFrame([("E", "v2"), ("E", "v10"), ("E", "v2")], "name string, version string")
    assert [tuple(r) for r in graph.versions(v).collect()] == [("E", ["v10", "v2"], "v10")]


def test_scenario(spark):
    given = spark.createDataFrame([("a", 1), ("a", 2)], "k string, n int")
    then = spark.createDataFrame([("a", 3)], "k string, total bigint")
    assert verify.scenario(given, lambda df: df.groupBy("k").agg(F.sum("n").alias("total")), then, ["k"]).isEmpty()
    assert verify.replay_safe(lambda live: 5 if live else 0)
