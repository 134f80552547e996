from __future__ import annotations

import time
from datetime import UTC, datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from chronofold import verify
from chronofold.functions import text, values
from chronofold.operators import dlq, graph, health, metrics, rules
from chronofold.operators.checkpoints import Checkpoint, merged
from chronofold.plans import projections
from chronofold.sources import files
from chronofold.sources import log as reading
from chronofold.streaming import runtime

SF = "/root/testdata/sf0.001"


def test_checkpoint_values(spark):
    c = Checkpoint("p").advance_to(5)
    assert c.global_position == 5
    for bad in (lambda: Checkpoint(""), lambda: Checkpoint("p", -1), lambda: c.advance_to(4)):
        with pytest.raises(ValueError):
            bad()
    kind = "projection_name string, global_position bigint, updated_at timestamp, version int"
    old = spark.createDataFrame([("a", 5, None, 1), ("b", 9, None, 1)], kind)
    new = spark.createDataFrame([("a", 3, None, 1), ("b", 2, None, 2)], kind)
    assert rows(merged(old, new).select("projection_name", "version", "global_position")) == [("a", 1, 5), ("b", 2, 2)]


def test_health_boundaries(spark):
    cases = [(0, 0, 0, "healthy"), (99, 0, 0, "healthy"), (100, 0, 0, "degraded"), (999, 0, 0, "degraded"), (1000, 0, 0, "unhealthy"), (0, 1, 0, "unhealthy"), (1, 0, 60000, "healthy"), (1, 0, 60001, "degraded"), (0, 0, 60001, "healthy")]
    df = spark.createDataFrame(cases, "lag bigint, failed bigint, age bigint, want string")
    assert df.where(health.status(F.col("lag"), F.col("failed"), F.col("age")) != F.col("want")).isEmpty()
    assert [r[0] for r in spark.createDataFrame([(99,), (100,), (1000,)], "lag bigint").select(health.check(F.col("lag"))).collect()] == ["pass", "warn", "fail"]


def test_retry_policy():
    p = dlq.RetryPolicy()
    assert [p.delay_ms(i) for i in (1, 2, 3, 10)] == [100, 200, 400, 30000]
    assert [p.should_retry(i) for i in range(4)] == [True, True, True, False]
    assert p.is_transient("Connection refused") and not p.is_transient("bad value")
    assert p.is_transient("connect ECONNRESET") and p.is_transient("socket hang up") and not p.is_transient("rate limit")
    assert dlq.RetryPolicy(patterns=("bad",)).is_transient("Bad value") and not dlq.RetryPolicy(patterns=("b.d",)).is_transient("Bad value")
    assert dlq.RetryPolicy(patterns=()).is_transient("timeout")


def test_dead_letters(spark):
    kind = "id string, projection_name string, error string, status string, ignore_reason string, seq bigint, last_failed_at timestamp"
    df = spark.createDataFrame([("1", "p", "x", "pending", None, 1, datetime(2024, 1, 1)), ("2", "p", "y", "pending", None, 1, datetime(2024, 1, 2))], kind)
    df = dlq.mark(df, spark.createDataFrame([("1",)], "id string"), dlq.IGNORED, 2, "known")
    assert rows(dlq.counts(df).select("pending", "total")) == [(1, 2)]
    assert [r["id"] for r in dlq.listing(df, "p", limit=1).collect()] == ["2"]
    assert dlq.purge(df, F.lit(datetime(2024, 2, 1))).select("id").distinct().count() == 1


def test_histogram_and_gauges(spark):
    df = spark.createDataFrame([("h", 0.05), ("h", 0.3), ("h", 0.7)], "name string, value double")
    h = metrics.histogram(df, F.col("value"), ["name"], (0.1, 0.5, 1.0))
    assert [(r["le"], r["cumulative"]) for r in h.orderBy(F.col("le").asc_nulls_last()).collect()] == [(0.1, 1), (0.5, 2), (1.0, 3), (None, 3)]
    assert abs(metrics.quantile(h, 0.5, ["name"]).first()["quantile"] - 0.3) < 1e-9
    g = spark.createDataFrame([("g", {"a": "1"}, 5.0, 1, "set"), ("g", {"a": "1"}, 2.0, 2, "add"), ("g", {"a": "1"}, 1.0, 0, "add")], "name string, labels map<string,string>, value double, seq bigint, kind string")
    assert metrics.gauges(g).first()["value"] == 7.0


def test_functions(spark):
    df = spark.createDataFrame([("Order-9-a", "OrderPlacedV2", "00-" + "a" * 32 + "-" + "b" * 16 + "-01", "v12"), ("plain", "HTTPError", "00-" + "0" * 32 + "-" + "b" * 16 + "-01", "2.1.0")], "s string, e string, t string, v string")
    got = df.select(text.stream_type(F.col("s")), text.stream_id(F.col("s")), text.pascal_to_snake(F.col("e")), text.traceparent(F.col("t"))["sampled"], text.version_number(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [("Order", "9-a", "order_placed_v2", True, 12), ("plain", "plain", "http_error", None, 2)]
    assert df.select(text.snake_to_pascal(F.lit("order_placed"))).first()[0] == "OrderPlaced"
    assert df.select(F.lit("src/a/b.ts").rlike(text.glob("src/**/*.ts")), F.lit("src/a/b.ts").rlike(text.glob("src/*.ts"))).first()[:] == (True, False)
    assert df.limit(1).select(text.template("Order {s} is {v}", s=F.col("s"), v=F.col("v"))).first()[0] == "Order Order-9-a is v12"
    one = spark.sql("select named_struct('a', 1, 'b', array(1,2,3), 'c', named_struct('d', 'x')) s")
    assert one.select(values.matches_partially(F.col("s"), {"a": 1, "b": [1, 2], "c": {"d": "x"}}), values.matches_partially(F.col("s"), {"b": [2]})).first()[:] == (True, False)


def _log_files(spark, root, n=3):
    """A log as a committer writes it: one file after the other, in global order."""
    log = reading.from_events(spark, SF).cache()
    for i in range(n):
        part = log.where((F.col("global_nonce") > 1000 * i / n) & (F.col("global_nonce") <= 1000 * (i + 1) / n))
        part.coalesce(1).sortWithinPartitions("global_nonce").write.mode("append").parquet(f"{root}/log")
    return spark.read.parquet(f"{root}/log")


def test_coordinator_batch_and_stream_agree(spark, root):
    log = _log_files(spark, root)
    seen = {"batch": [], "stream": []}

    def projection(where):
        return runtime.Projection("counts", lambda df, _: seen[where].extend((r[0], r[1]) for r in df.groupBy("event_type").count().collect()), ["purchase", "error"])

    batch, stream = runtime.Coordinator(spark, f"{root}/b", [projection("batch")]), runtime.Coordinator(spark, f"{root}/s", [projection("stream")])
    batch.run_table(log)
    live = runtime.subscribe(spark, f"{root}/log", log.schema, 1)
    stream.run_stream(live, f"{root}/checkpoint").awaitTermination()

    def total(where):
        out = {}
        for k, n in seen[where]:
            out[k] = out.get(k, 0) + n
        return out

    assert total("batch") == total("stream") and len(seen["stream"]) > 2
    assert batch.status()[0]["position"] == stream.status()[0]["position"] == reading.head(log)
    n = len(seen["stream"])
    stream.run_stream(live, f"{root}/checkpoint").awaitTermination()
    assert len(seen["stream"]) == n


def test_a_killed_stream_goes_on_where_it_was(spark, root):
    """Dies after a batch was handled, before it was recorded; a new coordinator gets to the same table as one batch."""
    log = _log_files(spark, root)
    out, starts = f"{root}/out", []

    def handle(df, context):
        df.groupBy("event_type").count().write.mode("overwrite").parquet(f"{out}/batch={context.batch_id}")
        if context.batch_id == 1 and len(starts) == 1:
            raise KeyError("killed")

    def coordinator():
        starts.append(1)
        return runtime.Coordinator(spark, f"{root}/state", [runtime.Projection("counts", handle)], on_failure="block")

    live = runtime.subscribe(spark, f"{root}/log", log.schema, 1)
    with pytest.raises(Exception, match="killed"):
        coordinator().run_stream(live, f"{root}/checkpoint").awaitTermination()
    assert coordinator().position("counts") > 0
    coordinator().run_stream(live, f"{root}/checkpoint").awaitTermination()
    assert rows(spark.read.parquet(out).groupBy("event_type").agg(F.sum("count"))) == rows(log.groupBy("event_type").count())

    tries = []

    def stumbles(df, context):
        tries.append(context.batch_id)
        if len(tries) in (1, 2, 4):
            raise KeyError("killed")

    slept = []
    c = runtime.Coordinator(spark, f"{root}/again", [runtime.Projection("p", stumbles)], on_failure="block", sleep=slept.append)
    assert c.stay(live, f"{root}/checkpoint2") == 3 and c.position("p") == reading.head(log)
    assert slept == [0.1, 0.2, 0.1]


def test_streaming_daily_sales_equals_batch(spark, root):
    log = _log_files(spark, root)
    live = runtime.daily_sales(runtime.subscribe(spark, f"{root}/log", log.schema), "purchase")
    live.writeStream.outputMode("complete").format("memory").queryName("sales").trigger(availableNow=True).option("checkpointLocation", f"{root}/c").start().awaitTermination()
    got = spark.table("sales").select(F.date_format("day.start", "yyyy-MM-dd"), "revenue", "sales")
    assert rows(got) == rows(projections.daily_sales(log, "purchase").select("day", "revenue", "sales"))


def test_boundary_and_process_managers(spark, root):
    log = reading.from_events(spark, SF)
    acted, parts = [], []

    def build():
        manager = runtime.ProcessManager("m", lambda df: df.where("event_type = 'signup'").select(F.col("global_nonce").cast("string").alias("key")), lambda item: acted.append(item["key"]), spark, f"{root}/managers")
        p = runtime.Projection("p", lambda df, context: parts.append((context.live, df.count())))
        return manager, runtime.Coordinator(spark, f"{root}/state", [p], [manager], boundary=500)

    manager, c = build()
    c.run_batch(log.where("global_nonce <= 400"), 0)
    assert not acted and parts == [(False, 400)]
    manager, c = build()  # restarted
    c.run_batch(log.where("global_nonce > 400"), 1)  # across the boundary: in two parts
    assert parts[1:] == [(False, 100), (True, 500)]
    want = sorted(str(r[0]) for r in log.where("event_type = 'signup'").select("global_nonce").collect())
    assert sorted(acted) == want and verify.idempotent(manager.process_pending)
    manager, c = build()  # restarted again: nothing is acted on twice, no batch handled twice
    c.run_batch(log.where("global_nonce > 400"), 1)
    assert manager.process_pending() == 0 and sorted(acted) == want and len(parts) == 3
    assert c.start() == 1001


def test_rebuild_replays_one_projection(spark, root):
    log = reading.from_events(spark, SF)
    calls, cleared = [], []
    both = [runtime.Projection(n, lambda df, _, n=n: calls.append((n, df.count())), clear=lambda n=n: cleared.append(n)) for n in "pq"]
    c = runtime.Coordinator(spark, root, both)
    c.run_table(log.where("global_nonce <= 600"))
    c.run_table(log)
    assert calls == [("p", 600), ("q", 600), ("p", 400), ("q", 400)]
    c.rebuild("p")
    assert cleared == ["p"] and c.position("p") == 0 and c.start() == 0
    c.run_table(log)
    assert calls[4:] == [("p", 1000)] and c.position("p") == 1000
    changed = runtime.Coordinator(spark, root, [runtime.Projection("q", both[1].handle, version=2, clear=both[1].clear)])
    changed.run_table(log)
    assert cleared == ["p", "q"] and calls[5:] == [("q", 1000)]
    assert rows(changed.checkpoints().select("projection_name", "global_position", "version")) == [("p", 1000, 1), ("q", 1000, 2)]


def test_outcomes_and_dead_letters(spark, root):
    log = reading.from_events(spark, SF)
    slept, tries = [], []

    def outcomes(df, _):
        tries.append(df.count())
        bad = F.when(F.col("event_type") == "error", "FAILURE").when(F.col("event_type") == "click", "RETRY").when(F.col("event_type") == "view", "SKIP").otherwise("SUCCESS")
        return df.select("event_id", bad.alias("result"), F.when(F.col("event_type") == "error", "bad payload").otherwise("later").alias("error"))

    def poisoned(df, _):
        if not df.where("global_nonce in (7, 600)").isEmpty():
            raise ValueError("x" * 900 + " poison")

    c = runtime.Coordinator(spark, root, [runtime.Projection("p", outcomes), runtime.Projection("q", poisoned)], sleep=slept.append)
    odd = log.where("global_nonce = 5").withColumn("event_id", F.lit(None).cast("string"))
    c.run_batch(log.where("global_nonce <> 5").unionByName(odd), 0)
    n = {r[0]: r[1] for r in log.where("global_nonce <> 5").groupBy("event_type").count().collect()}
    letters = c.dead_letters()
    assert letters.where("projection_name = 'p' and error = 'bad payload' and attempts = 1").count() == n["error"]
    assert letters.where("projection_name = 'p' and error = 'later' and attempts = 3").count() == n["click"]
    assert tries == [999, n["click"], n["click"]] and slept == [0.1, 0.2]
    assert rows(letters.where("projection_name = 'q'").select("global_nonce", F.length("error"))) == [(600, 907), (7, 907)]
    assert rows(letters.where("projection_name = '*'").select("global_nonce", "error")) == [(5, "malformed event")]
    assert [s["failed"] for s in c.status()] == [n["error"] + n["click"], 2] and [s["position"] for s in c.status()] == [1000, 1000]

    def hangs_up_once(df, _):
        tries.append("t")
        if tries.count("t") == 1:
            raise OSError("socket hang up")

    again = runtime.Coordinator(spark, f"{root}/2", [runtime.Projection("r", hangs_up_once)], sleep=slept.append)
    again.run_table(log)
    assert again.dead_letters().count() == 0 and slept[2:] == [0.1]
    blocked = runtime.Coordinator(spark, f"{root}/3", [runtime.Projection("q", poisoned)], on_failure="block")
    with pytest.raises(ValueError):
        blocked.run_table(log)
    assert blocked.position("q") == 0
    with pytest.raises(ValueError):
        runtime.Coordinator(spark, f"{root}/4", [runtime.Projection("p", poisoned), runtime.Projection("p", poisoned)])


def test_projection_manager_and_keep_alive(spark, root):
    seen = []

    def fails(df, _):
        raise ValueError("no")

    m = runtime.ProjectionManager([runtime.Projection("a", fails), runtime.Projection("b", lambda df, _: seen.append(df.count()), ["purchase"])])
    log = reading.from_events(spark, SF)
    assert m.run(log) == {"a": ["no"]} and seen == [log.where("event_type = 'purchase'").count()]

    told = []
    alive = runtime.KeepAlive(lambda: told.append("live"), lambda: told.append("beat"))
    files_ = _log_files(spark, root, 1)
    spark.streams.addListener(alive)
    q = runtime.subscribe(spark, f"{root}/log", files_.schema).writeStream.foreachBatch(lambda *_: None).option("checkpointLocation", f"{root}/ka").trigger(processingTime="200 milliseconds").start()
    deadline = time.time() + 60
    while alive.beats < 1 and time.time() < deadline:
        time.sleep(0.2)
    q.stop()
    spark.streams.removeListener(alive)
    assert told[0] == "live" and told.count("live") == 1 and "beat" in told


def test_poller_cold_and_warm():
    start, handled = datetime(2024, 1, 1, tzinfo=UTC), []
    events = [{"created_at": datetime(2023, 1, 1, tzinfo=UTC)}, {"created_at": datetime(2024, 1, 2, tzinfo=UTC)}]
    p = files.Poller(lambda s, c: (events, files.Cursor("2")), lambda e, replay: handled.append((len(e), replay)), start)
    assert p.poll("s") == 1 and p.poll("s") == 2
    assert handled == [(1, True), (2, False)]


def test_fixtures_and_rules(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"description": "d", "aggregateType": "Order", "events": [{"type": "Opened", "version": "v1", "data": {"n": "1"}}], "tags": ["x"]}')
    (tmp_path / "b.json").write_text('{"description": "e", "aggregateType": "Order", "events": []}')
    assert files.fixtures(spark, str(tmp_path)).count() == 2
    assert rows(files.fixture_log(files.fixtures(spark, str(tmp_path), ["x", "y"])).select("aggregate_nonce", "event_type")) == [(1, "Opened")]
    tree = spark.createDataFrame(
        [
            ("contexts/shop/domain/OrderAggregate.ts", "import { Db } from '../infrastructure/db';\nexport class OrderAggregate {}"),
            ("contexts/shop/slices/get-order/GetOrderQuery.ts", "import { X } from '../../../billing/contexts/billing/domain/x';\nexport class GetOrderQuery {}"),
            ("contexts/shop/slices/list/ListQuery.ts", "export class ListQuery {}"),
            ("contexts/shop/slices/list/ListProjection.ts", "export class ListProjection {}"),
            ("contexts/shop/slices/list/list.test.ts", "import x from '../get-order/GetOrderQuery'"),
        ],
        "path string, text string",
    )
    got = {(r["rule"], r["path"].rsplit("/", 1)[1]) for r in rules.check(tree).collect()}
    assert {("layer-dependency", "OrderAggregate.ts"), ("context-isolation", "GetOrderQuery.ts"), ("query-slice", "GetOrderQuery.ts"), ("tests", "GetOrderQuery.ts")} == got
    assert rules.report(rules.check(tree)).first()["is_valid"] is False


def test_manifest_edges(spark):
    m = '{"version": "1", "domain": {"aggregates": [{"name": "Order", "command_handlers": [{"command_type": "Place", "emits_events": ["Placed", "Placed"]}], "event_handlers": []}, {"name": "Stock", "command_handlers": [], "event_handlers": [{"event_type": "Placed"}]}], "projections": [{"name": "Orders", "subscribed_events": ["Placed"], "read_model": "orders"}]}}'
    df = graph.parse_manifest(spark.createDataFrame([(m,), ("{",)], "text string"))
    assert sorted(r["ok"] for r in df.collect()) == [False, True]
    e = graph.edges(df.where("ok"))
    assert e.count() == 5 and rows(graph.flows(e).select("emitter", "event", "handler")) == [("Order", "Placed", "Stock")]
    links = e.select("src", "dst")
    assert ("Place", "orders") in set(rows(graph.reachable(spark, links)))
