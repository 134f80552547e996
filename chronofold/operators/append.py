"""The write path as plans: normalise, check, tell accepted from refused.

Everything is set-wise: many requests at once, each for one stream. Of the requests for one stream in
one batch that pass the checks against the log, the first (by request_id) is considered; the others
are refused as Concurrency, as their writers would have found the head moved. Requests that are
refused themselves stand in nobody's way. Order of the checks: arguments, tenant, the idempotency
ledger, the expected head, contiguous nonces, event ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions import values

CONTENT_TYPE = "application/json"


def heads_of(log: DataFrame) -> DataFrame:
    return log.groupBy("tenant_id", "aggregate_id").agg(F.max("aggregate_nonce").alias("head"))


def normalize(e: Column, tenant: Column, aggregate_id: Column, aggregate_type: Column) -> Column:
    """An event with the request's ids where it has none, empty strings null, the payload's hash set."""
    kept = {c: values.present(e[c]) for c in ("content_schema", "correlation_id", "causation_id", "actor_id")}
    return F.struct(
        values.or_else(e["tenant_id"], tenant).alias("tenant_id"),
        values.or_else(e["aggregate_id"], aggregate_id).alias("aggregate_id"),
        values.or_else(e["aggregate_type"], aggregate_type).alias("aggregate_type"),
        e["aggregate_nonce"].alias("aggregate_nonce"),
        F.lit(None).cast("bigint").alias("global_nonce"),
        e["event_id"].alias("event_id"),
        e["event_type"].alias("event_type"),
        F.coalesce(e["event_version"], F.lit(1)).alias("event_version"),
        values.or_else(e["content_type"], CONTENT_TYPE).alias("content_type"),
        *(v.alias(k) for k, v in kept.items()),
        F.coalesce(e["timestamp_unix_ms"], F.lit(0).cast("bigint")).alias("timestamp_unix_ms"),
        F.coalesce(e["recorded_time_unix_ms"], F.unix_millis(F.current_timestamp())).alias("recorded_time_unix_ms"),
        F.coalesce(e["payload_sha256"], F.unhex(F.sha2(e["payload"], 256))).alias("payload_sha256"),
        e["headers"].alias("headers"),
        e["payload"].alias("payload"),
    )


def event_fingerprint(e: Column) -> Column:
    """Of all that a writer sets; what the store sets (global_nonce, recorded time) is left out."""
    names = ("tenant_id", "aggregate_id", "aggregate_type", "aggregate_nonce", "event_id", "event_type", "event_version", "content_type", "content_schema", "correlation_id", "causation_id", "actor_id", "timestamp_unix_ms")
    return values.fingerprint(*(e[n] for n in names), values.sorted_map(e["headers"]), F.base64(e["payload"]))


def batch_fingerprint(events: Column) -> Column:
    """SHA-256 over the events' fingerprints in order."""
    return F.sha2(F.array_join(F.transform(events, event_fingerprint), ","), 256)


def validate(requests: DataFrame, heads: DataFrame, ledger: DataFrame, known_ids: DataFrame) -> DataFrame:
    """The requests with normalised events, fingerprint, head, and status: ok, replayed, or the name of an error."""
    t, a = F.col("tenant_id"), F.col("aggregate_id")
    raw = F.coalesce("events", F.array())
    events = F.transform(raw, lambda e: normalize(e, t, a, F.col("aggregate_type")))
    got = requests.withColumn("events", events).withColumn("n", F.size("events")).withColumn("fingerprint", batch_fingerprint(F.col("events")))
    got = got.join(heads, ["tenant_id", "aggregate_id"], "left").withColumn("head", F.coalesce("head", F.lit(0).cast("bigint")))
    old = ledger.select("tenant_id", "aggregate_id", "idempotency_key", F.col("fingerprint").alias("old_fingerprint"), F.col("last_nonce").alias("old_last"))
    got = got.join(old, ["tenant_id", "aggregate_id", "idempotency_key"], "left")

    # of the log's ids only those that the batch has too: the batch is the small side of a semi-join
    ids = got.select("request_id", "tenant_id", F.explode("events.event_id").alias("event_id"))
    known = known_ids.select("tenant_id", "event_id").join(ids.select("tenant_id", "event_id").distinct(), ["tenant_id", "event_id"], "left_semi").distinct().withColumn("known", F.lit(1))
    taken = ids.join(known, ["tenant_id", "event_id"], "left").groupBy("request_id").agg(F.max("known").alias("known"), (F.count("*") > F.count_distinct("event_id")).alias("twice"))
    got = got.join(taken, "request_id", "left")

    missing = t.isNull() | (t == "")
    incomplete = a.isNull() | (a == "") | F.col("aggregate_type").isNull() | (F.col("aggregate_type") == "") | (F.col("n") == 0)
    malformed = F.exists("events", lambda e: F.coalesce(e["event_id"], F.lit("")).eqNullSafe("") | F.coalesce(e["aggregate_nonce"] < 1, F.lit(True)) | (e["aggregate_id"] != a) | (e["aggregate_type"] != F.col("aggregate_type")))
    stranger = F.exists("events", lambda e: e["tenant_id"] != t)
    steps = F.transform("events", lambda e, i: e["aggregate_nonce"] - i)
    contiguous = F.forall(steps, lambda x: x == F.col("head") + 1)
    alone = (
        F.when(missing, "Unauthenticated")
        .when(incomplete | malformed, "Invalid")
        .when(stranger, "PermissionDenied")
        .when(F.col("old_fingerprint") == F.col("fingerprint"), "replayed")
        .when(F.col("old_fingerprint").isNotNull(), "AlreadyExists")
        .when(F.col("expected") != F.col("head"), "Concurrency")
        .when(~contiguous, "Invalid")
        .when((F.col("known") == 1) | F.col("twice"), "DuplicateEvent")
        .otherwise("ok")
    )
    got = got.withColumn("alone", alone).drop("known", "twice")
    # within the batch only requests that are right by themselves count: one a stream, then one an event id
    right = F.col("alone") == "ok"
    order = Window.partitionBy("tenant_id", "aggregate_id", right).orderBy("request_id")
    got = got.withColumn("late", right & (F.row_number().over(order) > 1))
    rest = got.where(right & ~F.col("late")).select("request_id", "tenant_id", F.explode("events.event_id").alias("event_id"))
    first = rest.withColumn("rank", F.row_number().over(Window.partitionBy("tenant_id", "event_id").orderBy("request_id")))
    clash = first.groupBy("request_id").agg((F.max("rank") > 1).alias("clash"))
    got = got.join(clash, "request_id", "left")
    status = F.when(F.col("late"), "Concurrency").when(F.col("clash"), "DuplicateEvent").otherwise(F.col("alone"))
    return got.withColumn("status", status).drop("alone", "late", "clash")


def accepted_events(checked: DataFrame) -> DataFrame:
    return checked.where("status = 'ok'").select("request_id", F.explode("events").alias("e")).select("request_id", "e.*")


def ledger_rows(checked: DataFrame) -> DataFrame:
    """Ledger entries of what was accepted under a key."""
    return checked.where("status = 'ok' and idempotency_key <> ''").select("tenant_id", "aggregate_id", "idempotency_key", "fingerprint", (F.col("head") + F.col("n")).alias("last_nonce"))


def outcomes(checked: DataFrame) -> DataFrame:
    """Each request's outcome: status, the head it met, the last nonce that it wrote (or had written, if replayed)."""
    last = F.when(F.col("status") == "ok", F.col("head") + F.col("n")).when(F.col("status") == "replayed", F.col("old_last"))
    return checked.select("request_id", "status", F.col("head").alias("actual_head"), last.alias("last_nonce"))


def expected_after(version: Column, uncommitted: Column) -> Column:
    """The head that a repository expects: the aggregate's version less what it is about to write."""
    return version - uncommitted


def claims(requests: DataFrame, value: str = "value") -> DataFrame:
    """Set-based uniqueness: each value is a stream of its own that must be new; the first to ask gets it."""
    w = Window.partitionBy(value).orderBy("request_id")
    return requests.withColumn("granted", F.row_number().over(w) == 1)
