"""Making, serialising and reading envelopes; the context that events carry on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions import values


def create(rows: DataFrame, event_type: Column, payload: Column, head: Column | None = None, order: str | None = None) -> DataFrame:
    """Events from rows: an id of their own, the time, defaults, and the nonce after a head (0 without)."""
    nonce = (F.lit(0).cast("bigint") if head is None else head) + (F.lit(1) if order is None else F.col(order))
    now = F.unix_millis(F.current_timestamp())
    return rows.withColumns(
        {"event_id": F.uuid(), "event_type": event_type, "event_version": F.lit(1), "content_type": F.lit("application/json"), "aggregate_nonce": nonce.cast("bigint"), "timestamp_unix_ms": now, "payload": F.to_json(payload).cast("binary")}
    )


def to_json(log: DataFrame, name: str = "json") -> DataFrame:
    """Each event as one JSON object; null fields are left out, the payload is embedded as the object that it is.

    A payload that is a JSON object is put in as its own text, so numbers, booleans and what is nested
    stay as they are; any other is left out.
    """
    meta = F.struct(*(c for c in log.columns if c not in ("payload", "event_type", "event_version")))
    text = F.trim(F.col("payload").cast("string"))
    is_object = text.startswith("{") & F.try_parse_json(text).isNotNull()
    rest = F.to_json(F.struct(F.col("event_type").alias("type"), F.col("event_version").alias("version"), meta.alias("metadata")))
    return log.select("event_id", F.when(is_object, F.concat(F.left(rest, F.length(rest) - 1), F.lit(',"data":'), text, F.lit("}"))).otherwise(rest).alias(name))


def decode(log: DataFrame, registry: dict[str, str], payload: str = "payload") -> DataFrame:
    """Payloads by event type: a struct for each registered type (name -> schema), all fields as a map for any other.

    A registered type whose payload lacks the schema's form falls back to the map; malformed JSON is
    an empty map. is_generic says which it was.
    """
    text = F.col(payload).cast("string")
    for kind, schema in registry.items():
        parsed = F.from_json(text, schema, {"mode": "PERMISSIVE"})
        complete = F.forall(F.array(*(parsed[c.strip().split()[0]].isNotNull() for c in schema.split(","))), lambda x: x)
        log = log.withColumn(f"as_{kind}", F.when((F.col("event_type") == kind) & complete, parsed))
    typed = [F.col(f"as_{k}").isNotNull() for k in registry]
    generic = ~F.exists(F.array(*typed), lambda x: x) if typed else F.lit(True)
    return log.withColumn("is_generic", generic).withColumn("fields", F.when(F.col("is_generic"), F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))))


def with_context(log: DataFrame, **context: Column) -> DataFrame:
    """Context over events: an event's own values stay; headers are merged, its own first."""
    out = {}
    for name, value in context.items():
        if name == "headers":
            own = F.coalesce("headers", F.create_map().cast("map<string,string>"))
            out[name] = F.map_concat(F.map_filter(value, lambda k, _: ~F.map_contains_key(own, k)), own)
        else:
            out[name] = F.coalesce(values.present(F.col(name)), value)
    return log.withColumns(out)


def trace_headers(log: DataFrame) -> DataFrame:
    """Headers by which an event's effects can be traced to it."""
    return log.withColumn("headers", F.map_concat(F.coalesce("headers", F.create_map().cast("map<string,string>")), F.create_map(F.lit("x-correlation-id"), F.coalesce("correlation_id", "event_id"), F.lit("x-causation-id"), F.col("event_id"))))
