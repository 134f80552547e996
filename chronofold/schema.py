"""Schemas of the event log and of the tables around it, and the errors of the write path."""

from __future__ import annotations

from pyspark.sql import types as T

#: The envelope: one row an event. Money is kept in cents (bigint), absent strings are null.
ENVELOPE = T.StructType(
    [
        T.StructField("tenant_id", T.StringType(), False),
        T.StructField("aggregate_id", T.StringType(), False),
        T.StructField("aggregate_type", T.StringType()),
        T.StructField("aggregate_nonce", T.LongType(), False),
        T.StructField("global_nonce", T.LongType()),
        T.StructField("event_id", T.StringType(), False),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_version", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("content_schema", T.StringType()),
        T.StructField("correlation_id", T.StringType()),
        T.StructField("causation_id", T.StringType()),
        T.StructField("actor_id", T.StringType()),
        T.StructField("timestamp_unix_ms", T.LongType()),
        T.StructField("recorded_time_unix_ms", T.LongType()),
        T.StructField("payload_sha256", T.BinaryType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("payload", T.BinaryType()),
    ]
)

#: A request to append: one stream, one batch. expected: 0 for a new stream, null for any head.
APPEND = T.StructType(
    [
        T.StructField("request_id", T.LongType(), False),
        T.StructField("tenant_id", T.StringType()),
        T.StructField("aggregate_id", T.StringType()),
        T.StructField("aggregate_type", T.StringType()),
        T.StructField("expected", T.LongType()),
        T.StructField("idempotency_key", T.StringType()),
        T.StructField("events", T.ArrayType(T.StructType(ENVELOPE.fields))),
    ]
)

CHECKPOINT = "projection_name string, global_position bigint, updated_at timestamp, version int"
HEADS = "tenant_id string, aggregate_id string, head bigint"
LEDGER = "tenant_id string, aggregate_id string, idempotency_key string, fingerprint string, last_nonce bigint"
FAILED = (
    "id string, projection_name string, event_id string, event_type string, global_nonce bigint, aggregate_id string, "
    "payload string, error string, attempts int, first_failed_at timestamp, last_failed_at timestamp, status string, ignore_reason string, seq bigint"
)
READ_MODEL = "projection string, key string, data map<string,string>, seq bigint, deleted boolean"
SAMPLE = "name string, labels map<string,string>, value double, seq bigint"


class StoreError(Exception):
    """What the write path refuses. status: the name under which a caller sees it."""

    status = "INTERNAL"


class Invalid(StoreError):
    status = "INVALID_ARGUMENT"


class NotFound(StoreError):
    status = "NOT_FOUND"


class AlreadyExists(StoreError):
    status = "ALREADY_EXISTS"


class Concurrency(StoreError):
    """The stream's head is not what the writer expected; actual is that head."""

    status = "ABORTED"

    def __init__(self, message: str, actual: int | None = None) -> None:
        super().__init__(message)
        self.actual = actual


class DuplicateEvent(Concurrency):
    """An event id is in the tenant's log already."""


class Unauthenticated(StoreError):
    status = "UNAUTHENTICATED"


class PermissionDenied(StoreError):
    status = "PERMISSION_DENIED"


class Immutable(StoreError):
    """The log is append-only."""

    status = "FAILED_PRECONDITION"


class Unavailable(StoreError):
    status = "UNAVAILABLE"


#: Status by the name of a rule that a request broke.
ERRORS = {c.__name__: c for c in (Invalid, NotFound, AlreadyExists, Concurrency, DuplicateEvent, Unauthenticated, PermissionDenied, Immutable, Unavailable)}
