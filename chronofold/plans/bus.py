"""Commands and queries by name, aggregates and their repository, for callers that work one stream at a time."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from chronofold import schema
from chronofold.sources import log as reading
from chronofold.sources.store import EventStore


class QueryBus:
    """Routes a query's name to a function (spark, **parameters) -> DataFrame."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._handlers = spark, {}

    def register(self, name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
        def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self._handlers[name] = f
            return f

        return put

    def send(self, name: str, **parameters: object) -> DataFrame:
        if name not in self._handlers:
            raise schema.NotFound(f"no handler for query {name!r}")
        return self._handlers[name](self.spark, **parameters)


class CommandBus:
    """Routes a command's type to its handler."""

    def __init__(self) -> None:
        self._handlers: dict[type, Callable] = {}

    def register(self, kind: type, handler: Callable) -> None:
        if kind in self._handlers:
            raise schema.AlreadyExists(f"{kind.__name__} has a handler")
        self._handlers[kind] = handler

    def send(self, command: object) -> object:
        if type(command) not in self._handlers:
            raise schema.NotFound(f"no handler for {type(command).__name__}")
        return self._handlers[type(command)](command)


def handles(kind: type) -> Callable:
    """Marks a method of an aggregate as a command's handler."""

    def mark(f: Callable) -> Callable:
        f.handles = kind
        return f

    return mark


def applies(event_type: str) -> Callable:
    """Marks a method of an aggregate that applies events of a type."""

    def mark(f: Callable) -> Callable:
        f.applies = event_type
        return f

    return mark


@dataclass
class Aggregate:
    """State of one stream. version counts all events, also those not saved yet; unknown events change nothing."""

    aggregate_id: str
    version: int = 0
    uncommitted: list[dict] = field(default_factory=list)
    aggregate_type = "Aggregate"

    def _marked(self, attribute: str, value: object) -> Callable | None:
        return next((getattr(self, n) for n in dir(type(self)) if getattr(getattr(type(self), n), attribute, None) == value), None)

    def apply(self, event_type: str, data: dict) -> None:
        if (f := self._marked("applies", event_type)) is not None:
            f(data)
        self.version += 1

    def emit(self, event_type: str, **data: object) -> None:
        """Raises an event: applied at once, saved with the next save."""
        self.apply(event_type, data)
        self.uncommitted.append(envelope(event_type, data, self.version))

    def handle(self, command: object) -> None:
        f = self._marked("handles", type(command))
        if f is None:
            raise schema.NotFound(f"{type(self).__name__} handles no {type(command).__name__}")
        f(command)


def envelope(event_type: str, data: dict, nonce: int, **context: str) -> dict:
    """An event with an id of its own. context: correlation_id, causation_id, actor_id."""
    return {"event_id": str(uuid.uuid4()), "event_type": event_type, "aggregate_nonce": nonce, "event_version": 1, "payload": json.dumps(data, separators=(",", ":")).encode(), **context}


class Repository:
    def __init__(self, store: EventStore, tenant: str, kind: type[Aggregate]) -> None:
        self.store, self.tenant, self.kind = store, tenant, kind

    def load(self, aggregate_id: str) -> Aggregate | None:
        """The aggregate after its events; None if it has none."""
        rows = reading.read_stream(self.store.events(), self.tenant, aggregate_id).select("event_type", "payload").collect()
        if not rows:
            return None
        a = self.kind(aggregate_id)
        for r in rows:
            a.apply(r["event_type"], json.loads(bytes(r["payload"] or b"{}").decode()))
        return a

    def exists(self, aggregate_id: str) -> bool:
        return reading.exists(self.store.events(), self.tenant, aggregate_id)

    def save(self, a: Aggregate, key: str = "") -> None:
        """Writes what is not saved, expecting the head that the aggregate was loaded at."""
        if not a.uncommitted:
            return
        row = (0, self.tenant, a.aggregate_id, a.aggregate_type, a.version - len(a.uncommitted), key, [{n: e.get(n) for n in schema.ENVELOPE.names} for e in a.uncommitted])
        relaxed = schema.T.StructType([schema.T.StructField(f.name, f.dataType) for f in schema.ENVELOPE.fields])
        kind = schema.T.StructType([*schema.APPEND.fields[:-1], schema.T.StructField("events", schema.T.ArrayType(relaxed))])
        outcome = self.store.append(self.store.spark.createDataFrame([row], kind)).first()
        if outcome["status"] in schema.ERRORS:
            error = schema.ERRORS[outcome["status"]]
            message = f"{a.aggregate_id}: {outcome['status']}, head {outcome['actual_head']}"
            raise error(message, outcome["actual_head"]) if issubclass(error, schema.Concurrency) else error(message)
        a.uncommitted.clear()

    def save_new(self, a: Aggregate) -> None:
        """Saves an aggregate that must not exist."""
        if a.version != len(a.uncommitted):
            raise schema.Invalid(f"{a.aggregate_id} is not new")
        self.save(a)
