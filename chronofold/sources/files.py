"""Other inputs: JSON fixtures, source trees, manifests, external sources that are polled."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIXTURE = (
    "description string, aggregateType string, aggregateId string, "
    "events array<struct<type:string,version:string,data:map<string,string>,metadata:struct<eventId:string,timestamp:string,correlationId:string,causationId:string,actorId:string,tenantId:string>>>, "
    "expectedState map<string,string>, expectedVersion int, tags array<string>"
)


def fixtures(spark: SparkSession, path: str, tags: list[str] | None = None) -> DataFrame:
    """Fixtures of a file or folder, one a JSON file; with tags, those that have one of them (untagged ones have none)."""
    got = spark.read.schema(FIXTURE).option("multiLine", True).json(path)
    return got if tags is None else got.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))


def fixture_log(fixtures_: DataFrame) -> DataFrame:
    """A fixture's events as a log."""
    e = fixtures_.select(F.coalesce("aggregateId", F.lit("fixture")).alias("aggregate_id"), F.col("aggregateType").alias("aggregate_type"), F.posexplode("events").alias("i", "e"))
    return e.select(F.coalesce("e.metadata.tenantId", F.lit("")).alias("tenant_id"), "aggregate_id", "aggregate_type", (F.col("i") + 1).cast("bigint").alias("aggregate_nonce"), F.col("e.type").alias("event_type"), F.col("e.version").alias("event_version"), F.col("e.data").alias("payload"))


def source_tree(spark: SparkSession, path: str, pattern: str = "*.{ts,py,rs}") -> DataFrame:
    """Files below a folder: path, text."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return got.select("path", F.col("content").cast("string").alias("text"))


@dataclass(frozen=True)
class Cursor:
    value: str
    metadata: dict[str, str] = field(default_factory=dict)


@dataclass
class Poller:
    """Polls an external source from a cursor.

    fetch(source, cursor) gives events (each with created_at) and the next cursor; process(events,
    is_replay) handles them. A source never polled before starts cold: its cursor is kept before
    events are processed, and events from before the start are not handled; later polls keep the
    cursor after processing, so a crash repeats a batch rather than losing one.
    """

    fetch: Callable[[str, Cursor | None], tuple[list[dict], Cursor]]
    process: Callable[[list[dict], bool], None]
    started_at: datetime
    cursors: dict[str, Cursor] = field(default_factory=dict)

    def poll(self, source: str) -> int:
        """Polls once; the number of events handled."""
        old = self.cursors.get(source)
        events, new = self.fetch(source, old)
        if old is None:
            self.cursors[source] = new
            events = [e for e in events if e["created_at"] >= self.started_at]
        if events:
            self.process(events, old is None)
        self.cursors[source] = new
        return len(events)
