"""Projections on a live log: one stream fanned out in micro-batches, with durable checkpoints and dead letters.

A projection is a function from a log to keyed rows to merge. The coordinator reads the log once and
hands each micro-batch to every projection that subscribes to one of its types and has not come past
it. Then one small file that appears whole or not at all records the batch: the position of each
projection and process manager, and the folder of its dead letters. A restarted coordinator reads the
last record. A batch that comes again (after a crash, or as the log is read from the start for a
rebuild) meets positions that are past it, so only what lacks it handles it. What was handled but not
yet recorded is handled again: handlers are given the batch's id to make that harmless.
"""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from chronofold.operators import dlq
from chronofold.operators.checkpoints import Checkpoint
from chronofold.operators.dlq import RetryPolicy
from chronofold.sources.commits import Commits

_log = logging.getLogger(__name__)
#: Dead letters, and how a coordinator writes them.
LETTERS = "id string, projection_name string, event_id string, event_type string, global_nonce bigint, error string, attempts int, status string, seq bigint, ignore_reason string, last_failed_at timestamp"


@dataclass(frozen=True)
class Context:
    """What a handler may want to know: the batch, whether it is live or catching up, and the boundary between."""

    batch_id: int
    live: bool
    boundary: int


@dataclass
class Projection:
    """name, version, event types (None: all), and what to do with a micro-batch's events.

    handle() may return outcomes (event_id, result, error): SUCCESS and SKIP pass, FAILURE and RETRY
    are tried again by the policy and become dead letters. Events that it returns nothing about passed.
    """

    name: str
    handle: Callable[[DataFrame, Context], DataFrame | None]
    types: list[str] | None = None
    version: int = 1
    clear: Callable[[], None] = lambda: None


@dataclass
class ProcessManager:
    """to_do(events) gives items with a key (string); act(item) is called for each key, and only live.

    Items and keys that were acted on are kept under `root`, so neither is lost at a restart: items as
    tables, a small file for each key that is done. An act that dies is repeated, one that went well
    isn't; a crash right between the act and its file repeats that one. Nothing is held in memory.
    """

    name: str
    to_do: Callable[[DataFrame], DataFrame]
    act: Callable[[dict], None]
    spark: SparkSession
    root: str

    def __post_init__(self) -> None:
        base = f"{self.root.rstrip('/')}/{self.name}"
        self._items, self._lists, self._done = f"{base}/items", Commits(self.spark, f"{base}/lists"), Commits(self.spark, f"{base}/done")

    def handle_events(self, events: DataFrame, batch: str) -> None:
        """Writes what is to do after a batch; the same batch again changes nothing."""
        folder = f"{self._items}/{uuid.uuid4().hex}"
        if self._lists.get(batch) is None:
            self.to_do(events).write.parquet(folder)
            self._lists.claim(batch, folder)

    def pending(self) -> DataFrame | None:
        """Items of keys that are not done, one a key; None if there never was any."""
        folders = [self._lists.get(n) for n in self._lists.names()]
        if not folders:
            return None
        items = self.spark.read.parquet(*folders).dropDuplicates(["key"])
        if not self._done.names():
            return items
        done = self.spark.read.text(self._done.folder, wholetext=True).withColumnRenamed("value", "key")
        return items.join(done, "key", "left_anti")

    def process_pending(self) -> int:
        """Acts on what is pending, one item after the other; a second call finds nothing."""
        items, n = self.pending(), 0
        for row in items.toLocalIterator() if items is not None else ():
            self.act(row.asDict())
            self._done.claim(uuid.uuid5(uuid.NAMESPACE_OID, row["key"]).hex, row["key"])
            n += 1
        return n


@dataclass
class Coordinator:
    """Runs projections over batches of a log, from a table or a stream, and keeps its state under `root`.

    on_failure: 'continue' records each event that fails as a dead letter and goes on; 'block' raises
    before anything of the batch is recorded. boundary: head of the log before the start; up to it
    events catch up, and process managers do not act. A batch across it is handed on in two parts.
    """

    spark: SparkSession
    root: str
    projections: list[Projection]
    managers: list[ProcessManager] = field(default_factory=list)
    policy: RetryPolicy = field(default_factory=RetryPolicy)
    on_failure: str = "continue"
    boundary: int = 0
    sleep: Callable[[float], None] = time.sleep

    def __post_init__(self) -> None:
        names = [p.name for p in self.projections] + [m.name for m in self.managers]
        if twice := {n for n in names if names.count(n) > 1}:
            raise ValueError(f"registered twice: {sorted(twice)}")
        self.root = self.root.rstrip("/")
        self._records = Commits(self.spark, f"{self.root}/records")

    # state

    def _record(self) -> tuple[int, dict]:
        """Number of the last record, and the record; -1 and an empty one at first."""
        names = self._records.names()
        return (int(names[-1]), json.loads(self._records.get(names[-1]))) if names else (-1, {"positions": {}, "letters": []})

    def _put(self, record: dict) -> None:
        number, _ = self._record()
        if not self._records.claim(f"{number + 1:012d}", json.dumps(record)):
            raise RuntimeError("another coordinator runs on this state")

    def position(self, name: str) -> int:
        return self._record()[1]["positions"].get(name, {}).get("position", 0)

    def checkpoints(self) -> DataFrame:
        """Checkpoints as a table."""
        rows = [(n, p["position"], None if p["ms"] is None else p["ms"] / 1000, p["version"]) for n, p in sorted(self._record()[1]["positions"].items())]
        got = self.spark.createDataFrame(rows, "projection_name string, global_position bigint, s double, version int")
        return got.select("projection_name", "global_position", F.col("s").cast("timestamp").alias("updated_at"), "version")

    def dead_letters(self) -> DataFrame:
        """All dead letters, for operators.dlq."""
        folders = self._record()[1]["letters"]
        return self.spark.read.schema(LETTERS).parquet(*folders) if folders else self.spark.createDataFrame([], LETTERS)

    # running

    def start(self) -> int:
        """Clears projections whose version changed; the position from which the log is needed."""
        _, record = self._record()
        stale = [p for p in self.projections if record["positions"].get(p.name, {"version": p.version})["version"] != p.version]
        for p in stale:
            p.clear()
            del record["positions"][p.name]
        if stale:
            self._put(record)
        at = [record["positions"].get(x.name, {}).get("position", 0) for x in (*self.projections, *self.managers)]
        return 0 if not at or min(at) == 0 else min(at) + 1

    def rebuild(self, name: str) -> None:
        """Clears one projection; the next run replays it, and it alone, from the start."""
        next(p for p in self.projections if p.name == name).clear()
        _, record = self._record()
        if record["positions"].pop(name, None):
            self._put(record)

    def run_batch(self, batch: DataFrame, batch_id: int) -> None:
        """Hands a batch to whatever has yet to see it, then records it.

        Rows without a position, an id or a type are malformed: they become dead letters of '*', and
        the rest goes on.
        """
        _, record = self._record()
        batch = batch.persist()
        try:
            well = F.col("global_nonce").isNotNull() & F.col("event_id").isNotNull() & F.col("event_type").isNotNull()
            seen = batch.agg(F.max(F.when(well, F.col("global_nonce"))).alias("head"), F.count_if(~well).alias("bad")).first()
            letters = [self._letters(batch.where(~well), "*", "malformed event", 1)] if seen["bad"] else []
            if seen["head"] is None and not letters:
                return
            good, live = batch.where(well), seen["head"] is not None and seen["head"] > self.boundary
            for p in self.projections:
                done = record["positions"].get(p.name, {"position": 0})["position"]
                if seen["head"] is None or seen["head"] <= done:
                    continue
                own = good.where(F.col("global_nonce") > done)
                own = own if p.types is None else own.where(F.col("event_type").isin(p.types))
                for part, is_live in ((own.where(F.col("global_nonce") <= self.boundary), False), (own.where(F.col("global_nonce") > self.boundary), True)):
                    if (not is_live and done < self.boundary) or (is_live and live):
                        letters += self._handle(p, part, Context(batch_id, is_live, self.boundary))
                record["positions"][p.name] = self._moved(p.name, p.version, seen["head"])
            for m in self.managers:
                done = record["positions"].get(m.name, {"position": 0})["position"]
                if seen["head"] is not None and seen["head"] > done:
                    m.handle_events(good.where(F.col("global_nonce") > done), f"{done}-{seen['head']}")
                    record["positions"][m.name] = self._moved(m.name, 1, seen["head"])
            record["letters"] += letters
            self._put(record)
            if live:
                for m in self.managers:
                    m.process_pending()
        finally:
            batch.unpersist()

    @staticmethod
    def _moved(name: str, version: int, head: int) -> dict:
        now = Checkpoint(name, version=version).advance_to(head)
        return {"position": now.global_position, "version": now.version, "ms": int(now.updated_at.timestamp() * 1000)}

    def _handle(self, p: Projection, own: DataFrame, context: Context) -> list[str]:
        """Folders of the dead letters of a batch.

        A batch that fails as a whole is tried again by the policy, and then halved, until what fails
        are single events.
        """
        attempt = 0
        while True:
            attempt += 1
            try:
                got = p.handle(own, context)
                break
            except Exception as e:  # whatever a handler raises is its failure
                if self.policy.is_transient(str(e)) and self.policy.should_retry(attempt):
                    self.sleep(self.policy.delay_ms(attempt) / 1000)
                    continue
                if self.on_failure == "block":
                    raise
                ends = own.agg(F.min("global_nonce").alias("a"), F.max("global_nonce").alias("b")).first()
                if ends["a"] is None:
                    return []
                if ends["a"] == ends["b"]:
                    return [self._letters(own, p.name, str(e), attempt)]
                middle = (ends["a"] + ends["b"]) // 2
                return self._handle(p, own.where(F.col("global_nonce") <= middle), context) + self._handle(p, own.where(F.col("global_nonce") > middle), context)
        return [] if got is None else self._outcomes(p, own, got, context)

    def _outcomes(self, p: Projection, own: DataFrame, got: DataFrame, context: Context) -> list[str]:
        """Tries again what may pass by the policy, and writes what stays failed as dead letters."""
        letters, attempt = [], 1
        while True:
            failed = dlq.route(got.where("result in ('FAILURE', 'RETRY')").withColumn("attempt", F.lit(attempt)), self.policy).select("event_id", F.col("error").alias("why"), "action").persist()
            try:
                dead = own.join(failed.where("action = 'dead letter'"), "event_id")
                if not dead.isEmpty():
                    if self.on_failure == "block":
                        raise RuntimeError(f"{p.name}: {dead.first()['why']}")
                    letters.append(self._letters(dead, p.name, F.col("why"), attempt))
                again = own.join(failed.where("action = 'retry'").select("event_id"), "event_id", "left_semi").persist()
                if again.isEmpty():
                    return letters
            finally:
                failed.unpersist()
            self.sleep(self.policy.delay_ms(attempt) / 1000)
            attempt += 1
            got = p.handle(again, context)
            if got is None:
                return letters

    def _letters(self, events: DataFrame, name: str, error: object, attempts: int) -> str:
        folder = f"{self.root}/letters/{uuid.uuid4().hex}"
        own = F.concat_ws(":", F.lit(name), F.coalesce("event_id", F.lit("?")), F.coalesce(F.col("global_nonce").cast("string"), F.lit("?")))
        rows = events.select(
            own.alias("id"), F.lit(name).alias("projection_name"), F.col("event_id").cast("string"), "event_type", F.col("global_nonce").cast("bigint"), (F.lit(error) if isinstance(error, str) else error).alias("error"),
            F.lit(attempts).alias("attempts"), F.lit(dlq.PENDING).alias("status"), F.lit(1).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("ignore_reason"), F.current_timestamp().alias("last_failed_at"),
        )
        rows.write.parquet(folder)
        return folder

    def run_table(self, log: DataFrame, batch_id: int = 0) -> None:
        """Everything of a log that some projection or manager has yet to see, as one batch."""
        self.run_batch(log.where(F.col("global_nonce") >= self.start()), batch_id)

    def run_stream(self, log: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        """The live form; trigger: availableNow=True for catching up, processingTime='5 seconds' for staying."""
        own = log.where(F.coalesce(F.col("global_nonce") >= self.start(), F.lit(True)))
        return own.writeStream.foreachBatch(self.run_batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def stay(self, log: DataFrame, checkpoint: str, attempts: int = 0, **trigger: object) -> int:
        """Runs the stream until it ends; one that dies is started again after the policy's delay.

        The delay grows with each start that recorded nothing and is the first again after one that did.
        attempts: most starts in a row without a record, 0 for no limit. Returns how often it was restarted.
        """
        restarts = in_a_row = 0
        while True:
            before = self._record()[0]
            try:
                self.run_stream(log, checkpoint, **trigger).awaitTermination()
                return restarts
            except Exception as e:
                in_a_row = 1 if self._record()[0] > before else in_a_row + 1
                if attempts and in_a_row >= attempts:
                    raise
                restarts += 1
                _log.warning("stream ended, starting again: %s", e)
                self.sleep(self.policy.delay_ms(in_a_row) / 1000)

    def status(self) -> list[dict]:
        """Name, version, position, failures of each projection."""
        failed = {r["projection_name"]: r["pending"] for r in dlq.counts(self.dead_letters()).select("projection_name", "pending").collect()}  # one row a projection
        return [{"projection_name": p.name, "version": p.version, "position": self.position(p.name), "failed": failed.get(p.name, 0)} for p in self.projections]


@dataclass
class ProjectionManager:
    """Several projections over a log without checkpoints, as for tests: one that fails is logged and doesn't stop the others."""

    projections: list[Projection]
    errors: dict[str, list[str]] = field(default_factory=dict)

    def run(self, log: DataFrame) -> dict[str, list[str]]:
        """Hands the log to each; returns the errors so far by projection."""
        for p in self.projections:
            try:
                p.handle(log if p.types is None else log.where(F.col("event_type").isin(p.types)), Context(0, False, 0))
            except Exception as e:
                _log.error("projection %s failed: %s", p.name, e)
                self.errors.setdefault(p.name, []).append(str(e))
        return self.errors


class KeepAlive(StreamingQueryListener):
    """Tells when a subscription passes from replay to live, and that an idle one is alive.

    head: of the log when the subscription began. on_live is called once, when a batch came that leaves
    nothing to replay; beat at every trigger that finds no data.
    """

    def __init__(self, on_live: Callable[[], None], beat: Callable[[], None]) -> None:
        self.on_live, self.beat, self.live, self.beats = on_live, beat, False, 0

    def _idle(self) -> None:
        if not self.live:
            self.live = True
            self.on_live()
        self.beats += 1
        self.beat()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        if event.progress.numInputRows == 0:
            self._idle()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self._idle()

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def subscribe(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """A log of Parquet files as a stream; filter it with sources.log.subscription.

    Files are taken in the order in which they appeared, so the log's one committer must add them in
    global order, as positions only grow.
    """
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def daily_sales(log: DataFrame, sale: str, late: str = "1 hour") -> DataFrame:
    """Revenue and count by day, for streams: late events count up to the watermark."""
    own = log.where(F.col("event_type") == sale).withColumn("ts", F.timestamp_millis("timestamp_unix_ms")).withWatermark("ts", late)
    return own.groupBy(F.window("ts", "1 day").alias("day")).agg(F.sum("amount").alias("revenue"), F.count("*").alias("sales"))
