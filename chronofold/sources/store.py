"""A durable log in files: one committer, batches that become visible at once, no update or delete.

Under the root, data/<uuid>, heads/<uuid> and ledger/<uuid> hold a batch's events, the heads of the
streams that it wrote and its idempotency keys, as Parquet. commits/<number> is a small file that
appears whole or not at all and names these folders. Readers list commits, so a batch is seen whole
or not at all; a writer that died left data that no commit names. Every INDEX commits one file,
index/<number>, holds all commits up to it, so readers open that and the few later ones. Global nonces
are given at commit: the base is the last commit's, and only the new batch is numbered.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold import schema
from chronofold.operators import append
from chronofold.sources.commits import Commits

#: Commits after which an index of all of them is written.
INDEX = 64
HEADS = "tenant_id string, aggregate_id string, head bigint"


class EventStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._commits, self._index = Commits(spark, f"{self.root}/commits"), Commits(spark, f"{self.root}/index")

    def commits(self) -> list[dict]:
        """Commits in order: number, data, heads, ledger, n, head. The last index and the commits after it are read."""
        last = self._index.names()[-1:]
        out = json.loads(self._index.get(last[0])) if last else []
        while (text := self._commits.get(f"{len(out):012d}.json")) is not None:
            out.append(json.loads(text))
        return out

    def _read(self, kind: str, what: str | object) -> DataFrame:
        folders = [c[kind] for c in self.commits()]
        return self.spark.read.schema(what).parquet(*folders) if folders else self.spark.createDataFrame([], what)

    def events(self) -> DataFrame:
        """All committed events."""
        return self._read("data", schema.ENVELOPE)

    def heads(self) -> DataFrame:
        """Head of each stream, from the heads that commits wrote: a row for each stream and batch, not for each event."""
        return self._read("heads", HEADS).groupBy("tenant_id", "aggregate_id").agg(F.max("head").alias("head"))

    def ledger(self) -> DataFrame:
        return self._read("ledger", schema.LEDGER)

    def append(self, requests: DataFrame) -> DataFrame:
        """Commits what is valid of the requests; returns each request's outcome (request_id, status, actual_head, last_nonce).

        Concurrency of writers is settled by the commit file: whoever comes second finds the number
        taken, validates again against the new heads, and retries. The outcomes are written beside
        the batch, so that they stay what they were when it was committed.
        """
        while True:
            commits = self.commits()
            number, base = len(commits), max((c["head"] for c in commits), default=0)
            checked = append.validate(requests, self.heads(), self.ledger(), self.events().select("tenant_id", "event_id"))
            tag = uuid.uuid4().hex
            own = {k: f"{self.root}/{k}/{tag}" for k in ("checked", "data", "heads", "ledger")}
            checked.write.parquet(own["checked"])
            checked = self.spark.read.schema(checked.schema).parquet(own["checked"])
            accepted = append.accepted_events(checked)
            if accepted.isEmpty():
                return append.outcomes(checked)
            order = Window.orderBy("request_id", "aggregate_nonce")  # over the new batch only
            numbered = accepted.withColumn("global_nonce", F.lit(base) + F.row_number().over(order)).select(schema.ENVELOPE.names)
            numbered.write.parquet(own["data"])
            append.heads_of(accepted).write.parquet(own["heads"])
            append.ledger_rows(checked).write.parquet(own["ledger"])
            n = self.spark.read.schema(schema.ENVELOPE).parquet(own["data"]).count()
            commit = {"number": number, **{k: own[k] for k in ("data", "heads", "ledger")}, "n": n, "head": base + n}
            if self._commits.claim(f"{number:012d}.json", json.dumps(commit)):
                if (number + 1) % INDEX == 0:
                    self._index.claim(f"{number + 1:012d}.json", json.dumps([*commits, commit]))
                return append.outcomes(checked)
            for folder in own.values():
                self._fs.delete(self._path(folder), True)

    def update(self, *_: object) -> None:
        raise schema.Immutable("events are never changed")

    delete = update


def open_store(spark: SparkSession, kind: str = "memory", root: str = "") -> EventStore:
    """A store by its kind: 'files' under a shared root, or 'memory', a folder that lives as long as a local session."""
    if kind == "files":
        if not root:
            raise schema.Invalid("a store in files needs a root")
        return EventStore(spark, root)
    if kind == "memory":
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise schema.Invalid("a store in memory is for local sessions")
        return EventStore(spark, f"file://{tempfile.mkdtemp(prefix='chronofold-')}")
    raise schema.Invalid(f"no store of kind {kind!r}")
