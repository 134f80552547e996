"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed deltas: an insert adds a
document and its tokens, a delete takes them away, a revision adds the difference of two counts.
Sums of deltas need no reading of documents that did not change, and batches commute.

A batch commits once. Its deltas are pre-aggregated, written to a folder of their own, and become
visible by a marker that appears whole or not at all, under the batch's id, and names that folder.
Committing the id again, after a crash or by a second writer, changes nothing. Readers sum over
marked folders only. compact() sums what is committed into one folder, so that readers open that and
the later ones.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.sources.commits import Commits

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


def deltas(changes: DataFrame) -> DataFrame:
    """Signed deltas of changes (op, source, lang, tokenizer, tokens, old_tokens).

    op is insert, delete or revise; tokens is the count inserted, deleted or revised to, old_tokens
    the count revised from. Null counts are 0; null sources and languages are groups of their own;
    any other op is an error. Each row is a change: repeated rows count as often as they are there, what
    is delivered twice has to come in a batch of the same id. Empty tables have no deltas.
    """
    new, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0)
    tokens = F.when(F.col("op") == "insert", new).when(F.col("op") == "delete", -new).when(F.col("op") == "revise", new - old)
    unknown = F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null"))))
    return changes.select(*KEYS, F.coalesce(docs, unknown.cast("int")).cast("bigint").alias("n_docs"), tokens.cast("bigint").alias("n_tokens"))


class TokenRollup:
    """Totals kept under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._commits, self._snapshots = Commits(spark, f"{self.root}/commits"), Commits(spark, f"{self.root}/snapshots")

    def committed(self, batch: str) -> bool:
        return self._commits.get(batch.encode().hex()) is not None

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Commits a batch of changes under its id. False, and nothing done, if the id is committed.

        Of two writers of one id the second's folder stays unmarked, as a lost writer's does.
        """
        if not batch:
            raise ValueError("a batch needs an id")
        return False if self.committed(batch) else self._commits.claim(batch.encode().hex(), self._written(deltas(changes)))

    def _written(self, rows: DataFrame) -> str:
        data = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.parquet(data)
        return data

    def _folders(self) -> tuple[list[str], list[str]]:
        """Batches that are committed, and folders that hold their sums: the last snapshot's, and one a later batch."""
        last = self._snapshots.names()[-1:]
        snapshot = json.loads(self._snapshots.get(last[0])) if last else {"batches": [], "data": []}
        later = sorted(set(self._commits.names()) - set(snapshot["batches"]))
        return [*snapshot["batches"], *later], [*snapshot["data"], *(self._commits.get(b) for b in later)]

    def compact(self) -> int:
        """Sums all that is committed into one folder, which readers use from then on; returns how many batches it holds.

        Markers stay, so ids stay taken. A compaction that another came before is dropped.
        """
        number = len(self._snapshots.names())
        batches, folders = self._folders()
        if len(folders) > 1:
            data = self._written(self.spark.read.schema(SCHEMA).parquet(*folders))
            self._snapshots.claim(f"{number:012d}", json.dumps({"batches": batches, "data": [data]}))
        return len(batches)

    def totals(self) -> DataFrame:
        """Current totals; groups that came to nothing are left out."""
        _, folders = self._folders()
        rows = self.spark.read.schema(SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMA)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")


def changes(counts: DataFrame, op: str, tokenizer: str, tokens: Column, old_tokens: Column | None = None) -> DataFrame:
    """Rows of a table with source and lang as changes of one kind."""
    old = F.lit(None).cast("bigint") if old_tokens is None else old_tokens
    return counts.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), tokens.cast("bigint").alias("tokens"), old.alias("old_tokens"))
