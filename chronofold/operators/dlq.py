"""Failures: retry policies, classification of errors, the dead-letter table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions import text, values
from chronofold.operators import fold

#: Parts of messages of errors that may pass.
TRANSIENT = ["econnrefused", "etimedout", "econnreset", "enotfound", "connection", "timeout", "unavailable", "temporarily", "overloaded", "too many connections", "connection pool", "socket hang up"]
PENDING, REPROCESSING, RESOLVED, IGNORED = "pending", "reprocessing", "resolved", "ignored"


@dataclass(frozen=True)
class RetryPolicy:
    """Exponential backoff; multiplier 1 makes it fixed, attempts 0 none.

    patterns, parts of messages in any case, replace TRANSIENT; none or an empty tuple leave it.
    """

    attempts: int = 3
    initial_ms: int = 100
    multiplier: float = 2.0
    most_ms: int = 30_000
    patterns: tuple[str, ...] | None = None

    def delay_ms(self, attempt: int) -> int:
        return min(self.most_ms, int(self.initial_ms * self.multiplier ** (attempt - 1)))

    def should_retry(self, attempt: int) -> bool:
        return attempt < self.attempts

    def is_transient(self, message: str) -> bool:
        return any(p.lower() in message.lower() for p in self.patterns or TRANSIENT)

    def transient(self, message: Column) -> Column:
        return text.contains_any(message, list(self.patterns or TRANSIENT))

    def delay(self, attempt: Column) -> Column:
        return values.backoff_ms(attempt, self.initial_ms, self.multiplier, self.most_ms)


def route(results: DataFrame, policy: RetryPolicy) -> DataFrame:
    """What becomes of each outcome (result, error, attempt): advance, retry after a delay, or dead letter.

    RETRY always counts as retryable; FAILURE only if its message is of an error that may pass.
    """
    more = F.col("attempt") < policy.attempts
    again = (F.col("result") == "RETRY") | ((F.col("result") == "FAILURE") & policy.transient(F.coalesce("error", F.lit(""))))
    action = F.when(F.col("result").isin("SUCCESS", "SKIP"), "advance").when(again & more, "retry").otherwise("dead letter")
    return results.withColumn("action", action).withColumn("delay_ms", F.when(F.col("action") == "retry", policy.delay(F.col("attempt") + 1)))


def current(failed: DataFrame) -> DataFrame:
    """Each dead letter as its last change left it."""
    return fold.latest(failed, ["id"], "seq")


def mark(failed: DataFrame, ids: DataFrame, status: str, seq: int, reason: str | None = None) -> DataFrame:
    """The table with a change of status for some ids."""
    got = current(failed).join(ids.select("id"), "id", "left_semi")
    return failed.unionByName(got.withColumns({"status": F.lit(status), "seq": F.lit(seq).cast("bigint"), "ignore_reason": F.lit(reason).cast("string")}))


def listing(failed: DataFrame, projection: str | None = None, status: str | None = None, limit: int = 0) -> DataFrame:
    """Newest first; limit 0: none."""
    got = current(failed)
    got = got if projection is None else got.where(F.col("projection_name") == projection)
    got = (got if status is None else got.where(F.col("status") == status)).orderBy(F.col("last_failed_at").desc(), "id")
    return got.limit(limit) if limit else got


def counts(failed: DataFrame) -> DataFrame:
    """Dead letters by projection: pending ones and all, and the messages of the five newest pending ones."""
    now = current(failed)
    got = now.groupBy("projection_name").agg(F.count_if(F.col("status") == PENDING).alias("pending"), F.count("*").alias("total"))
    return got.join(latest_messages(failed), "projection_name", "left").withColumn("messages", F.coalesce("messages", F.array().cast("array<string>")))


def latest_messages(failed: DataFrame, most: int = 5) -> DataFrame:
    """The messages of the newest pending letters by projection, newest first; only these are collected."""
    newest = Window.partitionBy("projection_name").orderBy(F.col("last_failed_at").desc(), "id")
    top = current(failed).where(F.col("status") == PENDING).withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= most)
    got = top.groupBy("projection_name").agg(F.array_sort(F.collect_list(F.struct("__n", "error"))).alias("__m"))
    return got.select("projection_name", F.col("__m.error").alias("messages"))


def purge(failed: DataFrame, before: Column) -> DataFrame:
    """The table without settled letters last failed before a time."""
    gone = current(failed).where(F.col("status").isin(RESOLVED, IGNORED) & (F.col("last_failed_at") < before)).select("id")
    return failed.join(gone, "id", "left_anti")


def split(handled: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows handled well, rows that failed."""
    return handled.where(F.col(error).isNull()).drop(error), handled.where(F.col(error).isNotNull())
