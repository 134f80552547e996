"""Causation: which event came of which, over any number of steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parents(log: DataFrame) -> DataFrame:
    """Each event with the event that caused it."""
    p = log.select(F.col("event_id").alias("parent_id"), F.col("event_type").alias("parent_type"), F.col("tenant_id").alias("parent_tenant"))
    return log.join(p, (F.col("causation_id") == F.col("parent_id")) & (F.col("tenant_id") == F.col("parent_tenant"))).drop("parent_tenant")


def descendants(spark, edges: DataFrame, roots: DataFrame, depth: int | None = None, stride: int = 8) -> DataFrame:
    """All that came of the roots (id), with the fewest steps to it; edges are (parent, child).

    Goes on until a round finds nothing new, or for `depth` steps if that is asked for. A round goes
    `stride` steps from what the last one found farthest, over pairs up to that far apart, and is
    checkpointed. Where each has one cause, these pairs are at most `stride` for each edge.
    """

    def fixed(df: DataFrame) -> DataFrame:
        return df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.cache()

    def further(pairs: DataFrame, more: DataFrame, start: str) -> DataFrame:
        """The fewest steps by one of the pairs (start, id, steps) and one of more (parent, child, far)."""
        both = pairs.join(more, F.col("id") == F.col("parent")).select(start, F.col("child").alias("id"), (F.col("steps") + F.col("far")).alias("steps"))
        return both.groupBy(start, "id").agg(F.min("steps").alias("steps"))

    near, reach = fixed(edges.select("parent", "child", F.lit(1).alias("far")).distinct()), 1
    while reach < stride and (depth is None or reach < depth):
        start = near.select(F.col("parent").alias("from"), F.col("child").alias("id"), F.col("far").alias("steps"))
        two = start.union(further(start, near, "from")).groupBy("from", "id").agg(F.min("steps").alias("far"))
        near, reach = fixed(two.select(F.col("from").alias("parent"), F.col("id").alias("child"), "far")), 2 * reach
    new = fixed(roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("steps")).distinct())
    seen, done = new, 0
    while depth is None or done < depth:
        step = further(new.where(F.col("steps") == done), near, "root")
        new = fixed(step.join(seen.select("root", "id"), ["root", "id"], "left_anti"))
        if new.isEmpty():
            break
        seen, done = seen.union(new), done + reach
    return seen.where("steps > 0" if depth is None else F.col("steps").between(1, depth))


def child_context(log: DataFrame) -> DataFrame:
    """What an event caused by another carries on: its correlation id (its own id if it has none), its id as causation, its actor."""
    return log.select("event_id", F.coalesce("correlation_id", "event_id").alias("correlation_id"), F.col("event_id").alias("causation_id"), "actor_id")


def correlated(log: DataFrame, key: str = "correlation_id") -> DataFrame:
    """One row a correlation: events, streams, first and last, and how long it took."""
    return log.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("n_events"), F.count_distinct("aggregate_id").alias("n_streams"), F.min("global_nonce").alias("first"), F.max("global_nonce").alias("last"), (F.max("timestamp_unix_ms") - F.min("timestamp_unix_ms")).alias("took_ms")
    )
