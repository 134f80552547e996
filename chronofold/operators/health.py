"""Health of projections, from the log's head, checkpoints and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lag from which a projection is degraded, from which unhealthy; age of its last progress, in ms, that is too old if it lags.
DEGRADED, UNHEALTHY, STALE_MS = 100, 1000, 60_000
SEVERITY = {"healthy": 0, "degraded": 1, "unhealthy": 2}


def status(lag: Column, failed: Column, age_ms: Column) -> Column:
    return (
        F.when((failed > 0) | (lag >= UNHEALTHY), "unhealthy")
        .when((lag >= DEGRADED) | ((age_ms > STALE_MS) & (lag > 0)), "degraded")
        .otherwise("healthy")
    )


def check(lag: Column) -> Column:
    """pass, warn or fail, as a health endpoint says it."""
    return F.when(lag < DEGRADED, "pass").when(lag < UNHEALTHY, "warn").otherwise("fail")


def projections(registered: DataFrame, checkpoints: DataFrame, head: DataFrame, failed: DataFrame, now_ms: Column) -> DataFrame:
    """One row a registered projection: position, head, lag, failed, age_ms, status.

    head has one row (head); failed one a projection (projection_name, pending). A projection
    without a checkpoint is at 0 since the epoch.
    """
    c = checkpoints.select("projection_name", "global_position", "updated_at")
    got = registered.select("projection_name").join(c, "projection_name", "left").join(failed.select("projection_name", "pending"), "projection_name", "left").crossJoin(F.broadcast(head))
    position = F.coalesce("global_position", F.lit(0).cast("bigint"))
    lag = F.greatest(F.lit(0).cast("bigint"), F.col("head") - position)
    bad, age = F.coalesce("pending", F.lit(0).cast("bigint")), now_ms - F.coalesce(F.unix_millis("updated_at"), F.lit(0).cast("bigint"))
    got = got.select("projection_name", position.alias("position"), "head", lag.alias("lag"), bad.alias("failed"), age.alias("age_ms"))
    return got.withColumn("status", status(F.col("lag"), F.col("failed"), F.col("age_ms")))


def summary(health: DataFrame) -> DataFrame:
    """Counts by status, sums of lag and failures, and the worst status of all."""
    rank = F.max(F.element_at(F.create_map(*(x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v)))), F.col("status")))
    worst = F.element_at(F.array(*map(F.lit, SEVERITY)), F.coalesce(rank, F.lit(0)) + 1)
    by = [F.count_if(F.col("status") == s).alias(s) for s in SEVERITY]
    return health.agg(F.count("*").alias("total"), *by, F.coalesce(F.sum("lag"), F.lit(0)).alias("total_lag"), F.coalesce(F.sum("failed"), F.lit(0)).alias("total_failed"), worst.alias("overall"))
