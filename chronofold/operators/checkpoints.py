"""Checkpoints of projections: positions that only grow, start positions, gates, rebuilds by version."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Checkpoint:
    """How far a projection of some version has come."""

    projection_name: str
    global_position: int = 0
    version: int = 1
    updated_at: datetime | None = None

    def __post_init__(self) -> None:
        if not self.projection_name or self.global_position < 0 or self.version < 1:
            raise ValueError("a checkpoint has a name, a position of at least 0 and a version of at least 1")

    def advance_to(self, position: int) -> Checkpoint:
        if position < self.global_position:
            raise ValueError(f"{self.projection_name} is at {self.global_position}, past {position}")
        return replace(self, global_position=position, updated_at=datetime.now(UTC))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Checkpoints with new ones over them: a newer version replaces, within one the position only grows."""
    both = old.unionByName(new)
    top = both.groupBy("projection_name").agg(F.max("version").alias("version"))
    return both.join(top, ["projection_name", "version"]).groupBy("projection_name", "version").agg(F.max("global_position").alias("global_position"), F.max("updated_at").alias("updated_at"))


def listing(checkpoints: DataFrame) -> DataFrame:
    """All checkpoints by name."""
    return checkpoints.orderBy("projection_name")


def removed(checkpoints: DataFrame, names: DataFrame) -> DataFrame:
    """The checkpoints without those of some projections (projection_name), which then start afresh."""
    return checkpoints.join(names.select("projection_name"), "projection_name", "left_anti")


def start_positions(registered: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Where each registered projection (projection_name, version) goes on, and whether it rebuilds.

    A missing checkpoint starts at 0; one of another version too, after its data is cleared.
    """
    old = checkpoints.select("projection_name", "global_position", F.col("version").alias("old_version"))
    got = registered.join(old, "projection_name", "left")
    rebuild = F.col("old_version").isNotNull() & (F.col("old_version") != F.col("version"))
    start = F.when(F.col("old_version").isNull() | rebuild, F.lit(0).cast("bigint")).otherwise(F.col("global_position"))
    return got.select("projection_name", "version", start.alias("position"), rebuild.alias("rebuild"))


def minimum(positions: DataFrame) -> DataFrame:
    """The first event that any of the projections needs: 0 if one starts at 0, else the least position + 1."""
    least = F.coalesce(F.min("position"), F.lit(0).cast("bigint"))
    return positions.agg(F.when(least == 0, least).otherwise(least + 1).alias("start"), F.count("*").alias("projections"))


def pending(log: DataFrame, positions: DataFrame, types: DataFrame, start: int | None = None) -> DataFrame:
    """Events that each projection has yet to handle: subscribed type, beyond its position.

    positions has a row a projection and types (projection_name, event_type) a row a subscription;
    they describe code, so they are small. `start`, a literal, reaches the scan as a pushed filter.
    """
    log = log if start is None else log.where(F.col("global_nonce") >= start)
    wanted = types.join(positions, "projection_name")
    return log.join(F.broadcast(wanted), "event_type").where(F.col("global_nonce") > F.col("position"))


def advanced(positions: DataFrame, head: DataFrame) -> DataFrame:
    """Positions after a batch: each at the batch's last event, also where nothing was subscribed; never back."""
    return positions.crossJoin(F.broadcast(head)).withColumn("position", F.greatest("position", F.col("head"))).drop("head")
