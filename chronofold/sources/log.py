"""Reading a log: streams, the global order, pages, heads, subscriptions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.functions import values

#: Page size of the global log if none is asked for, and the most that one page has.
DEFAULT_PAGE, LARGEST_PAGE = 100, 1000


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events table as a log. `amount` is in cents; `user_id` is the stream's number.

    global_nonce needs no sort, as event_id is dense; aggregate_nonce is a row number in each stream.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    nonce = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint")
    return e.select(
        F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string")).alias("tenant_id"),
        F.concat(F.lit("User-"), F.col("user_id").cast("string")).alias("aggregate_id"),
        F.lit("User").alias("aggregate_type"),
        nonce.alias("aggregate_nonce"),
        (F.col("event_id") + 1).alias("global_nonce"),
        F.col("event_id").cast("string").alias("event_id"),
        "event_type",
        F.lit(1).alias("event_version"),
        values.ms_of(F.col("ts")).alias("timestamp_unix_ms"),
        F.col("props").alias("payload"),
        values.cents(F.col("value")).alias("amount"),
        "user_id",
    )


def without_nonce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without aggregate_nonce, for reads that need only the global order: no shuffle."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string")).alias("tenant_id"),
        F.concat(F.lit("User-"), F.col("user_id").cast("string")).alias("aggregate_id"),
        (F.col("event_id") + 1).alias("global_nonce"),
        "event_type",
        values.ms_of(F.col("ts")).alias("timestamp_unix_ms"),
        F.col("props").alias("payload"),
        values.cents(F.col("value")).alias("amount"),
        "user_id",
    )


def read_stream(log: DataFrame, tenant: str, aggregate_id: str, start: int | None = None, limit: int = 0, forward: bool = True) -> DataFrame:
    """One stream: forward from `start` (1 at least), backward from `start` (None: its head). limit 0: no limit."""
    own = log.where((F.col("tenant_id") == tenant) & (F.col("aggregate_id") == aggregate_id))
    nonce = F.col("aggregate_nonce")
    if forward:
        own = own.where(nonce >= max(start or 1, 1)).orderBy(nonce)
    else:
        own = (own if start is None else own.where(nonce <= start)).orderBy(nonce.desc())
    return own.limit(limit) if limit else own


def read_all(log: DataFrame, tenant: str, start: int | None = None, max_count: int = 0, forward: bool = True) -> DataFrame:
    """A page of a tenant's events in global order; max_count 0 is DEFAULT_PAGE, LARGEST_PAGE at most."""
    own, nonce = log.where(F.col("tenant_id") == tenant), F.col("global_nonce")
    if forward:
        own = own.where(nonce >= (start or 0)).orderBy(nonce)
    else:
        own = (own if start is None else own.where(nonce <= start)).orderBy(nonce.desc())
    return own.limit(page_size(max_count))


def page_size(max_count: int) -> int:
    return min(LARGEST_PAGE, max_count or DEFAULT_PAGE)


@dataclass(frozen=True)
class Page:
    """A page's rows, whether it is the last, and where the next starts."""

    events: list[Row]
    is_end: bool
    next_from: int | None


def page_all(log: DataFrame, tenant: str, start: int | None = None, max_count: int = 0, forward: bool = True) -> Page:
    """A page with its cursor. A full last page says that it isn't the end; an empty one follows.

    Backward pages go on below the last row, so pages don't overlap.
    """
    rows = read_all(log, tenant, start, max_count, forward).collect()  # LARGEST_PAGE rows at most
    following = start if not rows else rows[-1]["global_nonce"] + 1 if forward else max(0, rows[-1]["global_nonce"] - 1)
    return Page(rows, len(rows) < page_size(max_count), following)


def page_stream(log: DataFrame, tenant: str, aggregate_id: str, start: int | None = None, limit: int = DEFAULT_PAGE, forward: bool = True) -> Page:
    """A page of one stream; the end is known from the stream's head."""
    rows = read_stream(log, tenant, aggregate_id, start, limit, forward).collect()
    if not rows:
        return Page([], True, start)
    last = rows[-1]["aggregate_nonce"]
    if not forward:
        return Page(rows, last <= 1, last - 1)
    top = head(log.where((F.col("tenant_id") == tenant) & (F.col("aggregate_id") == aggregate_id)), "aggregate_nonce")
    return Page(rows, last >= top, last + 1)


def page_cursors(log: DataFrame, size: int, partition: list[str], order: str) -> DataFrame:
    """All pages of all streams at once: page, first, last, n, is_end, next_from. Pages of equal size by row number."""
    w = Window.partitionBy(*partition)
    numbered = log.withColumn("page", ((F.row_number().over(w.orderBy(order)) - 1) / size).cast("bigint"))
    pages = numbered.groupBy(*partition, "page").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    return pages.withColumn("is_end", F.col("n") < size).withColumn("next_from", F.col("last") + 1)


def head(log: DataFrame, column: str = "global_nonce") -> int:
    """Position of the last event; 0 for an empty log."""
    return log.agg(F.coalesce(F.max(column), F.lit(0)).alias("h")).first()["h"]


def heads(log: DataFrame) -> DataFrame:
    """Each stream's head, its last event's type and position, and its number of events."""
    return log.groupBy("tenant_id", "aggregate_id").agg(
        F.max("aggregate_nonce").alias("head"), F.max_by("event_type", "aggregate_nonce").alias("last_type"), F.max("global_nonce").alias("last_global"), F.count("*").alias("n_events")
    )


def exists(log: DataFrame, tenant: str, aggregate_id: str) -> bool:
    return bool(log.where((F.col("tenant_id") == tenant) & (F.col("aggregate_id") == aggregate_id)).limit(1).count())


def existing(names: DataFrame, log: DataFrame) -> DataFrame:
    """Those of the named streams (tenant_id, aggregate_id) that have events."""
    return names.join(log.select("tenant_id", "aggregate_id"), ["tenant_id", "aggregate_id"], "left_semi")


def subscription(log: DataFrame, tenant: str, start: int = 0, prefix: str = "", types: list[str] | None = None, exclusive: bool = False) -> DataFrame:
    """What a subscriber sees, for batches and streams: position from `start` on, ids by literal prefix, types (None: all)."""
    own = log.where(F.col("tenant_id") == tenant)
    own = own.where(F.col("global_nonce") > start) if exclusive else own.where(F.col("global_nonce") >= start)
    own = own.where(F.startswith(F.col("aggregate_id"), F.lit(prefix))) if prefix else own
    return own if types is None else own.where(F.col("event_type").isin(list(types)))


def gaps(log: DataFrame, by: Column | None = None) -> DataFrame:
    """Events whose nonce is not the one before plus 1 (the first: not 1): previous and nonce."""
    order = F.col("aggregate_nonce") if by is None else by
    before = F.coalesce(F.lag(order).over(Window.partitionBy("tenant_id", "aggregate_id").orderBy(order)), F.lit(0).cast("bigint"))
    return log.withColumn("previous", before).where(order != F.col("previous") + 1)
