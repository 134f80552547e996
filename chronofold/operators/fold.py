"""Folding streams into state.

A fold has an initial state, a step for each event type, and leaves other types alone. fold() is the
general form, a left fold over each stream's events in order. Where a fold has an algebraic form
(sums, latest, resets, clamped counters) the functions below it are plain aggregations and windows,
which combine on the map side and spill; each is checked against the general form in the tests.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

Step = Callable[[Column, Column], Column]


def dispatch(handlers: dict[str, Step], event_type: str = "event_type") -> Step:
    """A step that goes by event type; unknown types leave the state as it is."""

    def step(state: Column, e: Column) -> Column:
        return reduce(lambda rest, h: F.when(e[event_type] == h[0], h[1](state, e)).otherwise(rest), handlers.items(), state)

    return step


def fold(log: DataFrame, keys: list[str], order: str, fields: list[str], initial: Column, step: Step, up_to: int | None = None) -> DataFrame:
    """State of each stream after its events in order (or those up to a nonce), and its version.

    Collects a stream's fields, so it is for streams that fit a row; use the forms below for others.
    """
    log = log if up_to is None else log.where(F.col(order) <= up_to)
    events = log.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *(f for f in fields if f != order)))).alias("__events"))
    state = F.aggregate("__events", initial, step)
    return events.select(*keys, state.alias("state"), F.element_at("__events", -1)[order].alias("version"))


def history(log: DataFrame, keys: list[str], order: str, fields: list[str], initial: Column, step: Step, block: int = 256) -> DataFrame:
    """State after each event of each stream (step-by-step replay): one general fold a stream that carries the states.

    Collects a stream's rows, like fold(); running_sum() and by_stream() are for streams that don't fit
    a row. The states are gathered a block at a time, so that adding one doesn't copy all before it.
    """
    rest = [c for c in log.columns if c not in keys]
    by_order = F.array_sort(F.collect_list(F.struct(*rest)), lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0))
    streams = log.groupBy(*keys).agg(by_order.alias("__events"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("__events") - 1) / block).cast("int")), lambda i: F.slice("__events", i * block + 1, F.lit(block)))

    def last(a: Column) -> Column:
        return F.element_at(a, -1)

    def replay(done: Column, events: Column) -> Column:
        states = F.aggregate(events, F.array(last(last(done))), lambda out, e: F.concat(out, F.array(step(last(out), e))))
        return F.concat(done, F.array(states))

    # each block begins with the state before it
    states = F.aggregate(blocks, F.array(F.array(initial)), replay)
    states = F.flatten(F.transform(states, lambda b: F.slice(b, F.lit(2), F.size(b))))
    rows = streams.select(*keys, F.explode(F.arrays_zip("__events", states.alias("__states"))).alias("__x"))
    return rows.select(*keys, "__x.__events.*", F.col("__x.__states").alias("state")).select(*log.columns, "state")


def by_stream(keys: list[str], order: str = "global_nonce") -> WindowSpec:
    """All events of a stream so far."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def segment(log: DataFrame, keys: list[str], starts: Column, order: str = "global_nonce", name: str = "segment") -> DataFrame:
    """Numbers the stretches of a stream that begin with an event of a kind; 0 before the first."""
    return log.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(by_stream(keys, order)))


def last_segment(log: DataFrame, keys: list[str], starts: Column, order: str = "global_nonce") -> DataFrame:
    """A stream's events from the last one that starts afresh; streams without one are left out.

    Needs no window: the start is an aggregate, joined back.
    """
    begin = log.where(starts).groupBy(*keys).agg(F.max(order).alias("__begin"))
    return log.join(begin, keys).where(F.col(order) >= F.col("__begin")).drop("__begin")


def running_sum(log: DataFrame, keys: list[str], signed: Column, order: str = "global_nonce", name: str = "running") -> DataFrame:
    return log.withColumn(name, F.sum(signed).over(by_stream(keys, order)))


def clamped_count(log: DataFrame, keys: list[str], change: Column, order: str = "global_nonce", name: str = "clamped", stretch: int = 1_000_000) -> DataFrame:
    """Running counter that never goes below 0: n <- max(0, n + change).

    By the identity n_t = S_t - min(0, S_1, ..., S_t) over running sums S. It is applied twice, so
    that a key with most of the rows is no single task: within stretches of the order, and over one
    row a stretch (its sum and its least running sum), which gives the counter that each starts with.
    """
    part = [*keys, "__stretch"]
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.lit(0).cast("bigint")
    rows = log.withColumn("__stretch", F.floor(F.col(order) / stretch)).withColumn("__sum", F.sum(change).over(w)).withColumn("__low", F.least(zero, F.min("__sum").over(w)))
    each = rows.groupBy(*part).agg(F.max_by("__sum", order).alias("total"), F.min("__low").alias("low"))
    earlier = Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("before", F.coalesce(F.sum("total").over(earlier), zero))
    start = F.col("before") - F.least(zero, F.coalesce(F.min(F.col("before") + F.col("low")).over(earlier), zero))
    starts = each.select(*part, start.alias("__start"))
    got = rows.join(starts, part)
    return got.withColumn(name, F.col("__sum") + F.greatest("__start", -F.col("__low"))).drop("__stretch", "__sum", "__low", "__start")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key. The rank is limited before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def snapshots(log: DataFrame, keys: list[str], every: int = 1000, order: str = "aggregate_nonce") -> DataFrame:
    """Last event of each `every` events of a stream: where snapshots stand."""
    got = log.groupBy(*keys, F.floor((F.col(order) - 1) / every).alias("snapshot"))
    return got.agg(F.max(order).alias("version"), F.max_by("event_type", order).alias("event_type"))


def violations(log: DataFrame, states: Column, invariant: Column, keys: list[str], order: str = "global_nonce") -> DataFrame:
    """Events after which a running state breaks an invariant; states is a window expression named `state`."""
    return log.withColumn("state", states).where(~invariant).select(*keys, order, "event_type", "state")


def catching_up(log: DataFrame, boundary: int, order: str = "global_nonce") -> Column:
    """Whether an event comes before going live: up to the boundary. In global order the switch happens once, so it needs no window."""
    return F.col(order) <= boundary
