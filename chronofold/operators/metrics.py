"""Counters, gauges, histograms, rates, quantiles, and their text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of buckets, in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
KEYS = ("name", "labels")


def _by_labels(samples: DataFrame) -> DataFrame:
    """Maps can't be keys; labels become text with sorted keys."""
    return samples.withColumn("labels", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("labels")))))


def counters(samples: DataFrame) -> DataFrame:
    """Sum of what was added, by name and labels; a counter never goes down, so negative samples are an error."""
    value = F.when(F.col("value") < 0, F.raise_error(F.lit("a counter only grows")).cast("double")).otherwise(F.col("value"))
    return _by_labels(samples.withColumn("value", value)).groupBy(*KEYS).agg(F.sum("value").alias("value"))


def gauges(samples: DataFrame) -> DataFrame:
    """A gauge's value: the last set (kind set) and what was added since (kind add)."""
    s = _by_labels(samples)
    last = s.where("kind = 'set'").groupBy(*KEYS).agg(F.max_by("value", "seq").alias("base"), F.max("seq").alias("at"))
    got = s.join(last, list(KEYS), "left")
    since = F.when((F.col("kind") == "add") & (F.col("seq") > F.coalesce("at", F.lit(-1))), F.col("value")).otherwise(0.0)
    return got.groupBy(*KEYS).agg((F.coalesce(F.max("base"), F.lit(0.0)) + F.sum(since)).alias("value"))


def histogram(samples: DataFrame, value: Column, keys: list[str], buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Cumulative counts (value <= le; le null is infinity), sum and count: one aggregation, then one row a bucket."""
    got = samples.groupBy(*keys).agg(*(F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(buckets)), F.count(value).alias("n"), F.sum(value).alias("total"))
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(buckets)]
    rows.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("n").alias("cumulative")))
    return got.select(*keys, "n", "total", F.explode(F.array(*rows)).alias("x")).select(*keys, "x.le", "x.cumulative", "n", "total")


def quantile(hist: DataFrame, q: float, keys: list[str]) -> DataFrame:
    """A quantile from cumulative buckets, linear within its bucket; the highest bound if it lies beyond."""
    w = Window.partitionBy(*keys).orderBy(F.col("le").asc_nulls_last())
    rank = F.lit(q) * F.col("n")
    got = hist.withColumns({"low": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "before": F.coalesce(F.lag("cumulative").over(w), F.lit(0).cast("bigint"))})
    hit = got.where((F.col("cumulative") >= rank) & (F.col("before") < rank))
    inside = F.col("low") + (F.col("le") - F.col("low")) * (rank - F.col("before")) / (F.col("cumulative") - F.col("before"))
    return hit.select(*keys, F.coalesce(inside, F.col("low")).alias("quantile"))


def rate(events: DataFrame, ts: str, keys: list[str], minutes: int = 5) -> DataFrame:
    """Events a second in each window of some minutes; on a stream, set a watermark on ts before."""
    got = events.groupBy(*keys, F.window(ts, f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n"))
    return got.select(*keys, F.col("w.start").alias("start"), "n", (F.col("n") / (60.0 * minutes)).alias("per_second"))


def sliding_rate(events: DataFrame, ts: str, keys: list[str], minutes: int = 5) -> DataFrame:
    """The rows with per_second: events a second of their keys over the minutes up to each, its own instant included.

    Time is cut into stretches of that length and an event is in its own and the next, which is all
    that an event's look back can reach; so a task has two stretches of a key, however long the log.
    """
    span = minutes * 60_000_000
    at = F.unix_micros(ts)
    own = events.withColumn("__at", at).withColumn("__next", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("__stretch", F.expr(f"(__at - pmod(__at, {span})) div {span}L") + F.col("__next"))
    w = Window.partitionBy(*keys, "__stretch").orderBy("__at").rangeBetween(1 - span, 0)
    return own.withColumn("per_second", F.count("*").over(w) / (60.0 * minutes)).where("__next = 0").drop("__at", "__next", "__stretch")


def _label_text(labels: Column) -> Column:
    """Labels sorted by name, without braces; backslashes, quotes and line ends escaped."""
    escaped = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), F.regexp_replace(F.regexp_replace(e["value"], r'([\\"])', r"\\$1"), "\n", r"\\n"), F.lit('"')))
    return F.array_join(escaped, ",")


def _braces(labels: Column) -> Column:
    return F.when(labels != "", F.concat(F.lit("{"), labels, F.lit("}"))).otherwise("")


def exposition(samples: DataFrame) -> DataFrame:
    """Prometheus text lines of (name, labels as a map, value)."""
    return samples.select(F.concat(F.col("name"), _braces(_label_text(F.col("labels"))), F.lit(" "), F.format_string("%s", "value")).alias("line"))


def headers(named: DataFrame) -> DataFrame:
    """HELP and TYPE lines of (name, help, type), one pair a name."""
    once = named.select("name", "help", "type").distinct()
    lines = F.array(F.concat_ws(" ", F.lit("# HELP"), "name", F.regexp_replace(F.regexp_replace("help", r"\\", r"\\\\"), "\n", r"\\n")), F.concat_ws(" ", F.lit("# TYPE"), "name", "type"))
    return once.select(F.explode(lines).alias("line"))


def histogram_exposition(hist: DataFrame, name: str, labels: Column) -> DataFrame:
    """Lines of a histogram() table: a cumulative _bucket a bound (+Inf last), _sum and _count. labels: a map from its keys."""
    own = hist.select(_label_text(labels).alias("l"), "le", "cumulative", "n", "total")
    bound = F.when(F.col("le").isNull(), "+Inf").otherwise(F.format_string("%s", F.col("le")))
    inside = F.concat(F.when(F.col("l") != "", F.concat(F.col("l"), F.lit(","))).otherwise(""), F.lit('le="'), bound, F.lit('"'))
    buckets = own.select(F.concat(F.lit(f"{name}_bucket{{"), inside, F.lit("} "), F.col("cumulative").cast("string")).alias("line"))
    whole = own.where("le is null")
    sums = whole.select(F.concat(F.lit(f"{name}_sum"), _braces(F.col("l")), F.lit(" "), F.format_string("%s", "total")).alias("line"))
    return buckets.union(sums).union(whole.select(F.concat(F.lit(f"{name}_count"), _braces(F.col("l")), F.lit(" "), F.col("n").cast("string")).alias("line")))


#: Names of the metrics of a log and its projections, with their types.
NAMES = {
    "es_events_appended_total": "counter",
    "es_events_append_duration_seconds": "histogram",
    "es_aggregate_load_duration_seconds": "histogram",
    "es_command_duration_seconds": "histogram",
    "es_projection_events_processed_total": "counter",
    "es_projection_lag_events": "gauge",
    "es_projection_errors_total": "counter",
    "es_projection_process_duration_seconds": "histogram",
    "es_dlq_size": "gauge",
    "es_retries_total": "counter",
}


def of_log(log: DataFrame, health: DataFrame) -> DataFrame:
    """Metrics of a log and its projections as samples (name, labels, value) under short names: events by type, lag, position, failures, status."""
    labels = F.create_map(F.lit("event_type"), F.col("event_type"))
    events = log.groupBy("event_type").agg(F.count("*").cast("double").alias("value")).select(F.lit("events_appended_total").alias("name"), labels.alias("labels"), "value")
    of = F.create_map(F.lit("projection"), F.col("projection_name"))
    up = F.when(F.col("status") == "unhealthy", 0.0).otherwise(1.0)
    rows = {"projection_lag": F.col("lag"), "projection_position": F.col("position"), "projection_failed_events": F.col("failed"), "projection_up": up}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), v.cast("double").alias("value")) for k, v in rows.items())))
    return events.unionByName(health.select(of.alias("labels"), each.alias("x")).select(F.col("x.name").alias("name"), "labels", F.col("x.value").alias("value")))


def standard(log: DataFrame, health: DataFrame, failed: DataFrame | None = None, handled: DataFrame | None = None) -> DataFrame:
    """Counters and gauges of NAMES that follow from tables, as samples (name, labels, value).

    From the log: events by type. From health (projection_name, lag, failed): lag, size of the dead-letter
    table. From failed (dead letters with attempts): errors and retries. From handled (a row an event that
    a projection handled): events processed. Durations come from samples by way of histogram().
    """
    by_type = F.create_map(F.lit("event_type"), F.col("event_type"))
    of = F.create_map(F.lit("projection"), F.col("projection_name"))

    def each(rows: DataFrame, name: str, labels: Column, value: Column) -> DataFrame:
        return rows.select(F.lit(name).alias("name"), labels.alias("labels"), value.cast("double").alias("value"))

    got = each(log.groupBy("event_type").agg(F.count("*").alias("n")), "es_events_appended_total", by_type, F.col("n"))
    got = got.union(each(health, "es_projection_lag_events", of, F.col("lag"))).union(each(health, "es_dlq_size", of, F.col("failed")))
    if failed is not None:
        sums = failed.groupBy("projection_name").agg(F.count("*").alias("n"), F.sum(F.col("attempts") - 1).alias("again"))
        got = got.union(each(sums, "es_projection_errors_total", of, F.col("n"))).union(each(sums, "es_retries_total", of, F.col("again")))
    if handled is not None:
        got = got.union(each(handled.groupBy("projection_name").agg(F.count("*").alias("n")), "es_projection_events_processed_total", of, F.col("n")))
    return got
