"""The architecture graph: edges from a manifest, flows, cycles, rules over files and imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shape of a manifest's domain part.
MANIFEST = (
    "struct<version:string,contexts:array<struct<name:string,features:array<string>>>,domain:struct<"
    "aggregates:array<struct<name:string,context:string,command_handlers:array<struct<command_type:string,method_name:string,line_number:int,emits_events:array<string>>>,"
    "event_handlers:array<struct<event_type:string,method_name:string,line_number:int>>>>,"
    "commands:array<struct<name:string,target_aggregate:string>>,events:array<struct<name:string,version:string>>,"
    "projections:array<struct<name:string,subscribed_events:array<string>,read_model:string>>>>"
)


def parse_manifest(texts: DataFrame, column: str = "text") -> DataFrame:
    """Manifests as structs; ok is whether the text is JSON and has a version."""
    m = F.from_json(column, MANIFEST)
    return texts.withColumn("manifest", m).withColumn("ok", F.col("manifest.version").isNotNull())


def edges(manifests: DataFrame) -> DataFrame:
    """Relations (src, dst, kind) of a manifest: command -> aggregate -> event -> handler, event -> projection -> read model."""
    d = manifests.select("manifest.domain.*")
    handler = d.select(F.explode("aggregates").alias("a")).select("a.name", F.explode("a.command_handlers").alias("h"))
    one = handler.select(F.col("h.command_type").alias("src"), F.col("name").alias("dst"), F.lit("command").alias("kind"))
    two = handler.select(F.col("name").alias("src"), F.explode("h.emits_events").alias("dst"), F.lit("emits").alias("kind"))
    reacts = d.select(F.explode("aggregates").alias("a")).select("a.name", F.explode("a.event_handlers").alias("h"))
    three = reacts.select(F.col("h.event_type").alias("src"), F.col("name").alias("dst"), F.lit("handled").alias("kind"))
    p = d.select(F.explode("projections").alias("p"))
    four = p.select(F.explode("p.subscribed_events").alias("src"), F.col("p.name").alias("dst"), F.lit("projected").alias("kind"))
    five = p.where("p.read_model is not null").select(F.col("p.name").alias("src"), F.col("p.read_model").alias("dst"), F.lit("read model").alias("kind"))
    return one.union(two).union(three).union(four).union(five).distinct()


def relation_maps(e: DataFrame) -> DataFrame:
    """For each source and kind its targets, sorted."""
    return e.groupBy("kind", "src").agg(F.array_sort(F.collect_set("dst")).alias("targets"))


def flows(e: DataFrame) -> DataFrame:
    """Events that pass from the aggregate that emits them to another that handles them."""
    out = e.where("kind = 'emits'").select(F.col("src").alias("emitter"), F.col("dst").alias("event"))
    into = e.where("kind = 'handled'").select(F.col("src").alias("event"), F.col("dst").alias("handler"))
    return out.join(into, "event").where("emitter <> handler").select("emitter", "event", "handler").distinct()


def unhandled(e: DataFrame) -> DataFrame:
    """Emitted events that nothing handles or projects."""
    used = e.where("kind in ('handled', 'projected')").select(F.col("src").alias("event"))
    return e.where("kind = 'emits'").select(F.col("dst").alias("event")).distinct().join(used, "event", "left_anti")


def cycles(spark: SparkSession, links: DataFrame) -> DataFrame:
    """Simple cycles in (src, dst), each once, written from its smallest node.

    No path is longer than there are nodes; Spark raises an error at its own limit of rows.
    """
    links.select("src", "dst").distinct().createOrReplaceTempView("__links")
    nodes = links.select("src").distinct().count()
    return spark.sql(
        f"""WITH RECURSIVE walk(start, at, path) MAX RECURSION LEVEL {nodes + 1} AS (
              SELECT src, dst, array(src) FROM __links WHERE dst >= src
              UNION ALL SELECT w.start, l.dst, array_append(w.path, l.src) FROM walk w JOIN __links l ON l.src = w.at
                        WHERE w.at <> w.start AND l.dst >= w.start AND NOT array_contains(w.path, l.src))
            SELECT array_join(path, ' -> ') AS cycle, size(path) AS n FROM walk WHERE at = start"""
    )


def reachable(spark: SparkSession, links: DataFrame) -> DataFrame:
    """Pairs (src, dst) with a way from one to the other. Each round joins only what is new, until nothing is."""
    now = links.select("src", "dst").distinct()
    new = now
    while True:
        step = new.join(links.select(F.col("src").alias("dst"), F.col("dst").alias("to")), "dst").select("src", F.col("to").alias("dst")).distinct()
        new = step.join(now, ["src", "dst"], "left_anti").checkpoint() if spark.sparkContext.getCheckpointDir() else step.join(now, ["src", "dst"], "left_anti").cache()
        if new.isEmpty():
            break
        now = now.union(new)
    return now


def classify_contexts(contexts: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Contexts with aggregates are bounded contexts; others are modules."""
    n = aggregates.groupBy("context").agg(F.count("*").alias("n_aggregates"))
    got = contexts.join(n, "context", "left").fillna({"n_aggregates": 0})
    return got.withColumn("kind", F.when(F.col("n_aggregates") > 0, "bounded context").otherwise("module"))


def statistics(e: DataFrame) -> DataFrame:
    """Number of relations and of different sources and targets, by kind."""
    return e.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


def duplicates(named: DataFrame, name: str, by: str) -> DataFrame:
    """Names that more than one has: integration events with several publishers, projections registered twice."""
    got = named.groupBy(name).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(by)).alias("who"))
    return got.where("n > 1")


def is_list_projection(name: Column) -> Column:
    return F.contains(F.lower(name), F.lit("list"))


def is_by_id(query: Column) -> Column:
    return query.rlike("(?i)(?:byid|get[A-Z]?\\w*byid)|ById$")


def export(manifests: DataFrame, pretty: bool = True) -> DataFrame:
    """Manifests as JSON text."""
    return manifests.select(F.to_json("manifest", {"pretty": "true"} if pretty else {}).alias("json"))


def versions(named: DataFrame) -> DataFrame:
    """Different versions of each event, sorted as text (so v10 comes before v2), and the latest by number."""
    number = F.coalesce(F.regexp_extract("version", "([0-9]+)", 1).try_cast("int"), F.lit(0))
    return named.groupBy("name").agg(F.array_sort(F.collect_set("version")).alias("versions"), F.max_by("version", number).alias("latest"))
