"""Rules over a source tree: files, the imports in them, and what may depend on what.

Files are (path, text). A rule gives violations (rule, severity, path, message); a report is valid
if none is an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.operators import graph

#: Folder names of layers, and which layer may not import which.
LAYERS = {"domain": "domain", "application": "application", "infrastructure": "infrastructure", "slices": "slices", "ports": "ports", "events": "events"}
FORBIDDEN = [("domain", "infrastructure"), ("domain", "application"), ("domain", "slices"), ("application", "infrastructure"), ("events", "domain"), ("events", "infrastructure")]

#: Forms of import statements.
_IMPORT = r"""(?m)^\s*(?:import\s+(?:[^'";]*?\s+from\s+)?['"]([^'"]+)['"]|from\s+([\w.]+)\s+import|use\s+([\w:]+))"""
_CLASSES = {
    "aggregate": r"(?m)^\s*(?:@aggregate[^\n]*\n\s*)?(?:export\s+)?class\s+(\w+Aggregate)\b",
    "command": r"(?m)^\s*(?:export\s+)?class\s+(\w+Command)\b",
    "event": r"(?m)^\s*(?:export\s+)?class\s+(\w+Event)\b",
    "query": r"(?m)^\s*(?:export\s+)?class\s+(\w+Query)\b",
    "projection": r"(?m)^\s*(?:export\s+)?class\s+(\w+Projection)\b",
    "upcaster": r"(?m)^\s*(?:export\s+)?class\s+(\w+Upcaster)\b",
}


def layer(path: Column) -> Column:
    """The layer whose folder comes first in a path; null without one."""
    return reduce(lambda rest, kv: F.when(path.rlike(f"(?:^|[/.:]){kv[0]}(?:[/.:]|$)"), kv[1]).otherwise(rest), reversed(LAYERS.items()), F.lit(None).cast("string"))


def context(path: Column) -> Column:
    """The folder below contexts/; null outside."""
    return F.nullif(F.regexp_extract(path, r"(?:^|/)contexts/([^/]+)/", 1), F.lit(""))


def feature(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"(?:^|/)slices/([^/]+)/", 1), F.lit(""))


def imports(files: DataFrame) -> DataFrame:
    """One row an import: path, target."""
    found = F.array_compact(F.transform(F.regexp_extract_all("text", F.lit(_IMPORT), F.lit(0)), lambda m: F.coalesce(*(F.nullif(F.regexp_extract(m, _IMPORT, i), F.lit("")) for i in (1, 2, 3)))))
    return files.select("path", F.explode(found).alias("target"))


def components(files: DataFrame) -> DataFrame:
    """Classes by what they are: path, kind, name, context, feature."""
    got = [files.select("path", F.lit(k).alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(r), F.lit(1))).alias("name")) for k, r in _CLASSES.items()]
    return reduce(DataFrame.union, got).withColumns({"context": context(F.col("path")), "feature": feature(F.col("path"))})


def _violation(rows: DataFrame, rule: str, severity: str, message: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "path", message.alias("message"))


def forbidden_imports(files: DataFrame) -> DataFrame:
    """Imports from a layer into one that it must not know."""
    got = imports(files).withColumns({"a": layer(F.col("path")), "b": layer(F.col("target"))})
    bad = reduce(lambda x, y: x | y, ((F.col("a") == a) & (F.col("b") == b) for a, b in FORBIDDEN))
    return _violation(got.where(bad), "layer-dependency", "error", F.concat_ws(" ", F.col("a"), F.lit("imports"), F.col("b"), F.col("target")))


def crossing_contexts(files: DataFrame) -> DataFrame:
    """Imports from one context into another, other than of its integration events."""
    got = imports(files).withColumns({"a": context(F.col("path")), "b": F.nullif(F.regexp_extract("target", r"(?:^|/)contexts/([^/]+)", 1), F.lit(""))})
    return _violation(got.where("a <> b and target not like '%integration-events%'"), "context-isolation", "error", F.concat_ws(" ", F.col("a"), F.lit("imports"), F.col("b")))


def crossing_slices(files: DataFrame) -> DataFrame:
    """Imports from one slice into another."""
    got = imports(files).withColumns({"a": feature(F.col("path")), "b": F.nullif(F.regexp_extract("target", r"(?:^|/)slices/([^/]+)", 1), F.lit(""))})
    return _violation(got.where("a <> b"), "slice-isolation", "error", F.concat_ws(" ", F.col("a"), F.lit("imports"), F.col("b")))


def misplaced(files: DataFrame) -> DataFrame:
    """Classes outside the folder of their kind."""
    homes = {"aggregate": "/domain/", "command": "/(?:domain/commands|slices)/", "event": "/(?:domain/events|events)/", "query": "/slices/", "projection": "/slices/"}
    where = reduce(lambda x, kv: x | ((F.col("kind") == kv[0]) & ~F.concat(F.lit("/"), F.col("path")).rlike(kv[1])), homes.items(), F.lit(False))
    return _violation(components(files).where(where), "location", "warning", F.concat_ws(" ", F.col("kind"), F.col("name"), F.lit("is out of place")))


def query_without_projection(files: DataFrame) -> DataFrame:
    """Slices that hold a query but no projection."""
    c = components(files)
    have = c.where("kind = 'projection'").select("feature")
    return _violation(c.where("kind = 'query' and feature is not null").join(have, "feature", "left_anti"), "query-slice", "error", F.concat(F.lit("no projection beside "), F.col("name")))


def untested(files: DataFrame) -> DataFrame:
    """Slices without a test file."""
    with_feature = files.withColumn("feature", feature(F.col("path"))).where("feature is not null")
    tested = with_feature.where(F.col("path").rlike(r"(?:\.test\.|\.spec\.|/test_|_test\.)")).select("feature")
    rows = with_feature.join(tested, "feature", "left_anti").groupBy("feature").agg(F.min("path").alias("path"))
    return _violation(rows, "tests", "warning", F.concat(F.lit("no test in "), F.col("feature")))


def unversioned_events(files: DataFrame) -> DataFrame:
    """Event classes in files that state no version."""
    got = components(files).where("kind = 'event'").join(files, "path").where(~F.col("text").rlike(r"""(?:version|@event\()[^\n]*['"]?(?:v\d+|\d+\.\d+\.\d+)"""))
    return _violation(got, "event-version", "warning", F.concat(F.lit("no version of "), F.col("name")))


def shared_publishers(files: DataFrame) -> DataFrame:
    """Integration events that more than one context publishes."""
    own = components(files.where("path like '%integration-events%'")).where("kind = 'event'")
    many = own.groupBy("name").agg(F.count_distinct("context").alias("n"), F.min("path").alias("path")).where("n > 1")
    return _violation(many, "integration-events", "error", F.concat(F.lit("several publishers of "), F.col("name")))


RULES = (forbidden_imports, crossing_contexts, crossing_slices, misplaced, query_without_projection, untested, unversioned_events, shared_publishers)


def check(files: DataFrame) -> DataFrame:
    """Violations of all rules."""
    return reduce(DataFrame.union, (r(files) for r in RULES))


def report(violations: DataFrame) -> DataFrame:
    """errors, warnings, and whether there is no error."""
    return violations.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")).withColumn("is_valid", F.col("errors") == 0)


# Rules by code. A tree is judged by codes, without a configuration; what a rule looks for is in its docstring.

#: Folders, from the outermost layer in. A layer may import only from those after it.
ORDER = ("infrastructure", "slices", "application", "ports", "domain", "events")
#: Kinds of classes and interfaces, by name.
KINDS = {
    "aggregate": r"class\s+(\w+Aggregate)\b", "command": r"class\s+(\w+Command)\b", "event": r"class\s+(\w+Event)\b", "query": r"class\s+(\w+Query)\b",
    "projection": r"class\s+(\w+Projection)\b", "handler": r"class\s+(\w+Handler)\b", "bus": r"class\s+(\w+Bus)\b", "port": r"interface\s+(\w+)\b",
    "process manager": r"class\s+(\w+ProcessManager)\b", "class": r"class\s+(\w+)\b",
}
#: Subfolders that _shared may have; libraries by which code reaches outside; lines of a thin adapter; folders below a slice.
SHARED, OUTSIDE, THIN, DEEPEST = ("integration-events", "types", "utils"), ("axios", "requests", "fs", "http", "pg", "node-fetch"), 50, 3


def resolved(path: Column, target: Column) -> Column:
    """The path that an import means: relative ones joined to the importing file's folder, `.` and `..` taken out."""
    parts = F.split(F.concat(F.regexp_extract(path, "^(.*/)?", 0), target), "/")
    none = F.array().cast("array<string>")
    walked = F.aggregate(parts, none, lambda out, p: F.when((p == "") | (p == "."), out).when(p == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p))))
    return F.when(target.startswith("."), F.array_join(walked, "/")).otherwise(target)


def declared(files: DataFrame) -> DataFrame:
    """Classes and interfaces with path, kind, name, line, context, layer and slice."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    found = [lines.select("path", F.lit(k).alias("kind"), F.regexp_extract("line", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?{r}", 1).alias("name"), (F.col("at") + 1).alias("line")) for k, r in KINDS.items()]
    return reduce(DataFrame.union, found).where("name <> ''").withColumns({"context": context(F.col("path")), "layer": layer(F.col("path")), "slice": feature(F.col("path"))})


def linked(files: DataFrame) -> DataFrame:
    """Imports with what they mean: path, target (resolved), and context, layer and slice of both ends."""
    got = imports(files).withColumn("target", resolved(F.col("path"), F.col("target")))
    ends = {f"{n}_{s}": f(F.concat(F.col(c), F.lit("/"))) for n, c in (("from", "path"), ("to", "target")) for s, f in (("context", context), ("layer", layer), ("slice", feature))}
    return got.withColumns(ends)


def _coded(rows: DataFrame, code: str, message: Column, severity: str = "error") -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "path", message.cast("string").alias("message"))


def _lacking(d: DataFrame, kind: str, beside: str, code: str, severity: str = "error") -> DataFrame:
    """Classes of a kind in a slice that has none of another."""
    have = d.where(F.col("kind") == beside).select("context", "slice").distinct()
    own = d.where((F.col("kind") == kind) & F.col("slice").isNotNull())
    lone = own.join(have.withColumnsRenamed({"context": "c", "slice": "s"}), F.col("context").eqNullSafe(F.col("c")) & (F.col("slice") == F.col("s")), "left_anti")
    return _coded(lone, code, F.concat(F.lit(f"no {beside} beside "), F.col("name")), severity)


def _slices(files: DataFrame, d: DataFrame, links: DataFrame) -> list[DataFrame]:
    """VSA001 to VSA015: what a slice holds, how it is named, what it reaches."""
    text, path = F.col("text"), F.col("path")
    base = F.regexp_extract("path", r"([^/]+?)(?:\.\w+)*$", 1)
    subscribed = r"(?i)\bon_?[a-z]\w*\s*\(|subscri|@event_?handler|\bwhen\s*\(|handles?\s*\("
    own = d.where("kind = 'projection'").join(files, "path")
    adapters = files.where(base.rlike("(?:Controller|Adapter|Cli)$") & feature(path).isNotNull())
    below = F.size(F.split(F.regexp_extract("path", r"(?:^|/)slices/[^/]+/(.*)$", 1), "/")) - 1
    of = files.select("path", context(path).alias("context"), feature(path).alias("slice")).where("slice is not null")
    tests = of.where(path.rlike(r"(?:\.test\.|\.spec\.|/test_|_test\.)")).select(F.col("context").alias("c"), F.col("slice").alias("s")).distinct()
    bare = of.join(tests, F.col("context").eqNullSafe(F.col("c")) & (F.col("slice") == F.col("s")), "left_anti").groupBy("context", "slice").agg(F.min("path").alias("path"))
    outside = links.where("from_slice is not null and to_slice is not null and (from_slice <> to_slice or not (from_context <=> to_context))")
    return [
        _coded(bare, "VSA001", F.concat(F.lit("no test in "), F.col("slice")), "warning"),
        _lacking(d, "command", "handler", "VSA002"),
        _lacking(d, "command", "event", "VSA003", "warning"),
        _coded(d.where("slice is not null and kind <> 'class' and kind <> 'port'").where(~base.rlike("^[A-Z][A-Za-z0-9]*$")).select("path").distinct(), "VSA004", F.concat(F.lit("not in PascalCase: "), base), "warning"),
        _coded(files.where(below > DEEPEST), "VSA005", F.concat(below.cast("string"), F.lit(" folders below its slice")), "warning"),
        _coded(files.where(path.rlike("(?:^|/)_shared/") & ~path.rlike(rf"(?:^|/)_shared/(?:{'|'.join(SHARED)})/")), "VSA006", F.lit("not in a known folder of _shared"), "warning"),
        _lacking(d, "query", "projection", "VSA007"),
        _lacking(d, "query", "handler", "VSA008"),
        _coded(own.where(~text.rlike(subscribed)), "VSA009", F.concat(F.col("name"), F.lit(" handles no event"))),
        _coded(outside, "VSA010", F.concat_ws(" ", F.col("from_slice"), F.lit("imports"), F.col("to_slice"))),
        _coded(adapters.where(F.size(F.split(text, "\n")) > THIN), "VSA011", F.lit(f"an adapter of over {THIN} lines"), "warning"),
        _coded(d.where("kind = 'handler' and slice is null and name rlike '(Command|Query)Handler$'"), "VSA015", F.concat(F.col("name"), F.lit(" is in no slice"))),
    ]


def _structure(files: DataFrame, d: DataFrame, links: DataFrame) -> list[DataFrame]:
    """VSA020 to VSA027: where each kind lives and how it is named."""
    slashed = F.concat(F.lit("/"), F.col("path"))
    named = F.concat(F.col("kind"), F.lit(" "), F.col("name"))

    def homeless(kind: str, home: str, code: str, more: str = "true") -> DataFrame:
        return _coded(d.where((F.col("kind") == kind) & ~slashed.rlike(home)).where(more), code, F.concat(named, F.lit(" is out of place")))

    return [
        homeless("command", "/domain/commands/", "VSA020"),
        homeless("event", "/(?:domain/events|events|integration-events)/", "VSA021"),
        homeless("aggregate", "/domain/", "VSA022"),
        homeless("port", "/ports/", "VSA023", "name like '%Port'"),
        homeless("bus", "/infrastructure/", "VSA024"),
        _coded(d.where((F.col("kind") == "port") & slashed.rlike("/ports/") & ~F.col("name").endswith("Port")), "VSA025", F.concat(F.col("name"), F.lit(" doesn't end in Port"))),
        _coded(d.where((F.col("kind") == "class") & slashed.rlike("/value-objects/") & ~F.col("path").rlike(r"(?:ValueObjects?|\.vo)\.\w+$")), "VSA026", F.concat(F.col("name"), F.lit(" is in a file not named for value objects")), "warning"),
        _coded(d.where((F.col("kind") == "aggregate") & slashed.rlike("/domain/") & ~slashed.rlike("/domain/aggregate_[^/]+/")), "VSA027", F.concat(F.col("name"), F.lit(" is in no folder aggregate_*")), "warning"),
    ]


def _dependencies(files: DataFrame, d: DataFrame, links: DataFrame) -> list[DataFrame]:
    """VSA027 to VSA033 and VSA206: what each layer and kind may import."""
    said = F.concat_ws(" ", F.col("from_layer"), F.lit("imports"), F.coalesce("to_layer", F.col("target")))
    library = F.col("target").isin(*OUTSIDE)

    def only(of: str, allowed: tuple[str, ...], code: str) -> DataFrame:
        return _coded(links.where((F.col("from_layer") == of) & (~F.col("to_layer").isin(*allowed) | library)), code, said)

    rank = {x: i for i, x in enumerate(ORDER)}
    above = reduce(lambda a, b: a | b, ((F.col("from_layer") == x) & (F.col("to_layer") == y) for x in ORDER for y in ORDER if rank[y] < rank[x]))
    projecting = links.join(d.where("kind = 'projection'").select("path").distinct(), "path", "left_semi")
    managers = d.where("kind = 'process manager'").join(files, "path")
    whole = F.col("text").rlike(r"(?i)process_?pending") & F.col("text").rlike(r"(?i)handle_?event|to_?do")
    return [
        only("domain", ("domain", "events"), "VSA027"),
        only("events", ("events",), "VSA028"),
        only("ports", ("ports", "domain", "events"), "VSA029"),
        only("application", ("application", "ports", "domain", "events"), "VSA030"),
        _coded(links.where("from_layer = 'slices' and to_layer = 'infrastructure'"), "VSA031", said),
        _coded(projecting.where((F.col("to_layer") == "infrastructure") | library | F.col("target").rlike("(?:Bus|CommandHandler)$")), "VSA032", F.concat(F.lit("a projection imports "), F.col("target"))),
        _coded(managers.where(~whole), "VSA033", F.concat(F.col("name"), F.lit(" lacks handling or processing"))),
        _coded(links.where(above), "VSA206", said),
    ]


def _contexts(files: DataFrame, d: DataFrame, links: DataFrame) -> list[DataFrame]:
    """VSA100 to VSA205: integration events and what contexts share."""
    shared = F.concat(F.lit("/"), F.col("path")).rlike("/integration-events/")
    integration = d.where(F.col("name").endswith("IntegrationEvent") & (F.col("kind") == "event"))
    twice = d.where((F.col("kind") == "class") & shared).groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n > 1")
    across = links.where("from_context is not null and to_context is not null and from_context <> to_context")
    of = files.select("path", context(F.col("path")).alias("context")).where("context is not null")
    first = of.groupBy("context").agg(F.min("path").alias("path"))
    arrows = across.select(F.col("from_context").alias("src"), F.col("to_context").alias("dst"))
    round_ = graph.reachable(files.sparkSession, arrows).where("src = dst").select(F.col("src").alias("context"))
    public = of.where(F.col("path").rlike(r"(?:^|/)contexts/[^/]+/(?:index|public)(?:\.\w+|/)")).select("context")
    several = first.agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n > 1")
    has_shared = files.where(F.col("path").rlike("(?:^|/)_shared/")).select(F.lit(1).alias("one")).distinct()
    api = F.col("target").rlike(r"(?:^|/)contexts/[^/]+/?(?:(?:index|public)(?:/.*|\.\w+)?)?$") | F.col("target").rlike("integration-events")
    return [
        _coded(twice, "VSA100", F.concat_ws(" ", "name", F.lit("is declared"), F.col("n").cast("string"), F.lit("times"))),
        _coded(integration.where(~shared), "VSA101", F.concat(F.col("name"), F.lit(" is out of place"))),
        _coded(d.where((F.col("kind") == "class") & shared & ~F.col("name").endswith("IntegrationEvent")), "VSA102", F.concat(F.col("name"), F.lit(" doesn't end in IntegrationEvent"))),
        _coded(first.join(round_.distinct(), "context"), "VSA200", F.concat(F.col("context"), F.lit(" depends on itself"))),
        _coded(across.where(~api), "VSA201", F.concat_ws(" ", F.col("from_context"), F.lit("imports"), F.col("to_context"))),
        _coded(several.join(has_shared, F.lit(True), "left_anti"), "VSA202", F.concat(F.col("n").cast("string"), F.lit(" contexts and no _shared")), "warning"),
        _coded(first.join(d.where("kind = 'aggregate'").select("context"), "context", "left_anti"), "VSA203", F.concat(F.col("context"), F.lit(" has no aggregate")), "warning"),
        _coded(across.where(~api & F.col("to_layer").isNotNull()), "VSA204", F.concat(F.lit("past the public API: "), F.col("target"))),
        _coded(first.join(arrows.select(F.col("dst").alias("context")).distinct(), "context", "left_semi").join(public, "context", "left_anti"), "VSA205", F.concat(F.col("context"), F.lit(" has no public API")), "warning"),
    ]


def check_codes(files: DataFrame) -> DataFrame:
    """Violations (code, severity, path, message) of all rules that have a code."""
    d, links = declared(files), linked(files)
    return reduce(DataFrame.union, (v for group in (_slices, _structure, _dependencies, _contexts) for v in group(files, d, links)))
