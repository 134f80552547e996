"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Targets: each source's share of all words by weight, at most `cap` times its own words; what is cut
off goes to the others by weight until none is above. That level (target = min(weight * level,
cap * size)) has a closed form over sources sorted by cap * size / weight.

Rates: the mix stays as near to the corpus as it can. It minimises the sum over documents of
root(size) times the entropy of its rate r between 0 and `cap`, relative to r = 1,

    r log r + (cap - r) log((cap - r) / (cap - 1)),

under one token constraint a source: sum of r * size = target. By Lagrange each rate is an
exponential tilt of 1 by the root of the document's size, bounded by the dual itself,

    r = cap / (1 + (cap - 1) exp(-l x)),   x = root(size),   l the source's multiplier,

so long documents give or take more than short ones, and empty ones stay as they are. l minimises the
convex dual; its gradient is sum(r size) - target, its Hessian sum(r (1 - r / cap) x size). Each
Newton iteration is one distributed aggregation of both over all documents, which are counted by
source and size first (documents of one source and size have one rate). A step that leaves the
bracket found so far is replaced by its middle, so every iteration gets nearer.

Copies: rates are rounded by error diffusion within buckets of about BUCKET documents of a source,
large documents first: each bucket ends within half a small document of its share. A document gets
its rate rounded down or up, never more than `cap` copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm import common

#: Documents of a source that are rounded together.
BUCKET = 128
#: Weights of the sources in order of code points, repeating; most copies of a document.
WEIGHTS, CAP = (5, 2, 1), 3
#: Most Newton iterations, and the part of its target by which a source may miss it then.
ITERATIONS, NEAR = 100, 1e-9


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Adds the target of each source to a table (source, source_size), one row a source, null last.

    The table has one row a source and is ranked in one task; sources are few against documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank - 1, F.lit(len(weights))) + 1)
    got = sizes.withColumn("weight", weight.cast("double")).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows, before = Window.partitionBy(), by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum("most").over(before), F.lit(0.0))
    rest = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    got = got.withColumn("level", (F.sum("source_size").over(all_rows) - capped) / rest)
    # the first source, in order of where its cap begins, that the level leaves below its cap
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("level").alias("level")))).over(all_rows)
    return got.withColumn("target", F.least(F.col("weight") * level["level"], F.col("most"))).drop("most", "level", "weight")


def rate(multiplier: Column, size: Column, cap: int = CAP) -> Column:
    """The tilted rate of a document; a null multiplier stands for infinity, all that the cap allows."""
    tilted = cap / (1 + (cap - 1) * F.exp(-multiplier * F.sqrt(size)))
    return F.when(multiplier.isNull() & (size > 0), F.lit(float(cap))).otherwise(F.coalesce(tilted, F.lit(1.0)))


def multipliers(sized: DataFrame, sources: DataFrame, cap: int = CAP) -> DataFrame:
    """Adds l, the multiplier that solves the dual, to a table of sources (source, target, ...).

    sized: (source, size, n), how many documents of a source have a size. A source whose target is all
    that its cap allows has null. Each iteration's multipliers, one row a source, are written and read
    again, so that no plan grows and no executor's loss costs more than one iteration.
    """
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    none = F.lit(None).cast("double")
    start = sources.withColumns({"l": F.when(full & (F.col("target") > 0), none).otherwise(F.lit(0.0)), "low": none, "high": none, "done": full | (F.col("target") <= 0)})
    now = common.written(start, "multipliers")
    rows = sized.where("size > 0").withColumnRenamed("source", "of")
    for _ in range(ITERATIONS):
        if now.where("not done").isEmpty():
            break
        at = rows.join(now.where("not done").select("source", "l"), F.col("of").eqNullSafe(F.col("source")))
        r, size = rate(F.col("l"), F.col("size"), cap), F.col("size").cast("double")
        sums = at.groupBy("source").agg(F.sum(r * size * F.col("n")).alias("given"), F.sum(r * (1 - r / cap) * F.sqrt(size) * size * F.col("n")).alias("hessian"))
        step = now.join(sums.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        gradient = F.col("given") - F.col("target")
        step = step.withColumns({"high": F.when(gradient > 0, F.col("l")).otherwise(F.col("high")), "low": F.when(gradient <= 0, F.col("l")).otherwise(F.col("low"))})
        newton = F.col("l") - gradient / F.col("hessian")
        inside = F.coalesce((newton > F.col("low")) | F.col("low").isNull(), F.lit(False)) & F.coalesce((newton < F.col("high")) | F.col("high").isNull(), F.lit(False))
        # with one side of the bracket still open, a step goes at most twice as far out as the last
        far = F.abs(F.col("l")) * 2 + 1
        beyond = F.when(gradient > 0, F.greatest(newton, -far)).otherwise(F.least(newton, far))
        middle = (F.col("low") + F.col("high")) / 2
        other = F.coalesce(middle, F.when(gradient > 0, -far).otherwise(far))
        both = F.col("low").isNotNull() & F.col("high").isNotNull()
        next_l = F.when(inside & ~F.isnan(newton), F.when(both, newton).otherwise(beyond)).otherwise(other)
        close = F.abs(gradient) <= NEAR * F.col("target")
        stuck = both & ((middle <= F.col("low")) | (middle >= F.col("high")))
        ended = F.col("done") | F.coalesce(close | stuck, F.lit(False))
        step = step.withColumns({"l": F.when(ended, F.col("l")).otherwise(next_l), "done": ended}).drop("given", "hessian")
        after = common.written(step.select(now.columns), "multipliers")
        common.drop_written(now)
        now = after
    return now.drop("low", "high", "done")


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """How often the mix takes each document. docs: row (unique), doc_id, source, size.

    Returns row, doc_id, source, size, source_size, target, rate, copies. Documents without words are
    taken once.
    """
    sized = common.written(docs.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes-counted")
    sources = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    plan = multipliers(sized, targets(sources, weights, cap), cap)
    dealt = docs.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # by id, so that the result doesn't depend on how the table is split; rows without one by their number
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("row").cast("string"))))
    dealt = dealt.withColumn("bucket", F.pmod(key, F.ceil(F.col("n") / BUCKET)))
    item = F.struct((-F.col("size")).alias("by"), key.alias("tie"), "row", "doc_id", "size", rate(F.col("l"), F.col("size"), cap).alias("rate"))
    groups = dealt.groupBy("source", "bucket").agg(F.sort_array(F.collect_list(item)).alias("items"), *(F.first(c).alias(c) for c in ("source_size", "target")))

    def take(state: Column, x: Column) -> Column:
        size = x["size"]
        due = state["due"] + x["rate"] * size  # words that the documents so far should have given, less what they gave
        low = F.floor(x["rate"])
        whole = F.when(size == 0, 1).when(due - low * size >= size / 2, F.ceil(x["rate"])).otherwise(low).cast("int")
        row = F.struct(x["row"].alias("row"), x["doc_id"].alias("doc_id"), size.alias("size"), x["rate"].alias("rate"), whole.alias("copies"))
        return F.struct((due - whole * size).alias("due"), F.concat(state["out"], F.array(row)).alias("out"))

    kinds = dict(docs.dtypes)
    start = F.struct(F.lit(0.0).alias("due"), F.array().cast(f"array<struct<row:{kinds['row']},doc_id:{kinds['doc_id']},size:{kinds['size']},rate:double,copies:int>>").alias("out"))
    done = groups.select("source", "source_size", "target", F.explode(F.aggregate("items", start, take)["out"]).alias("x"))
    return done.select("x.row", "x.doc_id", "source", "x.size", "source_size", "target", "x.rate", "x.copies")


def plan(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, rate.

    Sizes are words; null and empty texts have 0. A null source is a source of its own, last in order.
    Repeated rows are documents of their own. The rounding goes by id and size, so reruns agree however
    the table is split; only rows without an id are told apart by a row number, fixed by writing
    ids, sources and sizes once. Other columns are ignored, whatever their names. An empty table gives
    an empty result.
    """
    thin = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), common.word_count(F.col(text)).alias("size"))
    got = copies(common.written(thin, "sizes"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The documents as often as the mix takes them, in their columns, whatever these are called."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    wide = common.written(docs.select(F.monotonically_increasing_id().alias("at"), row.alias("row"), common.word_count(F.col(text)).alias("size")), "documents")
    thin = wide.select(F.col("at").alias("row"), F.col(f"row.`{doc_id}`").alias("doc_id"), F.col(f"row.`{source}`").alias("source"), "size")
    n = copies(thin).where("copies > 0").select(F.col("row").alias("at"), F.sequence(F.lit(1), "copies").alias("n"))
    return wide.join(n, "at").select("row", F.explode("n")).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
