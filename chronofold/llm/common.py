"""What several corpus operators share: the shared folder, written tables, word rules, components.

Words are maximal runs of anything but ASCII white space, ``[^\\x20\\x09-\\x0D]+``. On bytes that is
exactly ``bytes.split()``, which all Python code here uses.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.sources.shared import shared_dir as shared_dir

#: A word, for Java's and Python's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, what: str) -> DataFrame:
    """The frame, written as Parquet to the shared folder and read again.

    This cuts lineage (a lost executor costs no recomputation) and evaluates Python only once
    where a plan uses a frame twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes a table that written() made, once nothing reads it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def by_batch(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow of a function from batch to batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield f(batch)

    return df.mapInArrow(each, schema)


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; a null is empty."""
    for x in column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()):
        yield x.as_py() or b""


def word_count(text: Column) -> Column:
    """Number of words of a text, in the JVM; null counts 0."""
    marks = F.regexp_replace(text, WORD, "x")
    return F.coalesce(F.length(marks) - F.length(F.regexp_replace(marks, "x", "")), F.lit(0)).cast("long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (a, b): one row (node, root), root the smallest node.

    Alternates large-star and small-star until the edges stay as they are. Each round only ever
    aggregates and joins by node, so a node of any degree is a skewed join key (which adaptive
    execution splits) and never a collected list. Each round is written to the shared folder.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    now, was = written(now, "links"), None
    while True:
        at = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if at[0] == 0 or at == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        was = at
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, "links")
        drop_written(now)
        now = after
