"""Read models: records by (projection, key), kept as appended changes of which the last counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.operators import fold


def current(changes: DataFrame) -> DataFrame:
    """Records that are there: the last change of each key, unless it deleted it."""
    return fold.latest(changes, ["projection", "key"], "seq").where("not deleted").drop("deleted")


def save(changes: DataFrame, records: DataFrame) -> DataFrame:
    """Changes with records (projection, key, data, seq) written over what was there."""
    return changes.unionByName(records.withColumn("deleted", F.lit(False)))


def delete(changes: DataFrame, keys: DataFrame) -> DataFrame:
    """Changes with keys (projection, key, seq) deleted."""
    return changes.unionByName(keys.withColumns({"data": F.lit(None).cast("map<string,string>"), "deleted": F.lit(True)}))


def delete_all(changes: DataFrame, projection: str, seq: int) -> DataFrame:
    keys = current(changes.where(F.col("projection") == projection)).select("projection", "key").withColumn("seq", F.lit(seq).cast("bigint"))
    return delete(changes, keys)


def get(records: DataFrame, projection: str, key: str) -> DataFrame:
    return records.where((F.col("projection") == projection) & (F.col("key") == key))


def matching(records: DataFrame, filters: dict[str, object], field: str | None = "data") -> DataFrame:
    """Records that equal all filters; None matches an absent field. field None: filters are columns."""
    for k, v in filters.items():
        have = F.col(k) if field is None else F.col(field)[k]
        records = records.where(have.eqNullSafe(F.lit(v if v is None or field is None else str(v))))
    return records


def query(records: DataFrame, filters: dict[str, object] | None = None, order_by: str | None = None, limit: int | None = None, offset: int = 0, field: str | None = "data", key: str = "key") -> DataFrame:
    """Filter, order (-field: descending; absent fields as ""), offset, limit; ties by key."""
    got = matching(records, filters or {}, field)
    if order_by:
        name = order_by.lstrip("-")
        by: Column = F.coalesce(F.col(field)[name], F.lit("")) if field else F.col(name)
        got = got.orderBy(by.desc() if order_by.startswith("-") else by, key)
    elif limit is not None or offset:
        got = got.orderBy(key)
    got = got.offset(offset) if offset else got
    return got if limit is None else got.limit(limit)


def by_prefix(records: DataFrame, projection: str, prefix: str) -> DataFrame:
    """Records whose key starts with the prefix, taken literally."""
    return records.where((F.col("projection") == projection) & F.startswith(F.col("key"), F.lit(prefix)))
