"""Checks of folds and projections: determinism, rebuilds, replays, idempotency, differences of states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def digest(df: DataFrame) -> tuple[int, int]:
    """Number of rows and an order-free sum of their hashes."""
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return row["n"], int(row["h"])


def deterministic(projection: Callable[[DataFrame], DataFrame], log: DataFrame, times: int = 3) -> bool:
    """Whether repeated replays, over differently dealt input, agree."""
    return len({digest(projection(log.repartition(i + 1))) for i in range(times)}) == 1


def rebuilds(projection: Callable[[DataFrame], DataFrame], log: DataFrame, kept: DataFrame) -> bool:
    """Whether a rebuild gives what was kept."""
    return digest(projection(log)) == digest(kept.select(projection(log).columns))


def equal(a: DataFrame, b: DataFrame) -> bool:
    return sorted(a.columns) == sorted(b.columns) and a.exceptAll(b.select(a.columns)).isEmpty() and b.select(a.columns).exceptAll(a).isEmpty()


def differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Fields in which two states of a key differ: key, path, left, right; a key on one side only differs in all."""
    def flat(df: DataFrame, name: str) -> DataFrame:
        fields = [c for c in df.columns if c not in keys]
        pairs = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.col(c).cast("string") for c in fields)))
        return df.select(*keys, F.explode(pairs).alias("path", name))

    got = flat(a, "left").join(flat(b, "right"), [*keys, "path"], "full")
    return got.where(~F.col("left").eqNullSafe(F.col("right")))


def idempotent(action: Callable[[], int]) -> bool:
    """Whether a second pass of a process finds nothing to do."""
    action()
    return action() == 0


def purity(source: str, forbidden: tuple[str, ...] = ("requests", "socket", "subprocess", "random", "time", "os", "urllib")) -> list[str]:
    """Modules that a projection's source imports though it must be a pure function of events."""
    import ast

    names = []
    for node in ast.walk(ast.parse(source)):
        if isinstance(node, ast.Import):
            names += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            names.append(node.module or "")
    return sorted({n for n in names if n.split(".")[0] in forbidden})


def scenario(given: DataFrame, when: Callable[[DataFrame], DataFrame], then: DataFrame, keys: list[str]) -> DataFrame:
    """Given events, when a projection or command handler runs, then these rows: the differences, none if it passes."""
    return differences(when(given).select(then.columns), then, keys)


def replay_safe(run: Callable[[bool], int]) -> bool:
    """Whether a process manager does nothing while catching up. run(live) returns the number of its effects."""
    return run(False) == 0
