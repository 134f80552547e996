"""Upcasting on read: old event versions become the latest by a chain of column maps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Upcaster:
    """Turns a payload of one version into the next; both are maps of strings."""

    event_type: str
    version: int
    change: Callable[[Column], Column]
    to: int | None = None

    @property
    def is_incremental(self) -> bool:
        return self.target == self.version + 1

    @property
    def target(self) -> int:
        return self.version + 1 if self.to is None else self.to


def with_fields(**fields: Column | Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A change that adds fields: a column, or a function of the old payload. Fields that are there stay."""

    def change(payload: Column) -> Column:
        new = F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), (v if isinstance(v, Column) else v(payload)).cast("string"))))
        return F.map_concat(F.map_filter(new, lambda k, _: ~F.map_contains_key(payload, k)), payload)

    return change


def upcast(log: DataFrame, chain: list[Upcaster], payload: str = "payload") -> DataFrame:
    """The log with every event at its type's latest version; versions without an upcaster stay."""
    for u in sorted(chain, key=lambda u: (u.event_type, u.version)):
        applies = (F.col("event_type") == u.event_type) & (F.col("event_version") == u.version)
        log = log.withColumns({payload: F.when(applies, u.change(F.col(payload))).otherwise(F.col(payload)), "event_version": F.when(applies, u.target).otherwise(F.col("event_version"))})
    return log


def missing(chain: list[Upcaster], latest: dict[str, int]) -> list[tuple[str, int]]:
    """Steps (type, version) that no upcaster takes."""
    have = {(u.event_type, u.version) for u in chain}
    return [(t, v) for t, top in sorted(latest.items()) for v in range(1, top) if (t, v) not in have]
