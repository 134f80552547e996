"""Rebuilding a projection beside the one in use, and swapping; handling dead letters again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronofold.sources.commits import Commits


class Versioned:
    """A read model in files: each build has a folder of its own, one small pointer names the current one."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._pointers = Commits(spark, f"{self.root}/pointers")

    def current(self) -> str | None:
        """Folder of the build in use: the pointer of highest number."""
        names = self._pointers.names()
        return self._pointers.get(names[-1]) if names else None

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.current())

    def build(self, projection: Callable[[DataFrame], DataFrame], log: DataFrame) -> str:
        """Writes a new build; readers keep the old one until swap()."""
        folder = f"{self.root}/builds/{uuid.uuid4().hex}"
        projection(log).write.parquet(folder)
        return folder

    def swap(self, folder: str) -> None:
        """Readers see the new build from now on. A pointer appears whole or not at all; of two swaps the later wins."""
        while not self._pointers.claim(f"{len(self._pointers.names()):012d}", folder):
            pass


def reprocess(pending: DataFrame, log: DataFrame, handle: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Handles the events of pending dead letters again: ids that went well, ids that failed with their errors.

    handle() returns its rows with event_id and error (null if it went well).
    """
    events = log.join(pending.select("event_id"), "event_id", "left_semi")
    done = handle(events)
    return done.where("error is null").select("event_id"), done.where("error is not null").select("event_id", "error")
