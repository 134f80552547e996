"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: Folders made for local sessions that set none, by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, else of its context.

    Only where it is unset, and driver and executors are one process (as in tests), a folder of this
    machine stands in; a cluster without the setting is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='chronofold-')}"
        found = _own[context.applicationId]
    return found.rstrip("/")
