"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # splits a hot join key (one address, one event, one order) at run time
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # sets of period types are collected by hash for this many entities of a task before it sorts; the default is 128
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "100000",
    # recording the call site of every column expression triples the driver's time to build a plan
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(
    app_name: str = "billcycle", master: str | None = None, extra: dict[str, str] | None = None
) -> SparkSession:
    """Session with the settings above; partition counts and memory stay the cluster's business."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
