"""Intermediate tables that cut long plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where driver and executors are one process (a local master) may it be unset: a temporary folder serves then.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="run-cliploom-")
    return _local[app]


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once and go on from the written table.

    Used where several branches read the same costly result, above all after Python steps: the
    branches then scan a columnar table instead of repeating the work, the plan stays small, and a
    lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/cliploom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Spark removes a query's shuffles when it ends, not when the driver's garbage happens to be collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize_alone(df: DataFrame, label: str = "stage") -> DataFrame:
    """``materialize`` for large shuffles, which leave the disk as soon as the table is written."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return materialize(df, label)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)
