"""Stage tables: results of each stage, stored by category and read back by job."""

from __future__ import annotations

import re
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliploom.sources.responses import is_json
from cliploom.sources.scratch import materialize

# The categories of stored results.
CATEGORIES = ("frames", "audio", "transcript", "scenes", "vud", "edit", "output")
POINTERS = ".pointers"  # ending of the table that says where each job's rows are


def _check(category: str) -> None:
    if category not in CATEGORIES:
        raise ValueError(f"unknown category {category!r}; one of {CATEGORIES}")


def _table(root: str, category: str, name: str) -> str:
    _check(category)
    return f"{root}/{category}/{name}"


def _point(jobs: DataFrame, table: str) -> None:
    """Append pointers (job_id, stage_version, folder): from here on these jobs are read from that folder."""
    jobs.select(F.col("job_id").cast("string"), F.col("stage_version").cast("long"), F.col("folder").cast("long")).write.mode("append").parquet(table + POINTERS)


def _put(df: DataFrame, table: str, folder: int) -> None:
    """Rows of many jobs in files of even size, a large job in several; sorted, with a Bloom filter, for reads of one job."""
    out = df.hint("rebalance", "job_id").sortWithinPartitions("job_id")
    out.write.option("parquet.bloom.filter.enabled#job_id", "true").parquet(f"{table}/folder={folder}")


def write_stage(df: DataFrame, root: str, category: str, name: str = "data", version: int | None = None, jobs: DataFrame | None = None) -> int:
    """Store the rows of the jobs in ``df``, replacing what was stored for exactly these jobs.

    The rows go to a new folder; then one pointer per job is appended, in a single write, so that readers see a write whole
    or not at all, and a killed one leaves a folder that nothing points to.  Readers follow the pointer of the highest
    version.  ``jobs`` (job_id) names the jobs that were worked on: those without rows in ``df`` then have an empty result.
    """
    table = _table(root, category, name)
    folder = time.time_ns()
    version = folder if version is None else version
    _put(df, table, folder)
    stored = df.sparkSession.read.schema(df.schema).parquet(f"{table}/folder={folder}").select(F.col("job_id").cast("string"))
    if jobs is not None:
        stored = stored.union(jobs.select(F.col("job_id").cast("string")))
    _point(stored.distinct().withColumns({"stage_version": F.lit(version), "folder": F.lit(folder)}), table)
    return version


def _exists(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def _latest(spark: SparkSession, table: str) -> DataFrame | None:
    """(_job, stage_version, folder): where each job's rows are."""
    pointers = _exists(spark, table + POINTERS, "job_id string, stage_version long, folder long")
    if pointers is None:
        return None
    at = F.max(F.struct("stage_version", "folder")).alias("x")
    return pointers.groupBy(F.col("job_id").alias("_job")).agg(at).select("_job", "x.stage_version", "x.folder")


def read_stage(
    spark: SparkSession, root: str, category: str, schema: T.StructType, name: str = "data", job_id=None
) -> DataFrame:
    """Latest rows of every job (or of one).  A category never written is an empty table.

    Only folders that some job still points to are read; their numbers, one per write since the last compaction, pass
    through the driver.
    """
    table = _table(root, category, name)
    latest = _latest(spark, table)
    if latest is None:
        return spark.createDataFrame([], schema)
    if job_id is not None:
        latest = latest.filter(F.col("_job") == F.lit(job_id).cast("string"))
    live = sorted(r.folder for r in latest.select("folder").distinct().collect())
    if not live:
        return spark.createDataFrame([], schema)
    stored = T.StructType([*schema.fields, T.StructField("folder", T.LongType())])
    d = spark.read.schema(stored).option("basePath", table).parquet(*[f"{table}/folder={n}" for n in live])
    if job_id is not None:
        d = d.filter(F.col("job_id") == F.lit(job_id))
    own = (F.col("job_id").cast("string") == F.col("_job")) & (d["folder"] == latest["folder"])
    return d.join(latest, own, "left_semi").select(*[f.name for f in schema.fields])


def compact_stage(spark: SparkSession, root: str, category: str, schema: T.StructType, name: str = "data", keep_ms: int = 3_600_000) -> int:
    """Bring the latest rows of all jobs into one folder, and delete folders that are neither pointed to nor younger than ``keep_ms``.

    A job keeps its version, so a write that ends meanwhile still wins.  ``keep_ms`` must exceed the longest read and write: those
    under way keep their folders.  Returns how many folders were deleted.  Pointers of earlier writes stay; they are one
    narrow row per job and write.
    """
    table = _table(root, category, name)
    latest = _latest(spark, table)
    if latest is None:
        return 0
    pinned = materialize(latest, "pointers")
    if pinned.select("folder").distinct().limit(2).count() > 1:
        folder = time.time_ns()
        _put(read_stage(spark, root, category, schema, name), table, folder)
        # Only what was read: a job whose pointer has moved since is left to its newer write by its higher version.
        _point(pinned.select(F.col("_job").alias("job_id"), "stage_version", F.lit(folder).alias("folder")), table)
    live = {r.folder for r in _latest(spark, table).select("folder").distinct().collect()}
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    oldest = time.time_ns() - keep_ms * 1_000_000
    gone = 0
    for status in fs.listStatus(path):
        found = re.fullmatch(r"folder=([0-9]+)", status.getPath().getName())
        if found and int(found.group(1)) not in live and int(found.group(1)) < oldest:
            gone += bool(fs.delete(status.getPath(), True))
    return gone


def missing_jobs(jobs: DataFrame, stage: DataFrame) -> DataFrame:
    """Jobs without rows in a stage table: what is still to be done, or could not be loaded."""
    return jobs.select("job_id").distinct().join(stage.select("job_id").distinct(), "job_id", "left_anti")


JOB_MANIFEST = "struct<id:string,state:string,sourceFileName:string,jobDir:string,createdAt:string,updatedAt:string,error:string>"


def parse_job_manifests(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs newest first, corrupt) from (path, payload)."""
    d = raw.select("path", "payload", F.from_json("payload", JOB_MANIFEST).alias("j"), is_json(F.col("payload")).alias("_ok"))
    jobs = d.filter("_ok").select(
        F.col("j.id").alias("job_id"),
        F.col("j.state").alias("state"),
        F.col("j.sourceFileName").alias("source_file"),
        F.col("j.createdAt").try_cast("timestamp").alias("created_at"),
        F.col("j.updatedAt").try_cast("timestamp").alias("updated_at"),
        F.col("j.error").alias("error"),
    )
    return jobs.orderBy(F.desc("created_at"), "job_id"), d.filter("NOT coalesce(_ok, false)").select("path")


def list_jobs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Jobs of all <root>/<job>/manifest.json files, newest first, and the unreadable ones."""
    raw = spark.read.text(f"{root}/*/manifest.json", wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload")
    )
    return parse_job_manifests(raw)
