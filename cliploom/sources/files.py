"""Folders of many small files: tasks list, read and write them, so that neither the driver nor a commit meets every file.

Files are reached through ``pyarrow.fs``, so folders may be local, HDFS or an object store.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.operators.blocks import partitions_of

LISTED = "path string, length bigint"
OUT_ROWS, OUT_BYTES = 10_000, 16 << 20
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
# Fixed value: the characters that Spark escapes in the names of key=value folders.
ESCAPED = re.compile(r"[\x00-\x1f\"#%'*/:=?\\\x7f{\[\]^]")


def where_is(name: str) -> tuple:
    """(file system, path there) of a name with a scheme."""
    from pyarrow import fs

    if name.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", name)
    return fs.FileSystem.from_uri(quote(name, safe="/:@"))


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, as Spark names files."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def _hidden(path: str) -> bool:
    """Whether Spark would leave this file out: a folder or the file itself begins with a dot or an underscore."""
    return any(x.startswith(".") or (x.startswith("_") and "=" not in x) for x in path.split("/"))


def _lister(deep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Replaces folders, which have no length, by what is in them, or by all files below them."""
    from pyarrow import fs

    schema = pa.schema([("path", pa.string()), ("length", pa.int64())])

    def inside(name: str) -> Iterator[tuple[str, int | None]]:
        where, path = where_is(name)
        scheme = name.removesuffix(path)
        info = where.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(name)
        if info.type == fs.FileType.File:
            yield name, info.size
            return
        for found in where.get_file_info(fs.FileSelector(path, recursive=deep)):
            if not _hidden(found.path[len(path) :].strip("/")) and (found.type == fs.FileType.File or not deep):
                yield scheme + found.path, found.size if found.type == fs.FileType.File else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        for batch in batches:
            for row in batch.to_pylist():
                rows += [(row["path"], row["length"])] if row["length"] is not None else inside(row["path"])
                if len(rows) >= OUT_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of all files below ``path``; their content is not read.

    One task lists the folder itself, many its sub-folders, and many all below those.
    """
    rows = spark.createDataFrame([(qualified(spark, path), None)], LISTED)
    for deep in (False, False, True):
        rows = rows.mapInArrow(_lister(deep), LISTED)
        if not deep:
            rows = rows.repartition(partitions_of(rows), "path")
    return rows


def read_files(files: DataFrame, compression: str | None = None) -> DataFrame:
    """(path, length, content) from (path, length); ``compression`` 'detect' unpacks by the end of the name, as Spark's text reader does."""
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                where, path = where_is(row["path"])
                with where.open_input_stream(path, compression=compression) as f:
                    rows.append((row["path"], row["length"], f.read()))
                size += len(rows[-1][2])
                if len(rows) >= OUT_ROWS or size >= OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    dealt = files.select("path", "length").repartition(partitions_of(files), "path")
    return dealt.mapInArrow(run, f"{LISTED}, content binary")


def write_files(rows: DataFrame, root: str, folders: Sequence[str], value: str) -> None:
    """Texts as lines of one file in each key=value folder below ``root``, as Spark's partitioned text writer lays them out.

    A file is written under a hidden name and renamed when it is whole; a task that runs again replaces it by the same text.
    """
    spark, folders = rows.sparkSession, list(folders)
    top = qualified(spark, root)
    schema = pa.schema([("path", pa.string()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = where_is(top)
        now, out, hidden, folder, done = None, None, "", "", []

        def end() -> None:
            if out is not None:
                length = out.tell()
                out.close()
                where.move(hidden, f"{folder}/payload.txt")
                done.append((folder, length))

        for batch in batches:
            for *key, text in zip(*(batch.column(c).to_pylist() for c in [*folders, value])):
                if key != now:
                    end()
                    named = (ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", v) if v else NO_VALUE for v in key)
                    now, folder = key, "/".join([base, *(f"{c}={v}" for c, v in zip(folders, named))])
                    where.create_dir(folder, recursive=True)
                    hidden = f"{folder}/.{uuid.uuid4().hex}"
                    out = where.open_output_stream(hidden)
                out.write((text or "").encode() + b"\n")
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), schema.types)], schema=schema)
                done = []
        end()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), schema.types)], schema=schema)

    texts = rows.select(*[F.col(c).cast("string").alias(c) for c in folders], F.col(value).alias(value))
    together = texts.repartition(*folders).sortWithinPartitions(*folders)
    together.mapInArrow(run, LISTED).write.format("noop").mode("overwrite").save()
