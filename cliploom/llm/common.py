"""Helpers shared by the operators on training text."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cliploom.sources.scratch import materialize, materialize_alone, scratch_dir

__all__ = ["materialize", "materialize_alone", "scratch_dir", "table", "whole", "slices", "map_slices", "once", "tidy", "free", "partitions"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def once(key: tuple, build: Callable[[], object]) -> object:
    """What ``build`` gives, kept by a worker process for the tasks that follow (the last one made only).

    Functions travel by value, so every task has module globals of its own; the interpreter's is what tasks share.
    ``map_slices`` lets go of what its own task does not ask for.
    """
    held = getattr(sys, "_cliploom_once", None)
    if held is None or held[0] != key:
        held = None
        sys._cliploom_once = None
        held = sys._cliploom_once = (key, build())
    sys._cliploom_asked = True
    return held[1]


def give_back() -> None:
    """Freed memory goes back to the machine: worker processes live on, and an executor's others need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that does not ask for anything kept: lets go of what earlier tasks kept, gives memory back."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys._cliploom_once = None
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def slices(batches: Iterator[pa.RecordBatch], column: str, budget: int) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about ``budget`` bytes in a column (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, before + budget, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def map_slices(df: DataFrame, column: str, make: Callable[[], Callable[[list], dict]], added: str, keep: list[str], budget: int = 2_000_000) -> DataFrame:
    """Columns ``keep`` as they are, and those of the DDL ``added``, computed from one column by slices of bounded size.

    ``make`` runs once a task and gives a function from the values of ``column`` to the added columns. A kept column with
    an added one's name is replaced in place. Kept values never become Python objects.
    """
    new = T.StructType.fromDDL(added)
    names = {f.name for f in new}
    schema = T.StructType([new[k] if k in names else df.schema[k] for k in keep] + [f for f in new if f.name not in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys._cliploom_asked = False
        fn = make()
        if not sys._cliploom_asked:
            sys._cliploom_once = None
        out_schema = to_arrow_schema(schema)
        try:
            for part in slices(batches, column, budget):
                got = fn(part.column(column).to_pylist())
                arrays = []
                for f in out_schema:
                    if f.name in names:
                        arrays.append(pa.array(got[f.name], type=f.type))
                    else:
                        kept = part.column(f.name)
                        arrays.append(kept if kept.type == f.type else kept.cast(f.type))
                yield pa.RecordBatch.from_arrays(arrays, schema=out_schema)
        finally:
            got = arrays = None
            give_back()

    return df.select(*dict.fromkeys([*(k for k in keep if k not in names or k == column), column])).mapInArrow(run, schema)
