"""Exact duplicates by a tree of merges over sorted digest runs.

Every partition turns its rows into a sorted run: one row per digest with the id to keep and the number of rows. In
each round the tree's groups of ``fan_in`` partitions exchange their runs: a partition's number, written in base
``fan_in``, gets one digit after the other replaced by a digit of the digest's hash, and what arrives is merged
as sorted runs, keeping the best id and adding counts. After the last digit a digest lives in one partition only.

* No partition ever holds more than its share of distinct digests; a digest that a third of all rows carry is one row per
  run from the start, and at most ``fan_in`` rows meet in a merge.
* Ids are verified at every level: a row counts as equal only if SHA-256, byte length and a second, independent hash of
  the text agree.

A null text counts as empty. A null id is smaller than any other. Rows with equal ids are counted separately, all of them
are kept if their id is. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliploom.llm.common import materialize, partitions, tidy, whole

KEY = ["digest", "n_bytes", "check"]


def _collapsed(rows: pa.Table) -> pa.Table:
    """One row per key, sorted."""
    out = rows.group_by(["node", *KEY]).aggregate([("max_id", "max"), ("min_id", "min"), ("n", "sum")])
    out = out.rename_columns(["node", *KEY, "max_id", "min_id", "n"]).select(rows.column_names)
    return out.sort_by([(k, "ascending") for k in KEY]).cast(rows.schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of what a partition reads: equal digests become one row before anything moves."""
    for batch in batches:
        yield from _collapsed(pa.Table.from_batches([batch])).to_batches()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Collapse the merged order of a partition's runs; the last key of a batch may go on in the next one."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = _collapsed(rows if held is None else pa.concat_tables([held, rows]))
        held = rows.slice(rows.num_rows - 1)
        yield from rows.slice(0, rows.num_rows - 1).to_batches()
    if held is not None:
        yield from held.to_batches()


def digest_groups(keyed: DataFrame, id_col: str, fan_in: int = 4) -> DataFrame:
    """(digest, n_bytes, check, max_id, min_id, n) per distinct text of rows with these digests."""
    rounds = 1
    while fan_in**rounds < partitions(keyed.sparkSession):
        rounds += 1
    width = fan_in**rounds
    home = F.pmod(F.col("check"), F.lit(width)).cast("int")
    node = F.pmod(F.spark_partition_id(), F.lit(width)).cast("int")
    one = F.lit(1).cast("long")
    runs = keyed.select(*KEY, F.col(id_col).alias("max_id"), F.col(id_col).alias("min_id"), one.alias("n"), node.alias("node"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in runs.schema])
    runs = runs.mapInArrow(tidy(_runs), schema)
    for r in range(rounds):
        step = fan_in**r
        digit = lambda c: F.floor(c / step).cast("int") % fan_in  # noqa: B023, E731
        to = (F.col("node") + (digit(home) - digit(F.col("node"))) * step).cast("int")
        sent = runs.withColumn("node", to).repartitionById(width, F.col("node"))
        runs = sent.sortWithinPartitions(*KEY).mapInArrow(tidy(_merge), schema)
    return runs.drop("node")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fan_in: int = 4) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row; ``keep`` is 'max' or 'min' id of equal texts."""
    text = whole(text_col)
    keyed = materialize(
        docs.select(
            id_col,
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
            F.octet_length(text).cast("long").alias("n_bytes"),
            F.xxhash64(text).alias("check"),
        ),
        "digests",
    )
    groups = materialize(digest_groups(keyed, id_col, fan_in), "digest-groups")
    best = F.col(f"{keep}_id")
    return keyed.join(groups, KEY).select(
        id_col,
        best.alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col(id_col).eqNullSafe(best).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
