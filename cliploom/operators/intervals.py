"""Interval operators: bucketed joins, merging, complement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.operators.blocks import BLOCK_MS, running, time_block

BUCKET_MS = 30_000


def bucket(ms: str | Column, width: int = BUCKET_MS) -> Column:
    return time_block(ms, width)


def spread_over_buckets(df: DataFrame, start: str, end: str, name: str = "_bucket", width: int = BUCKET_MS) -> DataFrame:
    """One copy of each interval per time bucket it touches (both ends included)."""
    lo, hi = bucket(start, width), F.greatest(bucket(end, width), bucket(start, width))
    return df.withColumn(name, F.explode(F.sequence(lo, hi)))


def points_in_intervals(
    points: DataFrame,
    point_start: str,
    point_end: str,
    spans: DataFrame,
    span_start: str,
    span_end: str,
    keys: Sequence[str] = ("job_id",),
    how: str = "inner",
) -> DataFrame:
    """Pairs where [point_start, point_end] lies inside [span_start, span_end], ends included.

    A point carries only the bucket of its start, so no pair is produced twice.  ``how`` is seen from
    the points: 'inner', 'left' or 'left_semi'.
    """
    p = points.withColumn("_bucket", bucket(point_start)).alias("p")
    s = spread_over_buckets(spans, span_start, span_end).alias("s")
    cond = F.col("p._bucket") == F.col("s._bucket")
    for k in keys:
        cond = cond & (F.col(f"p.{k}") == F.col(f"s.{k}"))
    cond = cond & (F.col(f"p.{point_start}") >= F.col(f"s.{span_start}")) & (F.col(f"p.{point_end}") <= F.col(f"s.{span_end}"))
    joined = p.join(s, cond, how)
    if how == "left_semi":
        return joined.select([F.col(f"p.{c}") for c in points.columns])
    return joined.select(
        [F.col(f"p.{c}") for c in points.columns] + [F.col(f"s.{c}") for c in spans.columns if c not in keys]
    )


def overlaps(
    left: DataFrame,
    left_start: str,
    left_end: str,
    right: DataFrame,
    right_start: str,
    right_end: str,
    keys: Sequence[str] = ("job_id",),
) -> DataFrame:
    """Pairs of intervals with strict overlap; each pair is kept only in the later of the two first buckets."""
    a = spread_over_buckets(left.withColumn("_b0", bucket(left_start)), left_start, left_end).alias("a")
    b = spread_over_buckets(right.withColumn("_b0", bucket(right_start)), right_start, right_end).alias("b")
    cond = (F.col("a._bucket") == F.col("b._bucket")) & (
        F.col("a._bucket") == F.greatest(F.col("a._b0"), F.col("b._b0"))
    )
    for k in keys:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    cond = cond & (F.col(f"b.{right_end}") > F.col(f"a.{left_start}")) & (F.col(f"b.{right_start}") < F.col(f"a.{left_end}"))
    return a.join(b, cond).select(
        [F.col(f"a.{c}") for c in left.columns] + [F.col(f"b.{c}") for c in right.columns if c not in keys]
    )


def merge_intervals(
    spans: DataFrame,
    keys: Sequence[str] = ("job_id",),
    start: str = "start_ms",
    end: str = "end_ms",
    gap_ms: int = 0,
    block_ms: int = BLOCK_MS,
) -> DataFrame:
    """Union of intervals per key; two merge when the later starts at most ``gap_ms`` after the running end."""
    keys = list(keys)
    # Equal starts always merge, so they are combined before the shuffle by block.
    rows = spans.groupBy(*keys, F.col(start).alias("_s")).agg(F.max(end).alias("_e"))
    block = time_block("_s", block_ms)
    seen = running(rows, keys, ["_s"], block, maxes={"_reach": F.col("_e")})
    fresh = F.col("_reach").isNull() | (F.col("_s") > F.col("_reach") + F.lit(gap_ms))
    marked = seen.withColumn("_first", F.when(fresh, F.col("_s")))
    marked = running(marked, keys, ["_s"], block, maxes={"_open": F.col("_first")})
    return (
        marked.groupBy(*keys, F.coalesce("_first", "_open").alias(start))
        .agg(F.max("_e").alias(end))
        .select(*keys, start, end)
    )


def speech_islands(words: DataFrame, gap_ms: int = 1500) -> DataFrame:
    """Speech intervals of a job: words merge while the next starts at most ``gap_ms`` after the running end.

    Words whose starts fall in the same ``gap_ms`` wide slot always belong together, so they are
    reduced to one interval by a map-side aggregate first.
    """
    slots = words.groupBy("job_id", F.floor(F.col("start_ms") / F.lit(max(gap_ms, 1))).alias("_slot")).agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")
    )
    merged = merge_intervals(slots, gap_ms=gap_ms)
    return merged.select("job_id", "start_ms", "end_ms")


def complement(
    windows: DataFrame,
    removed: DataFrame,
    keys: Sequence[str],
    window_start: str = "win_start_ms",
    window_end: str = "win_end_ms",
) -> DataFrame:
    """Cut merged, disjoint ``removed`` spans (start_ms, end_ms) out of one window per key.

    Yields the kept pieces in order as start_ms, end_ms.  Windows without removed spans, or with
    nothing left, yield no row here: the caller keeps the original there.
    """
    keys = list(keys)
    placed = running(
        removed.select(*keys, "start_ms", "end_ms"),
        keys,
        ["start_ms"],
        time_block("start_ms"),
        prev={"_cut_end": F.col("end_ms")},
        following={"_next": F.col("start_ms")},
    ).join(windows.select(*keys, window_start, window_end), keys)
    piece = lambda a, b: F.struct(a.cast("long").alias("start_ms"), b.cast("long").alias("end_ms"))
    before = piece(F.coalesce("_cut_end", window_start), F.col("start_ms"))
    after = piece(F.col("end_ms"), F.col(window_end))
    parts = F.when(F.col("_next").isNull(), F.array(before, after)).otherwise(F.array(before))
    return placed.select(*keys, F.explode(parts).alias("_p")).select(*keys, "_p.start_ms", "_p.end_ms").filter("start_ms < end_ms")
