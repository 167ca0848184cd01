"""Order-dependent primitives that never need all rows of a key in one task.

A plain ``Window.partitionBy('job_id')`` sends a whole job to one task, so one very long job decides
the run time of the query.  Here each job is cut into blocks along its order.  The window runs
inside a block, one small summary row per block is carried along the job, and the carried value is
joined back.  Only the summaries of a job ever meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliploom.sources.scratch import materialize

BLOCK_ROWS = 100_000
BLOCK_MS = 600_000


def seq_block(col: str | Column = "seq", rows: int = BLOCK_ROWS) -> Column:
    """Block number for a unique integer position: at most ``rows`` rows share one."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / F.lit(rows)).cast("long")


def time_block(col: str | Column, width_ms: int = BLOCK_MS) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / F.lit(width_ms)).cast("long")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    prev: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add values computed over the *earlier* rows of the same key, in ``order``.

    ``sums``      sum over all earlier rows, 0 for the first row
    ``maxes``     maximum over all earlier rows, null for the first row
    ``prev``      value in the row just before, null for the first row
    ``following`` value in the row just after, null for the last row

    ``block`` must not decrease along ``order`` and must bound the rows it groups.  The rows are
    shuffled once, by key and block; the summaries are combined map-side before they move.
    """
    sums, maxes = dict(sums or {}), dict(maxes or {})
    prev, following = dict(prev or {}), dict(following or {})
    keys, order = list(keys), list(order)
    d = df.withColumn("_blk", block)
    position = F.col(order[0]) if len(order) == 1 else F.struct(*order)

    totals = d.groupBy(*keys, "_blk").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"_t_{n}") for n, c in maxes.items()],
        *[F.max_by(c, position).alias(f"_t_{n}") for n, c in prev.items()],
        *[F.min_by(c, position).alias(f"_t_{n}") for n, c in following.items()],
    )
    wk = Window.partitionBy(*keys).orderBy("_blk")
    before = wk.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        "_blk",
        *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(before).alias(f"_c_{n}") for n in maxes],
        *[F.lag(f"_t_{n}").over(wk).alias(f"_c_{n}") for n in prev],
        *[F.lead(f"_t_{n}").over(wk).alias(f"_c_{n}") for n in following],
    )

    w = Window.partitionBy(*keys, "_blk").orderBy(*order)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    inner = d.select(
        "*",
        *[F.sum(c).over(earlier).alias(f"_i_{n}") for n, c in sums.items()],
        *[F.max(c).over(earlier).alias(f"_i_{n}") for n, c in maxes.items()],
        *[F.lag(c).over(w).alias(f"_i_{n}") for n, c in prev.items()],
        *[F.lead(c).over(w).alias(f"_i_{n}") for n, c in following.items()],
        *([F.lag(F.lit(1)).over(w).alias("_has_prev")] if prev else []),
        *([F.lead(F.lit(1)).over(w).alias("_has_next")] if following else []),
    )
    joined = inner.join(carried, keys + ["_blk"], "left")
    zero = F.lit(0)
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.coalesce(F.col(f"_i_{n}"), zero) + F.coalesce(F.col(f"_c_{n}"), zero)).alias(n) for n in sums],
        *[F.greatest(f"_i_{n}", f"_c_{n}").alias(n) for n in maxes],
        *[F.when(F.col("_has_prev").isNull(), F.col(f"_c_{n}")).otherwise(F.col(f"_i_{n}")).alias(n) for n in prev],
        *[F.when(F.col("_has_next").isNull(), F.col(f"_c_{n}")).otherwise(F.col(f"_i_{n}")).alias(n) for n in following],
    )


def explode_range(df: DataFrame, count: Column, name: str, chunk: int = 10_000) -> DataFrame:
    """One output row per 0 <= i < count, in two steps so that no array holds the whole range."""
    n = F.greatest(count.cast("long"), F.lit(0).cast("long"))
    outer = df.withColumn("_n", n).filter("_n > 0").withColumn(
        "_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / F.lit(chunk)).cast("long")))
    )
    lo = F.col("_c") * F.lit(chunk)
    hi = F.least(F.col("_n"), lo + F.lit(chunk)) - 1
    return outer.withColumn(name, F.explode(F.sequence(lo, hi))).drop("_n", "_c")


# --------------------------------------------------------------------------------------------
# Greedy selection: the first row of a key is taken, and each later row is judged against the
# row taken last.  One sequential loop per key in a plain program; here three bounded steps.
#   1. per block: for every row that could be the last one taken when the block begins (only rows
#      within ``reach`` before the block can matter), find the last row taken inside the block;
#   2. chain these small tables along the job, in two levels;
#   3. per block: replay with the now known starting row.
# --------------------------------------------------------------------------------------------

Accept = Callable[[dict, dict], np.ndarray]
FAN = 1024
MINUS = -1  # entry/exit value: the last taken row is out of reach


def partitions_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def whole_groups(batches: Iterator[pd.DataFrame], by: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Re-cut a stream of sorted batches so that no group of ``by`` is split between two of them."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        change = np.zeros(len(pdf), dtype=bool)
        for c in by:
            v = pdf[c].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        cuts = np.flatnonzero(change)
        if held:
            same = all(held[-1][c].iloc[-1] == pdf[c].iloc[0] for c in by)
            if not same:
                yield pd.concat(held, ignore_index=True)
                held = []
        if not len(cuts):
            held.append(pdf)
            continue
        head, tail = pdf.iloc[: cuts[-1]], pdf.iloc[cuts[-1] :]
        yield pd.concat([*held, head], ignore_index=True)
        held = [tail]
    if held:
        yield pd.concat(held, ignore_index=True)


def group_bounds(pdf: pd.DataFrame, by: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each row and the first row of each group (plus the row count at the end)."""
    change = np.zeros(len(pdf), dtype=bool)
    change[0] = True
    for c in by:
        v = pdf[c].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.cumsum(change) - 1, np.append(np.flatnonzero(change), len(pdf))


def _successors(pdf: pd.DataFrame, lower: np.ndarray, upper: np.ndarray, reach: int, cols: Sequence[str], accept: Accept) -> np.ndarray:
    """For each row: index of the next row taken if this row is the last one taken (row count = none).

    Only rows from ``lower`` up to (not including) ``upper`` can be taken.
    """
    n = len(pdf)
    data = {c: pdf[c].to_numpy() for c in cols}
    pos = pdf["_pos"].to_numpy()
    nxt = np.full(n, n, dtype=np.int64)
    cur = np.arange(n)
    cand = np.maximum(cur + 1, lower)
    while True:
        live = cand < upper[cur]
        cur, cand = cur[live], cand[live]
        if not len(cur):
            return nxt
        hit = (pos[cand] - pos[cur] >= reach) | accept(
            {c: v[cur] for c, v in data.items()}, {c: v[cand] for c, v in data.items()}
        )
        nxt[cur[hit]] = cand[hit]
        cur, cand = cur[~hit], cand[~hit] + 1


def _layout(pdf: pd.DataFrame, by: Sequence[str]):
    """Per group: its rows, where its own rows begin (after the look-back rows), and the row limits."""
    gid, bounds = group_bounds(pdf, by)
    halo = pdf["_halo"].to_numpy().astype(bool)
    n_halo = np.add.reduceat(halo.astype(np.int64), bounds[:-1])
    own = bounds[:-1] + n_halo
    return gid, bounds, halo, own


def _steps(pdf: pd.DataFrame, by: Sequence[str]) -> Iterator[tuple[int, list[tuple[int, dict]]]]:
    """Entry/exit tables of sorted rows: for each group its first row and (block, table) pairs in order."""
    gid, bounds = group_bounds(pdf, by)
    blk, ent, exi = pdf["_blk"].tolist(), pdf["_entry"].tolist(), pdf["_exit"].tolist()
    for g in range(len(bounds) - 1):
        tables: list[tuple[int, dict]] = []
        for i in range(bounds[g], bounds[g + 1]):
            if not tables or tables[-1][0] != blk[i]:
                tables.append((blk[i], {}))
            tables[-1][1][ent[i]] = exi[i]
        yield int(bounds[g]), tables


def greedy_select(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    row_id: str,
    reach: int,
    cols: Sequence[str],
    accept: Accept,
    width: int = 3_600_000,
    out: str = "taken",
) -> DataFrame:
    """Mark rows taken by a greedy pass along ``pos`` (ties by the non-negative integer ``row_id``).

    A row is taken when it is the first of its key, when it lies at least ``reach`` after the last
    taken row, or when ``accept(last, row)`` holds.  ``accept`` gets dicts of numpy arrays of
    ``cols`` and must be safe to call on any pair within reach.
    """
    if width < reach:
        raise ValueError("block width must be at least the reach")
    keys, col_list = list(keys), list(cols)
    by_block = [*keys, "_blk"]
    base = df.withColumn("_pos", F.col(pos).cast("long")).withColumn("_id", F.col(row_id).cast("long"))
    base = base.withColumn("_blk", F.floor(F.col("_pos") / F.lit(width)).cast("long"))
    near_end = F.col("_pos") >= (F.col("_blk") + 1) * F.lit(width) - F.lit(reach)
    # Each row goes to its own block and, near the end of it, also to the next one as look-back row.
    # An explicit repartition by columns is merged but never split at run time, so that blocks stay whole.
    spread = (
        base.withColumn("_shift", F.explode(F.when(near_end, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .withColumn("_blk", F.col("_blk") + F.col("_shift"))
        .withColumn("_halo", F.col("_shift") == 1)
        .drop("_shift")
        .repartition(*by_block)
    )
    key_fields = [df.schema[k] for k in keys]
    longs = [T.StructField(c, T.LongType()) for c in ("_blk", "_entry", "_exit")]
    table_schema = T.StructType(key_fields + longs)
    entry_schema = T.StructType(key_fields + longs[:2])

    def transfer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, by_block):
            gid, bounds, halo, own = _layout(pdf, by_block)
            n = len(pdf)
            nxt = _successors(pdf, own[gid], bounds[1:][gid], reach, col_list, accept)
            last = np.where(nxt == n, np.arange(n), nxt)
            while True:
                step = last[last]
                if np.array_equal(step, last):
                    break
                last = step
            ids = pdf["_id"].to_numpy()
            filled = own < bounds[1:]  # blocks with rows of their own
            heads = own[filled]
            look = np.flatnonzero(halo & filled[gid])
            rows = np.concatenate([heads, look])
            res = pdf.iloc[rows][by_block].reset_index(drop=True)
            res["_entry"] = np.concatenate([np.full(len(heads), MINUS), ids[look]])
            res["_exit"] = ids[last[rows]]
            yield res

    narrow = spread.select(*by_block, "_halo", "_pos", "_id", *[c for c in col_list if c not in keys])
    sup = F.floor(F.col("_blk") / F.lit(FAN)).cast("long")
    tables = (
        narrow.sortWithinPartitions(*by_block, "_pos", "_id")
        .mapInPandas(transfer, table_schema)
        .withColumn("_sup", sup)
    )
    # A few look-back rows per block, read several times below.
    tables = materialize(tables, "chain")
    by_sup = [*keys, "_sup"]

    def climb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, by_sup):
            rows, entries, exits = [], [], []
            for first, steps in _steps(pdf, by_sup):
                for entry in steps[0][1]:
                    state = entry
                    for _, table in steps:
                        state = table[state if state in table else MINUS]
                    rows.append(first)
                    entries.append(entry)
                    exits.append(state)
            res = pdf.iloc[rows][keys].reset_index(drop=True)
            res["_blk"] = pdf["_sup"].to_numpy()[rows]
            res["_entry"], res["_exit"] = entries, exits
            yield res

    def walk(by: list[str], start_col: str | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in whole_groups(batches, by):
                rows, blocks, entries = [], [], []
                for first, steps in _steps(pdf, by):
                    state = MINUS if start_col is None else int(pdf[start_col].iloc[first])
                    for blk, table in steps:
                        entry = state if state in table else MINUS
                        rows.append(first)
                        blocks.append(blk)
                        entries.append(entry)
                        state = table[entry]
                res = pdf.iloc[rows][keys].reset_index(drop=True)
                res["_blk"], res["_entry"] = blocks, entries
                yield res

        return run

    by_parts = tables.repartition(*by_sup)
    upper = by_parts.sortWithinPartitions(*by_sup, "_blk", "_entry").mapInPandas(climb, table_schema)
    tops = (
        upper.repartition(*keys)
        .sortWithinPartitions(*keys, "_blk", "_entry")
        .mapInPandas(walk(keys, None), entry_schema)
        .select(*keys, F.col("_blk").alias("_sup"), F.col("_entry").alias("_start"))
    )
    entries = (
        by_parts.join(tops, by_sup)
        .sortWithinPartitions(*by_sup, "_blk", "_entry")
        .mapInPandas(walk(by_sup, "_start"), entry_schema)
    )

    names = df.columns
    out_schema = T.StructType([df.schema[c] for c in names] + [T.StructField(out, T.BooleanType())])

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, by_block):
            gid, bounds, halo, own = _layout(pdf, by_block)
            n = len(pdf)
            nxt = _successors(pdf, own[gid], bounds[1:][gid], reach, col_list, accept)
            at = own.copy()
            resumed = np.flatnonzero(halo & (pdf["_id"].to_numpy() == pdf["_entry"].to_numpy()))
            at[gid[resumed]] = nxt[resumed]
            mask = np.zeros(n + 1, dtype=bool)
            at = at[at < n]
            while len(at):
                mask[at] = True
                at = nxt[at]
                at = at[at < n]
            pdf[out] = mask[:n]
            yield pdf.loc[~halo, out_schema.names]

    return (
        spread.join(entries, by_block)
        .sortWithinPartitions(*by_block, "_pos", "_id")
        .mapInPandas(replay, out_schema)
    )


PART_ROWS = 500_000
HOT_JOBS = 1000


def with_job_row(
    rows: DataFrame, per_job: DataFrame, by: Column, how: str = "left", sizes: DataFrame | None = None, part_rows: int = PART_ROWS
) -> DataFrame:
    """Rows next to their job's single row of ``per_job``.

    One job may hold nearly all rows.  The rows of a job with more than ``part_rows`` of them are dealt out by a hash of ``by`` into
    as many parts as its size asks for, and its job row is repeated to meet them; all other jobs are left as they are.  This
    holds for the 1000 largest jobs, a list of bounded size that is broadcast: any other job has at most a thousandth of
    all rows.  ``sizes`` (job_id, n) saves counting the rows; it only steers the dealing, so it may be approximate.
    """
    if sizes is None:
        sizes = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / F.lit(part_rows)).cast("int").alias("_parts")
    hot = F.broadcast(sizes.filter(F.col("n") > part_rows).orderBy(F.desc("n"), "job_id").limit(HOT_JOBS).select("job_id", parts))
    number = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(hot, "job_id", "left").withColumn("_part", F.pmod(F.xxhash64(by), number).cast("int")).drop("_parts")
    copies = per_job.join(hot, "job_id", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), number - 1))).drop("_parts")
    return dealt.join(copies, ["job_id", "_part"], how).drop("_part")
