"""Structured Streaming forms of the sequential operators.

Each takes a streaming DataFrame with an event time ``ts`` (TIMESTAMP) and gives the rows the batch
operator gives, in whatever order rows arrive within the watermark.  Later rows are dropped and counted.

Operators that need a job's rows in order hold them back (``Ordered``): a row waits in the bucket of its time, and a timer
releases the bucket once the watermark has passed it.  A task holds one bucket of one job, never a job's micro-batch; few
rows of several buckets wait together, so that a job with a row an hour costs one value and not one for each row.
Budget alerts keep many jobs under one key of the state, so that very many small jobs do not each cost calls to the store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cliploom.operators.jobs import is_legal

# Positions count from one day after the epoch: a watermark starts at the epoch and would drop time 0.
ORIGIN_MS = 86_400_000


def event_time(ms: str):
    """TIMESTAMP of a position inside the video."""
    return F.timestamp_millis(F.col(ms) + ORIGIN_MS)


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the parquet files below a folder; ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


# State with timers and several values per key needs this store.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# A batch writes what it changed in a store, not the whole store again.
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
PARTITIONS = "spark.sql.shuffle.partitions"
STORE_ROWS = 1_000_000  # rows that one state store is meant for


def store_partitions(spark: SparkSession, rows: int) -> int:
    """State stores for ``rows`` rows: every store costs some time in every batch, however little it holds.

    Few rows get fewer stores than a shuffle has partitions, but enough for the cores; many rows get more.
    """
    least = min(int(spark.conf.get(PARTITIONS)), spark.sparkContext.defaultParallelism)
    return max(least, -(-rows // STORE_ROWS))


def run_counted(stream: DataFrame, out: str, checkpoint: str, partitions: int | None = None) -> tuple[DataFrame, int]:
    """Process everything that is there now into a parquet table; the table, and how many rows came too late.

    Spark keeps the progress of the last hundred batches only, so late rows are added up while the query runs.
    ``partitions`` is the number of state stores; a checkpoint keeps that of its first run.
    """
    spark = stream.sparkSession
    settings = {STORE: ROCKSDB, CHANGELOG: "true"} | ({} if partitions is None else {PARTITIONS: str(partitions)})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    try:
        q = writer.outputMode("append").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    late: dict[int, int] = {}
    ended = False
    while not ended:
        ended = q.awaitTermination(1)
        late |= {p["batchId"]: sum(op["numRowsDroppedByWatermark"] for op in p["stateOperators"]) for p in q.recentProgress}
    return spark.read.schema(stream.schema).parquet(out), sum(late.values())


def run_available(stream: DataFrame, out: str, checkpoint: str, partitions: int | None = None) -> DataFrame:
    return run_counted(stream, out, checkpoint, partitions)[0]


def speech_sessions(words: DataFrame, gap_ms: int = 1500, late: str = "1 minute") -> DataFrame:
    """Speech intervals of a word stream (job_id, ts, start_ms, end_ms).

    Each word holds its session open for its length plus the gap; one microsecond more makes the
    limit inclusive, as in the batch rule.
    """
    hold = F.concat(((F.col("end_ms") - F.col("start_ms") + gap_ms) * 1000 + 1).cast("string"), F.lit(" microseconds"))
    s = words.withWatermark("ts", late).groupBy("job_id", F.session_window("ts", hold).alias("w"))
    return s.agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).select("job_id", "start_ms", "end_ms")


def tumbling_counts(words: DataFrame, width_s: int = 15, late: str = "1 minute") -> DataFrame:
    """Words inside each window of ``width_s`` seconds, and whether the window has only cut-off words.

    A zero-length word on a window border counts on both sides.
    """
    width = width_s * 1000
    border = (F.col("end_ms") == F.col("start_ms")) & (F.col("start_ms") % width == 0) & (F.col("start_ms") > 0)
    at = F.explode(F.when(border, F.array(F.col("start_ms") - 1, F.col("start_ms"))).otherwise(F.array("start_ms")))
    placed = words.withColumn("_at", at).withColumn("ts", event_time("_at"))
    w = F.window("ts", f"{width_s} seconds")
    limit = (F.floor(F.col("_at") / width) + 1) * width
    g = placed.withColumn("_in", (F.col("end_ms") <= limit).cast("long")).withWatermark("ts", late).groupBy("job_id", w.alias("w"))
    return g.agg(F.sum("_in").alias("word_count")).select(
        "job_id", ((F.unix_millis("w.start") - ORIGIN_MS) / width).cast("long").alias("seq"), "word_count", (F.col("word_count") == 0).alias("is_silent")
    )


def delivered_once(rows: DataFrame, key: list[str], late: str = "1 minute") -> DataFrame:
    """Rows of a stream that may come several times, each once; every row that comes too late is counted by itself."""
    return rows.withWatermark("ts", late).dropDuplicates([*key, "ts"])


class Ordered(StatefulProcessor):
    """Rows of a key in the order of ``order``, bucket by bucket of ``width_ms``, once the watermark has passed them.

    Subclasses give ``kept`` (DDL of what they carry along) and ``step(key, rows, before)``, which returns the rows to put out
    and what to carry.  What a key carries is let go once the watermark is ``idle_ms`` past its last row.
    """

    kept = ""
    together = 64  # parts that are released in one step; the parts of a bucket stay together
    few = 1000  # rows of more than one bucket that wait in one part, under the first of them

    def __init__(self, out: T.StructType, order: list[str], width_ms: int, idle_ms: int):
        self.out, self.order, self.width, self.idle = out, order, width_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carried = handle.getValueState("carried", self.kept)
        self.last = handle.getValueState("last", "ms long")
        # Rows that wait, packed by their first bucket of time and arrival.
        self.waiting = handle.getMapState("waiting", "bucket long, part int", "data binary")

    def step(self, key: tuple, rows: pd.DataFrame, before: tuple | None) -> tuple[pd.DataFrame, tuple]:
        raise NotImplementedError

    def _bucket(self, rows: pd.DataFrame) -> np.ndarray:
        return rows["ts"].astype("datetime64[ms]").astype("int64").to_numpy() // self.width

    def _keep(self, rows: pd.DataFrame, parts: dict[int, int]) -> None:
        """Let rows wait; ``parts`` counts the parts under each bucket."""
        bucket = self._bucket(rows)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        packed = pa.RecordBatch.from_pandas(rows, preserve_index=False).take(pa.array(order))
        edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))).tolist()
        i = 0
        for k in range(1, len(edges)):
            j = edges[k]
            if k + 1 < len(edges) and edges[k + 1] - i <= self.few:
                continue
            b = int(bucket[i])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, packed.schema) as writer:
                writer.write_batch(packed.slice(i, j - i))
            self.waiting.updateValue((b, parts.get(b, 0)), (sink.getvalue().to_pybytes(),))
            parts[b] = parts.get(b, 0) + 1
            i = j

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.last.get()[0] if self.last.exists() else None
        last, parts = before, {}
        for b, n in self.waiting.keys():
            parts[b] = max(parts.get(b, 0), n + 1)
        for chunk in rows:
            ms = int(chunk["ts"].astype("datetime64[ms]").astype("int64").max())
            last = ms if last is None else max(last, ms)
            self._keep(chunk, parts)
        if last != before:
            self.last.update((last,))
        # One timer for the first bucket; each release asks for the next.
        self.handle.registerTimer((min(parts) + 1) * self.width)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.keys())
        over = past // self.width  # the first bucket that the watermark has not passed
        ready = [k for k in waiting if k[0] < over]
        later = [k[0] for k in waiting[len(ready) :]]
        if ready:
            before = tuple(self.carried.get()) if self.carried.exists() else None
            done, rest = 0, None
            while done < len(ready):
                end = min(len(ready), done + self.together)
                while end < len(ready) and ready[end][0] == ready[end - 1][0]:
                    end += 1
                read = [pa.ipc.open_stream(self.waiting.getValue(k)[0]).read_all() for k in ready[done:end]]
                if rest is not None:
                    read.append(rest)
                # A part whose numbers have gaps holds them as doubles (hash halves of 32 bits stay exact).
                rows = pa.concat_tables(read, promote_options="permissive").to_pandas()
                # What belongs to buckets of parts not yet read goes on with them.
                now = self._bucket(rows) < (ready[end][0] if end < len(ready) else over)
                rest = None if now.all() else pa.Table.from_pandas(rows[~now], preserve_index=False)
                got, before = self.step(key, rows[now].sort_values(self.order, ignore_index=True), before)
                for k in ready[done:end]:
                    self.waiting.removeKey(k)
                if len(got):
                    yield got[self.out.names]
                done = end
            self.carried.update(before)
            if rest is not None:
                parts: dict[int, int] = {}
                for b, n in waiting[len(ready) :]:
                    parts[b] = max(parts.get(b, 0), n + 1)
                self._keep(rest.to_pandas(), parts)
                later = list(parts)
        if later:
            self.handle.registerTimer((min(later) + 1) * self.width)
        elif self.last.exists():
            rest = self.last.get()[0] + self.idle
            if past >= rest:
                self.carried.clear()
                self.last.clear()
            else:
                self.handle.registerTimer(rest)

    def over(self, rows: DataFrame, late: str | None, key: str = "job_id") -> DataFrame:
        """The operator on a stream; ``late`` is None if that has a watermark already."""
        marked = rows if late is None else rows.withWatermark("ts", late)
        return marked.groupBy(key).transformWithStateInPandas(statefulProcessor=self, outputStructType=self.out, outputMode="append", timeMode="eventTime")


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.astype(np.uint64)).astype(np.int64)


LOOK = 256  # rows compared with the last kept one at a time


def _greedy_flags(at, hi, lo, known, kept: tuple, threshold: int, min_interval_ms: int) -> tuple[np.ndarray, tuple]:
    """Which rows are near the last kept row; ``kept`` is (hashed, hi, lo, at) of the one before, at may be None.

    Goes from kept row to kept row; what lies between is compared by arrays.
    """
    flags = np.zeros(len(at), bool)
    i = 0
    hashed, khi, klo, kat = kept
    while i < len(at):
        e = min(len(at), i + LOOK)
        if hashed and kat is not None:
            near = known[i:e] & (at[i:e] - kat < min_interval_ms) & (_bits(hi[i:e] ^ khi) + _bits(lo[i:e] ^ klo) <= threshold)
        else:
            near = np.zeros(e - i, bool)
        stop = int(np.argmin(near)) if not near.all() else len(near)
        flags[i : i + stop] = True
        i += stop
        if stop < len(near):
            hashed, khi, klo, kat = bool(known[i]), int(hi[i]), int(lo[i]), int(at[i])
            i += 1
    return flags, (hashed, khi, klo, kat)


class NearDuplicates(Ordered):
    """Carries the last kept frame."""

    kept = "hashed boolean, hi long, lo long, at long"

    def __init__(self, out: T.StructType, width_ms: int, idle_ms: int, threshold: int, min_interval_ms: int):
        super().__init__(out, ["ts_ms", "frame_number"], width_ms, idle_ms)
        self.threshold, self.interval = threshold, min_interval_ms

    def step(self, key, rows, before):
        known = rows["phash_hi"].notna().to_numpy()
        hi, lo = (rows[c].fillna(0).to_numpy().astype(np.int64) for c in ("phash_hi", "phash_lo"))
        rows["is_duplicate"], kept = _greedy_flags(rows["ts_ms"].to_numpy(), hi, lo, known, before or (False, 0, 0, None), self.threshold, self.interval)
        return rows, kept


def near_duplicates(frames: DataFrame, threshold: int = 10, min_interval_ms: int = 30_000, late: str = "1 minute", idle_s: int = 3600, width_ms: int = 60_000) -> DataFrame:
    """Flag near-duplicate frames of a stream (job_id, ts, frame_number, ts_ms, phash_hi, phash_lo)."""
    out = T.StructType(
        [frames.schema[c] for c in ("job_id", "frame_number", "ts_ms", "phash_hi", "phash_lo")] + [T.StructField("is_duplicate", T.BooleanType())]
    )
    return NearDuplicates(out, width_ms, idle_s * 1000, threshold, min_interval_ms).over(frames, late)


GROUP_ROWS = 50_000  # calls that one group of jobs is meant for


def job_groups(spark: SparkSession, rows: int) -> int:
    """Groups of jobs for ``rows`` calls: a few for each core at least, since every group costs some time in every batch."""
    return max(4 * store_partitions(spark, 0), -(-rows // GROUP_ROWS))


class BudgetAlerts(Ordered):
    """Carries, for each job of a group, the time of its last call, the sum and the highest level that was reported.

    The key is the number of the group, so that calls to the state store, which cost far more than adding up, are made per group
    and batch, not per job and batch. Calls without a job are a group of their own, -1.
    """

    columns = ["job_id", "ts", "call_id", "cost_usd", "budget_usd"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Jobs with last, total and level, packed.
        self.jobs = handle.getValueState("jobs", "data binary")
        self.waiting = handle.getMapState("waiting", "bucket long, part int", "data binary")

    def _jobs(self) -> pd.DataFrame | None:
        if not self.jobs.exists():
            return None
        return pa.ipc.open_stream(self.jobs.get()[0]).read_all().to_pandas().set_index("job_id")

    def _put(self, jobs: pd.DataFrame) -> None:
        packed = pa.Table.from_pandas(jobs.reset_index(), preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, packed.schema) as writer:
            writer.write_table(packed)
        self.jobs.update((sink.getvalue().to_pybytes(),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts: dict[int, int] = {}
        for b, n in self.waiting.keys():
            parts[b] = max(parts.get(b, 0), n + 1)
        last = []
        for chunk in rows:
            chunk = chunk[self.columns]
            if key[0] < 0:
                chunk = chunk.assign(job_id=0)
            ms = chunk["ts"].astype("datetime64[ms]").astype("int64")
            last.append(ms.groupby(chunk["job_id"]).max())
            self._keep(chunk, parts)
        jobs = self._jobs()
        if jobs is not None:
            last.append(jobs["last"])
        last = pd.concat(last).groupby(level=0).max()
        now = pd.DataFrame({"last": last, "total": 0.0, "level": 0}, index=last.index).rename_axis("job_id")
        if jobs is not None:
            now.loc[jobs.index, ["total", "level"]] = jobs[["total", "level"]]
        self._put(now)
        self.handle.registerTimer((min(parts) + 1) * self.width)
        return iter([])

    def _release(self, past: int, step: Callable[[pd.DataFrame], pd.DataFrame]):
        """Put out what ``step`` makes of the rows that the watermark has passed, in order; returns the buckets that go on waiting."""
        waiting = sorted(self.waiting.keys())
        over = past // self.width  # the first bucket that the watermark has not passed
        ready = [k for k in waiting if k[0] < over]
        later = [k[0] for k in waiting[len(ready) :]]
        done, rest = 0, None
        while done < len(ready):
            end = min(len(ready), done + self.together)
            while end < len(ready) and ready[end][0] == ready[end - 1][0]:
                end += 1
            read = [pa.ipc.open_stream(self.waiting.getValue(k)[0]).read_all() for k in ready[done:end]]
            if rest is not None:
                read.append(rest)
            # A part whose numbers have gaps holds them as doubles (hash halves of 32 bits stay exact).
            rows = pa.concat_tables(read, promote_options="permissive").to_pandas()
            # What belongs to buckets of parts not yet read goes on with them.
            now = self._bucket(rows) < (ready[end][0] if end < len(ready) else over)
            rest = None if now.all() else pa.Table.from_pandas(rows[~now], preserve_index=False)
            got = step(rows[now].sort_values(self.order, ignore_index=True))
            for k in ready[done:end]:
                self.waiting.removeKey(k)
            if len(got):
                yield got[self.out.names]
            done = end
        if rest is not None:
            parts: dict[int, int] = {}
            for b, n in waiting[len(ready) :]:
                parts[b] = max(parts.get(b, 0), n + 1)
            self._keep(rest.to_pandas(), parts)
            later = list(parts)
        return later

    def _add(self, rows: pd.DataFrame, jobs: pd.DataFrame, key: tuple) -> pd.DataFrame:
        """Alerts of rows in order of time; counts them in ``added`` and ``level`` of ``jobs``."""
        code = jobs.index.get_indexer(rows["job_id"])
        order = np.argsort(code, kind="stable")
        rows, code = rows.iloc[order], code[order]
        total, added, level = (jobs[c].to_numpy().copy() for c in ("total", "added", "level"))
        cost = rows["cost_usd"].to_numpy(dtype=float)
        # What a release adds is summed up by itself and in order, so that sums do not depend on where its steps end.
        run = np.where(np.isnan(cost), 0.0, cost)
        edges = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1], [True])))
        own = code[edges[:-1]]
        run[edges[:-1]] += added[own]
        for b, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            np.cumsum(run[b:e], out=run[b:e])
        added[own] = run[edges[1:] - 1]
        run = np.where(np.isnan(cost), np.nan, total[code] + run)  # a call without a cost reaches nothing
        budget = rows["budget_usd"].to_numpy(dtype=float)
        found = []
        for want, (share, name) in enumerate(((0.8, "budget.warning"), (1.0, "budget.blocked")), start=1):
            hit = np.flatnonzero((level[code] < want) & (run >= budget * share))
            who, first = np.unique(code[hit], return_index=True)  # rows of a job are in order, so the first is the earliest
            level[who] = want
            at = hit[first]
            found.append(pd.DataFrame({"job_id": rows["job_id"].iloc[at].array if key[0] >= 0 else None, "call_id": rows["call_id"].iloc[at].array, "event_type": name, "total_usd": run[at]}))
        jobs["added"], jobs["level"] = added, level
        return pd.concat([f for f in found if len(f)] or found[:1], ignore_index=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = timerValues.getCurrentWatermarkInMs()
        jobs = self._jobs()
        if jobs is None:
            return
        jobs["added"] = 0.0
        later = yield from self._release(past, lambda rows: self._add(rows, jobs, key))
        jobs["total"] += jobs.pop("added")
        # A job that is idle for long is let go, unless calls of it still wait.
        waits, rest = jobs["last"] // self.width >= past // self.width, jobs["last"] + self.idle
        jobs = jobs[waits | (rest > past)]
        if len(jobs):
            self._put(jobs)
        else:
            self.jobs.clear()
        ahead = [(min(later) + 1) * self.width] if later else []
        rest = rest[~waits & (rest > past)]
        if len(rest):
            ahead.append(int(rest.min()))
        if ahead:
            self.handle.registerTimer(min(ahead))


def budget_alerts(calls: DataFrame, late: str = "1 hour", idle_s: int = 30 * 86_400, width_ms: int = 3_600_000, groups: int = 64) -> DataFrame:
    """First call of a job that reaches 80 % and 100 % of its budget, once each.

    ``calls``: job_id, ts, call_id, cost_usd, budget_usd.  Calls delivered twice within the watermark
    count once.  A job's sum is forgotten ``idle_s`` after its last call, so it must not come back later than that.
    Jobs are dealt out by hash over ``groups`` keys of the state (see ``job_groups``); a checkpoint keeps its number for ever.
    """
    out = T.StructType(
        [calls.schema["job_id"], calls.schema["call_id"], T.StructField("event_type", T.StringType()), T.StructField("total_usd", T.DoubleType())]
    )
    once = calls.withWatermark("ts", late).dropDuplicatesWithinWatermark(["job_id", "call_id"])
    group = F.when(F.col("job_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("job_id"), F.lit(groups)).cast("int"))
    return BudgetAlerts(out, ["ts", "call_id"], width_ms, idle_s * 1000).over(once.withColumn("_group", group), None, "_group")


class Moves(Ordered):
    """Carries the last state; puts out every move."""

    kept = "state string"

    def step(self, key, rows, before):
        rows["prev_state"] = rows["state"].shift(1)
        if before is not None:
            rows.loc[0, "prev_state"] = before[0]
        return rows, (rows["state"].iloc[-1],)


def transition_alerts(events: DataFrame, late: str = "1 hour", idle_s: int = 30 * 86_400, width_ms: int = 3_600_000) -> DataFrame:
    """Illegal moves in a job event stream (job_id, ts, seq, state).  A job's state is forgotten ``idle_s`` after its last event."""
    out = T.StructType(
        [events.schema["job_id"], events.schema["seq"], T.StructField("prev_state", T.StringType()), T.StructField("state", T.StringType())]
    )
    moves = Moves(out, ["seq"], width_ms, idle_s * 1000).over(events, late)
    return moves.filter(F.col("prev_state").isNotNull() & ~is_legal(F.col("prev_state"), F.col("state")))
