"""The streaming operators, fed with the supplied tables cut into files in time order."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cliploom import fixtures as fx
from cliploom.catalog import manage as mg
from cliploom.sources.scratch import materialize_alone, scratch_dir
from cliploom.streaming import monitors as mon

SLICES = 3
FILES = 4
FILE_ROWS = 1_000_000


def run_slices(df, at: str, operator, closing: bool = False):
    """Let ``df`` arrive in SLICES slices in the order of ``at``, rows of a slice in no order, and run ``operator`` on them.

    A slice is FILES files, more where they would hold over FILE_ROWS rows, and one micro-batch.  ``closing`` adds a far later
    row of job -1 as a last slice, which lets the watermark pass the end.
    """
    spark = df.sparkSession
    root = f"{scratch_dir(spark)}/streams/{uuid.uuid4().hex}"
    lo, hi, n = df.agg(F.min(at), F.max(at), F.count(F.lit(1))).first()
    step = (hi - lo) // SLICES + 1
    slices = [df.filter((F.col(at) >= lo + i * step) & (F.col(at) < lo + (i + 1) * step)) for i in range(SLICES)]
    if closing:
        last = df.limit(1).withColumn("job_id", F.lit(-1).cast("long")).withColumn(at, F.lit(hi + 86_400_000).cast("long"))
        if "ts" in df.columns:
            last = last.withColumn("ts", mon.event_time(at))
        if at != "end_ms" and "end_ms" in df.columns:
            last = last.withColumn("end_ms", F.col(at))
        slices.append(last.select(df.columns))
    files = max(FILES, -(-n // (SLICES * FILE_ROWS)))
    for part in slices:
        part.repartition(files).write.mode("append").parquet(f"{root}/in")
    stores = mon.store_partitions(spark, n // SLICES)
    out = mon.run_available(operator(mon.read_stream(spark, f"{root}/in", df.schema, files)), f"{root}/out", f"{root}/state", stores)
    return out.filter("job_id <> -1")


def word_rows(s, d):
    return fx.words(s, d).select("job_id", "start_ms", "end_ms").withColumn("ts", mon.event_time("start_ms"))


def sessions(s, d):
    return run_slices(word_rows(s, d), "start_ms", mon.speech_sessions, closing=True)


def counts(s, d):
    return run_slices(word_rows(s, d), "start_ms", mon.tumbling_counts, closing=True)


def duplicates(s, d):
    return run_slices(fx.frames(s, d).withColumn("ts", mon.event_time("ts_ms")), "ts_ms", mon.near_duplicates, closing=True)


def alerts(s, d):
    c = mg.priced(s, d).join(mg.budgets(s, d), "job_id")
    c = c.select("job_id", F.col("ts").cast("timestamp").alias("ts"), "call_id", "cost_usd", "budget_usd")
    c = c.withColumn("at", F.unix_millis("ts"))
    # Every tenth call twice; written once, since each slice reads it.
    times = F.when(F.expr("call_id % 10 = 3"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    twice = materialize_alone(c.withColumn("_time", F.explode(times)).drop("_time"), "calls")
    groups = mon.job_groups(s, twice.count())
    return run_slices(twice, "at", lambda calls: mon.budget_alerts(calls, groups=groups), closing=True).withColumn("total_usd", F.round("total_usd", 6))


def transitions(s, d):
    # Events of a job are numbered in id order, so that order also gives the arrival time here.
    e = fx.job_events(s, d).select("job_id", "seq", "state", (F.col("seq") * 60_000).alias("at"))
    return run_slices(e.withColumn("ts", mon.event_time("at")), "at", mon.transition_alerts, closing=True)


LATE_BATCHES = 104


def late_rows(s, d):
    """Frames that come after the watermark has passed them, counted over more batches than Spark keeps the progress of.

    Every frame comes in time; the first two of each job come once more, in ``LATE_BATCHES`` files and as many batches, when all is over.
    """
    frames = fx.frames(s, d).select("job_id", "frame_number", "ts_ms").withColumn("ts", mon.event_time("ts_ms"))
    root = f"{scratch_dir(s)}/streams/{uuid.uuid4().hex}"
    end, n = frames.agg(F.max("ts_ms"), F.count(F.lit(1))).first()
    hi, stores = end + 86_400_000, mon.store_partitions(s, n)
    last = frames.limit(1).select(F.lit(-1).cast("long").alias("job_id"), "frame_number", F.lit(hi).cast("long").alias("ts_ms"))

    def run(files: int | None) -> int:
        once = mon.delivered_once(mon.read_stream(s, f"{root}/in", frames.schema, files), ["job_id", "frame_number"])
        return mon.run_counted(once, f"{root}/out", f"{root}/state", stores)[1]

    frames.unionByName(last.withColumn("ts", mon.event_time("ts_ms"))).write.mode("append").parquet(f"{root}/in")
    run(None)
    again = frames.where("frame_number <= 2")
    again.repartition(LATE_BATCHES, F.pmod("job_id", F.lit(LATE_BATCHES)), "frame_number").write.mode("append").parquet(f"{root}/in")
    return s.range(1).select(F.lit(run(1)).cast("long").alias("late_rows"))


QUERIES = {
    "str1_speech_sessions": (sessions, fx.with_tables("islands") + "\nSELECT * FROM islands"),
    "str2_near_duplicate_stream": (duplicates, fx.with_tables("deduped") + "\nSELECT * FROM deduped"),
    "str3_budget_alerts": (
        alerts,
        fx.with_tables("priced", "budgets") + """,
r AS (SELECT p.job_id, p.call_id, budget_usd, sum(cost_usd) OVER w AS t, row_number() OVER w AS k FROM priced p JOIN budgets USING (job_id) WINDOW w AS (PARTITION BY job_id ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING)),
a AS (SELECT job_id, min_by(call_id, k) AS call_id, 'budget.warning' AS event_type, min_by(t, k) AS t FROM r WHERE t >= budget_usd * 0.8::DOUBLE GROUP BY job_id
  UNION ALL SELECT job_id, min_by(call_id, k), 'budget.blocked', min_by(t, k) FROM r WHERE t >= budget_usd GROUP BY job_id)
SELECT job_id, call_id, event_type, round(t, 6) AS total_usd FROM a""",
    ),
    "str4_illegal_transitions": (
        transitions,
        fx.with_tables("job_events") + f""", m(a, b) AS (VALUES {mg._MOVES}),
p AS (SELECT job_id, seq, lag(state) OVER (PARTITION BY job_id ORDER BY seq) AS prev_state, state FROM job_events)
SELECT * FROM p WHERE prev_state IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m WHERE m.a = p.prev_state AND m.b = p.state)""",
    ),
    "str6_late_rows": (late_rows, fx.with_tables("frames") + "\nSELECT count(*) AS late_rows FROM frames WHERE frame_number <= 2"),
    "str5_tumbling_counts": (
        counts,
        fx.with_tables("words") + """,
e AS (SELECT job_id, end_ms, unnest(CASE WHEN start_ms = end_ms AND start_ms % 15000 = 0 AND start_ms > 0 THEN [start_ms - 1, start_ms] ELSE [start_ms] END) AS pos FROM words)
SELECT job_id, pos // 15000 AS seq, CAST(count(*) FILTER (end_ms <= (pos // 15000 + 1) * 15000) AS BIGINT) AS word_count, count(*) FILTER (end_ms <= (pos // 15000 + 1) * 15000) = 0 AS is_silent FROM e GROUP BY ALL""",
    ),
}
