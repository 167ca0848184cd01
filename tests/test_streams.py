"""Late rows, forgotten state and array-wise comparison in the streaming operators."""

import random

import numpy as np
from pyspark.sql import functions as F

from cliploom.streaming import monitors as mon


def batches(spark, tmp_path, schema, slices, operator):
    """Run the operator after each slice has arrived; the table and the number of late rows."""
    late = 0
    for rows in slices:
        df = spark.createDataFrame(rows, schema)
        df.write.mode("append").parquet(f"{tmp_path}/in")
        out, n = mon.run_counted(operator(mon.read_stream(spark, f"{tmp_path}/in", df.schema)), f"{tmp_path}/out", f"{tmp_path}/state")
        late += n
    return out, late


def at(seconds):
    import datetime as dt

    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_late_frames_are_dropped_and_counted(spark, tmp_path):
    schema = "job_id long, ts timestamp, frame_number long, ts_ms long, phash_hi long, phash_lo long"
    frame = lambda n, s, h=0: (1, at(s), n, s * 1000, h, 0)
    # The watermark is one minute behind; the second slice moves it to 540 s, and frame 9 at 10 s is then too late.
    slices = [[frame(1, 0), frame(2, 1)], [frame(3, 600, 2**31)], [frame(9, 10), frame(4, 601, 2**31)], [(-1, at(90_000), 1, 90_000_000, 0, 0)]]
    out, late = batches(spark, tmp_path, schema, slices, mon.near_duplicates)
    assert sorted((r["frame_number"], r["is_duplicate"]) for r in out.collect()) == [(1, False), (2, True), (3, False), (4, True)]
    assert late == 1


def test_frames_out_of_order_give_the_batch_result(spark, tmp_path):
    schema = "job_id long, ts timestamp, frame_number long, ts_ms long, phash_hi long, phash_lo long"
    r = random.Random(3)
    frames = [(job, at(s / 10), n, s * 100, r.choice([0, 1, 2**31 - 1, 5]), 0) for job in (1, 2) for n, s in enumerate(sorted(r.sample(range(4000), 300)))]
    mixed = sorted(frames, key=lambda f: f[3] + r.randrange(50_000))  # less than the watermark's minute out of place
    slices = [mixed[i : i + 150] for i in range(0, len(mixed), 150)] + [[(-1, at(90_000), 1, 90_000_000, 0, 0)]]
    out, late = batches(spark, tmp_path, schema, slices, lambda df: mon.near_duplicates(df, width_ms=7_000))
    want = set()
    for job in (1, 2):
        own = sorted((f for f in frames if f[0] == job), key=lambda f: (f[3], f[2]))
        cols = [np.array([f[k] for f in own], np.int64) for k in (3, 4, 5)]
        flags, _ = mon._greedy_flags(*cols, np.ones(len(own), bool), (False, 0, 0, None), 10, 30_000)
        want |= {(job, f[2], bool(x)) for f, x in zip(own, flags, strict=True)}
    assert late == 0
    assert {(r["job_id"], r["frame_number"], r["is_duplicate"]) for r in out.collect()} == want


def test_late_calls_do_not_count_against_the_budget(spark, tmp_path):
    schema = "job_id long, ts timestamp, call_id long, cost_usd double, budget_usd double"
    call = lambda n, s, usd: (1, at(s), n, usd, 10.0)
    slices = [[call(1, 0, 5.0)], [call(2, 20_000, 1.0)], [call(3, 100, 100.0), call(4, 20_001, 2.5)], [(-1, at(200_000), 9, 0.0, 1.0)]]
    out, late = batches(spark, tmp_path, schema, slices, mon.budget_alerts)
    assert [(r["call_id"], r["event_type"], r["total_usd"]) for r in out.collect()] == [(4, "budget.warning", 8.5)]
    assert late == 1


def test_state_of_finished_jobs_is_forgotten(spark, tmp_path):
    schema = "job_id long, ts timestamp, seq long, state string"
    slices = [[(1, at(0), 0, "created")], [(2, at(50_000), 0, "created")], [(2, at(50_001), 1, "rendering")], [(1, at(60_000), 1, "rendering")], [(3, at(72_000), 0, "created")]]
    out, _ = batches(spark, tmp_path, schema, slices, lambda df: mon.transition_alerts(df, idle_s=3600))
    # Job 1 came back long after an hour of silence: its old state is gone, so its move cannot be judged.
    assert [tuple(r) for r in out.collect()] == [(2, 1, "created", "rendering")]
    # Only what is not idle and what waits is still held.
    held = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "carried").load()
    assert {r["key"]["job_id"] for r in held.select("key").collect()} <= {1}
    waits = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "waiting").load()
    assert [r["key"]["job_id"] for r in waits.select("key").collect()] == [3]


def test_array_steps_equal_the_plain_loop():
    r = random.Random(1)
    for _ in range(50):
        n = r.randrange(1, 900)
        ts = np.sort(np.array([r.randrange(200_000) for _ in range(n)]))
        hi, lo = np.array([r.choice([0, 1, 3, 2**31, 12345]) for _ in range(n)]), np.array([r.choice([0, 7, 2**30]) for _ in range(n)])
        known = np.array([r.random() < 0.9 for _ in range(n)])
        start = r.choice([(False, 0, 0, None), (True, 1, 0, -5000), (False, 0, 0, -1)])
        hashed, khi, klo, kat = start
        want = []
        for t, a, b, k in zip(ts, hi, lo, known, strict=True):
            dup = bool(k and hashed and kat is not None and t - kat < 30_000 and (int(a) ^ khi).bit_count() + (int(b) ^ klo).bit_count() <= 2)
            want.append(dup)
            if not dup:
                hashed, khi, klo, kat = bool(k), int(a), int(b), int(t)
        flags, end = mon._greedy_flags(ts, hi, lo, known, start, 2, 30_000)
        assert flags.tolist() == want and end[0] == hashed and end[3] == kat


def test_session_counts_follow_the_batch_rule(spark, tmp_path):
    schema = "job_id long, start_ms long, end_ms long, ts timestamp"
    rows = spark.createDataFrame([(1, 0, 100), (1, 1600, 1700), (1, 9000, 9100), (-1, 10**8, 10**8)], "job_id long, start_ms long, end_ms long")
    rows = rows.withColumn("ts", mon.event_time("start_ms")).collect()
    out, _ = batches(spark, tmp_path, schema, [[tuple(r) for r in rows]], mon.speech_sessions)
    assert sorted(tuple(r) for r in out.where(F.col("job_id") == 1).collect()) == [(1, 0, 1700), (1, 9000, 9100)]


def test_few_rows_of_many_buckets_wait_together(spark, tmp_path):
    schema = "job_id long, ts timestamp, seq long, state string"
    walk = ["created", "rendering", "created", "ingesting"]
    events = [(job, at(3600 * n), n, walk[n % 4]) for job in (1, 2) for n in range(40)]
    out, _ = batches(spark, tmp_path, schema, [events], mon.transition_alerts)
    waits = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "waiting").load()
    assert waits.count() <= 4  # one part of a job for what the first watermark left, not one for each hour
    far = [(-1, at(3600 * 100), 0, "created")]
    out, late = batches(spark, tmp_path, schema, [far], mon.transition_alerts)
    legal = {("created", "ingesting")}
    want = {(j, n, walk[(n - 1) % 4], walk[n % 4]) for j in (1, 2) for n in range(1, 40) if (walk[(n - 1) % 4], walk[n % 4]) not in legal}
    assert {tuple(r) for r in out.collect()} == want and late == 0


def test_parts_that_reach_over_each_other_are_released_in_order(spark, tmp_path):
    schema = "job_id long, ts timestamp, seq long, state string"
    r = random.Random(5)
    mixed = sorted(((1, at(7 * n), n, str(n)) for n in range(400)), key=lambda e: e[2] * 7 + r.randrange(500))
    slices = [mixed[i : i + 80] for i in range(0, 400, 80)] + [[(-1, at(90_000), 0, "x")]]

    def moves(df):
        names = mon.T.StructType([df.schema["job_id"], df.schema["seq"], mon.T.StructField("prev_state", mon.T.StringType()), df.schema["state"]])
        op = mon.Moves(names, ["seq"], 20_000, 3_600_000)
        op.few, op.together = 9, 2
        return op.over(df, "10 minutes")

    out, late = batches(spark, tmp_path, schema, slices, moves)
    got = {(x["seq"], x["prev_state"]) for x in out.where("job_id = 1").collect()}
    assert late == 0 and got == {(n, str(n - 1) if n else None) for n in range(400)}


def test_few_rows_get_few_stores(spark, tmp_path):
    spark.createDataFrame([(1, at(0), 0), (1, at(0), 0), (2, at(1), 0)], "job_id long, ts timestamp, n long").write.parquet(f"{tmp_path}/in")
    stream = mon.delivered_once(mon.read_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema), ["job_id", "n"])
    before = spark.conf.get(mon.PARTITIONS)
    out, late = mon.run_counted(stream, f"{tmp_path}/out", f"{tmp_path}/state", partitions=2)
    assert out.count() == 2 and late == 0
    assert sorted(p.name for p in (tmp_path / "state" / "state" / "0").iterdir() if p.name.isdigit()) == ["0", "1"]
    assert spark.conf.get(mon.PARTITIONS) == before and spark.conf.get(mon.CHANGELOG, "false") == "false"
    # Stores grow with the rows, and every core has one unless the session has fewer partitions.
    least = min(int(before), spark.sparkContext.defaultParallelism)
    assert mon.store_partitions(spark, 10) == least and mon.store_partitions(spark, 50 * mon.STORE_ROWS + 1) == 51


CALLS = "job_id long, ts timestamp, call_id long, cost_usd double, budget_usd double"


def test_many_jobs_share_a_key_of_the_state(spark, tmp_path):
    """Alerts of many jobs equal the plain loop, with calls delivered twice, without a job or a budget, and a hot job; state is kept by group."""
    r = random.Random(9)
    calls, n = [], 0
    for job in [None, *range(2**60, 2**60 + 60)]:
        for s in sorted(r.sample(range(80_000), 700 if job == 2**60 else r.randrange(1, 25))):
            n += 1
            calls.append((job, at(s), n, r.randrange(1, 50) / 64, r.choice([2.0, 4.0, 100.0]) if job is None or job % 7 else None))
    calls.sort(key=lambda c: c[1])
    arrived = [c for c in calls for _ in range(2 if c[2] % 5 == 0 else 1)]
    r.shuffle(early := arrived[: len(arrived) // 2])
    far = (-1, at(10_000_000), n + 1, 0.0, 1.0)
    out, late = batches(spark, tmp_path, CALLS, [early, arrived[len(arrived) // 2 :], [far]], lambda df: mon.budget_alerts(df, idle_s=86_400, groups=4))
    want, state = set(), {}
    for job, _, call, cost, budget in calls:
        total, level = state.get(job, (0.0, 0))
        total += cost
        for k, (share, name) in enumerate(((0.8, "budget.warning"), (1.0, "budget.blocked")), start=1):
            if level < k and budget is not None and total >= budget * share:
                level = k
                want.add((job, call, name, total))
        state[job] = total, level
    assert late == 0 and {tuple(x) for x in out.collect()} == want and {x[0] for x in want} > {None, 2**60 + 1}
    # Jobs are held by group; all but the last one, which still waits, are idle by now and let go.
    held = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("operatorId", 0)
    held = held.option("stateVarName", "jobs").load()
    left = [mon.pa.ipc.open_stream(bytes(x["value"]["data"])).read_all().to_pylist() for x in held.select("value").collect()]
    assert [(x["job_id"], x["total"]) for group in left for x in group] == [(-1, 0.0)]


def test_idle_jobs_of_a_group_are_forgotten(spark, tmp_path):
    call = lambda job, n, s, usd: (job, at(s), n, usd, 10.0)
    # The watermark is an hour behind. Job 1 is silent for more than a day while job 2 goes on, then starts from nothing.
    slices = [[call(1, 1, 0, 7.0), call(2, 2, 0, 7.0)], [call(2, 3, 60_000, 0.5)], [call(2, 4, 120_000, 0.25)], [call(2, 5, 130_000, 0.125)]]
    slices += [[call(1, 6, 130_500, 2.0), call(2, 7, 130_500, 0.5)], [call(-1, 9, 10_000_000, 0.0)]]
    out, late = batches(spark, tmp_path, CALLS, slices, lambda df: mon.budget_alerts(df, idle_s=86_400, groups=1))
    assert late == 0 and [tuple(x) for x in out.collect()] == [(2, 7, "budget.warning", 8.375)]


def test_groups_grow_with_the_calls(spark):
    least = mon.job_groups(spark, 10)
    assert least == 4 * mon.store_partitions(spark, 0) and mon.job_groups(spark, 1000 * mon.GROUP_ROWS + 1) == 1001
