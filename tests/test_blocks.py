"""Block-wise primitives against plain loops, with blocks small enough that every job spans many."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.operators import blocks, intervals, sampling


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("width", [1, 4, 1000])
def test_running_equals_loop(spark, width):
    rng = random.Random(width)
    data = [(j, s, rng.randint(-5, 5)) for j in (1, 2, 3) for s in sorted(rng.sample(range(60), 30 * (j < 3) + 1))]
    df = spark.createDataFrame(data, "job_id long, seq long, v long")
    got = blocks.running(
        df, ["job_id"], ["seq"], blocks.seq_block("seq", width),
        sums={"s": F.col("v")}, maxes={"m": F.col("v")}, prev={"p": F.col("v")}, following={"n": F.col("v")},
    )
    want = []
    for j in (1, 2, 3):
        part = [d for d in data if d[0] == j]
        for i, d in enumerate(part):
            before = [x[2] for x in part[:i]]
            want.append((*d, sum(before), max(before) if before else None, before[-1] if before else None, part[i + 1][2] if i + 1 < len(part) else None))
    key = lambda t: (t[0], t[1])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


def test_prev_keeps_null_values_apart_from_missing_rows(spark):
    df = spark.createDataFrame([(1, 0, 7), (1, 1, None), (1, 2, 9)], "job_id long, seq long, v long")
    got = blocks.running(df, ["job_id"], ["seq"], blocks.seq_block("seq", 1), prev={"p": F.col("v")})
    assert rows_of(got.select("seq", F.coalesce("p", F.lit(-1)))) == [(0, -1), (1, 7), (2, -1)]


def test_explode_range_is_complete(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 25)], "k long, n long")
    got = blocks.explode_range(df, F.col("n"), "i", chunk=10).groupBy("k").agg(F.count("*").alias("c"), F.max("i").alias("m"))
    assert rows_of(got) == [(2, 1, 0), (3, 25, 24)]


def union(spans, gap):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("gap", [0, 7])
def test_merge_intervals_equals_loop(spark, gap):
    rng = random.Random(gap)
    data = [(j, a, a + rng.choice([0, 1, 3, 40, 200])) for j in (1, 2) for a in rng.sample(range(3000), 120)]
    df = spark.createDataFrame(data, "job_id long, start_ms long, end_ms long")
    got = intervals.merge_intervals(df, gap_ms=gap, block_ms=50)
    want = [(j, a, b) for j in (1, 2) for a, b in union([d[1:] for d in data if d[0] == j], gap)]
    assert rows_of(got) == sorted(want)


def test_speech_islands_include_the_exact_gap(spark):
    df = spark.createDataFrame([(1, 0, 100), (1, 1600, 1700), (1, 3201, 3300)], "job_id long, start_ms long, end_ms long")
    assert rows_of(intervals.speech_islands(df)) == [(1, 0, 1700), (1, 3201, 3300)]


def test_overlaps_equal_nested_loop(spark):
    rng = random.Random(5)
    make = lambda n: [(rng.randint(1, 2), i, s := rng.randint(0, 200_000), s + rng.choice([0, 500, 70_000])) for i in range(n)]
    a, b = make(60), make(60)
    left = spark.createDataFrame(a, "job_id long, i long, s long, e long")
    right = spark.createDataFrame(b, "job_id long, k long, t long, f long")
    got = intervals.overlaps(left, "s", "e", right, "t", "f").select("i", "k")
    want = [(x[1], y[1]) for x in a for y in b if x[0] == y[0] and y[3] > x[2] and y[2] < x[3]]
    assert rows_of(got) == sorted(want)
    pts = intervals.points_in_intervals(left, "s", "e", right, "t", "f").select("i", "k")
    want = [(x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] >= y[2] and x[3] <= y[3]]
    assert rows_of(pts) == sorted(want)


def frames(rng, jobs=3, n=400):
    out = []
    for j in range(jobs):
        h = (0, 0)
        t = 0
        for f in range(1, n + 1):
            t += rng.choice([1000] * 12 + [45_000])
            if rng.random() < 0.15:
                h = (rng.getrandbits(32), rng.getrandbits(32))
            known = rng.random() > 0.04
            out.append((j, f, t, h[0] ^ (1 << rng.randrange(8)) if known else None, h[1] if known else None))
    return out


def dedup_loop(rows, threshold=10, wait=30_000):
    flags, prev, at = {}, None, None
    for j, f, t, a, b in rows:
        if f == 1:
            prev, at = None, None
        near = prev is not None and a is not None and (a ^ prev[0]).bit_count() + (b ^ prev[1]).bit_count() <= threshold
        dup = near and t - at < wait
        if not dup:
            prev, at = (None if a is None else (a, b)), t
        flags[(j, f)] = dup
    return flags


@pytest.mark.parametrize("width,fan", [(30_000, 3), (60_000, 1024), (3_600_000, 1024)])
def test_greedy_selection_across_blocks(spark, monkeypatch, width, fan):
    monkeypatch.setattr(blocks, "FAN", fan)
    rng = random.Random(width)
    data = frames(rng)
    df = spark.createDataFrame(data, "job_id long, frame_number long, ts_ms long, phash_hi long, phash_lo long")
    select = blocks.greedy_select
    monkeypatch.setattr(sampling, "greedy_select", lambda *a, **k: select(*a, **{**k, "width": width}))
    got = {(r.job_id, r.frame_number): r.is_duplicate for r in sampling.dedup_frames(df).collect()}
    assert got == dedup_loop(data)
    assert len(got) == len(data)


def test_static_picture_keeps_one_frame_every_thirty_seconds(spark, monkeypatch):
    """Equal frames never bring two starting points together, so the chained state matters everywhere."""
    monkeypatch.setattr(blocks, "FAN", 2)
    select = blocks.greedy_select
    monkeypatch.setattr(sampling, "greedy_select", lambda *a, **k: select(*a, **{**k, "width": 37_000}))
    data = [(1, i + 1, i * 1000 + 500, 5, 5) for i in range(500)]
    df = spark.createDataFrame(data, "job_id long, frame_number long, ts_ms long, phash_hi long, phash_lo long")
    kept = [r.frame_number for r in sampling.dedup_frames(df).filter("NOT is_duplicate").orderBy("frame_number").collect()]
    assert kept == list(range(1, 501, 30))


def test_density_and_refinement_equal_loops(spark):
    rng = random.Random(11)
    data = frames(rng, jobs=2, n=300)
    dups = dedup_loop(data)
    rows = [(*r, dups[(r[0], r[1])]) for r in data]
    df = spark.createDataFrame(rows, "job_id long, frame_number long, ts_ms long, phash_hi long, phash_lo long, is_duplicate boolean")
    words = [(j, s, s + 300) for j in (0, 1) for s in range(0, 900_000, 1200) if (s // 50_000) % 2 == 0]
    wdf = spark.createDataFrame(words, "job_id long, start_ms long, end_ms long")
    got = {(r.job_id, r.frame_number): r.is_duplicate for r in sampling.adaptive_sampling(df, wdf).collect()}
    want = {}
    for j in (0, 1):
        spans = union([w[1:] for w in words if w[0] == j], 1500)
        part = [list(r) for r in rows if r[0] == j]
        last = {True: -999_000, False: -999_000}
        for r in part:
            talk = any(a <= r[2] <= b for a, b in spans)
            if not r[5] or r[2] - last[talk] >= (5000 if talk else 15_000):
                r[5], last[talk] = False, r[2]
        kept = [i for i, r in enumerate(part) if not r[5]]
        for a, b in zip(kept, kept[1:], strict=False):
            ha, hb = part[a][3:5], part[b][3:5]
            if ha[0] is None or hb[0] is None:
                continue
            dist = (ha[0] ^ hb[0]).bit_count() + (ha[1] ^ hb[1]).bit_count()
            mid = [i for i in range(a + 1, b) if part[i][3] is not None]
            if dist <= 10 or not mid:
                continue
            n = 1 if dist <= 25 else min(3, len(mid))
            picks = [len(mid) // 2] if n == 1 else [int(np.floor(p * (len(mid) - 1) / (n - 1) + 0.5)) for p in range(n)]
            for p in picks:
                part[mid[p]][5] = False
        want.update({(r[0], r[1]): r[5] for r in part})
    assert got == want


@pytest.mark.parametrize("broadcast", ["-1", "10MB"])
def test_blocks_stay_whole_under_adaptive_execution(spark, monkeypatch, broadcast):
    """One job with nearly all rows, and settings under which every partition counts as skewed."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": broadcast,
        "spark.sql.adaptive.autoBroadcastJoinThreshold": broadcast,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1B",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        select = blocks.greedy_select
        monkeypatch.setattr(sampling, "greedy_select", lambda *a, **k: select(*a, **{**k, "width": 600_000}))
        rng = random.Random(8)
        data = [r for r in frames(rng, jobs=2, n=3000) if r[0] == 0 or r[1] <= 20]
        df = spark.createDataFrame(data, "job_id long, frame_number long, ts_ms long, phash_hi long, phash_lo long").repartition(8)
        got = {(r.job_id, r.frame_number): r.is_duplicate for r in sampling.dedup_frames(df).collect()}
        assert got == dedup_loop(data)
        seqs = [(r[0], r[1], r[2] % 7) for r in data]
        run = blocks.running(
            spark.createDataFrame(seqs, "job_id long, seq long, v long").repartition(8), ["job_id"], ["seq"], blocks.seq_block("seq", 50), sums={"s": F.col("v")}
        )
        total, want = {}, []
        for j, s, v in seqs:
            want.append((j, s, v, total.get(j, 0)))
            total[j] = total.get(j, 0) + v
        assert rows_of(run) == sorted(want)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_rows_meet_their_job_row_also_in_a_hot_job(spark):
    from pyspark.sql import functions as F

    from cliploom.operators.blocks import with_job_row

    rows = spark.range(5000).select(F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(7).alias("job_id"), F.col("id").alias("seq"))
    per_job = spark.createDataFrame([(7, "hot"), (50, "cold")], "job_id long, x string")
    got = {(r["job_id"], r["seq"], r["x"]) for r in with_job_row(rows, per_job, F.col("seq")).collect()}
    want = {(r["job_id"], r["seq"], {7: "hot", 50: "cold"}.get(r["job_id"])) for r in rows.collect()}
    assert got == want
    assert with_job_row(rows, per_job, F.col("seq"), "inner").count() == sum(x is not None for _, _, x in want)


def test_only_hot_jobs_are_dealt_out_by_their_size(spark):
    from pyspark.sql import functions as F

    from cliploom.operators.blocks import with_job_row

    rows = spark.range(4000).select(F.when(F.col("id") % 20 == 0, F.col("id")).otherwise(7).alias("job_id"), F.col("id").alias("seq"))
    per_job = rows.select("job_id").distinct().withColumn("x", F.col("job_id") * 2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in (8, 200):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            got = with_job_row(rows, per_job, F.col("seq"), part_rows=50).withColumn("_p", F.spark_partition_id())
            hot = got.filter("job_id = 7").groupBy("_p").count().collect()
            assert got.filter("x = 2 * job_id").count() == 4000
            # 3800 rows in 76 parts of about 50.
            assert len(hot) >= min(partitions, 76) * 0.7 and max(r["count"] for r in hot) < 3800 * 3 / min(partitions, 24)
            assert with_job_row(rows, per_job, F.col("seq")).filter("job_id = 7").select(F.spark_partition_id()).distinct().count() == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_segments_energy_and_clips_with_one_hot_job(spark):
    """One job holds nearly all words: results equal those of the job alone."""
    from pyspark.sql import functions as F

    from cliploom.operators import segments as seg

    word = lambda job, n: spark.range(n).select(
        F.lit(job).cast("long").alias("job_id"), F.col("id").alias("seq"), F.lit("w.").alias("text"), F.lit("a").alias("speaker"),
        (F.col("id") * 400).alias("start_ms"), (F.col("id") * 400 + 250).alias("end_ms"), F.lit(0.5).alias("confidence"),
    )
    hot, cold = word(1, 20_000), word(2, 50)
    media = spark.createDataFrame([(1, 25, 10, 10, -20.0), (2, 30, 10, 10, None)], "job_id long, fps int, width int, height int, input_i double")
    both = seg.energy_curve(seg.segments_from_words(hot.unionByName(cold)), media)
    alone = seg.energy_curve(seg.segments_from_words(hot), media).unionByName(seg.energy_curve(seg.segments_from_words(cold), media))
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, alone.collect()))
