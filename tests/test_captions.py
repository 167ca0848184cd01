"""Captions that stay on their decision's row, and the flow that plans them once."""

from pyspark.sql import functions as F

from cliploom.catalog import edit as ed
from cliploom.operators import timeline
from cliploom.plans import flows

WORD = "array<struct<seq:bigint,text:string,start_ms:bigint,end_ms:bigint,confidence:double,speaker:string>>"
# Two jobs of three segments: silent ones, blank and missing texts, words that reach over the next start.
SPOKEN = [
    (1, 0, 0, 3000, [("a.", 0, 30), ("b", 20, 900), (" ", 1000, 1100), ("c", 1700, 1800)]),
    (1, 1, 3000, 4000, []),
    (1, 2, 4000, 9000, [(None, 4000, 4100), ("d", 4200, 9000), ("e", 4210, 4220)]),
    (2, 0, 0, 2000, [("x", 0, 100), ("אב", 100, 200)]),
    (2, 1, 2000, 3000, [(" ", 2000, 2500)]),
    (2, 2, 3000, 5000, [("א yz", 3000, 3300)]),
]


def _segments(spark):
    rows = [(j, s, f"seg_{s:03d}", a, b, [(k, t, x, y, 0.5, "p") for k, (t, x, y) in enumerate(ws)]) for j, s, a, b, ws in SPOKEN]
    return spark.createDataFrame(rows, f"job_id long, seq long, segment_id string, start_ms long, end_ms long, words {WORD}").withColumns(
        {"transcript": F.lit("t"), "energy": F.lit(0.5), "scene_type": F.lit(None).cast("string"), "is_silent": F.lit(False), "is_blurry": F.lit(False), "camera_motion": F.lit("pan")}
    )


def _decisions(segments):
    return segments.select("job_id", "seq", "segment_id", F.lit("keep").alias("action"), F.lit(None).cast("long").alias("trim_start_ms"), F.lit(None).cast("long").alias("trim_end_ms"))


def _media(spark):
    return spark.createDataFrame([(1, 25, 10, 10), (2, 30, 10, 10)], "job_id long, fps int, width int, height int")


def _frames(ms, fps):
    return int(ms * fps / 1000.0 + 0.5)


def _by_loop(job, fps):
    """One word per caption, whole windows (no threshold)."""
    rows, off = [], 0
    for _, seq, a, b, ws in (r for r in SPOKEN if r[0] == job):
        for t, x, y in ws:
            if (t or "").strip():
                s = off + _frames(x - a, fps)
                rows.append([seq, t, s, max(off + _frames(y - a, fps), s + 1)])
        off += _frames(b - a, fps)
    for r, after in zip(rows, rows[1:]):
        if r[3] > after[2]:
            r[3] = max(r[2] + 1, after[2])
    return [(job, n, *r) for n, r in enumerate(rows)]


def test_captions_equal_a_loop_and_are_not_sorted_word_by_word(spark):
    g = _segments(spark)
    got = timeline.plan_captions(_decisions(g), g, _media(spark), "jumbo")
    rows = got.orderBy("job_id", "seq").select("job_id", "seq", "decision_seq", "text", "start_frame", "end_frame").collect()
    assert [tuple(r) for r in rows] == _by_loop(1, 25) + _by_loop(2, 30)
    assert [r["direction"] for r in got.filter("job_id = 2").orderBy("seq").collect()] == ["ltr", "rtl", "ltr"]
    # Rows of single captions go through no window: numbers and following starts come from the decisions' rows.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "Window" not in plan[: plan.index("Generate")]
    # The words are read without what no caption needs.
    assert timeline.timed_words(g).schema["words"].dataType.elementType.names == ["text", "start_ms", "end_ms"]


def test_one_plan_serves_jobs_of_both_styles(spark):
    g = _segments(spark)
    d = _decisions(g).withColumn("mode", F.when(F.col("job_id") == 1, "jumbo").otherwise("standard"))
    got = {tuple(r) for r in timeline.plan_captions(d, g, _media(spark), F.col("mode"), 500).collect()}
    alone = [timeline.plan_captions(d.filter(F.col("mode") == m), g, _media(spark), m, 500).collect() for m in ("jumbo", "standard")]
    assert all(alone) and got == {tuple(r) for rows in alone for r in rows}


def test_the_flow_plans_captions_once_and_reads_plans_once(spark, monkeypatch):
    asked, written = [], []
    plan, keep = timeline.plan_captions, flows.materialize
    monkeypatch.setattr(timeline, "plan_captions", lambda *a, **k: asked.append(1) or plan(*a, **k))
    monkeypatch.setattr(flows, "materialize", lambda df, label: written.append(label) or keep(df, label))
    text = '{"decisions":[{"segmentId":"seg_000","action":"keep"},{"segmentId":"seg_002","action":"keep"}],"captionMode":"%s"}'
    plans = spark.createDataFrame([(1, 0, text % "jumbo"), (2, 0, text % "standard")], "job_id long, part long, content string")
    got = flows.edit(_segments(spark), _media(spark), plans, threshold_ms=500, pick_takes=False)
    assert {(r["job_id"], r["style"], r["font_size"]) for r in got.captions.collect()} == {(1, "jumbo", 96), (2, "standard", 36)}
    assert len(asked) == 1 and "plan-rows" in written


def test_spoken_segments_are_written_once(spark, tmp_path):
    turns = [(1, 0, "user", "One two. Three"), (1, 1, "bot", "Four")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = ed.spoken(spark, str(tmp_path))
    assert got.count() == 2 and all("/spoken_segments-" in f for f in got.inputFiles())
