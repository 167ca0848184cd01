"""Small hand-written cases with known answers."""

import pytest
from pyspark.sql import functions as F

from cliploom.functions import direction as dr
from cliploom.functions.text import clock, hash_half, js_round, normalized_word
from cliploom.operators import corrections, costs, decisions, enhance, gates, jobs, segments, silence, takes, timeline

WORD = "array<struct<seq:bigint,text:string,start_ms:bigint,end_ms:bigint,confidence:double,speaker:string>>"


def segs(spark, rows):
    """(job, seq, start, end) -> segments without words."""
    df = spark.createDataFrame(rows, "job_id long, seq long, start_ms long, end_ms long")
    return df.select(
        "*", F.format_string("seg_%03d", "seq").alias("segment_id"), F.lit("hi").alias("transcript"), F.lit(0.5).alias("energy"),
        F.lit(False).alias("is_silent"), F.lit(False).alias("is_blurry"), F.lit(None).cast("string").alias("scene_type"),
        F.lit(None).cast("string").alias("camera_motion"), F.array().cast(WORD).alias("words"),
    )


def decs(spark, rows):
    return spark.createDataFrame(rows, "job_id long, seq long, segment_id string, action string, trim_start_ms long, trim_end_ms long")


def media(spark, rows=((1, 30, 1920, 1080),)):
    return spark.createDataFrame(list(rows), "job_id long, fps int, width int, height int")


THREE = [(1, 0, 0, 30_000), (1, 1, 30_000, 60_000), (1, 2, 60_000, 90_000)]


def clip_rows(spark, ds, **kw):
    return [(r.start_from, r.duration_frames, r.segment_id) for r in timeline.build_clips(decs(spark, ds), segs(spark, THREE), media(spark), **kw).orderBy("seq").collect()]


def test_timeline_cases(spark):
    two = [(1, 0, "seg_000", "keep", None, None), (1, 1, "seg_001", "keep", None, None), (1, 2, "seg_002", "remove", None, None)]
    assert sum(r[1] for r in clip_rows(spark, two)) == 1800
    assert clip_rows(spark, [(1, 0, "seg_001", "keep", None, None)]) == [(900, 900, "seg_001")]
    assert clip_rows(spark, [(1, 0, "seg_000", "trim", 5000, 20_000)]) == [(150, 450, "seg_000")]
    assert clip_rows(spark, [(1, 0, "seg_000", "remove", None, None)]) == []
    gone = timeline.build_clips(decs(spark, [(1, 0, "seg_000", "remove", None, None)]), segs(spark, THREE), media(spark))
    assert timeline.timelines(gone, media(spark)).first().duration_frames == 0


def test_understanding_gate_cases(spark):
    doc = spark.createDataFrame([(1, 60_000, 30, 1920, 1080)], "job_id long, duration_ms long, fps int, width int, height int")
    ents = spark.createDataFrame([(1, 1)], "job_id long, n_entities long")
    codes = lambda d, s: sorted(r.code for r in gates.understanding_gate(d, s, ents).collect())
    assert codes(doc, segs(spark, [(1, 0, 0, 30_000), (1, 1, 30_000, 60_000)])) == []
    assert "no_segments" in codes(doc, segs(spark, [(9, 0, 0, 1)]))
    assert "overlapping_segments" in codes(doc, segs(spark, [(1, 0, 0, 40_000), (1, 1, 30_000, 60_000)]))
    flat = doc.withColumn("fps", F.lit(0)).withColumn("width", F.lit(0))
    assert codes(flat, segs(spark, [(1, 0, 0, 30_000), (1, 1, 30_000, 60_000)])) == ["missing_metadata"]


def test_edit_gate_cases(spark):
    caps = spark.createDataFrame([], "job_id long, seq long, start_frame long, end_frame long")
    tgt = spark.createDataFrame([(1, 60.0)], "job_id long, target_s double")
    none = spark.createDataFrame([], "job_id long, target_s double")

    def codes(frames, target):
        clips = spark.createDataFrame([(1, frames)] if frames else [], "job_id long, duration_frames long")
        tl = spark.createDataFrame([(1, 30.0, frames)], "job_id long, fps double, duration_frames long")
        return sorted(r.code for r in gates.edit_gate(tl, clips, caps, target).collect())

    assert codes(900, none) == []
    assert codes(0, none) == ["no_clips", "zero_duration"]
    assert codes(3600, tgt) == ["duration_mismatch"]


def test_document_validator_cases(spark):
    base = dict(job_id="j", version="1.0", language="en", duration_ms=60_000, fps=30, width=1920, height=1080, has_entities=True, has_topics=True, has_energy=True)
    schema = "job_id string, version string, language string, duration_ms long, fps int, width int, height int, has_entities boolean, has_topics boolean, has_energy boolean"

    def codes(rows=((0, 0, 30_000), (1, 30_000, 60_000)), **over):
        doc = {**base, **over}
        d = spark.createDataFrame([tuple(doc.values())], schema)
        s = spark.createDataFrame([(doc["job_id"], *r) for r in rows], "job_id string, seq long, start_ms long, end_ms long").withColumn("segment_id", F.format_string("seg_%03d", "seq"))
        return sorted(r.code for r in gates.validate_documents(d, s).collect())

    assert codes() == []
    assert codes(version="2.0") == ["invalid_version"]
    assert codes(job_id="") == ["missing_job_id"]
    assert codes(duration_ms=-1) == ["invalid_duration"]
    assert "end_not_after_start" in codes(rows=((0, 0, 0), (1, 30_000, 60_000)))
    assert codes(rows=((0, 0, 30_000), (1, 20_000, 60_000))) == ["overlap"]
    assert codes(rows=((0, 0, 30_000), (1, 29_990, 60_000))) == []


def test_cost_cases(spark):
    rows = [
        (1, "anthropic", "sonnet", "understand", 1000, 500, 0.05), (1, "anthropic", "haiku", "understand", 500, 200, 0.01),
        (1, "anthropic", "sonnet", "edit", 2000, 1000, 0.10), (2, "openai", "gpt-4o", "edit", 2000, 1000, 0.85), (3, "openai", "gpt-4o", "edit", 1, 1, 1.05),
    ]
    calls = spark.createDataFrame(rows, "job_id long, provider string, model string, stage string, input_tokens long, output_tokens long, cost_usd double")
    budgets = spark.createDataFrame([(2, 1.0), (3, 1.0)], "job_id long, budget_usd double")
    got = {r.job_id: r for r in costs.cost_rollup(calls, budgets).collect()}
    assert got[1].by_stage == {"understand": pytest.approx(0.06), "edit": pytest.approx(0.10)}
    assert got[1].input_tokens == 3500 and got[1].remaining_usd is None and not got[1].near_budget
    assert (got[2].near_budget, got[2].over_budget) == (True, False)
    assert (got[3].near_budget, got[3].over_budget) == (True, True) and got[3].remaining_usd < 0


def test_routing_cases(spark):
    rows = [
        (1, "frame_labeling", "anthropic", False, None, None), (2, "frame_labeling", "anthropic", True, None, None),
        (3, "vud_fusion", "openai", False, None, None), (4, "vud_fusion", "anthropic", False, "gemini", "fast"), (5, "review", "local", False, None, None),
    ]
    df = spark.createDataFrame(rows, "request_id long, task string, provider string, enriched boolean, override_provider string, override_tier string")
    got = {r.request_id: (r.tier, r.model, r.estimated_usd) for r in costs.route_models(df.withColumns({"input_tokens": F.lit(1000), "output_tokens": F.lit(1000)})).collect()}
    assert got[1][:2] == ("fast", "claude-haiku-4-5-20251001") and got[2][0] == "standard" and got[3][0] == "premium"
    assert got[4][:2] == ("fast", "gemini-1.5-flash") and got[5][2] == 0


def test_direction_cases(spark):
    rows = [("שלום עולם", "he", "rtl"), ("שלום עולם hi", "iw", "rtl"), ("hello wide world של", "he-IL", "ltr"), ("مرحبا", "ar-SA", "rtl"), ("", "en", "ltr"), ("  ", "fr", "ltr")]
    got = dr.direction_profile(spark.createDataFrame(rows, "t string, l string, want string"), "t", "l").collect()
    assert all(r.direction == r.want for r in got)
    assert [r.rtl_language for r in got] == [True, True, True, True, False, False]
    assert [r.is_mixed for r in got] == [False, True, True, False, False, False]
    assert got[0].wrapped == "‫שלום עולם‬" and got[4].wrapped == "‪‬"
    strict = spark.createDataFrame([("",)], "t string").select(dr.direction_or(F.col("t"), "rtl")).first()[0]
    assert strict == "rtl"


def test_state_machine_cases(spark):
    happy = ["created", "ingesting", "ingest_done", "understanding", "understand_done", "editing", "edit_done", "rendering", "render_done"]
    rows = [(1, i, s) for i, s in enumerate(happy)] + [(2, 0, "created"), (2, 1, "editing"), (3, 0, "render_done"), (3, 1, "rendering")]
    got = jobs.audit_transitions(spark.createDataFrame(rows, "job_id long, seq long, state string")).filter("NOT legal")
    assert sorted((r.job_id, r.prev_state, r.state) for r in got.collect()) == [(2, "created", "editing"), (3, "render_done", "rendering")]
    table = {r.state: r for r in jobs.state_table(spark).collect()}
    assert len(table) == 14 and not table["render_done"].is_terminal and table["render_done"].listed_terminal
    j = spark.createDataFrame([(1, "editing", "a.mp4", None, None), (2, "created", "b.mp4", "old", None)], "job_id long, state string, source_file string, error string, updated_at string")
    t = spark.createDataFrame([(1, "edit_failed", "boom", "t1"), (2, "rendering", None, "t1")], "job_id long, target_state string, detail string, at string")
    moved, rejected = jobs.apply_transitions(j, t)
    assert [(r.job_id, r.state, r.error) for r in moved.collect()] == [(1, "edit_failed", "boom")]
    assert [r.job_id for r in rejected.collect()] == [2]


def words_df(spark, rows):
    return spark.createDataFrame(rows, "job_id long, seq long, text string, speaker string, start_ms long, end_ms long, confidence double")


def test_segment_borders(spark):
    """Words on the border belong inside; a zero-length word on a grid line belongs to both pieces."""
    ws = [(1, 0, "a", "x", 0, 400, 0.9), (1, 1, "cut", "x", 29_900, 30_100, 0.9), (1, 2, "edge", "y", 30_000, 30_000, 0.9), (1, 3, "end", None, 64_500, 65_000, 0.9)]
    sc = spark.createDataFrame([(1, 0, "scene_001", 0, 65_000), (1, 1, "scene_002", 65_000, 200_000)], "job_id long, seq long, scene_id string, start_ms long, end_ms long")
    got = segments.build_segments(words_df(spark, ws), sc).orderBy("seq").collect()
    assert [(r.start_ms, r.end_ms, r.transcript) for r in got] == [(0, 30_000, "a edge"), (30_000, 60_000, "edge"), (60_000, 65_000, "end"), (65_000, 200_000, "")]
    assert [r.speaker for r in got] == ["x", "y", None, None] and got[3].is_silent
    flat = segments.build_segments(words_df(spark, [(7, *w[1:]) for w in ws]), sc).filter("job_id = 7").orderBy("seq").collect()
    assert [(r.scene_id, r.start_ms, r.end_ms, r.transcript) for r in flat][:3] == [("auto_1", 0, 15_000, "a"), ("auto_2", 15_000, 30_000, "edge"), ("auto_3", 30_000, 45_000, "edge")]


def spoken(spark, texts, step=400, start=0, conf=None):
    ws = [(i, t, start + i * step, start + i * step + 300, (conf or {}).get(i, 0.9), None) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(1, 0, "seg_000", start, start + max(len(texts) * step, ws[-1][3] - start), ws)], f"job_id long, seq long, segment_id string, start_ms long, end_ms long, words {WORD}")
    return df.withColumns({"transcript": F.lit(" ".join(texts)), "energy": F.lit(0.5), "is_silent": F.lit(False), "is_blurry": F.lit(False), "camera_motion": F.lit(None).cast("string"), "scene_type": F.lit(None).cast("string")})


LINE = "we went up the long hill then we saw snow okay so".split()


def test_takes_tie_keeps_the_earlier(spark):
    text = LINE + "and now again".split() + LINE
    s = spoken(spark, text)
    d = decs(spark, [(1, 0, "seg_000", "keep", None, None)])
    cut, log = takes.pick_takes(d, s)
    assert all(r.kept == (r["take"] == 0) for r in log.collect())
    # Five shared words are enough, so a match starts one word before the repeated line.
    assert sorted(r.start_ms for r in log.filter("NOT kept").collect()) == [14 * 400, 20 * 400]
    pieces = cut.orderBy("trim_start_ms").select("trim_start_ms", "trim_end_ms").collect()
    assert [tuple(r) for r in pieces] == [(0, 5600), (19 * 400 + 300, 8000), (25 * 400 + 300, 27 * 400)]


def test_takes_better_confidence_wins(spark):
    text = LINE[:6] + list("abcdefgh") + LINE[:6]
    s = spoken(spark, text, conf={i: 0.2 for i in range(6)})
    _, log = takes.pick_takes(decs(spark, [(1, 0, "seg_000", "keep", None, None)]), s)
    assert [r["take"] for r in log.filter("kept").collect()] == [1]
    assert log.first().phrase == "h we went up the"


def brute_pairs(tokens):
    out, used = [], set()
    for i in range(len(tokens) - 5):
        if i in used:
            continue
        for j in range(i + 6, len(tokens) - 5):
            if j not in used and sum(1 for t in tokens[i : i + 6] if t and t in tokens[j : j + 6]) >= 4.5:
                used |= set(range(i, i + 6)) | set(range(j, j + 6))
                out.append({"a": i, "b": j})
                break
    return out


def test_greedy_pairs_equal_nested_loops():
    import random

    rng = random.Random(3)
    for _ in range(150):
        tokens = [rng.choice(["", "no", "yes", "a", "b", "c", "d", "e", "f", "g", "h"]) for _ in range(rng.randint(0, 60))]
        assert takes._greedy_pairs(tokens) == brute_pairs(tokens)


def test_islands_and_silence_cuts(spark):
    s = spoken(spark, ["one.", "two", "three"], step=1000)
    d = decs(spark, [(1, 0, "seg_000", "keep", None, None), (1, 1, "seg_nope", "keep", 1, 2), (1, 2, "seg_000", "remove", None, None)])
    got = silence.islands_in_windows(d, s, 300).select("start_ms", "end_ms", "offset_ms").orderBy("start_ms")
    # 700 ms pauses: enough after a sentence (300), too short inside one (1200).
    assert [tuple(r) for r in got.collect()] == [(0, 400, 0), (1000, 2400, 400)]
    cuts = silence.silence_cuts(d, s, 700).orderBy("seq", "part").select("seq", "action", "trim_start_ms", "trim_end_ms")
    assert [tuple(r) for r in cuts.collect()] == [(0, "keep", 0, 350), (0, "keep", 950, 1350), (0, "keep", 1950, 3000), (1, "keep", 1, 2), (2, "remove", None, None)]


def test_captions_never_overlap(spark):
    s = spoken(spark, ["a", " ", "b", "c", "d", "e", "f"], step=10)
    cap = timeline.plan_captions(decs(spark, [(1, 0, "seg_000", "keep", None, None)]), s, media(spark), "jumbo").orderBy("seq").collect()
    assert [c.text for c in cap] == ["a", "b", "c", "d", "e", "f"]
    assert all(c.end_frame >= c.start_frame + 1 for c in cap)
    std = timeline.plan_captions(decs(spark, [(1, 0, "seg_000", "keep", None, None)]), s, media(spark), "jumbo-then-standard").orderBy("seq").collect()
    assert [c.text for c in std] == ["a   b c d", "e f"] and std[0].style == "standard"


def test_fixes_apply_in_order_and_all_or_nothing(spark):
    s = spoken(spark, [" Looks", "good", "Looks ", "fine"])
    fix = lambda rows: spark.createDataFrame(rows, "job_id long, ord long, spec string")
    ok, bad = corrections.correct_transcripts(s, fix([(1, 0, "Looks@0.1=Loops"), (1, 1, "Looks@0.6=x=Lops"), (1, 2, "Looks@0.6=Lops"), (1, 3, "Loops@0.0=Hoops")]))
    assert [r.problem for r in bad.collect()] == ["not_found"] and ok.first().transcript.startswith(" ".join([" Looks", "good"]))
    ok, bad = corrections.correct_transcripts(s, fix([(1, 0, "Looks@0.1=Loops"), (1, 2, "Looks@0.6=Lops"), (1, 3, "Loops@0.0=Hoops")]))
    assert bad.count() == 0 and ok.first().transcript == "Hoops good Lops fine"
    assert ok.first().words[0].text == " Hoops" and ok.first().words[2].text == "Lops "
    _, bad = corrections.correct_transcripts(s, fix([(1, 0, "no separators"), (1, 1, "a=b"), (1, 2, "a@x=b")]))
    assert sorted(r.problem for r in bad.collect()) == ["invalid"] * 3


def test_enhancement_rules_and_cap(spark):
    s = segs(spark, [(1, i, i * 1000, i * 1000 + 900) for i in range(5)]).withColumns({
        "text_on_screen": F.when(F.col("seq") == 0, "Menu"), "scene_type": F.when(F.col("seq") == 0, "screenrec").when(F.col("seq") == 2, "action"),
        "visual_description": F.when(F.col("seq") == 1, "A Chart, big"), "visual_interest": F.lit(4).cast("long"),
        "transcript": F.when(F.col("seq") == 3, "Notice that it moves").otherwise("hi"),
    })
    d = decs(spark, [(1, i, f"seg_{i:03d}", "keep", None, None) for i in range(5)])
    got = enhance.classify_enhancements(d, s, forced=["seg_004"]).orderBy("seq")
    assert [r.reason for r in got.collect()] == ["precision_zoom", "chart_animation", "premium_treatment", "educational_emphasis", "user_requested"]
    capped = enhance.cap_enhancements(got, 2).filter("level <> 'standard'")
    assert sorted(r.seq for r in capped.collect()) == [0, 4]
    assert {r.level for r in enhance.classify_enhancements(d, s, force_standard=True).collect()} == {"standard"}


def test_pacing_empty_job(spark):
    got = decisions.pacing_warnings(decs(spark, [(1, 0, "seg_000", "remove", None, None)]), segs(spark, THREE))
    assert [r.code for r in got.collect()] == ["nothing_kept"]


def test_scalar_helpers(spark):
    r = spark.range(1).select(
        js_round(F.lit(-2.5)).alias("a"), js_round(F.lit(2.5)).alias("b"), clock(F.lit(61_999)).alias("c"),
        hash_half(F.lit("ffffffff00000001"), 0).alias("h"), hash_half(F.lit("ffffffff00000001"), 1).alias("l"), normalized_word(F.lit("Don't-É!")).alias("n"),
    ).first()
    assert (r.a, r.b, r.c, r.h, r.l, r.n) == (-2, 3, "01:01.100", 4294967295, 1, "donté")
