"""End-to-end flows on the supplied tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from cliploom import fixtures as fx
from cliploom.catalog import edit as ed
from cliploom.catalog import understand as un
from cliploom.operators import decisions as dec
from cliploom.plans import flows


def answers(s, d, decided=ed.decided):
    """Plan answers in parts of up to 200 decisions, written from the decisions, with trims in seconds, transitions of their
    own and settings per job; every tenth job answers in prose."""
    w = decided(s, d)
    seconds = lambda c: F.coalesce(F.format_string("%.3f", F.col(c) / 1000.0), F.lit("null"))
    trims = F.when(F.col("action") == "trim", F.concat(F.lit(',"trimStart":'), seconds("trim_start_ms"), F.lit(',"trimEnd":'), seconds("trim_end_ms"))).otherwise("")
    own = F.when(F.col("seq") % 7 == 3, ',"transitionBefore":"fade"').otherwise("")
    item = F.concat(F.lit('{"segmentId":"'), "segment_id", F.lit('","action":"'), "action", F.lit('"'), trims, own, F.lit("}"))
    g = w.groupBy("job_id", F.floor(F.col("seq") / 200).alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", item.alias("t")))), lambda x: x["t"]).alias("ts"))
    j = F.col("job_id")
    default = F.when(j % 3 == 0, ',"transitionDefault":"mixed"').otherwise("")
    captions = F.when(j % 4 == 0, ',"captionMode":"standard"').when(j % 4 == 1, ',"captionMode":"jumbo"').when(j % 4 == 2, ',"captionMode":"none"').otherwise("")
    body = F.concat(F.lit('{"decisions":['), F.array_join("ts", ","), F.lit("]"), default, captions, F.lit("}"))
    return g.select("job_id", "part", F.when(j % 10 == 9, "no plan").otherwise(body).alias("content"))


def edited(s, d, **more):
    segments = ed.spoken(s, d).withColumn("scene_type", F.lit(None).cast("string"))
    return flows.edit(segments, fx.media(s, d), answers(s, d), threshold_ms=500, pick_takes=False, **more)


def targets(s, d):
    """Target lengths: one to four tenths of a job's segments; every eleventh job has none."""
    j = F.col("job_id")
    whole = ed.spoken(s, d).groupBy("job_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    return whole.select("job_id", F.when(j % 11 != 10, F.floor(F.col("ms") * (j % 4 + 1) / 10)).cast("long").alias("target_ms"))


def edited_to_length(s, d):
    """The edit flow with target lengths and a tighter second plan: two thirds of the decisions become removals, save in every
    fourth job."""
    stays = (F.col("seq") % 3 == 0) | (F.col("job_id") % 4 == 3)
    tighter = ed.decided(s, d).withColumn("action", F.when(stays, F.col("action")).otherwise("remove"))
    return edited(s, d, targets=targets(s, d), second_plans=dec.sanitize_decisions(tighter, ed.spoken(s, d)))


def edited_takes(s, d):
    """The edit flow with takes, on segments whose speakers start again."""
    said = F.array_join(F.transform("words", lambda w: w["text"]), " ")
    segments = ed.repeated(s, d).withColumns({"scene_type": F.lit(None).cast("string"), "transcript": said})
    return flows.edit(segments, fx.media(s, d), answers(s, d, ed.keep_all), threshold_ms=500)


def understood(s, d):
    return flows.understand(fx.words(s, d), fx.scenes(s, d), fx.frames(s, d), fx.media(s, d))


def _asked(segments):
    """Answers per 200 segments: an entity that every third segment mentions, a topic of every second one, updates of every fourth."""
    g = segments.groupBy("job_id", F.floor(F.col("seq") / 200).cast("long").alias("part")).agg(F.array_sort(F.collect_list(F.struct("seq", "segment_id"))).alias("x"))
    some = lambda n, k=0: F.filter("x", lambda r: r["seq"] % n == k)
    p = F.col("part").cast("string")
    entity = F.struct(F.array(F.struct(F.concat(F.lit("e"), p).alias("id"), F.lit("N").alias("name"), F.transform(some(3), lambda r: r["seq"]).alias("mentions"))).alias("entities"))
    topic = F.struct(F.array(F.struct(F.concat(F.lit("t"), p).alias("id"), F.lit("L").alias("label"), F.transform(some(2), lambda r: r["segment_id"]).alias("segments"))).alias("topics"))
    update = F.struct(F.transform(some(4, 1), lambda r: F.struct(r["segment_id"].alias("id"), F.lit("T").alias("textOnScreen"))).alias("segmentUpdates"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.to_json(v).alias("content")) for k, v in (("entities", entity), ("topics", topic), ("segment_updates", update))])
    return g.select("job_id", "part", F.explode(kinds).alias("a")).select("job_id", "part", "a.kind", "a.content")


_flow1: dict = {}


def understood_with_answers(s, d):
    """The understanding flow with answers, run once per application and data folder."""
    key = (s.sparkContext.applicationId, d)
    if key not in _flow1:
        _flow1[key] = flows.understand(fx.words(s, d), fx.scenes(s, d), fx.frames(s, d), fx.media(s, d), answer=_asked)
    return _flow1[key]


def understood_partly(s, d):
    """The same where some jobs get no answer about entities or topics."""
    j = F.col("job_id")
    lost = ((F.col("kind") == "entities") & (j % 5 == 2)) | ((F.col("kind") == "topics") & (j % 7 == 3))
    return flows.understand(fx.words(s, d), fx.scenes(s, d), fx.frames(s, d), fx.media(s, d), answer=lambda g: _asked(g).filter(~lost))


def enhanced(s, d):
    segments = ed.spoken(s, d).withColumns(
        {"scene_type": F.when(F.col("seq") % 3 == 0, "screenrec"), "text_on_screen": F.when(F.col("seq") % 6 == 0, "Menu"),
         "visual_description": F.lit(None).cast("string"), "visual_interest": F.lit(3).cast("long")}
    )

    def render(specs):
        n = F.col("spec_no")
        return specs.select(
            "job_id", n.alias("ord"), "scene_id", (n % 4 != 1).alias("success"), F.concat(F.lit("/out/"), "scene_id").alias("output_path"),
            ((n + 1) * 0.5).alias("output_s"), (n * 100).alias("render_ms"), (n % 4 == 1).alias("fallback"),
        )

    clips = ed.clips(s, d).withColumn("src", F.lit("source.mp4"))
    return flows.enhance_clips(clips, segments, render, limit=5)


# Transition of a decision: its own, or its plan's; plans that cannot be read have neither.
_KIND = "CASE WHEN {d}.job_id % 10 = 9 THEN 'cut' WHEN {d}.{seq} % 7 = 3 THEN 'fade' WHEN {d}.job_id % 3 = 0 THEN 'mixed' ELSE 'cut' END"
fx.CTES["flow_dec"] = (("spoken_decisions", "spoken_seg"), """
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY seq) - 1 AS seq, seq AS plan_seq, segment_id, action, trim_start_ms, trim_end_ms
FROM spoken_decisions WHERE job_id % 10 <> 9
UNION ALL SELECT job_id, seq, seq, segment_id, 'keep', NULL, NULL FROM spoken_seg WHERE job_id % 10 = 9""")
fx.CTES["flow_win"] = (("flow_dec", "spoken_seg"), """
WITH c AS (SELECT d.job_id, d.seq, d.segment_id, s.seq AS seg_seq, s.start_ms, s.end_ms, """ + _KIND.format(d="d", seq="plan_seq") + """ AS kind,
    greatest(coalesce(d.trim_start_ms, s.start_ms), s.start_ms) AS lo, least(coalesce(d.trim_end_ms, s.end_ms), s.end_ms) AS hi
  FROM flow_dec d JOIN spoken_seg s USING (job_id, segment_id) WHERE d.action <> 'remove')
SELECT job_id, seq, segment_id, seg_seq, kind, CASE WHEN hi <= lo THEN start_ms ELSE lo END AS ws, CASE WHEN hi <= lo THEN end_ms ELSE hi END AS we FROM c""")
fx.CTES["flow_isl"] = (("flow_win", "spoken_words"), ed._islands("flow_win", 500))
fx.CTES["flow_iw"] = (("flow_isl", "flow_win", "spoken_words"), "SELECT * FROM (" + re.sub(r"\bwin\b", "flow_win", ed._IW.replace("isl500", "flow_isl")) + ")")
fx.CTES["flow_steps"] = (("flow_iw",), re.sub(r"\biw\b", "flow_iw", fx.CTES["chunk_steps"][1]))
# Plans to length: the second one where the first is too long and the second is shorter, but not too short.
fx.CTES["flow_second"] = (("spoken_decisions", "spoken_seg"), """
WITH d AS (SELECT * FROM spoken_decisions WHERE action <> 'remove' AND (seq % 3 = 0 OR job_id % 4 = 3)),
c AS (SELECT d.job_id, d.seq, s.segment_id, s.seq AS seg_seq, s.start_ms, s.end_ms, CASE WHEN d.job_id % 10 <> 9 AND d.job_id % 3 = 0 THEN 'mixed' ELSE 'cut' END AS kind,
    greatest(coalesce(d.trim_start_ms, s.start_ms), s.start_ms) AS lo, least(coalesce(d.trim_end_ms, s.end_ms), s.end_ms) AS hi
  FROM d JOIN spoken_seg s USING (job_id, segment_id))
SELECT job_id, seq, segment_id, seg_seq, kind, CASE WHEN hi <= lo THEN start_ms ELSE lo END AS ws, CASE WHEN hi <= lo THEN end_ms ELSE hi END AS we FROM c""")
fx.CTES["flow_adopted"] = (("flow_win", "flow_second", "spoken_seg"), """
WITH t AS (SELECT job_id, CAST(floor(sum(end_ms - start_ms) * (job_id % 4 + 1) / 10) AS BIGINT) AS target_ms FROM spoken_seg WHERE job_id % 11 <> 10 GROUP BY job_id),
a AS (SELECT job_id, sum(we - ws) AS ms FROM flow_win GROUP BY job_id), b AS (SELECT job_id, sum(we - ws) AS ms FROM flow_second GROUP BY job_id)
SELECT job_id FROM t JOIN a USING (job_id) JOIN b USING (job_id)
WHERE target_ms > 0 AND a.ms > target_ms * 1.05::DOUBLE AND b.ms >= target_ms * 0.6::DOUBLE AND b.ms < a.ms""")
fx.CTES["fit_win"] = (("flow_win", "flow_second", "flow_adopted"), """
SELECT * FROM flow_win WHERE job_id NOT IN (SELECT job_id FROM flow_adopted) UNION ALL SELECT * FROM flow_second WHERE job_id IN (SELECT job_id FROM flow_adopted)""")
fx.CTES["fit_isl"] = (("fit_win", "spoken_words"), ed._islands("fit_win", 500))
# The same with takes cut out of segments whose speakers start again.
fx.CTES["rep_word_rows"] = (("rep_words",), "SELECT job_id, scene_seq AS seg_seq, k AS seq, text, start_ms, end_ms FROM rep_words")
fx.CTES["take_win"] = (("take_rows", "rep_seg"), "WITH " + ed._TAKE_CUTS.lstrip(",\n").replace("\nSELECT g.job_id, g.seq, g.segment_id, 'keep'", """,
x AS (SELECT g.job_id, g.seq, g.segment_id, g.start_ms, g.end_ms, 'keep'""") + """)
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY seq, coalesce(trim_start_ms, 0)) - 1 AS seq, segment_id, seq AS seg_seq,
  """ + _KIND.format(d="x", seq="seq") + """ AS kind, coalesce(trim_start_ms, start_ms) AS ws, coalesce(trim_end_ms, end_ms) AS we FROM x""")
fx.CTES["take_isl"] = (("take_win", "rep_word_rows"), ed._islands("take_win", 500).replace("spoken_words", "rep_word_rows"))


def _flow_clips(name):
    return fx.with_tables(f"{name}_isl", f"{name}_win", "media", recursive=name == "take") + f""",
r AS (SELECT i.job_id, i.seq, i.island, w.segment_id, w.kind, m.fps::DOUBLE AS fps, CAST(floor(i.start_ms::DOUBLE * m.fps::DOUBLE / 1000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS start_from,
    CAST(floor((i.end_ms - i.start_ms)::DOUBLE * m.fps::DOUBLE / 1000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS duration_frames
  FROM {name}_isl i JOIN {name}_win w USING (job_id, seq) JOIN media m ON m.job_id = i.job_id),
k AS (SELECT *, row_number() OVER o - 1 AS n, CAST(coalesce(sum(duration_frames) OVER (PARTITION BY job_id ORDER BY seq, island ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS out_start
  FROM r WHERE duration_frames > 0 WINDOW o AS (PARTITION BY job_id ORDER BY seq, island))
SELECT job_id, n AS seq, segment_id, start_from, duration_frames, out_start, CASE WHEN kind <> 'mixed' THEN kind WHEN n % 2 = 1 THEN 'fade' ELSE 'cut' END AS transition,
  CASE WHEN kind <> 'cut' THEN CAST(floor(fps * 0.5::DOUBLE + 0.5::DOUBLE) AS BIGINT) END AS transition_frames FROM k"""


def _flow_captions(chunks, style, size, jobs):
    sql = ed._CAPTIONS.format(chunks=chunks, style=style, size=size).lstrip(",\n").replace("isl500", "flow_isl")
    return f"SELECT * FROM (WITH {sql}) c WHERE job_id % 10 <> 9 AND job_id % 4 = {jobs}"


_INSERTS = fx.with_tables("clips", "spoken_seg") + """,
k AS (SELECT c.job_id, c.seq, c.segment_id, row_number() OVER (PARTITION BY c.job_id ORDER BY c.seq) - 1 AS n FROM clips c JOIN spoken_seg g USING (job_id, segment_id) WHERE g.seq % 6 = 0),
f AS (SELECT job_id, segment_id, min(n) AS n FROM k WHERE n < 5 GROUP BY ALL),
o AS (SELECT c.*, f.n, coalesce(f.n % 4 <> 1, false) AS hit FROM clips c LEFT JOIN f USING (job_id, segment_id)),
w AS (SELECT job_id, seq, clip_id, segment_id, CASE WHEN hit THEN printf('/out/enh_%03d', n) ELSE 'source.mp4' END AS src, CASE WHEN hit THEN 0 ELSE start_from END AS start_from,
  CASE WHEN hit THEN CAST(floor((n + 1) * 0.5::DOUBLE * fps + 0.5::DOUBLE) AS BIGINT) ELSE duration_frames END AS duration_frames, 1.0::DOUBLE AS volume, hit AS is_enhanced, transition FROM o)"""
_CLIP = ["job_id", "seq", "segment_id", "start_from", "duration_frames", "out_start", "transition", "transition_frames"]

QUERIES = {
    "flow1_understand": (
        lambda s, d: understood(s, d).segments.select("job_id", "seq", "segment_id", "start_ms", "end_ms", F.round("energy", 6).alias("energy"), "is_silent"),
        fx.with_tables("energy", "spoken", "spoken_words") + """
SELECT g.job_id, g.seq, printf('seg_%03d', g.seq) AS segment_id, g.start_ms, g.end_ms, round(coalesce((SELECT min_by(e.energy, e.seq) FROM energy e
    WHERE e.job_id = g.job_id AND abs(e.time_ms - g.start_ms) < 500), 0.5), 6) AS energy,
  NOT EXISTS (SELECT 1 FROM spoken_words w WHERE w.job_id = g.job_id AND w.seg_seq = g.seq) AS is_silent FROM spoken g""",
    ),
    "flow1_entities": (
        lambda s, d: understood_with_answers(s, d).entities.select("job_id", "entity_id", "total_screen_ms"),
        fx.with_tables("spoken") + """
SELECT job_id, 'e' || CAST(seq // 200 AS BIGINT) AS entity_id, CAST(coalesce(sum(end_ms - start_ms) FILTER (seq % 3 = 0), 0) AS BIGINT) AS total_screen_ms FROM spoken GROUP BY job_id, seq // 200""",
    ),
    "flow1_topics": (
        lambda s, d: understood_with_answers(s, d).topics.select("job_id", "topic_id", "total_duration_ms"),
        fx.with_tables("spoken") + """
SELECT job_id, 't' || CAST(seq // 200 AS BIGINT) AS topic_id, CAST(coalesce(sum(end_ms - start_ms) FILTER (seq % 2 = 0), 0) AS BIGINT) AS total_duration_ms FROM spoken GROUP BY job_id, seq // 200""",
    ),
    "flow1_updated_segments": (
        lambda s, d: understood_with_answers(s, d).segments.select("job_id", "seq", "text_on_screen"),
        fx.with_tables("spoken") + "\nSELECT job_id, seq, CASE WHEN seq % 4 = 1 THEN 'T' END AS text_on_screen FROM spoken",
    ),
    "flow1_energy": (
        lambda s, d: understood_with_answers(s, d).energy_curve.select("job_id", "seq", "time_ms", F.round("energy", 6).alias("energy")),
        fx.with_tables("energy") + "\nSELECT job_id, seq, time_ms, round(energy, 6) AS energy FROM energy",
    ),
    "flow1_errors": (
        lambda s, d: understood_partly(s, d).errors,
        fx.with_tables("spoken", "energy", "media") + """,
j AS (SELECT DISTINCT job_id FROM spoken), o AS (SELECT *, lag(end_ms) OVER (PARTITION BY job_id ORDER BY seq) AS p FROM spoken)
SELECT job_id, -1 AS seq, 'missing_entities' AS code FROM j WHERE job_id % 5 = 2
UNION ALL SELECT job_id, -1, 'missing_topics' FROM j WHERE job_id % 7 = 3
UNION ALL SELECT job_id, -1, 'missing_energy_curve' FROM j WHERE job_id NOT IN (SELECT job_id FROM energy)
UNION ALL SELECT job_id, -1, 'invalid_width' FROM j JOIN media USING (job_id) WHERE width <= 0
UNION ALL SELECT job_id, seq, 'end_not_after_start' FROM o WHERE end_ms <= start_ms
UNION ALL SELECT job_id, seq, 'non_positive_duration' FROM o WHERE end_ms <= start_ms
UNION ALL SELECT job_id, seq, 'overlap' FROM o WHERE start_ms < p - 10""",
    ),
    "flow2_edit": (lambda s, d: edited(s, d).clips.select(_CLIP), _flow_clips("flow")),
    "flow2_edit_with_takes": (lambda s, d: edited_takes(s, d).clips.select(_CLIP), _flow_clips("take")),
    "flow2_edit_to_length": (lambda s, d: edited_to_length(s, d).clips.select(_CLIP), _flow_clips("fit")),
    "flow2_take_log": (
        lambda s, d: edited_takes(s, d).take_log.withColumns({c: F.round(c, 6) for c in ("audio_confidence", "visual_score", "combined_score")}),
        fx.with_tables("take_rows")
        + "\nSELECT * REPLACE (round(audio_confidence, 6) AS audio_confidence, round(visual_score, 6) AS visual_score, round(combined_score, 6) AS combined_score) FROM take_rows",
    ),
    "flow2_errors": (
        lambda s, d: edited(s, d).errors,
        _flow_clips("flow").rsplit("\nSELECT", 1)[0] + """,
m AS (SELECT job_id, width, (SELECT count(*) FROM k WHERE k.job_id = media.job_id) AS n FROM media WHERE job_id IN (SELECT job_id FROM spoken_seg))
SELECT job_id, 'timeline' AS part, -1 AS seq, unnest(['no_clips', 'invalid_duration']) AS code FROM m WHERE n = 0
UNION ALL SELECT job_id, 'timeline', -1, 'invalid_dimensions' FROM m WHERE width <= 0""",
    ),
    "flow2_captions": (
        lambda s, d: edited(s, d).captions,
        fx.with_tables("flow_iw", "flow_steps", "flow_isl", "media", recursive=True) + "\n"
        + _flow_captions(re.sub(r"\biw\b", "flow_iw", ed._STANDARD).replace("chunk_steps", "flow_steps"), "standard", 36, 0)
        + "\nUNION ALL " + _flow_captions(ed._JUMBO.replace(ed._IW, "SELECT * FROM flow_iw"), "jumbo", 96, 1),
    ),
    "flow2_pacing": (
        lambda s, d: edited(s, d).pacing,
        fx.with_tables("flow_dec", "spoken_seg") + """,
k AS (SELECT d.job_id, d.seq, d.segment_id, s.energy, s.energy < 0.3::DOUBLE AND s.end_ms - s.start_ms > 10000 AS low
  FROM flow_dec d JOIN spoken_seg s USING (job_id, segment_id) WHERE d.action <> 'remove'),
l AS (SELECT *, lag(low) OVER w AS pl, lag(segment_id) OVER w AS pid FROM k WINDOW w AS (PARTITION BY job_id ORDER BY seq)),
j AS (SELECT job_id, max_by(energy, seq) AS le, max(seq) AS seq FROM k GROUP BY job_id)
SELECT job_id, 'nothing_kept' AS code, -1 AS seq, '' AS detail FROM flow_dec GROUP BY job_id HAVING count(*) FILTER (action <> 'remove') = 0
UNION ALL SELECT job_id, 'low_energy_stretch', seq, pid || ',' || segment_id FROM l WHERE low AND pl
UNION ALL SELECT job_id, 'low_energy_ending', seq, '' FROM j WHERE le < 0.3::DOUBLE""",
    ),
    "flow3_clips": (lambda s, d: enhanced(s, d).clips, _INSERTS + "\nSELECT * FROM w"),
    "flow3_totals": (
        lambda s, d: enhanced(s, d).totals,
        _INSERTS + """
SELECT job_id, CAST(sum(duration_frames) AS BIGINT) AS duration_frames, count(*) FILTER (is_enhanced) AS enhanced_clips,
  CASE WHEN count(*) FILTER (is_enhanced) > 0 THEN 'enhanced' ELSE 'standard' END AS edit_mode FROM w GROUP BY job_id""",
    ),
    "flow3_specs": (
        lambda s, d: enhanced(s, d).specs.select("job_id", "spec_no", "scene_id", "seq", "segment_id", "start_ms", "end_ms", "target_subject", "overlay_text"),
        _INSERTS + """
SELECT k.job_id, n AS spec_no, printf('enh_%03d', n) AS scene_id, k.seq, k.segment_id, g.start_ms, g.end_ms, 'Menu' AS target_subject, 'Menu' AS overlay_text
FROM k JOIN spoken_seg g USING (job_id, segment_id) WHERE n < 5""",
    ),
    "flow3_enhance": (
        lambda s, d: enhanced(s, d).manifest,
        fx.with_tables("clips", "spoken_seg") + """,
k AS (SELECT c.job_id, c.seq, row_number() OVER (PARTITION BY c.job_id ORDER BY c.seq) - 1 AS n FROM clips c JOIN spoken_seg g USING (job_id, segment_id) WHERE g.seq % 6 = 0),
s AS (SELECT * FROM k WHERE n < 5),
t AS (SELECT job_id, count(*) AS n, count(*) FILTER (n % 4 <> 1) AS ok, count(*) FILTER (n % 4 = 1) AS fb, sum(n * 100) AS ms FROM s GROUP BY job_id)
SELECT g.job_id, CASE WHEN t.n > 0 THEN 'enhanced' ELSE 'standard' END AS mode, g.n AS total_segments, coalesce(ok, 0) AS enhanced_segments, coalesce(fb, 0) AS fallback_count,
  CAST(coalesce(ms, 0) AS BIGINT) AS render_ms, CASE WHEN coalesce(t.n, 0) = 0 THEN 'pending' WHEN fb = t.n THEN 'failed' WHEN fb > 0 THEN 'degraded' ELSE 'complete' END AS status
FROM (SELECT job_id, count(*) AS n FROM spoken_seg GROUP BY job_id) g LEFT JOIN t USING (job_id)""",
    ),
}
