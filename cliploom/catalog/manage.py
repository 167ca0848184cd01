"""Queries on documents' segments, gates, enhancement, costs and jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cliploom import fixtures as fx
from cliploom.catalog import edit as ed
from cliploom.catalog import understand as un
from cliploom.functions import direction as dr
from cliploom.functions.text import age_bucket, clock, frame_label, frames_of
from cliploom.sources.scratch import scratch_dir
from cliploom.operators import corrections, costs, digest, enhance, enrich, gates, jobs, timeline
from cliploom.operators import decisions as dec
from cliploom.sources import responses

# ---- enrichment ------------------------------------------------------------------------------


def scene_descriptions(s, d):
    """Two answers for every scene with an even number, one for the others; a later one may be empty."""
    sc = fx.scenes(s, d)
    q = F.col("seq")
    return sc.select("job_id", "scene_id", q.alias("_q"), F.explode(F.when(q % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_k")).select(
        "job_id",
        (F.col("_q") * 2 + F.col("_k")).alias("ord"),
        "scene_id",
        F.concat(F.lit("view "), "_k", F.lit(" of "), "scene_id").alias("visual_description"),
        F.when(F.col("_q") % 3 == 0, "other").otherwise("interview").alias("scene_type"),
        (F.col("_q") % 5 + 1).cast("long").alias("visual_interest"),
        F.when(F.col("_k") == 1, F.lit("SALE")).alias("text_on_screen"),
        F.when(F.col("_q") % 4 == 0, F.lit("pan")).alias("camera_motion"),
    )


fx.CTES["described"] = (("scenes",), """
SELECT job_id, seq * 2 + k AS ord, scene_id, 'view ' || k || ' of ' || scene_id AS visual_description,
  CASE WHEN seq % 3 = 0 THEN 'other' ELSE 'interview' END AS scene_type, seq % 5 + 1 AS visual_interest,
  CASE WHEN k = 1 THEN 'SALE' END AS text_on_screen, CASE WHEN seq % 4 = 0 THEN 'pan' END AS camera_motion
FROM (SELECT *, unnest(CASE WHEN seq % 2 = 0 THEN [0, 1] ELSE [0] END) AS k FROM scenes)""")


def _nth(col, n):
    """Group number of a position: n interleaved groups per stretch of 100 n positions."""
    return (F.floor(F.col(col) / (100 * n)) * n + F.col(col) % n).cast("long")


def entities(s, d):
    """Entities that mention every seventh segment of a stretch of 700, the first one twice, and one position too far."""
    g = fx.segments(s, d)
    m = g.groupBy("job_id", _nth("seq", 7).alias("ord")).agg(F.array_sort(F.collect_list("seq")).alias("m"))
    e = F.concat(F.lit("entity_"), F.col("ord").cast("string"))
    return m.select(
        "job_id", "ord", e.alias("entity_id"), F.concat(F.lit("Name "), F.col("ord").cast("string")).alias("name"),
        F.concat(F.slice("m", 1, 1), "m", F.array(F.lit(10**15).cast("long"))).alias("mentions"),
    )


fx.CTES["mentions"] = (("segments",), """
WITH m AS (SELECT job_id, seq // 700 * 7 + seq % 7 AS ord, seq, row_number() OVER (PARTITION BY job_id, seq // 700 * 7 + seq % 7 ORDER BY seq) AS k FROM segments)
SELECT job_id, ord, 'entity_' || ord AS entity_id, k AS mention, seq FROM m
UNION ALL SELECT job_id, ord, 'entity_' || ord, 0, seq FROM m WHERE k = 1""")


def topics(s, d):
    g = fx.segments(s, d)
    m = g.groupBy("job_id", _nth("seq", 5).alias("ord")).agg(F.array_sort(F.collect_list("segment_id")).alias("m"))
    return m.select(
        "job_id", "ord", F.concat(F.lit("topic_"), F.col("ord").cast("string")).alias("topic_id"),
        F.concat("m", F.array(F.lit("seg_unknown"))).alias("segments"),
    )


fx.CTES["topic_rows"] = (("segments",), """
SELECT job_id, seq // 500 * 5 + seq % 5 AS ord, 'topic_' || (seq // 500 * 5 + seq % 5) AS topic_id, segment_id, seq, end_ms - start_ms AS dur,
  row_number() OVER (PARTITION BY job_id, seq // 500 * 5 + seq % 5 ORDER BY segment_id) AS mention FROM segments""")


def updates(s, d):
    g = fx.segments(s, d)
    q = F.col("seq")
    text = F.when(q % 2 == 0, ',"textOnScreen":null').when(q % 5 == 0, ',"textOnScreen":"NEW"').otherwise("")
    body = F.concat(
        F.lit('{"id":"'), "segment_id", F.lit('","visualDescription":"'), F.when(q % 4 == 0, "").otherwise("fresh"), F.lit('","visualInterest":'),
        F.when(q % 9 == 3, '"many"').when(q % 9 == 6, "4.5").otherwise((q % 6).cast("string")), text, F.lit("}"),
    )
    bare = F.concat(F.lit('{"id":"'), "segment_id", F.lit('"}'))
    return g.select("job_id", q.alias("ord"), F.when(q % 3 == 0, body).otherwise(bare).alias("update"))


def documents(s, d):
    g = fx.segments(s, d).groupBy("job_id").agg(F.max("end_ms").alias("_e"))
    m = fx.media(s, d).select("job_id", "fps", "width", "height")
    j = F.col("job_id")
    return g.join(m, "job_id", "left").select(
        "job_id",
        F.when(j % 6 == 5, "2.0").otherwise("1.0").alias("version"),
        F.when(j % 7 == 3, "").otherwise("en").alias("language"),
        F.when(j % 9 == 4, F.lit(0)).when(j % 4 == 1, F.col("_e") * 2).otherwise(F.col("_e")).cast("long").alias("duration_ms"),
        "fps",
        F.when(j % 5 == 2, F.lit(0)).otherwise(F.col("width")).alias("width"),
        "height",
        (j % 8 != 6).alias("has_entities"),
        F.lit(True).alias("has_topics"),
        (j % 3 != 2).alias("has_energy"),
    )


fx.CTES["docs"] = (("segments", "media"), """
SELECT g.job_id, CASE WHEN g.job_id % 6 = 5 THEN '2.0' ELSE '1.0' END AS version, CASE WHEN g.job_id % 7 = 3 THEN '' ELSE 'en' END AS language,
  CASE WHEN g.job_id % 9 = 4 THEN 0 WHEN g.job_id % 4 = 1 THEN e * 2 ELSE e END AS duration_ms, fps,
  CASE WHEN g.job_id % 5 = 2 THEN 0 ELSE width END AS width, height, g.job_id % 8 <> 6 AS has_entities, true AS has_topics, g.job_id % 3 <> 2 AS has_energy
FROM (SELECT job_id, max(end_ms) AS e FROM segments GROUP BY job_id) g LEFT JOIN media USING (job_id)""")


def entity_counts(s, d):
    return fx.segments(s, d).groupBy("job_id").agg(F.count_if(F.col("job_id") % 2 == 0).alias("n_entities"))


# ---- plans ---------------------------------------------------------------------------------------


def second_plan(s, d):
    """A tighter plan: two thirds of the decisions become removals, except in every fourth job."""
    stays = (F.col("seq") % 3 == 0) | (F.col("job_id") % 4 == 3)
    return fx.decisions(s, d).withColumn("action", F.when(stays, F.col("action")).otherwise("remove"))


def targets(s, d):
    return fx.segments(s, d).groupBy("job_id").agg(
        F.floor(F.sum(F.col("end_ms") - F.col("start_ms")) * (F.col("job_id") % 4 + 1) / 10).cast("long").alias("target_ms")
    ).withColumn("target_ms", F.when(F.col("job_id") % 11 == 10, None).otherwise(F.col("target_ms")))


fx.CTES["targets"] = (("segments",), """
SELECT job_id, CASE WHEN job_id % 11 <> 10 THEN CAST(floor(sum(end_ms - start_ms) * (job_id % 4 + 1) / 10) AS BIGINT) END AS target_ms FROM segments GROUP BY job_id""")


def _kept(name: str) -> str:
    return f"""(SELECT job_id, (SELECT count(*) FROM {name} x WHERE x.job_id = j.job_id AND x.action <> 'remove') AS kept_decisions,
  CAST(coalesce((SELECT sum(greatest(0, coalesce(x.trim_end_ms, g.end_ms) - coalesce(x.trim_start_ms, g.start_ms))) FROM {name} x
    JOIN segments g ON g.job_id = x.job_id AND g.segment_id = x.segment_id WHERE x.job_id = j.job_id AND x.action <> 'remove'), 0) AS BIGINT) AS kept_ms
  FROM (SELECT DISTINCT job_id FROM {name}) j)"""


fx.CTES["budget"] = (("decisions", "segments", "targets"), "SELECT k.*, target_ms, coalesce(target_ms > 0 AND kept_ms > target_ms * 1.05::DOUBLE, false) AS over_budget FROM "
    + _kept("decisions") + " k LEFT JOIN targets USING (job_id)")
fx.CTES["second"] = (("decisions",), "SELECT * REPLACE (CASE WHEN seq % 3 = 0 OR job_id % 4 = 3 THEN action ELSE 'remove' END AS action) FROM decisions")

# ---- enhancement ---------------------------------------------------------------------------------

FORCED = ["seg_003", "seg_017"]


def classified(s, d):
    return enhance.classify_enhancements(fx.decisions(s, d), fx.segments(s, d), FORCED)


def first_names(s, d):
    e = entities(s, d)
    return enhance.first_entities(enrich.entity_refs(e, fx.segments(s, d)), e)


def specs(s, d):
    return enhance.enhancement_specs(enhance.cap_enhancements(classified(s, d), 12), fx.segments(s, d), first_names(s, d))


def results(s, d):
    n = F.col("spec_no")
    return specs(s, d).select(
        "job_id",
        n.alias("ord"),
        "scene_id",
        (n % 4 != 1).alias("success"),
        F.when(n % 6 != 5, F.concat(F.lit("/out/"), "scene_id", F.lit(".mp4"))).alias("output_path"),
        F.when(n % 3 != 2, (n + 1) * 0.5).alias("output_s"),
        (n * 100).alias("render_ms"),
        ((n % 4 == 1) | (F.col("job_id") % 10 == 3)).alias("fallback"),
    ).filter("job_id % 10 <> 6")


fx.CTES["classified"] = (("decisions", "segments"), """
SELECT d.job_id, d.seq, d.segment_id, r.* FROM decisions d LEFT JOIN segments g USING (job_id, segment_id), LATERAL (SELECT
  CASE WHEN g.seq IS NULL THEN {'level': 'standard', 'reason': 'not_needed', 'enhancement_type': NULL::VARCHAR, 'confidence': 1.0::DOUBLE}
    WHEN d.segment_id IN ('seg_003', 'seg_017') THEN {'level': 'enhancement_required', 'reason': 'user_requested', 'enhancement_type': 'custom', 'confidence': 1.0::DOUBLE}
    WHEN g.scene_type = 'screenrec' AND g.text_on_screen <> '' THEN {'level': 'enhancement_candidate', 'reason': 'precision_zoom', 'enhancement_type': 'educational_zoom_callout', 'confidence': 0.8::DOUBLE}
    WHEN regexp_matches(lower(coalesce(g.visual_description, '')), '\\b(diagram|chart|graph|infographic|flowchart|table)\\b') THEN {'level': 'enhancement_candidate', 'reason': 'chart_animation', 'enhancement_type': 'chart_animation', 'confidence': 0.7::DOUBLE}
    WHEN g.scene_type = 'action' AND g.visual_interest >= 4 THEN {'level': 'enhancement_candidate', 'reason': 'premium_treatment', 'enhancement_type': 'feature_spotlight', 'confidence': 0.6::DOUBLE}
    WHEN regexp_matches(lower(g.transcript), '\\b(let me explain|here''s how|the key is|importantly|notice that|pay attention)\\b') THEN {'level': 'enhancement_candidate', 'reason': 'educational_emphasis', 'enhancement_type': 'animated_annotation', 'confidence': 0.5::DOUBLE}
    ELSE {'level': 'standard', 'reason': 'not_needed', 'enhancement_type': NULL, 'confidence': 1.0::DOUBLE} END AS x) q, LATERAL (SELECT q.x.level AS level, q.x.reason AS reason, q.x.enhancement_type AS enhancement_type, q.x.confidence AS confidence) r
WHERE d.action <> 'remove'""")
fx.CTES["capped"] = (("classified",), """
SELECT c.* REPLACE (CASE WHEN k.r > 12 THEN 'standard' ELSE c.level END AS level, CASE WHEN k.r > 12 THEN 'not_needed' ELSE c.reason END AS reason)
FROM classified c LEFT JOIN (SELECT job_id, seq, row_number() OVER (PARTITION BY job_id ORDER BY confidence DESC, seq) AS r FROM classified WHERE level <> 'standard') k USING (job_id, seq)""")
fx.CTES["specs"] = (("capped", "segments"), """
WITH j AS (SELECT c.job_id, c.seq, c.segment_id, coalesce(c.enhancement_type, 'custom') AS enhancement_type, g.start_ms, g.end_ms, g.text_on_screen AS t, g.transcript,
    'Name ' || (g.seq // 700 * 7 + g.seq % 7) AS entity FROM capped c JOIN segments g USING (job_id, segment_id) WHERE c.level <> 'standard')
SELECT job_id, row_number() OVER o - 1 AS spec_no, printf('enh_%03d', row_number() OVER o - 1) AS scene_id, seq, segment_id, enhancement_type, start_ms, end_ms,
  CASE WHEN t <> '' THEN t ELSE entity END AS target_subject,
  CASE WHEN enhancement_type IN ('educational_zoom_callout', 'precision_zoom') THEN 'zoom_in_hold_zoom_out'
    WHEN enhancement_type IN ('feature_spotlight', 'object_emphasis') THEN 'steady_zoom_in' ELSE 'static_with_overlay' END AS camera_behavior,
  CASE WHEN t <> '' THEN t WHEN len(string_split(transcript, ' ')) BETWEEN 4 AND 10 THEN transcript END AS overlay_text,
  CASE WHEN enhancement_type IN ('animated_annotation', 'diagram_reveal') THEN 'duck_under_overlay' ELSE 'preserve_original' END AS audio_strategy
FROM j WINDOW o AS (PARTITION BY job_id ORDER BY seq)""")
fx.CTES["results"] = (("specs",), """
SELECT job_id, spec_no AS ord, scene_id, spec_no % 4 <> 1 AS success, CASE WHEN spec_no % 6 <> 5 THEN '/out/' || scene_id || '.mp4' END AS output_path,
  CASE WHEN spec_no % 3 <> 2 THEN (spec_no + 1) * 0.5::DOUBLE END AS output_s, spec_no * 100 AS render_ms, spec_no % 4 = 1 OR job_id % 10 = 3 AS fallback
FROM specs WHERE job_id % 10 <> 6""")


def plain_clips(s, d):
    """Clips of the document segments (no words: one clip per decision)."""
    g = fx.segments(s, d).withColumn("words", ed._no_words())
    c = timeline.build_clips(fx.decisions(s, d), g, fx.media(s, d), 0, "cut")
    return c.withColumn("src", F.when(F.col("job_id") % 6 == 4, F.concat(F.lit("part"), (F.col("seq") % 2).cast("string"))).otherwise("source.mp4"))


fx.CTES["plain_clips"] = (("decisions", "segments", "media"), """
WITH w AS (SELECT d.job_id, d.seq AS dseq, d.segment_id, g.start_ms AS gs, g.end_ms AS ge, greatest(coalesce(d.trim_start_ms, g.start_ms), g.start_ms) AS lo,
    least(coalesce(d.trim_end_ms, g.end_ms), g.end_ms) AS hi, m.fps::DOUBLE AS fps FROM decisions d JOIN segments g USING (job_id, segment_id)
    JOIN media m ON m.job_id = d.job_id WHERE d.action <> 'remove'),
x AS (SELECT job_id, dseq, segment_id, fps, CASE WHEN hi <= lo THEN gs ELSE lo END AS s, CASE WHEN hi <= lo THEN ge ELSE hi END AS e FROM w)
SELECT job_id, row_number() OVER o - 1 AS seq, printf('clip_%03d', row_number() OVER o - 1) AS clip_id, segment_id,
  CAST(floor(s::DOUBLE * fps / 1000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS start_from, CAST(floor((e - s)::DOUBLE * fps / 1000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS duration_frames,
  'cut' AS transition, fps, CASE WHEN job_id % 6 = 4 THEN 'part' || ((row_number() OVER o - 1) % 2) ELSE 'source.mp4' END AS src
FROM x WHERE e > s WINDOW o AS (PARTITION BY job_id ORDER BY dseq)""")


def captions_with_faults(s, d):
    """Captions where every 17th ends before it starts."""
    c = timeline.plan_captions(ed.decided(s, d), ed.spoken(s, d), fx.media(s, d), "jumbo", 500)
    return c.withColumn("end_frame", F.when(F.col("seq") % 17 == 9, F.col("start_frame")).otherwise(F.col("end_frame")))


def spoken_timelines(s, d):
    return timeline.timelines(ed.clips(s, d), fx.media(s, d).join(ed.spoken(s, d).select("job_id").distinct(), "job_id", "left_semi"))


fx.CTES["spoken_timelines"] = (("clips", "media", "spoken"), """
SELECT m.job_id, m.fps::DOUBLE AS fps, m.width, m.height, count(c.seq) AS n_clips, CAST(coalesce(sum(c.duration_frames), 0) AS BIGINT) AS duration_frames
FROM media m LEFT JOIN clips c USING (job_id) WHERE m.job_id IN (SELECT job_id FROM spoken) GROUP BY ALL""")
_BAD_CAPS = "bad_caps AS (SELECT job_id, n AS seq FROM (" + "SELECT w.job_id, row_number() OVER (PARTITION BY w.job_id ORDER BY w.seq, w.rn) - 1 AS n FROM iw w WHERE trim(w.text) <> ''" + ") WHERE n % 17 = 9)"

# ---- costs and jobs ------------------------------------------------------------------------------


def priced(s, d):
    return costs.price_calls(fx.llm_calls(s, d))


def budgets(s, d):
    j = F.col("job_id")
    return fx.media(s, d).select("job_id", F.when(j % 5 != 4, (j % 10 + 1) * 0.06).alias("budget_usd"))


_PRICES = ", ".join(f"('{p}', '{m}', {i}::DOUBLE, {o}::DOUBLE)" for p, m, i, o in sorted(
    {(p, m, i, o) for p, _, m, i, o, _, _ in costs.MODELS} | set(costs.EXTRA_PRICES)))
_DEFAULTS = ", ".join(f"('{p}', '{m}')" for p, m in costs.DEFAULT_MODEL.items())
fx.CTES["priced"] = (("llm_calls",), f"""
WITH p(provider, model, i, o) AS (VALUES {_PRICES}), f(provider, model) AS (VALUES {_DEFAULTS})
SELECT c.*, c.input_tokens / 1000.0::DOUBLE * coalesce(p.i, q.i) + c.output_tokens / 1000.0::DOUBLE * coalesce(p.o, q.o) AS cost_usd
FROM llm_calls c LEFT JOIN p USING (provider, model) JOIN f ON f.provider = c.provider JOIN p q ON q.provider = f.provider AND q.model = f.model""")
fx.CTES["budgets"] = (("media",), "SELECT job_id, CASE WHEN job_id % 5 <> 4 THEN (job_id % 10 + 1) * 0.06::DOUBLE END AS budget_usd FROM media")


def job_updates(s, d):
    """Up to two updates per third job, some deletes, from the events of the jobs."""
    e = fx.table(s, d, "events")
    n = F.col("event_id")
    return e.select(
        (n % 4000 * 3).alias("job_id"),
        n.alias("ord"),
        F.col("ts").alias("at"),
        (n % 50 == 7).alias("deleted"),
        F.when(n % 2 == 0, "cancelled").alias("state"),
        F.when(n % 3 == 0, F.concat(F.lit("renamed_"), n.cast("string"), F.lit(".mp4"))).alias("source_file"),
    )


def files(s, d):
    li = fx.table(s, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("job_id"), (F.col("l_partkey") * 1000 + F.col("l_linenumber")).cast("long").alias("length"))


_MODELS_SQL = ", ".join(f"('{p}', '{t}', '{m}', {i}::DOUBLE, {o}::DOUBLE)" for p, t, m, i, o, _, _ in costs.MODELS)
_TIERS_SQL = ", ".join(f"('{t}', '{a}', '{b}')" for t, a, b in costs.TASK_TIERS)
_TASKS = [t for t, _, _ in costs.TASK_TIERS]


def routing_requests(s, d):
    c = fx.llm_calls(s, d)
    n = F.col("call_id")
    return c.select(
        n.alias("request_id"),
        fx._pick(n % 10, _TASKS).alias("task"),
        "provider",
        (n % 4 == 1).alias("enriched"),
        F.when(n % 13 == 5, "local").alias("override_provider"),
        F.when(n % 13 == 5, "fast").alias("override_tier"),
        "input_tokens",
        "output_tokens",
    )


_MOVES = ", ".join(f"('{a}', '{b}')" for a, bs in jobs.NEXT_STATES.items() for b in bs)


def moves(s, d):
    """Jobs with an old error, and a request for every third one."""
    j = fx.jobs(s, d).withColumns({"updated_at": F.lit(None).cast("timestamp"), "error": F.lit("old")})
    target = fx._pick((F.col("job_id") * 5 + 3) % 14, fx.STATES)
    return j, fx.jobs(s, d).filter("job_id % 3 = 0").select("job_id", target.alias("target_state"), F.lit("why").alias("detail"), F.col("created_at").alias("at"))


_REQUESTS = fx.with_tables("jobs") + f""", m(a, b) AS (VALUES {_MOVES}),
q AS (SELECT job_id, state, created_at, [{", ".join(f"'{x}'" for x in fx.STATES)}][CAST((job_id * 5 + 3) % 14 + 1 AS INT)] AS target FROM jobs WHERE job_id % 3 = 0)"""


def run_manifests(s, d):
    return jobs.run_manifests(fx.jobs(s, d), costs.cost_rollup(priced(s, d), budgets(s, d)))


def manifest_costs(s, d):
    """The maps of every manifest, one row per entry."""
    m = run_manifests(s, d)
    part = lambda name: m.select("job_id", F.lit(name).alias("part"), F.explode(F.from_json(f"by_{name}", "map<string,double>")).alias("name", "usd"))
    return part("stage").unionByName(part("provider")).withColumn("usd", F.round("usd", 9))


def stored_bytes(s, d):
    """Bytes that a folder of text files per job takes, as the reader of file sizes sees it."""
    root = f"{scratch_dir(s)}/files-{uuid.uuid4().hex}"
    fx.segments(s, d).select("job_id", F.col("segment_id").alias("value")).write.partitionBy("job_id").text(root)
    return jobs.storage_use(jobs.stored_files(s, root)).filter("job_id <> '_SUCCESS'").select("job_id", "bytes")


def fixes(s, d):
    """Fix orders: each 9th word by its own text, 3.6 s apart; in every 20th job one of them finds nothing."""
    w = fx.words(s, d).filter("seq % 9 = 4")
    bad = (F.col("job_id") % 20 == 0) & (F.col("seq") == 13)
    spec = F.concat(
        F.when(bad, "nosuchword").otherwise(F.col("text")), F.lit("@"), F.format_string("%.3f", (F.col("start_ms") + 100) / F.lit(1000.0)), F.lit("=Fixed"), F.col("seq").cast("string")
    )
    return w.select("job_id", F.col("seq").alias("ord"), spec.alias("spec"))


fx.CTES["fix_hits"] = (("spoken_words", "words"), """
WITH f AS (SELECT job_id, seq AS ord, CASE WHEN job_id % 20 = 0 AND seq = 13 THEN 'nosuchword' ELSE text END AS t, start_ms + 100 AS pos_ms, 'Fixed' || seq AS repl
  FROM words WHERE seq % 9 = 4)
SELECT f.job_id, f.ord, f.t || '@' || printf('%.3f', pos_ms / 1000.0) || '=' || repl AS spec, repl,
  (SELECT min({'seg': w.seg_seq, 'word': w.seq}) FROM spoken_words w WHERE w.job_id = f.job_id AND w.text = f.t AND abs(w.start_ms - f.pos_ms) < 500) AS pos FROM f""")


def texts(s, d):
    docs = fx.table(s, d, "documents").select("text", F.col("lang").alias("language"), "source")
    conv = fx.table(s, d, "conversations").select("text", F.lit("en").alias("language"), F.col("role").alias("source"))
    literal = s.createDataFrame(LITERAL_TEXTS, "text string, language string, source string")
    return docs.unionByName(conv).unionByName(literal)


# Literal rows, since the supplied tables hold no right-to-left text.
LITERAL_TEXTS = [
    ("שלום עולם", "he", "literal"),
    ("שלום עולם hi", "he-IL", "literal"),
    ("hello wide world של", "en-US", "literal"),
    ("مرحبا", "ar-SA", "literal"),
    ("", "iw", "literal"),
    ("  ", "fr", "literal"),
    ("ab אב", "ara", "literal"),
]
_LITERAL_SQL = ", ".join("('" + "', '".join(r) + "')" for r in LITERAL_TEXTS)
_R = r"[\x{0590}-\x{05FF}\x{0600}-\x{06FF}\x{0700}-\x{074F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"
_PROFILE_SQL = f"""
WITH t AS (SELECT text, lang AS language, source FROM documents UNION ALL SELECT text, 'en', role FROM conversations
  UNION ALL SELECT * FROM (VALUES {_LITERAL_SQL}) v(text, language, source)),
c AS (SELECT *, length(text) - length(regexp_replace(text, '{_R}', '', 'g')) AS r, length(text) - length(regexp_replace(text, '[a-zA-Z]', '', 'g')) AS l,
  split_part(lower(language), '-', 1) IN ('he','ar','fa','ur','yi','iw','heb','ara','fas','urd','yid') AS rtl_language FROM t),
p AS (SELECT *, CASE WHEN regexp_matches(text, '^\\s*$') THEN 'ltr' WHEN r > l THEN 'rtl' ELSE 'ltr' END AS direction FROM c)"""


def _digest_sql(expr: str) -> str:
    return fx.with_tables("segments") + f"\nSELECT job_id, seq, {expr} AS line FROM segments"


def _t(c: str) -> str:
    return f"printf('%d.%d', ({c} + 50) // 1000, ({c} + 50) % 1000 // 100)"


def _st(c: str) -> str:
    n = f"CAST(floor(({c} + 50) / 100.0) AS BIGINT)"
    return f"(CASE WHEN {n} < 0 THEN '-' ELSE '' END || printf('%d.%d', abs({n}) // 10, abs({n}) % 10))"


_SPAN = f"{_t('start_ms')} || 's-' || {_t('end_ms')} || 's'"
_TAIL = """'energy=' || printf('%.2f', energy), CASE WHEN transcript <> '' THEN 'audio="' || substr(transcript, 1, 120) || '"' END,
  CASE WHEN text_on_screen <> '' THEN 'screen_text="' || substr(text_on_screen, 1, 200) || '"' END,
  CASE WHEN visual_description <> '' THEN 'visual="' || substr(visual_description, 1, 150) || '"' END,
  CASE WHEN scene_type <> '' THEN 'type=' || scene_type END, CASE WHEN visual_interest > 0 THEN 'interest=' || visual_interest END,
  CASE WHEN is_silent THEN 'SILENT' END"""
_DIGESTS = {
    "cut_plan": f"concat_ws(' | ', segment_id || ': ' || {_SPAN} || ' (' || {_t('(end_ms - start_ms)')} || 's)', {_TAIL})",
    "fusion": f"""concat_ws(' | ', '[' || segment_id || '] ' || {_SPAN}, CASE WHEN transcript <> '' THEN 'Speech: "' || substr(transcript, 1, 150) || '"' END,
      CASE WHEN visual_description <> '' THEN 'Visual: "' || substr(visual_description, 1, 100) || '"' END,
      'Energy: ' || printf('%.2f', energy) || ', Type: ' || coalesce(scene_type, 'unknown'))""",
    "topics": f"'[' || seq || '] (' || {_SPAN} || ') ' || substr(transcript, 1, 200)",
    "extended": f"""'[' || segment_id || '] ' || {_t('start_ms')} || 's: energy=' || printf('%.2f', energy) || ' "' || substr(transcript, 1, 100) || '"'""",
    "entities": "'[Segment ' || seq || '] ' || transcript",
    "enhancement": """segment_id || ': type=' || coalesce(scene_type, 'unknown') || ' interest=' || coalesce(CAST(visual_interest AS VARCHAR), '?') || ' "'
      || substr(transcript, 1, 80) || '" visual="' || substr(coalesce(visual_description, ''), 1, 80) || '"'""",
}


def _variant(v: str):
    return lambda s, d: digest.digest_lines(fx.segments(s, d), v)


def _tighten(s, d):
    """Digest of the first plan's kept windows for jobs over budget."""
    chk = dec.budget_check(fx.decisions(s, d), fx.segments(s, d), targets(s, d))
    k = dec.tighten_list(fx.decisions(s, d), fx.segments(s, d), chk)
    g = fx.segments(s, d).drop("seq", "start_ms", "end_ms")
    rows = k.join(g, ["job_id", "segment_id"]).withColumnsRenamed({"win_start_ms": "start_ms", "win_end_ms": "end_ms"})
    return digest.digest_lines(rows, "tighten")


QUERIES = {
    "jon6_scene_descriptions": (
        lambda s, d: enrich.attach_descriptions(un.spoken_segments(s, d).drop("words", "speakers"), scene_descriptions(s, d)).select(
            "job_id", "seq", "scene_id", "visual_description", "scene_type", "visual_interest", "text_on_screen", "camera_motion"
        ),
        fx.with_tables("spoken", "described") + """
SELECT g.job_id, g.seq, g.scene_id, x.visual_description, x.scene_type, x.visual_interest, x.text_on_screen, x.camera_motion
FROM (SELECT *, row_number() OVER (PARTITION BY job_id, scene_id ORDER BY seq) AS r FROM spoken) g
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY job_id, scene_id ORDER BY ord DESC) AS k FROM described) x
  ON x.job_id = g.job_id AND x.scene_id = g.scene_id AND x.k = 1 AND g.r = 1""",
    ),
    "jon7_entity_screen_time": (
        lambda s, d: enrich.entity_screen_time(entities(s, d), fx.segments(s, d)).select("job_id", "ord", "entity_id", "total_screen_ms"),
        fx.with_tables("mentions", "segments") + """
SELECT m.job_id, m.ord, m.entity_id, CAST(sum(g.end_ms - g.start_ms) AS BIGINT) AS total_screen_ms FROM mentions m JOIN segments g USING (job_id, seq) GROUP BY ALL""",
    ),
    "jon7_segment_entities": (
        lambda s, d: enrich.entity_refs(entities(s, d), fx.segments(s, d)).withColumn("entities", F.array_join("entities", ",")),
        fx.with_tables("mentions", "segments") + """
SELECT m.job_id, m.seq, g.segment_id, string_agg(m.entity_id, ',' ORDER BY m.ord, m.mention) AS entities FROM mentions m JOIN segments g USING (job_id, seq) GROUP BY ALL""",
    ),
    "jon8_topic_durations": (
        lambda s, d: enrich.topic_durations(topics(s, d), fx.segments(s, d)).select("job_id", "ord", "topic_id", "total_duration_ms"),
        fx.with_tables("topic_rows") + "\nSELECT job_id, ord, topic_id, CAST(sum(dur) AS BIGINT) AS total_duration_ms FROM topic_rows GROUP BY ALL",
    ),
    "jon8_segment_topics": (
        lambda s, d: enrich.segment_topics(topics(s, d), fx.segments(s, d)).withColumn("topics", F.array_join("topics", ",")),
        fx.with_tables("topic_rows") + "\nSELECT job_id, seq, segment_id, string_agg(topic_id, ',' ORDER BY ord, mention) AS topics FROM topic_rows GROUP BY ALL",
    ),
    "jon9_segment_updates": (
        lambda s, d: enrich.apply_updates(fx.segments(s, d), updates(s, d)).select("job_id", "seq", "visual_description", "visual_interest", "text_on_screen", "scene_type"),
        fx.with_tables("segments") + """
SELECT job_id, seq, CASE WHEN seq % 3 = 0 AND seq % 4 <> 0 THEN 'fresh' ELSE visual_description END AS visual_description,
  CASE WHEN seq % 9 = 3 THEN visual_interest WHEN seq % 9 = 6 THEN 5 WHEN seq % 3 = 0 AND seq % 6 <> 0 THEN seq % 6 ELSE visual_interest END AS visual_interest,
  CASE WHEN seq % 3 = 0 AND seq % 2 = 0 THEN NULL WHEN seq % 3 = 0 AND seq % 5 = 0 THEN 'NEW' ELSE text_on_screen END AS text_on_screen, scene_type FROM segments""",
    ),
    "win4_segment_overlaps": (
        lambda s, d: gates.segment_overlaps(fx.segments(s, d)),
        fx.with_tables("segments") + """
SELECT job_id, seq, segment_id, prev_id, start_ms, prev_end_ms FROM (
  SELECT *, lag(end_ms) OVER w AS prev_end_ms, lag(segment_id) OVER w AS prev_id FROM segments WINDOW w AS (PARTITION BY job_id ORDER BY seq))
WHERE start_ms < prev_end_ms""",
    ),
    "agg4_understanding_gate": (
        lambda s, d: gates.understanding_gate(documents(s, d), fx.segments(s, d).withColumn("transcript", F.when(F.col("seq") % 8 == 5, "\n\t").when(F.col("seq") % 4 == 1, "  ").otherwise(F.col("transcript"))), entity_counts(s, d)),
        fx.with_tables("docs", "segments") + """,
g AS (SELECT * REPLACE (CASE WHEN seq % 8 = 5 THEN chr(10) || chr(9) WHEN seq % 4 = 1 THEN '  ' ELSE transcript END AS transcript) FROM segments),
a AS (SELECT job_id, count(*) AS n, sum(end_ms - start_ms) FILTER (regexp_matches(transcript, '\\S') OR is_silent) AS c, sum(end_ms - start_ms) AS s FROM g GROUP BY job_id),
x AS (SELECT * FROM docs JOIN a USING (job_id))
SELECT job_id, 'low_transcript_coverage' AS code, 'warning' AS severity, -1 AS seq FROM x WHERE CASE WHEN duration_ms > 0 THEN coalesce(c, 0) / duration_ms ELSE 0 END < 0.98::DOUBLE
UNION ALL SELECT job_id, 'low_scene_coverage', 'warning', -1 FROM x WHERE duration_ms > 0 AND s / duration_ms < 0.9::DOUBLE
UNION ALL SELECT job_id, 'missing_metadata', 'error', -1 FROM x WHERE coalesce(fps, 0) = 0 OR coalesce(width, 0) = 0 OR coalesce(height, 0) = 0
UNION ALL SELECT job_id, 'no_entities', 'warning', -1 FROM x WHERE n > 5 AND job_id % 2 <> 0
UNION ALL SELECT job_id, 'overlapping_segments', 'error', seq FROM (SELECT *, lag(end_ms) OVER (PARTITION BY job_id ORDER BY seq) AS p FROM g) WHERE start_ms < p""",
    ),
    "set1_gate_results": (
        lambda s, d: gates.gate_result(documents(s, d), gates.understanding_gate(documents(s, d), fx.segments(s, d), entity_counts(s, d))),
        fx.with_tables("docs", "segments") + """,
a AS (SELECT job_id, count(*) AS n, sum(end_ms - start_ms) FILTER (regexp_matches(transcript, '\\S') OR is_silent) AS c, sum(end_ms - start_ms) AS s FROM segments GROUP BY job_id),
x AS (SELECT * FROM docs JOIN a USING (job_id)),
i AS (SELECT job_id, 0 AS e FROM x WHERE CASE WHEN duration_ms > 0 THEN coalesce(c, 0) / duration_ms ELSE 0 END < 0.98::DOUBLE
UNION ALL SELECT job_id, 0 FROM x WHERE duration_ms > 0 AND s / duration_ms < 0.9::DOUBLE
UNION ALL SELECT job_id, 1 FROM x WHERE coalesce(fps, 0) = 0 OR coalesce(width, 0) = 0 OR coalesce(height, 0) = 0
UNION ALL SELECT job_id, 0 FROM x WHERE n > 5 AND job_id % 2 <> 0
UNION ALL SELECT job_id, 1 FROM (SELECT *, lag(end_ms) OVER (PARTITION BY job_id ORDER BY seq) AS p FROM segments) WHERE start_ms < p)
SELECT docs.job_id, count(*) FILTER (e = 1) AS errors, count(*) FILTER (e = 0) AS warnings, count(*) FILTER (e = 1) = 0 AS passed FROM docs LEFT JOIN i USING (job_id) GROUP BY docs.job_id""",
    ),
    "agg5_document_errors": (
        lambda s, d: gates.validate_documents(documents(s, d), fx.segments(s, d).withColumn("end_ms", F.when(F.col("seq") % 19 == 7, F.col("start_ms")).otherwise(F.col("end_ms")))),
        fx.with_tables("docs", "segments") + """,
g AS (SELECT * REPLACE (CASE WHEN seq % 19 = 7 THEN start_ms ELSE end_ms END AS end_ms) FROM segments)
SELECT job_id, -1 AS seq, 'invalid_version' AS code FROM docs WHERE version <> '1.0'
UNION ALL SELECT job_id, -1, 'missing_language' FROM docs WHERE language = ''
UNION ALL SELECT job_id, -1, 'invalid_duration' FROM docs WHERE duration_ms <= 0
UNION ALL SELECT job_id, -1, 'invalid_fps' FROM docs WHERE fps IS NULL OR fps <= 0
UNION ALL SELECT job_id, -1, 'invalid_width' FROM docs WHERE width IS NULL OR width <= 0
UNION ALL SELECT job_id, -1, 'invalid_height' FROM docs WHERE height IS NULL OR height <= 0
UNION ALL SELECT job_id, -1, 'missing_entities' FROM docs WHERE NOT has_entities
UNION ALL SELECT job_id, -1, 'missing_energy_curve' FROM docs WHERE NOT has_energy
UNION ALL SELECT job_id, seq, 'negative_start' FROM g WHERE start_ms < 0
UNION ALL SELECT job_id, seq, 'end_not_after_start' FROM g WHERE end_ms <= start_ms
UNION ALL SELECT job_id, seq, 'non_positive_duration' FROM g WHERE end_ms - start_ms <= 0
UNION ALL SELECT job_id, seq, 'overlap' FROM (SELECT *, lag(end_ms) OVER (PARTITION BY job_id ORDER BY seq) AS p FROM g) WHERE start_ms < p - 10""",
    ),
    "agg6_edit_gate": (
        lambda s, d: gates.edit_gate(
            spoken_timelines(s, d), ed.clips(s, d), captions_with_faults(s, d),
            fx.media(s, d).select("job_id", F.when(F.col("job_id") % 3 != 0, F.col("job_id") % 7 * 15.0).alias("target_s")),
        ),
        fx.with_tables("spoken_timelines", "clips", "media", "iw") + ", " + _BAD_CAPS + """,
x AS (SELECT t.*, CASE WHEN job_id % 3 <> 0 THEN job_id % 7 * 15.0::DOUBLE END AS target_s FROM spoken_timelines t)
SELECT job_id, 'no_clips' AS code, 'error' AS severity, -1 AS seq FROM x WHERE n_clips = 0
UNION ALL SELECT job_id, 'zero_duration', 'error', -1 FROM x WHERE duration_frames <= 0
UNION ALL SELECT job_id, 'duration_mismatch', 'warning', -1 FROM x WHERE target_s > 0 AND abs(duration_frames / fps - target_s) > target_s * 5 / 100
UNION ALL SELECT job_id, 'invalid_caption', 'error', min(seq) FROM bad_caps GROUP BY job_id""",
    ),
    "agg7_timeline_errors": (
        lambda s, d: gates.validate_timelines(
            spoken_timelines(s, d), ed.clips(s, d).withColumn("src", F.when(F.col("seq") % 13 == 5, "").otherwise("source.mp4")), captions_with_faults(s, d)
        ),
        fx.with_tables("spoken_timelines", "clips", "iw") + ", " + _BAD_CAPS + """
SELECT job_id, 'timeline' AS part, -1 AS seq, 'no_clips' AS code FROM spoken_timelines WHERE n_clips = 0
UNION ALL SELECT job_id, 'timeline', -1, 'invalid_duration' FROM spoken_timelines WHERE duration_frames <= 0
UNION ALL SELECT job_id, 'timeline', -1, 'invalid_dimensions' FROM spoken_timelines WHERE width <= 0 OR height <= 0
UNION ALL SELECT job_id, 'clip', seq, 'missing_src' FROM clips WHERE seq % 13 = 5
UNION ALL SELECT job_id, 'caption', seq, 'end_not_after_start' FROM bad_caps""",
    ),
    "agg12_budget_check": (
        lambda s, d: dec.budget_check(fx.decisions(s, d), fx.segments(s, d), targets(s, d)),
        fx.with_tables("budget", "segments") + """
SELECT b.*, CASE WHEN over_budget THEN kept_ms - target_ms END AS overage_ms,
  greatest(3, CAST(floor((SELECT count(*) FROM segments g WHERE g.job_id = b.job_id) * 0.3::DOUBLE) AS BIGINT)) AS min_segments FROM budget b""",
    ),
    "agg13_chosen_plan": (
        lambda s, d: dec.choose_plan(
            fx.decisions(s, d), second_plan(s, d), fx.segments(s, d), dec.budget_check(fx.decisions(s, d), fx.segments(s, d), targets(s, d))
        ),
        fx.with_tables("budget", "second", "segments") + ", ok AS (SELECT b.job_id FROM budget b JOIN " + _kept("second") + """ k USING (job_id)
  WHERE b.over_budget AND k.kept_decisions > 0 AND k.kept_ms >= b.target_ms * 0.6::DOUBLE AND k.kept_ms < b.kept_ms)
SELECT *, 1 AS plan FROM decisions WHERE job_id NOT IN (SELECT job_id FROM ok) UNION ALL SELECT *, 2 FROM second WHERE job_id IN (SELECT job_id FROM ok)""",
    ),
    "agg14_fallback_plan": (
        lambda s, d: dec.fallback_keep_all(
            fx.decisions(s, d), fx.segments(s, d), responses.ingest_plans(fx.plan_responses(s, d), ["job_id", "seq"])[1].filter("status = 'failed'")
        ),
        fx.with_tables("decisions", "segments") + """
SELECT job_id, seq, segment_id, action, '' AS reason, trim_start_ms, trim_end_ms FROM decisions WHERE job_id % 10 NOT IN (7, 9)
UNION ALL SELECT job_id, seq, segment_id, 'keep', 'Fallback: plan could not be parsed', NULL, NULL FROM segments WHERE job_id % 10 IN (7, 9)""",
    ),
    "agg16_fast_path": (
        lambda s, d: timeline.fast_path_eligible(
            plain_clips(s, d).withColumn("transition", F.when((F.col("job_id") % 7 == 2) & (F.col("seq") == 3), "fade").otherwise(F.col("transition"))),
            fx.media(s, d).filter("input_i IS NULL"),
        ),
        fx.with_tables("plain_clips") + """
SELECT job_id, count(*) AS n_clips, job_id % 4 <> 0 AND count(DISTINCT src) = 1 AND NOT (job_id % 7 = 2 AND max(seq) >= 3) AS fast_path FROM plain_clips GROUP BY job_id""",
    ),
    "prj7_enhancement_rules": (classified, fx.with_tables("classified") + "\nSELECT * FROM classified"),
    "top4_enhancement_cap": (
        lambda s, d: enhance.cap_enhancements(classified(s, d), 12),
        fx.with_tables("capped") + "\nSELECT * FROM capped",
    ),
    "prj8_enhancement_specs": (specs, fx.with_tables("specs") + "\nSELECT * FROM specs"),
    "jon14_enhancement_inserts": (
        lambda s, d: enhance.apply_inserts(plain_clips(s, d), specs(s, d), results(s, d))[0],
        fx.with_tables("plain_clips", "specs", "results") + """,
f AS (SELECT * FROM specs QUALIFY row_number() OVER (PARTITION BY job_id, segment_id ORDER BY spec_no) = 1),
j AS (SELECT c.*, f.audio_strategy, r.output_path, r.output_s, coalesce(r.success AND r.output_path <> '', false) AS hit
  FROM plain_clips c LEFT JOIN f USING (job_id, segment_id) LEFT JOIN results r ON r.job_id = c.job_id AND r.scene_id = f.scene_id)
SELECT job_id, seq, clip_id, segment_id, CASE WHEN hit THEN output_path ELSE src END AS src, CASE WHEN hit THEN 0 ELSE start_from END AS start_from,
  CASE WHEN hit AND output_s > 0 THEN CAST(floor(output_s * fps + 0.5::DOUBLE) AS BIGINT) ELSE duration_frames END AS duration_frames,
  CASE WHEN hit AND audio_strategy = 'duck_under_overlay' THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END AS volume, hit AS is_enhanced, transition FROM j""",
    ),
    "agg11_enhancement_manifest": (
        lambda s, d: enhance.enhancement_manifest(fx.segments(s, d), specs(s, d), results(s, d)),
        fx.with_tables("segments", "specs", "results") + """
SELECT g.job_id, CASE WHEN s.n > 0 THEN 'enhanced' ELSE 'standard' END AS mode, g.n AS total_segments, coalesce(r.ok, 0) AS enhanced_segments,
  coalesce(r.fb, 0) AS fallback_count, CAST(coalesce(r.ms, 0) AS BIGINT) AS render_ms,
  CASE WHEN coalesce(r.n, 0) = 0 THEN 'pending' WHEN r.fb = r.n THEN 'failed' WHEN r.fb > 0 THEN 'degraded' ELSE 'complete' END AS status
FROM (SELECT job_id, count(*) AS n FROM segments GROUP BY job_id) g LEFT JOIN (SELECT job_id, count(*) AS n FROM specs GROUP BY job_id) s USING (job_id)
LEFT JOIN (SELECT job_id, count(*) AS n, count(*) FILTER (success) AS ok, count(*) FILTER (fallback) AS fb, sum(render_ms) AS ms FROM results GROUP BY job_id) r USING (job_id)""",
    ),
    "jon15_model_routing": (
        lambda s, d: costs.route_models(routing_requests(s, d)).withColumn("estimated_usd", F.round("estimated_usd", 9)),
        fx.with_tables("llm_calls") + f""",
m(provider, tier, model, i, o) AS (VALUES {_MODELS_SQL}), t(task, a, b) AS (VALUES {_TIERS_SQL}),
r AS (SELECT call_id, {repr(_TASKS)}[CAST(call_id % 10 + 1 AS INT)] AS task, CASE WHEN call_id % 13 = 5 THEN 'local' ELSE provider END AS provider,
  call_id % 13 = 5 AS ov, call_id % 4 = 1 AS rich, input_tokens, output_tokens FROM llm_calls),
q AS (SELECT r.*, CASE WHEN ov THEN 'fast' WHEN rich THEN b ELSE a END AS tier FROM r JOIN t USING (task))
SELECT call_id AS request_id, task, provider, tier, model, round(input_tokens / 1000.0::DOUBLE * i + output_tokens / 1000.0::DOUBLE * o, 9) AS estimated_usd FROM q JOIN m USING (provider, tier)""",
    ),
    "jon16_call_prices": (
        lambda s, d: priced(s, d).select("call_id", "provider", "model", F.round("cost_usd", 9).alias("cost_usd")),
        fx.with_tables("priced") + "\nSELECT call_id, provider, model, round(cost_usd, 9) AS cost_usd FROM priced",
    ),
    "agg8_cost_rollup": (
        lambda s, d: costs.cost_rollup(priced(s, d), budgets(s, d)).withColumns(
            {c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.9f", e["value"]))), ",") for c in ("by_stage", "by_provider")}
        ),
        fx.with_tables("priced", "budgets") + """,
t AS (SELECT job_id, sum(cost_usd) AS total, CAST(sum(input_tokens) AS BIGINT) AS i, CAST(sum(output_tokens) AS BIGINT) AS o, count(*) AS n FROM priced GROUP BY job_id),
st AS (SELECT job_id, string_agg(stage || '=' || printf('%.9f', round(c, 9)), ',' ORDER BY stage) AS by_stage FROM (SELECT job_id, stage, sum(cost_usd) AS c FROM priced GROUP BY ALL) GROUP BY job_id),
pr AS (SELECT job_id, string_agg(provider || '=' || printf('%.9f', round(c, 9)), ',' ORDER BY provider) AS by_provider FROM (SELECT job_id, provider, sum(cost_usd) AS c FROM priced GROUP BY ALL) GROUP BY job_id)
SELECT t.job_id, round(total, 9) AS total_usd, i AS input_tokens, o AS output_tokens, n AS calls, by_stage, by_provider,
  coalesce(total >= budget_usd * 0.8::DOUBLE, false) AS near_budget, coalesce(total >= budget_usd, false) AS over_budget, round(budget_usd - total, 9) AS remaining_usd
FROM t JOIN st USING (job_id) JOIN pr USING (job_id) LEFT JOIN budgets USING (job_id)""",
    ),
    "agg9_cost_dashboard": (
        lambda s, d: costs.cost_dashboard(priced(s, d), fx.jobs(s, d)),
        fx.with_tables("priced", "jobs") + """,
p AS (SELECT * FROM priced WHERE job_id IN (SELECT job_id FROM jobs))
SELECT 'total' AS breakdown, 'spend' AS name, round(sum(cost_usd), 9) AS value FROM p
UNION ALL SELECT 'total', 'jobs_tracked', count(DISTINCT job_id) FROM p
UNION ALL SELECT 'total', 'mean_per_job', round(sum(cost_usd) / count(DISTINCT job_id), 9) FROM p
UNION ALL SELECT 'total', 'jobs', count(*) FROM jobs
UNION ALL SELECT 'provider', provider, round(sum(cost_usd), 9) FROM p GROUP BY provider
UNION ALL SELECT 'stage', stage, round(sum(cost_usd), 9) FROM p GROUP BY stage""",
    ),
    "jon18_tracked_jobs": (
        lambda s, d: costs.tracked_jobs(fx.jobs(s, d), costs.cost_rollup(priced(s, d), budgets(s, d))),
        fx.with_tables("priced", "jobs") + """, r AS (SELECT job_id, round(sum(cost_usd), 9) AS t FROM priced GROUP BY job_id)
SELECT count(*) AS total_jobs, count(t) AS tracked_jobs, round(coalesce(sum(t), 0), 9) AS total_usd FROM jobs LEFT JOIN r USING (job_id)""",
    ),
    "agg10_job_counts": (
        lambda s, d: jobs.job_counts(fx.jobs(s, d)),
        fx.with_tables("jobs") + """
SELECT count(*) AS total, count(*) FILTER (state LIKE '%ing%') AS running, count(*) FILTER (state = 'render_done') AS done, count(*) FILTER (state LIKE '%failed%') AS failed FROM jobs""",
    ),
    "win11_transition_audit": (
        lambda s, d: jobs.audit_transitions(fx.job_events(s, d)),
        fx.with_tables("job_events") + f""", m(a, b) AS (VALUES {_MOVES}),
p AS (SELECT job_id, seq, lag(state) OVER (PARTITION BY job_id ORDER BY seq) AS prev_state, state FROM job_events)
SELECT job_id, seq, prev_state, state, prev_state IS NULL OR EXISTS (SELECT 1 FROM m WHERE m.a = p.prev_state AND m.b = p.state) AS legal,
  CASE WHEN state = 'cancelled' THEN 'job.cancelled' WHEN state LIKE '%\\_failed' ESCAPE '\\' THEN 'stage.failed' WHEN state LIKE '%\\_done' ESCAPE '\\' THEN 'stage.completed' ELSE 'stage.started' END AS event_type FROM p""",
    ),
    "win11_applied_transitions": (
        lambda s, d: jobs.apply_transitions(*moves(s, d))[0].select("job_id", "state", "updated_at", "error"),
        _REQUESTS + """
SELECT job_id, target AS state, created_at AS updated_at, CASE WHEN target LIKE '%\\_failed' ESCAPE '\\' THEN 'why' ELSE 'old' END AS error
FROM q WHERE EXISTS (SELECT 1 FROM m WHERE m.a = q.state AND m.b = q.target)""",
    ),
    "win11_rejected_transitions": (
        lambda s, d: jobs.apply_transitions(*moves(s, d))[1],
        _REQUESTS + "\nSELECT job_id, state, target AS target_state FROM q WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.a = q.state AND m.b = q.target)",
    ),
    "win11_current_states": (
        lambda s, d: jobs.current_states(fx.job_events(s, d)),
        fx.with_tables("job_events") + f""", m(a, b) AS (VALUES {_MOVES}), l AS (SELECT job_id, max_by(state, seq) AS state, max(seq) AS last_seq FROM job_events GROUP BY job_id)
SELECT l.*, coalesce((SELECT string_agg(b, ',' ORDER BY b) FROM m WHERE a = state), '') AS next_states, state NOT IN (SELECT a FROM m) AS is_terminal,
  state IN ('render_done', 'ingest_failed', 'understand_failed', 'edit_failed', 'render_failed', 'cancelled') AS listed_terminal FROM l""",
    ),
    "src8_job_updates": (
        lambda s, d: jobs.apply_job_updates(fx.jobs(s, d).withColumn("updated_at", F.col("created_at")), job_updates(s, d)),
        fx.with_tables("jobs") + """,
u AS (SELECT event_id % 4000 * 3 AS job_id, event_id AS ord, ts AS upd, event_id % 50 = 7 AS deleted, CASE WHEN event_id % 2 = 0 THEN 'cancelled' END AS state,
  CASE WHEN event_id % 3 = 0 THEN 'renamed_' || event_id || '.mp4' END AS source_file FROM events),
p AS (SELECT job_id, max_by(state, ord) FILTER (state IS NOT NULL) AS st, max_by(source_file, ord) FILTER (source_file IS NOT NULL) AS sf,
  max_by(upd, ord) FILTER (NOT deleted) AS upd, bool_or(deleted) AS gone FROM u GROUP BY job_id)
SELECT j.job_id, j.created_at, coalesce(st, j.state) AS state, coalesce(sf, j.source_file) AS source_file, coalesce(upd, j.created_at) AS updated_at
FROM jobs j LEFT JOIN p USING (job_id) WHERE NOT coalesce(gone, false)""",
    ),
    "src9_run_manifests": (
        lambda s, d: jobs.run_manifests(fx.jobs(s, d), costs.cost_rollup(priced(s, d), budgets(s, d))).drop("by_stage", "by_provider"),
        fx.with_tables("jobs", "priced") + """, r AS (SELECT job_id, round(sum(cost_usd), 9) AS t FROM priced GROUP BY job_id)
SELECT job_id, state, '2026-04-11.1' AS policy_version, source_file AS source_filename, CASE WHEN state = 'render_done' THEN 'pass' ELSE 'pending' END AS render_validation,
  CASE WHEN state = 'render_done' THEN 'released' ELSE 'held' END AS release_status,
  CASE WHEN state = 'render_done' THEN 'pipeline_complete' ELSE 'stopped_at_' || state END AS release_reason, coalesce(t, 0) AS total_usd FROM jobs LEFT JOIN r USING (job_id)""",
    ),
    "src9_manifest_costs": (
        lambda s, d: manifest_costs(s, d),
        fx.with_tables("jobs", "priced") + """
SELECT job_id, 'stage' AS part, stage AS name, round(sum(cost_usd), 9) AS usd FROM priced JOIN jobs USING (job_id) GROUP BY job_id, priced.stage
UNION ALL SELECT job_id, 'provider', provider, round(sum(cost_usd), 9) FROM priced JOIN jobs USING (job_id) GROUP BY job_id, provider""",
    ),
    "src9_merged_manifests": (
        lambda s, d: jobs.merge_manifests(
            run_manifests(s, d).select("job_id", "render_validation", "release_status", "release_reason"),
            fx.jobs(s, d).filter("job_id % 4 = 1").select("job_id", F.lit("by hand").alias("release_reason"), F.when(F.col("job_id") % 8 == 1, "fail").alias("render_validation")),
        ),
        fx.with_tables("jobs") + """
SELECT job_id, CASE WHEN job_id % 8 = 1 THEN 'fail' WHEN state = 'render_done' THEN 'pass' ELSE 'pending' END AS render_validation,
  CASE WHEN state = 'render_done' THEN 'released' ELSE 'held' END AS release_status,
  CASE WHEN job_id % 4 = 1 THEN 'by hand' WHEN state = 'render_done' THEN 'pipeline_complete' ELSE 'stopped_at_' || state END AS release_reason FROM jobs""",
    ),
    "agg15_stored_bytes": (
        lambda s, d: stored_bytes(s, d),
        fx.with_tables("segments") + "\nSELECT CAST(job_id AS VARCHAR) AS job_id, CAST(sum(strlen(segment_id) + 1) AS BIGINT) AS bytes FROM segments GROUP BY job_id",
    ),
    "agg15_retention_plan": (
        lambda s, d: jobs.retention_plan(fx.jobs(s, d), files(s, d), "cleanable", 25),
        fx.with_tables("jobs") + """,
c AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, job_id) AS r FROM jobs WHERE state NOT IN ('ingesting', 'understanding', 'editing', 'rendering')),
f AS (SELECT l_orderkey AS job_id, sum(l_partkey * 1000 + l_linenumber) AS b FROM lineitem GROUP BY ALL)
SELECT job_id, state, source_file, created_at, CAST(coalesce(b, 0) AS BIGINT) AS freed_bytes FROM c LEFT JOIN f USING (job_id) WHERE r > 25""",
    ),
    "agg15_storage_use": (
        lambda s, d: jobs.storage_use(files(s, d)),
        "SELECT l_orderkey AS job_id, CAST(sum(l_partkey * 1000 + l_linenumber) AS BIGINT) AS bytes, count(*) AS files FROM lineitem GROUP BY ALL",
    ),
    "top5_newest_jobs": (
        lambda s, d: jobs.newest(fx.jobs(s, d), 50),
        fx.with_tables("jobs") + "\nSELECT * FROM jobs ORDER BY created_at DESC, job_id LIMIT 50",
    ),
    "prj9_timecodes": (
        lambda s, d: fx.frames(s, d).join(fx.media(s, d), "job_id").select(
            "job_id", "frame_number", frames_of(F.col("ts_ms") + 37 * F.col("job_id"), F.col("fps")).alias("frame"),
            clock(F.col("ts_ms") + 37 * F.col("job_id")).alias("timecode"), frame_label(F.col("frame_number") * 53).alias("label"),
            F.round(F.col("frame_number") / F.col("fps"), 6).alias("seconds"),
        ),
        fx.with_tables("frames", "media") + """
SELECT f.job_id, frame_number, CAST(floor((ts_ms + 37 * f.job_id)::DOUBLE * fps::DOUBLE / 1000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS frame,
  printf('%02d:%02d.%02d', (ts_ms + 37 * f.job_id) // 60000, (ts_ms + 37 * f.job_id) // 1000 % 60, CAST(floor((ts_ms + 37 * f.job_id) % 1000 / 10.0 + 0.5) AS BIGINT)) AS timecode,
  CASE WHEN frame_number * 53 > 3600 THEN printf('%d:%02d:%02d', (frame_number * 53 - 1) // 3600, (frame_number * 53 - 1) % 3600 // 60, (frame_number * 53 - 1) % 60)
    ELSE printf('%d:%02d', (frame_number * 53 - 1) // 60, (frame_number * 53 - 1) % 60) END AS label, round(frame_number / fps::DOUBLE, 6) AS seconds
FROM frames f JOIN media m USING (job_id)""",
    ),
    "prj9_job_ages": (
        lambda s, d: fx.jobs(s, d).select("job_id", age_bucket(F.col("created_at"), F.lit("1998-08-03 07:30:00").cast("timestamp_ntz")).alias("age")),
        fx.with_tables("jobs") + """, a AS (SELECT job_id, CAST(floor((epoch_ms(TIMESTAMP '1998-08-03 07:30:00') - epoch_ms(created_at)) / 60000.0) AS BIGINT) AS m FROM jobs)
SELECT job_id, CASE WHEN m < 60 THEN m || 'm' WHEN CAST(floor(m / 60.0) AS BIGINT) < 24 THEN CAST(floor(m / 60.0) AS BIGINT) || 'h' ELSE CAST(floor(floor(m / 60.0) / 24) AS BIGINT) || 'd' END AS age FROM a""",
    ),
    "prj6_direction_rollup": (
        lambda s, d: dr.direction_rollup(dr.direction_profile(texts(s, d), "text", "language"), ["language", "source"]),
        _PROFILE_SQL + f"""
SELECT language, source, count(*) AS texts, count(*) FILTER (direction = 'rtl') AS rtl_texts,
  count(*) FILTER (regexp_matches(text, '[\\x{{0590}}-\\x{{05FF}}]')) AS hebrew_texts, count(*) FILTER (regexp_matches(text, '[\\x{{0600}}-\\x{{06FF}}]')) AS arabic_texts,
  count(*) FILTER (r > 0 AND l > 0) AS mixed_texts, count(*) FILTER (rtl_language) AS rtl_language_texts FROM p GROUP BY language, source""",
    ),
    "prj6_wrapped_text": (
        lambda s, d: dr.direction_profile(texts(s, d), "text", "language").groupBy("direction", F.md5("wrapped").alias("digest")).agg(F.count(F.lit(1)).alias("texts")),
        _PROFILE_SQL + """
SELECT direction, md5(CASE WHEN direction = 'rtl' THEN chr(8235) ELSE chr(8234) END || text || chr(8236)) AS digest, count(*) AS texts FROM p GROUP BY ALL""",
    ),
    "prj1_low_confidence_words": (
        lambda s, d: corrections.low_confidence_words(un.spoken_segments(s, d), 0.3),
        fx.with_tables("spoken", "spoken_words") + """,
t AS (SELECT job_id, seg_seq, string_agg(text, ' ' ORDER BY seq) AS tr FROM spoken_words GROUP BY ALL),
r AS (SELECT w.job_id, w.seg_seq, printf('seg_%03d', w.seg_seq) AS segment_id, w.seq AS word_seq, trim(w.text) AS word, w.start_ms, w.confidence, instr(t.tr, trim(w.text)) AS pos, t.tr, length(w.text) AS n
  FROM spoken_words w JOIN t USING (job_id, seg_seq) WHERE w.confidence < 0.3::DOUBLE)
SELECT job_id, seg_seq, segment_id, word_seq, word, start_ms, confidence,
  CASE WHEN pos > 0 THEN substr(tr, greatest(pos - 20, 1), least(length(tr), pos - 1 + n + 20) - greatest(pos - 20, 1) + 1) END AS context,
  row_number() OVER (PARTITION BY job_id ORDER BY seg_seq, word_seq) AS rank FROM r""",
    ),
    "prj1_low_confidence_summary": (
        lambda s, d: corrections.low_confidence_summary(corrections.low_confidence_words(un.spoken_segments(s, d))),
        fx.with_tables("spoken_words") + """,
r AS (SELECT job_id, text, start_ms, confidence, row_number() OVER (PARTITION BY job_id ORDER BY seg_seq, seq) AS k FROM spoken_words WHERE confidence < 0.7::DOUBLE)
SELECT job_id, count(*) AS flagged, string_agg('"' || trim(text) || '" @' || """ + _t("start_ms") + """ || 's (conf ' || printf('%.0f', confidence * 100) || '%)', ', ' ORDER BY k) FILTER (k <= 10) AS shown,
  greatest(count(*) - 10, 0) AS more FROM r GROUP BY job_id""",
    ),
    "jon11_transcript_fixes": (
        lambda s, d: corrections.correct_transcripts(un.spoken_segments(s, d), fixes(s, d))[0].select("job_id", "seq", "transcript"),
        fx.with_tables("fix_hits", "spoken", "spoken_words") + """,
ok AS (SELECT job_id FROM fix_hits GROUP BY job_id HAVING count(*) = count(pos)),
hit AS (SELECT job_id, pos.seg AS seg, pos.word AS word, max_by(repl, ord) AS repl FROM fix_hits SEMI JOIN ok USING (job_id) GROUP BY ALL),
t AS (SELECT w.job_id, w.seg_seq, string_agg(CASE WHEN h.repl IS NOT NULL THEN h.repl ELSE w.text END, ' ' ORDER BY w.seq) AS tr
  FROM spoken_words w LEFT JOIN hit h ON h.job_id = w.job_id AND h.seg = w.seg_seq AND h.word = w.seq GROUP BY ALL)
SELECT g.job_id, g.seq, coalesce(t.tr, '') AS transcript FROM spoken g LEFT JOIN t ON t.job_id = g.job_id AND t.seg_seq = g.seq""",
    ),
    "jon11_fix_problems": (
        lambda s, d: corrections.correct_transcripts(un.spoken_segments(s, d), fixes(s, d))[1],
        fx.with_tables("fix_hits") + "\nSELECT job_id, ord, spec, 'not_found' AS problem FROM fix_hits WHERE pos IS NULL",
    ),
    **{f"prj5_digest_{v}": (_variant(v), _digest_sql(sql)) for v, sql in _DIGESTS.items()},
    "prj5_digest_tighten": (
        _tighten,
        fx.with_tables("budget", "decisions", "segments") + f""",
k AS (SELECT d.seq, d.action, g.* EXCLUDE (seq, start_ms, end_ms), coalesce(d.trim_start_ms, g.start_ms) AS start_ms, coalesce(d.trim_end_ms, g.end_ms) AS end_ms
  FROM decisions d JOIN segments g USING (job_id, segment_id) JOIN budget b ON b.job_id = d.job_id WHERE d.action <> 'remove' AND b.over_budget)
SELECT job_id, seq, concat_ws(' | ', segment_id || ': ' || {_st('start_ms')} || 's-' || {_st('end_ms')} || 's (' || {_st('(end_ms - start_ms)')} || 's) [first-pass: ' || action || ']', {_TAIL}) AS line FROM k""",
    ),
    "prj5_digest_documents": (
        lambda s, d: digest.digest_documents(digest.digest_lines(fx.segments(s, d), "cut_plan"), 40).withColumn("document", F.md5("document")),
        fx.with_tables("segments") + f", l AS (SELECT job_id, seq, {_DIGESTS['cut_plan']} AS line FROM segments)\nSELECT job_id, seq // 40 AS page, md5(string_agg(line, chr(10) ORDER BY seq)) AS document, count(*) AS lines FROM l GROUP BY ALL",
    ),
    "top6_scene_batches": (
        lambda s, d: digest.batches(
            fx.scenes(s, d).select("job_id", "seq", F.concat("scene_id", F.lit(": "), F.format_string("%d", "start_ms"), F.lit(" - "), F.format_string("%d", "end_ms")).alias("t")), "seq", "t", 3
        ),
        fx.with_tables("scenes") + """
SELECT job_id, seq // 3 AS batch, string_agg(scene_id || ': ' || start_ms || ' - ' || end_ms, chr(10) ORDER BY seq) AS document, count(*) AS items FROM scenes GROUP BY ALL""",
    ),
}
