"""Queries of the understanding stage: segments, energy, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliploom import fixtures as fx
from cliploom.operators import intervals, sampling
from cliploom.operators import segments as seg

# ---- segments --------------------------------------------------------------------------------

fx.CTES["spoken"] = (("words", "scenes"), """
WITH s AS (
  SELECT sc.*, CASE WHEN end_ms - start_ms > 60000 AND EXISTS (
      SELECT 1 FROM words w WHERE w.job_id = sc.job_id AND w.start_ms >= sc.start_ms AND w.end_ms <= sc.end_ms)
    THEN CAST(ceil((end_ms - start_ms) / 30000.0) AS BIGINT) ELSE 1 END AS n FROM scenes sc),
p AS (SELECT *, unnest(range(n)) AS piece FROM s)
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY seq, piece) - 1 AS seq, scene_id, seq AS scene_seq, piece,
  start_ms + 30000 * piece AS start_ms,
  CASE WHEN n = 1 THEN end_ms ELSE least(start_ms + 30000 * (piece + 1), end_ms) END AS end_ms
FROM p""")
fx.CTES["spoken_words"] = (("spoken",), """
SELECT g.job_id, g.seq AS seg_seq, w.seq, w.text, w.start_ms, w.end_ms, w.confidence, w.speaker
FROM spoken g JOIN words w ON w.job_id = g.job_id AND w.start_ms >= g.start_ms AND w.end_ms <= g.end_ms""")
fx.CTES["tumbling"] = (("words",), """
WITH d AS (SELECT job_id, max_by(end_ms, seq) AS dur FROM words GROUP BY job_id),
p AS (SELECT job_id, dur, unnest(range(CAST(ceil(dur / 15000.0) AS BIGINT))) AS seq FROM d)
SELECT job_id, seq, 'auto_' || (seq + 1) AS scene_id, seq * 15000 AS start_ms, least((seq + 1) * 15000, dur) AS end_ms FROM p""")

_SEG_SQL = """
SELECT g.job_id, g.seq, printf('seg_%03d', g.seq) AS segment_id, g.scene_id, g.start_ms, g.end_ms,
  coalesce(string_agg(w.text, ' ' ORDER BY w.seq), '') AS transcript,
  min_by(w.speaker, w.seq) AS speaker, count(w.seq) AS word_count, count(w.seq) = 0 AS is_silent
FROM {src} g LEFT JOIN words w ON w.job_id = g.job_id AND w.start_ms >= g.start_ms AND w.end_ms <= g.end_ms
GROUP BY ALL"""


def build(spark, sf):
    return seg.build_segments(fx.words(spark, sf), fx.scenes(spark, sf))


@fx.stored
def spoken_segments(spark, sf):
    return build(spark, sf)


def energy(spark, sf):
    return seg.energy_curve(spoken_segments(spark, sf), fx.media(spark, sf))


fx.CTES["energy"] = (("spoken", "spoken_words", "media"), """
WITH c AS (
  SELECT g.job_id, g.seq, g.start_ms, g.end_ms, count(w.seq) AS n FROM spoken g
  LEFT JOIN spoken_words w ON w.job_id = g.job_id AND w.seg_seq = g.seq GROUP BY ALL),
r AS (SELECT *, CASE WHEN end_ms > start_ms THEN n / ((end_ms - start_ms) / 1000.0::DOUBLE) ELSE 0 END AS rate FROM c),
m AS (SELECT r.*, rate / greatest(max(rate) OVER (PARTITION BY r.job_id), 1.0) AS rr,
    CASE WHEN input_i IS NULL THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS loud
  FROM r LEFT JOIN media USING (job_id))
SELECT job_id, seq, printf('seg_%03d', seq) AS segment_id, start_ms AS time_ms,
  greatest(0, least(1, CASE WHEN n = 0 THEN 0.05::DOUBLE WHEN rr > 0.7::DOUBLE THEN rr * 0.6::DOUBLE + loud * 0.3::DOUBLE + 0.05::DOUBLE
    ELSE rr * 0.3::DOUBLE + loud * 0.5::DOUBLE + 0.1::DOUBLE END)) AS energy,
  CASE WHEN n = 0 THEN 'silence' WHEN rr > 0.7::DOUBLE THEN 'speech_rate' ELSE 'audio_level' END AS driver
FROM m""")

# ---- speech and frames -----------------------------------------------------------------------

fx.CTES["islands"] = (("words",), """
WITH a AS (
  SELECT *, max(end_ms) OVER (PARTITION BY job_id ORDER BY start_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM words),
b AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach + 1500 THEN 1 ELSE 0 END)
    OVER (PARTITION BY job_id ORDER BY start_ms, seq) AS island FROM a)
SELECT job_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM b GROUP BY job_id, island""")
fx.CTES["deduped"] = (("frames",), """
WITH RECURSIVE st AS (
  SELECT job_id, frame_number, phash_hi AS kh, phash_lo AS kl, ts_ms AS kt, false AS is_duplicate FROM frames WHERE frame_number = 1
  UNION ALL
  SELECT f.job_id, f.frame_number,
    CASE WHEN q.dup THEN s.kh ELSE f.phash_hi END, CASE WHEN q.dup THEN s.kl ELSE f.phash_lo END,
    CASE WHEN q.dup THEN s.kt ELSE f.ts_ms END, q.dup
  FROM st s JOIN frames f ON f.job_id = s.job_id AND f.frame_number = s.frame_number + 1,
  LATERAL (SELECT coalesce(s.kh IS NOT NULL AND f.phash_hi IS NOT NULL
    AND bit_count(xor(s.kh, f.phash_hi)) + bit_count(xor(s.kl, f.phash_lo)) <= 10, false) AND f.ts_ms - s.kt < 30000 AS dup) q)
SELECT f.*, st.is_duplicate FROM frames f JOIN st USING (job_id, frame_number)""")
fx.CTES["in_speech"] = (("deduped", "islands"), """
SELECT f.*, EXISTS (SELECT 1 FROM islands i WHERE i.job_id = f.job_id AND f.ts_ms BETWEEN i.start_ms AND i.end_ms) AS in_speech
FROM deduped f""")
fx.CTES["dense"] = (("in_speech",), """
WITH RECURSIVE st AS (
  SELECT job_id, frame_number, CASE WHEN in_speech THEN ts_ms ELSE -999000 END AS ls, CASE WHEN in_speech THEN -999000 ELSE ts_ms END AS lq,
    is_duplicate AND true AS density_kept FROM in_speech WHERE frame_number = 1
  UNION ALL
  SELECT f.job_id, f.frame_number,
    CASE WHEN f.in_speech AND (NOT f.is_duplicate OR f.ts_ms - s.ls >= 5000) THEN f.ts_ms ELSE s.ls END,
    CASE WHEN NOT f.in_speech AND (NOT f.is_duplicate OR f.ts_ms - s.lq >= 15000) THEN f.ts_ms ELSE s.lq END,
    f.is_duplicate AND CASE WHEN f.in_speech THEN f.ts_ms - s.ls >= 5000 ELSE f.ts_ms - s.lq >= 15000 END
  FROM st s JOIN in_speech f ON f.job_id = s.job_id AND f.frame_number = s.frame_number + 1)
SELECT f.job_id, f.frame_number, f.ts_ms, f.phash_hi, f.phash_lo, f.in_speech, st.density_kept, f.is_duplicate AND NOT st.density_kept AS is_duplicate
FROM in_speech f JOIN st USING (job_id, frame_number)""")
_REFINE = """
WITH k AS MATERIALIZED (SELECT *, sum(CASE WHEN is_duplicate THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY frame_number) AS g FROM {src}),
kept AS MATERIALIZED (SELECT job_id, g, phash_hi, phash_lo, lead(phash_hi) OVER w AS h2, lead(phash_lo) OVER w AS l2, lead(g) OVER w AS g2
  FROM k WHERE NOT is_duplicate WINDOW w AS (PARTITION BY job_id ORDER BY frame_number)),
mid AS MATERIALIZED (SELECT job_id, frame_number, g, row_number() OVER (PARTITION BY job_id, g ORDER BY frame_number) - 1 AS r,
    count(*) OVER (PARTITION BY job_id, g) AS n FROM k WHERE is_duplicate AND phash_hi IS NOT NULL),
pick AS MATERIALIZED (
  SELECT mid.*, bit_count(xor(kept.phash_hi, h2)) + bit_count(xor(kept.phash_lo, l2)) AS d
  FROM mid JOIN kept USING (job_id, g) WHERE g2 IS NOT NULL),
chosen AS MATERIALIZED (
  SELECT job_id, frame_number FROM pick WHERE d > 10 AND CASE
    WHEN d <= 25 OR n = 1 THEN r = n // 2
    WHEN n = 2 THEN r IN (0, 1)
    ELSE r IN (0, CAST(floor((n - 1) / 2.0 + 0.5) AS BIGINT), n - 1) END)
SELECT {cols}, c.frame_number IS NOT NULL AS visual_kept, k.is_duplicate AND c.frame_number IS NULL AS is_duplicate
FROM k LEFT JOIN chosen c USING (job_id, frame_number)"""
fx.CTES["sampled"] = (("dense",), _REFINE.format(
    src="dense", cols="k.job_id, k.frame_number, k.ts_ms, k.phash_hi, k.phash_lo, k.in_speech, k.density_kept"))


@fx.stored
def deduped(spark, sf):
    return sampling.dedup_frames(fx.frames(spark, sf))


def sampled(spark, sf):
    return sampling.adaptive_sampling(deduped(spark, sf), fx.words(spark, sf))


_EVEN_SQL = """,
o AS (SELECT job_id, frame_number, row_number() OVER (PARTITION BY job_id ORDER BY frame_number) - 1 AS i, count(*) OVER (PARTITION BY job_id) AS n FROM frames),
j AS (SELECT DISTINCT job_id, n FROM o),
pick1 AS (SELECT job_id, k, CASE WHEN n > {cap} THEN CAST(floor(k * (n::DOUBLE / {cap})) AS BIGINT) ELSE k END AS i
  FROM (SELECT job_id, n, unnest(range(least(n, {cap}))) AS k FROM j)),
s1 AS (SELECT o.job_id, p.k AS i, o.frame_number, least(o.n, {cap}) AS n FROM o JOIN pick1 p ON p.job_id = o.job_id AND p.i = o.i),
pick2 AS (SELECT job_id, k, CASE WHEN n > {fit} THEN CAST(floor(k * (n::DOUBLE / {fit})) AS BIGINT) ELSE k END AS i
  FROM (SELECT job_id, n, unnest(range(least(n, {fit}))) AS k FROM (SELECT DISTINCT job_id, n FROM s1))),
s2 AS (SELECT s1.job_id, p.k AS idx, s1.frame_number, least(s1.n, {fit}) AS sampled FROM s1 JOIN pick2 p ON p.job_id = s1.job_id AND p.i = s1.i)
"""


QUERIES = {
    "agg1_segment_assembly": (
        lambda s, d: build(s, d).drop("words", "speakers"),
        fx.with_tables("spoken", "words") + _SEG_SQL.format(src="spoken"),
    ),
    "jon1_words_in_scenes": (
        lambda s, d: intervals.points_in_intervals(
            fx.words(s, d).select("job_id", "seq", "start_ms", "end_ms"),
            "start_ms",
            "end_ms",
            fx.scenes(s, d).select("job_id", "scene_id", F.col("start_ms").alias("scene_start"), F.col("end_ms").alias("scene_end")),
            "scene_start",
            "scene_end",
        ),
        fx.with_tables("scenes") + """
SELECT w.job_id, w.seq, w.start_ms, w.end_ms, s.scene_id, s.start_ms AS scene_start, s.end_ms AS scene_end
FROM words w JOIN scenes s ON s.job_id = w.job_id AND w.start_ms >= s.start_ms AND w.end_ms <= s.end_ms""",
    ),
    "jon2_long_scene_pieces": (
        lambda s, d: build(s, d)
        .select("job_id", "seq", "scene_id", "start_ms", "end_ms", F.explode("words").alias("w"))
        .select("job_id", "seq", "scene_id", "start_ms", "end_ms", F.col("w.seq").alias("word_seq")),
        fx.with_tables("spoken_words") + """
SELECT g.job_id, g.seq, g.scene_id, g.start_ms, g.end_ms, w.seq AS word_seq
FROM spoken g JOIN spoken_words w ON w.job_id = g.job_id AND w.seg_seq = g.seq""",
    ),
    "jon3_tumbling_windows": (
        lambda s, d: seg.segments_from_words(fx.words(s, d)).drop("words", "speakers"),
        fx.with_tables("tumbling") + _SEG_SQL.format(src="tumbling"),
    ),
    "set3_distinct_speakers": (
        lambda s, d: spoken_segments(s, d)
        .select("job_id", "segment_id", F.size("speakers").cast("long").alias("n_speakers"), F.array_join("speakers", ",").alias("speakers")),
        fx.with_tables("spoken_words") + """, f AS (
  SELECT job_id, seg_seq, speaker, min(seq) AS at FROM spoken_words WHERE speaker <> '' GROUP BY ALL)
SELECT g.job_id, printf('seg_%03d', g.seq) AS segment_id, count(f.at) AS n_speakers,
  coalesce(string_agg(f.speaker, ',' ORDER BY f.at), '') AS speakers
FROM spoken g LEFT JOIN f ON f.job_id = g.job_id AND f.seg_seq = g.seq GROUP BY g.job_id, g.seq""",
    ),
    "agg2_energy_curve": (
        lambda s, d: energy(s, d).withColumn("energy", F.round("energy", 6)),
        fx.with_tables("energy") + "\nSELECT job_id, seq, segment_id, time_ms, round(energy, 6) AS energy, driver FROM energy",
    ),
    "jon10_energy_attach": (
        lambda s, d: seg.attach_energy(fx.segments(s, d).drop("energy"), _shifted_curve(s, d)).select(
            "job_id", "seq", F.round("energy", 6).alias("energy")
        ),
        fx.with_tables("segments") + """, curve AS (
  SELECT job_id, seq, start_ms + 137 * (seq % 9) + CASE WHEN seq % 10 = 4 THEN 5000 ELSE 0 END AS time_ms, energy FROM segments)
SELECT s.job_id, s.seq, round(coalesce((SELECT min_by(c.energy, c.seq) FROM curve c
  WHERE c.job_id = s.job_id AND abs(c.time_ms - s.start_ms) < 500), 0.5), 6) AS energy FROM segments s""",
    ),
    "win1_speech_intervals": (
        lambda s, d: intervals.speech_islands(fx.words(s, d)),
        fx.with_tables("islands") + "\nSELECT * FROM islands",
    ),
    "stf1_near_duplicate_frames": (
        lambda s, d: sampling.dedup_frames(fx.frames(s, d)),
        fx.with_tables("deduped") + "\nSELECT * FROM deduped",
    ),
    "jon4_frame_in_speech": (
        lambda s, d: sampling.flag_speech(fx.frames(s, d), intervals.speech_islands(fx.words(s, d))).select(
            "job_id", "frame_number", "ts_ms", "in_speech"
        ),
        fx.with_tables("frames", "islands") + """
SELECT f.job_id, f.frame_number, f.ts_ms,
  EXISTS (SELECT 1 FROM islands i WHERE i.job_id = f.job_id AND f.ts_ms BETWEEN i.start_ms AND i.end_ms) AS in_speech FROM frames f""",
    ),
    "stf2_speech_density": (
        lambda s, d: sampling.speech_density(deduped(s, d), intervals.speech_islands(fx.words(s, d))),
        fx.with_tables("dense") + "\nSELECT * FROM dense",
    ),
    "top3_visual_refinement": (
        lambda s, d: sampling.visual_refinement(deduped(s, d)),
        fx.with_tables("deduped") + ", refined AS (" + _REFINE.format(
            src="deduped", cols="k.job_id, k.frame_number, k.ts_ms, k.phash_hi, k.phash_lo") + ")\nSELECT * FROM refined",
    ),
    "stf5_adaptive_sampling": (
        lambda s, d: sampling.sampling_counts(sampled(s, d)),
        fx.with_tables("sampled") + """
SELECT job_id, count(*) FILTER (density_kept) AS phase1_unflagged, count(*) FILTER (visual_kept) AS phase2_unflagged,
  count(*) FILTER (NOT is_duplicate) AS total_kept FROM sampled GROUP BY job_id""",
    ),
    "stf5_sampled_frames": (
        lambda s, d: sampled(s, d).select("job_id", "frame_number", "ts_ms", "phash_hi", "phash_lo", "in_speech", "density_kept", "visual_kept", "is_duplicate"),
        fx.with_tables("sampled") + "\nSELECT * FROM sampled",
    ),
    # The sentence is a fixed value.
    "agg3_motion_quality": (
        lambda s, d: sampling.motion_quality(deduped(s, d)),
        fx.with_tables("deduped") + """
SELECT job_id, dup_frames, total_frames, round(dup_frames / total_frames, 6) AS dup_ratio, dup_frames / total_frames >= 0.4 AS slideshow,
  CASE WHEN dup_frames / total_frames >= 0.4 THEN '[motion-quality: ' || CAST(floor(dup_frames / total_frames * 100 + 0.5) AS BIGINT)
    || '% of frames are perceptual duplicates of the prior frame - subjects show minimal movement; this video may read as a slideshow rather than live footage] '
    ELSE '' END AS summary_prefix
FROM (SELECT job_id, CAST(count(*) FILTER (is_duplicate) AS DOUBLE) AS dup_frames, count(*) AS total_frames FROM deduped GROUP BY job_id)""".replace(
            "CAST(count(*) FILTER (is_duplicate) AS DOUBLE)", "count(*) FILTER (is_duplicate)"),
    ),
    "jon5_representative_frames": (
        lambda s, d: sampling.representative_frames(fx.scenes(s, d), deduped(s, d)),
        fx.with_tables("scenes", "deduped") + """, o AS (
  SELECT *, (row_number() OVER (PARTITION BY job_id ORDER BY seq) - 1) // 10 AS batch FROM scenes),
m AS (SELECT s.job_id, s.seq, f.frame_number, f.ts_ms, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY s.job_id, s.seq) AS n
  FROM scenes s JOIN deduped f ON f.job_id = s.job_id AND NOT f.is_duplicate AND f.ts_ms BETWEEN s.start_ms AND s.end_ms
  WINDOW w AS (PARTITION BY s.job_id, s.seq ORDER BY f.frame_number)),
x AS (SELECT o.job_id, o.seq AS scene_seq, o.scene_id, o.batch, m.frame_number, m.ts_ms FROM o LEFT JOIN m ON m.job_id = o.job_id AND m.seq = o.seq AND m.r = m.n // 2)
SELECT *, CASE WHEN frame_number IS NOT NULL THEN 'frame' WHEN count(frame_number) OVER (PARTITION BY job_id, batch) = 0 THEN 'no_frames_in_batch' ELSE 'no_frame' END AS status FROM x""",
    ),
    "top1_even_downsample": (
        lambda s, d: sampling.even_sample(fx.frames(s, d), cap=60, cols=1),
        fx.with_tables("frames") + _EVEN_SQL.format(cap=60, fit=7500 // 210) + "SELECT job_id, idx, frame_number, sampled FROM s2",
    ),
    "top2_contact_sheet": (
        lambda s, d: sampling.contact_sheet(sampling.even_sample(fx.frames(s, d), cap=60)),
        fx.with_tables("frames") + _EVEN_SQL.format(cap=60, fit=7500 // 210 * 6) + """
SELECT job_id, idx, frame_number, idx // 6 AS grid_row, idx % 6 AS grid_col, (idx % 6) * 328 + 4 AS x, (idx // 6) * 210 + 4 AS y,
  CAST(ceil(sampled / 6.0) AS BIGINT) AS grid_rows,
  CASE WHEN frame_number > 3600 THEN printf('%d:%02d:%02d', (frame_number - 1) // 3600, (frame_number - 1) % 3600 // 60, (frame_number - 1) % 60)
    ELSE printf('%d:%02d', (frame_number - 1) // 60, (frame_number - 1) % 60) END AS label FROM s2""",
    ),
}


def _shifted_curve(s, d):
    """Segment starts moved by up to 1.1 s, some by 5 s more, so that the tolerance decides."""
    q = F.col("seq")
    moved = F.col("start_ms") + 137 * (q % 9) + F.when(q % 10 == 4, 5000).otherwise(0)
    return fx.segments(s, d).select("job_id", "seq", moved.alias("time_ms"), "energy")
