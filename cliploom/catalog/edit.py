"""Queries of the editing stage on spoken segments (words cut by scenes)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cliploom import fixtures as fx
from cliploom.catalog import understand as un
from cliploom.operators import decisions as dec
from cliploom.operators import intervals, silence, takes, timeline
from cliploom.sources.scratch import scratch_dir

fx.CTES["spoken_seg"] = (("spoken", "spoken_words"), """
SELECT g.job_id, g.seq, printf('seg_%03d', g.seq) AS segment_id, g.start_ms, g.end_ms,
  CAST((g.seq * 13 + g.job_id * 5) % 100 AS DOUBLE) / 100 AS energy, g.seq % 6 = 2 AS is_blurry,
  NOT EXISTS (SELECT 1 FROM spoken_words w WHERE w.job_id = g.job_id AND w.seg_seq = g.seq) AS is_silent,
  CASE g.seq % 4 WHEN 0 THEN 'static' WHEN 1 THEN 'Handheld shake' WHEN 2 THEN 'pan' END AS camera_motion
FROM spoken g""")
fx.CTES["spoken_decisions"] = (("spoken_seg",), fx._DECISIONS + "spoken_seg")
fx.CTES["win"] = (("spoken_decisions", "spoken_seg"), """
SELECT d.job_id, d.seq, d.segment_id, d.action, s.seq AS seg_seq, s.start_ms AS seg_start, s.end_ms AS seg_end,
  coalesce(d.trim_start_ms, s.start_ms) AS ws, coalesce(d.trim_end_ms, s.end_ms) AS we
FROM spoken_decisions d JOIN spoken_seg s USING (job_id, segment_id) WHERE d.action <> 'remove'""")
fx.CTES["fixed_win"] = (("win",), """
SELECT * EXCLUDE (ws, we), CASE WHEN least(we, seg_end) <= greatest(ws, seg_start) THEN seg_start ELSE greatest(ws, seg_start) END AS ws,
  CASE WHEN least(we, seg_end) <= greatest(ws, seg_start) THEN seg_end ELSE least(we, seg_end) END AS we
FROM win""")


def _islands(src: str, thr: int) -> str:
    """Islands of contained words per window row of ``src`` (job_id, seq, seg_seq, ws, we)."""
    return f"""
WITH w AS (SELECT d.job_id, d.seq, d.ws, d.we, x.seq AS wseq, x.text, x.start_ms, x.end_ms FROM {src} d
    JOIN spoken_words x ON x.job_id = d.job_id AND x.seg_seq = d.seg_seq AND x.start_ms >= d.ws AND x.end_ms <= d.we),
l AS (SELECT *, lag(end_ms) OVER o AS pe, lag(text) OVER o AS pt FROM w WINDOW o AS (PARTITION BY job_id, seq ORDER BY wseq)),
c AS (SELECT *, sum(CASE WHEN pe IS NOT NULL AND start_ms - pe >= {thr} * CASE WHEN regexp_matches(pt, '[.!?]\\s*$') THEN 1
      WHEN regexp_matches(pt, '[,;:]\\s*$') THEN 2 ELSE 4 END THEN 1 ELSE 0 END) OVER (PARTITION BY job_id, seq ORDER BY wseq) AS island FROM l),
i AS (SELECT job_id, seq, island, min(start_ms) AS start_ms, least(arg_max(end_ms, wseq) + 100, any_value(we)) AS end_ms, count(*) AS n_words,
    min(wseq) AS w0, max(wseq) AS w1 FROM c GROUP BY ALL),
u AS (SELECT * FROM i UNION ALL SELECT d.job_id, d.seq, 0, d.ws, d.we, 0, NULL, NULL FROM {src} d
    WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.job_id = d.job_id AND w.seq = d.seq))
SELECT *, coalesce(sum(end_ms - start_ms) OVER (PARTITION BY job_id, seq ORDER BY island ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset_ms
FROM u"""


fx.CTES["isl500"] = (("win", "spoken_words"), _islands("win", 500))
fx.CTES["fisl500"] = (("fixed_win", "spoken_words"), _islands("fixed_win", 500))
fx.CTES["clips"] = (("fisl500", "fixed_win", "media"), """
WITH r AS (SELECT i.job_id, i.seq AS decision_seq, i.island, d.segment_id, CAST(m.fps AS DOUBLE) AS fps,
    CAST(floor(i.start_ms::DOUBLE * m.fps::DOUBLE / 1000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS start_from,
    CAST(floor((i.end_ms - i.start_ms)::DOUBLE * m.fps::DOUBLE / 1000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS duration_frames
  FROM fisl500 i JOIN fixed_win d ON d.job_id = i.job_id AND d.seq = i.seq JOIN media m ON m.job_id = i.job_id WHERE d.we > d.ws),
k AS (SELECT *, row_number() OVER o - 1 AS n, coalesce(sum(duration_frames) OVER (PARTITION BY job_id ORDER BY decision_seq, island
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS out_start
  FROM r WHERE duration_frames > 0 WINDOW o AS (PARTITION BY job_id ORDER BY decision_seq, island))
SELECT job_id, n AS seq, printf('clip_%03d', n) AS clip_id, decision_seq, segment_id, start_from, duration_frames, CAST(out_start AS BIGINT) AS out_start,
  CASE WHEN n % 2 = 1 THEN 'fade' ELSE 'cut' END AS transition, CAST(floor(fps * 0.5::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS transition_frames, fps FROM k""")


def _off(isl: str) -> str:
    return f"""
SELECT i.job_id, i.seq, CAST(floor(sum(i.end_ms - i.start_ms)::DOUBLE * any_value(m.fps)::DOUBLE / 1000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS fr,
  any_value(m.fps)::DOUBLE AS fps FROM {isl} i JOIN media m USING (job_id) GROUP BY i.job_id, i.seq"""


_CAPTIONS = """,
chunks AS ({chunks}),
offs AS (SELECT *, coalesce(sum(fr) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM (""" + _off("isl500") + """)),
t AS (SELECT c.job_id, c.seq AS decision_seq, c.k, c.text,
    CAST(o.off + floor((c.s - c.island_start + c.offset_ms)::DOUBLE * o.fps / 1000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS start_frame,
    CAST(o.off + floor((c.e - c.island_start + c.offset_ms)::DOUBLE * o.fps / 1000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS e0
  FROM chunks c JOIN offs o USING (job_id, seq) WHERE trim(c.text) <> ''),
u AS (SELECT *, greatest(e0, start_frame + 1) AS e1, row_number() OVER o - 1 AS n, lead(start_frame) OVER o AS nx FROM t
  WINDOW o AS (PARTITION BY job_id ORDER BY decision_seq, k))
SELECT job_id, n AS seq, decision_seq, text, start_frame, CASE WHEN e1 > nx THEN greatest(start_frame + 1, nx) ELSE e1 END AS end_frame,
  'ltr' AS direction, '{style}' AS style, {size} AS font_size, 'bottom' AS position FROM u"""
_IW = """SELECT i.job_id, i.seq, i.island, i.start_ms AS island_start, i.offset_ms, x.seq AS wseq, x.text, x.start_ms, x.end_ms,
  row_number() OVER (PARTITION BY i.job_id, i.seq ORDER BY x.seq) AS rn
  FROM isl500 i JOIN win d ON d.job_id = i.job_id AND d.seq = i.seq
  JOIN spoken_words x ON x.job_id = i.job_id AND x.seg_seq = d.seg_seq AND x.seq BETWEEN i.w0 AND i.w1
    AND x.start_ms >= d.ws AND x.end_ms <= d.we"""
_JUMBO = f"SELECT job_id, seq, rn AS k, text, start_ms AS s, end_ms AS e, island_start, offset_ms FROM ({_IW})"
fx.CTES["iw"] = (("isl500", "win", "spoken_words"), _IW)
fx.CTES["chunk_steps"] = (("iw",), """
WITH RECURSIVE st AS (
  SELECT job_id, seq, rn, island, 1 AS chunk, 1 AS cnt, start_ms AS cs, 1 >= 5 OR end_ms - start_ms >= 2000 AS flush FROM iw WHERE rn = 1
  UNION ALL
  SELECT w.job_id, w.seq, w.rn, w.island, CASE WHEN q.fresh THEN s.chunk + 1 ELSE s.chunk END, CASE WHEN q.fresh THEN 1 ELSE s.cnt + 1 END,
    CASE WHEN q.fresh THEN w.start_ms ELSE s.cs END,
    CASE WHEN q.fresh THEN w.end_ms - w.start_ms >= 2000 ELSE s.cnt + 1 >= 5 OR w.end_ms - s.cs >= 2000 END
  FROM st s JOIN iw w ON w.job_id = s.job_id AND w.seq = s.seq AND w.rn = s.rn + 1, LATERAL (SELECT s.flush OR w.island <> s.island AS fresh) q)
SELECT job_id, seq, rn, chunk FROM st""")
_STANDARD = """SELECT w.job_id, w.seq, c.chunk AS k, string_agg(w.text, ' ' ORDER BY w.rn) AS text, min(w.start_ms) AS s, arg_max(w.end_ms, w.rn) AS e,
  any_value(w.island_start) AS island_start, any_value(w.offset_ms) AS offset_ms FROM iw w JOIN chunk_steps c USING (job_id, seq, rn) GROUP BY w.job_id, w.seq, c.chunk"""


def spoken(s, d):
    """Spoken segments with the visual fields the take scores need."""
    g = un.spoken_segments(s, d)
    q = F.col("seq")
    return g.withColumns(
        {
            "energy": ((q * 13 + F.col("job_id") * 5) % 100).cast("double") / 100,
            "is_blurry": q % 6 == 2,
            "camera_motion": F.when(q % 4 == 0, "static").when(q % 4 == 1, "Handheld shake").when(q % 4 == 2, "pan"),
        }
    )


def decided(s, d):
    return fx.decisions_for(spoken(s, d))


def clips(s, d):
    return timeline.build_clips(decided(s, d), spoken(s, d), fx.media(s, d), threshold_ms=500, transition="mixed")


def written_cut_list(s, d):
    """The cut list read back from its files, and the clips that could not be cut: every fifth one is emptied."""
    path = f"{scratch_dir(s)}/cuts-{uuid.uuid4().hex}"
    some = clips(s, d).withColumn("duration_frames", F.when(F.col("seq") % 5 == 0, 0).otherwise(F.col("duration_frames")).cast("long"))
    rejected = timeline.write_cut_list(some, path)
    return s.read.schema("job_id long, ordinal long, start_s string, duration_s string, output_name string").option("header", True).csv(path), rejected


# Repeated lines: each scene gets a copy of its first eight words after its last word.
fx.CTES["rep_words"] = (("scenes", "words"), """
WITH w AS (SELECT s.job_id, s.seq AS scene_seq, x.seq, x.text, x.start_ms, x.end_ms, x.confidence, x.speaker,
    row_number() OVER (PARTITION BY s.job_id, s.seq ORDER BY x.seq) - 1 AS k, count(*) OVER (PARTITION BY s.job_id, s.seq) AS n,
    max(x.end_ms) OVER (PARTITION BY s.job_id, s.seq) AS last_end, min(x.start_ms) OVER (PARTITION BY s.job_id, s.seq) AS first_start
  FROM scenes s JOIN words x ON x.job_id = s.job_id AND x.start_ms >= s.start_ms AND x.end_ms <= s.end_ms)
SELECT job_id, scene_seq, k, text, start_ms, end_ms, confidence FROM w
UNION ALL
SELECT job_id, scene_seq, n + k, text, start_ms - first_start + last_end + 150, end_ms - first_start + last_end + 150,
  CASE WHEN k % 2 = 0 THEN confidence END FROM w WHERE k < 8""")
fx.CTES["rep_seg"] = (("scenes", "rep_words"), """
SELECT s.job_id, s.seq, printf('seg_%03d', s.seq) AS segment_id, s.start_ms, greatest(s.end_ms, coalesce(max(w.end_ms), s.end_ms)) AS end_ms,
  CAST((s.seq * 13 + s.job_id * 5) % 100 AS DOUBLE) / 100 AS energy, s.seq % 6 = 2 AS is_blurry, count(w.k) = 0 AS is_silent,
  CASE s.seq % 4 WHEN 0 THEN 'static' WHEN 1 THEN 'Handheld shake' WHEN 2 THEN 'pan' END AS camera_motion
FROM scenes s LEFT JOIN rep_words w ON w.job_id = s.job_id AND w.scene_seq = s.seq GROUP BY s.job_id, s.seq, s.start_ms, s.end_ms""")
fx.CTES["rep_tok"] = (("rep_seg", "rep_words"), """
SELECT w.job_id, w.scene_seq AS seq, row_number() OVER (PARTITION BY w.job_id, w.scene_seq ORDER BY w.k) - 1 AS k, w.text, w.start_ms, w.end_ms, w.confidence,
  count(*) OVER (PARTITION BY w.job_id, w.scene_seq) AS n,
  regexp_replace(lower(w.text), '[^a-z0-9\\x{80}-\\x{10FFFF}]', '', 'g') AS tok
FROM rep_words w JOIN rep_seg s ON s.job_id = w.job_id AND s.seq = w.scene_seq WHERE w.end_ms > s.start_ms AND w.start_ms < s.end_ms""")
fx.CTES["rep_pairs"] = (("rep_tok",), """
WITH a AS (SELECT x.job_id, x.seq, x.k AS i, list(y.tok ORDER BY y.k) AS toks FROM rep_tok x JOIN rep_tok y
    ON y.job_id = x.job_id AND y.seq = x.seq AND y.k BETWEEN x.k AND x.k + 5 WHERE x.k <= x.n - 6 GROUP BY ALL)
SELECT a.job_id, a.seq, a.i, b.i AS j FROM a JOIN a b ON b.job_id = a.job_id AND b.seq = a.seq AND b.i >= a.i + 6
WHERE len(list_filter(a.toks, lambda t: t <> '' AND list_contains(b.toks, t))) >= 5""")


@fx.stored
def repeated(s, d):
    sc = fx.scenes(s, d)
    spans = sc.select("job_id", F.col("seq").alias("scene_seq"), F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"))
    hit = intervals.points_in_intervals(fx.words(s, d), "start_ms", "end_ms", spans, "_s", "_e")
    ws = hit.groupBy("job_id", F.col("scene_seq").alias("seq")).agg(
        F.array_sort(F.collect_list(F.struct("seq", "text", "start_ms", "end_ms", "confidence", "speaker"))).alias("w")
    )
    shift = F.array_max(F.transform("w", lambda x: x["end_ms"])) - F.array_min(F.transform("w", lambda x: x["start_ms"])) + 150
    copy = F.transform(
        F.slice("w", 1, 8),
        lambda x, k: F.struct(
            (x["seq"] + 1_000_000).alias("seq"),
            x["text"].alias("text"),
            (x["start_ms"] + shift).alias("start_ms"),
            (x["end_ms"] + shift).alias("end_ms"),
            F.when(k % 2 == 0, x["confidence"]).alias("confidence"),
            x["speaker"].alias("speaker"),
        ),
    )
    ws = ws.withColumn("words", F.concat("w", copy)).drop("w")
    q = F.col("seq")
    out = sc.join(ws, ["job_id", "seq"], "left").withColumn("words", F.coalesce("words", F.slice(F.array(F.struct(
        F.lit(0).cast("long").alias("seq"), F.lit("").alias("text"), F.lit(0).cast("long").alias("start_ms"), F.lit(0).cast("long").alias("end_ms"),
        F.lit(0.0).alias("confidence"), F.lit("").alias("speaker"))), 1, 0)))
    return out.select(
        "job_id",
        "seq",
        F.format_string("seg_%03d", "seq").alias("segment_id"),
        "start_ms",
        F.greatest("end_ms", F.coalesce(F.array_max(F.transform("words", lambda x: x["end_ms"])), F.col("end_ms"))).alias("end_ms"),
        "words",
        (F.size("words") == 0).alias("is_silent"),
        (((q * 13 + F.col("job_id") * 5) % 100).cast("double") / 100).alias("energy"),
        (q % 6 == 2).alias("is_blurry"),
        F.when(q % 4 == 0, "static").when(q % 4 == 1, "Handheld shake").when(q % 4 == 2, "pan").alias("camera_motion"),
    )


def keep_all(s, d):
    return repeated(s, d).select(
        "job_id", "seq", "segment_id", F.lit("keep").alias("action"), F.lit(None).cast("long").alias("trim_start_ms"), F.lit(None).cast("long").alias("trim_end_ms")
    )


_VISUAL = """
(SELECT coalesce(avg(least(1.0::DOUBLE, g.energy) * CASE WHEN g.is_blurry THEN 0.6::DOUBLE ELSE 1 END * CASE WHEN g.is_silent THEN 0.4::DOUBLE ELSE 1 END
  * CASE WHEN lower(coalesce(g.camera_motion, '')) LIKE '%shake%' OR lower(coalesce(g.camera_motion, '')) LIKE '%unstable%' THEN 0.7::DOUBLE ELSE 1 END), 0.5)
  FROM {seg} g WHERE g.job_id = {t}.job_id AND g.end_ms > {t}.start_ms AND g.start_ms < {t}.end_ms)"""


def some_spans(s, d):
    """Overlapping or touching spans in two of three decision windows, some reaching outside it; none in the third."""
    w = silence.windowed(decided(s, d), spoken(s, d)).select("job_id", "seq", "win_start_ms", "win_end_ms")
    ln = F.when(F.col("seq") % 3 == 1, F.lit(0)).otherwise(F.col("win_end_ms") - F.col("win_start_ms"))
    a = F.col("win_start_ms") + F.floor(ln / 4).cast("long") * (F.col("seq") % 2)
    parts = F.array(
        F.struct(a.alias("start_ms"), (a + F.floor(ln / 4)).cast("long").alias("end_ms")),
        F.struct((a + F.floor(ln / 4)).cast("long").alias("start_ms"), (a + F.floor(ln / 3)).cast("long").alias("end_ms")),
        F.struct((a + F.floor(ln / 2)).cast("long").alias("start_ms"), (a + ln - 500 * (F.col("seq") % 4)).cast("long").alias("end_ms")),
    )
    return w.select("job_id", "seq", F.explode(parts).alias("x")).select("job_id", "seq", "x.start_ms", "x.end_ms").filter("end_ms > start_ms")


fx.CTES["some_spans"] = (("win",), """
WITH l AS (SELECT job_id, seq, ws, CASE WHEN seq % 3 = 1 THEN 0 ELSE we - ws END AS ln FROM win),
b AS (SELECT job_id, seq, ln, ws + CAST(floor(ln / 4.0) AS BIGINT) * (seq % 2) AS a FROM l),
p AS (SELECT job_id, seq, a AS start_ms, a + CAST(floor(ln / 4.0) AS BIGINT) AS end_ms FROM b
  UNION ALL SELECT job_id, seq, a + CAST(floor(ln / 4.0) AS BIGINT), a + CAST(floor(ln / 3.0) AS BIGINT) FROM b
  UNION ALL SELECT job_id, seq, a + CAST(floor(ln / 2.0) AS BIGINT), a + ln - 500 * (seq % 4) FROM b)
SELECT * FROM p WHERE end_ms > start_ms""")
_MERGED = """
m0 AS (SELECT *, max(end_ms) OVER (PARTITION BY job_id, seq ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM some_spans),
m1 AS (SELECT *, sum(CASE WHEN r IS NULL OR start_ms > r THEN 1 ELSE 0 END) OVER (PARTITION BY job_id, seq ORDER BY start_ms, end_ms) AS g FROM m0),
merged AS (SELECT job_id, seq, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM m1 GROUP BY job_id, seq, g)"""

fx.CTES["take_pairs"] = (("rep_pairs", "rep_tok"), """
WITH RECURSIVE c AS (
  SELECT p.job_id, p.seq, p.i, list(p.j ORDER BY p.j) AS js, row_number() OVER (PARTITION BY p.job_id, p.seq ORDER BY p.i) AS r
  FROM rep_pairs p JOIN (SELECT job_id, seq, count(*) AS n FROM rep_tok GROUP BY ALL) q USING (job_id, seq) WHERE q.n >= 12 GROUP BY p.job_id, p.seq, p.i),
st AS (
  SELECT job_id, seq, r, i, js[1] AS j, list_concat(range(i, i + 6), range(js[1], js[1] + 6)) AS used FROM c WHERE r = 1
  UNION ALL
  SELECT c.job_id, c.seq, c.r, c.i, q.j, CASE WHEN q.j IS NULL THEN s.used ELSE list_concat(s.used, list_concat(range(c.i, c.i + 6), range(q.j, q.j + 6))) END
  FROM st s JOIN c ON c.job_id = s.job_id AND c.seq = s.seq AND c.r = s.r + 1,
    LATERAL (SELECT CASE WHEN list_contains(s.used, c.i) THEN NULL ELSE list_filter(c.js, lambda x: NOT list_contains(s.used, x))[1] END AS j) q)
SELECT job_id, seq, row_number() OVER (PARTITION BY job_id, seq ORDER BY i) - 1 AS cluster, i, j FROM st WHERE j IS NOT NULL""")
fx.CTES["take_rows"] = (("take_pairs", "rep_tok", "rep_seg"), """
WITH e AS (SELECT job_id, seq, cluster, 0 AS take, i AS k0 FROM take_pairs UNION ALL SELECT job_id, seq, cluster, 1, j FROM take_pairs),
t AS (SELECT e.job_id, e.seq, e.cluster, e.take, arg_min(w.start_ms, w.k) AS start_ms, arg_max(w.end_ms, w.k) AS end_ms,
    string_agg(w.text, ' ' ORDER BY w.k) FILTER (w.k < e.k0 + 5) AS phrase, coalesce(avg(w.confidence), 0.7::DOUBLE) AS audio_confidence
  FROM e JOIN rep_tok w ON w.job_id = e.job_id AND w.seq = e.seq AND w.k BETWEEN e.k0 AND e.k0 + 5 GROUP BY e.job_id, e.seq, e.cluster, e.take, e.k0),
v AS (SELECT t.*, """ + _VISUAL.format(seg="rep_seg", t="t") + """ AS visual_score FROM t),
c AS (SELECT *, 0.7::DOUBLE * audio_confidence + 0.3::DOUBLE * visual_score AS combined_score FROM v),
p AS (SELECT job_id, seq, cluster, max(combined_score) FILTER (take = 0) AS s0, max(combined_score) FILTER (take = 1) AS s1,
    max(phrase) FILTER (take = 0) AS p0, max(phrase) FILTER (take = 1) AS p1 FROM c GROUP BY ALL),
b AS (SELECT *, CASE WHEN abs(s0 - s1) < 0.02::DOUBLE OR s0 > s1 THEN 0 ELSE 1 END AS win FROM p)
SELECT c.job_id, c.seq, printf('seg_%03d', c.seq) AS segment_id, c.cluster, c.take, CASE WHEN b.win = 0 THEN p0 ELSE p1 END AS phrase,
  c.start_ms, c.end_ms, audio_confidence, visual_score, combined_score, c.take = b.win AS kept FROM c JOIN b USING (job_id, seq, cluster)""")
_TAKE_CUTS = """,
some_spans AS (SELECT job_id, seq, start_ms, end_ms FROM take_rows WHERE NOT kept),""" + _MERGED + """,
c AS (SELECT m.job_id, m.seq, coalesce(lag(m.end_ms) OVER (PARTITION BY m.job_id, m.seq ORDER BY m.start_ms), g.start_ms) AS s, m.start_ms AS e
    FROM merged m JOIN rep_seg g USING (job_id, seq)
  UNION ALL SELECT m.job_id, m.seq, max(m.end_ms), any_value(g.end_ms) FROM merged m JOIN rep_seg g USING (job_id, seq) GROUP BY m.job_id, m.seq),
p AS (SELECT * FROM c WHERE e > s)
SELECT g.job_id, g.seq, g.segment_id, 'keep' AS action, p.s AS trim_start_ms, p.e AS trim_end_ms FROM rep_seg g LEFT JOIN p USING (job_id, seq)"""


QUERIES = {
    "prj2_kept_windows": (
        lambda s, d: dec.kept_windows(fx.decisions(s, d), fx.segments(s, d)),
        fx.with_tables("decisions", "segments") + """
SELECT d.job_id, d.seq, d.segment_id, d.action, coalesce(d.trim_start_ms, s.start_ms) AS win_start_ms, coalesce(d.trim_end_ms, s.end_ms) AS win_end_ms
FROM decisions d JOIN segments s USING (job_id, segment_id) WHERE d.action <> 'remove'""",
    ),
    "prj3_sanitized_decisions": (
        lambda s, d: dec.sanitize_decisions(
            fx.decisions(s, d).withColumn("trim_end_ms", F.when(F.col("seq") % 11 == 3, "soon").otherwise(F.col("trim_end_ms").cast("string"))),
            fx.segments(s, d),
        ),
        fx.with_tables("decisions", "segments") + """,
r AS (SELECT d.*, try_cast(CASE WHEN d.seq % 11 = 3 THEN 'soon' ELSE CAST(trim_end_ms AS VARCHAR) END AS BIGINT) AS te, s.start_ms, s.end_ms
  FROM decisions d LEFT JOIN segments s USING (job_id, segment_id)),
c AS (SELECT *, CASE WHEN trim_start_ms IS NOT NULL THEN CASE WHEN start_ms IS NULL THEN trim_start_ms ELSE greatest(trim_start_ms, start_ms) END END AS lo,
  CASE WHEN te IS NOT NULL THEN CASE WHEN end_ms IS NULL THEN te ELSE least(te, end_ms) END END AS hi FROM r)
SELECT job_id, seq, segment_id, action, '' AS reason, CASE WHEN start_ms IS NOT NULL AND hi <= lo THEN NULL ELSE lo END AS trim_start_ms,
  CASE WHEN start_ms IS NOT NULL AND hi <= lo THEN NULL ELSE hi END AS trim_end_ms FROM c""",
    ),
    "prj4_repaired_windows": (
        lambda s, d: dec.repaired_windows(fx.decisions(s, d), fx.segments(s, d)).select("job_id", "seq", "segment_id", "win_start_ms", "win_end_ms"),
        fx.with_tables("decisions", "segments") + """,
w AS (SELECT d.job_id, d.seq, d.segment_id, s.start_ms, s.end_ms, greatest(coalesce(d.trim_start_ms, s.start_ms), s.start_ms) AS lo,
  least(coalesce(d.trim_end_ms, s.end_ms), s.end_ms) AS hi FROM decisions d JOIN segments s USING (job_id, segment_id) WHERE d.action <> 'remove')
SELECT job_id, seq, segment_id, CASE WHEN hi <= lo THEN start_ms ELSE lo END AS win_start_ms, CASE WHEN hi <= lo THEN end_ms ELSE hi END AS win_end_ms
FROM w WHERE CASE WHEN hi <= lo THEN end_ms > start_ms ELSE true END""",
    ),
    "jon13_words_in_window": (
        lambda s, d: silence.windowed(decided(s, d), spoken(s, d)).select(
            "job_id",
            "seq",
            F.size(silence.words_overlapping(F.col("seg_words"), F.col("win_start_ms"), F.col("win_end_ms"))).alias("overlapping"),
            F.size(silence.words_inside(F.col("seg_words"), F.col("win_start_ms"), F.col("win_end_ms"))).alias("inside"),
        ),
        fx.with_tables("win", "spoken_words") + """
SELECT d.job_id, d.seq, count(*) FILTER (w.end_ms > d.ws AND w.start_ms < d.we) AS overlapping,
  count(*) FILTER (w.start_ms >= d.ws AND w.end_ms <= d.we) AS inside
FROM win d LEFT JOIN spoken_words w ON w.job_id = d.job_id AND w.seg_seq = d.seg_seq GROUP BY d.job_id, d.seq""",
    ),
    "win2_speech_islands": (
        lambda s, d: silence.islands_in_windows(decided(s, d), spoken(s, d), 500),
        fx.with_tables("isl500", "win") + """
SELECT i.job_id, i.seq, d.segment_id, i.island, i.start_ms, i.end_ms, i.offset_ms, i.n_words FROM isl500 i JOIN win d USING (job_id, seq)""",
    ),
    "win3_silence_cuts": (
        lambda s, d: silence.silence_cuts(decided(s, d), spoken(s, d), 400),
        fx.with_tables("spoken_decisions", "win", "spoken_words") + """,
w AS (SELECT d.job_id, d.seq, d.ws, d.we, x.seq AS wseq, x.start_ms, x.end_ms FROM win d JOIN spoken_words x
    ON x.job_id = d.job_id AND x.seg_seq = d.seg_seq AND x.end_ms > d.ws AND x.start_ms < d.we),
g0 AS (SELECT *, lead(start_ms) OVER (PARTITION BY job_id, seq ORDER BY wseq) AS b FROM w),
g AS (SELECT job_id, seq, ws, we, end_ms AS a, b, row_number() OVER (PARTITION BY job_id, seq ORDER BY wseq) AS k FROM g0 WHERE b - end_ms >= 400),
p AS (SELECT job_id, seq, coalesce(lag(b) OVER (PARTITION BY job_id, seq ORDER BY k) - 50, ws) AS s, least(a + 50, b) AS e, k FROM g
  UNION ALL SELECT job_id, seq, max_by(b, k) - 50, any_value(we), max(k) + 1 FROM g GROUP BY job_id, seq),
cut AS (SELECT job_id, seq, row_number() OVER (PARTITION BY job_id, seq ORDER BY k) - 1 AS part, s, e FROM p WHERE e > s)
SELECT d.job_id, d.seq, coalesce(c.part, 0) AS part, d.segment_id, CASE WHEN c.part IS NULL THEN d.action ELSE 'keep' END AS action,
  CASE WHEN c.part IS NULL THEN d.trim_start_ms ELSE c.s END AS trim_start_ms, CASE WHEN c.part IS NULL THEN d.trim_end_ms ELSE c.e END AS trim_end_ms
FROM spoken_decisions d LEFT JOIN cut c USING (job_id, seq)""",
    ),
    "tl1_timeline_clips": (clips, fx.with_tables("clips") + "\nSELECT * FROM clips"),
    "win8_clip_transitions": (
        lambda s, d: timeline.build_clips(
            fx.decisions(s, d), fx.segments(s, d).withColumn("words", _no_words()), fx.media(s, d), 0, "mixed"
        ).select("job_id", "seq", "clip_id", "segment_id", "transition", "transition_frames"),
        fx.with_tables("decisions", "segments", "media") + """,
w AS (SELECT d.job_id, d.seq, d.segment_id, m.fps, row_number() OVER (PARTITION BY d.job_id ORDER BY d.seq) - 1 AS n
  FROM decisions d JOIN segments s USING (job_id, segment_id) JOIN media m ON m.job_id = d.job_id WHERE d.action <> 'remove')
SELECT job_id, n AS seq, printf('clip_%03d', n) AS clip_id, segment_id, CASE WHEN n % 2 = 1 THEN 'fade' ELSE 'cut' END AS transition,
  CAST(floor(fps * 0.5 + 0.5) AS BIGINT) AS transition_frames FROM w""",
    ),
    "win10_clip_positions": (
        lambda s, d: timeline.fade_lengths(clips(s, d)),
        fx.with_tables("clips") + """
SELECT job_id, seq, clip_id, out_start, out_start + duration_frames AS out_end, CASE WHEN transition = 'fade' THEN transition_frames ELSE 0 END AS fade_frames FROM clips""",
    ),
    "src11_cut_list": (
        lambda s, d: timeline.cut_list(clips(s, d))[0],
        fx.with_tables("clips") + """
SELECT job_id, seq AS ordinal, printf('%.4f', start_from / fps) AS start_s, printf('%.4f', duration_frames / fps) AS duration_s,
  printf('seg_%04d.mp4', seq) AS output_name FROM clips""",
    ),
    "src11_written_cut_list": (
        lambda s, d: written_cut_list(s, d)[0],
        fx.with_tables("clips") + """
SELECT job_id, seq AS ordinal, printf('%.4f', start_from / fps) AS start_s, printf('%.4f', duration_frames / fps) AS duration_s,
  printf('seg_%04d.mp4', seq) AS output_name FROM clips WHERE seq % 5 <> 0""",
    ),
    "src11_rejected_clips": (
        lambda s, d: written_cut_list(s, d)[1],
        fx.with_tables("clips") + """
SELECT job_id, seq AS ordinal, printf('%.4f', start_from / fps) AS start_s, '0.0000' AS duration_s, printf('seg_%04d.mp4', seq) AS output_name, 0 AS duration_frames FROM clips WHERE seq % 5 = 0""",
    ),
    "stf3_standard_captions": (
        lambda s, d: timeline.plan_captions(decided(s, d), spoken(s, d), fx.media(s, d), "standard", 500),
        fx.with_tables("iw", "chunk_steps", "isl500", "media") + _CAPTIONS.format(chunks=_STANDARD, style="standard", size=36),
    ),
    "win7_jumbo_captions": (
        lambda s, d: timeline.plan_captions(decided(s, d), spoken(s, d), fx.media(s, d), "jumbo", 500),
        fx.with_tables("iw", "isl500", "media") + _CAPTIONS.format(chunks=_JUMBO.replace(_IW, "SELECT * FROM iw"), style="jumbo", size=96),
    ),
    "win6_caption_offsets": (
        lambda s, d: timeline.caption_drift(decided(s, d), spoken(s, d), fx.media(s, d), 500),
        fx.with_tables("isl500", "media") + ", o AS (" + _off("isl500") + """), c AS (
  SELECT i.job_id, i.seq, sum(greatest(0, CAST(floor((i.end_ms - i.start_ms)::DOUBLE * m.fps::DOUBLE / 1000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT))) AS fr
  FROM isl500 i JOIN media m USING (job_id) GROUP BY i.job_id, i.seq),
r AS (SELECT o.job_id, o.seq, CAST(coalesce(sum(o.fr) OVER w, 0) AS BIGINT) AS caption_offset, CAST(coalesce(sum(c.fr) OVER w, 0) AS BIGINT) AS clip_offset
  FROM o JOIN c USING (job_id, seq) WINDOW w AS (PARTITION BY o.job_id ORDER BY o.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT *, caption_offset - clip_offset AS drift FROM r""",
    ),
    "win5_pacing_warnings": (
        lambda s, d: dec.pacing_warnings(fx.decisions(s, d), fx.segments(s, d)),
        fx.with_tables("decisions", "segments") + """,
k AS (SELECT d.job_id, d.seq, d.segment_id, s.energy, s.scene_type, s.energy < 0.3::DOUBLE AND s.end_ms - s.start_ms > 10000 AS low
  FROM decisions d JOIN segments s USING (job_id, segment_id) WHERE d.action <> 'remove'),
l AS (SELECT *, lag(low) OVER w AS pl, lag(segment_id) OVER w AS pid FROM k WINDOW w AS (PARTITION BY job_id ORDER BY seq)),
j AS (SELECT job_id, max_by(energy, seq) AS le, max(seq) AS seq, count(scene_type) AS n, count(DISTINCT scene_type) AS t, min(scene_type) AS t1 FROM k GROUP BY job_id)
SELECT job_id, 'nothing_kept' AS code, -1 AS seq, '' AS detail FROM decisions GROUP BY job_id HAVING count(*) FILTER (action <> 'remove') = 0
UNION ALL SELECT job_id, 'low_energy_stretch', seq, pid || ',' || segment_id FROM l WHERE low AND pl
UNION ALL SELECT job_id, 'low_energy_ending', seq, '' FROM j WHERE le < 0.3::DOUBLE
UNION ALL SELECT job_id, 'single_scene_type', -1, t1 FROM j WHERE n > 3 AND t = 1""",
    ),
    "win9_removed_spans": (
        lambda s, d: takes.remove_spans(decided(s, d), spoken(s, d), some_spans(s, d)),
        fx.with_tables("spoken_decisions", "some_spans", "win") + "," + _MERGED + """,
c AS (SELECT m.job_id, m.seq, coalesce(lag(m.end_ms) OVER (PARTITION BY m.job_id, m.seq ORDER BY m.start_ms), w.ws) AS s, m.start_ms AS e
    FROM merged m JOIN win w USING (job_id, seq)
  UNION ALL SELECT m.job_id, m.seq, max(m.end_ms), any_value(w.we) FROM merged m JOIN win w USING (job_id, seq) GROUP BY m.job_id, m.seq),
p AS (SELECT * FROM c WHERE e > s)
SELECT d.job_id, d.seq, d.segment_id, CASE WHEN p.s IS NULL THEN d.action ELSE 'keep' END AS action,
  CASE WHEN p.s IS NULL THEN d.trim_start_ms ELSE p.s END AS trim_start_ms, CASE WHEN p.s IS NULL THEN d.trim_end_ms ELSE p.e END AS trim_end_ms
FROM spoken_decisions d LEFT JOIN p USING (job_id, seq)""",
    ),
    "win9_merged_spans": (
        lambda s, d: intervals.merge_intervals(some_spans(s, d), ["job_id", "seq"]),
        fx.with_tables("some_spans") + "," + _MERGED + "\nSELECT * FROM merged",
    ),
    "jon17_repeat_candidates": (
        lambda s, d: takes.repeat_candidates(keep_all(s, d), repeated(s, d)),
        fx.with_tables("rep_pairs") + "\nSELECT job_id, seq, printf('seg_%03d', seq) AS segment_id, i, min(j) AS j FROM rep_pairs GROUP BY job_id, seq, i",
    ),
    "stf4_best_takes": (
        lambda s, d: takes.pick_takes(keep_all(s, d), repeated(s, d))[0],
        fx.with_tables("take_rows", "rep_seg") + _TAKE_CUTS,
    ),
    "agg17_take_scores": (
        lambda s, d: takes.score_takes(keep_all(s, d), repeated(s, d))
        .withColumn("audio_confidence", F.round("audio_confidence", 6))
        .withColumn("visual_score", F.round("visual_score", 6))
        .withColumn("combined_score", F.round("combined_score", 6)),
        fx.with_tables("take_rows")
        + "\nSELECT * REPLACE (round(audio_confidence, 6) AS audio_confidence, round(visual_score, 6) AS visual_score, round(combined_score, 6) AS combined_score) FROM take_rows",
    ),
    "jon12_visual_scores": (
        lambda s, d: takes.visual_scores(
            some_spans(s, d).select("job_id", "seq", F.col("start_ms").alias("take"), "start_ms", "end_ms"), spoken(s, d), ["job_id", "seq", "take"]
        ).select("job_id", "seq", "start_ms", "end_ms", F.round("visual_score", 6).alias("visual_score")),
        fx.with_tables("some_spans", "spoken_seg") + "\nSELECT t.job_id, t.seq, t.start_ms, t.end_ms, round(" + _VISUAL.format(seg="spoken_seg", t="t") + ", 6) AS visual_score FROM some_spans t",
    ),
}


def _no_words():
    return F.array().cast("array<struct<seq:bigint,text:string,start_ms:bigint,end_ms:bigint,confidence:double,speaker:string>>")
