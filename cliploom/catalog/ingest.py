"""Queries that read tool output and model answers: the texts are built from the supplied tables first."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from cliploom import fixtures as fx
from cliploom.catalog import understand as un
from cliploom.operators import costs, digest, model_calls
from cliploom.sources import artifacts, files, images, responses, scratch, stages


def sec(c):
    return F.col(c) / F.lit(1000.0)


def transcript_payloads(s, d):
    word = F.struct(
        F.col("text"), sec("start_ms").alias("start"), sec("end_ms").alias("end"), "confidence", "speaker"
    )
    g = fx.words(s, d).groupBy("job_id", F.col("turn").alias("part")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", word.alias("w")))), lambda x: x["w"]).alias("words")
    )
    lang = F.when(F.col("job_id") % 3 == 0, "he").otherwise("en")
    rtl = F.when(F.col("job_id") % 2 == 0, F.col("job_id") % 3 == 0)
    return g.select("job_id", "part", F.to_json(F.struct(lang.alias("language"), rtl.alias("is_rtl"), "words")).alias("payload"))


def frame_payloads(s, d):
    n = F.col("frame_number")
    frame = F.struct(
        F.format_string("frame_%06d.jpg", n).alias("path"),
        F.when(n % 5 != 0, sec("ts_ms")).alias("timestamp"),
        n.alias("frame_number"),
        F.when(F.col("phash_hi").isNotNull(), F.concat(F.lpad(F.lower(F.hex("phash_hi")), 8, "0"), F.lpad(F.lower(F.hex("phash_lo")), 8, "0"))).alias("phash"),
        (n % 3 == 0).alias("is_duplicate"),
    )
    g = fx.frames(s, d).groupBy("job_id", F.floor(n / 50).alias("part")).agg(F.collect_list(frame).alias("frames"))
    return g.select("job_id", "part", F.to_json(F.struct("frames")).alias("payload"))


def scene_payloads(s, d):
    scene = F.struct(
        F.col("scene_id").alias("id"), sec("start_ms").alias("start_time"), sec("end_ms").alias("end_time"),
        (F.col("start_ms") * 3).alias("start_frame"), (F.col("end_ms") * 3).alias("end_frame"), ((F.col("end_ms") - F.col("start_ms")) / F.lit(1000.0)).alias("duration"),
    )
    g = fx.scenes(s, d).groupBy("job_id", F.floor(F.col("seq") / 5).alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", scene.alias("s")))), lambda x: x["s"]).alias("scenes"))
    body = F.when(F.col("job_id") % 5 == 3, F.lit('{"error":"detector crashed"}')).when(F.col("job_id") % 7 == 2, F.lit('{"scenes":[]}')).otherwise(F.to_json(F.struct("scenes")))
    return g.select("job_id", "part", body.alias("payload"))


def probe_payloads(s, d):
    j = F.col("job_id")
    rate = F.when(j % 4 == 0, "30000/1001").when(j % 4 == 1, "25").when(j % 4 == 2, "24/0").otherwise("")
    video = F.concat(
        F.lit('{"codec_type":"video","codec_name":"h264","width":'), F.col("width").cast("string"), F.lit(',"height":1080,"r_frame_rate":"'), rate,
        F.lit('","bit_rate":"'), (j * 100).cast("string"), F.lit('"}'),
    )
    second = F.lit('{"codec_type":"video","codec_name":"mjpeg","width":1}')
    audio = F.lit('{"codec_type":"audio","codec_name":"aac","channels":2,"sample_rate":"48000"}')
    streams = F.concat_ws(",", F.when(j % 2 == 1, audio), F.when(j % 7 != 5, video), F.when(j % 7 != 5, second))
    fmt = F.when(j % 3 == 1, F.concat(F.lit('{"duration":"9.5","bit_rate":"'), (j * 7).cast("string"), F.lit('"}'))).otherwise(F.lit("{}"))
    return fx.media(s, d).select("job_id", F.concat(F.lit('{"format":'), fmt, F.lit(',"streams":['), streams, F.lit("]}")).alias("payload"))


def loudness_logs(s, d):
    j = F.col("job_id")
    block = F.concat(
        F.lit('{\n\t"input_i" : "'), F.coalesce(F.col("input_i").cast("string"), F.lit("-inf")), F.lit('",\n\t"input_tp" : "-'),
        (j % 5).cast("string"), F.lit('.25",\n\t"input_lra" : "7.10",\n\t"input_thresh" : "-30.5",\n\t"target_offset" : "0.1"\n}'),
    )
    return fx.media(s, d).select(
        "job_id",
        F.when(j % 6 == 1, "frame= 1\nsize=N/A").otherwise(F.concat(F.lit("Input #0\n[Parsed_loudnorm_0 @ 0x1]\n"), block, F.lit("\n{trailer}"))).alias("log"),
    )


def manifests(s, d):
    j = F.col("job_id")
    body = F.concat(
        F.lit('{"id":"'), j.cast("string"), F.lit('","state":"'), "state", F.lit('","sourceFileName":"'), "source_file",
        F.lit('","createdAt":"'), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('"'), F.when(j % 11 == 3, "").otherwise("}"),
    )
    return fx.jobs(s, d).select(F.concat(F.lit("jobs/"), j.cast("string"), F.lit("/manifest.json")).alias("path"), body.alias("payload"))


def page_images(s, d):
    p = F.col("page_id")
    ext = F.when(p % 5 == 0, "PNG").when(p % 5 == 1, "webp").when(p % 5 == 2, "gif").when(p % 5 == 3, "jpg").otherwise("bin")
    data = F.encode("html", "UTF-8")
    return fx.table(s, d, "pages").select(F.concat(F.lit("img_"), p.cast("string"), F.lit("."), ext).alias("path"), F.octet_length("html").cast("long").alias("length"), data.alias("content"))


def plan_texts(s, d):
    """The plan answers; every second truncated one ends after a complete string, which can be repaired."""
    fixable = (F.col("job_id") % 10 == 7) & (F.col("seq") % 2 == 1)
    return fx.plan_responses(s, d).withColumn("content", F.when(fixable, F.concat("content", F.lit('rt"'))).otherwise(F.col("content")))


def scene_answers(s, d):
    q, sid = F.col("seq"), F.col("segment_id")
    one = F.concat(F.lit('{"sceneId":"'), sid, F.lit('","description":"d"'), F.when(q % 3 == 0, ',"visualInterest":5').otherwise(""), F.when(q % 4 == 0, ',"sceneType":"action"').otherwise(""), F.lit("}"))
    body = F.when(q % 5 == 0, "not json").when(q % 5 == 1, one).when(q % 5 == 2, F.concat(F.lit("Sure: ["), one, F.lit(","), one, F.lit("] done"))).otherwise(F.concat(F.lit("["), one, F.lit("]")))
    return fx.segments(s, d).select("job_id", F.array(sid, F.concat(sid, F.lit("b"))).alias("scene_ids"), body.alias("content"))


def entity_answers(s, d):
    q = F.col("seq")
    # Leading line ends, and mentions that are no positions: both must be borne.
    odd = F.when(q % 6 == 0, ',"x",1.5').otherwise("")
    arr = F.concat(F.when(q % 9 == 0, "\n\t").otherwise(""), F.lit('[{"id":"e'), q.cast("string"), F.lit('","name":"N","type":"person","mentions":['), q.cast("string"), odd, F.lit(","), (q + 1).cast("string"), F.lit("]}]"))
    return fx.segments(s, d).select("job_id", F.when(q % 3 == 0, arr).when(q % 3 == 1, F.concat(F.lit('{"entities":'), arr, F.lit("}"))).otherwise(F.concat(arr, F.lit(" oops"))).alias("content"))


def fusion_answers(s, d):
    q, sid = F.col("seq"), F.col("segment_id")
    good = F.concat(
        F.lit('{"summary":"S'), q.cast("string"), F.lit('","keyMoments":[{"segmentId":"'), sid, F.lit('","recommendedForHighlight":'), F.when(q % 2 == 0, "true").otherwise("false"),
        F.lit('},{"label":"L","reason":"R"}],"segmentUpdates":[{"id":"'), sid, F.lit('","textOnScreen":null}],"topics":[{"id":"t","label":"T","segments":["'), sid,
        F.lit('"]}],"sentiment":[{"time":1.5,"sentiment":-0.5,"label":"sad"}],"bRollOpportunities":[{"afterSegmentId":"'), sid, F.lit('","suggestedContent":"city","reason":"r"}],"pacingRecommendations":["a","b"]}'),
    )
    return fx.segments(s, d).select("job_id", "seq", F.when(q % 4 == 3, "broken {").otherwise(good).alias("content"))


def enhancement_answers(s, d):
    q, sid = F.col("seq"), F.col("segment_id")
    item = F.concat(F.when(q % 3 == 1, "\n ").otherwise(""), F.lit('[{"segmentId":"'), sid, F.lit('"'), F.when(q % 2 == 0, ',"level":"enhancement_required","confidence":0.9').otherwise(""), F.lit("}]"))
    return fx.segments(s, d).select("job_id", F.when(q % 5 == 4, F.concat(F.lit('{"items":'), item, F.lit("}"))).otherwise(item).alias("content"))


def progress(s, d):
    """What the progress observer has counted once its rows were used."""
    rows, seen = model_calls.with_progress(un.spoken_segments(s, d).select("job_id", "segment_id"), "understand", "segments")
    scratch.materialize(rows, "observed")
    return s.createDataFrame([(seen.get["rows"],)], "rows long")


def payload_files(s, payloads, name):
    """Payloads written as one folder per job and part."""
    root = f"{scratch.scratch_dir(s)}/{name}-{uuid.uuid4().hex}"
    files.write_files(payloads, root, ["job_id", "part"], "payload")
    return root


def _numbered(df):
    return df.withColumn("job_id", F.col("job_id").cast("long"))


def frames_from_files(s, d):
    """The frames' payloads written as files, and read back from there."""
    return _numbered(artifacts.read_frames(s, payload_files(s, frame_payloads(s, d), "payloads")))


RANGE_BYTES = 4096  # far below a file, so that most ranges begin in the middle of an item


def scanned_transcripts(s, d):
    return artifacts.scan_transcripts(s, payload_files(s, transcript_payloads(s, d), "transcripts"), RANGE_BYTES)


def scanned_frames(s, d):
    return _numbered(artifacts.scan_frames(s, payload_files(s, frame_payloads(s, d), "frames"), split_bytes=RANGE_BYTES))


def scanned_scenes(s, d):
    """The scenes' payloads in files; jobs are named by texts there."""
    named = lambda df: df.withColumn("job_id", F.col("job_id").cast("string"))
    root = payload_files(s, scene_payloads(s, d), "scenes")
    return _numbered(artifacts.scan_scenes(s, root, named(fx.frames(s, d)), named(fx.media(s, d)), RANGE_BYTES))


def images_from_files(s, d):
    """The pages written as files, and listed as images from there."""
    root = f"{scratch.scratch_dir(s)}/images-{uuid.uuid4().hex}"
    files.write_files(fx.table(s, d, "pages"), root, ["page_id"], "html")
    fits, oversize = images.image_catalog(s, root, 1500)
    both = fits.select("path", "media_type", "length", F.lit(True).alias("fits")).unionByName(oversize.withColumn("fits", F.lit(False)))
    return both.select(F.regexp_extract("path", "/page_id=([0-9]+)/", 1).cast("long").alias("page_id"), "media_type", "length", "fits")


def stage_round_trip(s, d):
    """Store all decisions, store those of every third job again, read the latest state."""
    root = f"{scratch.scratch_dir(s)}/stages-{hashlib.md5(d.encode()).hexdigest()}-{s.sparkContext.applicationId}"
    dec = fx.decisions(s, d)
    stages.write_stage(dec, root, "edit", "decisions", version=1)
    stages.write_stage(dec.filter("job_id % 3 = 0").withColumn("action", F.lit("keep")), root, "edit", "decisions", version=2)
    return stages.read_stage(s, root, "edit", dec.schema, "decisions")


def stage_compacted(s, d):
    """Ten writes, each of the decisions of fewer jobs, then one folder, read again."""
    root = f"{scratch.scratch_dir(s)}/compacted-{uuid.uuid4().hex}"
    decisions = scratch.materialize(fx.decisions(s, d), "decisions")
    for i in range(10):
        stages.write_stage(decisions.filter(F.col("job_id") % 10 >= i).withColumn("action", F.lit(f"write {i}")), root, "edit", "decisions")
    stages.compact_stage(s, root, "edit", decisions.schema, "decisions", keep_ms=0)
    return stages.read_stage(s, root, "edit", decisions.schema, "decisions")


def stub_model(texts):
    """Stands in for a model: the digest of the text, and lengths as token counts."""
    return [(hashlib.md5(t.encode()).hexdigest(), len(t), 32) for t in texts]


def answers(s, d):
    pages = digest.digest_documents(digest.digest_lines(fx.segments(s, d), "topics"), 20)
    return model_calls.call_model(pages, ["job_id", "page"], "document", stub_model, "anthropic", "claude-haiku-4-5-20251001", "understand")


def ledger_answers(s, d):
    """A run over every third page, then one over all by a model that answers otherwise: what is in the ledger stays."""
    pages = scratch.materialize(digest.digest_documents(digest.digest_lines(fx.segments(s, d), "topics"), 20), "pages")
    ledger = f"{scratch.scratch_dir(s)}/ledger-{uuid.uuid4().hex}"

    def ask(df, run):
        model = lambda texts: [(f"{run} {a}", n, m) for a, n, m in stub_model(texts)]
        return model_calls.ask_once(df, ["job_id", "page"], "document", model, ledger, "anthropic", "claude-haiku-4-5-20251001")

    ask(pages.filter("page % 3 = 0"), "first")
    return ask(pages, "second")


_TOPIC_LINE = "'[' || seq || '] (' || " + "printf('%d.%d', (start_ms + 50) // 1000, (start_ms + 50) % 1000 // 100) || 's-' || printf('%d.%d', (end_ms + 50) // 1000, (end_ms + 50) % 1000 // 100) || 's) ' || substr(transcript, 1, 200)"
_ANSWERS = fx.with_tables("segments") + f""", l AS (SELECT job_id, seq // 20 AS page, string_agg({_TOPIC_LINE}, chr(10) ORDER BY seq) AS doc FROM segments GROUP BY ALL),
a AS (SELECT job_id, page, md5(doc) AS content, CAST(length(doc) AS BIGINT) AS input_tokens, CAST(32 AS BIGINT) AS output_tokens, 'anthropic' AS provider, 'claude-haiku-4-5-20251001' AS model, 'understand' AS stage,
  length(doc) / 1000.0::DOUBLE * 0.0008::DOUBLE + 32 / 1000.0::DOUBLE * 0.004::DOUBLE AS cost_usd FROM l)"""

QUERIES = {
    "src1_transcripts": (
        lambda s, d: artifacts.parse_transcripts(transcript_payloads(s, d))[0],
        fx.with_tables("words") + "\nSELECT job_id, seq, text, speaker, start_ms, end_ms, confidence FROM words",
    ),
    "src1_scanned_words": (
        lambda s, d: _numbered(scanned_transcripts(s, d)[0]),
        fx.with_tables("words") + "\nSELECT job_id, seq, text, speaker, start_ms, end_ms, confidence FROM words",
    ),
    "src1_transcript_heads": (
        lambda s, d: artifacts.parse_transcripts(transcript_payloads(s, d))[1],
        fx.with_tables("words") + """
SELECT DISTINCT job_id, CASE WHEN job_id % 3 = 0 THEN 'he' ELSE 'en' END AS language, job_id % 3 = 0 AS is_rtl FROM words""",
    ),
    "src1_scanned_heads": (
        lambda s, d: _numbered(scanned_transcripts(s, d)[1]),
        fx.with_tables("words") + """
SELECT DISTINCT job_id, CASE WHEN job_id % 3 = 0 THEN 'he' ELSE 'en' END AS language, job_id % 3 = 0 AS is_rtl FROM words""",
    ),
    "src2_frames": (
        lambda s, d: artifacts.parse_frames(frame_payloads(s, d)),
        fx.with_tables("frames") + "\nSELECT *, printf('frame_%06d.jpg', frame_number) AS path, frame_number % 3 = 0 AS is_duplicate FROM frames",
    ),
    "src2_frame_files": (
        frames_from_files,
        fx.with_tables("frames") + "\nSELECT *, printf('frame_%06d.jpg', frame_number) AS path, frame_number % 3 = 0 AS is_duplicate FROM frames",
    ),
    "src2_scanned_frames": (
        scanned_frames,
        fx.with_tables("frames") + "\nSELECT *, printf('frame_%06d.jpg', frame_number) AS path, frame_number % 3 = 0 AS is_duplicate FROM frames",
    ),
    "src3_scenes": (
        lambda s, d: artifacts.parse_scenes(scene_payloads(s, d), fx.frames(s, d), fx.media(s, d)),
        fx.with_tables("scenes", "frames", "media") + """
SELECT job_id, seq, scene_id, start_ms, end_ms, start_ms * 3 AS start_frame, end_ms * 3 AS end_frame FROM scenes WHERE job_id % 5 <> 3 AND job_id % 7 <> 2
UNION ALL SELECT j.job_id, 0, 'scene_000', 0, coalesce(t, 0), 0, CAST(floor(coalesce(t, 0)::DOUBLE * fps::DOUBLE / 1000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)
FROM (SELECT DISTINCT job_id FROM scenes WHERE job_id % 5 = 3) j LEFT JOIN (SELECT job_id, max(ts_ms) AS t FROM frames GROUP BY job_id) f USING (job_id) LEFT JOIN media USING (job_id)""",
    ),
    "src3_scanned_scenes": (
        scanned_scenes,
        fx.with_tables("scenes", "frames", "media") + """
SELECT job_id, seq, scene_id, start_ms, end_ms, start_ms * 3 AS start_frame, end_ms * 3 AS end_frame FROM scenes WHERE job_id % 5 <> 3 AND job_id % 7 <> 2
UNION ALL SELECT j.job_id, 0, 'scene_000', 0, coalesce(t, 0), 0, CAST(floor(coalesce(t, 0)::DOUBLE * fps::DOUBLE / 1000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)
FROM (SELECT DISTINCT job_id FROM scenes WHERE job_id % 5 = 3) j LEFT JOIN (SELECT job_id, max(ts_ms) AS t FROM frames GROUP BY job_id) f USING (job_id) LEFT JOIN media USING (job_id)""",
    ),
    "src4_media": (
        lambda s, d: artifacts.normalize_probe(probe_payloads(s, d))[0].withColumn("fps", F.round("fps", 6)),
        fx.with_tables("media") + """
SELECT job_id, width, 1080 AS height, round(CASE job_id % 4 WHEN 0 THEN 30000 / 1001.0::DOUBLE WHEN 1 THEN 25 WHEN 2 THEN 24 ELSE 0 END, 6) AS fps, 'h264' AS codec,
  CASE WHEN job_id % 3 = 1 THEN job_id * 7 ELSE job_id * 100 END AS bitrate, job_id % 2 = 1 AS has_audio, CASE WHEN job_id % 2 = 1 THEN 'aac' END AS audio_codec,
  CASE WHEN job_id % 2 = 1 THEN 2 END AS audio_channels, CASE WHEN job_id % 2 = 1 THEN 48000 END AS audio_sample_rate FROM media WHERE job_id % 7 <> 5""",
    ),
    "src4_rejected_probes": (
        lambda s, d: artifacts.normalize_probe(probe_payloads(s, d))[1].select("job_id"),
        fx.with_tables("media") + "\nSELECT job_id FROM media WHERE job_id % 7 = 5",
    ),
    "src5_loudness": (
        lambda s, d: artifacts.parse_loudness(loudness_logs(s, d))[0],
        fx.with_tables("media") + """
SELECT job_id, input_i, -(job_id % 5 + 0.25::DOUBLE) AS input_tp, 7.1::DOUBLE AS input_lra, -30.5::DOUBLE AS input_thresh FROM media WHERE job_id % 6 <> 1""",
    ),
    "src5_failed_logs": (
        lambda s, d: artifacts.parse_loudness(loudness_logs(s, d))[1],
        fx.with_tables("media") + "\nSELECT job_id FROM media WHERE job_id % 6 = 1",
    ),
    "src6_stage_round_trip": (
        stage_round_trip,
        fx.with_tables("decisions") + "\nSELECT * REPLACE (CASE WHEN job_id % 3 = 0 THEN 'keep' ELSE action END AS action) FROM decisions",
    ),
    "src6_compacted_stage": (
        stage_compacted,
        fx.with_tables("decisions") + "\nSELECT * REPLACE ('write ' || CAST(job_id % 10 AS VARCHAR) AS action) FROM decisions",
    ),
    "src7_job_listing": (
        lambda s, d: stages.parse_job_manifests(manifests(s, d))[0].select("job_id", "state", "source_file", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at")),
        fx.with_tables("jobs") + "\nSELECT CAST(job_id AS VARCHAR) AS job_id, state, source_file, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM jobs WHERE job_id % 11 <> 3",
    ),
    "src7_corrupt_manifests": (
        lambda s, d: stages.parse_job_manifests(manifests(s, d))[1],
        fx.with_tables("jobs") + "\nSELECT 'jobs/' || job_id || '/manifest.json' AS path FROM jobs WHERE job_id % 11 = 3",
    ),
    "src10_image_files": (
        images_from_files,
        "SELECT page_id, 'image/jpeg' AS media_type, octet_length(encode(html)) + 1 AS length, octet_length(encode(html)) + 1 <= 1500 AS fits FROM pages",
    ),
    "src10_images": (
        lambda s, d: images.image_rows(page_images(s, d), 1500)[0].withColumn("data", F.md5("data")),
        """WITH p AS (SELECT page_id, encode(html) AS b FROM pages)
SELECT 'img_' || page_id || '.' || ['PNG', 'webp', 'gif', 'jpg', 'bin'][CAST(page_id % 5 + 1 AS INT)] AS path, ['image/png', 'image/webp', 'image/gif', 'image/jpeg', 'image/jpeg'][CAST(page_id % 5 + 1 AS INT)] AS media_type,
  octet_length(b) AS length, md5(to_base64(b)) AS data FROM p WHERE octet_length(b) <= 1500""",
    ),
    "src10_oversize_images": (
        lambda s, d: images.image_rows(page_images(s, d), 1500)[1],
        """WITH p AS (SELECT page_id, encode(html) AS b FROM pages)
SELECT 'img_' || page_id || '.' || ['PNG', 'webp', 'gif', 'jpg', 'bin'][CAST(page_id % 5 + 1 AS INT)] AS path, ['image/png', 'image/webp', 'image/gif', 'image/jpeg', 'image/jpeg'][CAST(page_id % 5 + 1 AS INT)] AS media_type,
  octet_length(b) AS length FROM p WHERE octet_length(b) > 1500""",
    ),
    "dec1_plan_decisions": (
        lambda s, d: responses.ingest_plans(plan_texts(s, d), ["job_id", "seq"])[0],
        fx.with_tables("decisions") + """
SELECT job_id, seq, 0 AS ord, segment_id, action, CASE WHEN job_id % 10 = 7 THEN 'cut short' ELSE 'r' END AS reason, CAST(NULL AS BIGINT) AS trim_start_ms, CAST(NULL AS BIGINT) AS trim_end_ms, CAST(NULL AS VARCHAR) AS transition_before
FROM decisions WHERE job_id % 10 <> 9 AND (job_id % 10 <> 7 OR seq % 2 = 1)""",
    ),
    "dec1_plan_status": (
        lambda s, d: responses.ingest_plans(plan_texts(s, d), ["job_id", "seq"])[1],
        fx.with_tables("decisions") + """, p AS (SELECT job_id, seq, CASE WHEN job_id % 10 = 9 OR (job_id % 10 = 7 AND seq % 2 = 0) THEN 'failed' WHEN job_id % 10 = 7 THEN 'repaired' ELSE 'good' END AS status FROM decisions)
SELECT *, CASE WHEN status = 'good' THEN 'standard' ELSE 'none' END AS caption_mode, 'cut' AS transition_default, CASE WHEN status = 'failed' THEN 0 ELSE 1 END AS n_decisions FROM p""",
    ),
    "src12_scene_answers": (
        lambda s, d: responses.parse_responses(scene_answers(s, d), "scenes"),
        fx.with_tables("segments") + """
SELECT job_id, k AS ord, segment_id AS scene_id, 'd' AS visual_description, CASE WHEN seq % 4 = 0 THEN 'action' ELSE 'other' END AS scene_type, CASE WHEN seq % 3 = 0 THEN 5.0::DOUBLE ELSE 3.0::DOUBLE END AS visual_interest,
  CAST(NULL AS VARCHAR) AS text_on_screen, CAST(NULL AS VARCHAR) AS camera_motion FROM (SELECT *, unnest(CASE WHEN seq % 5 = 2 THEN [0, 1] ELSE [0] END) AS k FROM segments WHERE seq % 5 <> 0)
UNION ALL SELECT job_id, k, segment_id || CASE WHEN k = 1 THEN 'b' ELSE '' END, 'Analysis failed', 'other', 2.0::DOUBLE, NULL, NULL FROM (SELECT *, unnest([0, 1]) AS k FROM segments WHERE seq % 5 = 0)""",
    ),
    "src12_entity_answers": (
        lambda s, d: responses.parse_responses(entity_answers(s, d), "entities").withColumn("mentions", F.array_join("mentions", ",")),
        fx.with_tables("segments") + """
SELECT job_id, 0 AS ord, 'e' || seq AS entity_id, 'N' AS name, 'person' AS type, CAST(NULL AS VARCHAR) AS role, seq || ',' || (seq + 1) AS mentions FROM segments WHERE seq % 3 <> 2""",
    ),
    "src12_key_moments": (
        lambda s, d: responses.parse_responses(fusion_answers(s, d), "key_moments"),
        fx.with_tables("segments") + """
SELECT job_id, 0 AS ord, segment_id, '' AS label, '' AS reason, seq % 2 = 0 AS highlight FROM segments WHERE seq % 4 <> 3
UNION ALL SELECT job_id, 1, '', 'L', 'R', false FROM segments WHERE seq % 4 <> 3""",
    ),
    "src12_segment_updates": (
        lambda s, d: responses.parse_responses(fusion_answers(s, d), "segment_updates"),
        fx.with_tables("segments") + """
SELECT job_id, 0 AS ord, '{"id":"' || segment_id || '","textOnScreen":null}' AS update FROM segments WHERE seq % 4 <> 3""",
    ),
    "src12_topic_answers": (
        lambda s, d: responses.parse_responses(fusion_answers(s, d), "topics").withColumn("segments", F.array_join("segments", ",")),
        fx.with_tables("segments") + "\nSELECT job_id, 0 AS ord, 't' AS topic_id, 'T' AS label, segment_id AS segments FROM segments WHERE seq % 4 <> 3",
    ),
    "src12_sentiment": (
        lambda s, d: responses.parse_responses(fusion_answers(s, d), "sentiment"),
        fx.with_tables("segments") + "\nSELECT job_id, 0 AS ord, 1.5::DOUBLE AS time, -0.5::DOUBLE AS sentiment, 'sad' AS label FROM segments WHERE seq % 4 <> 3",
    ),
    "src12_broll": (
        lambda s, d: responses.parse_responses(fusion_answers(s, d), "broll"),
        fx.with_tables("segments") + """\nSELECT job_id, 0 AS ord, segment_id AS "afterSegmentId", 'city' AS "suggestedContent", 'r' AS reason FROM segments WHERE seq % 4 <> 3""",
    ),
    "src12_pacing": (
        lambda s, d: responses.parse_responses(fusion_answers(s, d), "pacing"),
        fx.with_tables("segments") + "\nSELECT job_id, k AS ord, ['a', 'b'][CAST(k + 1 AS INT)] AS recommendation FROM (SELECT *, unnest([0, 1]) AS k FROM segments WHERE seq % 4 <> 3)",
    ),
    "src12_summaries": (
        lambda s, d: responses.parse_summaries(fusion_answers(s, d)),
        fx.with_tables("segments") + "\nSELECT job_id, CASE WHEN seq % 4 = 3 THEN 'Video analysis complete.' ELSE 'S' || seq END AS summary FROM segments",
    ),
    "src12_enhancement_answers": (
        lambda s, d: responses.parse_responses(enhancement_answers(s, d), "enhancements"),
        fx.with_tables("segments") + """
SELECT job_id, 0 AS ord, segment_id, CASE WHEN seq % 2 = 0 THEN 'enhancement_required' ELSE 'standard' END AS level, 'not_needed' AS reason, CAST(NULL AS VARCHAR) AS enhancement_type,
  CASE WHEN seq % 2 = 0 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM segments WHERE seq % 5 <> 4""",
    ),
    "udf1_model_answers": (
        lambda s, d: answers(s, d).withColumn("cost_usd", F.round("cost_usd", 9)),
        _ANSWERS + "\nSELECT * REPLACE (round(cost_usd, 9) AS cost_usd) FROM a",
    ),
    "udf1_ledger_answers": (
        ledger_answers,
        _ANSWERS
        + """
SELECT job_id, page, concat(CASE WHEN bool_or(page % 3 = 0) OVER (PARTITION BY doc) THEN 'first ' ELSE 'second ' END, md5(doc)) AS content,
  CAST(length(doc) AS BIGINT) AS input_tokens, CAST(32 AS BIGINT) AS output_tokens, CAST(NULL AS VARCHAR) AS error FROM l""",
    ),
    "udf2_usage_by_stage": (
        lambda s, d: answers(s, d).groupBy("stage", "provider", "model").agg(
            F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd")
        ),
        _ANSWERS + "\nSELECT stage, provider, model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, round(sum(cost_usd), 6) AS cost_usd FROM a GROUP BY ALL",
    ),
    "udf3_observed_segments": (
        lambda s, d: model_calls.with_progress(un.spoken_segments(s, d).select("job_id", "segment_id"), "understand", "segments")[0],
        fx.with_tables("spoken") + "\nSELECT job_id, printf('seg_%03d', seq) AS segment_id FROM spoken",
    ),
    "udf3_progress": (lambda s, d: progress(s, d), fx.with_tables("spoken") + "\nSELECT count(*) AS rows FROM spoken"),
    "set2_jobs_without_report": (
        lambda s, d: stages.missing_jobs(fx.jobs(s, d), costs.price_calls(fx.llm_calls(s, d))),
        fx.with_tables("jobs", "llm_calls") + "\nSELECT job_id FROM jobs WHERE job_id NOT IN (SELECT job_id FROM llm_calls)",
    ),
}
