"""Stage gates and validators: one issue row per finding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.functions.text import blank, present
from cliploom.operators.blocks import running, seq_block

ISSUE = ["job_id", "code", "severity", "seq"]


def _issue(df: DataFrame, code: str, severity: str, seq: str | None = None) -> DataFrame:
    return df.select(
        "job_id",
        F.lit(code).alias("code"),
        F.lit(severity).alias("severity"),
        (F.col(seq) if seq else F.lit(-1)).cast("long").alias("seq"),
    )


def segment_overlaps(segments: DataFrame, slack_ms: int = 0) -> DataFrame:
    """Segments that start more than ``slack_ms`` before the previous one ends."""
    s = segments.select("job_id", "seq", "segment_id", "start_ms", "end_ms")
    p = running(s, ["job_id"], ["seq"], seq_block("seq"), prev={"prev_end_ms": F.col("end_ms"), "prev_id": F.col("segment_id")})
    return p.filter(F.col("start_ms") < F.col("prev_end_ms") - F.lit(slack_ms)).select(
        "job_id", "seq", "segment_id", "prev_id", "start_ms", "prev_end_ms"
    )


def understanding_gate(
    documents: DataFrame, segments: DataFrame, entity_counts: DataFrame, coverage: float = 0.98
) -> DataFrame:
    """Issues of understanding documents (job_id, duration_ms, fps, width, height).

    ``entity_counts``: job_id, n_entities.  Coverage counts segments with speech or marked silent.
    """
    dur = F.col("end_ms") - F.col("start_ms")
    spoken = ~blank(F.col("transcript")) | F.col("is_silent")
    per = segments.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.when(spoken, dur).otherwise(0)).alias("_c"), F.sum(dur).alias("_s")
    )
    d = documents.join(per, "job_id", "left").join(entity_counts, "job_id", "left").fillna(0, ["_n", "_c", "_s", "n_entities"])
    has = F.col("duration_ms") > 0
    share = F.when(has, F.col("_c") / F.col("duration_ms")).otherwise(F.lit(0.0))
    missing = lambda c: F.coalesce(F.col(c) == 0, F.lit(True))
    found = F.filter(
        F.array(
            F.when(F.col("_n") == 0, F.struct(F.lit("no_segments").alias("c"), F.lit("error").alias("s"))),
            F.when(share < coverage, F.struct(F.lit("low_transcript_coverage").alias("c"), F.lit("warning").alias("s"))),
            F.when(
                has & (F.col("_s") / F.col("duration_ms") < 0.9),
                F.struct(F.lit("low_scene_coverage").alias("c"), F.lit("warning").alias("s")),
            ),
            F.when(
                missing("fps") | missing("width") | missing("height"),
                F.struct(F.lit("missing_metadata").alias("c"), F.lit("error").alias("s")),
            ),
            F.when(
                (F.col("_n") > 5) & (F.col("n_entities") == 0),
                F.struct(F.lit("no_entities").alias("c"), F.lit("warning").alias("s")),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    flat = d.select("job_id", F.explode(found).alias("x")).select(
        "job_id", F.col("x.c").alias("code"), F.col("x.s").alias("severity"), F.lit(-1).cast("long").alias("seq")
    )
    return flat.unionByName(_issue(segment_overlaps(segments), "overlapping_segments", "error", "seq"))


def edit_gate(timelines: DataFrame, clips: DataFrame, captions: DataFrame, targets: DataFrame, tolerance_pct: float = 5) -> DataFrame:
    """Issues of timelines (job_id, fps, duration_frames) with optional targets (job_id, target_s)."""
    per = clips.groupBy("job_id").agg(F.count(F.lit(1)).alias("_n"), F.sum("duration_frames").alias("_f"))
    d = timelines.select("job_id", "fps", "duration_frames").join(per, "job_id", "left").join(targets, "job_id", "left").fillna(0, ["_n", "_f"])
    none = _issue(d.filter("_n = 0"), "no_clips", "error")
    zero = _issue(d.filter("_f <= 0"), "zero_duration", "error")
    off = F.abs(F.col("duration_frames") / F.col("fps") - F.col("target_s"))
    wrong = _issue(
        d.filter((F.col("target_s") > 0) & (off > F.col("target_s") * F.lit(tolerance_pct) / 100)), "duration_mismatch", "warning"
    )
    first_bad = captions.filter("end_frame <= start_frame").groupBy("job_id").agg(F.min("seq").alias("seq"))
    return none.unionByName(zero).unionByName(wrong).unionByName(_issue(first_bad, "invalid_caption", "error", "seq"))


def gate_result(jobs: DataFrame, issues: DataFrame) -> DataFrame:
    """passed = no error among the issues of a job."""
    per = issues.groupBy("job_id").agg(
        F.count_if(F.col("severity") == "error").alias("_e"), F.count_if(F.col("severity") == "warning").alias("_w")
    )
    return jobs.select("job_id").distinct().join(per, "job_id", "left").select(
        "job_id",
        F.coalesce("_e", F.lit(0)).alias("errors"),
        F.coalesce("_w", F.lit(0)).alias("warnings"),
        (F.coalesce("_e", F.lit(0)) == 0).alias("passed"),
    )


def _errors(df: DataFrame, checks: list, seq: str | None) -> DataFrame:
    arr = F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(code)) for code, cond in checks]), lambda x: x.isNotNull())
    pos = (F.col(seq) if seq else F.lit(-1)).cast("long")
    return df.select("job_id", pos.alias("seq"), F.explode(arr).alias("code"))


def validate_documents(documents: DataFrame, segments: DataFrame, slack_ms: int = 10) -> DataFrame:
    """Error rows (job_id, seq, code) of documents.

    ``documents``: job_id, version, language, duration_ms, fps, width, height, has_entities,
    has_topics, has_energy.
    """
    bad = lambda c: F.col(c).isNull() | (F.col(c) <= 0)
    head = _errors(
        documents,
        [
            ("invalid_version", F.col("version").isNull() | (F.col("version") != "1.0")),
            ("missing_job_id", ~present(F.col("job_id").cast("string"))),
            ("missing_language", ~present(F.col("language"))),
            ("invalid_duration", F.col("duration_ms") <= 0),
            ("invalid_fps", bad("fps")),
            ("invalid_width", bad("width")),
            ("invalid_height", bad("height")),
            ("missing_entities", ~F.col("has_entities")),
            ("missing_topics", ~F.col("has_topics")),
            ("missing_energy_curve", ~F.col("has_energy")),
        ],
        None,
    )
    empty = documents.select("job_id").join(segments.select("job_id").distinct(), "job_id", "left_anti")
    rows = _errors(
        segments,
        [
            ("missing_segment_id", ~present(F.col("segment_id"))),
            ("negative_start", F.col("start_ms") < 0),
            ("end_not_after_start", F.col("end_ms") <= F.col("start_ms")),
            ("non_positive_duration", F.col("end_ms") - F.col("start_ms") <= 0),
        ],
        "seq",
    )
    lap = segment_overlaps(segments, slack_ms).select("job_id", "seq", F.lit("overlap").alias("code"))
    none = empty.select("job_id", F.lit(-1).cast("long").alias("seq"), F.lit("no_segments").alias("code"))
    return head.unionByName(none).unionByName(rows).unionByName(lap)


def validate_timelines(timelines: DataFrame, clips: DataFrame, captions: DataFrame) -> DataFrame:
    """Error rows (job_id, part, seq, code) of timelines, their clips and captions."""
    head = _errors(
        timelines,
        [
            ("no_clips", F.col("n_clips") == 0),
            ("invalid_fps", (F.col("fps") <= 0) | (F.col("fps") > 120)),
            ("invalid_duration", F.col("duration_frames") <= 0),
            ("invalid_dimensions", (F.col("width") <= 0) | (F.col("height") <= 0)),
        ],
        None,
    )
    parts = _errors(
        clips,
        [
            ("non_positive_duration", F.col("duration_frames") <= 0),
            ("negative_start", F.col("start_from") < 0),
            ("missing_src", ~present(F.col("src"))),
        ],
        "seq",
    )
    caps = _errors(captions, [("end_not_after_start", F.col("end_frame") <= F.col("start_frame"))], "seq")
    tag = lambda df, t: df.withColumn("part", F.lit(t))
    return tag(head, "timeline").unionByName(tag(parts, "clip")).unionByName(tag(caps, "caption"))
