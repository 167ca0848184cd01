"""The three end-to-end flows over tables of many jobs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.operators import corrections, enhance, enrich, gates, sampling, takes, timeline
from cliploom.operators import decisions as dec
from cliploom.operators import segments as seg
from cliploom.operators.silence import numbered_decisions
from cliploom.sources import responses
from cliploom.sources.scratch import materialize


@dataclass
class Understanding:
    segments: DataFrame
    energy_curve: DataFrame
    frames: DataFrame
    sampling: DataFrame
    motion: DataFrame
    representatives: DataFrame
    errors: DataFrame
    entities: DataFrame | None = None
    topics: DataFrame | None = None


def _answered(answers: DataFrame, kind: str) -> DataFrame:
    """Rows of one kind of answer (job_id, part, kind, content); ``ord`` is their part and place in it."""
    own = answers.filter(F.col("kind") == kind).select(F.struct("job_id", "part").alias("job_id"), "content")
    rows = responses.parse_responses(own, kind)
    return rows.withColumns({"job_id": F.col("job_id.job_id"), "ord": F.struct(F.col("job_id.part").alias("part"), "ord")})


def understand(
    words: DataFrame,
    scenes: DataFrame,
    frames: DataFrame,
    media: DataFrame,
    describe: Callable[[DataFrame], DataFrame] | None = None,
    answer: Callable[[DataFrame], DataFrame] | None = None,
    languages: DataFrame | None = None,
) -> Understanding:
    """Segments with energy and visual fields, thinned frames, and the checks on the result.

    ``describe`` turns the representative frames into scene descriptions; without it the visual
    fields stay empty.  ``answer`` turns segments into answers (job_id, part, kind, content) about 'entities', 'topics' and
    'segment_updates'.  ``languages``: job_id, language.  A job without an answer about entities or topics, or without an
    energy curve, gets the error that they are missing; an answer that names none is an empty list, which is no error.
    """
    built = materialize(seg.build_segments(words, scenes), "segments")
    curve = materialize(seg.energy_curve(built, media), "energy")
    segments = seg.attach_energy(built, curve)
    raw = materialize(sampling.dedup_frames(frames), "frames") if "is_duplicate" not in frames.columns else frames
    motion = sampling.motion_quality(raw)
    thinned = materialize(sampling.adaptive_sampling(raw, words), "sampled")
    reps = sampling.representative_frames(scenes, thinned)
    fields = {"visual_description": "string", "scene_type": "string", "visual_interest": "bigint", "text_on_screen": "string", "camera_motion": "string"}
    segments = segments.withColumns({c: F.lit(None).cast(t) for c, t in fields.items()} | {"is_blurry": F.lit(False)})
    if describe is not None:
        segments = enrich.attach_descriptions(segments, describe(reps))
    entities = topics = None
    told = {kind: segments.select("job_id").limit(0) for kind in ("entities", "topics")}
    if answer is not None:
        segments = materialize(segments, "described")
        answers = materialize(answer(segments), "answers")
        entities = materialize(enrich.entity_screen_time(_answered(answers, "entities"), segments), "entities")
        topics = materialize(enrich.topic_durations(_answered(answers, "topics"), segments), "topics")
        segments = enrich.apply_updates(segments, _answered(answers, "segment_updates"))
        told = {kind: answers.filter((F.col("kind") == kind) & F.col("content").isNotNull()).select("job_id") for kind in told}
    segments = materialize(segments, "understood")
    ends = segments.groupBy("job_id").agg(F.max_by("end_ms", "seq").alias("duration_ms"))
    documents = ends.join(media.select("job_id", "fps", "width", "height"), "job_id", "left").withColumn("version", F.lit("1.0"))
    for name, jobs in (("has_entities", told["entities"]), ("has_topics", told["topics"]), ("has_energy", curve.select("job_id"))):
        documents = documents.join(jobs.distinct().withColumn(name, F.lit(True)), "job_id", "left")
        documents = documents.withColumn(name, F.coalesce(name, F.lit(False)))
    if languages is not None:
        documents = documents.join(languages.select("job_id", "language"), "job_id", "left")
    else:
        documents = documents.withColumn("language", F.lit(None).cast("string"))
    documents = documents.withColumn("language", F.coalesce("language", F.lit("unknown")))
    errors = gates.validate_documents(documents, segments)
    return Understanding(segments, curve, thinned, sampling.sampling_counts(thinned), motion, reps, errors, entities, topics)


@dataclass
class Edit:
    low_confidence: DataFrame
    plans: DataFrame
    decisions: DataFrame
    take_log: DataFrame
    pacing: DataFrame
    captions: DataFrame
    clips: DataFrame
    errors: DataFrame


def edit(
    segments: DataFrame,
    media: DataFrame,
    plan_texts: DataFrame,
    caption_mode: str | None = None,
    threshold_ms: int = 0,
    targets: DataFrame | None = None,
    second_plans: DataFrame | None = None,
    pick_takes: bool = True,
    source: str = "source.mp4",
) -> Edit:
    """From plan answers (job_id, part, content) to clips and captions.

    A long plan may come in several parts.  Jobs with an answer that cannot be read keep all segments.  With ``targets`` (job_id, target_ms) and
    ``second_plans`` (decisions of a tighter pass) over-budget jobs may switch to the second plan.  Transitions and the caption
    mode are the plan's (its first part's); ``caption_mode`` overrides the latter for all jobs.
    """
    raw, plans = responses.ingest_plans(plan_texts, ["job_id", "part"])
    raw, plans = materialize(raw, "plan-rows"), materialize(plans, "plans")  # numbering reads its rows twice: they are parsed once
    ordered = numbered_decisions(raw.withColumnsRenamed({"part": "seq", "ord": "part"}))
    sane = dec.sanitize_decisions(ordered, segments)
    failed = plans.filter("status = 'failed'").select("job_id")
    first = materialize(dec.fallback_keep_all(sane, segments, failed).drop("reason"), "decisions")
    if targets is not None and second_plans is not None:
        checked = materialize(dec.budget_check(first, segments, targets), "budget")
        second = second_plans
        if "transition_before" not in second.columns:
            second = second.withColumn("transition_before", F.lit(None).cast("string"))
        first = materialize(dec.choose_plan(first, second.select(first.columns), segments, checked).drop("plan"), "decisions")
    if pick_takes:
        cut, log = takes.pick_takes(first, segments)
        parts = cut.withColumn("part", F.coalesce("trim_start_ms", F.lit(0)))
        final = materialize(numbered_decisions(parts), "decisions")
    else:
        final, log = first, takes.score_takes(first.limit(0), segments)
    pacing = dec.pacing_warnings(final, segments)
    # One row of settings per job: the first part of its plan that can be read.
    read = plans.filter("status <> 'failed'").join(failed, "job_id", "left_anti")
    settings = read.groupBy("job_id").agg(
        F.min_by("transition_default", "part").alias("transition_default"), F.min_by("caption_mode", "part").alias("caption_mode")
    )
    final = materialize(final.join(settings, "job_id", "left"), "set-decisions")
    clips = materialize(timeline.build_clips(final, segments, media, threshold_ms).withColumn("src", F.lit(source)), "clips")
    mode = F.coalesce(F.lit(caption_mode), "caption_mode", F.lit("none"))
    captions = materialize(timeline.plan_captions(final.filter(mode != "none"), segments, media, mode, threshold_ms), "captions")
    final = final.drop("transition_default", "caption_mode")
    errors = gates.validate_timelines(
        timeline.timelines(clips, media.join(segments.select("job_id").distinct(), "job_id", "left_semi")), clips, captions
    )
    return Edit(corrections.low_confidence_words(segments), plans, final, log, pacing, captions, clips, errors)


@dataclass
class Enhancement:
    classified: DataFrame
    specs: DataFrame
    clips: DataFrame
    totals: DataFrame
    manifest: DataFrame


def enhance_clips(
    clips: DataFrame,
    segments: DataFrame,
    render: Callable[[DataFrame], DataFrame],
    limit: int | None = None,
    first_entity: DataFrame | None = None,
) -> Enhancement:
    """Choose segments of the finished timeline, have ``render`` make inserts, put them in.

    ``render`` gets the specs and returns job_id, ord, scene_id, success, output_path, output_s,
    render_ms, fallback.
    """
    # Every clip counts as one kept decision, so a segment with several clips is asked about several times.
    kept = clips.select("job_id", "seq", "segment_id", F.lit("keep").alias("action"))
    marked = enhance.classify_enhancements(kept, segments)
    if limit is not None:
        marked = enhance.cap_enhancements(marked, limit)
    specs = materialize(enhance.enhancement_specs(marked, segments, first_entity), "specs")
    results = materialize(render(specs), "renders")
    out, totals = enhance.apply_inserts(clips, specs, results)
    return Enhancement(marked, specs, out, totals, enhance.enhancement_manifest(segments, specs, results))
