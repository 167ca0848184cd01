"""Which segments get motion graphics, what to render, and putting the results back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.functions.text import js_round, numbered, present
from cliploom.operators.blocks import running, seq_block
from cliploom.operators.silence import with_segment

# Words that call for a chart, and phrases of someone explaining.
CHART_WORDS = r"\b(diagram|chart|graph|infographic|flowchart|table)\b"
TEACHING_WORDS = r"\b(let me explain|here's how|the key is|importantly|notice that|pay attention)\b"


def classify_enhancements(
    decisions: DataFrame, segments: DataFrame, forced: Sequence[str] = (), force_standard: bool = False
) -> DataFrame:
    """Level, reason, type and confidence for every kept decision; the first rule that matches counts."""
    kept = with_segment(decisions.filter("action <> 'remove'"), segments)

    def mark(level, reason, kind, conf):
        return F.struct(
            F.lit(level).alias("level"),
            F.lit(reason).alias("reason"),
            F.lit(kind).cast("string").alias("enhancement_type"),
            F.lit(conf).alias("confidence"),
        )

    plain = mark("standard", "not_needed", None, 1.0)
    if force_standard:
        rule = plain
    else:
        c = F.col
        rule = F.when(c("seg_seq").isNull(), plain)
        if forced:
            rule = rule.when(c("segment_id").isin(*forced), mark("enhancement_required", "user_requested", "custom", 1.0))
        rule = (
            rule.when(
                (c("seg_scene_type") == "screenrec") & present(c("seg_text_on_screen")),
                mark("enhancement_candidate", "precision_zoom", "educational_zoom_callout", 0.8),
            )
            .when(
                F.lower(F.coalesce("seg_visual_description", F.lit(""))).rlike(CHART_WORDS),
                mark("enhancement_candidate", "chart_animation", "chart_animation", 0.7),
            )
            .when(
                (c("seg_scene_type") == "action") & (c("seg_visual_interest") >= 4),
                mark("enhancement_candidate", "premium_treatment", "feature_spotlight", 0.6),
            )
            .when(
                F.lower("seg_transcript").rlike(TEACHING_WORDS),
                mark("enhancement_candidate", "educational_emphasis", "animated_annotation", 0.5),
            )
            .otherwise(plain)
        )
    return kept.withColumn("_r", rule).select("job_id", "seq", "segment_id", "_r.*")


def cap_enhancements(classified: DataFrame, limit: int) -> DataFrame:
    """Keep at most ``limit`` enhanced decisions per job, by confidence, earlier ones first on ties.

    The rank of a decision is found inside its confidence class plus the size of the higher classes.
    """
    enhanced = classified.filter("level <> 'standard'").select("job_id", "seq", "confidence")
    sizes = enhanced.groupBy("job_id", "confidence").agg(F.count(F.lit(1)).alias("n"))
    # Blocks of confidences that agree in three digits; without a confidence comes first.
    stretch = F.coalesce(F.floor(F.col("_o") * 1000).cast("long"), F.lit(-(2**40)))
    above = running(
        sizes.withColumn("_o", -F.col("confidence")), ["job_id"], ["_o"], stretch, sums={"_above": F.col("n")}
    ).select("job_id", "confidence", "_above")
    inside = running(enhanced, ["job_id", "confidence"], ["seq"], seq_block("seq"), sums={"_in": F.lit(1)})
    drop = inside.join(above, ["job_id", "confidence"]).filter(F.col("_above") + F.col("_in") >= limit)
    marked = classified.join(drop.select("job_id", "seq", F.lit(True).alias("_drop")), ["job_id", "seq"], "left")
    low = F.coalesce("_drop", F.lit(False))
    return marked.withColumn("level", F.when(low, "standard").otherwise(F.col("level"))).withColumn(
        "reason", F.when(low, "not_needed").otherwise(F.col("reason"))
    ).drop("_drop")


def enhancement_specs(classified: DataFrame, segments: DataFrame, first_entity: DataFrame | None = None) -> DataFrame:
    """Render orders for the non-standard decisions.

    ``first_entity``: job_id, segment_id, name of the entity the segment lists first.
    """
    d = with_segment(classified.filter("level <> 'standard'"), segments, "inner")
    if first_entity is not None:
        d = d.join(first_entity.select("job_id", "segment_id", F.col("name").alias("_entity")), ["job_id", "segment_id"], "left")
    else:
        d = d.withColumn("_entity", F.lit(None).cast("string"))
    kind = F.coalesce("enhancement_type", F.lit("custom"))
    screen = F.col("seg_text_on_screen")
    n_words = F.size(F.split("seg_transcript", " "))
    rows = d.select(
        "job_id",
        "seq",
        "segment_id",
        kind.alias("enhancement_type"),
        F.col("seg_start_ms").alias("start_ms"),
        F.col("seg_end_ms").alias("end_ms"),
        F.when(present(screen), screen).otherwise(F.col("_entity")).alias("target_subject"),
        F.when(kind.isin("educational_zoom_callout", "precision_zoom"), "zoom_in_hold_zoom_out")
        .when(kind.isin("feature_spotlight", "object_emphasis"), "steady_zoom_in")
        .otherwise("static_with_overlay")
        .alias("camera_behavior"),
        F.when(present(screen), screen).when((n_words > 3) & (n_words <= 10), F.col("seg_transcript")).alias("overlay_text"),
        F.when(kind.isin("animated_annotation", "diagram_reveal"), "duck_under_overlay")
        .otherwise("preserve_original")
        .alias("audio_strategy"),
    )
    placed = running(rows, ["job_id"], ["seq"], seq_block("seq"), sums={"_n": F.lit(1)})
    return placed.select(
        "job_id", F.col("_n").cast("long").alias("spec_no"), numbered("enh_", F.col("_n")).alias("scene_id"), *[c for c in rows.columns if c != "job_id"]
    )


def apply_inserts(clips: DataFrame, specs: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clips, totals): successful renders replace the clips of their segment.

    ``results``: job_id, ord, scene_id, success, output_path, output_s.  First spec of a segment, first
    result of a spec.
    """
    spec = specs.groupBy("job_id", "segment_id").agg(
        F.min_by(F.struct("scene_id", "audio_strategy"), "spec_no").alias("_s")
    ).select("job_id", "segment_id", "_s.scene_id", "_s.audio_strategy")
    res = results.groupBy("job_id", "scene_id").agg(
        F.min_by(F.struct("success", "output_path", "output_s"), "ord").alias("_r")
    ).select("job_id", "scene_id", "_r.*")
    j = clips.join(spec, ["job_id", "segment_id"], "left").join(res, ["job_id", "scene_id"], "left")
    hit = F.coalesce(F.col("success") & present(F.col("output_path")), F.lit(False))
    sized = hit & F.coalesce(F.col("output_s") > 0, F.lit(False))
    out = j.select(
        "job_id",
        "seq",
        "clip_id",
        "segment_id",
        F.when(hit, F.col("output_path")).otherwise(F.col("src")).alias("src"),
        F.when(hit, F.lit(0)).otherwise(F.col("start_from")).cast("long").alias("start_from"),
        F.when(sized, js_round(F.col("output_s") * F.col("fps"))).otherwise(F.col("duration_frames")).cast("long").alias("duration_frames"),
        F.when(hit & (F.col("audio_strategy") == "mute_original"), 0.0)
        .when(hit & (F.col("audio_strategy") == "duck_under_overlay"), 0.4)
        .otherwise(1.0)
        .alias("volume"),
        hit.alias("is_enhanced"),
        "transition",
    )
    totals = out.groupBy("job_id").agg(
        F.sum("duration_frames").alias("duration_frames"), F.count_if("is_enhanced").alias("enhanced_clips")
    ).withColumn("edit_mode", F.when(F.col("enhanced_clips") > 0, "enhanced").otherwise("standard"))
    return out, totals


def enhancement_manifest(segments: DataFrame, specs: DataFrame, results: DataFrame) -> DataFrame:
    """Per job: successes, fallbacks, render time and status."""
    n = segments.groupBy("job_id").agg(F.count(F.lit(1)).alias("total_segments"))
    s = specs.groupBy("job_id").agg(F.count(F.lit(1)).alias("_specs"))
    r = results.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if("success").alias("_ok"),
        F.count_if("fallback").alias("_fb"),
        F.sum(F.coalesce("render_ms", F.lit(0))).alias("_ms"),
    )
    j = n.join(s, "job_id", "left").join(r, "job_id", "left").fillna(0, ["_specs", "_n", "_ok", "_fb", "_ms"])
    return j.select(
        "job_id",
        F.when(F.col("_specs") > 0, "enhanced").otherwise("standard").alias("mode"),
        "total_segments",
        F.col("_ok").alias("enhanced_segments"),
        F.col("_fb").alias("fallback_count"),
        F.col("_ms").cast("long").alias("render_ms"),
        F.when(F.col("_n") == 0, "pending")
        .when(F.col("_fb") == F.col("_n"), "failed")
        .when(F.col("_fb") > 0, "degraded")
        .otherwise("complete")
        .alias("status"),
    )


def first_entities(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """Name of the entity each segment lists first (refs: job_id, segment_id, entities)."""
    names = entities.groupBy("job_id", "entity_id").agg(F.min_by("name", "ord").alias("name"))
    return (
        refs.select("job_id", "segment_id", F.get("entities", F.lit(0)).alias("entity_id"))
        .join(names, ["job_id", "entity_id"])
        .select("job_id", "segment_id", "name")
    )
