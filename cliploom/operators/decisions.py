"""Edit decisions: cleaning, kept duration, plan choice, fallback, pacing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.operators.blocks import running, seq_block
from cliploom.operators.silence import windowed, with_segment


# What a decision may hold besides its window.
OPTIONAL = ("transition_before",)
# Fixed value: the reason of decisions made up for a plan that cannot be read.
FALLBACK_REASON = "Fallback: plan could not be parsed"


def kept_windows(decisions: DataFrame, segments: DataFrame) -> DataFrame:
    """Kept decisions with their effective window."""
    return windowed(decisions, segments).select("job_id", "seq", "segment_id", "action", "win_start_ms", "win_end_ms")


def sanitize_decisions(raw: DataFrame, segments: DataFrame) -> DataFrame:
    """Clamp trims to the segment, drop both when they leave nothing, fill action and reason.

    ``raw`` may hold trims as text: what is not a number counts as absent.  Decisions of unknown
    segments keep their trims, and a decision its own transition.
    """
    d = with_segment(raw, segments)
    known = F.col("seg_start_ms").isNotNull()
    ts = F.expr("try_cast(trim_start_ms AS BIGINT)")
    te = F.expr("try_cast(trim_end_ms AS BIGINT)")
    lo = F.when(known & ts.isNotNull(), F.greatest(ts, F.col("seg_start_ms"))).otherwise(ts)
    hi = F.when(known & te.isNotNull(), F.least(te, F.col("seg_end_ms"))).otherwise(te)
    bad = F.coalesce(known & (hi <= lo), F.lit(False))
    reason = F.coalesce("reason", F.lit("")) if "reason" in raw.columns else F.lit("")
    return d.select(
        "job_id",
        "seq",
        "segment_id",
        F.coalesce("action", F.lit("keep")).alias("action"),
        reason.alias("reason"),
        F.when(~bad, lo).alias("trim_start_ms"),
        F.when(~bad, hi).alias("trim_end_ms"),
        *[c for c in OPTIONAL if c in raw.columns],
    )


def repaired_windows(decisions: DataFrame, segments: DataFrame) -> DataFrame:
    """Window used by the timeline: clamped; an empty one becomes the whole segment; still empty ones go."""
    d = windowed(decisions, segments)
    lo = F.greatest("win_start_ms", "seg_start_ms")
    hi = F.least("win_end_ms", "seg_end_ms")
    empty = hi <= lo
    return (
        d.withColumn("_lo", F.when(empty, F.col("seg_start_ms")).otherwise(lo))
        .withColumn("_hi", F.when(empty, F.col("seg_end_ms")).otherwise(hi))
        .withColumn("win_start_ms", F.col("_lo").cast("long"))
        .withColumn("win_end_ms", F.col("_hi").cast("long"))
        .drop("_lo", "_hi")
        .filter("win_end_ms > win_start_ms")
    )


def kept_duration(decisions: DataFrame, segments: DataFrame) -> DataFrame:
    """Kept decisions and kept milliseconds per job; jobs with nothing kept count 0."""
    kept = windowed(decisions, segments).groupBy("job_id").agg(
        F.sum(F.greatest(F.lit(0), F.col("win_end_ms") - F.col("win_start_ms"))).alias("_ms")
    )
    counts = decisions.groupBy("job_id").agg(F.count_if(F.col("action") != "remove").alias("kept_decisions"))
    return counts.join(kept, "job_id", "left").select(
        "job_id", "kept_decisions", F.coalesce("_ms", F.lit(0)).cast("long").alias("kept_ms")
    )


def budget_check(decisions: DataFrame, segments: DataFrame, targets: DataFrame, tolerance: float = 1.05) -> DataFrame:
    """Kept duration against the target (job_id, target_ms): is a tighter plan needed, and how tight."""
    n = segments.groupBy("job_id").agg(F.count(F.lit(1)).alias("_n"))
    d = kept_duration(decisions, segments).join(targets, "job_id", "left").join(n, "job_id", "left")
    over = F.coalesce((F.col("target_ms") > 0) & (F.col("kept_ms") > F.col("target_ms") * F.lit(tolerance)), F.lit(False))
    return d.select(
        "job_id",
        "kept_decisions",
        "kept_ms",
        "target_ms",
        over.alias("over_budget"),
        F.when(over, F.col("kept_ms") - F.col("target_ms")).alias("overage_ms"),
        F.greatest(F.lit(3), F.floor(F.coalesce("_n", F.lit(0)) * F.lit(0.3))).cast("long").alias("min_segments"),
    )


def tighten_list(decisions: DataFrame, segments: DataFrame, checked: DataFrame) -> DataFrame:
    """Kept segments of over-budget jobs: what the second planning pass may choose from."""
    over = checked.filter("over_budget").select("job_id")
    return kept_windows(decisions, segments).join(over, "job_id", "left_semi")


def choose_plan(first: DataFrame, second: DataFrame, segments: DataFrame, checked: DataFrame) -> DataFrame:
    """Decisions of the plan to use: the second only where the first is over budget and the second is sound.

    Sound: keeps something, lasts at least 0.6 of the target and less than the first.
    """
    b = kept_duration(second, segments).select(
        "job_id", F.col("kept_decisions").alias("_k2"), F.col("kept_ms").alias("_ms2")
    )
    adopted = (
        checked.filter("over_budget")
        .join(b, "job_id")
        .filter((F.col("_k2") > 0) & (F.col("_ms2") >= F.col("target_ms") * 0.6) & (F.col("_ms2") < F.col("kept_ms")))
        .select("job_id")
    )
    use2 = second.join(adopted, "job_id", "left_semi").withColumn("plan", F.lit(2))
    use1 = first.join(adopted, "job_id", "left_anti").withColumn("plan", F.lit(1))
    return use1.unionByName(use2)


def fallback_keep_all(decisions: DataFrame, segments: DataFrame, failed: DataFrame) -> DataFrame:
    """Add a keep-everything plan for jobs whose plan could not be read (``failed``: job_id)."""
    cols = ["job_id", "seq", "segment_id", "action", "reason", "trim_start_ms", "trim_end_ms"]
    keep = (
        segments.join(failed.select("job_id").distinct(), "job_id", "left_semi")
        .select("job_id", "seq", "segment_id")
        .withColumn("action", F.lit("keep"))
        .withColumn("reason", F.lit(FALLBACK_REASON))
        .withColumn("trim_start_ms", F.lit(None).cast("long"))
        .withColumn("trim_end_ms", F.lit(None).cast("long"))
    )
    optional = [c for c in OPTIONAL if c in decisions.columns]
    sane = decisions.join(failed.select("job_id").distinct(), "job_id", "left_anti")
    if "reason" not in sane.columns:
        sane = sane.withColumn("reason", F.lit(""))
    keep = keep.select(*cols, *[F.lit(None).cast("string").alias(c) for c in optional])
    return sane.select(*cols, *optional).unionByName(keep)


def pacing_warnings(decisions: DataFrame, segments: DataFrame) -> DataFrame:
    """Warnings per job: nothing kept, long low-energy pairs, low-energy ending, one scene type only."""
    jobs = decisions.groupBy("job_id").agg(F.count_if(F.col("action") != "remove").alias("_kept"))
    nothing = jobs.filter("_kept = 0").select(
        "job_id", F.lit("nothing_kept").alias("code"), F.lit(-1).cast("long").alias("seq"), F.lit("").alias("detail")
    )
    kept = with_segment(decisions.filter("action <> 'remove'"), segments, "inner").select(
        "job_id",
        "seq",
        "segment_id",
        F.col("seg_energy").alias("energy"),
        F.col("seg_scene_type").alias("scene_type"),
        ((F.col("seg_energy") < 0.3) & (F.col("seg_end_ms") - F.col("seg_start_ms") > 10_000)).alias("low"),
    )
    pairs = running(
        kept,
        ["job_id"],
        ["seq"],
        seq_block("seq"),
        prev={"_plow": F.col("low").cast("int"), "_pid": F.col("segment_id")},
    )
    stretch = pairs.filter("low AND _plow = 1").select(
        "job_id",
        F.lit("low_energy_stretch").alias("code"),
        "seq",
        F.concat_ws(",", "_pid", "segment_id").alias("detail"),
    )
    per_job = kept.groupBy("job_id").agg(
        F.max_by("energy", "seq").alias("_last"),
        F.max("seq").alias("seq"),
        F.count("scene_type").alias("_typed"),
        F.min("scene_type").alias("_t1"),
        F.max("scene_type").alias("_t2"),
    )
    ending = per_job.filter("_last < 0.3").select("job_id", F.lit("low_energy_ending").alias("code"), "seq", F.lit("").alias("detail"))
    same = per_job.filter("_typed > 3 AND _t1 = _t2").select(
        "job_id", F.lit("single_scene_type").alias("code"), F.lit(-1).cast("long").alias("seq"), F.col("_t1").alias("detail")
    )
    return nothing.unionByName(stretch).unionByName(ending).unionByName(same)
