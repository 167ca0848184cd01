"""Frame thinning: near-duplicate drop, speech-aware density, visual-change refinement."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.functions.text import frame_label, hamming, js_round
from cliploom.operators.blocks import greedy_select, running, time_block, with_job_row
from cliploom.operators.intervals import points_in_intervals, speech_islands
from cliploom.sources.scratch import materialize

# Hash distances up to which two frames count as equal, or as moderately different.
SAME = 10
MODERATE = 25


def _distance(a: dict, b: dict) -> np.ndarray:
    total = np.zeros(len(a["phash_hi"]), dtype=np.int64)
    for c in ("phash_hi", "phash_lo"):
        x = np.nan_to_num(a[c].astype("float64")).astype(np.uint64)
        y = np.nan_to_num(b[c].astype("float64")).astype(np.uint64)
        total += np.bitwise_count(x ^ y)
    return total


def dedup_frames(frames: DataFrame, threshold: int = SAME, min_interval_ms: int = 30_000) -> DataFrame:
    """Flag frames whose hash is close to the last kept one, unless that one is ``min_interval_ms`` old.

    A frame without a hash is kept, and the frame after it too.
    """

    def differs(last: dict, row: dict) -> np.ndarray:
        unknown = np.isnan(last["phash_hi"].astype("float64")) | np.isnan(row["phash_hi"].astype("float64"))
        return unknown | (_distance(last, row) > threshold)

    marked = greedy_select(
        frames, ["job_id"], "ts_ms", "frame_number", min_interval_ms, ["phash_hi", "phash_lo"], differs, out="kept"
    )
    return marked.withColumn("is_duplicate", ~F.col("kept")).drop("kept")


def flag_speech(frames: DataFrame, intervals: DataFrame) -> DataFrame:
    """Is the frame inside a speech interval (ends included)?  Intervals of a job must be disjoint."""
    spans = intervals.select("job_id", F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"))
    hit = points_in_intervals(frames, "ts_ms", "ts_ms", spans, "_s", "_e", how="left")
    return hit.withColumn("in_speech", F.col("_s").isNotNull()).drop("_s", "_e")


def speech_density(frames: DataFrame, intervals: DataFrame, speech_ms: int = 5000, silent_ms: int = 15_000) -> DataFrame:
    """Re-keep duplicates so that speech has a frame every 5 s and silence one every 15 s.

    ``density_kept`` marks the frames re-kept here; ``is_duplicate`` is updated.
    """
    flagged = flag_speech(frames, intervals).withColumn(
        "_wait", F.when(F.col("in_speech"), F.lit(speech_ms)).otherwise(F.lit(silent_ms)).cast("long")
    )
    flagged = materialize(flagged, "flagged")  # read twice below: once to chain the blocks, once to replay them

    def due(last: dict, row: dict) -> np.ndarray:
        return ~row["is_duplicate"].astype(bool) | (row["ts_ms"] - last["ts_ms"] >= row["_wait"])

    marked = greedy_select(
        flagged,
        ["job_id", "in_speech"],
        "ts_ms",
        "frame_number",
        max(speech_ms, silent_ms),
        ["is_duplicate", "ts_ms", "_wait"],
        due,
        out="_taken",
    )
    return (
        marked.withColumn("density_kept", F.col("is_duplicate") & F.col("_taken"))
        .withColumn("is_duplicate", F.col("is_duplicate") & ~F.col("_taken"))
        .drop("_taken", "_wait")
    )


def visual_refinement(frames: DataFrame, same: int = SAME, moderate: int = MODERATE) -> DataFrame:
    """Re-keep frames between two kept frames that look different: one, or up to three, evenly spaced.

    ``visual_kept`` marks the frames re-kept here; ``is_duplicate`` is updated.
    """
    keep = ~F.col("is_duplicate")
    hashed = F.col("is_duplicate") & F.col("phash_hi").isNotNull()
    block = time_block("ts_ms")
    counted = running(
        frames,
        ["job_id"],
        ["ts_ms", "frame_number"],
        block,
        sums={"_kept_before": keep.cast("long"), "_dups_before": hashed.cast("long")},
    )
    counted = materialize(counted, "counted")  # read for the kept frames, and again for all
    # Row i of the kept frames opens group i; duplicates after it belong to that group.
    kept = counted.filter(keep).select("job_id", "ts_ms", "frame_number", "phash_hi", "phash_lo", "_kept_before", "_dups_before")
    pairs = running(
        kept,
        ["job_id"],
        ["ts_ms", "frame_number"],
        block,
        following={"_hi2": F.col("phash_hi"), "_lo2": F.col("phash_lo"), "_dups2": F.col("_dups_before")},
    )
    n = F.col("_dups2") - F.col("_dups_before")
    dist = hamming(F.col("phash_hi"), F.col("phash_lo"), F.col("_hi2"), F.col("_lo2"))
    gaps = pairs.filter(F.col("_dups2").isNotNull() & (n > 0) & (dist > same)).select(
        "job_id",
        (F.col("_kept_before") + 1).alias("_group"),
        F.col("_dups_before").alias("_base"),
        n.alias("_count"),
        F.when(dist <= moderate, F.lit(1)).otherwise(F.least(F.lit(3), n)).alias("_picks"),
    )
    joined = counted.withColumn("_group", F.col("_kept_before")).join(gaps, ["job_id", "_group"], "left")
    rank = F.col("_dups_before") - F.col("_base")
    last = F.col("_count") - 1
    spaced = [js_round((F.lit(p) * last).cast("double") / (F.col("_picks") - 1)) for p in range(3)]
    hit = F.when(F.col("_picks") == 1, rank == F.floor(F.col("_count") / F.lit(2))).otherwise(
        (rank == spaced[0])
        | (rank == spaced[1])
        | ((F.col("_picks") == 3) & (rank == spaced[2]))
    )
    picked = F.coalesce(hashed & F.col("_picks").isNotNull() & hit, F.lit(False))
    return joined.withColumn("visual_kept", picked).select(
        *[c if c != "is_duplicate" else (F.col(c) & ~F.col("visual_kept")).alias(c) for c in frames.columns], "visual_kept"
    )


def adaptive_sampling(frames: DataFrame, words: DataFrame) -> DataFrame:
    """Speech density, then visual refinement, on already flagged frames."""
    dense = materialize(speech_density(frames, speech_islands(words)), "density")
    return visual_refinement(dense)


def sampling_counts(sampled: DataFrame) -> DataFrame:
    return sampled.groupBy("job_id").agg(
        F.count_if(F.col("density_kept")).alias("phase1_unflagged"),
        F.count_if(F.col("visual_kept")).alias("phase2_unflagged"),
        F.count_if(~F.col("is_duplicate")).alias("total_kept"),
    )


def motion_quality(frames: DataFrame, slideshow_at: float = 0.40) -> DataFrame:
    """Raw duplicate ratio per job, taken before any re-keeping, and the warning text it leads to."""
    agg = frames.groupBy("job_id").agg(F.count_if("is_duplicate").alias("dup_frames"), F.count(F.lit(1)).alias("total_frames"))
    ratio = F.col("dup_frames") / F.col("total_frames")
    pct = js_round(ratio * 100)
    slideshow = ratio >= slideshow_at
    note = F.concat(
        F.lit("[motion-quality: "),
        pct.cast("string"),
        F.lit(
            "% of frames are perceptual duplicates of the prior frame - subjects show minimal movement; "
            "this video may read as a slideshow rather than live footage] "
        ),
    )
    return agg.select(
        "job_id",
        "dup_frames",
        "total_frames",
        F.round(ratio, 6).alias("dup_ratio"),
        slideshow.alias("slideshow"),
        F.when(slideshow, note).otherwise("").alias("summary_prefix"),
    )


def _nth_per_scene(matched: DataFrame, totals: DataFrame) -> DataFrame:
    placed = running(matched, ["job_id", "scene_seq"], ["ts_ms", "frame_number"], time_block("ts_ms"), sums={"_rank": F.lit(1)})
    return placed.join(totals, ["job_id", "scene_seq"]).filter(F.col("_rank") == F.floor(F.col("_n") / F.lit(2)))


def representative_frames(scenes: DataFrame, frames: DataFrame, batch: int = 10) -> DataFrame:
    """Middle kept frame of every scene, and the request batch of ten scenes it goes into.

    ``status`` is 'frame', 'no_frame', or 'no_frames_in_batch' when a whole batch has none.
    """
    spans = scenes.select("job_id", F.col("seq").alias("scene_seq"), F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"))
    kept = frames.filter(~F.col("is_duplicate")).select("job_id", "frame_number", "ts_ms")
    matched = points_in_intervals(kept, "ts_ms", "ts_ms", spans, "_s", "_e").drop("_s", "_e")
    totals = matched.groupBy("job_id", "scene_seq").agg(F.count(F.lit(1)).alias("_n"))
    mid = _nth_per_scene(matched, totals).select("job_id", "scene_seq", "frame_number", "ts_ms")
    order = running(
        scenes.select("job_id", F.col("seq").alias("scene_seq"), "scene_id"),
        ["job_id"],
        ["scene_seq"],
        F.floor(F.col("scene_seq") / F.lit(10_000)).cast("long"),
        sums={"_rn": F.lit(1)},
    ).withColumn("batch", F.floor(F.col("_rn") / F.lit(batch)).cast("long"))
    rows = order.join(mid, ["job_id", "scene_seq"], "left")
    full = rows.groupBy("job_id", "batch").agg(F.count("frame_number").alias("_with"))
    return rows.join(full, ["job_id", "batch"]).select(
        "job_id",
        "scene_seq",
        "scene_id",
        "batch",
        "frame_number",
        "ts_ms",
        F.when(F.col("frame_number").isNotNull(), "frame")
        .when(F.col("_with") == 0, "no_frames_in_batch")
        .otherwise("no_frame")
        .alias("status"),
    )


def even_sample(frames: DataFrame, cap: int, thumb_width: int = 320, cols: int = 6, max_dimension: int = 7500) -> DataFrame:
    """Evenly thin the frames of a job to ``cap`` (0 = all), then to what the sheet height allows."""
    placed = running(frames, ["job_id"], ["frame_number"], F.floor(F.col("frame_number") / F.lit(100_000)).cast("long"), sums={"_i": F.lit(1)})
    counts = frames.groupBy("job_id").agg(F.count(F.lit(1)).alias("_n"))
    sized = with_job_row(placed, counts, F.col("frame_number"), "inner", counts.select("job_id", F.col("_n").alias("n")))
    row_h = int(thumb_width * 9 / 16) + 4 * 2 + 22
    fit = (max_dimension // row_h) * cols

    def thin(df: DataFrame, m: int) -> DataFrame:
        step = F.col("_n") / F.lit(float(m))
        guess = F.floor(F.col("_i") / step).cast("long")
        slot = F.try_element_at(
            F.filter(
                F.array(guess - 1, guess, guess + 1),
                lambda k: (k >= 0) & (k < m) & (F.floor(k.cast("double") * step).cast("long") == F.col("_i")),
            ),
            F.lit(1),
        )
        over = F.col("_n") > m
        return (
            df.withColumn("_slot", F.when(over, slot).otherwise(F.col("_i")))
            .filter(F.col("_slot").isNotNull())
            .withColumn("_i", F.col("_slot"))
            .withColumn("_n", F.when(over, F.lit(m).cast("long")).otherwise(F.col("_n")))
            .drop("_slot")
        )

    if cap > 0:
        sized = thin(sized, cap)
    out = thin(sized, fit)
    return out.select("job_id", F.col("_i").cast("long").alias("idx"), "frame_number", F.col("_n").alias("sampled"))


def contact_sheet(sampled: DataFrame, cols: int = 6, thumb_width: int = 320, aspect: tuple[int, int] = (1920, 1080)) -> DataFrame:
    """Grid position and label of every sampled frame; the picture itself is not drawn."""
    thumb_h = int(thumb_width * aspect[1] / aspect[0])
    cell_w, cell_h = thumb_width + 8, thumb_h + 8 + 22
    col = (F.col("idx") % cols).cast("long")
    row = F.floor(F.col("idx") / F.lit(cols)).cast("long")
    return sampled.select(
        "job_id",
        "idx",
        "frame_number",
        row.alias("grid_row"),
        col.alias("grid_col"),
        (col * cell_w + 4).alias("x"),
        (row * cell_h + 4).alias("y"),
        F.ceil(F.col("sampled") / F.lit(cols)).cast("long").alias("grid_rows"),
        frame_label(F.col("frame_number")).alias("label"),
    )
