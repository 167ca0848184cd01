"""Transcript words and scenes -> segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.functions.text import numbered, present
from cliploom.operators.blocks import explode_range, running, seq_block, with_job_row
from cliploom.operators.intervals import points_in_intervals

# Longest scene kept whole, length of its pieces, window length without scenes.
LONG_SCENE_MS = 60_000
PIECE_MS = 30_000
WINDOW_MS = 15_000

WORD = ("seq", "text", "start_ms", "end_ms", "confidence", "speaker")


def _word_list(keep: Column) -> Column:
    """Words of a group in transcript order.  Groups span at most one segment, i.e. 60 s of speech."""
    return F.sort_array(F.collect_list(F.when(keep, F.struct(*WORD))))  # compares without a comparator per pair


def _pieces_of(offset: Column, length: Column, width: int, n: Column) -> Column:
    """Grid pieces that contain a word: one, or two for a zero-length word on a grid line."""
    idx = F.floor(offset / F.lit(width)).cast("long")
    last = n - 1
    both = (length == 0) & (offset % width == 0) & (idx > 0)
    inside = (idx <= last) & ((offset + length) <= (idx + 1) * width)
    return F.when(both & (idx <= last), F.array(idx - 1, idx)).when(both, F.array(idx - 1)).when(
        inside, F.array(idx)
    ).otherwise(F.array(F.lit(-1).cast("long")))


def _finish(segs: DataFrame) -> DataFrame:
    ws = F.col("words")
    return segs.select(
        "job_id",
        "seq",
        numbered("seg_", F.col("seq")).alias("segment_id"),
        "scene_id",
        "start_ms",
        "end_ms",
        F.array_join(F.transform(ws, lambda w: w["text"]), " ").alias("transcript"),
        F.get(F.filter(F.transform(ws, lambda w: w["speaker"]), present), F.lit(0)).alias("speaker"),
        F.array_distinct(F.filter(F.transform(ws, lambda w: w["speaker"]), present)).alias("speakers"),
        F.size(ws).alias("word_count"),
        (F.size(ws) == 0).alias("is_silent"),
        ws.alias("words"),
    )


def segments_from_scenes(words: DataFrame, scenes: DataFrame) -> DataFrame:
    """One segment per scene; scenes over 60 s that hold words are cut on a 30 s grid.

    A word belongs to a segment when it lies inside it, ends included; words across a cut drop out.
    """
    spans = scenes.select(
        "job_id", F.col("seq").alias("scene_seq"), F.col("start_ms").alias("scene_start"), F.col("end_ms").alias("scene_end")
    )
    hits = points_in_intervals(words, "start_ms", "end_ms", spans, "scene_start", "scene_end")
    span = F.col("scene_end") - F.col("scene_start")
    long_n = F.ceil(span / F.lit(PIECE_MS)).cast("long")
    hits = hits.withColumn(
        "piece",
        F.explode(
            F.when(
                span > LONG_SCENE_MS,
                _pieces_of(F.col("start_ms") - F.col("scene_start"), F.col("end_ms") - F.col("start_ms"), PIECE_MS, long_n),
            ).otherwise(F.array(F.lit(0).cast("long")))
        ),
    )
    spoken = hits.groupBy("job_id", "scene_seq", "piece").agg(_word_list(F.col("piece") >= 0).alias("words"))
    # Words across a cut are there too, as piece -1: a scene with any row holds a word.
    voiced = spoken.groupBy("job_id", "scene_seq").agg(F.count(F.lit(1)).alias("_voiced"))

    long_scene = (F.col("end_ms") - F.col("start_ms")) > LONG_SCENE_MS
    counted = scenes.withColumnRenamed("seq", "scene_seq").join(voiced, ["job_id", "scene_seq"], "left")
    counted = counted.withColumn(
        "_pieces",
        F.when(long_scene & F.col("_voiced").isNotNull(), F.ceil((F.col("end_ms") - F.col("start_ms")) / F.lit(PIECE_MS)))
        .otherwise(F.lit(1))
        .cast("long"),
    )
    counted = running(
        counted.select("job_id", "scene_seq", "scene_id", "start_ms", "end_ms", "_pieces"),
        ["job_id"],
        ["scene_seq"],
        seq_block("scene_seq"),
        sums={"_first": F.col("_pieces")},
    )
    grid = explode_range(counted, F.col("_pieces"), "piece")
    single = F.col("_pieces") == 1
    lo = F.col("start_ms") + F.col("piece") * PIECE_MS
    grid = grid.select(
        "job_id",
        "scene_seq",
        "piece",
        "scene_id",
        (F.col("_first") + F.col("piece")).cast("long").alias("seq"),
        lo.cast("long").alias("start_ms"),
        F.when(single, F.col("end_ms")).otherwise(F.least(lo + PIECE_MS, F.col("end_ms"))).cast("long").alias("end_ms"),
    )
    none = F.array().cast("array<struct<seq:bigint,text:string,start_ms:bigint,end_ms:bigint,confidence:double,speaker:string>>")
    filled = grid.join(spoken, ["job_id", "scene_seq", "piece"], "left").withColumn("words", F.coalesce("words", none))
    return _finish(filled)


def segments_from_words(words: DataFrame) -> DataFrame:
    """No scenes: 15 s windows over [0, end of the last word); empty windows are kept."""
    length = words.groupBy("job_id").agg(F.max_by("end_ms", "seq").alias("duration_ms"))
    n = F.ceil(F.col("duration_ms") / F.lit(WINDOW_MS)).cast("long")
    windows = explode_range(length.withColumn("_w", n), F.col("_w"), "piece").select(
        "job_id",
        "piece",
        (F.col("piece") * WINDOW_MS).cast("long").alias("start_ms"),
        F.least((F.col("piece") + 1) * WINDOW_MS, F.col("duration_ms")).cast("long").alias("end_ms"),
    )
    placed = with_job_row(words, length, F.col("seq"), "inner").filter(F.col("end_ms") <= F.col("duration_ms"))
    placed = placed.withColumn(
        "piece", F.explode(_pieces_of(F.col("start_ms"), F.col("end_ms") - F.col("start_ms"), WINDOW_MS, n))
    ).filter("piece >= 0")
    spoken = placed.groupBy("job_id", "piece").agg(_word_list(F.lit(True)).alias("words"))
    none = F.array().cast("array<struct<seq:bigint,text:string,start_ms:bigint,end_ms:bigint,confidence:double,speaker:string>>")
    filled = windows.join(spoken, ["job_id", "piece"], "left").withColumn("words", F.coalesce("words", none))
    filled = filled.withColumn("seq", F.col("piece")).withColumn(
        "scene_id", F.concat(F.lit("auto_"), (F.col("piece") + 1).cast("string"))
    )
    return _finish(filled)


def build_segments(words: DataFrame, scenes: DataFrame) -> DataFrame:
    """Scene-based segments where a job has scenes, 15 s windows where it has none."""
    with_scenes = scenes.select("job_id").distinct()
    return segments_from_scenes(words, scenes).unionByName(
        segments_from_words(words.join(with_scenes, "job_id", "left_anti"))
    )


def energy_curve(segments: DataFrame, media: DataFrame) -> DataFrame:
    """Energy point per segment from speech rate, silence and whether loudness was measured."""
    dur = (F.col("end_ms") - F.col("start_ms")) / F.lit(1000.0)
    rated = segments.select(
        "job_id",
        "seq",
        "segment_id",
        "start_ms",
        "is_silent",
        F.when(dur > 0, F.col("word_count") / dur).otherwise(F.lit(0.0)).alias("_rate"),
    )
    top = rated.groupBy("job_id").agg(F.greatest(F.max("_rate"), F.lit(1.0)).alias("_top"), F.count(F.lit(1)).alias("n"))
    sizes, top = top.select("job_id", "n"), top.drop("n")
    loud = media.select("job_id", F.when(F.col("input_i").isNotNull(), 0.3).otherwise(0.5).alias("_loud"))
    per_job = top.join(loud, "job_id", "left").withColumn("_loud", F.coalesce("_loud", F.lit(0.5)))
    d = with_job_row(rated, per_job, F.col("seq"), sizes=sizes)
    r = F.col("_rate") / F.col("_top")
    energy = (
        F.when(F.col("is_silent"), F.lit(0.05))
        .when(r > 0.7, r * 0.6 + F.col("_loud") * 0.3 + F.lit(0.5) * 0.1)
        .otherwise(r * 0.3 + F.col("_loud") * 0.5 + F.lit(0.5) * 0.2)
    )
    driver = F.when(F.col("is_silent"), "silence").when(r > 0.7, "speech_rate").otherwise("audio_level")
    return d.select(
        "job_id",
        "seq",
        "segment_id",
        F.col("start_ms").alias("time_ms"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), energy)).alias("energy"),
        driver.alias("driver"),
    )


def attach_energy(segments: DataFrame, curve: DataFrame, tolerance_ms: int = 500) -> DataFrame:
    """First curve point (by seq) less than ``tolerance_ms`` away from the segment start; 0.5 without one.

    Points and starts are reduced to distinct times first, so a bucket holds a bounded number of rows.
    """
    times = curve.groupBy("job_id", "time_ms").agg(F.min("seq").alias("_pseq"), F.min_by("energy", "seq").alias("_e"))
    points = times.withColumn("_bucket", F.floor(F.col("time_ms") / F.lit(tolerance_ms)).cast("long"))
    starts = segments.select("job_id", "start_ms").distinct()
    b = F.floor(F.col("start_ms") / F.lit(tolerance_ms)).cast("long")
    starts = starts.withColumn("_bucket", F.explode(F.sequence(b - 1, b + 1)))
    near = starts.join(points, ["job_id", "_bucket"]).filter(
        F.abs(F.col("time_ms") - F.col("start_ms")) < F.lit(tolerance_ms)
    )
    best = near.groupBy("job_id", "start_ms").agg(F.min_by("_e", "_pseq").alias("_best"))
    return (
        segments.join(best, ["job_id", "start_ms"], "left")
        .withColumn("energy", F.coalesce("_best", F.lit(0.5)))
        .drop("_best")
    )
