"""Clips, captions and the checks on a finished timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.functions.direction import text_direction
from cliploom.functions.text import frames_of, js_round, numbered
from cliploom.operators.blocks import running, seq_block, with_job_row
from cliploom.operators.decisions import repaired_windows
from cliploom.operators.silence import speech_islands_of, timed_words, windowed, words_inside
from cliploom.sources.scratch import materialize

# Longest standard caption in words and in output time.
CAPTION_WORDS = 5
CAPTION_MS = 2000
ROWS_PER_STEP = 1000  # decisions per block; a decision holds at most 60 s of speech


def _rates(media: DataFrame) -> DataFrame:
    return media.select(
        "job_id", F.when(F.col("fps").isNull() | (F.col("fps") == 0), 30).otherwise(F.col("fps")).cast("double").alias("fps")
    )


def _with_rate(narrow: DataFrame, media: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows with their job's frame rate. Joined to narrow rows, after the word arrays are gone: a job may hold nearly all."""
    sizes = decisions.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    return with_job_row(narrow, _rates(media), F.col("seq"), sizes=sizes).withColumn("fps", F.coalesce("fps", F.lit(30.0)))


def build_clips(
    decisions: DataFrame, segments: DataFrame, media: DataFrame, threshold_ms: int = 0, transition: str = "cut"
) -> DataFrame:
    """Clips of the output timeline in order, one per speech island of each kept decision.

    ``decisions`` may hold its own ``transition_before`` and its plan's ``transition_default``; ``transition`` is what counts
    without either, and 'mixed' alternates cut and fade.  ``out_start`` is the position in the output.
    """
    d = repaired_windows(decisions, timed_words(segments))
    d = d.withColumn("_w", words_inside(F.col("seg_words"), F.col("win_start_ms"), F.col("win_end_ms")))
    d = d.withColumn("_i", speech_islands_of("_w", "win_start_ms", "win_end_ms", threshold_ms))
    own = [F.col(c) for c in ("transition_before", "transition_default") if c in d.columns]
    d = d.withColumn("_kind", F.coalesce(*own, F.lit(transition)))
    rows = d.select("job_id", "seq", "segment_id", "_kind", F.posexplode_outer("_i").alias("island", "_x"))
    rows = _with_rate(rows, media, decisions).select(
        "job_id",
        F.col("seq").alias("decision_seq"),
        "island",
        "segment_id",
        "fps",
        "_kind",
        frames_of(F.col("_x.start_ms"), F.col("fps")).alias("start_from"),
        frames_of(F.col("_x.end_ms") - F.col("_x.start_ms"), F.col("fps")).alias("duration_frames"),
    ).filter("duration_frames > 0")
    rows = materialize(rows, "clip-rows")  # a few numbers per clip; the word arrays are not needed again
    placed = running(
        rows,
        ["job_id"],
        ["decision_seq", "island"],
        seq_block("decision_seq", ROWS_PER_STEP),
        sums={"_n": F.lit(1), "out_start": F.col("duration_frames")},
    )
    n = F.col("_n").cast("long")
    mixed = F.col("_kind") == "mixed"
    kind_out = F.when(mixed, F.when(n % 2 == 1, "fade").otherwise("cut")).otherwise(F.col("_kind"))
    fade = F.when(F.col("_kind").isin("fade", "mixed"), js_round(F.col("fps") * 0.5))
    return placed.select(
        "job_id",
        n.alias("seq"),
        numbered("clip_", n).alias("clip_id"),
        F.col("decision_seq"),
        "segment_id",
        "start_from",
        "duration_frames",
        F.col("out_start").cast("long").alias("out_start"),
        kind_out.alias("transition"),
        fade.alias("transition_frames"),
        "fps",
    )


def fade_lengths(clips: DataFrame) -> DataFrame:
    """Output position of each clip and the fade the player applies to it."""
    return clips.select(
        "job_id",
        "seq",
        "clip_id",
        "out_start",
        (F.col("out_start") + F.col("duration_frames")).alias("out_end"),
        F.when(F.col("transition") == "fade", F.coalesce("transition_frames", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("fade_frames"),
    )


def timelines(clips: DataFrame, media: DataFrame) -> DataFrame:
    """Totals per job; jobs without clips have 0 frames."""
    totals = clips.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_clips"), F.sum("duration_frames").alias("_d"))
    m = media.select("job_id", "width", "height").join(_rates(media), "job_id")
    return m.join(totals, "job_id", "left").select(
        "job_id",
        "fps",
        "width",
        "height",
        F.coalesce("n_clips", F.lit(0)).alias("n_clips"),
        F.coalesce("_d", F.lit(0)).cast("long").alias("duration_frames"),
    )


def _chunks(style: Column) -> Column:
    """Captions (text, from_ms, to_ms) of the word array _w with islands _i, in order; times are the output's."""
    none = F.array().cast("array<struct<a:int,b:int>>")

    def caption(x: Column, text: Column, start: Column, end: Column) -> Column:
        shift = lambda t: t + x["offset_ms"] - x["start_ms"]
        return F.struct(text.alias("text"), shift(start).alias("from_ms"), shift(end).alias("to_ms"))

    def by_word(x: Column) -> Column:
        said = F.slice("_w", x["first"] + 1, x["past"] - x["first"])
        return F.transform(said, lambda w: caption(x, F.coalesce(w["text"], F.lit("")), w["start_ms"], w["end_ms"]))

    def by_line(x: Column) -> Column:
        cut = F.aggregate(
            F.sequence(x["first"], x["past"] - 1),
            F.struct(none.alias("out"), x["first"].alias("at")),
            lambda acc, k: F.when(
                ((k - acc["at"] + 1) >= CAPTION_WORDS)
                | ((F.get(F.col("_w"), k)["end_ms"] - F.get(F.col("_w"), acc["at"])["start_ms"]) >= CAPTION_MS),
                F.struct(
                    F.concat(acc["out"], F.array(F.struct(acc["at"].alias("a"), k.alias("b")))).alias("out"), (k + 1).alias("at")
                ),
            ).otherwise(acc),
            lambda acc: F.concat(
                acc["out"],
                F.when(acc["at"] < x["past"], F.array(F.struct(acc["at"].alias("a"), (x["past"] - 1).alias("b")))).otherwise(none),
            ),
        )
        text = lambda c: F.array_join(
            F.transform(F.slice("_w", c["a"] + 1, c["b"] - c["a"] + 1), lambda w: w["text"]), " "
        )
        return F.transform(cut, lambda c: caption(x, text(c), F.get(F.col("_w"), c["a"])["start_ms"], F.get(F.col("_w"), c["b"])["end_ms"]))

    voiced = F.filter("_i", lambda x: x["past"] > x["first"])
    return F.when(style == "jumbo", F.flatten(F.transform(voiced, by_word))).otherwise(F.flatten(F.transform(voiced, by_line)))


def plan_captions(
    decisions: DataFrame, segments: DataFrame, media: DataFrame, mode: str | Column = "standard", threshold_ms: int = 0
) -> DataFrame:
    """Caption track of every job.  'standard': up to five words or two seconds; 'jumbo': one word.

    ``mode`` may be a column of ``decisions``, one value per job.  Captions never reach past the start of the next one, except
    that each lasts at least one frame.  They stay on their decision's row, which is numbered and placed by its count of
    captions and its first start, and are rows of their own only in the result.
    """
    if isinstance(mode, str):
        if mode == "none":
            raise ValueError("caption mode 'none' has no track")
        mode = F.lit(mode)
    style = F.when(mode == "jumbo", "jumbo").otherwise("standard")
    d = windowed(decisions, timed_words(segments)).withColumn("style", style)
    d = d.withColumn("_w", words_inside(F.col("seg_words"), F.col("win_start_ms"), F.col("win_end_ms")))
    d = d.withColumn("_i", speech_islands_of("_w", "win_start_ms", "win_end_ms", threshold_ms))
    total = F.aggregate("_i", F.lit(0).cast("long"), lambda acc, x: acc + x["end_ms"] - x["start_ms"])
    d = d.select(
        "job_id", "seq", "style", total.alias("_ms"), F.filter(_chunks(F.col("style")), lambda x: ~x["text"].rlike(r"^\s*$")).alias("_c")
    )
    d = d.select("*", F.size("_c").alias("_size"), F.get("_c", F.lit(0))["from_ms"].alias("_first_ms"), F.monotonically_increasing_id().alias("_row"))
    d = materialize(d, "caption-chunks")
    lengths = _with_rate(d.drop("style", "_c"), media, decisions).withColumn("_frames", frames_of(F.col("_ms"), F.col("fps")))
    off = running(lengths, ["job_id"], ["seq"], seq_block("seq", ROWS_PER_STEP), sums={"_off": F.col("_frames")})
    at = lambda ms: (F.col("_off") + frames_of(F.col(ms), F.col("fps"))).cast("long")
    placed = running(
        off.filter("_size > 0").select("job_id", "seq", "_row", "fps", "_off", "_size", at("_first_ms").alias("_first")),
        ["job_id"],
        ["seq"],
        seq_block("seq", ROWS_PER_STEP),
        sums={"_n": F.col("_size")},
        following={"_after": F.col("_first")},
    ).drop("_size", "_first")
    rows = d.select("job_id", "seq", "_row", "style", "_c").join(placed, ["job_id", "seq", "_row"])
    # Each caption next to the start of the one that follows it on the row.
    rows = rows.withColumn("_c", F.arrays_zip("_c.text", "_c.from_ms", "_c.to_ms", F.slice("_c.from_ms", F.lit(2), F.size("_c")).alias("next_ms")))
    rows = rows.select("job_id", "seq", "style", "fps", "_off", "_n", "_after", F.posexplode_outer("_c").alias("chunk", "_x")).select(
        "job_id",
        (F.col("_n") + F.col("chunk")).cast("long").alias("seq"),
        F.col("seq").alias("decision_seq"),
        F.col("_x.text").alias("text"),
        at("_x.from_ms").alias("start_frame"),
        at("_x.to_ms").alias("_end"),
        F.coalesce(at("_x.next_ms"), F.col("_after")).alias("_next"),
        "style",
    )
    rows = rows.withColumn("_end", F.greatest(F.col("_end"), F.col("start_frame") + 1))
    end = F.when(F.col("_end") > F.col("_next"), F.greatest(F.col("start_frame") + 1, F.col("_next"))).otherwise(F.col("_end"))
    return rows.select(
        "job_id",
        "seq",
        "decision_seq",
        "text",
        "start_frame",
        end.alias("end_frame"),
        text_direction(F.col("text")).alias("direction"),
        "style",
        F.when(F.col("style") == "jumbo", 96).otherwise(36).alias("font_size"),
        F.lit("bottom").alias("position"),
    )


def caption_drift(decisions: DataFrame, segments: DataFrame, media: DataFrame, threshold_ms: int) -> DataFrame:
    """Per decision: frame offset the captions assume and the one the clips have; they round differently."""
    d = windowed(decisions, timed_words(segments))
    d = d.withColumn("_w", words_inside(F.col("seg_words"), F.col("win_start_ms"), F.col("win_end_ms")))
    d = d.withColumn("_i", speech_islands_of("_w", "win_start_ms", "win_end_ms", threshold_ms))
    d = _with_rate(d.select("job_id", "seq", F.transform("_i", lambda x: x["end_ms"] - x["start_ms"]).alias("_l")), media, decisions)
    total = F.aggregate("_l", F.lit(0).cast("long"), lambda acc, x: acc + x)
    by_clip = F.aggregate(
        "_l", F.lit(0).cast("long"), lambda acc, x: acc + F.greatest(F.lit(0).cast("long"), frames_of(x, F.col("fps")))
    )
    d = d.select("job_id", "seq", frames_of(total, F.col("fps")).alias("_a"), by_clip.alias("_b"))
    d = running(
        d,
        ["job_id"],
        ["seq"],
        seq_block("seq", ROWS_PER_STEP),
        sums={"caption_offset": F.col("_a"), "clip_offset": F.col("_b")},
    )
    return d.select(
        "job_id",
        "seq",
        F.col("caption_offset").cast("long").alias("caption_offset"),
        F.col("clip_offset").cast("long").alias("clip_offset"),
        (F.col("caption_offset") - F.col("clip_offset")).cast("long").alias("drift"),
    )


def fast_path_eligible(clips: DataFrame, captioned: DataFrame, titled: DataFrame | None = None) -> DataFrame:
    """Can a timeline be cut without re-encoding?  ``captioned``/``titled`` list jobs with captions/title cards.

    ``clips`` may hold src, playback_rate and is_enhanced.
    """
    rate = F.coalesce("playback_rate", F.lit(1.0)) if "playback_rate" in clips.columns else F.lit(1.0)
    enhanced = F.coalesce("is_enhanced", F.lit(False)) if "is_enhanced" in clips.columns else F.lit(False)
    ok = F.coalesce(F.col("transition") != "fade", F.lit(True)) & rate.isin(0.0, 1.0) & ~enhanced
    per = clips.groupBy("job_id").agg(
        F.bool_and(ok).alias("_ok"), F.min("src").alias("_s1"), F.max("src").alias("_s2"), F.count(F.lit(1)).alias("n_clips")
    )
    marked = per.join(captioned.select("job_id").distinct().withColumn("_cap", F.lit(True)), "job_id", "left")
    if titled is not None:
        marked = marked.join(titled.select("job_id").distinct().withColumn("_tit", F.lit(True)), "job_id", "left")
    else:
        marked = marked.withColumn("_tit", F.lit(None).cast("boolean"))
    return marked.select(
        "job_id",
        "n_clips",
        (F.col("_ok") & (F.col("_s1") == F.col("_s2")) & F.col("_cap").isNull() & F.col("_tit").isNull()).alias("fast_path"),
    )


def cut_list(clips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cut list, rejected): where to cut each clip in its source, in seconds with four decimals."""
    rows = clips.select(
        "job_id",
        F.col("seq").alias("ordinal"),
        F.format_string("%.4f", F.col("start_from") / F.col("fps")).alias("start_s"),
        F.format_string("%.4f", F.col("duration_frames") / F.col("fps")).alias("duration_s"),
        F.concat(F.format_string("seg_%04d", "seq"), F.lit(".mp4")).alias("output_name"),
        "duration_frames",
    )
    # Clips without a frame cannot be cut.
    good = rows.filter("duration_frames > 0").drop("duration_frames")
    return good, rows.filter("duration_frames <= 0")


def write_cut_list(clips: DataFrame, path: str) -> DataFrame:
    """Write the cut list as CSV files in order of job and position; returns the clips that cannot be cut."""
    good, rejected = cut_list(clips)
    good.repartitionByRange("job_id", "ordinal").sortWithinPartitions("job_id", "ordinal").write.option("header", True).csv(path)
    return rejected
