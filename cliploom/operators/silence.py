"""Words inside a decision window, speech islands and silence cuts.

A segment carries its words as an array (at most 60 s of speech), so all of this is done per row,
without a shuffle.  Arrays are exploded with the outer form: it keeps the optimizer from copying the
array expression into a size filter below, where it would be computed again for every word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.operators.blocks import running, seq_block

# Sound kept after the last word of an island, and at both ends of a cut pause.
TAIL_MS = 100
KEEP_MS = 50


def first_segments(segments: DataFrame) -> DataFrame:
    """First row (by seq) of every segment id, as a lookup side for joins by id."""
    # One exchange by id, which the join that follows can use as well.
    by_id = Window.partitionBy("job_id", "segment_id").orderBy("seq")
    return segments.withColumn("_nth", F.row_number().over(by_id)).filter("_nth = 1").drop("_nth")


def with_segment(decisions: DataFrame, segments: DataFrame, how: str = "left") -> DataFrame:
    """Decisions next to their segment; segment columns get the prefix ``seg_``."""
    side = first_segments(segments)
    side = side.select(
        "job_id", "segment_id", *[F.col(c).alias(f"seg_{c}") for c in side.columns if c not in ("job_id", "segment_id")]
    )
    return decisions.join(side, ["job_id", "segment_id"], how)


def windowed(decisions: DataFrame, segments: DataFrame) -> DataFrame:
    """Kept decisions of known segments with their effective window win_start_ms .. win_end_ms."""
    d = with_segment(decisions.filter("action <> 'remove'"), segments, "inner")
    return d.withColumn("win_start_ms", F.coalesce("trim_start_ms", "seg_start_ms")).withColumn(
        "win_end_ms", F.coalesce("trim_end_ms", "seg_end_ms")
    )


def timed_words(segments: DataFrame) -> DataFrame:
    """Segments with no more of their words than text and times, so that nothing else is read and shuffled."""
    return segments.withColumn("words", F.arrays_zip("words.text", "words.start_ms", "words.end_ms"))


def words_overlapping(words: Column, start: Column, end: Column) -> Column:
    return F.filter(words, lambda w: (w["end_ms"] > start) & (w["start_ms"] < end))


def words_inside(words: Column, start: Column, end: Column) -> Column:
    return F.filter(words, lambda w: (w["start_ms"] >= start) & (w["end_ms"] <= end))


def gap_multiplier(text: Column) -> Column:
    """How many thresholds a pause must last: after a sentence 1, after a clause 2, inside one 4."""
    return F.when(text.rlike(r"[.!?]\s*$"), 1).when(text.rlike(r"[,;:]\s*$"), 2).otherwise(4)


def speech_islands_of(ws: str, start: str, end: str, threshold_ms: int) -> Column:
    """Array of islands (first, past, start_ms, end_ms, offset_ms) of a word array in a window.

    ``first``/``past`` are word positions, ``offset_ms`` the output time before the island.  Without
    words, or with a threshold of 0, one island covers the window.
    """
    w = F.col(ws)
    n = F.size(w)
    whole = F.array(
        F.struct(
            F.lit(0).alias("first"),
            n.alias("past"),
            F.col(start).cast("long").alias("start_ms"),
            F.col(end).cast("long").alias("end_ms"),
        )
    )
    if threshold_ms <= 0:
        cut = whole
    else:
        inner = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
        # A pause below one threshold is none, whatever the text: most words end here, before the patterns.
        pause = lambda i: F.get(w, i)["start_ms"] - F.get(w, i - 1)["end_ms"]
        breaks = F.filter(
            inner,
            lambda i: (pause(i) >= threshold_ms) & (pause(i) >= F.lit(threshold_ms) * gap_multiplier(F.get(w, i - 1)["text"])),
        )
        firsts = F.concat(F.array(F.lit(0)), breaks)
        pasts = F.concat(breaks, F.array(n))
        cut = F.zip_with(
            firsts,
            pasts,
            lambda a, b: F.struct(
                a.alias("first"),
                b.alias("past"),
                F.get(w, a)["start_ms"].alias("start_ms"),
                F.least(F.get(w, b - 1)["end_ms"] + F.lit(TAIL_MS), F.col(end)).cast("long").alias("end_ms"),
            ),
        )
        cut = F.when(n > 0, cut).otherwise(whole)
    none = F.array().cast("array<struct<first:int,past:int,start_ms:bigint,end_ms:bigint,offset_ms:bigint>>")
    return F.aggregate(
        cut,
        F.struct(none.alias("items"), F.lit(0).cast("long").alias("total")),
        lambda acc, x: F.struct(
            F.concat(
                acc["items"],
                F.array(
                    F.struct(
                        x["first"].alias("first"),
                        x["past"].alias("past"),
                        x["start_ms"].alias("start_ms"),
                        x["end_ms"].alias("end_ms"),
                        acc["total"].alias("offset_ms"),
                    )
                ),
            ).alias("items"),
            (acc["total"] + x["end_ms"] - x["start_ms"]).alias("total"),
        ),
        lambda acc: acc["items"],
    )


def islands_in_windows(decisions: DataFrame, segments: DataFrame, threshold_ms: int) -> DataFrame:
    """One row per speech island of every kept decision."""
    d = windowed(decisions, timed_words(segments))
    d = d.withColumn("_w", words_inside(F.col("seg_words"), F.col("win_start_ms"), F.col("win_end_ms")))
    d = d.withColumn("_i", speech_islands_of("_w", "win_start_ms", "win_end_ms", threshold_ms))
    return d.select("job_id", "seq", "segment_id", F.posexplode_outer("_i").alias("island", "_x")).select(
        "job_id",
        "seq",
        "segment_id",
        "island",
        F.col("_x.start_ms").alias("start_ms"),
        F.col("_x.end_ms").alias("end_ms"),
        F.col("_x.offset_ms").alias("offset_ms"),
        (F.col("_x.past") - F.col("_x.first")).alias("n_words"),
    )


def silence_cuts(decisions: DataFrame, segments: DataFrame, min_gap_ms: int) -> DataFrame:
    """Split kept decisions at pauses of at least ``min_gap_ms``, keeping 50 ms at both ends of a pause.

    Decisions without a pause, without words or without a segment stay as they are.  ``part`` numbers
    the pieces of one decision.
    """
    d = with_segment(decisions, segments)
    start, end = F.coalesce("trim_start_ms", "seg_start_ms"), F.coalesce("trim_end_ms", "seg_end_ms")
    d = d.withColumn("_s", start.cast("long")).withColumn("_e", end.cast("long"))
    d = d.withColumn("_w", words_overlapping(F.col("seg_words"), F.col("_s"), F.col("_e")))
    n = F.size("_w")
    inner = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    gaps = F.filter(
        F.transform(
            inner,
            lambda i: F.struct(
                F.get(F.col("_w"), i - 1)["end_ms"].alias("a"), F.get(F.col("_w"), i)["start_ms"].alias("b")
            ),
        ),
        lambda g: (g["b"] - g["a"]) >= F.lit(min_gap_ms),
    )
    d = d.withColumn("_g", F.when(F.col("action") != "remove", gaps))
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    spans = F.aggregate(
        F.col("_g"),
        F.struct(none.alias("out"), F.col("_s").alias("at")),
        lambda acc, g: F.struct(
            F.concat(
                acc["out"],
                F.when(
                    F.least(g["a"] + KEEP_MS, g["b"]) > acc["at"],
                    F.array(F.struct(acc["at"].alias("a"), F.least(g["a"] + KEEP_MS, g["b"]).alias("b"))),
                ).otherwise(none),
            ).alias("out"),
            F.greatest(g["b"] - KEEP_MS, acc["at"]).alias("at"),
        ),
        lambda acc: F.concat(
            acc["out"],
            F.when(F.col("_e") > acc["at"], F.array(F.struct(acc["at"].alias("a"), F.col("_e").alias("b")))).otherwise(none),
        ),
    )
    split = F.coalesce(F.size("_g") > 0, F.lit(False))
    unchanged = F.array(F.struct(F.col("trim_start_ms").cast("long").alias("a"), F.col("trim_end_ms").cast("long").alias("b")))
    d = d.withColumn("_split", split).withColumn("_p", F.when(split, spans).otherwise(unchanged))
    return d.select("job_id", "seq", "segment_id", "action", "_split", F.posexplode_outer("_p").alias("part", "_x")).filter("_x IS NOT NULL").select(
        "job_id",
        "seq",
        "part",
        "segment_id",
        F.when(F.col("_split"), "keep").otherwise(F.col("action")).alias("action"),
        F.col("_x.a").alias("trim_start_ms"),
        F.col("_x.b").alias("trim_end_ms"),
    )


def numbered_decisions(parts: DataFrame) -> DataFrame:
    """Give split decisions (seq, part) a new dense seq per job."""
    out = running(parts, ["job_id"], ["seq", "part"], seq_block("seq", 1000), sums={"_n": F.lit(1)})
    return out.withColumn("seq", F.col("_n").cast("long")).drop("_n", "part")
