"""Text sent to models: one line per segment, and documents of such lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.functions.text import fixed, present, seconds_text

VARIANTS = ("cut_plan", "tighten", "fusion", "topics", "extended", "entities", "enhancement")


def _quoted(label: str, c: Column, n: int) -> Column:
    return F.when(present(c), F.concat(F.lit(f'{label}"'), F.substring(c, 1, n), F.lit('"')))


def _plan_tail() -> list[Column]:
    return [
        F.concat(F.lit("energy="), fixed(F.col("energy"), 2)),
        _quoted("audio=", F.col("transcript"), 120),
        _quoted("screen_text=", F.col("text_on_screen"), 200),
        _quoted("visual=", F.col("visual_description"), 150),
        F.when(present(F.col("scene_type")), F.concat(F.lit("type="), "scene_type")),
        F.when(F.col("visual_interest") > 0, F.concat(F.lit("interest="), F.col("visual_interest").cast("string"))),
        F.when(F.col("is_silent"), F.lit("SILENT")),
    ]


def digest_lines(segments: DataFrame, variant: str = "cut_plan") -> DataFrame:
    """One digest line per row.

    'tighten' expects decisions joined to segments: start_ms/end_ms are the kept window and ``action``
    is the first decision.
    """
    a, b = seconds_text(F.col("start_ms")), seconds_text(F.col("end_ms"))
    span = F.concat(a, F.lit("s-"), b, F.lit("s"))
    length = F.concat(F.lit(" ("), seconds_text(F.col("end_ms") - F.col("start_ms")), F.lit("s)"))
    sid, said = F.col("segment_id"), F.col("transcript")
    shown = F.coalesce("visual_description", F.lit("")) if "visual_description" in segments.columns else F.lit("")
    if variant == "cut_plan":
        line = F.concat_ws(" | ", F.concat(sid, F.lit(": "), span, length), *_plan_tail())
    elif variant == "tighten":
        head = F.concat(sid, F.lit(": "), span, length, F.lit(" [first-pass: "), F.col("action"), F.lit("]"))
        line = F.concat_ws(" | ", head, *_plan_tail())
    elif variant == "fusion":
        line = F.concat_ws(
            " | ",
            F.concat(F.lit("["), sid, F.lit("] "), span),
            _quoted("Speech: ", said, 150),
            _quoted("Visual: ", F.col("visual_description"), 100),
            F.concat(F.lit("Energy: "), fixed(F.col("energy"), 2), F.lit(", Type: "), F.coalesce("scene_type", F.lit("unknown"))),
        )
    elif variant == "topics":
        line = F.concat(F.lit("["), F.col("seq").cast("string"), F.lit("] ("), span, F.lit(") "), F.substring(said, 1, 200))
    elif variant == "extended":
        line = F.concat(
            F.lit("["), sid, F.lit("] "), a, F.lit("s: energy="), fixed(F.col("energy"), 2), F.lit(' "'), F.substring(said, 1, 100), F.lit('"')
        )
    elif variant == "entities":
        line = F.concat(F.lit("[Segment "), F.col("seq").cast("string"), F.lit("] "), said)
    elif variant == "enhancement":
        line = F.concat(
            sid,
            F.lit(": type="),
            F.coalesce("scene_type", F.lit("unknown")),
            F.lit(" interest="),
            F.coalesce(F.col("visual_interest").cast("string"), F.lit("?")),
            F.lit(' "'),
            F.substring(said, 1, 80),
            F.lit('" visual="'),
            F.substring(shown, 1, 80),
            F.lit('"'),
        )
    else:
        raise ValueError(f"unknown digest variant {variant!r}; one of {VARIANTS}")
    return segments.select("job_id", "seq", line.alias("line"))


def digest_documents(lines: DataFrame, page_lines: int = 500) -> DataFrame:
    """Lines joined in order, in pages of ``page_lines`` segment positions.

    A job of ordinary length is one page; joining its pages with a newline gives the whole text, and
    no row ever has to hold an unbounded job.
    """
    page = F.floor(F.col("seq") / F.lit(page_lines)).cast("long")
    return lines.groupBy("job_id", page.alias("page")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("document"),
        F.count(F.lit(1)).alias("lines"),
    )


def batches(rows: DataFrame, position: str, text: str, size: int = 10) -> DataFrame:
    """Requests of ``size`` consecutive items: rows must carry a dense 0-based ``position`` per job."""
    b = F.floor(F.col(position) / F.lit(size)).cast("long")
    return rows.groupBy("job_id", b.alias("batch")).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(text).alias("t")))), lambda x: x["t"]), "\n"
        ).alias("document"),
        F.count(F.lit(1)).alias("items"),
    )
