"""Repeated lines inside a decision: find them, score the takes, keep the best one."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliploom.functions.text import normalized_word
from cliploom.operators.decisions import OPTIONAL
from cliploom.operators.intervals import complement, merge_intervals, overlaps
from cliploom.operators.silence import windowed, words_overlapping
from cliploom.sources.scratch import materialize

# Words per window, share that must repeat, words a decision needs, score difference that counts as a tie.
SPAN = 6
MIN_SHARE = 0.75
MIN_WORDS = 12
TIE = 0.02


def _lookup(tokens: list[str]) -> dict[str, list[int]]:
    """Window starts that contain a token, ascending."""
    at: dict[str, list[int]] = defaultdict(list)
    for j in range(len(tokens) - SPAN + 1):
        for t in set(tokens[j : j + SPAN]):
            if t:
                at[t].append(j)
    return at


def _first_match(tokens: list[str], i: int, at: dict[str, list[int]], blocked: set[int]) -> int:
    """First window j >= i+SPAN, not blocked, that shares enough tokens with window i; -1 if none.

    At most one of the six tokens may be missing, so j must hold one of the two rarest.
    """
    query = tokens[i : i + SPAN]
    need = MIN_SHARE * SPAN
    if sum(1 for t in query if t) < need:
        return -1
    slack = int(SPAN - need)
    rare = sorted(query, key=lambda t: len(at.get(t, ())))[: slack + 1]
    best = -1
    for t in set(rare):
        starts = at.get(t, ())
        for j in starts[bisect_left(starts, i + SPAN) :]:
            if j in blocked:
                continue
            if 0 <= best <= j:
                break
            other = set(tokens[j : j + SPAN])
            if sum(1 for q in query if q and q in other) >= need:
                best = j
                break
    return best


PAIRS = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))


def _hopeful(tokens: list[str]) -> list[int]:
    """Windows of which enough words occur again after the window; only these can have a repeat."""
    n = len(tokens) - SPAN + 1
    if n <= SPAN:
        return []
    last = {t: k for k, t in enumerate(tokens) if t}
    later = np.array([last.get(t, -1) for t in tokens])
    edge = np.arange(n) + SPAN
    again = sum((later[k : k + n] >= edge).astype(np.int64) for k in range(SPAN))
    return np.flatnonzero(again >= MIN_SHARE * SPAN).tolist()


def _all_pairs(tokens: list[str]) -> list[dict]:
    """First match of every window."""
    starts = _hopeful(tokens)
    at = _lookup(tokens) if starts else {}
    found = [(i, _first_match(tokens, i, at, set())) for i in starts]
    return [{"a": i, "b": j} for i, j in found if j >= 0]


def _greedy_pairs(tokens: list[str]) -> list[dict]:
    """Left to right: a matched pair of windows blocks its twelve words as further anchors."""
    starts = _hopeful(tokens)
    at = _lookup(tokens) if starts else {}
    used: set[int] = set()
    out = []
    for i in starts:
        if i in used:
            continue
        j = _first_match(tokens, i, at, used)
        if j >= 0:
            used.update(range(i, i + SPAN))
            used.update(range(j, j + SPAN))
            out.append({"a": i, "b": j})
    return out


def _pairs(tokens: Column, greedy: bool) -> Column:
    find = _greedy_pairs if greedy else _all_pairs

    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda ts: find(list(ts)))

    return F.pandas_udf(run, PAIRS)(tokens)


def _decision_words(decisions: DataFrame, segments: DataFrame) -> DataFrame:
    d = windowed(decisions, segments)
    d = d.withColumn("_w", words_overlapping(F.col("seg_words"), F.col("win_start_ms"), F.col("win_end_ms")))
    return d.withColumn("_t", F.transform("_w", lambda w: normalized_word(w["text"])))


def _repeats(tokens: str) -> Column:
    """Can there be a repeat at all?  Five words of a window must come again, so a decision without that needs no Python."""
    return F.size(tokens) - F.size(F.array_distinct(tokens)) >= F.ceil(F.lit(MIN_SHARE * SPAN))


def repeat_candidates(decisions: DataFrame, segments: DataFrame) -> DataFrame:
    """For every six-word window the first later, disjoint window that repeats at least five of its words."""
    d = _decision_words(decisions, segments).filter(_repeats("_t")).select("job_id", "seq", "segment_id", F.explode(_pairs(F.col("_t"), greedy=False)).alias("x"))
    return d.select("job_id", "seq", "segment_id", F.col("x.a").cast("long").alias("i"), F.col("x.b").cast("long").alias("j"))


def visual_scores(spans: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Mean visual score over the segments each span (start_ms, end_ms) overlaps; 0.5 without any."""
    motion = F.lower(F.coalesce("camera_motion", F.lit("")))
    energy = F.coalesce(F.least(F.lit(1.0), "energy"), F.lit(0.5))
    score: Column = (
        energy
        * F.when(F.col("is_blurry"), 0.6).otherwise(1.0)
        * F.when(F.col("is_silent"), 0.4).otherwise(1.0)
        * F.when(motion.contains("shake") | motion.contains("unstable"), 0.7).otherwise(1.0)
    )
    side = segments.select("job_id", F.col("start_ms").alias("_ss"), F.col("end_ms").alias("_se"), score.alias("_score"))
    hit = overlaps(spans.select("job_id", *[k for k in keys if k != "job_id"], "start_ms", "end_ms"), "start_ms", "end_ms", side, "_ss", "_se")
    mean = hit.groupBy(*keys).agg(F.avg("_score").alias("_v"))
    return spans.join(mean, keys, "left").withColumn("visual_score", F.coalesce("_v", F.lit(0.5))).drop("_v")


def score_takes(decisions: DataFrame, segments: DataFrame, null_as_zero: bool = False) -> DataFrame:
    """Both takes of every repeated line with their scores and which one stays.

    Score = 0.7 x mean word confidence + 0.3 x visual score.  Takes closer than 0.02 count as equal;
    then the earlier one stays.
    """
    d = _decision_words(decisions, segments).filter((F.size("_w") >= MIN_WORDS) & _repeats("_t"))
    d = d.withColumn("_c", _pairs(F.col("_t"), greedy=True)).select("job_id", "seq", "segment_id", "_w", F.posexplode("_c").alias("cluster", "_x"))
    takes = d.select(
        "job_id",
        "seq",
        "segment_id",
        "cluster",
        F.posexplode(F.array(F.slice("_w", F.col("_x.a") + 1, SPAN), F.slice("_w", F.col("_x.b") + 1, SPAN))).alias("take", "_s"),
    )
    conf = F.transform("_s", lambda w: w["confidence"])
    known = F.transform(conf, lambda c: F.coalesce(c, F.lit(0.0))) if null_as_zero else F.filter(conf, lambda c: c.isNotNull())
    n = F.size(known)
    mean = F.when(n > 0, F.aggregate(known, F.lit(0.0), lambda a, c: a + c) / n).otherwise(F.lit(0.7))
    takes = takes.select(
        "job_id",
        "seq",
        "segment_id",
        "cluster",
        "take",
        F.get("_s", F.lit(0))["start_ms"].alias("start_ms"),
        F.get("_s", F.lit(SPAN - 1))["end_ms"].alias("end_ms"),
        F.array_join(F.transform(F.slice("_s", 1, 5), lambda w: w["text"]), " ").alias("phrase"),
        mean.alias("audio_confidence"),
    )
    takes = materialize(takes, "takes")
    scored = visual_scores(takes, segments, ["job_id", "seq", "cluster", "take"]).withColumn(
        "combined_score", F.lit(0.7) * F.col("audio_confidence") + F.lit(0.3) * F.col("visual_score")
    )
    pair = scored.groupBy("job_id", "seq", "cluster").agg(
        F.max(F.when(F.col("take") == 0, F.col("combined_score"))).alias("_s0"),
        F.max(F.when(F.col("take") == 1, F.col("combined_score"))).alias("_s1"),
        F.max(F.when(F.col("take") == 0, F.col("phrase"))).alias("_p0"),
        F.max(F.when(F.col("take") == 1, F.col("phrase"))).alias("_p1"),
    )
    first_wins = (F.abs(F.col("_s0") - F.col("_s1")) < TIE) | (F.col("_s0") > F.col("_s1"))
    best = pair.select(
        "job_id", "seq", "cluster", F.when(first_wins, 0).otherwise(1).alias("_win"), F.when(first_wins, F.col("_p0")).otherwise(F.col("_p1")).alias("_phrase")
    )
    return scored.join(best, ["job_id", "seq", "cluster"]).select(
        "job_id",
        "seq",
        "segment_id",
        "cluster",
        "take",
        F.col("_phrase").alias("phrase"),
        "start_ms",
        "end_ms",
        "audio_confidence",
        "visual_score",
        "combined_score",
        (F.col("take") == F.col("_win")).alias("kept"),
    )


def remove_spans(decisions: DataFrame, segments: DataFrame, spans: DataFrame) -> DataFrame:
    """Cut spans (job_id, seq, start_ms, end_ms) out of the decisions they belong to.

    Touching spans merge.  A decision that loses everything, or has no span, stays as it is.
    """
    windows = windowed(decisions, segments).select("job_id", "seq", "win_start_ms", "win_end_ms")
    merged = merge_intervals(spans.select("job_id", "seq", "start_ms", "end_ms"), keys=["job_id", "seq"])
    pieces = complement(windows, merged, ["job_id", "seq"])
    pieces = pieces.select("job_id", "seq", F.col("start_ms").alias("_from"), F.col("end_ms").alias("_to"))
    cut = F.col("_from").isNotNull()
    optional = [c for c in OPTIONAL if c in decisions.columns]
    return (
        decisions.select("job_id", "seq", "segment_id", "action", "trim_start_ms", "trim_end_ms", *optional)
        .join(pieces, ["job_id", "seq"], "left")
        .select(
            "job_id",
            "seq",
            "segment_id",
            F.when(cut, "keep").otherwise(F.col("action")).alias("action"),
            F.when(cut, F.col("_from")).otherwise(F.col("trim_start_ms")).alias("trim_start_ms"),
            F.when(cut, F.col("_to")).otherwise(F.col("trim_end_ms")).alias("trim_end_ms"),
            *optional,
        )
    )


def pick_takes(decisions: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions with the losing takes cut out, log of all takes)."""
    log = materialize(score_takes(decisions, segments), "take-log")
    return remove_spans(decisions, segments, log.filter("NOT kept")), log
