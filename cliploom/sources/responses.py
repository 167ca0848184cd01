"""Model answers as text -> typed rows, with the lenient defaults of the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.functions.text import stripped

DECISION = (
    "struct<segmentId:string,action:string,reason:string,trimStart:double,trimEnd:double,transitionBefore:string>"
)
PLAN = f"struct<decisions:array<{DECISION}>,captionMode:string,transitionDefault:string>"
SCENE = (
    "struct<sceneId:string,description:string,sceneType:string,visualInterest:double,textOnScreen:string,cameraMotion:string>"
)
ENTITY = "struct<id:string,name:string,type:string,role:string,mentions:array<string>>"
TOPIC = "struct<id:string,label:string,segments:array<string>>"
MOMENT = "struct<segmentId:string,label:string,reason:string,recommendedForHighlight:string>"
ENHANCEMENT = "struct<segmentId:string,level:string,reason:string,enhancementType:string,confidence:double>"
SENTIMENT = "struct<time:double,sentiment:double,label:string>"
BROLL = "struct<afterSegmentId:string,suggestedContent:string,reason:string>"

# Arrays are exploded with the outer form, so that the optimizer does not copy the whole parse into a
# size filter below it.


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _cut(text: Column, opening: str, closing: str) -> Column:
    """From the first opening to the last closing bracket, or the text itself without such a part."""
    return F.coalesce(F.regexp_substr(text, F.lit(rf"(?s)\{opening}.*\{closing}")), text)


def is_json(text: Column) -> Column:
    """Is the text exactly one JSON value?  The parser ignores what follows a value, hence the wrapping."""
    in_list = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.coalesce(in_list.isNotNull() & in_object.isNotNull(), F.lit(False))


def repair_json(text: Column) -> Column:
    """Close a truncated answer: the last string, its object and list, then whatever brackets are still open.

    Truncation inside a string leaves an unclosed one behind and stays unreadable.
    """
    closed = F.regexp_replace(text, r'(?s)\A(.*"|)[^"}]*\z', "$1}]}")

    def open_count(c: Column, opening: str, closing: str) -> Column:
        n = F.regexp_count(c, F.lit(rf"\{opening}")) - F.regexp_count(c, F.lit(rf"\{closing}"))
        return F.greatest(n, F.lit(0))

    return _let(
        closed,
        lambda c: F.concat(
            c, F.repeat(F.lit("]"), open_count(c, "[", "]")), F.repeat(F.lit("}"), open_count(c, "{", "}"))
        ),
    )


def ingest_plans(responses: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(decisions, plans) from (keys..., content).

    ``plans.status`` is 'good', 'repaired' or 'failed'; failed plans go to the keep-everything
    fallback.  Trims that are not numbers are null; times are seconds in, milliseconds out.
    """
    keys = keys or ["job_id"]
    state = lambda text, status: F.struct(text.alias("text"), F.lit(status).alias("status"))
    repaired = lambda a: _let(
        repair_json(a), lambda b: F.when(is_json(b), state(b, "repaired")).otherwise(state(F.lit(None).cast("string"), "failed"))
    )
    read = _let(_cut(stripped(F.col("content")), "{", "}"), lambda a: F.when(is_json(a), state(a, "good")).otherwise(repaired(a)))
    d = responses.select(*keys, read.alias("r")).select(*keys, F.from_json("r.text", PLAN).alias("p"), F.col("r.status").alias("status"))
    plans = d.select(
        *keys,
        "status",
        F.when(F.col("status") != "failed", F.coalesce("p.captionMode", F.lit("none"))).otherwise("none").alias("caption_mode"),
        F.when(F.col("status") != "failed", F.coalesce("p.transitionDefault", F.lit("cut"))).otherwise("cut").alias("transition_default"),
        F.coalesce(F.array_size("p.decisions"), F.lit(0)).alias("n_decisions"),
    )
    rows = d.filter("status <> 'failed'").select(*keys, F.posexplode_outer("p.decisions").alias("ord", "x")).filter("x IS NOT NULL")
    ms = lambda c: F.floor(c * 1000 + F.lit(0.5)).cast("long")
    decisions = rows.select(
        *keys,
        "ord",
        F.coalesce("x.segmentId", F.lit("")).alias("segment_id"),
        F.coalesce("x.action", F.lit("keep")).alias("action"),
        F.coalesce("x.reason", F.lit("")).alias("reason"),
        ms(F.col("x.trimStart")).alias("trim_start_ms"),
        ms(F.col("x.trimEnd")).alias("trim_end_ms"),
        F.col("x.transitionBefore").alias("transition_before"),
    )
    return decisions, plans


# What stands in for answers that cannot be read.
FAILED_DESCRIPTION = "Analysis failed"
DEFAULT_SUMMARY = "Video analysis complete."


def _list_of(content: Column, item: str, key: str | None) -> Column:
    """The answer as an array of items: a bare array, or the array under ``key``."""
    text = F.when(is_json(content), content)
    bare = F.from_json(text, f"array<{item}>")
    is_list = stripped(text).startswith("[")
    if key is None:
        return F.when(is_list, bare)
    keyed = F.from_json(text, f"struct<{key}:array<{item}>>")[key]
    return F.when(is_list, bare).otherwise(keyed)


def _positions(mentions: str) -> Column:
    """The whole numbers of a list; what else it holds points at no segment."""
    number = lambda m: m.try_cast("double")
    return F.transform(F.filter(mentions, lambda m: number(m) == F.floor(number(m))), lambda m: number(m).cast("int"))


def parse_responses(df: DataFrame, kind: str) -> DataFrame:
    """Typed rows from (job_id, content) for one kind of question.

    'scenes' (also needs scene_ids, the scenes asked about), 'entities', 'topics', 'key_moments',
    'segment_updates', 'sentiment', 'broll', 'pacing', 'enhancements'.  Unreadable answers give no
    rows, except for 'scenes', where every scene asked about gets a fallback row.
    """
    c = F.col("content")
    if kind == "scenes":
        d = df.select("job_id", "scene_ids", _cut(stripped(c), "[", "]").alias("t"))
        d = d.withColumn("_ok", is_json(F.col("t")))
        arr = F.from_json("t", f"array<{SCENE}>")
        one = F.array(F.from_json("t", SCENE))
        good = d.filter("_ok").select(
            "job_id", F.posexplode_outer(F.when(stripped(F.col("t")).startswith("["), arr).otherwise(one)).alias("ord", "x")
        ).filter("ord IS NOT NULL")
        good = good.select(
            "job_id",
            "ord",
            F.coalesce("x.sceneId", F.lit("")).alias("scene_id"),
            F.coalesce("x.description", F.lit("")).alias("visual_description"),
            F.coalesce("x.sceneType", F.lit("other")).alias("scene_type"),
            F.coalesce("x.visualInterest", F.lit(3.0)).alias("visual_interest"),
            F.col("x.textOnScreen").alias("text_on_screen"),
            F.col("x.cameraMotion").alias("camera_motion"),
        )
        bad = d.filter("NOT _ok").select("job_id", F.posexplode_outer("scene_ids").alias("ord", "scene_id")).filter("ord IS NOT NULL").select(
            "job_id",
            "ord",
            "scene_id",
            F.lit(FAILED_DESCRIPTION).alias("visual_description"),
            F.lit("other").alias("scene_type"),
            F.lit(2.0).alias("visual_interest"),
            F.lit(None).cast("string").alias("text_on_screen"),
            F.lit(None).cast("string").alias("camera_motion"),
        )
        return good.unionByName(bad)
    if kind == "entities":
        rows = df.select("job_id", F.posexplode_outer(_list_of(c, ENTITY, "entities")).alias("ord", "x")).filter("ord IS NOT NULL")
        return rows.select("job_id", "ord", F.col("x.id").alias("entity_id"), "x.name", "x.type", "x.role", _positions("x.mentions").alias("mentions"))
    if kind == "topics":
        rows = df.select("job_id", F.posexplode_outer(F.from_json(F.when(is_json(c), c), f"struct<topics:array<{TOPIC}>>")["topics"]).alias("ord", "x")).filter("ord IS NOT NULL")
        return rows.select("job_id", "ord", F.col("x.id").alias("topic_id"), "x.label", "x.segments")
    if kind == "key_moments":
        rows = df.select("job_id", F.posexplode_outer(F.from_json(F.when(is_json(c), c), f"struct<keyMoments:array<{MOMENT}>>")["keyMoments"]).alias("ord", "x")).filter("ord IS NOT NULL")
        flag = F.col("x.recommendedForHighlight")
        return rows.select(
            "job_id",
            "ord",
            F.coalesce("x.segmentId", F.lit("")).alias("segment_id"),
            F.coalesce("x.label", F.lit("")).alias("label"),
            F.coalesce("x.reason", F.lit("")).alias("reason"),
            F.coalesce(~flag.isin("", "false", "0"), F.lit(False)).alias("highlight"),
        )
    if kind == "segment_updates":
        text = F.when(is_json(c), c)
        rows = df.select("job_id", F.posexplode_outer(F.from_json(text, "struct<segmentUpdates:array<map<string,string>>>")["segmentUpdates"]).alias("ord", "m")).filter("ord IS NOT NULL")
        return rows.select("job_id", "ord", F.to_json("m", {"ignoreNullFields": "false"}).alias("update"))
    if kind in ("sentiment", "broll", "pacing"):
        key, item = {"sentiment": ("sentiment", SENTIMENT), "broll": ("bRollOpportunities", BROLL), "pacing": ("pacingRecommendations", "string")}[kind]
        rows = df.select("job_id", F.posexplode_outer(F.from_json(F.when(is_json(c), c), f"struct<{key}:array<{item}>>")[key]).alias("ord", "x")).filter("ord IS NOT NULL")
        if kind == "pacing":
            return rows.select("job_id", "ord", F.col("x").alias("recommendation"))
        return rows.select("job_id", "ord", "x.*")
    if kind == "enhancements":
        rows = df.select("job_id", F.posexplode_outer(_list_of(c, ENHANCEMENT, None)).alias("ord", "x")).filter("ord IS NOT NULL")
        return rows.select(
            "job_id",
            "ord",
            F.coalesce("x.segmentId", F.lit("")).alias("segment_id"),
            F.coalesce("x.level", F.lit("standard")).alias("level"),
            F.coalesce("x.reason", F.lit("not_needed")).alias("reason"),
            F.col("x.enhancementType").alias("enhancement_type"),
            F.coalesce("x.confidence", F.lit(0.5)).alias("confidence"),
        )
    raise ValueError(f"unknown kind {kind!r}")


def parse_summaries(df: DataFrame) -> DataFrame:
    """Summary text per job, or the standard one where the answer cannot be read."""
    text = F.when(is_json(F.col("content")), F.col("content"))
    return df.select(
        "job_id", F.coalesce(F.from_json(text, "struct<summary:string>")["summary"], F.lit(DEFAULT_SUMMARY)).alias("summary")
    )
