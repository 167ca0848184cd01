"""Attach model answers to segments: scene descriptions, entities, topics, updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.operators.silence import first_segments

UPDATE_FIELDS = {
    "visual_description": ("visualDescription", False),
    "scene_type": ("sceneType", False),
    "visual_interest": ("visualInterest", False),
    "text_on_screen": ("textOnScreen", True),
    "camera_motion": ("cameraMotion", True),
}


def attach_descriptions(segments: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Give each scene description (job_id, ord, scene_id, ...) to the first segment of its scene.

    Of several descriptions of one scene the last counts.  All five visual fields are replaced.
    """
    fields = ["visual_description", "scene_type", "visual_interest", "text_on_screen", "camera_motion"]
    target = segments.groupBy("job_id", "scene_id").agg(F.min("seq").alias("seq"))
    last = descriptions.groupBy("job_id", "scene_id").agg(
        F.max_by(F.struct(*[F.col(c).alias(c) for c in fields]), "ord").alias("_d")
    )
    picked = target.join(last, ["job_id", "scene_id"]).select("job_id", "seq", "_d")
    hit = F.col("_d").isNotNull()
    return (
        segments.join(picked, ["job_id", "seq"], "left")
        .select(
            *[F.col(c) for c in segments.columns if c not in fields],
            *[
                F.when(hit, F.col(f"_d.{c}")).otherwise(F.col(c) if c in segments.columns else F.lit(None)).alias(c)
                for c in fields
            ],
        )
    )


def entity_mentions(entities: DataFrame) -> DataFrame:
    """One row per mention: entities (job_id, ord, entity_id, mentions array of segment positions)."""
    return entities.select("job_id", "ord", "entity_id", F.posexplode("mentions").alias("mention", "seq"))


def entity_screen_time(entities: DataFrame, segments: DataFrame) -> DataFrame:
    """Total duration of the mentioned segments per entity; repeats count, unknown positions add 0."""
    durations = segments.select("job_id", "seq", (F.col("end_ms") - F.col("start_ms")).alias("_d"))
    total = (
        entity_mentions(entities)
        .join(durations, ["job_id", "seq"])
        .groupBy("job_id", "ord")
        .agg(F.sum("_d").alias("_t"))
    )
    return (
        entities.join(total, ["job_id", "ord"], "left")
        .withColumn("total_screen_ms", F.coalesce("_t", F.lit(0)).cast("long"))
        .drop("_t")
    )


def entity_refs(entities: DataFrame, segments: DataFrame) -> DataFrame:
    """Entity ids per segment in the order they were pushed; a repeated mention repeats the id."""
    rows = entity_mentions(entities).join(segments.select("job_id", "seq", "segment_id"), ["job_id", "seq"])
    return rows.groupBy("job_id", "seq", "segment_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "mention", "entity_id"))), lambda x: x["entity_id"]).alias("entities")
    )


def topic_refs(topics: DataFrame) -> DataFrame:
    return topics.select("job_id", "ord", "topic_id", F.posexplode("segments").alias("mention", "segment_id"))


def topic_durations(topics: DataFrame, segments: DataFrame) -> DataFrame:
    """Total duration of the segments a topic lists by id; unknown ids add 0."""
    durations = first_segments(segments).select("job_id", "segment_id", (F.col("end_ms") - F.col("start_ms")).alias("_d"))
    total = (
        topic_refs(topics)
        .join(durations, ["job_id", "segment_id"])
        .groupBy("job_id", "ord")
        .agg(F.sum("_d").alias("_t"))
    )
    return (
        topics.join(total, ["job_id", "ord"], "left")
        .withColumn("total_duration_ms", F.coalesce("_t", F.lit(0)).cast("long"))
        .drop("_t")
    )


def segment_topics(topics: DataFrame, segments: DataFrame) -> DataFrame:
    """Topic ids per segment, in push order."""
    first = first_segments(segments).select("job_id", "segment_id", "seq")
    rows = topic_refs(topics).join(first, ["job_id", "segment_id"])
    return rows.groupBy("job_id", "seq", "segment_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "mention", "topic_id"))), lambda x: x["topic_id"]).alias("topics")
    )


def _taken(value: Column, old: Column, kind: str) -> Column:
    """The value in the column's type; a number is rounded half up, and what is no number leaves the old value."""
    if kind == "string":
        return value
    number = value.try_cast("double")
    return F.coalesce(number.try_cast(kind) if kind in ("double", "float") else F.floor(number + F.lit(0.5)).try_cast(kind), old)


def apply_updates(segments: DataFrame, updates: DataFrame) -> DataFrame:
    """Merge updates (job_id, ord, update: JSON object with an id) into segments, later ones last.

    Description, type and interest replace only with a non-empty value; screen text and camera motion
    replace whenever the key is present, also by null.
    """
    m = F.from_json("update", "map<string,string>")
    u = updates.select("job_id", "ord", m.alias("m")).withColumn("segment_id", F.col("m")["id"])

    def given(key: str, nullable: bool):
        if nullable:
            return F.map_contains_key("m", key)
        v = F.col("m")[key]
        some = v.isNotNull() & (v != "")
        return some & (v != "0") if key == "visualInterest" else some

    merged = u.groupBy("job_id", "segment_id").agg(
        *[
            F.max_by(F.struct(F.col("m")[key].alias("v")), F.when(given(key, nullable), F.col("ord"))).alias(f"_u_{col}")
            for col, (key, nullable) in UPDATE_FIELDS.items()
        ],
        *[F.max(F.when(given(key, nullable), F.lit(True))).alias(f"_g_{col}") for col, (key, nullable) in UPDATE_FIELDS.items()],
    )
    first = first_segments(segments).select("job_id", "segment_id", "seq")
    keyed = merged.join(first, ["job_id", "segment_id"]).drop("segment_id")
    joined = segments.join(keyed, ["job_id", "seq"], "left")
    types = dict(segments.dtypes)
    return joined.select(
        *[
            F.when(F.col(f"_g_{c}"), _taken(F.col(f"_u_{c}.v"), F.col(c), types[c])).otherwise(F.col(c)).alias(c) if c in UPDATE_FIELDS else F.col(c)
            for c in segments.columns
        ]
    )
