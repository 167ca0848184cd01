"""Reading the JSON files that media tools leave behind: transcripts, frames, scenes, probes, loudness logs.

``parse_*`` work on a table of texts, ``read_*`` on a folder of files named <job_id>/<anything>.json, and ``scan_*`` on the
same folder, where any file may be larger than a task can hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.functions.direction import TRANSCRIPT_RTL_LANGUAGES
from cliploom.functions.text import hash_half, js_round
from cliploom.operators.blocks import running, seq_block
from cliploom.sources.files import list_files, read_files
from cliploom.sources.items import SPLIT_BYTES, file_names, items_of
from cliploom.sources.responses import is_json

WORD = "struct<text:string,start:double,end:double,confidence:double,speaker:string>"
TRANSCRIPT = (
    f"struct<language:string,is_rtl:boolean,words:array<{WORD}>,"
    f"segments:array<struct<start:double,end:double,text:string,speaker:string,words:array<{WORD}>>>,speakers:array<string>>"
)
TRANSCRIPT_HEAD = "struct<language:string,is_rtl:boolean>"
FRAME = "struct<path:string,timestamp:double,frame_number:bigint,phash:string,is_duplicate:boolean>"
FRAMES = f"struct<frames:array<{FRAME}>>"
SCENE = "struct<id:string,start_time:double,end_time:double,start_frame:bigint,end_frame:bigint,duration:double>"
SCENES = f"struct<error:string,scenes:array<{SCENE}>>"
PROBE = (
    "struct<format:struct<duration:string,bit_rate:string>,streams:array<struct<codec_type:string,codec_name:string,"
    "width:int,height:int,r_frame_rate:string,bit_rate:string,channels:int,sample_rate:string>>>"
)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, part, payload): every file below ``path`` as one text.

    The folder names the job.  A long result may come in several files; the number at the end of the
    file name (frames_12.json) is its part, 0 without one.  Folders that Spark writes (job_id=7/part=12/...) work too.
    """
    job, part = file_names(F.col("path"))
    return read_files(list_files(spark, path), "detect").select(job.alias("job_id"), part.alias("part"), F.col("content").cast("string").alias("payload"))


def _ms(c):
    return js_round(c * 1000)


def parse_transcripts(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words, transcripts) from (job_id, part, payload).  ``seq`` runs over the parts of a job in order."""
    d = raw.select("job_id", "part", F.from_json("payload", TRANSCRIPT).alias("t"))
    sized = d.withColumn("_n", F.coalesce(F.array_size("t.words"), F.lit(0)))
    placed = running(sized.select("job_id", "part", "_n", F.col("t.words").alias("ws")), ["job_id"], ["part"], seq_block("part", 10_000), sums={"_off": F.col("_n")})
    words = placed.select("job_id", "_off", F.posexplode_outer("ws").alias("i", "w")).select("job_id", (F.col("_off") + F.col("i")).alias("seq"), "w")
    return _words(words), _transcript_heads(d)


def _words(rows: DataFrame) -> DataFrame:
    """Words from (job_id, seq, w)."""
    return rows.filter("w IS NOT NULL").select(
        "job_id",
        F.col("seq").cast("long").alias("seq"),
        F.col("w.text").alias("text"),
        F.col("w.speaker").alias("speaker"),
        _ms(F.col("w.start")).alias("start_ms"),
        _ms(F.col("w.end")).alias("end_ms"),
        F.col("w.confidence").alias("confidence"),
    )


def _transcript_heads(d: DataFrame) -> DataFrame:
    """Language and direction per job from (job_id, part, t): those of its first part."""
    lang = F.min_by("t.language", "part")
    heads = d.groupBy("job_id").agg(lang.alias("language"), F.min_by("t.is_rtl", "part").alias("_rtl"))
    return heads.select(
        "job_id",
        F.coalesce("language", F.lit("unknown")).alias("language"),
        F.coalesce("_rtl", F.col("language").isin(*TRANSCRIPT_RTL_LANGUAGES), F.lit(False)).alias("is_rtl"),
    )


def read_transcripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_transcripts(read_payloads(spark, path))


def scan_transcripts(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, jobs: list | None = None) -> tuple[DataFrame, DataFrame]:
    """``read_transcripts`` with many tasks per file; ``jobs`` leaves out the files of all others."""
    items, heads = items_of(list_files(spark, path), "words", split_bytes, jobs)
    words = items.select("job_id", "seq", F.from_json("value", WORD).alias("w"))
    return _words(words), _transcript_heads(heads.select("job_id", "part", F.from_json("head", TRANSCRIPT_HEAD).alias("t")))


def parse_frames(raw: DataFrame, fps: float = 1.0) -> DataFrame:
    """Frames with hash halves; a missing timestamp is (frame_number - 1) / fps."""
    return _frames(raw.select("job_id", F.explode_outer(F.from_json("payload", FRAMES)["frames"]).alias("f")), fps)


def _frames(rows: DataFrame, fps: float) -> DataFrame:
    f = rows.filter("f IS NOT NULL")
    at = F.coalesce("f.timestamp", F.round((F.col("f.frame_number") - 1) / F.lit(fps), 6))
    return f.select(
        "job_id",
        F.col("f.frame_number").alias("frame_number"),
        _ms(at).alias("ts_ms"),
        F.col("f.path").alias("path"),
        hash_half(F.col("f.phash"), 0).alias("phash_hi"),
        hash_half(F.col("f.phash"), 1).alias("phash_lo"),
        F.coalesce("f.is_duplicate", F.lit(False)).alias("is_duplicate"),
    )


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return parse_frames(read_payloads(spark, path))


def scan_frames(spark: SparkSession, path: str, fps: float = 1.0, split_bytes: int = SPLIT_BYTES, jobs: list | None = None) -> DataFrame:
    """``read_frames`` with many tasks per file."""
    items, _ = items_of(list_files(spark, path), "frames", split_bytes, jobs)
    return _frames(items.select("job_id", F.from_json("value", FRAME).alias("f")), fps)


def parse_scenes(raw: DataFrame, frames: DataFrame, media: DataFrame) -> DataFrame:
    """Scenes; a job whose detection failed (payload with 'error') gets one scene up to its last frame.

    A detection that worked and found nothing stays empty.  ``seq`` runs over the parts of a job.
    """
    d = raw.select("job_id", "part", F.from_json("payload", SCENES).alias("s"))
    sized = d.filter("s.error IS NULL").select("job_id", "part", F.coalesce(F.array_size("s.scenes"), F.lit(0)).alias("_n"), F.col("s.scenes").alias("xs"))
    placed = running(sized, ["job_id"], ["part"], seq_block("part", 10_000), sums={"_off": F.col("_n")})
    found = placed.select("job_id", "_off", F.posexplode_outer("xs").alias("i", "x")).select("job_id", (F.col("_off") + F.col("i")).alias("seq"), "x")
    return _scenes(found, d.filter("s.error IS NOT NULL"), frames, media)


def _scenes(rows: DataFrame, failed: DataFrame, frames: DataFrame, media: DataFrame) -> DataFrame:
    """Scenes from (job_id, seq, x), and one for each job of ``failed``."""
    found = rows.filter("x IS NOT NULL").select(
        "job_id",
        F.col("seq").cast("long").alias("seq"),
        F.col("x.id").alias("scene_id"),
        _ms(F.col("x.start_time")).alias("start_ms"),
        _ms(F.col("x.end_time")).alias("end_ms"),
        F.col("x.start_frame").alias("start_frame"),
        F.col("x.end_frame").alias("end_frame"),
    )
    last = frames.groupBy("job_id").agg(F.max_by("ts_ms", "frame_number").alias("_end"))
    failed = failed.select("job_id").distinct().join(last, "job_id", "left").join(
        media.select("job_id", "fps"), "job_id", "left"
    )
    end = F.coalesce("_end", F.lit(0)).cast("long")
    whole = failed.select(
        "job_id",
        F.lit(0).cast("long").alias("seq"),
        F.lit("scene_000").alias("scene_id"),
        F.lit(0).cast("long").alias("start_ms"),
        end.alias("end_ms"),
        F.lit(0).cast("long").alias("start_frame"),
        js_round(end.cast("double") * F.coalesce("fps", F.lit(30)).cast("double") / 1000.0).alias("end_frame"),
    )
    return found.unionByName(whole)


def read_scenes(spark: SparkSession, path: str, frames: DataFrame, media: DataFrame) -> DataFrame:
    return parse_scenes(read_payloads(spark, path), frames, media)


def scan_scenes(
    spark: SparkSession, path: str, frames: DataFrame, media: DataFrame, split_bytes: int = SPLIT_BYTES, jobs: list | None = None
) -> DataFrame:
    """``read_scenes`` with many tasks per file; a file that names an error has no scenes."""
    items, heads = items_of(list_files(spark, path), "scenes", split_bytes, jobs)
    failed = heads.withColumn("s", F.from_json("head", "struct<error:string>")).filter("s.error IS NOT NULL")
    good = items.join(failed.select("file").distinct(), "file", "left_anti")
    return _scenes(good.select("job_id", "seq", F.from_json("value", SCENE).alias("x")), failed, frames, media)


def _leading_int(c):
    return F.regexp_extract(c, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint")


def normalize_probe(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(media, rejected): first video and audio stream of each probe; no video stream is a reject."""
    p = raw.select("job_id", "payload", F.from_json("payload", PROBE).alias("p"))
    first = lambda kind: F.get(F.filter("p.streams", lambda s: s["codec_type"] == kind), F.lit(0))
    d = p.select("job_id", "payload", "p", first("video").alias("v"), first("audio").alias("a"))
    num = F.split_part("v.r_frame_rate", F.lit("/"), F.lit(1)).try_cast("double")
    den = F.split_part("v.r_frame_rate", F.lit("/"), F.lit(2)).try_cast("double")
    fps = F.when(F.coalesce("v.r_frame_rate", F.lit("")) == "", F.lit(0.0)).otherwise(
        F.when(den.isNull() | (den == 0), num).otherwise(num / den)
    )
    media = d.filter("v IS NOT NULL").select(
        "job_id",
        F.coalesce("v.width", F.lit(0)).alias("width"),
        F.coalesce("v.height", F.lit(0)).alias("height"),
        fps.alias("fps"),
        F.col("v.codec_name").alias("codec"),
        _leading_int(F.coalesce("p.format.bit_rate", "v.bit_rate", F.lit("0"))).alias("bitrate"),
        F.col("a").isNotNull().alias("has_audio"),
        F.col("a.codec_name").alias("audio_codec"),
        F.col("a.channels").alias("audio_channels"),
        F.when(F.col("a.sample_rate") != "", _leading_int(F.col("a.sample_rate"))).alias("audio_sample_rate"),
    )
    return media, d.filter("v IS NULL").select("job_id", "payload")


# Fixed value: the block of a log that holds the measurement.
LOUDNESS_BLOCK = r'\{[\s\S]*?"input_i"[\s\S]*?\}'
LOUDNESS = "struct<input_i:string,input_tp:string,input_lra:string,input_thresh:string>"


def parse_loudness(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(loudness, failed) from (job_id, log): the first {...} block that holds "input_i"."""
    block = F.regexp_extract("log", LOUDNESS_BLOCK, 0)
    d = logs.select("job_id", F.from_json(block, LOUDNESS).alias("l"), is_json(block).alias("_ok"))
    number = lambda c: F.regexp_extract(c, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double")
    good = d.filter("_ok").select("job_id", *[number(F.col(f"l.{c}")).alias(c) for c in ("input_i", "input_tp", "input_lra", "input_thresh")])
    return good, d.filter("NOT coalesce(_ok, false)").select("job_id")
