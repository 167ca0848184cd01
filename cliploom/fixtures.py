"""Input tables of the operators, derived from the supplied parquet tables.

Each table exists twice: as a Spark job (block-wise along a job, so no job is numbered in one task)
and as the DuckDB common table expression the oracles start from.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cliploom.functions.text import numbered
from cliploom.operators.blocks import running, seq_block
from cliploom.sources.scratch import materialize


_stored: dict[tuple[str, str, str], DataFrame] = {}


def stored(fn):
    """Derive a table once per application and data folder, then read the written copy."""

    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, fn.__qualname__)
        if key not in _stored:
            _stored[key] = materialize(fn(spark, sf_dir), fn.__name__)
        return _stored[key]

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turn_words(placed: DataFrame, stop) -> DataFrame:
    """One row per word ``text`` at place ``i`` of its turn; ``_ended`` counts the sentences of the turn that end before it.

    A turn with words is cut into its sentences and these into words, all on one row.  Only the words of turns that share their number
    are brought together, since they are counted in one order.
    """
    alone = ~(F.col("_before").eqNullSafe(F.struct("turn")) | F.col("_after").eqNullSafe(F.struct("turn")))
    columns = ["job_id", "turn", F.col("role").alias("speaker"), "_words", "_sents"]
    # Where sentences end: after each stop, and at the end of the turn if words are left.
    ends = F.array_compact(F.transform("ws", lambda w, k: F.when((k + 1 == F.col("_n")) | stop(w), k + 1)))
    single = placed.filter(alone).select(*columns, "ws", ends.alias("_ends"))
    single = single.select("*", F.posexplode("_ends").alias("_ended", "_to"))
    single = single.withColumn("_from", F.when(F.col("_ended") > 0, F.get("_ends", F.col("_ended") - 1)).otherwise(0))
    single = single.select("job_id", "turn", "speaker", "_words", "_sents", "_ended", "_from", F.slice("ws", F.col("_from") + 1, F.col("_to") - F.col("_from")).alias("_said"))
    single = single.select("job_id", "turn", "speaker", "_words", "_sents", "_ended", "_from", F.posexplode("_said").alias("_at", "text"))
    single = single.select("job_id", "turn", "speaker", "_words", "_sents", "_ended", (F.col("_from") + F.col("_at")).alias("i"), "text")
    several = placed.filter(~alone).select(*columns, F.posexplode("ws").alias("i", "text"))
    in_turn = Window.partitionBy("job_id", "turn").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.sum(stop(F.col("text")).cast("int")).over(in_turn), F.lit(0))
    return single.unionByName(several.withColumn("_ended", ended))


@stored
def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    # Words with one space between them. Counts come from the text, so that the shuffle below carries no arrays.
    said = F.trim(F.regexp_replace("text", "[ \\n\\t\\r]+", " "))
    stop = lambda z: F.right(z, F.lit(1)).isin(".", "!", "?")
    turns = conv.select(F.col("conv_id").alias("job_id"), "turn", "role", said.alias("said"))
    n = F.when(F.col("said") == "", 0).otherwise(F.length("said") - F.length(F.replace("said", F.lit(" "), F.lit(""))) + 1)
    turns = turns.select("*", n.alias("_n"), F.regexp_count("said", F.lit(r"[.!?](?= |\z)")).alias("_s"))
    here = F.struct("turn")  # a struct, so that a neighbour without a number differs from no neighbour
    placed = running(
        turns, ["job_id"], ["turn"], seq_block("turn", 10_000),
        sums={"_words": F.col("_n"), "_sents": F.col("_s")}, prev={"_before": here}, following={"_after": here},
    )
    rows = _turn_words(placed.filter("_n > 0").withColumn("ws", F.split("said", " ")), stop)
    rows = rows.withColumn("sents", F.col("_sents") + F.col("_ended")).withColumn("seq", (F.col("_words") + F.col("i")).cast("long"))
    start = (400 * F.col("seq") + 1300 * F.col("sents") + 2500 * F.col("turn")).cast("long")
    conf = ((F.col("seq") * 37 + F.col("turn") * 11 + F.col("job_id") * 7) % 100).cast("double") / 100
    return rows.select(
        F.col("job_id").cast("long").alias("job_id"),
        "seq",
        "text",
        "speaker",
        "turn",
        start.alias("start_ms"),
        (start + F.when(F.col("seq") % 13 == 12, 0).otherwise(250)).cast("long").alias("end_ms"),
        F.when(F.col("seq") % 17 != 16, conf).alias("confidence"),
    )


@stored
def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        words(spark, sf_dir)
        .groupBy("job_id", F.col("turn").alias("seq"))
        .agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("_end"))
        .select(
            "job_id",
            "seq",
            numbered("scene_", F.col("seq") + 1).alias("scene_id"),
            "start_ms",
            (F.col("_end") - F.when(F.col("seq") % 5 == 4, 100).otherwise(0)).alias("end_ms"),
        )
    )


@stored
def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id")
    n = running(ev, ["job_id"], ["event_id"], seq_block("event_id"), sums={"_b": F.lit(1)})
    n = n.select("job_id", (F.col("_b") + 1).cast("long").alias("n"))
    hi = ((F.col("job_id") * 7 + F.floor((F.col("n") - 1) / 12)) * 2654435761 + (F.col("n") % 4) * 1048577) % 4294967296
    lo = ((F.col("job_id") * 11 + F.floor((F.col("n") - 1) / 6) * 3) * 2246822519) % 4294967296
    return n.select(
        "job_id",
        F.col("n").alias("frame_number"),
        ((F.col("n") - 1) * 1000).alias("ts_ms"),
        F.when(F.col("n") % 41 != 0, hi.cast("long")).alias("phash_hi"),
        F.when(F.col("n") % 41 != 0, lo.cast("long")).alias("phash_lo"),
    )


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = (
        table(spark, sf_dir, "conversations")
        .select(F.col("conv_id").alias("job_id"))
        .union(table(spark, sf_dir, "events").select("user_id"))
        .distinct()
    )
    j = F.col("job_id")
    return ids.select(
        "job_id",
        F.when(j % 3 == 0, 30).when(j % 3 == 1, 25).otherwise(24).alias("fps"),
        F.when(j % 29 == 28, 0).otherwise(1920).alias("width"),
        F.lit(1080).alias("height"),
        F.when(j % 4 != 0, F.lit(-14.0) - (j % 12).cast("double")).alias("input_i"),
    )


@stored
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One segment per document; after that of every eighth one, a silent segment of the same length."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.explode(F.when(d % 8 == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("silent"),
        (d % 20).alias("job_id"),
        (2000 + (F.col("n_chars") * 20) % 45000).alias("dur"),
        F.col("text").alias("transcript"),
        "source",
    )
    c = running(docs, ["job_id"], ["doc_id", "silent"], seq_block("doc_id"), sums={"seq": F.lit(1), "s0": F.col("dur")})
    said = (
        F.when(F.col("silent"), "")
        .when(d % 11 == 3, F.concat(F.lit("Let me explain. "), F.col("transcript")))
        .otherwise(F.col("transcript"))
    )
    kinds = ["interview", "action", "screenrec", "b-roll", "title", "other"]
    scene_type = F.when(F.lit(False), F.lit(""))
    for i, k in enumerate(kinds):
        scene_type = scene_type.when(d % 7 == i, k)
    return c.select(
        "job_id",
        F.col("seq").cast("long").alias("seq"),
        numbered("seg_", F.col("seq")).alias("segment_id"),
        (F.col("s0") - F.when(F.col("seq") % 23 == 22, 500).otherwise(0)).cast("long").alias("start_ms"),
        (F.col("s0") + F.col("dur")).cast("long").alias("end_ms"),
        said.alias("transcript"),
        (((d * 13) % 100).cast("double") / 100).alias("energy"),
        scene_type.alias("scene_type"),
        (d % 5 + 1).cast("long").alias("visual_interest"),
        F.when(d % 9 == 2, F.concat(F.lit("Menu "), F.col("source"))).alias("text_on_screen"),
        F.when(d % 6 == 0, "A bar chart on a whiteboard")
        .when(d % 6 == 1, "Two people talking")
        .when(d % 6 == 2, "Unstable street shot")
        .alias("visual_description"),
        F.when(d % 4 == 0, "static").when(d % 4 == 1, "handheld shake").when(d % 4 == 2, "pan").alias("camera_motion"),
        F.col("silent").alias("is_silent"),
        (d % 10 == 0).alias("is_blurry"),
    )


def decisions_for(segs: DataFrame) -> DataFrame:
    """One edit decision per segment: keep, trim or remove, with some bad trims and dangling ids."""
    kind = (F.col("seq") * 7 + F.col("job_id")) % 5
    return segs.select(
        "job_id",
        "seq",
        F.when(F.col("seq") % 31 == 30, "seg_missing").otherwise(F.col("segment_id")).alias("segment_id"),
        F.when(kind == 0, "remove").when(kind == 1, "trim").otherwise("keep").alias("action"),
        F.when(kind == 1, F.col("start_ms") + 700 * (F.col("seq") % 3) - 500).alias("trim_start_ms"),
        F.when(
            kind == 1,
            F.when(F.col("seq") % 6 == 5, F.col("start_ms") - 1000).otherwise(F.col("end_ms") + 400 - 300 * (F.col("seq") % 4)),
        ).alias("trim_end_ms"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions_for(segments(spark, sf_dir))


def plan_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.col("job_id")
    return decisions(spark, sf_dir).select(
        "job_id",
        "seq",
        F.when(j % 10 == 9, "sorry, no plan")
        .when(
            j % 10 == 7,
            F.concat(
                F.lit('{"decisions":[{"segmentId":"'), "segment_id", F.lit('","action":"'), "action", F.lit('","reason":"cut sho')
            ),
        )
        .otherwise(
            F.concat(
                F.lit('Here you go: {"decisions":[{"segmentId":"'),
                "segment_id",
                F.lit('","action":"'),
                "action",
                F.lit('","reason":"r", "trimStart":null}],"captionMode":"standard"} bye'),
            )
        )
        .alias("content"),
    )


def llm_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    models = [
        "claude-sonnet-4-20250514",
        "gpt-4o",
        "gemini-1.5-flash",
        "claude-haiku-4-5-20251001",
        "unknown-model",
        "gemini-1.5-pro",
    ]
    model = F.when(F.lit(False), F.lit(""))
    for i, m in enumerate(models):
        model = model.when(e % 6 == i, m)
    return table(spark, sf_dir, "events").select(
        e.alias("call_id"),
        F.col("user_id").alias("job_id"),
        "ts",
        F.when(e % 3 == 0, "anthropic").when(e % 3 == 1, "openai").otherwise("gemini").alias("provider"),
        model.alias("model"),
        F.when(F.col("event_type") == "click", "edit")
        .when(F.col("event_type") == "view", "understand")
        .when(F.col("event_type") == "purchase", "enhance")
        .otherwise("unknown")
        .alias("stage"),
        (100 + (e * 31) % 5000).cast("long").alias("input_tokens"),
        (10 + (e * 17) % 900).cast("long").alias("output_tokens"),
    )


# The fourteen job states.
STATES = [
    "created", "ingesting", "ingest_done", "ingest_failed", "understanding", "understand_done", "understand_failed",
    "editing", "edit_done", "edit_failed", "rendering", "render_done", "render_failed", "cancelled",
]
WALK = [
    "created", "ingesting", "ingest_done", "understanding", "understand_done", "editing", "edit_done", "rendering", "render_done",
]


def _pick(index, names):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_orderdate").alias("created_at"),
        _pick(F.col("o_orderkey") % 14, STATES).alias("state"),
        F.concat(F.lit("clip_"), F.col("o_custkey").cast("string"), F.lit(".mp4")).alias("source_file"),
    )


@stored
def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", "ts")
    n = running(ev, ["job_id"], ["event_id"], seq_block("event_id"), sums={"seq": F.lit(1)})
    step = (F.col("seq") + F.when(F.col("seq") % 7 == 6, 3).otherwise(0)) % 9
    return n.select("job_id", F.col("seq").cast("long").alias("seq"), "ts", _pick(step, WALK).alias("state"))


# --------------------------------------------------------------------------------------------
# The same tables for the oracles.
# --------------------------------------------------------------------------------------------

CTES: dict[str, tuple[tuple[str, ...], str]] = {}
CTES["words"] = ((), r"""
WITH b AS (
  SELECT conv_id AS job_id, turn, role,
    list_filter(string_split(regexp_replace(text, '[ \n\t\r]+', ' ', 'g'), ' '), lambda z: z <> '') AS ws FROM conversations),
x AS (SELECT job_id, turn, role, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM b),
n AS (
  SELECT job_id, turn, role, i, w,
    row_number() OVER (PARTITION BY job_id ORDER BY turn, i) - 1 AS seq,
    coalesce(sum(CASE WHEN right(w, 1) IN ('.', '!', '?') THEN 1 ELSE 0 END)
      OVER (PARTITION BY job_id ORDER BY turn, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sents
  FROM x)
SELECT CAST(job_id AS BIGINT) AS job_id, CAST(seq AS BIGINT) AS seq, w AS text, role AS speaker, turn,
  CAST(400 * seq + 1300 * sents + 2500 * turn AS BIGINT) AS start_ms,
  CAST(400 * seq + 1300 * sents + 2500 * turn + CASE WHEN seq % 13 = 12 THEN 0 ELSE 250 END AS BIGINT) AS end_ms,
  CASE WHEN seq % 17 = 16 THEN NULL ELSE CAST((seq * 37 + turn * 11 + job_id * 7) % 100 AS DOUBLE) / 100 END AS confidence
FROM n""")
CTES["scenes"] = (("words",), """
SELECT job_id, turn AS seq, printf('scene_%03d', turn + 1) AS scene_id,
  min(start_ms) AS start_ms,
  max(end_ms) - CASE WHEN turn % 5 = 4 THEN 100 ELSE 0 END AS end_ms
FROM words GROUP BY job_id, turn""")
CTES["frames"] = ((), """
WITH f AS (
  SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT job_id, CAST(n AS BIGINT) AS frame_number, CAST((n - 1) * 1000 AS BIGINT) AS ts_ms,
  CASE WHEN n % 41 = 0 THEN NULL ELSE CAST(((job_id * 7 + CAST(floor((n - 1) / 12.0) AS BIGINT)) * 2654435761
    + (n % 4) * 1048577) % 4294967296 AS BIGINT) END AS phash_hi,
  CASE WHEN n % 41 = 0 THEN NULL ELSE CAST(((job_id * 11 + CAST(floor((n - 1) / 6.0) AS BIGINT) * 3) * 2246822519)
    % 4294967296 AS BIGINT) END AS phash_lo
FROM f""")
CTES["media"] = ((), """
SELECT job_id, CASE job_id % 3 WHEN 0 THEN 30 WHEN 1 THEN 25 ELSE 24 END AS fps,
  CASE WHEN job_id % 29 = 28 THEN 0 ELSE 1920 END AS width, 1080 AS height,
  CASE WHEN job_id % 4 = 0 THEN NULL ELSE -14.0 - CAST(job_id % 12 AS DOUBLE) END AS input_i
FROM (SELECT DISTINCT conv_id AS job_id FROM conversations UNION SELECT DISTINCT user_id FROM events) j""")
CTES["segments"] = ((), """
WITH d AS (
  SELECT doc_id, silent, doc_id % 20 AS job_id, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY doc_id, silent) - 1 AS seq,
    2000 + (n_chars * 20) % 45000 AS dur, text AS transcript, source
  FROM (SELECT *, unnest(CASE WHEN doc_id % 8 = 0 THEN [false, true] ELSE [false] END) AS silent FROM documents)),
c AS (SELECT *, coalesce(sum(dur) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0 FROM d)
SELECT job_id, CAST(seq AS BIGINT) AS seq, printf('seg_%03d', seq) AS segment_id,
  CAST(s0 - CASE WHEN seq % 23 = 22 THEN 500 ELSE 0 END AS BIGINT) AS start_ms, CAST(s0 + dur AS BIGINT) AS end_ms,
  CASE WHEN silent THEN '' WHEN doc_id % 11 = 3 THEN concat('Let me explain. ', transcript) ELSE transcript END AS transcript,
  CAST((doc_id * 13) % 100 AS DOUBLE) / 100 AS energy,
  CASE doc_id % 7 WHEN 0 THEN 'interview' WHEN 1 THEN 'action' WHEN 2 THEN 'screenrec' WHEN 3 THEN 'b-roll' WHEN 4 THEN 'title' WHEN 5 THEN 'other' END AS scene_type,
  CAST(doc_id % 5 + 1 AS BIGINT) AS visual_interest,
  CASE WHEN doc_id % 9 = 2 THEN concat('Menu ', source) END AS text_on_screen,
  CASE doc_id % 6 WHEN 0 THEN 'A bar chart on a whiteboard' WHEN 1 THEN 'Two people talking' WHEN 2 THEN 'Unstable street shot' END AS visual_description,
  CASE doc_id % 4 WHEN 0 THEN 'static' WHEN 1 THEN 'handheld shake' WHEN 2 THEN 'pan' END AS camera_motion,
  silent AS is_silent, doc_id % 10 = 0 AS is_blurry
FROM c""")
_DECISIONS = """
SELECT job_id, seq, CASE WHEN seq % 31 = 30 THEN 'seg_missing' ELSE segment_id END AS segment_id,
  CASE (seq * 7 + job_id) % 5 WHEN 0 THEN 'remove' WHEN 1 THEN 'trim' ELSE 'keep' END AS action,
  CASE WHEN (seq * 7 + job_id) % 5 = 1 THEN start_ms + 700 * (seq % 3) - 500 END AS trim_start_ms,
  CASE WHEN (seq * 7 + job_id) % 5 = 1 THEN CASE WHEN seq % 6 = 5 THEN start_ms - 1000 ELSE end_ms + 400 - 300 * (seq % 4) END END AS trim_end_ms
FROM """
CTES["decisions"] = (("segments",), _DECISIONS + "segments")
CTES["plan_responses"] = (("decisions",), """
SELECT job_id, seq, CASE
  WHEN job_id % 10 = 9 THEN 'sorry, no plan'
  WHEN job_id % 10 = 7 THEN concat('{"decisions":[{"segmentId":"', segment_id, '","action":"', action, '","reason":"cut sho')
  ELSE concat('Here you go: {"decisions":[{"segmentId":"', segment_id, '","action":"', action, '","reason":"r", "trimStart":null}],"captionMode":"standard"} bye') END AS content
FROM decisions""")
CTES["llm_calls"] = ((), """
SELECT event_id AS call_id, user_id AS job_id, ts,
  CASE event_id % 3 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai' ELSE 'gemini' END AS provider,
  CASE event_id % 6 WHEN 0 THEN 'claude-sonnet-4-20250514' WHEN 1 THEN 'gpt-4o' WHEN 2 THEN 'gemini-1.5-flash'
    WHEN 3 THEN 'claude-haiku-4-5-20251001' WHEN 4 THEN 'unknown-model' ELSE 'gemini-1.5-pro' END AS model,
  CASE event_type WHEN 'click' THEN 'edit' WHEN 'view' THEN 'understand' WHEN 'purchase' THEN 'enhance' ELSE 'unknown' END AS stage,
  CAST(100 + (event_id * 31) % 5000 AS BIGINT) AS input_tokens, CAST(10 + (event_id * 17) % 900 AS BIGINT) AS output_tokens
FROM events""")
CTES["jobs"] = ((), """
SELECT o_orderkey AS job_id, o_orderdate AS created_at,
  CASE o_orderkey % 14 WHEN 0 THEN 'created' WHEN 1 THEN 'ingesting' WHEN 2 THEN 'ingest_done' WHEN 3 THEN 'ingest_failed'
    WHEN 4 THEN 'understanding' WHEN 5 THEN 'understand_done' WHEN 6 THEN 'understand_failed' WHEN 7 THEN 'editing'
    WHEN 8 THEN 'edit_done' WHEN 9 THEN 'edit_failed' WHEN 10 THEN 'rendering' WHEN 11 THEN 'render_done'
    WHEN 12 THEN 'render_failed' ELSE 'cancelled' END AS state,
  concat('clip_', CAST(o_custkey AS VARCHAR), '.mp4') AS source_file
FROM orders""")
CTES["job_events"] = ((), """
WITH e AS (SELECT user_id AS job_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events)
SELECT job_id, CAST(seq AS BIGINT) AS seq, ts,
  CASE (CASE WHEN seq % 7 = 6 THEN seq + 3 ELSE seq END) % 9 WHEN 0 THEN 'created' WHEN 1 THEN 'ingesting' WHEN 2 THEN 'ingest_done'
    WHEN 3 THEN 'understanding' WHEN 4 THEN 'understand_done' WHEN 5 THEN 'editing' WHEN 6 THEN 'edit_done'
    WHEN 7 THEN 'rendering' ELSE 'render_done' END AS state
FROM e""")


def with_tables(*names: str, recursive: bool = False) -> str:
    """'WITH a AS (...), b AS (...)' for the named tables and what they read."""
    order: list[str] = []

    def add(n: str) -> None:
        for dep in CTES[n][0]:
            add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order)
