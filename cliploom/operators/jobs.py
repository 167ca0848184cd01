"""Job lifecycle: transitions, listing, updates, manifests, retention."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.operators.blocks import running, seq_block

# States that may follow each state.
NEXT_STATES = {
    "created": ["ingesting", "cancelled"],
    "ingesting": ["ingest_done", "ingest_failed", "cancelled"],
    "ingest_done": ["understanding", "cancelled"],
    "ingest_failed": [],
    "understanding": ["understand_done", "understand_failed", "cancelled"],
    "understand_done": ["editing", "cancelled"],
    "understand_failed": [],
    "editing": ["edit_done", "edit_failed", "cancelled"],
    "edit_done": ["rendering", "editing", "cancelled"],
    "edit_failed": [],
    "rendering": ["render_done", "render_failed", "cancelled"],
    "render_done": ["editing", "cancelled"],
    "render_failed": [],
    "cancelled": [],
}
# States that count as final although render_done may be edited again.
LISTED_TERMINAL = ["render_done", "ingest_failed", "understand_failed", "edit_failed", "render_failed", "cancelled"]
ACTIVE = ["ingesting", "understanding", "editing", "rendering"]
# States a batch clean-up may remove.
CLEANABLE = [
    "render_done", "ingest_done", "understand_done", "edit_done", "ingest_failed", "understand_failed", "edit_failed",
    "render_failed", "cancelled", "created",
]


def state_table(spark: SparkSession) -> DataFrame:
    """Per state: what may follow, and whether it is terminal (no way out / listed as final)."""
    rows = [(s, sorted(n), not n, s in LISTED_TERMINAL) for s, n in NEXT_STATES.items()]
    return spark.createDataFrame(rows, "state string, next_states array<string>, is_terminal boolean, listed_terminal boolean")


def event_type(state: Column) -> Column:
    return (
        F.when(state == "cancelled", "job.cancelled")
        .when(state.endswith("_failed"), "stage.failed")
        .when(state.endswith("_done"), "stage.completed")
        .otherwise("stage.started")
    )


def is_legal(prev: Column, state: Column) -> Column:
    """May ``state`` follow ``prev``?  Kept as an expression: 14 states, 21 moves."""
    ok = F.lit(False)
    for s, following in NEXT_STATES.items():
        if following:
            ok = ok | ((prev == s) & state.isin(*following))
    return ok


def audit_transitions(events: DataFrame) -> DataFrame:
    """Every event with its previous state and whether the move is allowed; first events have none."""
    e = events.select("job_id", "seq", "state")
    p = running(e, ["job_id"], ["seq"], seq_block("seq"), prev={"prev_state": F.col("state")})
    return p.select(
        "job_id",
        "seq",
        "prev_state",
        "state",
        F.when(F.col("prev_state").isNull(), True).otherwise(is_legal(F.col("prev_state"), F.col("state"))).alias("legal"),
        event_type(F.col("state")).alias("event_type"),
    )


def current_states(events: DataFrame) -> DataFrame:
    """Last state of every job, what may follow, and whether it is terminal."""
    last = events.groupBy("job_id").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("last_seq"))
    t = state_table(events.sparkSession)
    return last.join(F.broadcast(t), "state", "left").select(
        "job_id", "state", "last_seq", F.array_join("next_states", ",").alias("next_states"), "is_terminal", "listed_terminal"
    )


def apply_transitions(jobs: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(moved jobs, rejected requests) for requests (job_id, target_state, detail, at).

    A move into a failed state stores the detail as error; other moves keep the old error.
    """
    j = jobs.join(targets, "job_id")
    ok = is_legal(F.col("state"), F.col("target_state"))
    moved = j.filter(ok).select(
        *[
            {
                "state": F.col("target_state").alias("state"),
                "updated_at": F.col("at").alias("updated_at"),
                "error": F.when(F.col("target_state").endswith("_failed"), F.col("detail")).otherwise(F.col("error")).alias("error"),
            }.get(c, F.col(c))
            for c in jobs.columns
        ]
    )
    return moved, j.filter(~ok).select("job_id", "state", "target_state")


def job_counts(jobs: DataFrame, strict: bool = False) -> DataFrame:
    """Total, running, done and failed jobs.

    Running means the state contains 'ing', as the dashboard counts it; ``strict`` uses the four
    active states.
    """
    running_ = F.col("state").isin(*ACTIVE) if strict else F.col("state").contains("ing")
    return jobs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(running_).alias("running"),
        F.count_if(F.col("state") == "render_done").alias("done"),
        F.count_if(F.col("state").contains("failed")).alias("failed"),
    )


def newest_first(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), "job_id")


def newest(jobs: DataFrame, n: int) -> DataFrame:
    """The n most recent jobs."""
    return newest_first(jobs).limit(n)


def apply_job_updates(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """Merge partial updates into jobs, the latest value of each field last; drop deleted jobs.

    ``updates``: job_id, ord, at, deleted, and any job columns (null = not part of the update).
    Identity, folder and creation time never change; updated_at becomes the time of the last update.
    Updates and deletes of unknown jobs do nothing.
    """
    fixed = {"job_id", "job_dir", "created_at", "updated_at"}
    fields = [c for c in jobs.columns if c not in fixed and c in updates.columns]
    per = updates.groupBy("job_id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(f"_u_{c}") for c in fields],
        F.max_by("at", F.when(~F.coalesce("deleted", F.lit(False)), F.col("ord"))).alias("_at"),
        F.bool_or(F.coalesce("deleted", F.lit(False))).alias("_gone"),
    )
    j = jobs.join(per, "job_id", "left").filter(~F.coalesce("_gone", F.lit(False)))
    out = []
    for c in jobs.columns:
        if c in fields:
            out.append(F.coalesce(f"_u_{c}", c).alias(c))
        elif c == "updated_at":
            out.append(F.coalesce("_at", c).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


# Fixed value: policy version written into every manifest.
POLICY_VERSION = "2026-04-11.1"


def run_manifests(jobs: DataFrame, costs: DataFrame) -> DataFrame:
    """One manifest per job with its costs (cost_rollup) and the release decision."""
    done = F.col("state") == "render_done"
    none = F.lit(0.0)
    return jobs.join(costs.select("job_id", "total_usd", "by_stage", "by_provider"), "job_id", "left").select(
        "job_id",
        "state",
        F.lit(POLICY_VERSION).alias("policy_version"),
        F.col("source_file").alias("source_filename"),
        F.when(done, "pass").otherwise("pending").alias("render_validation"),
        F.when(done, "released").otherwise("held").alias("release_status"),
        F.when(done, F.lit("pipeline_complete")).otherwise(F.concat(F.lit("stopped_at_"), "state")).alias("release_reason"),
        F.coalesce("total_usd", none).alias("total_usd"),
        F.coalesce(F.to_json("by_stage"), F.lit("{}")).alias("by_stage"),
        F.coalesce(F.to_json("by_provider"), F.lit("{}")).alias("by_provider"),
    )


def merge_manifests(manifests: DataFrame, partial: DataFrame) -> DataFrame:
    """Shallow update: a non-null top-level field of ``partial`` (one row per job) replaces the stored one."""
    p = partial.select("job_id", *[F.col(c).alias(f"_p_{c}") for c in partial.columns if c != "job_id"])
    return manifests.join(p, "job_id", "left").select(
        *[F.coalesce(f"_p_{c}", c).alias(c) if c in partial.columns and c != "job_id" else F.col(c) for c in manifests.columns]
    )


def stored_files(spark: SparkSession, root: str) -> DataFrame:
    """(job_id, length) of every file below <root>/<job>/ or <root>/job_id=<job>/; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    own = F.regexp_replace("path", f"^.*?{re.escape(root.rstrip('/').rpartition('/')[2])}/", "")
    return files.select(F.regexp_replace(F.split_part(own, F.lit("/"), F.lit(1)), "^job_id=", "").alias("job_id"), "length")


def storage_use(files: DataFrame) -> DataFrame:
    """Bytes and files per job from (job_id, length)."""
    return files.groupBy("job_id").agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files"))


def retention_plan(
    jobs: DataFrame, files: DataFrame, mode: str = "cleanable", keep_latest: int = 0
) -> DataFrame:
    """Jobs a clean-up would remove and the bytes that frees.

    ``mode``: 'cleanable', 'failed' or 'all'.  ``keep_latest`` spares the newest of the *filtered* jobs.
    The spared ones are found with a top-n, so no global ranking is needed.
    """
    if mode == "all":
        chosen = jobs
    elif mode == "failed":
        chosen = jobs.filter(F.col("state").endswith("_failed") | (F.col("state") == "cancelled"))
    else:
        chosen = jobs.filter(F.col("state").isin(*CLEANABLE))
    if keep_latest > 0:
        chosen = chosen.join(newest(chosen, keep_latest).select("job_id"), "job_id", "left_anti")
    return chosen.join(storage_use(files), "job_id", "left").select(
        "job_id", "state", "source_file", "created_at", F.coalesce("bytes", F.lit(0)).cast("long").alias("freed_bytes")
    )
