"""Sending batches of documents to a model function, with usage recorded per call."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliploom.operators.costs import price_calls
from cliploom.sources.scratch import materialize

ModelFn = Callable[[list[str]], Sequence[tuple[str, int, int]]]


def call_model(
    documents: DataFrame, keys: list[str], text: str, fn: ModelFn, provider: str, model: str, stage: str = "unknown"
) -> DataFrame:
    """Answers of ``fn`` for every document, with tokens, cost and the stage that asked.

    ``fn`` gets a list of texts and returns (content, input tokens, output tokens) for each.  It runs
    inside the tasks, one call per Arrow batch.  The answers are written once, so that a later
    branch never asks the model again.
    """
    schema = T.StructType(
        [documents.schema[k] for k in keys]
        + [
            T.StructField("content", T.StringType()),
            T.StructField("input_tokens", T.LongType()),
            T.StructField("output_tokens", T.LongType()),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers = fn(pdf[text].tolist())
            out = pdf[keys].copy()
            for i, c in enumerate(("content", "input_tokens", "output_tokens")):
                out[c] = [a[i] for a in answers]
            yield out

    calls = documents.select(*keys, text).mapInPandas(run, schema)
    calls = calls.withColumns({"provider": F.lit(provider), "model": F.lit(model), "stage": F.lit(stage)})
    return materialize(price_calls(calls), "answers")


def with_progress(df: DataFrame, stage: str, step: str) -> tuple[DataFrame, Observation]:
    """Count the rows and jobs passing a step as a side effect of running it."""
    seen = Observation(f"{stage}:{step}")
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("job_id").alias("jobs")), seen


LEDGER = "digest string, content string, input_tokens long, output_tokens long, error string, run string"


def _requests(texts: list[str], budget: int) -> Iterator[tuple[int, int]]:
    """Runs of texts (from, to) of at most ``budget`` tokens, four bytes taken as one; a longer text goes alone."""
    start = used = 0
    for i, t in enumerate(texts):
        size = -(-len(t.encode("utf-8", "surrogatepass")) // 4)
        if i > start and used + size > budget:
            yield start, i
            start, used = i, 0
        used += size
    if texts:
        yield start, len(texts)


def ask_once(
    documents: DataFrame, keys: list[str], text: str, fn: ModelFn, ledger: str, provider: str, model: str, budget: int = 8000, wave_rows: int = 100_000
) -> DataFrame:
    """Answers from a stored ledger; ``fn`` is asked only for distinct texts that the ledger lacks for this provider and model.

    Texts travel in requests of at most ``budget`` tokens.  What is asked is appended in waves of about ``wave_rows`` texts, so
    that a killed run loses the wave under way at most and the next run goes on after it.  A request that
    fails, or is answered for another number of texts, or a text answered by None, gives rows with ``error`` instead of a
    content; they are asked again by the next run.  A null text is an empty one.  Runs at the same time may both ask for a
    text; all readers then take the same one of its answers.

    Returns the keys, content, input_tokens, output_tokens and error.
    """
    spark = documents.sparkSession
    run = uuid.uuid4().hex
    said = F.coalesce(F.col(text), F.lit(""))
    asked_for = documents.select(*keys, F.sha2(F.concat_ws("\n", F.lit(provider), F.lit(model), said), 256).alias("_digest"), said.alias("_text"))
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(ledger)
    stored = lambda: spark.read.schema(LEDGER).parquet(ledger)
    wanted = asked_for.groupBy("_digest").agg(F.any_value("_text").alias("_text"))
    answered = stored().filter("error IS NULL").select(F.col("digest").alias("_digest"))
    # Pinned: what is missing must not change while the ledger grows.
    missing = materialize(wanted.join(answered, "_digest", "left_anti"), "unanswered")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, rows = pdf["_text"].tolist(), []
            for a, b in _requests(texts, budget):
                try:
                    got, error = list(fn(texts[a:b])), None
                    if len(got) != b - a:
                        error = f"{len(got)} answers to {b - a} texts"
                except Exception as e:  # noqa: BLE001 - whatever a provider's client raises becomes rows
                    error = f"{type(e).__name__}: {e}"
                if error:
                    got = [None] * (b - a)
                rows += [(*x, None) if x is not None else (None, None, None, error or "no answer") for x in got]
            out = pd.DataFrame(rows, columns=["content", "input_tokens", "output_tokens", "error"])
            out[["input_tokens", "output_tokens"]] = out[["input_tokens", "output_tokens"]].astype("Int64")
            yield out.assign(digest=pdf["_digest"].to_numpy(), run=run)[["digest", "content", "input_tokens", "output_tokens", "error", "run"]]

    waves = -(-missing.count() // wave_rows)
    for w in range(waves):
        part = missing.filter(F.pmod(F.xxhash64("_digest"), F.lit(waves)) == w)
        part.mapInPandas(ask, LEDGER).write.mode("append").parquet(ledger)
    known = stored().filter((F.col("error").isNull()) | (F.col("run") == run)).groupBy(F.col("digest").alias("_digest")).agg(
        F.min(F.when(F.col("error").isNull(), F.struct("content", "input_tokens", "output_tokens"))).alias("_a"), F.min("error").alias("_e")
    )
    out = asked_for.drop("_text").join(known, "_digest", "left")
    return out.select(*keys, "_a.content", "_a.input_tokens", "_a.output_tokens", F.when(F.col("_a").isNull(), F.col("_e")).alias("error"))
