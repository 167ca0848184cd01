"""Token counts of whole texts through a cache keyed by content and tokenizer digests.

``token_counts`` looks every text's SHA-256 up in a stored table of (tokenizer digest, content digest, count).
Only distinct texts that the table lacks are encoded, and their counts are appended to it, so that a second
corpus with the same pages costs a join of narrow rows.

* Texts move only for misses: their representatives are joined back by row id. Spark broadcasts that side if
  it is small (all or nearly all texts known) and shuffles by the unique row id otherwise, so copies never meet.
* An append that is repeated after a failure can leave a digest twice in the cache; both rows hold the same count,
  and reading groups them.

Nulls and empty texts count 0 tokens; a row with a null id is counted like any other; repeated rows stay repeated.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliploom.llm.common import map_slices, materialize, once, whole

CACHE = T.StructType(
    [T.StructField("tokenizer", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("n_tokens", T.LongType())]
)


def tokenizer_digest(data: bytes) -> str:
    """The version of a tokenizer is the digest of its file."""
    return hashlib.sha256(data).hexdigest()


def counter(data: bytes, kind: str):
    """A function from texts to token counts for the file's bytes; ``kind`` is 'json' or 'model'."""
    if kind == "json":
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_buffer(data)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_proto=data)
    return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]


def _cached(spark, cache_dir: str, version: str) -> DataFrame:
    """Counts stored for one tokenizer version, one row per digest."""
    known = spark.read.schema(CACHE).parquet(cache_dir).where(F.col("tokenizer") == version)
    return known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer_file: str, cache_dir: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, n_bytes, n_tokens) for every row of ``docs``; new counts are appended to ``cache_dir``."""
    spark = docs.sparkSession
    with open(tokenizer_file, "rb") as f:
        data = f.read()
    kind = "model" if tokenizer_file.endswith(".model") else "json"
    version = tokenizer_digest(data)
    text = whole(text_col)
    rows = docs.select(F.col(id_col), F.sha2(text.cast("binary"), 256).alias("digest"), text.alias("_text"))
    narrow = materialize(
        rows.select(id_col, "digest", F.octet_length("_text").cast("long").alias("n_bytes")), "content-digests"
    )
    # The cache begins as an empty table, so that the first run reads like every other.
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache_dir)
    misses = (
        narrow.groupBy("digest")
        .agg(F.min(id_col).alias("_id"))
        .join(_cached(spark, cache_dir, version), "digest", "left_anti")
        .withColumnRenamed("digest", "_digest")
    )
    todo = rows.join(misses, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))).select("digest", "_text")

    def make():
        count = once(("counter", version), lambda: counter(data, kind))

        def run(texts: list) -> dict:
            # Rows that repeat with their id all match their representative's: once a slice.
            own = list(dict.fromkeys(texts))
            n = dict(zip(own, count(own), strict=True))
            return {"n_tokens": [n[t] for t in texts]}

        return run

    fresh = map_slices(todo, "_text", make, "n_tokens long", ["digest"], 500_000)
    fresh = fresh.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    fresh.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_dir)
    return narrow.join(_cached(spark, cache_dir, version), "digest").select(id_col, "digest", "n_bytes", "n_tokens")
