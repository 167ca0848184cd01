"""Boilerplate lines: lines that many distinct sites share.

Every line's hash gets a HyperLogLog sketch of its sites; sketches merge by aggregation, so a line that a third of all
documents carry is one small row per task. Where the estimate is near the threshold the sites are counted exactly, so the
decision is that of an exact count (unless an estimate is off by more than five standard errors).

A boilerplate line stays in the document with the smallest id that has it and goes from all others, so that copies of
one page on many sites do not vanish altogether. Lines shorter than ``min_chars`` after trimming repeat by chance and are
boilerplate from ``short_threshold`` sites on; blank lines never are.

Only hashes, ids and positions are grouped. Texts meet their list of dropped lines by the row's key, which is unique.

Defined results: a null text stays null and has no lines; an empty text has one (blank) line; texts of any number of lines take time in
proportion; columns named like the added counts make these take a longer name; null sites count as one
site; repeated rows are cut alike; a document may lose all lines and is then empty; an empty table stays empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import free, materialize

LG_K = 12


def _lines(text_col: str) -> Column:
    return F.split(F.col(text_col), "\n", -1)


def boilerplate(lines: DataFrame) -> DataFrame:
    """(line, first_id) for lines (line, need, site, id) with at least ``need`` distinct sites."""
    seen = lines.groupBy("line", "need").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min("id").alias("first_id"), F.min("site").alias("a"), F.max("site").alias("b"))
    # Two different sites are needed for any spread at all: no estimate for the many lines that have one.
    spread = seen.where((F.col("a") != F.col("b")) | (F.col("need") < 2))
    spread = materialize(spread.select("line", "need", "first_id", F.hll_sketch_estimate("sketch").alias("sites")), "line-spread")
    slack = 1 + F.col("need") * (5 * 1.04 / math.sqrt(2**LG_K))
    sure = spread.where(F.col("sites") > F.col("need") + slack).select("line", "first_id")
    near = spread.where(F.col("sites").between(F.col("need") - slack, F.col("need") + slack)).select("line", "need", "first_id")
    exact = lines.join(near.select("line"), "line", "left_semi").select("line", "site").distinct().groupBy("line").count()
    return sure.unionByName(near.join(exact, "line").where(F.col("count") >= F.col("need")).select("line", "first_id"))


def drop_boilerplate(
    docs: DataFrame, threshold: int = 5, min_chars: int = 20, short_threshold: int = 20, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", counts: bool = False,
) -> DataFrame:
    """``docs`` without other documents' boilerplate lines; ``counts`` adds ``_n_lines`` and ``_n_removed``."""
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    # The key comes before the lines part, or every line's row would carry the whole text to compute it.
    narrow = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), _lines(text_col).alias("lines"))
    narrow = narrow.select("id", "key", "site", F.posexplode("lines").alias("pos", "raw"))
    narrow = narrow.withColumn("trimmed", F.regexp_replace("raw", r"^\s+|\s+$", "")).where("trimmed <> ''")
    need = F.when(F.length("trimmed") >= min_chars, threshold).otherwise(short_threshold).alias("need")
    narrow = materialize(narrow.select("id", "key", "site", "pos", need, F.unhex(F.md5(F.col("trimmed").cast("binary"))).alias("line")), "line-hashes")
    shared = materialize(boilerplate(narrow), "boilerplate")
    gone = narrow.join(shared, "line").where(~F.col("id").eqNullSafe(F.col("first_id")))
    own_id, own_key, drop = free(docs, "_id"), free(docs, "_key"), free(docs, "_drop")
    gone = gone.groupBy("id", "key").agg(F.collect_set("pos").alias(drop)).withColumnsRenamed({"id": own_id, "key": own_key})
    joined = docs.join(gone, F.col(id_col).eqNullSafe(F.col(own_id)) & (key == F.col(own_key)), "left")

    def left(lines: Column) -> Column:
        """The lines at the positions that stay, from an array that is at hand (an expression here would be computed for each line)."""
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    text = F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(F.get(F.transform(F.array(_lines(text_col)), left), F.lit(0)))
    out = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    if counts:
        out += [
            F.when(F.col(text_col).isNull(), 0).otherwise(F.size(_lines(text_col))).cast("long").alias(free(docs, "_n_lines")),
            F.when(F.col(drop).isNull(), 0).otherwise(F.size(drop)).cast("long").alias(free(docs, "_n_removed")),
        ]
    return joined.select(*out)
