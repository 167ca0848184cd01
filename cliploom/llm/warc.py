"""Web archives: written by Spark's text sink, read back with verified record boundaries.

Writing. Records with equal payloads (SHA-1, length and a second hash agree) of at least ``min_bytes`` become one response,
that of the largest id, and revisits that refer to it. A record is a header, the block, and two line ends; the
last are the sink's line separator, so executors write archives through Spark into any store it can write.

Reading. The reader cuts files at the magic ``WARC/1.0``, in splits, so a file of any size is read by many tasks. A magic
may stand inside a payload, hence a cut is only a candidate. Each candidate gives its own offset and, from its header's
content length, that of its successor. Within a split pointers are doubled over arrays (log2 of the number of candidates)
to find where each chain leaves it; from split to split the same is done by joins (log2 of the number of splits) until all
offsets that can be reached from the file's start are known; then marks go along the doubled pointers of every split. Only reachable candidates are records; pieces between two of them belong to the first one's
payload and are put together again.

Defined results: a null payload is empty; a null id is written as ``null`` and is smaller than any other; rows with equal ids
and payloads are responses both, if the id is the largest; what follows a broken header (no content length, a negative one, or one above ``MOST_BYTES``) is not reachable and is left out;
very long payloads lie in one row like any Spark text; only the three named columns are read, so others may clash;
an empty table gives an archive without records.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cliploom.llm.common import materialize, whole

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
MOST_BYTES = 1 << 48  # of a block; a header that states more is broken
# Digits of base 32 as the SQL function conv writes them, and as RFC 4648 does.
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(data: Column) -> Column:
    """SHA-1 in base 32: five hexadecimal digits make four of base 32."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32_DIGITS)


def write_warc(
    pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", min_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z", compression: str = "gzip", records_per_file: int = 20_000,
) -> None:
    """Write one record per row to archives in the folder ``path``."""
    payload = whole(payload_col)
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), payload.alias("_payload"))
    rows = rows.withColumn("_digest", sha1_base32(F.col("_payload").cast("binary"))).withColumn("_bytes", F.octet_length("_payload"))
    narrow = materialize(rows.where(F.col("_bytes") >= min_bytes).select("_id", "_digest", "_bytes", F.xxhash64("_payload").alias("_check")), "payload-digests")
    key = ["_digest", "_bytes", "_check"]
    groups = narrow.groupBy(*key).agg(F.max("_id").alias("_refers"), F.count("*").alias("_n")).where("_n > 1")
    # Only revisits are listed: few against the pages, so the pages themselves seldom move.
    revisits = materialize(
        narrow.join(groups, key).where(~F.col("_id").eqNullSafe(F.col("_refers"))).select(F.col("_id").alias("_rid"), F.col("_digest").alias("_rdigest"), "_refers", F.lit(True).alias("_revisit")).distinct(),
        "revisits",
    )
    rows = rows.join(revisits, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_digest") == F.col("_rdigest")), "left")
    uri = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    safe = F.regexp_replace(F.coalesce("_url", F.lit("urn:none")), r"[^\x21-\x7E]", "_")
    is_revisit = F.coalesce("_revisit", F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_bytes").cast("string"), F.lit(END))
    block = F.when(is_revisit, http).otherwise(F.concat(http, F.col("_payload")))
    record = F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), F.when(is_revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), uri(F.col("_id")), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), safe,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("_digest"),
        F.when(is_revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), uri(F.col("_refers")), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block,
    )
    options = {"lineSep": END, "compression": compression, "maxRecordsPerFile": str(records_per_file)}
    rows.select(record.alias("value")).write.options(**options).text(path)


def header_field(header: Column, name: str) -> Column:
    """A header field's value; null where it is missing."""
    got = F.regexp_extract(header, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    return F.when(got != "", got)


def _chain(at: np.ndarray, after: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted candidates and their successors' offsets: the next candidate (or -1), and where each one's chain
    leaves the split (-1 where it breaks off)."""
    place = np.searchsorted(at, after)
    met = (place < len(at)) & (after >= 0)
    met[met] &= at[place[met]] == after[met]
    following = np.where(met, place, -1)
    leaves = np.where(met, -1, np.where(after >= end, after, -1))
    jump = np.where(met, place, np.arange(len(at)))
    while True:  # pointer jumping within the split
        further = jump[jump]
        if (further == jump).all():
            return following, leaves[jump]
        jump = further


def _exits(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("mid")
    size = part["len"].to_numpy() + len(MAGIC)
    at = np.cumsum(size) - size
    after = np.where(part["total"].isna(), -1, at + part["total"].fillna(0).to_numpy().astype(np.int64))
    _, leaves = _chain(at, after, int(size.sum()))
    return pd.DataFrame({"file": part["file"], "split": part["split"], "mid": part["mid"], "at": at, "after": after, "leaves": leaves, "size": int(size.sum())})


def _reached(following: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which candidates the chains from ``entries`` (indexes) pass: marks go along pointers that double in every round."""
    reached = np.zeros(len(following), bool)
    reached[entries] = True
    jump = np.where(following >= 0, following, np.arange(len(following)))
    while True:
        reached[jump[reached]] = True
        further = jump[jump]
        if (further == jump).all():
            return reached
        jump = further


def _marked(part: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
    """Mark what the split's entry reaches, and tell for every piece the last reached one before it (-1: none here)."""
    part = part.sort_values("at")
    at = part["at"].to_numpy()
    following, _ = _chain(at, part["after"].to_numpy(), int(part["size"].iloc[0]) if len(part) else 0)
    reached = _reached(following, np.flatnonzero(np.isin(at, entry["entry"].to_numpy())))
    owner = np.maximum.accumulate(np.where(reached, np.arange(len(at)), -1)) if len(at) else at
    start = part["base"].to_numpy() + at
    return pd.DataFrame(
        {
            "file": part["file"], "split": part["split"], "mid": part["mid"], "at": start, "reached": reached,
            "owner": np.where(owner >= 0, start[owner], -1), "owner_end": np.where(owner >= 0, (part["base"].to_numpy() + part["after"].to_numpy())[owner], -1),
        }
    )


def read_warc(spark: SparkSession, path: str, derived: dict[str, Column] | None = None) -> DataFrame:
    """Verified records: file, offset, header and the ``derived`` columns, computed from ``header`` and ``block`` (binary).

    Without ``derived``, the block itself.
    """
    derived = derived or {"block": F.col("block")}
    raw = spark.read.option("lineSep", MAGIC).text(path)
    raw = raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("mid"), "value", F.octet_length("value").cast("long").alias("len"),
        F.substring_index("value", END, 1).alias("header"),
    )
    # A header is complete only if its blank line is there.
    content = F.when(F.octet_length("header") < F.col("len"), header_field(F.col("header"), "Content-Length").try_cast("long"))
    # A payload may hold any number: successors lie behind their record, and sums of offsets stay within 64 bits.
    content = F.when(content.between(0, MOST_BYTES), content)
    start = F.octet_length("header") + len(END)
    pieces = raw.withColumn("content", content).withColumn("value", F.col("value").cast("binary"))
    pieces = pieces.withColumn("total", start + F.col("content") + len(END) + len(MAGIC))
    cut = lambda v: F.substring(v, start + 1, F.col("content").cast("int"))
    own = [c.alias(n) for n, c in derived.items()]
    seen = pieces.withColumn("complete", F.coalesce(F.col("len") >= start + F.col("content"), F.lit(False)))
    seen = seen.withColumn("block", F.when(F.col("complete"), cut(F.col("value"))))
    narrow = materialize(seen.select("file", "split", "mid", "len", "total", "header", "content", "complete", *own), "warc-candidates")
    local = materialize(
        narrow.select("file", "split", "mid", "len", "total").groupBy("file", "split")
        .applyInPandas(_exits, "file string, split long, mid long, at long, after long, leaves long, size long"), "warc-chains",
    )
    # Splits of one file are few (its size over the split size): their running lengths need no more than a small window.
    in_file = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = local.groupBy("file", "split").agg(F.max("size").alias("size"))
    splits = materialize(splits.withColumn("base", F.coalesce(F.sum("size").over(in_file), F.lit(0))), "warc-splits")
    placed = local.join(splits.select("file", "split", "base"), ["file", "split"])
    most = splits.groupBy("file").count().agg(F.max("count")).first()[0] or 1
    reach = splits.where("base = 0").select("file", F.lit(len(MAGIC)).cast("long").alias("entry")).distinct()
    if most > 1:
        jump = materialize(placed.where("leaves >= 0").select("file", (F.col("base") + F.col("at")).alias("from"), (F.col("base") + F.col("leaves")).alias("to")), "warc-jumps")
        for _ in range(math.ceil(math.log2(most)) + 1):
            step = reach.join(jump, (reach["file"] == jump["file"]) & (reach["entry"] == jump["from"])).select(reach["file"], F.col("to").alias("entry"))
            reach = materialize(reach.unionByName(step).distinct(), "warc-reach")
            then = jump.select(F.col("file").alias("f2"), F.col("from").alias("via"), F.col("to").alias("then"))
            jump = materialize(jump.join(then, (F.col("file") == F.col("f2")) & (F.col("to") == F.col("via"))).select("file", "from", F.col("then").alias("to")), "warc-jumps")
    entries = reach.join(splits, "file").where((F.col("entry") >= F.col("base")) & (F.col("entry") < F.col("base") + F.col("size")))
    entries = entries.select("file", "split", (F.col("entry") - F.col("base")).alias("entry"))
    marked = materialize(
        placed.groupBy("file", "split").cogroup(entries.groupBy("file", "split"))
        .applyInPandas(_marked, "file string, split long, mid long, at long, reached boolean, owner long, owner_end long"), "warc-marked",
    )
    hits = marked.where("reached").select("mid", (F.col("at") - len(MAGIC)).alias("offset"), F.col("at").alias("_at"))
    records = narrow.join(hits, "mid")
    names = ["file", "offset", "header", *derived]
    good = records.where("complete").select(*names)
    # Records whose payload holds the magic: gather their pieces, also from later splits.
    open_ = materialize(records.where(~F.col("complete") & F.col("content").isNotNull()).select("file", "offset", "_at", "header", "content"), "warc-open")
    if open_.isEmpty():
        return good
    last = marked.where("owner >= 0").groupBy("file", "split").agg(F.max(F.struct("owner", "owner_end")).alias("w"))
    before = splits.join(last, ["file", "split"], "left").withColumn("prev", F.last("w", ignorenulls=True).over(in_file)).select("file", "split", "prev")
    owned = marked.join(before, ["file", "split"]).select(
        "file", "mid", F.when(F.col("owner") >= 0, F.col("owner")).otherwise(F.col("prev.owner")).alias("_at"), F.col("at").alias("_piece")
    )
    owned = owned.join(open_.select("file", "_at", "content", "header", "offset"), ["file", "_at"])
    # A piece that begins where the payload ends: the magic before it is the payload's end.
    owned = owned.where(F.col("_piece") <= F.col("_at") + F.octet_length("header") + len(END) + F.col("content"))
    values = pieces.select("mid", "value").join(owned, "mid")
    joined = values.groupBy("file", "offset", "header", "content").agg(F.array_sort(F.collect_list(F.struct("_piece", "value"))).alias("v"))
    text = F.aggregate("v", F.lit(b"").cast("binary"), lambda a, s: F.when(F.octet_length(a) == 0, s["value"]).otherwise(F.concat(a, F.lit(MAGIC.encode()), s["value"])))
    rebuilt = joined.withColumn("block", cut(text)).where(F.octet_length("block") == F.col("content"))
    return good.unionByName(rebuilt.select("file", "offset", "header", *own))


def warc_pages(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) per record; revisits take both of their response's payload."""
    # The payload follows the HTTP header's blank line; its digest is computed, and must agree with the header's.
    body = F.substring(F.col("block"), F.instr(F.col("block").cast("string"), END) + len(END), F.octet_length("block"))
    got = read_warc(
        spark, path, {"payload_bytes": F.octet_length(body).cast("long"), "payload_digest": sha1_base32(body)}
    )
    name = lambda field: F.regexp_extract(header_field(F.col("header"), field), "^<urn:record:(.*)>$", 1).try_cast(id_type)
    got = got.select(
        name("WARC-Record-ID").alias("page_id"), "payload_bytes", "payload_digest", header_field(F.col("header"), "WARC-Type").alias("record_type"),
        name("WARC-Refers-To").alias("refers_to"), header_field(F.col("header"), "WARC-Payload-Digest").alias("_stated"),
    )
    response = got.where("record_type = 'response'").where(F.col("_stated") == F.concat(F.lit("sha1:"), F.col("payload_digest"))).drop("_stated")
    target = response.select(F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_b"), F.col("payload_digest").alias("_d")).distinct()
    revisit = got.where("record_type = 'revisit'")
    revisit = revisit.join(target, (F.col("refers_to") == F.col("_page")) & (F.col("_stated") == F.concat(F.lit("sha1:"), F.col("_d"))))
    return response.unionByName(revisit.select("page_id", F.col("_b").alias("payload_bytes"), F.col("_d").alias("payload_digest"), "record_type", "refers_to"))
