"""Items of a JSON array in payload files of any size: one file is read by many tasks.

``read_payloads`` makes one row of a file, so a payload of a gigabyte is one task and one string.  Here a file is cut
into byte ranges.  What a bracket or a comma means in the middle of a file depends on everything before it, so the file is
read twice:

1. each range says what it does to the state of a reader, once for a start outside of strings and once for a start inside
   one: whether it ends in the other of both, how many brackets of earlier ranges it closes, and the first two it leaves
   open (deeper ones decide nothing);
2. these rows, one of some hundred bytes per range, are folded along each file and give every range its start;
3. each range is read again and gives the items that begin in it, the last one possibly by reading on.

A task reads many ranges, about ``SPLIT_BYTES`` of them, neighbours of a file together; so short ranges or small files make no
more tasks than long ones.  Files are listed and read by ``pyarrow.fs``, so folders may be local, HDFS or an object store.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.operators.blocks import running, seq_block, whole_groups
from cliploom.sources.files import OUT_BYTES, OUT_ROWS, list_files, where_is  # noqa: F401
from cliploom.sources.scratch import materialize

SPLIT_BYTES = 16 << 20
RANGE_COST = 4096  # bytes that opening a range is worth
MAX_TASKS = 20_000
OPEN = "struct<kind:string,key:string>"
EFFECT = f"struct<closes:bigint,n_opens:bigint,opens:array<{OPEN}>>"
RANGE = "file string, job_id string, part bigint, no bigint, lo bigint, hi bigint"


def file_names(file: Column) -> tuple[Column, Column]:
    """(job_id, part) of a payload file: its folder and the number at the end of its name, or Spark's key=value folders."""
    named = lambda key: F.regexp_extract(file, f"/{key}=([^/]*)/", 1)
    part = F.coalesce(named("part").try_cast("bigint"), F.regexp_extract(file, r"([0-9]+)\.[^./]*$", 1).try_cast("bigint"), F.lit(0))
    job = F.when(named("job_id") != "", named("job_id")).otherwise(F.element_at(F.split(file, "/"), -2))
    return job, part.cast("long")


class _File:
    """Byte ranges of one file, kept open over the rows of a task."""

    def __init__(self) -> None:
        self.name, self.f = None, None

    def read(self, name: str, lo: int, hi: int) -> bytes:
        if name != self.name:
            self.close()
            where, path = where_is(name)
            self.name, self.f = name, where.open_input_file(path)
        lo = max(lo, 0)
        return self.f.read_at(hi - lo, lo) if hi > lo else b""

    def close(self) -> None:
        if self.f is not None:
            self.f.close()
        self.name = self.f = None


def _backslashes_before(src: _File, name: str, lo: int) -> int:
    """Length of the run of backslashes that ends just before ``lo``."""
    n, step = 0, 64
    while lo - n > 0:
        piece = src.read(name, lo - n - step, lo - n)
        run = len(piece) - len(piece.rstrip(b"\\"))
        n += run
        if run < len(piece):
            break
        step *= 2
    return n


def _from_character(data: bytes) -> bytes:
    """``data`` without the bytes that continue a UTF-8 character begun before it."""
    n = 0
    while n < min(3, len(data)) and data[n] & 0xC0 == 0x80:
        n += 1
    return data[n:]


def _marks(data: bytes, inside: bool, escaped: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """(positions, characters, quotes): brackets and commas outside of strings, and the number of quotes.

    ``inside``: the first byte lies in a string; ``escaped``: an odd number of backslashes stands before it.
    """
    b = np.frombuffer(data, dtype=np.uint8)
    quotes = np.flatnonzero(b == 34)
    if len(quotes):
        slash = np.flatnonzero(b == 92)
        if len(slash) or escaped:
            # The run of backslashes before a quote starts after the last other byte.
            first = np.flatnonzero(np.diff(slash, prepend=-2) != 1)
            run_of = np.searchsorted(slash, quotes, "left") - 1
            ends_here = (run_of >= 0) & (slash[np.maximum(run_of, 0)] == quotes - 1) if len(slash) else np.zeros(len(quotes), dtype=bool)
            length = np.zeros(len(quotes), dtype=np.int64)
            if len(slash):
                start = first[np.searchsorted(first, np.maximum(run_of, 0), "right") - 1]
                length[ends_here] = (run_of - start + 1)[ends_here]
            if escaped:
                length[quotes - length == 0] += 1
            quotes = quotes[length % 2 == 0]
    at = np.flatnonzero((b == 44) | (b == 91) | (b == 93) | (b == 123) | (b == 125))
    outside = (np.searchsorted(quotes, at) + inside) % 2 == 0
    at = at[outside]
    return at, b[at], len(quotes)


def _key_before(src: _File, name: str, at: int) -> str | None:
    """Name of the member whose value starts at ``at``; None for an element of an array or the whole text."""
    step = 256
    while True:
        tail = src.read(name, at - step, at).rstrip()
        if tail[-1:] not in (b":", b"") or (not tail and step >= at):
            return None
        found = re.search(rb'(?<!\\)(?:\\\\)*"((?:[^"\\]|\\.)*)"\s*:$', tail, re.S)
        if found and (found.start() > 0 or step >= at):
            return found.group(1).decode("utf-8", "replace")
        if step >= at:
            return None
        step *= 4


def _effect(src: _File, name: str, lo: int, at: np.ndarray, ch: np.ndarray) -> dict:
    """Brackets that a range closes and leaves open, from its marks."""
    bracket = ch != 44
    at, ch = at[bracket], ch[bracket]
    step = np.where((ch == 91) | (ch == 123), 1, -1)
    depth = np.cumsum(step)
    closes = int(max(0, -depth.min())) if len(depth) else 0
    n_opens = int(depth[-1]) + closes if len(depth) else 0
    opens = []
    for level in range(-closes + 1, -closes + 1 + min(n_opens, 2)):
        # The last time the depth came up to a level that it ends at or above.
        i = int(np.flatnonzero((depth == level) & (step == 1))[-1])
        opens.append({"kind": chr(ch[i]), "key": _key_before(src, name, lo + int(at[i]))})
    return {"closes": closes, "n_opens": n_opens, "opens": opens}


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    src = _File()
    opened = pa.struct([("kind", pa.string()), ("key", pa.string())])
    effect = pa.struct([("closes", pa.int64()), ("n_opens", pa.int64()), ("opens", pa.list_(opened))])
    types = [pa.bool_(), pa.bool_(), effect, effect]
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            data = src.read(row["file"], row["lo"], row["hi"])
            escaped = _backslashes_before(src, row["file"], row["lo"]) % 2 == 1
            both = []
            for inside in (False, True):
                at, ch, quotes = _marks(data, inside, escaped)
                both.append(_effect(src, row["file"], row["lo"], at, ch))
            found.append((quotes % 2 == 1, escaped, *both))
        if found:
            cols = [*batch.columns, *(pa.array(c, t) for c, t in zip(zip(*found), types))]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, "turns", "escaped", "outer", "inner"])
    src.close()


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """Start of every range of whole files, by file and number; the ranges of a file that does not end where it began are marked."""
    starts, whole, first, file = [], [], 0, None
    inside, depth, stack, ok = False, 0, [], True
    for name, turns, outer, inner in zip(pdf["file"], pdf["turns"], pdf["outer"], pdf["inner"]):
        if name != file:
            whole += [ok and depth == 0 and not inside] * (len(starts) - first)
            first, file = len(starts), name
            inside, depth, stack, ok = False, 0, [], True
        starts.append((inside, depth, [dict(o) for o in stack]))
        e = inner if inside else outer
        depth -= e["closes"]
        ok = ok and depth >= 0
        depth = max(depth, 0)
        stack = stack[:depth] + [dict(o) for o in e["opens"]][: max(0, 2 - depth)]
        depth += e["n_opens"]
        inside = inside != turns
    whole += [ok and depth == 0 and not inside] * (len(starts) - first)
    out = pdf[["file", "job_id", "part", "no", "lo", "hi", "escaped"]].copy()
    out["inside"], out["depth"], out["stack"] = (list(x) for x in zip(*starts))
    out["whole"] = whole
    return out


def _folds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    return map(_fold, whole_groups(batches, ["file"]))


def _events(src: _File, name: str, base: int, data: bytes, inside: bool, escaped: bool, depth: int, stack: list, array: str):
    """Where the wanted array's items and the text outside of containers begin and end.

    Yields (position, what): 'd' a place between items, 'o'/'c' the opening or closing of a container of the root object, with
    'O'/'C' for the wanted array; 'A' where the text turns out to be an array.
    """
    at, ch, _ = _marks(data, inside, escaped)
    up = (ch == 91) | (ch == 123)
    down = (ch == 93) | (ch == 125)
    before = depth + np.cumsum(up.astype(np.int64) - down) - up + down
    root = stack[0]["kind"] if stack else None
    wanted = len(stack) > 1 and root == "{" and stack[1]["kind"] == "[" and stack[1]["key"] == array
    near = np.flatnonzero(((before == 0) & up) | ((before == 1) & up) | ((before == 2) & ~up))
    for i in near:
        p, c = int(at[i]), chr(ch[i])
        if before[i] == 0:
            root = c
            if root == "[":
                yield p, "A"
        elif c in "[{":
            wanted = root == "{" and c == "[" and _key_before(src, name, base + p) == array
            if root == "{":
                yield p, "O" if wanted else "o"
        elif c in "]}":
            if root == "{":
                yield p, "C" if wanted else "c"
            wanted = False
        elif wanted:
            yield p, "d"


def _cutter(array: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["file", "job_id", "part", "no", "at", "k", "value"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def pieces(src: _File, row: dict) -> Iterator[tuple[int, int | None, bytes]]:
        """(position, number among the range's items, bytes); the number of text outside of containers is None."""
        name, lo = row["file"], row["lo"]
        data = src.read(name, lo, row["hi"])
        stack = row["stack"]
        cut_off = len(data) - len(_from_character(data))  # the end of the character that the range before began
        start = None  # just after the last place between items
        head = cut_off if row["depth"] <= 1 and (not stack or stack[0]["kind"] == "{") else None
        k = 0
        for p, what in _events(src, name, lo, data, row["inside"], row["escaped"], row["depth"], stack, array):
            if what in "dC" and start is not None:
                item = data[start:p].strip()
                if item:
                    yield lo + start, k, item
                    k += 1
            if what in "oO":
                yield lo + head, None, data[head : p + 1]
                head = None
            if what in "cC":
                head = p
            if what == "A":
                head = None
            start = p + 1 if what in "dO" else None
        if head is not None and head < len(data):
            rest = src.read(name, row["hi"], row["hi"] + 3)
            yield lo + head, None, data[head:] + rest[: len(rest) - len(_from_character(rest))]
        if start is not None:
            step = 1 << 10
            open_array = [{"kind": "{", "key": None}, {"kind": "[", "key": array}]
            while True:
                more = src.read(name, lo + start, lo + start + step)
                end = next((p for p, w in _events(src, name, lo + start, more, False, False, 2, open_array, array) if w in "dC"), None)
                if end is not None or len(more) < step:
                    break
                step *= 4
            item = more[:end].strip()
            if item:
                yield lo + start, k, item

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src = _File()
        rows, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                for at, k, value in pieces(src, row):
                    rows.append((row["file"], row["job_id"], row["part"], row["no"], at, k, value.decode("utf-8", "replace")))
                    size += len(value)
                    if len(rows) >= OUT_ROWS or size >= OUT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        src.close()

    return cut


def items_of(
    files: DataFrame, array: str, split_bytes: int = SPLIT_BYTES, jobs: Sequence[str] | None = None, max_tasks: int = MAX_TASKS
) -> tuple[DataFrame, DataFrame]:
    """(items, heads) of JSON objects in ``files`` (path, length).

    items  job_id, part, file, seq, value: the elements of the member ``array`` as JSON texts, null for a null; ``seq`` numbers
           them over the parts of a job
    heads  job_id, part, file, head: the object with the content of all its containers left out

    ``jobs`` leaves out the files of other jobs before anything is read.  A file whose strings or brackets do not
    close gives neither items nor a head; so does an empty one, or one whose text is an array.  If
    the member occurs twice, the items of both count.  An item is held whole by one task, one range at a time.
    The function runs jobs when called and writes its rows to the shared folder.
    """
    spark = files.sparkSession
    job, part = file_names(F.col("path"))
    named = files.filter("length > 0").select(F.col("path").alias("file"), job.alias("job_id"), part.alias("part"), "length")
    if jobs is not None:
        named = named.filter(F.col("job_id").isin([str(j) for j in jobs]))
    size = F.lit(int(split_bytes))
    no = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size).cast("long"))).alias("no")
    ranges = named.select("file", "job_id", "part", "length", no).select(
        "file", "job_id", "part", "no", (F.col("no") * size).alias("lo"), F.least((F.col("no") + 1) * size, "length").alias("hi")
    )
    ranges = materialize(ranges, "ranges")
    n, size = ranges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("hi") - F.col("lo")), F.lit(0))).first()
    work, cores = size + n * RANGE_COST, spark.sparkContext.defaultParallelism
    tasks = max(1, min(n, max_tasks, -(-work // max(split_bytes, min(SPLIT_BYTES, work // cores)))))
    width = max(split_bytes, min(SPLIT_BYTES, size // cores))
    dealt = lambda df: df.repartition(tasks, "file", F.floor(F.col("lo") / F.lit(width))).sortWithinPartitions("file", "no")
    effects = dealt(ranges).mapInArrow(_summaries, f"{RANGE}, turns boolean, escaped boolean, outer {EFFECT}, inner {EFFECT}")
    starts = effects.repartition("file").sortWithinPartitions("file", "no").mapInPandas(
        _folds, f"{RANGE}, escaped boolean, inside boolean, depth bigint, stack array<{OPEN}>, whole boolean"
    )
    starts = materialize(starts, "starts").filter("whole")
    cut = materialize(
        dealt(starts).mapInArrow(_cutter(array), "file string, job_id string, part bigint, no bigint, at bigint, k bigint, value string"), "items"
    )
    items = cut.filter("k IS NOT NULL")
    sizes = items.groupBy("job_id", "part", "file", "no").agg(F.count(F.lit(1)).alias("_n"))
    offsets = running(sizes, ["job_id"], ["part", "file", "no"], seq_block("part", 10_000), sums={"_off": F.col("_n")})
    placed = items.join(offsets.select("file", "no", "_off"), ["file", "no"])
    heads = cut.filter("k IS NULL").groupBy("job_id", "part", "file").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("x"))
    return (
        placed.select("job_id", "part", "file", (F.col("_off") + F.col("k")).cast("long").alias("seq"), F.nullif("value", F.lit("null")).alias("value")),
        heads.select("job_id", "part", "file", F.array_join(F.transform("x", lambda r: r["value"]), "").alias("head")),
    )


def stream_items(
    spark: SparkSession, path: str, array: str, handle: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, files_per_batch: int = 1000,
    **options,
):
    """Files as they arrive: ``handle(items, heads, batch)`` for every batch of new ones; ``seq`` counts within the batch.

    Returns the query, which ends when the files there at its start are done.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch)

    def batch(df: DataFrame, number: int) -> None:
        handle(*items_of(df, array, **options), number)

    source = files.load(path).select("path", "length")
    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
