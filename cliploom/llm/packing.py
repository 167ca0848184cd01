"""Harmonic packing of token streams into sequences of a fixed capacity.

A document's ids are cut into pieces that fit *reciprocal-capacity classes*: a piece of class j is at most 1/j of the capacity and
falls short of it by so little that j of them leave at most ``slack`` of the capacity empty. Whole capacities come first (class 1);
the rest stays whole if it is such a piece; otherwise it gives up the longest such piece, at least 1/(j + 1) for a rest of
class j, and what remains, about 1/(j * (j + 1)) of the capacity, is judged again. So a document has few cuts, and every sequence of
class j takes j pieces.

Each task fills its own sequences, one open sequence per class, and needs nothing from the others: no shuffle, and state of one
sequence per class (about twice the square root of the capacity). What the last open sequences of a task hold is laid end to end and cut at
the capacity; the very last stretch is cut into powers of two, which need no padding.

Ids are those of the tokenizers library for a byte-level BPE file with the usual word pattern, computed by tiktoken from the same
vocabulary, merge order and special strings (equal on every code point, see the tests). Long texts are encoded piece by piece;
they are cut in front of white space that follows something else, where no token can reach across.

Defined results: null and empty texts hold the closing id only; repeated rows and rows with null ids are packed like any other; an
empty table gives an empty result; sequence ids are unique, not consecutive; columns other than the id and the text are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cliploom.llm.bpe import byte_symbols
from cliploom.llm.common import give_back, once, slices

# Fixed value: the word pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEAM = regex.compile(r"(?<=[^\s\x1c-\x1f])[\t-\r ]")


class Encoder:
    """Token ids of texts for a byte-level BPE vocabulary file."""

    def __init__(self, data: bytes, long: int = 1_000_000):
        import tiktoken

        spec = json.loads(data)
        spelled = byte_symbols()
        ranks = {bytes(spelled[c] for c in s): i for s, i in spec["model"]["vocab"].items() if all(c in spelled for c in s)}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {b: i for b, i in ranks.items() if i not in set(special.values())}
        self.encoding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.long = long

    def parts(self, text: str) -> Iterator[str]:
        """The text in parts of about ``long`` characters whose tokens do not depend on each other."""
        start = 0
        while len(text) - start > self.long:
            seam = SEAM.search(text, start + self.long)
            if seam is None:
                break
            yield text[start : seam.start()]
            start = seam.start()
        yield text[start:] if start else text

    def encode(self, text: str) -> np.ndarray:
        found = [np.array(self.encoding.encode(p, allowed_special="all"), "<u4") for p in self.parts(text)]
        return found[0] if len(found) == 1 else np.concatenate(found)


def cut(n: int, capacity: int, slack: float) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a stream of n ids."""
    pieces = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        length = rest
        while capacity % length > slack * capacity:
            length -= 1
        pieces.append((length, capacity // length))
        rest -= length
    return pieces


def packed(streams: Iterator[tuple[object, np.ndarray]], capacity: int, slack: float) -> Iterator[tuple]:
    """(id, start, length, crc, stream length, sequence, offset) for each piece; sequences are numbered from 0."""
    cuts: dict[int, list[tuple[int, int]]] = {}
    opened: dict[int, list[tuple]] = {}
    number = 0
    for key, ids in streams:
        n, start = len(ids), 0
        raw = ids.tobytes()
        rest = n % capacity
        if rest not in cuts:
            cuts[rest] = cut(rest, capacity, slack)
        for start in range(0, n - rest, capacity):
            yield key, start, capacity, zlib.crc32(raw[4 * start : 4 * (start + capacity)]), n, number, 0
            number += 1
        start = n - rest
        for length, j in cuts[rest]:
            here = opened.setdefault(j, [])
            here.append((key, start, raw[4 * start : 4 * (start + length)], n))
            start += length
            if len(here) == j:
                offset = 0
                for k, s, ids_of, total in here:
                    yield k, s, len(ids_of) // 4, zlib.crc32(ids_of), total, number, offset
                    offset += len(ids_of) // 4
                number += 1
                here.clear()
    # The open sequences of all classes, largest pieces first, end to end.
    left = [piece for j in sorted(opened) for piece in opened[j]]
    size = sum(len(piece[2]) // 4 for piece in left)
    rooms = [capacity] * (size // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if (size % capacity) >> b & 1]
    room, offset = iter(rooms), 0
    free = next(room, 0)
    for key, start, raw, n in left:
        while raw:
            take = min(free, len(raw) // 4)
            yield key, start, take, zlib.crc32(raw[: 4 * take]), n, number, offset
            raw, start, offset, free = raw[4 * take :], start + take, offset + take, free - take
            if not free:
                number, offset, free = number + 1, 0, next(room, 0)


def pack(
    docs: DataFrame, tokenizer_file: str, capacity: int = 1024, slack: float = 1 / 64, closing: int = 0, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset): a row for each piece of each document.

    ``slack`` is the share of a sequence that may stay empty for the sake of fewer cuts.
    """
    with open(tokenizer_file, "rb") as f:
        data = f.read()
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(k, T.LongType()) for k in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once(("encoder", hash(data)), lambda: Encoder(data))
        first = TaskContext.get().partitionId() << 33
        out_schema = to_arrow_schema(schema)
        end = np.array([closing], "<u4")

        def streams() -> Iterator[tuple[object, np.ndarray]]:
            for part in slices(batches, "text", 2_000_000):
                for key, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    yield key, np.concatenate((encoder.encode(text or ""), end))

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            columns[5] = [first + x for x in columns[5]]
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out_schema, strict=True)], schema=out_schema)

        rows: list[tuple] = []
        try:
            for piece in packed(streams(), capacity, slack):
                rows.append(piece)
                if len(rows) == 20_000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)
        finally:
            give_back()

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)
