"""Benchmark decontamination with an FM-index per training shard.

A shard is what a task holds at a time. Its words are numbered by the phrases' vocabulary; runs of words that are all
in the vocabulary are the only places where a phrase can occur, so the index covers these runs (all of them, whole), with
a separator between. The index is the Burrows-Wheeler transform of the shard's word numbers with a wavelet matrix
for ranks. All phrases search it backwards at once (one array step per word, from last to first), their occurrences
are located by walking to the next sampled suffix position, and the covered words of a document are merged into spans.

Phrases are a stated query set: they are sent to the tasks in blocks of at most ``block_words`` words, so a benchmark
of any size costs bounded memory and further passes over the shards, never a bigger task. A task's shard is at most
``shard_chars`` characters, or one document.

Defined results: null and wordless texts have no words and no hits; items without words are never found; an item of fewer
than ``window`` words is one phrase; repeated items each count; repeated documents each get their row; an
empty benchmark finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cliploom.llm.common import free, map_slices, materialize, slices, tidy

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-case (A-Z only) words: runs of ASCII letters and digits and of anything beyond ASCII."""
    return WORD.findall(text.encode().lower()) if text else []


class WaveletMatrix:
    """Ranks of symbols in prefixes of an integer array, for whole arrays of questions."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            self.levels.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(len(symbols) - int(bit.sum()))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first ``end`` places."""
        begin = np.zeros_like(end)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, zero = self.levels[level], self.zeros[level]
            one = (symbol >> b) & 1 == 1
            begin = np.where(one, zero + ones[begin], begin - ones[begin])
            end = np.where(one, zero + ones[end], end - ones[end])
        return end - begin


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorted suffixes of an integer array (a suffix that is a prefix of another comes first), by doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:]
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([1], np.diff(key[order]) != 0)))
        rank = new
        if rank.max() == n or step >= n:
            return order
        step *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, sample: int = 8):
        """``text``: symbols of at least 1; the end is marked by a 0 that is added here."""
        text = np.concatenate((text.astype(np.int64), [0]))
        order = suffix_array(text)
        self.bwt = text[order - 1]
        bits = max(1, int(text.max()).bit_length())
        self.wavelet = WaveletMatrix(self.bwt, bits)
        counts = np.bincount(text, minlength=(1 << bits) + 1)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.kept = order % sample == 0
        self.rank_kept = np.concatenate(([0], np.cumsum(self.kept)))
        self.positions = order[self.kept]
        self.size = len(text)

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.wavelet.rank(symbol, at)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of all rows of ``phrases`` (equal length) by backward search."""
        phrases = phrases.astype(np.int64)
        # Symbols beyond the index's own stand nowhere in the text.
        absent = (phrases >> self.wavelet.bits != 0).any(axis=1)
        phrases = np.where(absent[:, None], 0, phrases)
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        for i in range(phrases.shape[1] - 1, -1, -1):
            low, high = self.step(phrases[:, i], low), self.step(phrases[:, i], high)
            high = np.maximum(high, low)
        return low, np.where(absent, low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: walk back to a sampled one and add the steps."""
        out = np.zeros(len(rows), np.int64)
        at, open_ = rows.astype(np.int64), np.arange(len(rows))
        steps = 0
        while len(open_):
            done = self.kept[at]
            out[open_[done]] = self.positions[self.rank_kept[at[done]]] + steps
            at, open_ = at[~done], open_[~done]
            at = self.step(self.bwt[at], at)
            steps += 1
        return out


def phrases_of(items: list[tuple[str, str | None]], window: int) -> tuple[dict[bytes, int], dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Vocabulary (numbers from 2) and, per length, the phrases with the number of the item they belong to."""
    vocabulary: dict[bytes, int] = {}
    by_length: dict[int, tuple[list, list]] = {}
    for k, (_, text) in enumerate(items):
        ids = [vocabulary.setdefault(w, len(vocabulary) + 2) for w in words_of(text)]
        n = min(window, len(ids))
        for i in range(len(ids) - n + 1 if n else 0):
            rows, owners = by_length.setdefault(n, ([], []))
            rows.append(ids[i : i + n])
            owners.append(k)
    return vocabulary, {n: (np.array(r, np.int32), np.array(o, np.int32)) for n, (r, o) in by_length.items()}


def shard_hits(texts: list[str | None], vocabulary: dict, phrases: dict) -> tuple[np.ndarray, list[tuple[int, int, int]], np.ndarray]:
    """Words per text, merged spans (text, first word, end), and (text, item) pairs found."""
    get = vocabulary.get
    coded = [np.fromiter((get(w, 0) for w in words_of(t)), np.int64) for t in texts]
    sizes = np.array([len(c) for c in coded], np.int64)
    base = np.concatenate(([0], np.cumsum(sizes + 1)))  # a separator after each text
    flat = np.zeros(base[-1], np.int64)
    for b, c in zip(base, coded, strict=False):
        flat[b : b + len(c)] = c
    least = min(phrases) if phrases else 0
    inside = np.concatenate(([0], (flat > 0).astype(np.int8), [0]))
    start, end = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
    long = end - start >= least
    start, end = start[long], end[long]
    if not least or not len(start):
        return sizes, [], np.zeros((0, 2), np.int64)
    length = end - start + 1
    place = np.concatenate(([0], np.cumsum(length)))
    source = np.arange(place[-1]) - np.repeat(place[:-1], length) + np.repeat(start, length)
    text = flat[np.minimum(source, len(flat) - 1)]
    text[place[1:] - 1] = 1  # separator
    index = FMIndex(text)
    mark = np.zeros(len(flat) + 1, np.int64)
    pairs = []
    for n, (rows, owners) in phrases.items():
        low, high = index.search(rows)
        found = high - low
        if not found.sum():
            continue
        which = np.repeat(np.arange(len(rows)), found)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(found) - found, found)
        at = source[index.locate(low[which] + nth)]
        np.add.at(mark, at, 1)
        np.add.at(mark, at + n, -1)
        pairs.append(np.unique(np.stack((np.searchsorted(base, at, "right") - 1, owners[which]), 1), axis=0))
    hit = np.concatenate(([0], (np.cumsum(mark) > 0).astype(np.int8), [0]))
    begin, stop = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
    of = np.searchsorted(base, begin, "right") - 1
    spans = [(int(t), int(b - base[t]), int(e - base[t])) for t, b, e in zip(of, begin, stop, strict=False)]
    return sizes, spans, np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, str | None]]]:
    """The phrase set in blocks; the driver holds one block at a time."""
    block, words = [], 0
    for row in benchmark.select(F.col(item_col).cast("string"), text_col).toLocalIterator():
        block.append((row[0], row[1]))
        words += len(words_of(row[1]))
        if words >= block_words:
            yield block
            block, words = [], 0
    if block:
        yield block


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
    item_col: str = "item_id", item_text: str = "text", block_words: int = 200_000, shard_bytes: int = 4_000_000,
) -> DataFrame:
    """The kept columns, n_words, spans array<struct<start,end>>, items array<string>; spans count words."""

    def search(items: list[tuple[str, str | None]]) -> DataFrame:
        vocabulary, phrases = phrases_of(items, window)
        names = [i for i, _ in items]

        def make():
            def run(texts: list) -> dict:
                sizes, spans, pairs = shard_hits(texts, vocabulary, phrases)
                own: list[list] = [[] for _ in texts]
                found: list[list] = [[] for _ in texts]
                for t, b, e in spans:
                    own[t].append({"start": b, "end": e})
                for t, k in pairs.tolist():
                    found[t].append(names[k])
                return {"n_words": sizes, "spans": own, "items": found}

            return run

        added = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"
        return map_slices(docs, text_col, make, added, list(keep), shard_bytes)

    found = [search(block) for block in _blocks(benchmark, item_col, item_text, block_words)] or [search([])]
    if len(found) == 1:
        return found[0]
    # Rows keep their place in the input, so the blocks' answers meet by it.
    placed = [f.withColumn("_row", F.monotonically_increasing_id()) for f in found]
    merged = placed[0]
    for f in placed[1:]:
        merged = merged.unionByName(f)
    joined = merged.groupBy("_row").agg(
        *[F.first(k).alias(k) for k in keep], F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.flatten(F.collect_list("items")).alias("items"),
    )
    # Overlapping spans of different blocks: a span is stretched or opened as they come in order.
    step = lambda a, s: F.when(
        (F.size(a) > 0) & (F.element_at(a, -1)["end"] >= s["start"]),
        F.concat(
            F.slice(a, 1, F.size(a) - 1),
            F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end"))),
        ),
    ).otherwise(F.concat(a, F.array(s)))
    empty = F.array().cast("array<struct<start:long,end:long>>")
    return joined.withColumn("spans", F.aggregate("spans", empty, step)).drop("_row")


def contamination_report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """Text without the words in ``spans``, from the first word's first byte to the last word's last one."""
    data = text.encode()
    places = [m.span() for m in WORD.finditer(data.lower())]
    out, at = [], 0
    for b, e in spans:
        out.append(data[at : places[b][0]])
        at = places[e - 1][1]
    return b"".join([*out, data[at:]]).decode()


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    block_words: int = 200_000, shard_bytes: int = 4_000_000,
) -> DataFrame:
    """``docs`` with all benchmark passages cut out of the texts; all columns and rows stay.

    All passages are found in the texts as they come in and cut at once, so the result does not depend on the blocks. Words that
    become neighbours by a cut are not looked at again.
    """
    blocks = _blocks(benchmark, item_col, item_text, block_words)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    if second is not None:
        return _cut_by_row(docs, benchmark, window, text_col, item_col, item_text, block_words, shard_bytes)
    vocabulary, phrases = phrases_of(first, window)

    def make():
        def run(texts: list) -> dict:
            by: dict[int, list] = {}
            for t, b, e in shard_hits(texts, vocabulary, phrases)[1]:
                by.setdefault(t, []).append((b, e))
            return {text_col: [remove_spans(x, by[t]) if t in by else x for t, x in enumerate(texts)]}

        return run

    return map_slices(docs, text_col, make, f"`{text_col}` string", docs.columns, shard_bytes)


def _cut_by_row(docs: DataFrame, benchmark: DataFrame, window: int, text_col: str, item_col: str, item_text: str, block_words: int, shard_bytes: int) -> DataFrame:
    """Several blocks: their spans meet by the number of a row in a written table, and the merged ones are cut."""
    row = free(docs, "_place")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate")
    found = find_contamination(numbered, benchmark, window, text_col, (row,), item_col, item_text, block_words, shard_bytes)
    spans = free(docs, "_cuts")
    hits = found.where(F.size("spans") > 0).select(row, F.col("spans").alias(spans))
    schema = docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = to_arrow_schema(schema)
        for part in slices(batches, text_col, shard_bytes):
            texts = part.column(text_col).to_pylist()
            for i, own in enumerate(part.column(spans).to_pylist()):
                if own:
                    texts[i] = remove_spans(texts[i], [(s["start"], s["end"]) for s in own])
            arrays = [pa.array(texts, f.type) if f.name == text_col else part.column(f.name).cast(f.type) for f in out_schema]
            yield pa.RecordBatch.from_arrays(arrays, schema=out_schema)

    return numbered.join(hits, row, "left").select(*docs.columns, spans).mapInArrow(tidy(cut), schema)
