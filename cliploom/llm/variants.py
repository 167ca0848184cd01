"""Groups of spelling variants: words one edit apart, found through Bloom-guided neighbourhoods.

1. Words are counted in tasks and summed by Spark; the vocabulary is what is long and frequent enough.
2. Every word goes into a blocked Bloom filter: one shard per word length, blocks of 512 bits, one bit in each of a block's eight lanes. Blocks
   are put together by aggregation. The filter travels to the tasks in portions of at most ``portion`` bytes, whatever
   the size of the vocabulary: each portion serves the probes that fall into it.
3. Every word generates its edits and probes them: the deletions and the replacements by a later letter. An insertion is
   the other word's deletion, so each pair is met once. Only hashes are made: that of an edit follows from its word's.
4. Positives, as pairs of hashes, meet the vocabulary in a join; the edit distance of the two words is then checked exactly.

A word's form is its most frequent neighbour if that is ``ratio`` times as frequent; roots follow forms by pointer jumping. Frequencies
grow by the ratio at each step, so there are no circles, and a word has no more neighbours than edits.

Defined results: null and empty texts have no words; repeated rows count each time; an empty table gives an empty result; words of any
length are counted and compared whole; columns other than the id and the text are not read; with ``edit`` given, null ids are passed to it.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import map_slices, materialize, slices, tidy

U = np.uint64
LANES = 8
WORD = r"[a-zÀ-ÿ]+"
SALTS = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def terms(place: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """What a letter at a place adds to a word's sum."""
    return mix((place.astype(U) << U(21)) + letter.astype(U) + U(1))


def finish(sums: np.ndarray, length: int) -> np.ndarray:
    return mix(sums + U(length * int(SALTS[0]) & 0xFFFFFFFFFFFFFFFF))


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, which words, matrix of their code points)."""
    groups: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        groups[len(w)].append(i)
    for length, which in groups.items():
        raw = "".join([words[i] for i in which]).encode("utf-32-le")
        yield length, np.array(which), np.frombuffer(raw, "<u4").reshape(len(which), length)


def word_hashes(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), U)
    for length, which, letters in by_length(words):
        out[which] = finish(terms(np.arange(length)[None, :], letters).sum(axis=1, dtype=U), length)
    return out


def edit_hashes(letters: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row, hash, length) of the deletions and of the replacements by later letters, for words of one length."""
    m, length = letters.shape
    place = np.arange(length)
    own = terms(place[None, :], letters)
    total = own.sum(axis=1, dtype=U)
    if length > 1:
        before = np.cumsum(own, axis=1, dtype=U) - own
        moved = terms(np.maximum(place - 1, 0)[None, :], letters)
        after = moved.sum(axis=1, dtype=U)[:, None] - np.cumsum(moved, axis=1, dtype=U)
        yield np.repeat(np.arange(m), length), finish(before + after, length - 1).ravel(), length - 1
    for i in range(length):
        row, new = np.nonzero(alphabet[None, :] > letters[:, i][:, None])
        yield row, finish(total[row] - own[row, i] + terms(np.array([i]), alphabet)[new], length), length


class Shards:
    """Where hashes of each length have their block: one shard of blocks per length."""

    def __init__(self, counts: dict[int, int], bits: int):
        self.first: dict[int, tuple[int, int]] = {}
        self.blocks = 0
        for length in sorted(counts):
            n = max(1, -(-counts[length] * bits // 512))
            self.first[length] = (self.blocks, n)
            self.blocks += n

    def block(self, hashes: np.ndarray, length: int) -> np.ndarray | None:
        if length not in self.first:
            return None
        first, n = self.first[length]
        # Two halves of the hash: shards may have more than 2^32 blocks only in theory.
        return (((hashes >> U(32)) * U(n)) >> U(32)).astype(np.int64) + first


def lane_bit(hashes: np.ndarray, lane: int) -> np.ndarray:
    return U(1) << ((hashes * SALTS[lane]) >> U(58))


def word_counts(docs: DataFrame, edit: Callable[[object], Callable[[str], str]] | None = None, id_col: str = "doc_id", text_col: str = "text", held: int = 100_000) -> DataFrame:
    """(word, n): how often each word stands in all texts, A-Z in lower case; ``edit(id)`` may change a row's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(WORD)
        sums: dict[str, int] = defaultdict(int)

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], names=["word", "n"])
            sums.clear()
            return got

        for part in slices(batches, "text", 2_000_000):
            for key, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                words = Counter(pattern.findall(text.encode().lower().decode()))
                change = edit(key) if edit else None
                for w, n in words.items():
                    sums[change(w) if change else w] += n
            if len(sums) > held:
                yield out()
        if sums:
            yield out()

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(tidy(run), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def near_words(vocabulary: DataFrame, bits: int = 16, portion: int = 64 << 20) -> DataFrame:
    """(a, b, n_a, n_b): pairs of words (word, n) that differ by one inserted, deleted or replaced code point, each pair once."""
    spark = vocabulary.sparkSession

    def make_hashes():
        return lambda words: {"h": word_hashes(words).view(np.int64), "length": [len(w) for w in words]}

    hashed = materialize(map_slices(vocabulary, "word", make_hashes, "h long, length int", ["word", "n"]), "word-hashes")
    shards = Shards({r["length"]: r["count"] for r in hashed.groupBy("length").count().collect()}, bits)
    # The letters of words are those of the pattern: ninety at most.
    alphabet = np.array(sorted(ord(r["c"]) for r in hashed.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()), np.uint32)

    def bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False).view(U)
            length = batch.column("length").to_numpy(zero_copy_only=False)
            block = np.zeros(len(h), np.int64)
            for own in np.unique(length):
                block[length == own] = shards.block(h[length == own], int(own))
            lanes = [lane_bit(h, k).view(np.int64) for k in range(LANES)]
            yield pa.RecordBatch.from_arrays([pa.array(block), *map(pa.array, lanes)], names=["block", *(f"l{k}" for k in range(LANES))])

    ddl = "block long, " + ", ".join(f"l{k} long" for k in range(LANES))
    blocks = hashed.select("h", "length").mapInArrow(tidy(bits_of), ddl).groupBy("block").agg(*(F.bit_or(f"l{k}").alias(f"l{k}") for k in range(LANES)))
    blocks = materialize(blocks, "filter-blocks")
    found = None
    step = max(1, portion // (8 * LANES))
    for low in range(0, shards.blocks, step):
        high = min(shards.blocks, low + step)
        part = blocks.where((F.col("block") >= low) & (F.col("block") < high)).toArrow()
        lanes = np.zeros((LANES, high - low), U)
        at = part.column("block").to_numpy() - low
        for k in range(LANES):
            lanes[k, at] = part.column(f"l{k}").to_numpy().view(U)
        sent = spark.sparkContext.broadcast(lanes)

        def probe(batches: Iterator[pa.RecordBatch], low=low, high=high, sent=sent) -> Iterator[pa.RecordBatch]:
            lanes = sent.value
            for part in slices(batches, "word", 200_000):
                words = part.column("word").to_pylist()
                h = part.column("h").to_numpy(zero_copy_only=False)
                for _, which, letters in by_length(words):
                    group = max(1, 200_000 // (letters.shape[1] * max(1, len(alphabet))))
                    for k in range(0, len(which), group):
                        own, edits = [np.zeros(0, np.int64)], [np.zeros(0, U)]
                        for row, edit, length in edit_hashes(letters[k : k + group], alphabet):
                            block = shards.block(edit, length)
                            if block is None:
                                continue
                            here = (block >= low) & (block < high)
                            row, edit, block = row[here], edit[here], block[here] - low
                            for lane in range(LANES):
                                hit = lanes[lane][block] & lane_bit(edit, lane) != 0
                                row, edit, block = row[hit], edit[hit], block[hit]
                            own.append(h[which[k : k + group][row]])
                            edits.append(edit)
                        a, b = np.concatenate(own), np.concatenate(edits).view(np.int64)
                        if len(a):
                            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        positive = materialize(hashed.select("word", "h").mapInArrow(tidy(probe), "a long, b long").distinct(), "filter-positives")
        sent.destroy()
        found = positive if found is None else found.unionByName(positive)
    if found is None:
        return vocabulary.select(F.col("word").alias("a"), F.col("word").alias("b"), F.col("n").alias("n_a"), F.col("n").alias("n_b")).where(F.lit(False))
    second = hashed.select(F.col("h").alias("b"), F.col("word").alias("_word"), F.col("n").alias("n_b"))
    pairs = found.join(second, "b").select("a", F.col("_word").alias("b"), "n_b")
    first = hashed.select(F.col("h").alias("a"), F.col("word").alias("_word"), F.col("n").alias("n_a"))
    pairs = pairs.join(first, "a").select(F.col("_word").alias("a"), "b", "n_a", "n_b")
    return pairs.where(F.levenshtein("a", "b", 1) == 1).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms (word, form); each round doubles the steps taken."""
    at = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "variant-roots")
    while not at.where("moved").isEmpty():
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        at = at.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        at = materialize(at, "variant-roots")
    return at.select("word", "root")


def spelling_variants(counts: DataFrame, min_chars: int = 6, min_count: int = 5, ratio: int = 5, bits: int = 16, portion: int = 64 << 20) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of (word, n) that are long and frequent enough."""
    vocabulary = materialize(counts.where((F.char_length("word") >= min_chars) & (F.col("n") >= min_count)), "vocabulary")
    pairs = materialize(near_words(vocabulary, bits, portion), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    much = -F.col("best.less") >= ratio * F.col("n")
    rows = vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(much, F.col("best.near")).alias("form"), F.when(much, -F.col("best.less")).alias("form_n")
    )
    rows = materialize(rows, "variant-forms")
    rows = rows.join(roots(rows.where("form IS NOT NULL")), "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
