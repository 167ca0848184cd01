"""Periodic runs of words, found by block convolution.

A run is a stretch of words with smallest period q, at least 4 * q words long, that cannot be extended. The texts of a slice are one
array of word numbers with a word of its own behind each text, so that nothing matches across.

*Scales.* At scale B = 1, 2, 4, ... runs of period B <= q < 2 * B are found. Such a run holds an aligned block of B words, at x, with
two more periods behind the block; the block occurs again at x + q. So the block is correlated with the window behind it: the sums
of squared differences for all shifts of [B, 2 * B) come from number-theoretic transforms modulo a prime, where the sum of a true
occurrence is exactly 0. Word numbers stand for random residues; a chance zero is thrown out later.

*Blocks worth a transform.* All four-word sequences that start in the block of a run recur within 2 * B words: blocks where one does not
are left out. So are blocks whose window lies within a known run of a smaller period, since two runs share fewer words
than their periods together; a run found at this scale always has another block.

*Seeds to runs.* A zero at distance d is a seed. Prefix hashes tell whether the period goes on for two more periods (equal words have
equal hashes, so nothing is lost); at most one seed a block survives, and exact comparison extends it to the left and to the right.

Defined results: null and empty texts have no words, no runs and collapse to the empty text; texts of any length are searched whole, a
task holds a slice of about ``budget`` bytes or a single text; repeated rows are searched alike; an empty table stays empty; only the
id and the text are read, other columns are ignored; with ``edit`` given, null ids are passed to it like others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cliploom.llm.common import slices, tidy

U = np.uint64
PRIME, GENERATOR = 2013265921, 31  # 15 * 2^27 + 1
P = U(PRIME)
RUNS = "array<struct<start: long, length: long, period: long>>"
LONGEST = 1 << 20  # words of a block in one transform


@cache
def roots(n: int, inverse: bool) -> np.ndarray:
    """The first n / 2 powers of an n-th root of unity (of its inverse)."""
    w = pow(GENERATOR, (PRIME - 1) // n, PRIME)
    w = pow(w, PRIME - 2, PRIME) if inverse else w
    out = np.ones(max(1, n // 2), U)
    done = 1
    while done < len(out):
        step = U(pow(w, done, PRIME))
        out[done : 2 * done] = out[:done] * step % P
        done *= 2
    return out


def transform(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform of every row; the length of rows is a power of two."""
    m, n = x.shape
    w = roots(n, inverse)
    half, stride = n // 2, 1
    while half:
        x = x.reshape(m, 2, half, stride)
        a, b = x[:, 0], x[:, 1]
        y = np.empty((m, half, 2, stride), U)
        y[:, :, 0] = (a + b) % P
        y[:, :, 1] = (a + (P - b)) * w[::stride][None, :half, None] % P
        x = y
        half, stride = half // 2, stride * 2
    x = x.reshape(m, n)
    return x * U(pow(n, PRIME - 2, PRIME)) % P if inverse else x


def zero_mismatch(values: np.ndarray, starts: np.ndarray, size: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance): where blocks of ``size`` values at ``starts`` occur at distances of [shift, shift + size)."""
    n = 2 * size
    at, by = [], []
    back = (-np.arange(size)) % n
    rows = max(1, (1 << 18) // n)
    for k in range(0, len(starts), rows):
        own = starts[k : k + rows]
        block = values[own[:, None] + np.arange(size)]
        window = values[own[:, None] + shift + np.arange(n)]
        turned = np.zeros((len(own), n), U)
        turned[:, back] = block
        common = transform(transform(turned) * transform(window) % P, inverse=True)[:, :size]
        squares = np.zeros((len(own), n + 1), U)
        np.cumsum(window * window % P, axis=1, out=squares[:, 1:])
        sums = (squares[:, size:n] - squares[:, :size]) % P + (block * block % P).sum(axis=1)[:, None] % P
        i, d = np.nonzero((sums + 2 * (P - common)) % P == 0)
        at.append(own[i])
        by.append(d + shift)
    return np.concatenate(at), np.concatenate(by)


def next_distance(keys: np.ndarray) -> np.ndarray:
    """How far away the next equal key is; very far if there is none."""
    order = np.argsort(keys, kind="stable")
    out = np.full(len(keys), np.iinfo(np.int64).max)
    same = keys[order[1:]] == keys[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def extend(words: np.ndarray, x: int, d: int) -> tuple[int, int]:
    """The stretch (start, end) around x in which words d apart are equal."""
    start, step = x, 64
    while start > 0:
        low = max(0, start - step)
        differ = np.flatnonzero(words[low:start] != words[low + d : start + d])
        if len(differ):
            start = low + int(differ[-1]) + 1
            break
        start, step = low, 2 * step
    end, step = x, 64
    while end + d < len(words):
        high = min(len(words) - d, end + step)
        differ = np.flatnonzero(words[end:high] != words[end + d : high + d])
        if len(differ):
            end += int(differ[0])
            break
        end, step = high, 2 * step
    return start, end + d


def find_runs(words: np.ndarray, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``times`` (four or more) periods in an array of word numbers."""
    n = len(words)
    if n < times:
        return []
    draw = np.random.default_rng(12)
    top = int(words.max()) + 1
    values = draw.integers(0, PRIME, top, dtype=np.int64).astype(U)[words]
    wide = draw.integers(0, 1 << 63, top, dtype=np.int64).astype(U)[words]
    base = np.full(n + 1, 0x9E3779B97F4A7C15, U)
    base[0] = 1
    base = np.cumprod(base, dtype=U)
    prefix = np.concatenate((np.zeros(1, U), np.cumsum(wide * base[:n], dtype=U)))
    grams = np.zeros(n, U)
    for j in range(4):
        grams[: n - j] += wide[j:] * U(2 * j + 1) * U(0xD6E8FEB86659FD93)
    far = {1: next_distance(words), 4: next_distance(grams)}
    found: list[tuple[int, int, int]] = []
    scale, worst = 1, far[1]
    while 3 * scale <= n:
        if scale == 4:
            worst = far[4][: n // 4 * 4].reshape(-1, 4).max(axis=1)
        elif scale > 1:
            worst = worst[: len(worst) // 2 * 2].reshape(-1, 2).max(axis=1)
        starts = np.flatnonzero(worst < 2 * scale) * scale
        starts = starts[starts + 3 * scale <= n]
        if len(starts) and found:
            reach = np.zeros(n, np.int64)
            np.maximum.at(reach, [r[0] for r in found], [r[0] + r[1] for r in found])
            starts = starts[np.maximum.accumulate(reach)[starts] < starts + 3 * scale]
        if len(starts):
            size = min(scale, LONGEST)
            parts = [zero_mismatch(values, starts, size, shift) for shift in range(scale, 2 * scale, size)]
            x, d = (np.concatenate(p) for p in zip(*parts, strict=True))
            inside = x + scale + 2 * d <= n
            x, d = x[inside], d[inside]
            goes_on = (prefix[x + scale + d] - prefix[x]) * base[d] == prefix[x + scale + 2 * d] - prefix[x + d]
            x, d = x[goes_on], d[goes_on]
            order = np.argsort(x, kind="stable")
            done: dict[int, int] = {}
            for at, by in zip(x[order].tolist(), d[order].tolist(), strict=True):
                if at < done.get(by, 0):
                    continue
                start, end = extend(words, at, by)
                done[by] = max(done.get(by, 0), end - by)
                if end - start >= times * by:
                    found.append((start, end - start, by))
        scale *= 2
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def periodic_runs(
    docs: DataFrame, edit: Callable[[object, list[bytes]], list[bytes]] | None = None, id_col: str = "doc_id", text_col: str = "text", least: int = 6, budget: int = 2_000_000,
) -> DataFrame:
    """(id, runs, collapsed): the runs of every text (word number, words, period) and the text without what its runs repeat.

    ``edit`` may change the words of a row before they are searched. Runs have ``least`` words and four periods at least.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("runs", T.StructType.fromDDL(f"r {RUNS}")["r"].dataType), T.StructField("collapsed", T.StringType())])

    def search(keys: list, texts: list) -> tuple[list, list]:
        split = [(t or "").encode().split() for t in texts]
        if edit:
            split = [edit(k, words) for k, words in zip(keys, split, strict=True)]
        flat: list = []
        for words in split:
            flat += words
            flat.append(None)  # a word of its own behind each text
        size = np.array([len(words) for words in split])
        close = np.cumsum(size + 1) - 1
        coded = pa.array(flat, pa.large_binary()).dictionary_encode()
        number = coded.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        number[close] = len(coded.dictionary) + np.arange(len(split))
        runs: list[list] = [[] for _ in split]
        for start, length, period in find_runs(number):
            if length >= least:
                k = int(np.searchsorted(close, start))
                runs[k].append((start - int(close[k] - size[k]), length, period))
        texts_out = []
        for words, own in zip(split, runs, strict=True):
            if own:
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, [s + q for s, _, q in own], 1)
                np.add.at(step, [s + n for s, n, _ in own], -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
            texts_out.append(b" ".join(words).decode())
        return runs, texts_out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = to_arrow_schema(schema)
        for part in slices(batches, "text", budget):
            keys = part.column("id").to_pylist()
            runs, collapsed = search(keys, part.column("text").to_pylist())
            listed = [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in runs]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip((keys, listed, collapsed), out_schema, strict=True)], schema=out_schema)

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(tidy(run), schema)
