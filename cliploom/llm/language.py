"""Language identification by interpolated Kneser-Ney character models.

One model per language: probabilities of a character after the ``ORDER - 1`` before it, with an absolute discount, the lower
orders built from continuation counts (in how many contexts a string ends), each interpolated with the next. Counts and
continuation counts come from Spark aggregations over the training rows; a model keeps its strings as sorted 64-bit
arrays that are searched by bisection. A text goes to the language whose model needs the fewest bits per character.

Characters are the UTF-16 code units of letters, so a string of ``ORDER`` is one 64-bit number and every script is told apart
without an alphabet; a letter beyond the first plane is two units. Letters that no training text has share what is left over.

Training reads a bounded sample of labelled rows, as a classifier may: about ``sample_rows`` per language and 100,000 in all,
of at most a million bytes each, chosen by a bound on the hash of id and text. So the size of what is sent to the tasks
does not grow with the input.

Rejection is calibrated on a fifth of the sample, scored by models of the other four fifths: in windows of 4, 8, 16, ...
symbols, how many bits a symbol do a language's own texts need, and how many do texts of other languages that are nearest to
it once their own model is left out? For each size the limit keeps all but a share ``miss`` of the own windows; where the cheapest
hundredth of the foreign ones lies higher, the limit is in the middle between both. A text is held against the
limit of the largest size not above its own that has ``ENOUGH`` windows. The same texts choose how sharply differences
become the score. The models that predict are then built from the whole sample.

Defined results: a text that is null or has no letter is ``und`` with score 0 and is rejected; ties go to the language that is
first in the alphabet; a language without training text is never predicted; without any training text all are ``und``; a text of fewer than four
symbols, or of a language with no text in the calibrating fifth, is not rejected.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliploom.llm.common import free, map_slices, materialize, tidy

ORDER = 4
BITS = 6  # of a symbol, where a model is not told otherwise
UNIT_BITS = 16  # of a code unit; 0 is the gap between words
PARTS = 5  # one of them calibrates
ENOUGH = 1000  # windows that a limit is taken from
BIN = 0.02  # bits; width of the bins in which windows are counted
SHARPNESS = tuple(2.0**-k for k in range(7))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: the remainder of the id's CRC-32 is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def letter_table() -> np.ndarray:
    """Which code units are letters by themselves."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x10000)])


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    """Code units of a text's letters with a gap before, between and after its words; empty if it has no letter."""
    units = np.frombuffer(text.lower().encode("utf-16-le", "surrogatepass"), np.uint16)
    out = np.where(table[units], units, np.uint16(0))
    half = units & 0xFC00
    lead = np.flatnonzero((half[:-1] == 0xD800) & (half[1:] == 0xDC00))
    if len(lead):
        points = 0x10000 + ((units[lead].astype(np.int64) & 0x3FF) << 10) + (units[lead + 1] & 0x3FF)
        kinds, of = np.unique(points, return_inverse=True)
        lead = lead[np.array([unicodedata.category(chr(p))[0] == "L" for p in kinds.tolist()])[of]]
        out[lead], out[lead + 1] = units[lead], units[lead + 1]
    gap = out == 0
    out = out[~gap | ~np.concatenate(([True], gap[:-1]))] if len(out) else out
    if not out.any():
        return out[:0]
    lead, tail = out[0] != 0, out[-1] != 0
    return np.concatenate((np.zeros(int(lead), np.uint16), out, np.zeros(int(tail), np.uint16)))


def grams(out: np.ndarray, order: int) -> np.ndarray:
    """The string of ``order`` symbols that ends at each place but the first; places before the text are gaps."""
    padded = np.concatenate((np.zeros(order - 2, np.uint64), out)) if order > 1 else out[1:]
    n = len(out) - 1
    code = np.zeros(n, np.uint64)
    for i in range(order):
        code = (code << np.uint64(UNIT_BITS)) | padded[i : i + n].astype(np.uint64)
    return code


class KneserNey:
    """One language's model: for each order, sorted strings with numerators, and sorted contexts with totals and kinds."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, n_symbols: int, bits: int = BITS):
        self.n_symbols, self.n_bits = n_symbols, bits
        self.levels: list[tuple] = []  # from order 1 up
        for order in range(ORDER, 0, -1):
            by = np.argsort(codes, kind="stable")
            codes, counts = codes[by], counts[by].astype(np.float64)
            context, first = np.unique(codes >> np.uint64(bits), return_index=True)
            total = np.add.reduceat(counts, first)
            kinds = np.diff(np.append(first, len(codes)))
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            self.levels.insert(0, (codes, np.maximum(counts - discount, 0), context, total, discount * kinds))
            # The lower order counts in how many contexts a string ends.
            mask = np.uint64((1 << (bits * (order - 1))) - 1)
            codes, counts = np.unique(codes & mask, return_counts=True)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        """Of the last symbol of each string of ORDER symbols after those before it."""
        p = np.full(len(codes), 1 / self.n_symbols)
        for order, (strings, numerator, context, total, spare) in enumerate(self.levels, 1):
            s = codes & np.uint64((1 << (self.n_bits * order)) - 1)
            before = s >> np.uint64(self.n_bits)
            i = np.minimum(np.searchsorted(strings, s), len(strings) - 1)
            j = np.minimum(np.searchsorted(context, before), len(context) - 1)
            seen = context[j] == before
            top = np.where(strings[i] == s, numerator[i], 0)
            p = np.where(seen, (top + spare[j] * p) / total[j], p)
        return p


class Scorer:
    """Bits per symbol of texts under every language; probabilities are worked out once per distinct string.

    Strings are found by open addressing in a table of fixed size; it starts anew when ``most`` strings are known.
    """

    def __init__(self, models: dict[str, KneserNey], table: np.ndarray, most: int | None = None):
        self.languages, self.models, self.table = sorted(models), models, table
        self.most = most or max(1 << 12, min(1 << 20, (1 << 24) // len(models)))
        self.shift = 64 - (self.most.bit_length() + 1)
        self.clear()

    def clear(self) -> None:
        self.slots = np.zeros(1 << (64 - self.shift), np.int32)  # number of the string there, 0 for none
        self.known = np.zeros(1, np.uint64)
        self.bits = np.zeros((1, len(self.models)), np.float32)

    def home(self, codes: np.ndarray) -> np.ndarray:
        h = (codes ^ (codes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(self.shift)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of strings, 0 for unknown ones."""
        at = self.home(codes)
        found = self.slots[at]
        other = np.flatnonzero((found > 0) & (self.known[found] != codes))
        while len(other):
            at[other] = (at[other] + 1) % len(self.slots)
            found[other] = self.slots[at[other]]
            other = other[(found[other] > 0) & (self.known[found[other]] != codes[other])]
        return found

    def learn(self, new: np.ndarray) -> None:
        """Add distinct unknown strings."""
        number = np.arange(len(new), dtype=np.int32) + np.int32(len(self.known))
        bits = np.stack([-np.log2(self.models[k].probability(new)) for k in self.languages], 1)
        self.known, self.bits = np.concatenate((self.known, new)), np.concatenate((self.bits, bits.astype(np.float32)))
        at = self.home(new)
        while len(new):
            free = self.slots[at] == 0
            self.slots[at[free]] = number[free]
            left = self.slots[at] != number
            at, number, new = (at[left] + 1) % len(self.slots), number[left], new[left]

    def __call__(self, text: str) -> tuple[np.ndarray | None, int]:
        out = symbols(text, self.table)
        if not len(out):
            return None, 0
        codes = grams(out, ORDER)
        total = np.zeros(len(self.models))
        for part in self.per_symbol(codes):
            total += part.sum(axis=0, dtype=np.float64)
        return total / len(codes), len(codes)

    def per_symbol(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        """Bits of every symbol (rows) under every language (columns), some rows at a time."""
        for b in range(0, len(codes), self.most):
            part = codes[b : b + self.most]
            at = self.find(part)
            if (at == 0).any():
                new = np.unique(part[at == 0])
                if len(self.known) + len(new) > self.most + 1:
                    self.clear()
                    new = np.unique(part)
                self.learn(new)
                at = self.find(part)
            yield self.bits[at]


class Model:
    def __init__(self, models: dict[str, KneserNey]):
        self.models = models
        self.limits: dict[str, list[tuple[int, float]]] = {}  # per language: size of a window, bits a symbol; ascending
        self.sharpness = 1.0

    def scorer(self) -> Callable[[list], dict]:
        table = letter_table()
        score = Scorer(self.models, table) if self.models else None

        def predict(texts: list) -> dict:
            out: dict[str, list] = {"lang_pred": [], "score": [], "cross_entropy": [], "n_symbols": [], "rejected": []}
            for text in texts:
                bits, n = score(text) if score and text else (None, 0)
                if bits is None:
                    row = ("und", 0.0, None, 0, True)
                else:
                    best = int(np.argmin(bits))
                    odds = np.exp(-self.sharpness * np.minimum((bits - bits[best]) * np.sqrt(n), 60))
                    language = score.languages[best]
                    row = (language, float(1 / odds.sum()), float(bits[best]), n, bool(bits[best] > self.limit(language, n)))
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            return out

        return predict

    def limit(self, language: str, n: int) -> float:
        """Cross-entropy above which a text of n symbols is rejected."""
        return next((bits for size, bits in reversed(self.limits.get(language, [])) if size <= n), np.inf)


PREDICTED = "lang_pred string, score double, cross_entropy double, n_symbols long, rejected boolean"


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 2000, miss: float = 1e-4) -> Model:
    """Fit the models on at most ``sample_rows`` rows per language, outside the held-out ones; ``miss``: share of a
    language's own windows that its limit may reject."""
    spark = docs.sparkSession
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.xxhash64(F.col(id_col).cast("string"), text_col).alias("h"), F.col(lang_col).alias("lang"), F.octet_length(text_col).alias("size"), F.col(text_col).alias("text"))
    # Rows whose hash lies below a bound: about sample_rows per language, found without ordering anything.
    count = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    sample_rows = max(1, min(sample_rows, 100_000 // max(1, len(count))))
    bounds = [(lang, min(2**63 - 1, int(-(2**63) + min(1.0, sample_rows / n) * (2**64 - 1)))) for lang, n in count.items()]
    bound = F.broadcast(spark.createDataFrame(bounds, "lang string, bound long"))
    chosen = rows.where(F.col("size") <= 1_000_000).join(bound, "lang").where(F.col("h") <= F.col("bound"))
    sample = materialize(chosen.select("lang", "text", (F.pmod(F.xxhash64("h"), F.lit(PARTS)) == 0).alias("judge")), "language-sample")

    def count_grams(batches):
        table = letter_table()
        for batch in batches:
            data = batch.to_pydict()
            keys = list(zip(data["lang"], data["judge"], strict=True))
            for key in sorted(set(keys)):
                found = [grams(s, ORDER) for t, k in zip(data["text"], keys, strict=True) if k == key and len(s := symbols(t, table))]
                if found:
                    code, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([key[0]] * len(code)), "judge": pa.array([key[1]] * len(code)), "code": pa.array(code.astype(np.int64)), "n": pa.array(n)})

    counted = sample.mapInArrow(tidy(count_grams), "lang string, judge boolean, code long, n long").groupBy("lang", "code")
    counted = counted.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~F.col("judge"), F.col("n"))), F.lit(0)).alias("fitted")).toPandas()
    # All symbols that end a string, and one for any other.
    n_symbols = len(np.unique(counted["code"].to_numpy().astype(np.uint64) & np.uint64((1 << UNIT_BITS) - 1))) + 1
    def fit(rows, column: str) -> dict[str, KneserNey]:
        rows = rows[rows[column] > 0]
        return {lang: KneserNey(part["code"].to_numpy().astype(np.uint64), part[column].to_numpy(), n_symbols, UNIT_BITS) for lang, part in rows.groupby("lang")}

    model = Model(fit(counted, "n"))
    judges = Model(fit(counted, "fitted"))
    if judges.models:
        _calibrate(model, judges, sample.where("judge"), miss)
    return model


def window_counts(bits: np.ndarray, own: int | None) -> Iterator[tuple[str, int, int, np.ndarray, np.ndarray]]:
    """From bits per symbol and language: kind, language, size, bins and their counts, for all whole windows of every size.

    ``own`` windows are those of the text's language, ``other`` ones those of the cheapest language besides.
    """
    upto = np.concatenate((np.zeros((1, bits.shape[1])), np.cumsum(bits, axis=0, dtype=np.float64)))
    size = 4
    while size < len(upto):
        means = np.diff(upto[::size], axis=0) / size
        if own is not None:
            yield "own", own, size, *np.unique(np.ceil(means[:, own] / BIN).astype(np.int64), return_counts=True)
            means[:, own] = np.inf
        near = means.argmin(axis=1)
        for k in np.unique(near) if means.shape[1] > (own is not None) else ():
            yield "other", int(k), size, *np.unique(np.ceil(means[near == k, k] / BIN).astype(np.int64), return_counts=True)
        size *= 2


def _calibrate(model: Model, judges: Model, sample: DataFrame, miss: float) -> None:
    """Limits and sharpness from texts that ``judges`` were not built from."""

    def judge(batches):
        table = letter_table()
        score = Scorer(judges.models, table)
        place = {k: i for i, k in enumerate(score.languages)}
        for batch in batches:
            seen: dict[tuple, float] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                found = symbols(text, table)
                if not len(found):
                    continue
                own, total, codes = place.get(lang), 0.0, grams(found, ORDER)
                for bits in score.per_symbol(codes):
                    total = total + bits.sum(axis=0, dtype=np.float64)
                    for kind, k, size, bins, n in window_counts(bits, own):
                        for b, c in zip(bins.tolist(), n.tolist(), strict=True):
                            key = (kind, score.languages[k], size, b)
                            seen[key] = seen.get(key, 0.0) + c
                if own is not None:
                    far = np.minimum((total - total.min()) / np.sqrt(len(codes)), 60)
                    for i, s in enumerate(SHARPNESS):
                        loss = s * far[own] + np.log(np.exp(-s * far).sum())
                        seen["loss", "", i, 0] = seen.get(("loss", "", i, 0), 0.0) + float(loss)
            if seen:
                kind, lang, size, b = zip(*seen, strict=True)
                yield pa.RecordBatch.from_pydict({"kind": pa.array(kind), "lang": pa.array(lang), "size": pa.array(size, pa.int64()), "bin": pa.array(b, pa.int64()), "n": pa.array(list(seen.values()), pa.float64())})

    got = sample.select("lang", "text").mapInArrow(tidy(judge), "kind string, lang string, size long, bin long, n double")
    got = got.groupBy("kind", "lang", "size", "bin").agg(F.sum("n").alias("n")).toPandas()
    loss = got[got["kind"] == "loss"].sort_values("size")["n"].to_numpy()
    if len(loss):
        model.sharpness = SHARPNESS[int(np.argmin(loss))]
    groups = {key: part.sort_values("bin") for key, part in got[got["kind"] != "loss"].groupby(["kind", "lang", "size"])}

    def level(kind: str, lang: str, size: int, share: float) -> float:
        """The bits that a share of the windows does not exceed."""
        part = groups[kind, lang, size]
        upto = part["n"].cumsum().to_numpy()
        return float(part["bin"].to_numpy()[np.searchsorted(upto, np.ceil(share * upto[-1]))] * BIN)

    for lang in model.models:
        sizes = sorted(size for kind, k, size in groups if kind == "own" and k == lang)
        enough = [size for size in sizes if groups["own", lang, size]["n"].sum() >= ENOUGH] or sizes[:1]
        limits = []
        for size in enough:
            top = level("own", lang, size, 1 - miss)
            foreign = level("other", lang, size, 0.01) if ("other", lang, size) in groups else top
            limits.append((int(size), max(top, (top + foreign) / 2)))
        model.limits[lang] = limits


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred, score (0 to 1), cross_entropy (bits per symbol), n_symbols, rejected."""
    return map_slices(docs, text_col, model.scorer, PREDICTED, list(keep))


def drop_rejected(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that identification rejects; columns stay as they are."""
    names = [f.name for f in T.StructType.fromDDL(PREDICTED)]
    own = {n: free(docs, f"_{n}") for n in names}
    added = ", ".join(f"{own[f.name]} {f.dataType.simpleString()}" for f in T.StructType.fromDDL(PREDICTED))

    def make():
        predict = model.scorer()
        return lambda texts: {own[k]: v for k, v in predict(texts).items()}

    got = map_slices(docs, text_col, make, added, docs.columns)
    return got.where(~F.col(own["rejected"])).select(*docs.columns)
