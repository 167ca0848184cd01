"""Secret scans: fixed patterns, and a small character convolutional network over every candidate in its context.

Candidates are the patterns' matches, those that fail their length test, and every unbroken string of at least 12
key characters that has a digit. The network sees 24 characters before a candidate, up to 40 of it and what follows up to 80
in all; it embeds characters, convolves, takes the maximum over places and ends in one probability. It is trained
in numpy on labelled findings: matches of the patterns are secrets, other candidates are not. In every second copy of a
positive the words before it are hidden, so that the network learns what keys look like by themselves.

All distinct findings of all documents are used. They are dealt out by hash in parts of about ``part_rows``; in each of
``epochs`` rounds every part goes on from the common weights with one pass of Adam over its rows, and the parts' weights
and moments are averaged by rows. A quarter of the findings is held out. On all of them probabilities are calibrated (scale and shift
of the logit, Newton steps on sums over the rows). The threshold is recall-constrained: the highest one at which at least
``recall`` of the held-out secrets are found. Candidates above it that overlap no pattern match are added as kind ``model``.
Pattern matches always stay. Offsets count code points.

Defined results: null and empty texts have no spans; with fewer than three findings of a label on either side nothing is added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import map_slices, materialize, tidy

# The kinds and their patterns.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

LOOSE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
DIGIT = re.compile(r"[0-9]")
BEFORE, INSIDE, WIDTH = 24, 40, 80
KERNEL, FILTERS, EMBED = 5, 24, 8
#: Character classes: printable ASCII by itself, line ends, other letters, the rest; 0 is padding.
CLASSES = 100


def base_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """Matches that pass, by start and then kind; and the places of those that fail."""
    found, failed = [], []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST_ASSIGN:
            found.append((m.start(), 0, m.end()))
        else:
            failed.append((m.start(), m.end()))
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= LEAST_ACCESS:
            found.append((m.start(), 1, m.end()))
        else:
            failed.append((m.start(), m.end()))
    # Runs of 32 and more are what remains of all maximal runs.
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, k, e in sorted(found)], failed


def other_candidates(text: str, spans: list[tuple[int, int, str]], failed: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Failed matches and loose strings with a digit that overlap no span."""
    loose = [m.span() for m in LOOSE.finditer(text) if DIGIT.search(text, m.start(), m.end())]
    out, k = [], 0
    ends = sorted((s, e) for s, e, _ in spans)
    reach = 0
    for s, e in sorted({*loose, *failed}):
        while k < len(ends) and ends[k][0] < e:
            reach = max(reach, ends[k][1])
            k += 1
        if reach <= s:
            out.append((s, e))
    return out


def window(text: str, start: int, end: int) -> np.ndarray:
    """Character classes around a candidate, which begins at place ``BEFORE``."""
    before = text[max(0, start - BEFORE) : start]
    inside = text[start : min(end, start + INSIDE)]
    after = text[end : end + WIDTH - BEFORE - len(inside)]
    points = np.frombuffer((before + inside + after).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.where((points >= 32) & (points < 127), points - 31, np.where(points < 32, 96, np.where(points < 0x2000, 97, 98)))
    out = np.zeros(WIDTH, np.uint8)
    out[BEFORE - len(before) : BEFORE - len(before) + len(points)] = kinds
    return out


class CharCNN:
    """Embedding, one convolution with ReLU, maximum over places, one logit."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.w = {
            "embed": r.normal(0, 0.3, (CLASSES, EMBED)),
            "kernel": r.normal(0, 0.2, (KERNEL * EMBED, FILTERS)),
            "bias": np.zeros(FILTERS),
            "out": r.normal(0, 0.2, FILTERS),
            "shift": np.zeros(1),
        }
        self.scale = np.array([1.0, 0.0])

    def forward(self, x: np.ndarray) -> tuple:
        e = self.w["embed"][x]
        cols = np.lib.stride_tricks.sliding_window_view(e, KERNEL, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, KERNEL * EMBED)
        conv = cols @ self.w["kernel"] + self.w["bias"]
        best = conv.argmax(axis=1)
        top = np.maximum(np.take_along_axis(conv, best[:, None], 1)[:, 0], 0)
        return cols, best, top, top @ self.w["out"] + self.w["shift"][0]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict:
        cols, best, top, logit = self.forward(x)
        d = (1 / (1 + np.exp(-logit)) - y) / len(x)
        d_top = d[:, None] * self.w["out"] * (top > 0)
        picked = np.take_along_axis(cols, best[:, :, None], 1)  # rows, filters, kernel x embed
        d_cols = d_top[:, :, None] * self.w["kernel"].T
        d_embed = np.zeros_like(self.w["embed"])
        places = best[:, :, None] + np.arange(KERNEL)
        np.add.at(d_embed, x[np.arange(len(x))[:, None, None], places], d_cols.reshape(*best.shape, KERNEL, EMBED))
        return {"embed": d_embed, "kernel": np.einsum("nfk,nf->kf", picked, d_top), "bias": d_top.sum(0), "out": top.T @ d, "shift": np.array([d.sum()])}

    def fit(self, x: np.ndarray, y: np.ndarray, moments: list[dict], t: float, seed: int, batch: int = 128, rate: float = 0.01) -> float:
        """One pass of Adam over the rows, after ``t`` steps; changes the moments in place and gives the steps done."""
        order, (m, v) = np.random.default_rng(seed).permutation(len(x)), moments
        for i in range(0, len(x), batch):
            t += 1
            for k, g in self.gradients(x[order[i : i + batch]], y[order[i : i + batch]]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return t

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self.forward(x[i : i + 2048])[3] for i in range(0, len(x), 2048))])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * self.logits(x) + self.scale[1], -30, 30)))


class Scanner:
    def __init__(self, net: CharCNN | None, threshold: float):
        self.net, self.threshold = net, threshold

    def __call__(self, texts: list) -> list[list[tuple[int, int, str, float]]]:
        """Spans (start, end, kind, probability) of each text, by start and kind."""
        rows, places, seen = [], [], []
        for t, text in enumerate(texts):
            text = text or ""
            spans, failed = base_spans(text)
            more = other_candidates(text, spans, failed)
            rows.append(spans)
            for s, e, kind in [*spans, *((s, e, "model") for s, e in more)]:
                places.append((t, s, e, kind))
                seen.append(window(text, s, e))
        p = self.net.probability(np.array(seen)) if self.net is not None and seen else np.zeros(len(seen))
        out: list[list] = [[] for _ in texts]
        for (t, s, e, kind), prob in zip(places, p.tolist(), strict=True):
            if kind != "model" or (self.net is not None and prob >= self.threshold):
                out[t].append((s, e, kind, prob))
        for spans in out:
            spans.sort(key=lambda x: (x[0], KINDS.index(x[2])))
        return out


def _windows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDTH)


def _findings(docs: DataFrame, text_col: str) -> DataFrame:
    """(label, seen, held): the distinct windows of all findings; a quarter of them, by a digest, is held out."""

    def make():
        def findings(texts: list) -> dict:
            out = []
            for text in texts:
                spans, failed = base_spans(text)
                more = other_candidates(text, spans, failed)
                out.append([{"label": 1, "seen": window(text, s, e).tobytes()} for s, e, _ in spans] + [{"label": 0, "seen": window(text, s, e).tobytes()} for s, e in more])
            return {"found": out}

        return findings

    found = map_slices(docs.where(F.col(text_col).isNotNull()), text_col, make, "found array<struct<label:int,seen:binary>>", [])
    found = found.select(F.explode("found").alias("f")).select("f.label", "f.seen").distinct()
    return found.withColumn("held", F.substring(F.md5("seen"), 2, 1).isin("0", "4", "8", "c"))


def _round(learned: DataFrame, net: CharCNN, moments: list[dict], t: float, seed: int) -> tuple[CharCNN, list[dict], float]:
    """Weights, moments and steps after one pass over every part from the given ones, averaged over the parts by their rows."""
    names = sorted(net.w)

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("label", "ascending"), ("seen", "ascending")])
        x, y = _windows(table.column("seen")), table.column("label").to_numpy().astype(float)
        hidden = x[y == 1].copy()
        hidden[:, :BEFORE] = 0
        own, m = CharCNN(), [{k: d[k].copy() for k in names} for d in moments]
        own.w = {k: net.w[k].copy() for k in names}
        steps = own.fit(np.concatenate((x, hidden)), np.concatenate((y, np.ones(len(hidden)))), m, t, seed)
        state = np.concatenate([*(d[k].ravel() for d in (own.w, *m) for k in names), [steps]])
        return pa.table({"part": table.column("part")[:1], "n": pa.array([len(x)], pa.int64()), "state": pa.array([state.tolist()], pa.list_(pa.float64()))})

    done = learned.groupBy("part").applyInArrow(one, "part long, n long, state array<double>")
    # In order of the parts, so that sums come out the same each time.
    values = done.select("part", "n", F.posexplode("state").alias("at", "x")).groupBy("at").agg(F.array_sort(F.collect_list(F.struct("part", "n", "x"))).alias("l"))
    total = lambda f: F.aggregate("l", F.lit(0.0), lambda a, r: a + f(r))
    rows = values.select("at", (total(lambda r: r["n"] * r["x"]) / total(lambda r: r["n"])).alias("x")).collect()
    flat = np.array([r["x"] for r in sorted(rows)])
    after, at = [], 0
    for d in (net.w, *moments):
        after.append({})
        for k in names:
            after[-1][k] = flat[at : at + d[k].size].reshape(d[k].shape)
            at += d[k].size
    out = CharCNN()
    out.w = after[0]
    return out, after[1:], float(flat[-1])


def _valued(found: DataFrame, fn) -> DataFrame:
    """(label, value): what ``fn`` gives for arrays of windows."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(fn(_windows(batch.column("seen"))), pa.float64())], names=["label", "value"])

    return found.select("label", "seen").mapInArrow(tidy(run), "label int, value double")


def calibrated(logits: DataFrame) -> np.ndarray:
    """Scale and shift of the logit that fit the labels (label, value) best: Newton steps on the logistic loss."""
    scale, start = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    z, y = F.col("value"), F.col("label")
    for _ in range(25):
        at = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z * float(scale[0]) + float(scale[1])))
        p = 1 / (1 + F.exp(-at))
        sums = logits.select(z.alias("z"), (p - y).alias("d"), (p * (1 - p)).alias("s"))
        got = sums.agg(F.sum(F.col("d") * F.col("z")), F.sum("d"), F.sum(F.col("s") * F.col("z") ** 2), F.sum(F.col("s") * F.col("z")), F.sum("s")).first()
        hessian = np.array([[got[2], got[3]], [got[3], got[4]]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, np.array([got[0], got[1]]) + 1e-3 * (scale - start))
        scale = scale - step
        if np.abs(step).max() < 1e-11:
            break
    return np.round(scale, 9)  # sums differ in their last digits by the order of rows


def train(docs: DataFrame, text_col: str = "text", recall: float = 0.98, epochs: int = 8, part_rows: int = 8192) -> Scanner:
    """Fit the network, its calibration and its threshold on the labelled findings of all documents."""
    found = materialize(_findings(docs, text_col), "secret-findings")
    counts = {(r["label"], r["held"]): r["count"] for r in found.groupBy("label", "held").count().collect()}
    if min(counts.get((label, held), 0) for label in (0, 1) for held in (False, True)) < 3:
        return Scanner(None, 1.0)
    parts = -(-(counts[0, False] + counts[1, False]) // part_rows)
    learned = found.where(~F.col("held")).select("label", "seen", F.pmod(F.xxhash64("seen"), F.lit(parts)).alias("part"))
    net, t = CharCNN(), 0.0
    moments = [{k: np.zeros_like(a) for k, a in net.w.items()} for _ in range(2)]
    for seed in range(epochs):
        net, moments, t = _round(learned, net, moments, t, seed)
    held = found.where("held")
    net.scale = calibrated(materialize(_valued(held, net.logits), "secret-logits"))
    # The rows up to the threshold are 1 - recall of the held-out secrets.
    at = int(np.floor((1 - recall) * counts[1, True]))
    lowest = _valued(held.where("label = 1"), net.probability).orderBy("value").offset(at).limit(1)
    return Scanner(net, float(lowest.first()["value"]))


def scan(docs: DataFrame, scanner: Scanner, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``findings``: array of (start, end, kind, probability) over the whole texts."""

    def make():
        return lambda texts: {"findings": [[{"start": s, "end": e, "kind": k, "probability": p} for s, e, k, p in row] for row in scanner(texts)]}

    return map_slices(docs, text_col, make, "findings array<struct<start:long,end:long,kind:string,probability:double>>", list(keep))


def spelled(findings: str, base_only: bool):
    """'kind:start:end' of findings, comma-joined."""
    found = F.filter(findings, lambda f: f["kind"] != "model") if base_only else F.col(findings)
    parts = F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string")))
    return F.array_join(parts, ",")


def secrets_report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans)."""
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    return found.select(
        id_col, *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(spelled("findings", True).cast("binary"), 256).alias("base_sha256"), spelled("findings", False).alias("spans"),
    )


def redact(text: str, spans: Iterator[tuple[int, int]]) -> str:
    """Text with spans replaced by a mark."""
    out, at = [], 0
    for s, e in sorted(spans):
        if e > at:
            out += [text[at : max(s, at)], "[secret]"] if s >= at else []
            at = e
    return "".join([*out, text[at:]])
