"""Operators on training text against plain versions, on inputs with nulls, ties, long texts and clashing columns."""

import base64
import hashlib
import math
import random
import re
import time
import uuid
import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cliploom.llm import bpe, components, decontaminate, exact_dedup, jaccard, language, lines, secrets, substrings, token_counts, warc
from cliploom.llm.common import scratch_dir
from cliploom.sources import scratch

FILE = public_tokenizers.path("byte_bpe_50k.json")
NOTICE = "This line of notice stands on a great many sites of the web today."


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_token_counts_and_cache(spark, hard, library):
    cache = f"{scratch_dir(spark)}/cache-{uuid.uuid4().hex}"
    for _ in range(2):
        got = token_counts.token_counts(hard, FILE, cache).collect()
        assert len(got) == hard.count()
        texts = {hashlib.sha256((r["text"] or "").encode()).hexdigest(): r["text"] or "" for r in hard.select("text").collect()}
        for r in got:
            assert (r["n_bytes"], r["n_tokens"]) == (len(texts[r["digest"]].encode()), len(ids_of(library, texts[r["digest"]])))
        stored = spark.read.parquet(cache)
        assert stored.count() == stored.select("digest").distinct().count() == len(texts)  # the second time all are known


def test_token_counts_with_sentencepiece(spark, plain, plain_rows):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    pieces = sentencepiece.SentencePieceProcessor(model_file=model)
    got = by_id(token_counts.token_counts(plain, model, f"{scratch_dir(spark)}/cache-{uuid.uuid4().hex}"))
    assert {d: r["n_tokens"] for d, r in got.items()} == {d: len(pieces.encode(t or "")) for d, t in plain_rows}


def test_bpe_round_trip(hard, plain, plain_rows, library):
    got = by_id(bpe.round_trip(plain, FILE))
    for d, t in plain_rows:
        ids = ids_of(library, t)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == want
    back = by_id(bpe.decode_ids(bpe.encode_texts(plain, FILE), FILE))
    assert {d: r["text"] for d, r in back.items()} == {d: t or "" for d, t in plain_rows}
    assert bpe.round_trip(hard, FILE, keep=("doc_id", "n", "_text")).count() == hard.count()


def test_bpe_equals_library_on_random_text(library):
    with open(FILE, "rb") as f:
        codec = bpe.Codec(f.read(), max_words=200)
    r = random.Random(1)
    pool = "aeiou thrsn.,'’\n\t 0123日本語éüß€𝕏 \x85<|endoftext|>"
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(60))) for _ in range(3000)] + ["'s" * 40, "x" * 5000, "\n" * 300 + "a"]
    for i in range(0, len(texts), 200):
        for text, ids in zip(texts[i : i + 200], codec.encode_all(texts[i : i + 200]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == ids_of(library, text)
            assert codec.decode(ids) == library.decode(ids_of(library, text), skip_special_tokens=False)


def test_words_that_come_back_are_not_encoded_again():
    with open(FILE, "rb") as f:
        codec = bpe.Codec(f.read())
    words, learned, learn = [f" word{i}x" for i in range(120_000)], [], codec.learn
    codec.learn = lambda fresh: (learned.append(len(fresh)), learn(fresh))
    for _ in range(2):
        for i in range(0, len(words), 40_000):
            assert len(codec.have(set(words[i : i + 40_000]))) >= 40_000
    # So do words that are met in turns with many new ones.
    for i in range(4):
        codec.have({f" more{k}x" for k in range(i * 20_000, i * 20_000 + 20_000)})
        codec.have(set(words[:40_000]))
    assert sum(learned) == 200_000


def test_long_text_is_cut_into_words_piecewise(library):
    with open(FILE, "rb") as f:
        codec = bpe.Codec(f.read())
    text = "Some words, 12 of them; don't stop.\n\n" * 130_000
    assert np.frombuffer(codec.encode_all([text])[0], "<u4").tolist() == ids_of(library, text)


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup(hard, keep):
    rows = [(r["doc_id"], r["text"] or "") for r in hard.collect()]
    groups = {}
    for d, t in rows:
        groups.setdefault(t, []).append(d)
    pick = max if keep == "max" else min
    want = []
    for d, t in rows:
        best = pick(x for x in groups[t] if x is not None) if any(x is not None for x in groups[t]) else None
        want.append((d, best, len(groups[t]), d == best, hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_dedup(hard, keep=keep, fan_in=2).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_repeated_substrings(spark, plain, plain_rows):
    r = random.Random(3)
    passage = "".join(r.choice("abcd ") for _ in range(400))
    rows = list(plain_rows)
    for i in range(80):
        t = "".join(r.choice("abcdefgh ") for _ in range(r.choice([0, 49, 50, 51, 120, 400])))
        for _ in range(r.randrange(3)):
            a, size, at = r.randrange(300), r.choice([49, 50, 51, 70, 100]), r.randrange(len(t) + 1)
            t = t[:at] + passage[a : a + size] + t[at:]
        rows.append((1000 + i, t))
    got = by_id(substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    want = brute.repeats(rows)
    assert {d: (x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for d, x in got.items()} == want
    assert sum(w[1] for w in want.values()) > 3000


def test_hot_passage_is_dealt_out(spark, plain_rows, monkeypatch, tmp_path):
    """One passage in very many documents with text of their own around it: the same rows, and no merge of a whole anchor."""
    r = random.Random(11)
    make = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passage, other = make(160), make(120)
    rows = list(plain_rows)
    for i in range(600):
        t = make(r.choice([0, 3, 40, 90])) + passage[r.choice([0, 0, 0, 5]) :] + make(r.choice([0, 3, 40, 90]))
        rows.append((1000 + i, t + (other + make(60) if i % 40 == 0 else "")))
    df = spark.createDataFrame([(d if d != 1000 else None, t) for d, t in rows], "doc_id long, text string").repartition(5)
    want = brute.repeats([(d if d != 1000 else -(10**6), t) for d, t in rows])
    real, folder = substrings._resolve, str(tmp_path)

    def watched(*args):
        inner = real(*args)

        def run(batches):
            batches = list(batches)
            groups = Counter(h for b in batches for h in b.column("h").to_pylist())
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(max(groups.values(), default=0)))
            yield from inner(iter(batches))

        return run

    monkeypatch.setattr(substrings, "_resolve", watched)
    for limits in ({"many": 8, "hot_runs": 40}, {"many": 8}, {"hot_runs": 40, "slice_bytes": 20_000}):
        for f in tmp_path.iterdir():
            f.unlink()
        got = by_id(substrings.remove_repeats(df, **limits))
        assert {(d if d is not None else -(10**6)): (x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for d, x in got.items()} == want
        top = max(int(f.read_text()) for f in tmp_path.iterdir())
        assert top <= 40 if "hot_runs" in limits else top > 100, top


def test_merged_shards_keep_suffix_order():
    r = random.Random(4)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randrange(1, 40))) for _ in range(30)]
    one = substrings.repeated_windows(np.arange(30), texts, 6, shard_bytes=10**6)
    many = substrings.repeated_windows(np.arange(30), texts, 6, shard_bytes=50)
    first = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - 5):
            first.setdefault(t[i : i + 6], d)
    want = [[i for i in range(len(t) - 5) if first[t[i : i + 6]] < d] for d, t in enumerate(texts)]
    assert [sorted(x.tolist()) for x in one] == [sorted(x.tolist()) for x in many] == want


def test_secret_patterns_and_threshold(spark):
    r = random.Random(2)
    key = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for i in range(240):
        kinds = [f'api_key = "{key(24)}"', f"TOKEN: {key(40)} end", f"AKIA{key(16).upper()}", key(32), "password: short", f"order {r.randrange(10**14)} ok", f"ref-{r.randrange(10**9)}-{r.randrange(10**6)}"]
        rows.append((i, f"some words {kinds[i % 7]} and more {kinds[(i * 3 + 1) % 7]}."))
    rows += [(900, None), (901, ""), (902, "paſsword = 12345678"), (903, "secret=" + "b" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scanner = secrets.train(df)
    assert scanner.net is not None and 0 < scanner.threshold < 1
    got = by_id(secrets.secrets_report(secrets.scan(df, scanner)))
    for d, t in rows:
        spans, _ = secrets.base_spans(t or "")
        text = ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
        assert got[d]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [x for x in got[d]["spans"].split(",") if x and not x.startswith("model")] == (text.split(",") if text else [])
    assert got[902]["n_assign"] == 0 and got[903]["n_assign"] == 1
    # On held-out findings the network tells keys from other strings.
    held = [f'value "{key(40)}" x' for _ in range(50)], [f"order {r.randrange(10**14)} ok" for _ in range(50)]
    score = lambda t: scanner.net.probability(np.array([secrets.window(t, *secrets.LOOSE.search(t).span())]))[0]
    assert np.mean([score(t) for t in held[0]]) > np.mean([score(t) for t in held[1]]) + 0.3


def test_secret_gradients_are_right():
    net = secrets.CharCNN()
    r = np.random.default_rng(0)
    x, y = r.integers(0, secrets.CLASSES, (6, secrets.WIDTH)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0.0])
    loss = lambda: float(np.mean(np.log1p(np.exp(-np.where(y > 0, 1, -1) * net.forward(x)[3]))))
    for name, g in net.gradients(x, y).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        was = net.w[name][at]
        net.w[name][at] = was + 1e-5
        up = loss()
        net.w[name][at] = was - 1e-5
        down = loss()
        net.w[name][at] = was
        assert abs((up - down) / 2e-5 - g[at]) < 1e-4


def test_similar_components(spark, plain, plain_rows):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    common = [r.choice(vocabulary) for _ in range(25)]
    rows = list(plain_rows)
    for g in range(40):
        n = r.choice([1, 3, 4, 5, 6, 8, 10, 14, 20, 50, 80, 150])
        base = [r.choice(vocabulary) for _ in range(n)] + (common if g % 3 == 0 else [])
        for _ in range(r.choice([1, 2, 3, 10])):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((1000 + len(rows), " ".join(w)))
    got = by_id(jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    want = brute.similar(rows)
    assert {d: (x["n_shingles"], x["component_id"]) for d, x in got.items()} == want
    assert len({c for _, c in want.values()}) < len(want) - 20


def test_pigeonhole_finds_every_similar_pair():
    """Any two sets within the bound share a key, whatever segments the allocation skips or makes one-off."""
    r = np.random.default_rng(1)
    slots = jaccard.Slots(2000, 80)
    for kind in slots.kind.values():
        n = len(kind) // 10
        kind[:n], kind[n : 2 * n] = -1, 1
    for _ in range(300):
        n = int(r.integers(4, 400))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        d = int(len(a) * 2 // 9)
        cut = int(r.integers(0, d + 1))
        b = np.unique(np.concatenate((r.permutation(a)[cut:], r.integers(0, 2**63, (d - cut) // 2).astype(np.uint64) * np.uint64(2))))
        if not jaccard.jaccard_at_least(a, b, 80) or len(a) == 0:
            continue
        keys = [set(np.concatenate([slots.keys(s, k) for k in slots.of(len(s))] or [np.zeros(0)]).tolist()) for s in (a, b)]
        assert (len(a) == len(b) and (a == b).all()) or keys[0] & keys[1]


def test_wide_sketches_lose_nothing_and_tell_sets_apart(spark):
    r = np.random.default_rng(4)
    rows, similar = [], []
    for n in (500, 600, 1000, 1030, 3000, 9000):
        base = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        for gone in (0.0, 0.05, 0.19, 0.4, 1.0):
            kept = base[r.random(len(base)) >= gone]
            other = np.unique(np.concatenate((kept, r.integers(0, 2**63, int(n * gone * (gone > 0.3))).astype(np.uint64))))
            k = len(rows)
            rows.append((k, *((len(s), jaccard.parity_sketch(s), jaccard.wide_sketch(s)) for s in (base, other))))
            similar.append(jaccard.jaccard_at_least(base, other, 80))
    x = "struct<n: long, sketch: array<long>, wide: array<long>>"
    got = spark.createDataFrame(rows, f"k int, xa {x}, xb {x}").select("k", jaccard._possible("xa", "xb", 80).alias("a"), jaccard._possible("xb", "xa", 80).alias("b")).collect()
    for g in got:
        assert g["a"] == g["b"]
        assert g["a"] or not similar[g["k"]]
        assert not g["a"] or rows[g["k"]][1][0] and g["k"] % 5 != 4  # unrelated sets never pass
    assert sum(g["a"] for g in got) < len(got) - 8


def test_links_within_open_groups(spark):
    """Long sets that share a passage: pairs beyond the group's leader, in all bands of size."""
    r = random.Random(9)
    word = lambda: f"v{r.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(12):
        base = [word() for _ in range(r.choice([40, 75, 160, 700, 2000]))]
        for _ in range(4):
            w = passage + base
            for _ in range(len(w) // 70):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w[: len(w) - r.randrange(len(w) // 20)])))
    got = by_id(jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert {d: (x["n_shingles"], x["component_id"]) for d, x in got.items()} == brute.similar(rows)


def test_groups_of_keys_across_batches():
    import pyarrow as pa

    rows = [(1, 1), (1, 1), (2, 1), (2, 2), (2, 2), (2, 3), (3, 4), (4, 1), (4, 9), (5, 1), (6, 1), (6, 2), (6, 3), (6, 4), (6, 5), (6, 6), (6, 7), (7, 7)]
    want = {2: [1, 2, 3], 4: [1, 9], 6: [1, 2, 3, 4, 5, 6, 7]}
    for size in range(1, 19):
        for most in (1, 2, 4, 100):
            batches = [pa.RecordBatch.from_pydict({"sig": [x for x, _ in rows[i : i + size]], "sid": [y for _, y in rows[i : i + size]]}) for i in range(0, len(rows), size)]
            got = [tuple(x.values()) for b in jaccard._groups(iter(batches), most) for x in b.to_pylist()]
            whole = sorted(s for g, s in got if g is None)
            parts = {}
            for g, s in got:
                if g is not None:
                    parts.setdefault(g, []).extend(s)
            parts = {g: s for g, s in parts.items() if len(s) > 1}  # a lone row in parts is harmless
            assert sorted([*whole, *parts.values()]) == sorted(want.values())


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (200, 101), (5, 5)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 100}


def test_boilerplate_lines(hard):
    got = lines.drop_boilerplate(hard, counts=True).collect()
    assert len(got) == hard.count()
    notice = "This line of notice"
    holders = {r["doc_id"] for r in got if notice in (r["text"] or "")}
    assert holders == {12}  # the smallest id keeps it
    assert {r["doc_id"]: r["_n_removed"] for r in got if r["doc_id"] in (0, 1, 13, 14)} == {0: 0, 1: 0, 13: 1, 14: 1}
    assert [r["text"] for r in got if r["doc_id"] in (0, 1)] == [None, ""] or [r["text"] for r in got if r["doc_id"] in (0, 1)] == ["", None]


def test_many_lines_and_short_lines(spark):
    long = "\n".join(f"{NOTICE}" if i % 1000 == 7 else f"own line {i}" for i in range(200_000))
    rows = [(i, f"{NOTICE}\nSign in\nown words of {i}\n\nMenu", f"s{i}") for i in range(25)] + [(99, long, "big")]
    rows += [(200 + i, "Menu\nmore", "one") for i in range(30)]
    began = time.time()
    got = by_id(lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), short_threshold=25))
    assert time.time() - began < 60
    assert got[0]["text"] == rows[0][1]
    # 25 sites: the notice and both short lines go from all but the first; blank lines stay.
    assert all(got[i]["text"] == f"own words of {i}\n" for i in range(1, 25))
    assert got[99]["text"] == "\n".join(x for x in long.split("\n") if x != NOTICE)
    assert all(got[200 + i]["text"] == "more" for i in range(30))
    # With a higher bound for short lines these stay.
    got = by_id(lines.drop_boilerplate(spark.createDataFrame(rows[:25], "doc_id long, text string, source string"), short_threshold=26))
    assert all(got[i]["text"] == f"Sign in\nown words of {i}\n\nMenu" for i in range(1, 25))


@pytest.mark.parametrize("threshold", [1, 3, 200, 1000])
def test_line_spread_is_exact(spark, threshold):
    """Estimates decide only far from the threshold."""
    rows = [(f"line{k}", f"site{s}", s) for k, n in enumerate([1, 2, 3, 4, 150, 199, 200, 201, 260, 1400]) for s in range(n) for _ in range(1 + k % 2)]
    given = spark.createDataFrame(rows, "line string, site string, id long").selectExpr("*", f"{threshold} AS need")
    got = {r["line"] for r in lines.boilerplate(given).collect()}
    assert got == {f"line{k}" for k, n in enumerate([1, 2, 3, 4, 150, 199, 200, 201, 260, 1400]) if n >= threshold}


@pytest.mark.parametrize("block_words", [5, 2_000_000])
def test_decontamination(spark, plain_rows, block_words):
    r = random.Random(6)
    vocabulary = ["Alpha", "beta", "ğama", "d4", "x", "the"]
    items = [(str(i), " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 9, 10, 11, 25])))) for i in range(20)] + [("i1", None), ("i2", "!?"), ("a", "the d4 x ğama"), ("b", "the d4 x ğama")]
    rows = list(plain_rows)
    for i in range(60):
        w = [r.choice(vocabulary) for _ in range(r.randrange(40))]
        if i % 3 == 0:
            w[3:3] = r.choice(items[:20])[1].upper().split()
        rows.append((1000 + i, ", ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    got = by_id(decontaminate.contamination_report(decontaminate.find_contamination(docs, benchmark, block_words=block_words)))
    want = brute.contamination(rows, items)
    assert {d: tuple(x)[1:] for d, x in got.items()} == want
    if block_words > 5:
        left = by_id(decontaminate.decontaminate(docs, benchmark))
        for d, t in rows:
            if not want[d][1]:
                assert left[d]["text"] == t


def test_blocks_of_phrases_are_cut_at_once(spark, plain_rows):
    """Overlapping items of different blocks lose all their words, and words that a cut brings together stay."""
    r = random.Random(9)
    w = [f"w{i}" for i in range(15)]
    joined = [f"j{i}" for i in range(10)]
    items = [("a", " ".join(w[:10])), ("b", " ".join(w[5:])), ("c", " ".join(joined))] + [(f"r{i}", " ".join(r.choice("pqr") for _ in range(r.choice([4, 10, 14])))) for i in range(12)]
    rows = [*plain_rows, (500, " ".join(["x", *w, "y"])), (501, " ".join([*joined[:5], *w[:10], *joined[5:]])), (502, None), (503, ", ".join(w * 2))]
    rows += [(1000 + i, " ".join(r.choice("pqr") for _ in range(r.randrange(60)))) for i in range(40)]
    docs = spark.createDataFrame([(d, t, d) for d, t in rows], "doc_id long, text string, _place long").repartition(3)
    word = decontaminate.words_of
    want = {}
    for d, t in rows:
        words, gone = word(t), set()
        for _, item in items:
            p = word(item)
            n = min(10, len(p))
            for q in {tuple(p[i : i + n]) for i in range(len(p) - n + 1)}:
                gone.update(k for i in range(len(words) - n + 1) if tuple(words[i : i + n]) == q for k in range(i, i + n))
        want[d] = [x for i, x in enumerate(words) if i not in gone]
    assert want[500] == [b"x", b"y"] and want[501] == word(" ".join(joined))
    for block_words in (10, 25, 200_000):
        for order in ("item_id", F.desc("item_id")):
            benchmark = spark.createDataFrame(items, "item_id string, text string").orderBy(order)
            left = decontaminate.decontaminate(docs, benchmark, block_words=block_words)
            assert left.columns == docs.columns
            got = by_id(left)
            assert {d: word(x["text"]) for d, x in got.items()} == want
            assert got[502]["text"] is None and all(x["_place"] == d for d, x in got.items())


def test_fm_index_finds_all_places():
    r = np.random.default_rng(2)
    text = r.integers(1, 5, 500)
    index = decontaminate.FMIndex(text)
    for n in (1, 2, 4):
        phrases = r.integers(1, 5, (40, n))
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high, strict=True):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_fm_index_knows_no_symbols_beyond_its_text():
    index = decontaminate.FMIndex(np.array([3, 2, 3, 2, 1]))
    low, high = index.search(np.array([[2, 4], [4, 2], [900, 2], [3, 2]]))
    assert (high - low).tolist() == [0, 0, 0, 2]


@pytest.mark.parametrize("compression, split", [("gzip", "128m"), ("none", "3001")])
def test_warc(spark, compression, split):
    magic = "WARC/1.0\r\n"
    fake = magic + "WARC-Type: response\r\nWARC-Record-ID: <urn:record:77>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, f"x{magic}y"), (6, fake), (7, fake * 3 + "tail"), (8, magic), (9, "é" * 1000 + magic * 5), (10, "z" * 5000), (11, "\r\n\r\n"), (12, "q" * 20000 + magic + "w" * 20000)]
    rows += [(13 + i, f"x{magic}Content-Length: {n}\r\n\r\n" + "y" * 100) for i, n in enumerate([-40, -110, 2**63 - 1, 2**48 + 1, "1e3"])]
    rows += [(i, f"p{i} " * (i % 50) + (fake if i % 7 == 0 else "")) for i in range(20, 120)]
    df = spark.createDataFrame([(p, None if p % 5 == 0 else f"http://x/é\r\n {p}", h, "x") for p, h in rows], "page_id long, url string, html string, _id string").repartition(3)
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(df, path, compression=compression, records_per_file=50)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = sorted(tuple(r) for r in warc.warc_pages(spark, path).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    largest = {}
    for p, h in rows:
        largest[h or ""] = max(p, largest.get(h or "", p))
    want = []
    for p, h in rows:
        b, main = (h or "").encode(), largest[h or ""]
        want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if main == p else "revisit", None if main == p else main))
    assert got == sorted(want, key=lambda r: r[0])


def test_marks_go_along_chains():
    r = np.random.default_rng(4)
    for n in (1, 2, 7, 300):
        following = np.array([r.choice([-1, *range(i + 1, min(n, i + 4))]) if i + 1 < n else -1 for i in range(n)])
        for _ in range(5):
            entries = np.unique(r.integers(0, n, r.integers(0, 3)))
            want = set()
            for k in entries:
                while k >= 0:
                    want.add(int(k))
                    k = following[k]
            assert np.flatnonzero(warc._reached(following, entries)).tolist() == sorted(want)


def test_language_equals_a_plain_model(spark):
    """Prediction, cross-entropy and rejection against models of dictionaries, fitted on the same rows."""
    r = random.Random(21)
    sounds = {"aa": "tha ing ou er st".split(), "bb": "sch ung ei ü st".split(), "cc": "ción os ña lo st".split()}
    make = lambda k, n: " ".join("".join(r.choice(sounds[k]) for _ in range(3)) for _ in range(n))
    rows = [(i, make(k, r.choice([3, 30, 90])), k) for i, k in enumerate(sorted(sounds) * 60)]
    rows += [(1000, "Жизнь " * 30, None), (1001, None, "aa"), (1002, "..", "bb"), (1003, make("aa", 9) + " " + make("cc", 4), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    strings = lambda t: [("\0\0" + w)[i : i + 4] for w in ["\0" + "\0".join(re.findall(r"[^\W\d_]+", t.lower())) + "\0"] for i in range(len(w) - 1)]
    counts = {k: Counter() for k in sounds}
    for i, t, k in rows:
        if k and t and zlib.crc32(str(i).encode()) % 4 != 2 and re.search(r"[^\W\d_]", t):
            counts[k].update(strings(t))
    alphabet = {s[-1] for c in counts.values() for s in c}

    def levels(count):
        out = []
        for order in (4, 3, 2, 1):
            ones, twos = (sum(v == n for v in count.values()) for n in (1, 2))
            discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            total, kinds = Counter(), Counter()
            for s, n in count.items():
                total[s[:-1]] += n
                kinds[s[:-1]] += 1
            out.insert(0, (count, total, kinds, discount))
            count = Counter({s[1:]: 0 for s in count}) + Counter(s[1:] for s in count)
        return out

    def bits(t, fitted):
        sum_ = 0.0
        for s in strings(t):
            p = 1 / (len(alphabet) + 1)
            for order, (count, total, kinds, discount) in enumerate(fitted, 1):
                part = s[4 - order :]
                if part[:-1] in total:
                    p = (max(count[part] - discount, 0) + discount * kinds[part[:-1]] * p) / total[part[:-1]]
            sum_ -= math.log2(p)
        return sum_ / len(strings(t))

    fitted = {k: levels(c) for k, c in counts.items()}
    got = by_id(language.identify(docs, model))
    assert sorted(got) == sorted(i for i, _, _ in rows)
    for i, t, _ in rows:
        x = got[i]
        if not t or not re.search(r"[^\W\d_]", t):
            assert (x["lang_pred"], x["score"], x["rejected"]) == ("und", 0.0, True)
            continue
        plain = {k: bits(t, f) for k, f in fitted.items()}
        best = min(sorted(plain), key=plain.get)
        n = len(strings(t))
        odds = [math.exp(-model.sharpness * min((v - plain[best]) * math.sqrt(n), 60)) for v in plain.values()]
        assert x["lang_pred"] == best and abs(x["cross_entropy"] - plain[best]) < 1e-4 and x["n_symbols"] == n
        assert abs(x["score"] - 1 / sum(odds)) < 1e-3
        limit = [b for size, b in model.limits[best] if size <= n]
        assert x["rejected"] == bool(limit and x["cross_entropy"] > limit[-1])
    assert got[1000]["rejected"]


def test_windows_are_counted_by_size():
    bits = np.array([[1.0, 3.0], [1.0, 3.0], [1.0, 3.0], [1.0, 3.0], [2.0, 9.0], [2.0, 9.0], [2.0, 9.0], [2.0, 9.0], [50.0, 50.0]])
    got = {(kind, k, size): (bins.tolist(), n.tolist()) for kind, k, size, bins, n in language.window_counts(bits, 0)}
    at = lambda x: math.ceil(x / language.BIN)
    assert got == {("own", 0, 4): ([at(1), at(2)], [1, 1]), ("other", 1, 4): ([at(3), at(9)], [1, 1]), ("own", 0, 8): ([at(1.5)], [1]), ("other", 1, 8): ([at(6)], [1])}
    assert not [x for x in language.window_counts(bits[:, :1], 0) if x[0] == "other"]


def test_language(spark, hard):
    # Invented languages: consonants and vowels in different proportions.
    r = random.Random(8)
    parts = {"aa": ["tha", "ing", "ou", "er"], "bb": ["sch", "ung", "ei", "ü"], "cc": ["ción", "os", "ña", "lo"]}
    make = lambda k, n: " ".join("".join(r.choice(parts[k]) for _ in range(r.randrange(1, 4))) for _ in range(n))
    rows = [(i, make(k, r.choice([5, 40, 200])), k) for i, k in enumerate(r.choice("abc") * 2 for _ in range(600))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, sample_rows=100)
    got = language.identify(docs, model, keep=("doc_id", "lang")).withColumn("held_out", language.held_out()).where("held_out")
    got = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count_if("rejected"), F.min("score"), F.max("score")).first()
    assert got[0] > 0.98 and got[1] == 0 and 0 <= got[2] <= got[3] <= 1
    odd = by_id(language.identify(spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "жизнь " * 50)], "doc_id long, text string"), model))
    assert [odd[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and all(odd[i]["rejected"] for i in (1, 2, 3, 4))
    kept = language.drop_rejected(hard, model)
    assert kept.columns == hard.columns


def test_languages_of_all_scripts_are_told_apart(spark):
    """Scripts that long Latin texts crowd out, letters from U+3000 on and beyond the first plane, and texts of two scripts."""
    r = random.Random(12)
    pools = {k: [chr(start + i) for i in range(n)] for k, start, n in [("la", 0x61, 26), ("gr", 0x3B1, 17), ("ar", 0x627, 20), ("ko", 0xAC00, 200), ("xa", 0x20000, 200)]}
    pools |= {"ru": list("аеионтслврыэъ"), "uk": list("аеионтслврієї"), "zh": list("的一是不了人我在有他这中大来"), "yu": list("的一是不了人佢喺有嘅咁中大嚟")}
    make = lambda k, n: " ".join("".join(r.choice(pools[k]) for _ in range(5)) for _ in range(n))
    sizes = {k: 400 if k == "la" else 12 for k in pools}
    latin = [(10**5 + i, " ".join(chr(0xC0 + r.randrange(300)) * 3 + make("la", 1) for _ in range(60)), "la") for i in range(40)]
    rows = latin + [(i, make(k, sizes[k]), k) for i, k in enumerate(sorted(pools) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    fresh = [(i, make(k, 12), k) for i, k in enumerate(sorted(pools) * 10)]
    fresh += [(1000 + i, make(k, 30) + " " + make("la", 6), k) for i, k in enumerate(["gr", "ru", "uk", "zh", "yu", "ko", "xa"] * 5)]
    got = by_id(language.identify(spark.createDataFrame(fresh, docs.schema), model))
    assert {i: got[i]["lang_pred"] for i, _, _ in fresh} == {i: k for i, _, k in fresh}


def test_more_than_a_thousand_labels(spark):
    rows = [(i, f"{chr(0x4E00 + i) * 2}{chr(0xAC00 + i)}", f"l{i}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    model = language.train(docs)
    assert len(model.models) > 1000
    got = language.identify(docs.where("doc_id < 20"), model, keep=("doc_id", "lang")).collect()
    learned = [x for x in got if x["lang"] in model.models]
    assert len(learned) > 5 and all(x["lang_pred"] == x["lang"] for x in learned)


def test_string_table_of_the_scorer_starts_anew():
    r = np.random.default_rng(5)
    texts = ["".join(chr(0x4E00 + x) for x in r.integers(0, 300, 150)) for _ in range(30)]
    table = language.letter_table()
    code, n = np.unique(np.concatenate([language.grams(language.symbols(t, table), language.ORDER) for t in texts[:10]]), return_counts=True)
    models = {"a": language.KneserNey(code, n, 400, language.UNIT_BITS), "b": language.KneserNey(code[::3], n[::3], 400, language.UNIT_BITS)}
    small, large = language.Scorer(models, table, most=64), language.Scorer(models, table)
    for t in texts:
        (x, i), (y, j) = small(t), large(t)
        direct = [-np.log2(models[k].probability(language.grams(language.symbols(t, table), language.ORDER))).mean() for k in "ab"]
        assert i == j and np.allclose(x, y) and np.allclose(x, direct)


def test_kneser_ney_sums_to_one():
    r = np.random.default_rng(3)
    codes = r.integers(0, 6, (3000, language.ORDER)).astype(np.uint64)
    packed = np.zeros(3000, np.uint64)
    for i in range(language.ORDER):
        packed = packed << np.uint64(language.BITS) | codes[:, i]
    code, n = np.unique(packed, return_counts=True)
    model = language.KneserNey(code, n, 64)
    for context in (0, 1 << 6, 12345, int(packed[0] >> np.uint64(6))):
        strings = (np.uint64(context) << np.uint64(6)) | np.arange(64, dtype=np.uint64)
        assert abs(model.probability(strings).sum() - 1) < 1e-9


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id string, text string")
    assert token_counts.token_counts(empty, FILE, f"{scratch_dir(spark)}/cache-{uuid.uuid4().hex}").count() == 0
    assert bpe.round_trip(empty, FILE).count() == 0
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert substrings.remove_repeats(empty).count() == 0
    assert secrets.scan(empty, secrets.train(empty)).count() == 0
    assert jaccard.similar_components(empty).count() == 0
    assert lines.drop_boilerplate(empty).count() == 0
    assert decontaminate.find_contamination(empty, bench).count() == 0
    assert language.identify(empty, language.train(empty)).count() == 0
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.warc_pages(spark, path).count() == 0


def test_hard_rows_go_through(hard):
    n = hard.count()
    assert substrings.remove_repeats(hard).count() == n
    assert jaccard.similar_components(hard).count() == n
    assert jaccard.keep_one_of_each(hard).columns == hard.columns
    assert secrets.scan(hard, secrets.train(hard)).count() == n
    assert language.identify(hard, language.train(hard)).count() == n
    bench = hard.sparkSession.createDataFrame([("1", "quick brown fox jumps over the lazy dog and runs far away")], "item_id string, text string")
    assert decontaminate.decontaminate(hard, bench).columns == hard.columns


def test_secret_network_learns_from_all_findings(spark):
    r = random.Random(5)
    key = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    one = lambda: r.choice([f"token={key(24)}", f"value {key(40)}", f"order {r.randrange(10**15)} ok", f"ref-{r.randrange(10**9)}-{r.randrange(10**6)} is"])
    texts = ["; ".join(one() for _ in range(100)) for _ in range(130)]
    scanner = secrets.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    held = set()
    for t in texts:
        spans, failed = secrets.base_spans(t)
        for label, (s, e) in [*((1, x[:2]) for x in spans), *((0, x) for x in secrets.other_candidates(t, spans, failed))]:
            seen = secrets.window(t, s, e)
            if hashlib.md5(seen.tobytes()).digest()[0] % 4 == 0:
                held.add((label, seen.tobytes()))
    y = np.array([label for label, _ in held])
    x = np.array([np.frombuffer(seen, np.uint8) for _, seen in held])
    assert len(x) > 3000
    # The threshold is that of all held-out secrets, and the calibration is the best one for all held-out findings.
    p = scanner.net.probability(x)
    assert abs(scanner.threshold - np.sort(p[y == 1])[int(np.floor(0.02 * (y == 1).sum()))]) < 1e-9
    z = scanner.net.forward(x)[3]
    slope = np.array([((p - y) * z).sum(), (p - y).sum()]) + 1e-3 * (scanner.net.scale - np.array([1.0, 0.0]))
    assert np.abs(slope).max() < 1e-3
    assert p[y == 1].mean() > p[y == 0].mean() + 0.5


def test_equal_texts_stand_in_a_shard_once(monkeypatch):
    passage, met, real = b"a passage of words which stands in a great many of the documents, whole.", [], substrings.repeated_windows
    monkeypatch.setattr(substrings, "repeated_windows", lambda ids, texts, *a: (met.extend(texts), real(ids, texts, *a))[1])
    # (anchor, id, place, context): the same passage in other surroundings, a part of it in a smaller and in a larger id, a repeated id.
    rows = [(7, i, 5, hashlib.md5(b"%d" % k).digest() + passage + hashlib.md5(b"-%d" % k).digest()) for k, i in enumerate([3, 4, 5, 5, *range(10, 40)])]
    rows += [(7, 1, 0, b"#" * 30 + passage[:60]), (7, 50, 0, passage[4:66] + b"!" * 20)]
    rows.sort()
    batch = pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(("h", "id", "lo", "context"))})
    got = {(i, p) for out in substrings._resolve(50, 400_000)(iter([batch])) for i, lo in zip(out["id"].to_pylist(), out["lo"].to_pylist(), strict=True) for p in np.frombuffer(lo, "<u4").tolist()}
    first = {}
    for _, i, _, text in rows:
        for at in range(len(text) - 49):
            first[text[at : at + 50]] = min(i, first.get(text[at : at + 50], i))
    assert got == {(i, lo + at) for _, i, lo, text in rows for at in range(len(text) - 49) if first[text[at : at + 50]] < i}
    assert len(met) == len(set(met)) < len(rows) / 4


def test_repeated_runs_travel_packed(spark, monkeypatch):
    """Copies of whole documents over many buckets: rows by bucket and part, not by run, and no shuffle left behind."""
    r = random.Random(8)
    make = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(400))
    texts = [make() for _ in range(30)]
    rows = [(100 * k + i, t + (f" end {k}" if i % 3 else "")) for k in range(4) for i, t in enumerate(texts)]
    written, real = {}, scratch.materialize
    for place in (scratch, substrings):
        monkeypatch.setattr(place, "materialize", lambda df, label="stage": written.setdefault(label, real(df, label)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
        got = by_id(substrings.remove_repeats(df))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {d: (x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for d, x in got.items()} == brute.repeats(rows)
    closed = written["repeat-runs"].where("not open")
    runs = sum(len(substrings.unpack_runs(bytes(x["runs"]))[0]) for x in closed.collect())
    assert runs > 3 * 30 * 2000 / 20 and closed.count() <= min(23 * 23 + 2 * 23, runs / 5)
    assert written["repeat-spans"].count() == 90
    assert spark.conf.get(scratch.CLEANUP, "false") == "false"


def test_packed_runs_come_back():
    r = random.Random(2)
    for n in (0, 1, 5, 3000):
        ids = np.sort(np.array([r.choice([-(2**63), 2**63 - 1, 0, r.randrange(2**40)]) for _ in range(n)], np.int64))
        lo, more = np.array([r.randrange(2**32) for _ in range(n)], np.int64), np.array([r.randrange(256) for _ in range(n)], np.int64)
        for x, y in zip(substrings.unpack_runs(substrings.pack_runs(ids, lo, more)), (ids, lo, more), strict=True):
            assert x.tolist() == y.tolist()
        ids, lo = ids % 7, lo % 3000
        want = {(i, p) for i, a, m in zip(ids.tolist(), lo.tolist(), more.tolist(), strict=True) for p in range(a, a + m + 1)}
        got = [(i, p) for i, a, m in zip(*(x.tolist() for x in substrings.joined(ids, lo, more)), strict=True) for p in range(a, a + m + 1)]
        assert len(got) == len(set(got)) and set(got) == want
