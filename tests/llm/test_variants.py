import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cliploom.llm import queries, variants


def one_edit(a, b):
    """Exactly one insertion, deletion or replacement."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(counts, min_chars=6, min_count=5, ratio=5):
    words = {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= ratio * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def corpus():
    rng = np.random.default_rng(7)
    stems = ["letter", "lettér", "planet", "planets", "garden", "gardens", "ÀÉÿàé×÷x", "aaaaaaa", "aaaaaaaa", "straße", "wonder", "wander", "wandern", "wonders"]
    rows = []
    for i in range(400):
        words = []
        for _ in range(30):
            w = stems[int(rng.zipf(1.5)) % len(stems)]
            if rng.random() < 0.1:
                k = int(rng.integers(0, len(w)))
                w = [w[:k] + w[k + 1 :], w[:k] + "e" + w[k:], w[:k] + "a" + w[k + 1 :]][int(rng.integers(0, 3))]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, " 1".join(words) if i % 2 else ", ".join(words)))
    return [*rows, (1000, None), (1001, ""), (1002, "12 !!")]


def plain_counts(rows):
    out = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{w}".encode())
            if h % 199 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            out[w] += 1
    return out


@pytest.mark.parametrize("portion", [64 << 20, 64])
def test_query_equals_plain_version(spark, tmp_path, portion):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    if portion > 1000:
        got = queries.op13_spelling_variants(spark, str(tmp_path))
        assert got.schema.simpleString() == "struct<word:string,form:string,root:string,n:bigint,n_near:bigint,form_n:bigint>"
    else:  # many portions of the filter, and one that lets nearly everything pass
        counts = variants.word_counts(spark.read.parquet(f"{tmp_path}/documents.parquet"), queries.planted_misspellings)
        got = variants.spelling_variants(counts, bits=1, portion=portion)
    want = plain(plain_counts(rows))
    assert {tuple(r) for r in got.collect()} == want
    assert sum(r[1] is not None for r in want) > 10
    assert len({r[2] for r in want}) < len(want)


@settings(max_examples=100, deadline=None)
@given(st.text("abcé", min_size=1, max_size=9))
def test_hashes_of_edits_are_those_of_the_words(word):
    alphabet = np.array(sorted(map(ord, "abcé")), np.uint32)
    letters = np.array([[ord(c) for c in word]], np.uint32)
    made = {int(h) for _, hs, _ in variants.edit_hashes(letters, alphabet) for h in hs}
    edits = {word[:k] + word[k + 1 :] for k in range(len(word))} | {word[:k] + c + word[k + 1 :] for k in range(len(word)) for c in "abcé" if c > word[k]}
    assert made == set(variants.word_hashes(sorted(edits - {""})).tolist())


def test_chains_of_forms(spark):
    n = {"wonder": 5**7, "wonderx": 5**6, "wonderxy": 5**5, "wonderxyz": 5**4, "wonderxyzz": 5**3, "awonderxyzz": 5**2, "abwonderxyzz": 5}
    got = variants.spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long"))
    rows = {tuple(r) for r in got.collect()}
    assert rows == plain(n)
    assert {r[2] for r in rows} == {"wonder"}


def test_hard_rows(spark, hard, empty):
    counts = variants.word_counts(hard)
    want = Counter()
    for r in hard.collect():
        want.update(re.findall("[a-zÀ-ÿ]+", (r["text"] or "").encode().lower().decode()))
    assert dict(map(tuple, counts.collect())) == dict(want)
    long = spark.createDataFrame([("q" * 3000, 50), ("q" * 2999 + "r", 7), ("q" * 3001, 5)], "word string, n long")
    assert {tuple(r) for r in variants.spelling_variants(long).collect()} == plain({"q" * 3000: 50, "q" * 2999 + "r": 7, "q" * 3001: 5})
    assert variants.spelling_variants(variants.word_counts(empty)).count() == 0
