import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cliploom.llm import periods, queries


def plain_runs(words, times=4):
    """Every period by itself: maximal stretches with words q apart equal, without those of a smaller period."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            own = words[i : i + length]
            if length >= times * q and not any(q % p == 0 and own[p:] == own[:-p] for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=150))
def test_runs_of_few_words(words):
    assert periods.find_runs(np.array(words, np.int64)) == plain_runs(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.integers(1, 9)), max_size=6), st.integers(1, 5))
def test_runs_of_repeated_stretches(parts, times):
    words = [w for own, n in parts for w in own * n] * times
    assert periods.find_runs(np.array(words, np.int64)) == plain_runs(words)


def test_blocks_of_bounded_size(monkeypatch):
    monkeypatch.setattr(periods, "LONGEST", 4)
    rng = np.random.default_rng(3)
    for _ in range(60):
        words = np.concatenate([np.tile(rng.integers(0, 3, rng.integers(1, 50)), rng.integers(1, 7)) for _ in range(4)])
        assert periods.find_runs(words) == plain_runs(words.tolist())


def test_transform_is_exact():
    rng = np.random.default_rng(1)
    for n in (1, 2, 8, 64):
        x = rng.integers(0, periods.PRIME, (3, n)).astype(np.uint64)
        assert (periods.transform(periods.transform(x), inverse=True) == x).all()
        w = pow(periods.GENERATOR, (periods.PRIME - 1) // n, periods.PRIME)
        direct = [[sum(int(v) * pow(w, i * k, periods.PRIME) for i, v in enumerate(row)) % periods.PRIME for k in range(n)] for row in x]
        assert periods.transform(x).tolist() == direct


def test_one_word_and_long_periods():
    words = np.zeros(200_000, np.int64)
    assert periods.find_runs(words) == [(0, 200_000, 1)]
    rng = np.random.default_rng(5)
    own = rng.integers(0, 300, 30_011)
    text = np.concatenate((rng.integers(0, 300, 777), np.tile(own, 5), rng.integers(300, 400, 50)))
    assert (777, 5 * 30_011, 30_011) in [(s, n, q) for s, n, q in periods.find_runs(text) if q > 100] or any(q == 30_011 and n >= 5 * 30_011 for _, n, q in periods.find_runs(text))


def expected(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = [r for r in plain_runs(words) if r[1] >= 6]
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    stats = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *stats, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rows = [(i, " ".join(f"w{(i * k) % (3 + i % 40)}" for k in range(i % 300))) for i in range(200)]
    rows += [(1000, None), (1001, ""), (1002, "a a a a a a"), (1003, "a a a a a"), (1004, "x " * 70 + "y"), (1005, "a b " * 6 + "a\tc  d\n" * 5), (1006, "é ü " * 9)]
    folder = str(tmp_path_factory.mktemp("periods"))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def test_query_equals_plain_version(spark, small):
    folder, rows = small
    got = {tuple(r) for r in queries.op12_periodic_runs(spark, folder).collect()}
    assert got == {expected(*r) for r in rows}
    assert sum(r[1] > 0 for r in got) > 20


def test_hard_rows(spark, hard, empty):
    got = periods.periodic_runs(hard).collect()
    texts = hard.select("doc_id", "text").collect()
    key = lambda r: (str(r[0]), str(r[1]))
    short = sorted(((i, t) for i, t in texts if len(t or "") < 5000), key=key)
    want = []
    for i, t in short:
        words = (t or "").encode().split()
        runs = [r for r in plain_runs(words) if r[1] >= 6]
        assert not runs
        want.append((i, b" ".join(words).decode()))
    assert sorted(((r["doc_id"], r["collapsed"]) for r in got if len(r["collapsed"]) < 5000), key=key) == sorted(want, key=key)
    assert len(got) == len(texts)
    assert periods.periodic_runs(empty).count() == 0
