import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cliploom.llm import packing

FILE = public_tokenizers.path("byte_bpe_50k.json")


@cache
def both():
    with open(FILE, "rb") as f:
        return packing.Encoder(f.read(), long=50), Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def encoder():
    return both()[0]


@pytest.fixture(scope="module")
def library():
    return both()[1]


def test_ids_on_code_points(encoder, library):
    """All of the lower planes, where the white space is, and a part of the others."""
    points = [*range(0xD800), *range(0xE000, 0x20000), *range(0x20000, 0x110000, 97)]
    texts = [f"a{c}b {c}1{c}{c}  !{c}" for c in map(chr, points)]
    for i in range(0, len(texts), 50_000):
        part = texts[i : i + 50_000]
        expected = [e.ids for e in library.encode_batch_fast(part, add_special_tokens=False)]
        assert [encoder.encoding.encode(t, allowed_special="all") for t in part] == expected


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abT'sre  \t\n\x0b\x1c\x1f\x85\xa0　é.1<|endoftext|>")), max_size=400))
def test_ids_of_texts_cut_into_parts(text):
    encoder, library = both()
    assert "".join(encoder.parts(text)) == text
    assert encoder.encode(text + "<|endoftext|> x").tolist() == library.encode(text + "<|endoftext|> x", add_special_tokens=False).ids


def test_pieces_of_a_class_fill_a_sequence():
    for n in range(1, 3000):
        pieces = packing.cut(n, 1024, 1 / 64)
        assert sum(length for length, _ in pieces) == n
        for length, j in pieces:
            assert 0 < j * length <= 1024 and 1024 - j * length <= 16
        assert len(pieces) <= n // 1024 + 5


def check(rows, streams, capacity=1024, share=0.01):
    """The pieces cover each stream once, sequences have no gaps, and little is padded."""
    by_key, by_sequence = defaultdict(list), defaultdict(list)
    for key, start, length, crc, total, sequence, offset in rows:
        ids = streams[key]
        assert total == len(ids) and length > 0
        assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
        by_key[key].append((start, length))
        by_sequence[sequence].append((offset, length))
    assert by_key.keys() == streams.keys()
    for key, pieces in by_key.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == len(streams[key])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding <= share * sum(map(len, streams.values()))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=200))
def test_streams_of_any_length(sizes):
    streams = {k: np.arange(n, dtype="<u4") * (k + 1) for k, n in enumerate(sizes)}
    check(list(packing.packed(iter(streams.items()), 1024, 1 / 64)), streams, share=0.017)


def test_pack_equals_the_library(spark, plain, plain_rows, library):
    got = packing.pack(plain, FILE)
    streams = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in plain_rows}
    check([tuple(r) for r in got.collect()], streams)
    assert got.schema.simpleString() == (
        "struct<doc_id:bigint,start:bigint,length:bigint,ids_crc32:bigint,doc_tokens:bigint,sequence_id:bigint,offset:bigint>"
    )


def test_hard_rows(spark, hard, empty, library):
    rows = packing.pack(hard, FILE).collect()
    texts = [(r["doc_id"], r["text"]) for r in hard.collect()]
    # Repeated rows are packed each; together the pieces hold every row's ids.
    expected = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts)
    assert sum(r["length"] for r in rows) == expected
    assert sum(r["length"] for r in rows if r["doc_id"] is None) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts if i is None)
    assert packing.pack(empty, FILE).count() == 0
