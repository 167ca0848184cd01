import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, _drop string, _text int, n string, sid long, lang_pred string, spans int, digest string"
LONG = " ".join(f"word{i % 997}x{i % 13}" for i in range(40_000))
NOTICE = "This line of notice stands on a great many sites of the web today."


def hard_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from the old house near the river bank"
    near = base.replace("lazy", "sleepy") + " in the evening when the sun has set behind the hills and all the birds are quiet again"
    texts = [None, "", base, base, base.upper(), near, near + " now", "\n", " ", "é", LONG, LONG + " end", f"{NOTICE}\n{base} one", f"{NOTICE}\nother words here, that nobody else has"]
    texts += [f"{NOTICE}\nsite text number {i} of {i * i} things" for i in range(8)] + ["a" * 3000, "a" * 2000, "<|endoftext|> x", "no. 5", "12345 !!"]
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i % 7}" if i % 5 else None, None if i % 4 == 0 else i, i, "d", i, "n", i, "x", 1, "g") for i, t in enumerate(texts)]
    return [*rows, rows[2], rows[12], (None, base, None, None, *[None] * 9), (None, None, *[None] * 11)]


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def plain_rows():
    """Distinct ids only: what the brute-force versions compare."""
    seen = {}
    for r in hard_rows():
        if r[0] is not None:
            seen.setdefault(r[0], r[1])
    return sorted(seen.items())


@pytest.fixture(scope="session")
def plain(spark, plain_rows):
    return spark.createDataFrame(plain_rows, "doc_id long, text string").repartition(4)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
