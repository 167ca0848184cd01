"""A model is asked once for a text, whatever ends a run."""

import uuid

import pytest
from pyspark.sql import functions as F

from cliploom.operators.model_calls import _requests, ask_once
from cliploom.sources.scratch import scratch_dir


def recorder(folder, bad=(), stop=()):
    """A model that notes every text it is asked for."""

    class Killed(BaseException):
        pass

    def fn(texts):
        for t in texts:
            (folder / uuid.uuid4().hex).write_text(t)
        if any(t in stop for t in texts):
            raise Killed
        if any(t in bad for t in texts):
            raise ValueError("no")
        return [(t.upper(), len(t), 1) if t != "silent" else None for t in texts]

    return fn


def asked(folder):
    return sorted(p.read_text() for p in folder.iterdir())


def test_requests_hold_the_budget():
    texts = ["a" * 8, "b" * 8, "", "c" * 400, "d" * 4, "é" * 2]
    assert list(_requests(texts, 4)) == [(0, 3), (3, 4), (4, 6)]
    assert list(_requests([], 4)) == []


def test_only_new_texts_are_asked_for(spark, tmp_path):
    ledger = f"{scratch_dir(spark)}/ledger-{uuid.uuid4().hex}"
    rows = [(i, f"t{i % 20}") for i in range(300)] + [(300, None), (301, "")]
    docs = spark.createDataFrame(rows, "id long, text string")
    ask = lambda df, model="m": {r["id"]: r for r in ask_once(df, ["id"], "text", recorder(tmp_path), ledger, "p", model).collect()}
    first = ask(docs.filter("id < 5"))
    assert sorted(first) == list(range(5)) and asked(tmp_path) == [f"t{i}" for i in range(5)]
    got = ask(docs)
    assert {i: r["content"] for i, r in got.items()} == {i: (t or "").upper() for i, t in rows}
    assert asked(tmp_path) == sorted({t or "" for _, t in rows})
    assert ask(docs) == got and len(asked(tmp_path)) == 21
    ask(docs.filter("id = 7"), "other")
    assert asked(tmp_path).count("t7") == 2
    assert ask_once(docs.filter("id < 0"), ["id"], "text", recorder(tmp_path), ledger, "p", "m").count() == 0


def test_bad_answers_are_rows_and_asked_again(spark, tmp_path):
    ledger = f"{scratch_dir(spark)}/ledger-{uuid.uuid4().hex}"
    docs = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "silent")], "id long, text string")
    ask = lambda bad: {r["id"]: (r["content"], r["error"]) for r in ask_once(docs, ["id"], "text", recorder(tmp_path, bad), ledger, "p", "m", budget=1).collect()}
    assert ask(["bad"]) == {1: ("GOOD", None), 2: (None, "ValueError: no"), 3: (None, "no answer")}
    assert ask([]) == {1: ("GOOD", None), 2: ("BAD", None), 3: (None, "no answer")}
    assert asked(tmp_path) == sorted(["good", "bad", "bad", "silent", "silent"])


def test_a_killed_run_goes_on_after_its_last_wave(spark, tmp_path):
    ledger = f"{scratch_dir(spark)}/ledger-{uuid.uuid4().hex}"
    docs = spark.range(60).select("id", F.concat(F.lit("t"), "id").alias("text"))
    with pytest.raises(Exception, match="Killed"):
        ask_once(docs, ["id"], "text", recorder(tmp_path, stop=["t31"]), ledger, "p", "m", budget=1, wave_rows=10).count()
    kept = {r["content"].lower() for r in spark.read.parquet(ledger).collect()}
    got = ask_once(docs, ["id"], "text", recorder(tmp_path), ledger, "p", "m", wave_rows=10)
    assert got.filter("content = upper(concat('t', id))").count() == 60
    counts = asked(tmp_path)
    assert all(counts.count(t) == 1 for t in kept) and set(counts) == {f"t{i}" for i in range(60)}
