"""Words of turns, counted along the job."""

import re

from cliploom import fixtures as fx


def test_words_are_counted_without_moving_them(spark, tmp_path):
    turns = [(1, 0, "user", " One two.  Three!\nfour "), (1, 1, "bot", ""), (1, 2, "bot", None), (1, 3, "user", "? a.b c. . d"), (2, 0, "user", "x\u2028 y.\u2028 z!"), (None, 5, "bot", "p. q")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want, n, ended = [], {}, {}
    for job, turn, role, text in turns:
        for w in [w for w in re.split("[ \n\t\r]+", text or "") if w]:
            seq = n.get(job, 0)
            want.append((job, seq, w, role, 400 * seq + 1300 * ended.get(job, 0) + 2500 * turn))
            n[job] = seq + 1
            ended[job] = ended.get(job, 0) + (w[-1] in ".!?")
    got = fx.words(spark, str(tmp_path)).select("job_id", "seq", "text", "speaker", "start_ms").collect()
    assert {tuple(r) for r in got} == set(want) and len(got) == len(want)
    # The words of turns with a number of their own go through no shuffle: the only one is for turns that share theirs.
    said = spark.createDataFrame([(1, 0, "user", 0, 0, 2, ["a.", "b"], None, None)], "job_id long, turn long, role string, _words long, _sents long, _n int, ws array<string>, _before struct<turn:long>, _after struct<turn:long>")
    rows = fx._turn_words(said, lambda z: z.endswith("."))
    assert [(r["_ended"], r["i"], r["text"]) for r in rows.orderBy("i").collect()] == [(0, 0, "a."), (1, 1, "b")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "Window" not in plan[: plan.index("_said")]


def test_turns_that_share_their_number_are_counted_together(spark, tmp_path):
    turns = [(1, 0, "user", "a b. c"), (1, 1, "bot", "d. e f."), (1, 1, "bot", "d. e f."), (1, 2, "user", "g")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = fx.words(spark, str(tmp_path)).where("turn = 1").select("seq", "text").collect()
    assert sorted(r["seq"] for r in got) == [3, 4, 5, 6, 7, 8] and sorted(r["text"] for r in got) == ["d.", "d.", "e", "e", "f.", "f."]
