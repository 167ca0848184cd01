"""The reader of JSON items against a whole parse of the same texts."""

import json
import pathlib
import tempfile

import pandas as pd
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cliploom.sources import artifacts, items


def folder():
    return pathlib.Path(tempfile.mkdtemp(prefix="run-", dir="/tmp"))


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())
    return path


def by_ranges(path, size, array):
    """(items, head) of one file through the three steps, without Spark; None where the file is not whole."""
    n = path.stat().st_size
    cols = ["file", "job_id", "part", "no", "lo", "hi"]
    rows = [(f"file:{path}", "j", 0, i, lo, min(lo + size, n)) for i, lo in enumerate(range(0, n, size))]
    table = pa.Table.from_pandas(pd.DataFrame(rows, columns=cols), preserve_index=False)
    effects = [r for b in items._summaries(table.to_batches()) for r in b.to_pylist()]
    starts = items._fold(pd.DataFrame(effects))
    if not starts["whole"].all():
        return None
    found = [r for b in items._cutter(array)(iter([pa.RecordBatch.from_pylist(starts.to_dict("records"))])) for r in b.to_pylist()]
    found.sort(key=lambda r: r["at"])
    return [json.loads(r["value"]) for r in found if r["k"] is not None], "".join(r["value"] for r in found if r["k"] is None)


texts = st.text(st.sampled_from('ab"\\[]{},: \né世words'), max_size=12)
values = st.recursive(
    st.none() | st.booleans() | st.integers(-9, 9) | texts,
    lambda x: st.lists(x, max_size=3) | st.dictionaries(texts, x, max_size=3),
    max_leaves=8,
)


@settings(max_examples=60, deadline=None)
@given(st.lists(values, max_size=5), st.dictionaries(texts, values, max_size=4), st.booleans(), st.integers(1, 40), st.sampled_from([None, 1]))
def test_ranges_of_any_size_give_the_items_of_a_whole_parse(wanted, others, first, size, indent):
    others.pop("words", None)
    doc = {"words": wanted, **others} if first else {**others, "words": wanted}
    path = put(folder() / "j" / "t.json", json.dumps(doc, indent=indent, ensure_ascii=False))
    got, head = by_ranges(path, size, "words")
    assert got == wanted
    left = json.loads(head)
    assert {k: v for k, v in left.items() if not isinstance(v, (list, dict))} == {k: v for k, v in doc.items() if not isinstance(v, (list, dict))}
    assert left["words"] == []


def test_texts_that_are_not_whole_or_no_object():
    root = folder()
    for i, bad in enumerate(['{"words":[1,2', '{"words":["a]}', '{"words":[1]}}', "]", '{"a":"\\"}']):
        assert by_ranges(put(root / "j" / f"b{i}.json", bad), 3, "words") is None
    assert by_ranges(put(root / "j" / "list.json", '[{"words":[1]},[2,3]]'), 4, "words") == ([], "")
    assert by_ranges(put(root / "j" / "deep.json", '{"x":{"words":[1]},"y":[["words",[2]]],"words":[ ]}'), 5, "words")[0] == []
    long = "\\\\" * 500 + '\\"'
    assert by_ranges(put(root / "j" / "slashes.json", '{"words":["' + long + '",[3]]}'), 7, "words")[0] == [json.loads(f'"{long}"'), [3]]
    assert by_ranges(put(root / "j" / "scalar.json", "17"), 1, "words") == ([], "17")


def test_scanned_files_equal_read_ones(spark):
    root = folder()
    word = lambda i: {"text": f'w"{i}\\', "start": i * 0.5, "end": i * 0.5 + 0.25, "speaker": "S", "more": [{"x": [i]}]}
    doc = lambda a, b: {"segments": [{"words": [word(1)], "text": "[,]"}], "language": "he", "words": [*map(word, range(a, b)), None], "is_rtl": True}
    for part, (a, b) in enumerate([(0, 400), (400, 401), (401, 900)]):
        put(root / "j1" / f"t_{part}.json", json.dumps(doc(a, b), indent=part or None))
    put(root / "j2" / "t.json", json.dumps({"words": []}))
    put(root / "j3" / "t.json", '{"words":[{"text":"x"}')
    put(root / "j4" / "t.json", "")
    words, heads = artifacts.scan_transcripts(spark, str(root), split_bytes=1000)
    want_words, want_heads = artifacts.read_transcripts(spark, str(root))
    rows = lambda df: sorted(tuple(r) for r in df.filter("job_id IN ('j1', 'j2')").collect())
    assert rows(words) == rows(want_words) and words.filter("job_id = 'j1'").count() == 900
    assert rows(heads) == rows(want_heads)
    assert {r.job_id for r in heads.collect()} == {"j1", "j2"}
    only, _ = artifacts.scan_transcripts(spark, str(root), split_bytes=1000, jobs=["j2"])
    assert only.count() == 0


def test_a_range_table_has_many_tasks_for_one_file(spark):
    root = folder()
    put(root / "j" / "f.json", json.dumps({"frames": [{"path": f"p{i}", "frame_number": i + 1, "phash": "0" * 16} for i in range(20_000)]}))
    frames = artifacts.scan_frames(spark, str(root), split_bytes=50_000)
    assert frames.selectExpr("count(distinct frame_number)").first()[0] == 20_000
    found, _ = items.items_of(items.list_files(spark, str(root)), "frames", 50_000)
    assert found.selectExpr("max(seq)").first()[0] == 19_999


def test_files_that_arrive_are_read_once(spark):
    root, seen = folder(), []
    handle = lambda got, heads, n: seen.append((n, sorted((r.job_id, r.seq, r.value) for r in got.collect()), heads.count()))
    put(root / "in" / "j1" / "t.json", '{"words":[1,2]}')
    run = lambda: items.stream_items(spark, f"{root}/in", "words", handle, f"{root}/ck", split_bytes=4).awaitTermination()
    run()
    put(root / "in" / "j2" / "t.json", '{"words":["a,b"]}')
    run()
    assert [x for _, x, _ in seen] == [[("j1", 0, "1"), ("j1", 1, "2")], [("j2", 0, '"a,b"')]]
    assert [h for *_, h in seen] == [1, 1]
