"""Folders of many small files, and how their ranges are dealt to tasks."""

import json
import pathlib
import tempfile

from cliploom.sources import artifacts, files, items


def folder():
    return pathlib.Path(tempfile.mkdtemp(prefix="run-", dir="/tmp"))


def texts_below(root):
    return sorted((str(p.parent.relative_to(root)), p.read_bytes()) for p in root.rglob("*.txt"))


def test_written_files_lie_where_sparks_partitioned_writer_puts_them(spark):
    root = folder()
    rows = [(1, "a/b", "x"), (1, "a/b", "x"), (1, None, "é"), (None, "c", None), (2, "d", "y\nz")]
    df = spark.createDataFrame(rows, "job_id long, part string, value string")
    files.write_files(df, f"{root}/own", ["job_id", "part"], "value")
    df.repartition("job_id", "part").write.partitionBy("job_id", "part").text(f"{root}/spark")
    assert texts_below(root / "own") == texts_below(root / "spark")
    (root / "own" / ".left").write_text("hidden")
    (root / "own" / "_logs").mkdir()
    (root / "own" / "_logs" / "x.txt").write_text("hidden")
    listed = {(r.path, r.length) for r in files.list_files(spark, f"{root}/own").collect()}
    by_spark = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/own")
    assert listed == {(r.path, r.length) for r in by_spark.select("path", "length").collect()}
    assert sorted(r.payload for r in artifacts.read_payloads(spark, f"{root}/own").collect()) == ["\n", "x\nx\n", "y\nz\n", "é\n"]


def test_many_short_ranges_make_few_tasks(spark, monkeypatch):
    root, tasks = folder(), {}
    for j in range(40):
        (root / f"j{j}").mkdir()
        (root / f"j{j}" / "t.json").write_text(json.dumps({"words": list(range(200))}))

    def kept(df, label):
        tasks[label] = df.rdd.getNumPartitions()
        return write(df, label)

    write = items.materialize
    monkeypatch.setattr(items, "materialize", kept)
    found, _ = items.items_of(files.list_files(spark, str(root)), "words", 16)
    assert found.count() == 8000 and found.selectExpr("max(seq)").first()[0] == 199
    assert tasks["items"] <= 8 * 40  # of more than 2000 ranges
