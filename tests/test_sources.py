"""Readers and stage tables on real files."""

import json
import pathlib
import tempfile

from pyspark.sql import functions as F

from cliploom.sources import artifacts, images, responses, stages


def folder():
    return pathlib.Path(tempfile.mkdtemp(prefix="run-", dir="/tmp"))


def put(root, name, obj):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(obj if isinstance(obj, str) else json.dumps(obj, indent=1))


def word(t, a, b, **kw):
    return {"text": t, "start": a, "end": b, **kw}


def test_transcripts_frames_scenes_from_files(spark):
    root = folder()
    put(root, "t/j1/transcript_0.json", {"language": "he", "is_rtl": True, "words": [word("a", 0, 0.4, confidence=0.5), word("b", 0.5, 0.9)], "segments": []})
    put(root, "t/j1/transcript_1.json", {"language": "he", "is_rtl": True, "words": [word("c", 1.0005, 1.2)], "segments": []})
    words, heads = artifacts.read_transcripts(spark, f"{root}/t")
    assert [(r.seq, r.text, r.start_ms, r.confidence) for r in words.orderBy("seq").collect()] == [(0, "a", 0, 0.5), (1, "b", 500, None), (2, "c", 1001, None)]
    assert [tuple(r) for r in heads.collect()] == [("j1", "he", True)]
    fr = [{"path": f"f{i}", "timestamp": i * 2.0, "frame_number": i + 1, "phash": "00000001ffffffff", "is_duplicate": False} for i in range(3)]
    put(root, "f/j1/frames.json", {"frames": fr, "kept": 3})
    frames = artifacts.read_frames(spark, f"{root}/f")
    assert [(r.ts_ms, r.phash_hi, r.phash_lo) for r in frames.orderBy("ts_ms").collect()][2] == (4000, 1, 4294967295)
    put(root, "s/j1/scenes.json", {"error": "crashed"})
    put(root, "s/j2/scenes.json", {"scenes": []})
    media = spark.createDataFrame([("j1", 25.0)], "job_id string, fps double")
    got = artifacts.read_scenes(spark, f"{root}/s", frames, media).collect()
    assert [(r.job_id, r.scene_id, r.end_ms, r.end_frame) for r in got] == [("j1", "scene_000", 4000, 100)]


def test_job_listing_skips_corrupt(spark):
    root = folder()
    put(root, "a/manifest.json", {"id": "a", "state": "created", "createdAt": "2026-01-01T00:00:00Z"})
    put(root, "b/manifest.json", {"id": "b", "state": "editing", "createdAt": "2026-02-01T00:00:00Z"})
    put(root, "c/manifest.json", '{"id": "c", ')
    jobs, corrupt = stages.list_jobs(spark, str(root))
    assert [r.job_id for r in jobs.collect()] == ["b", "a"]
    assert corrupt.count() == 1


def test_stage_store_replaces_jobs_and_reports_missing(spark):
    root = str(folder())
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "job_id long, v string")
    assert stages.read_stage(spark, root, "vud", df.schema).count() == 0
    stages.write_stage(df, root, "vud")
    stages.write_stage(spark.createDataFrame([(1, "new")], df.schema), root, "vud")
    got = stages.read_stage(spark, root, "vud", df.schema)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "new"), (2, "z")]
    assert [r.v for r in stages.read_stage(spark, root, "vud", df.schema, job_id=2).collect()] == ["z"]
    todo = stages.missing_jobs(spark.createDataFrame([(1,), (2,), (3,)], "job_id long"), got)
    assert [r.job_id for r in todo.collect()] == [3]


def test_image_catalog(spark):
    root = folder()
    (root / "a.PNG").write_bytes(b"12345")
    (root / "b.jpeg").write_bytes(b"1" * 100)
    ok, big = images.image_catalog(spark, str(root), max_bytes=50)
    assert [(r.media_type, r.data) for r in ok.collect()] == [("image/png", "MTIzNDU=")]
    assert [r.media_type for r in big.collect()] == ["image/jpeg"]


def test_plan_repair(spark):
    rows = [
        (1, 'x {"decisions":[{"segmentId":"s","trimStart":"5","trimEnd":7.5}]} y'), (2, '{"decisions":[{"segmentId":"s","reason":"done"'),
        (3, '{"decisions":[{"segmentId":"s","reason":"open'), (4, "none"), (5, '{"captionMode":"jumbo"}'), (6, '{"decisions":[{"segmentId":"s"},{"segmentId":"t"}'),
    ]
    dec, plans = responses.ingest_plans(spark.createDataFrame(rows, "job_id long, content string"))
    assert [r.status for r in plans.orderBy("job_id").collect()] == ["good", "repaired", "failed", "failed", "good", "repaired"]
    first = dec.filter("job_id = 1").first()
    assert (first.action, first.trim_start_ms, first.trim_end_ms) == ("keep", None, 7500)
    assert dec.filter("job_id = 6").count() == 2
    assert plans.filter("job_id = 5").first().caption_mode == "jumbo"


def test_loudness_takes_first_block(spark):
    log = 'a {x} {\n"input_i" : "-17.5", "input_tp" : "-1", "input_lra" : "3", "input_thresh" : "-28"}\n{"input_i": "-1"}'
    good, bad = artifacts.parse_loudness(spark.createDataFrame([(1, log.replace("{x}", "")), (2, "nothing")], "job_id long, log string"))
    assert [(r.job_id, r.input_i) for r in good.collect()] == [(1, -17.5)]
    assert [r.job_id for r in bad.collect()] == [2]


def test_a_job_can_be_replaced_by_an_empty_result(spark, tmp_path):
    from cliploom.sources import stages

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "job_id long, x string")
    stages.write_stage(rows, str(tmp_path), "edit", "x", version=1)
    stages.write_stage(rows.filter("job_id = 3"), str(tmp_path), "edit", "x", version=2, jobs=rows.filter("job_id = 2"))
    assert [tuple(r) for r in stages.read_stage(spark, str(tmp_path), "edit", rows.schema, "x").collect()] == [(1, "a")]
    stages.write_stage(rows.filter("job_id = 2"), str(tmp_path), "edit", "x", version=3, jobs=rows)
    assert sorted(tuple(r) for r in stages.read_stage(spark, str(tmp_path), "edit", rows.schema, "x").collect()) == [(2, "b"), (2, "c")]


def test_compaction_leaves_one_folder_and_the_same_rows(spark, tmp_path):
    schema = "job_id long, v long, m map<string,int>"
    folders = lambda: sorted(p.name for p in (tmp_path / "vud" / "data").iterdir() if p.name.startswith("folder="))
    for i in range(5):
        stages.write_stage(spark.sql(f"SELECT id AS job_id, {i}L AS v, map('x', {i}) AS m FROM range({10 - i})"), str(tmp_path), "vud", version=i)
    stages.write_stage(spark.createDataFrame([], schema), str(tmp_path), "vud", version=9, jobs=spark.createDataFrame([(0,)], "job_id long"))
    types = spark.createDataFrame([], schema).schema
    read = lambda **kw: sorted((r.job_id, r.v, r.m["x"]) for r in stages.read_stage(spark, str(tmp_path), "vud", types, **kw).collect())
    want = [(j, min(4, 9 - j), min(4, 9 - j)) for j in range(1, 10)]
    assert read() == want and len(folders()) == 6
    assert stages.compact_stage(spark, str(tmp_path), "vud", types) == 0
    assert read() == want and len(folders()) == 7
    assert stages.compact_stage(spark, str(tmp_path), "vud", types, keep_ms=0) == 6
    assert read() == want and len(folders()) == 1
    read_from = {f.rsplit("/", 2)[-2] for f in stages.read_stage(spark, str(tmp_path), "vud", types).inputFiles()}
    assert {f for f in read_from if f.startswith("folder=")} == set(folders())
    assert read(job_id=3) == [(3, 4, 4)] and read(job_id=0) == [] and read(job_id=77) == []
    # A write of a version that compaction has not seen wins over the compacted rows.
    stages.write_stage(spark.sql("SELECT 3L AS job_id, 50L AS v, map('x', 50) AS m"), str(tmp_path), "vud", version=10)
    assert read(job_id=3) == [(3, 50, 50)]


def test_a_write_without_pointers_is_not_seen(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "job_id long, x string")
    stages.write_stage(rows, str(tmp_path), "edit")
    rows.withColumn("x", F.lit("half")).write.parquet(f"{tmp_path}/edit/data/folder=99999")
    assert [tuple(r) for r in stages.read_stage(spark, str(tmp_path), "edit", rows.schema).collect()] == [(1, "a")]
    assert stages.compact_stage(spark, str(tmp_path), "edit", rows.schema) == 1
