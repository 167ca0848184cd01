"""Registered queries and the pipeline on the smallest supplied tables."""

import pathlib

import brute
import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).is_dir(), reason="supplied tables not found")


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


def rows(spark, name):
    return [r.asDict() for r in entry.queries()[name](spark, SF).collect()]


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op4_suffix_dedup", "op6_ngram_jaccard", "op7_line_dedup", "op8_decontamination", "op9_warc"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(cur.fetchall(), key=repr) == sorted((tuple(r[n] for n in names) for r in rows(spark, name)), key=repr)


def test_all_eleven_are_registered():
    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {k.split("_")[0] + "_" for k in names if k.startswith("op")} and "pipeline" in names


def test_op4_op6_op8(spark, docs):
    import hashlib

    want = brute.repeats(docs)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(spark, "op4_suffix_dedup")} == {d: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for d, w in want.items()}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(spark, "op6_ngram_jaccard")} == brute.similar(docs)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute.contamination(docs, items)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows(spark, "op8_decontamination")} == want


def test_op10_predicts_held_out_rows(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = [r for r in rows(spark, "op10_language") if r["held_out"]]
    assert sum(lang[r["doc_id"]] == r["lang_pred"] for r in got) >= 0.95 * len(got) > 10


def test_pipeline_stages(spark, docs, tmp_path):
    """Each stage against a plain version of its decision on its own input."""
    import corpus_pipeline as p

    table = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stage = table.columns, dict(p.STAGES)
    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "decontamination", "bpe_round_trip"]

    def step(name, df):
        stage[name](spark, df, SF).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    kept = step("language_id", table)
    assert kept.columns == columns and kept.count() == len(docs)  # the supplied documents are all in learned languages
    cut = step("line_dedup", kept)
    con = duckdb.connect()
    from cliploom.llm.queries import LINES_CTES

    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/language_id/*.parquet'")
    want = con.execute("WITH " + LINES_CTES.format(docs="documents") + " SELECT doc_id, text FROM cut").fetchall()
    after = sorted((r["doc_id"], r["text"]) for r in cut.collect())
    assert after == sorted(want)
    one = step("ngram_jaccard", cut)
    assert {r["doc_id"] for r in one.collect()} == {d for d, (n, c) in brute.similar(after).items() if n == 0 or c == d}
    clean = step("decontamination", one)
    assert clean.columns == columns and clean.count() == one.count()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    before = {r["doc_id"]: r["text"] for r in one.collect()}
    hits = brute.contamination(before.items(), items)
    assert {d for d, t in ((r["doc_id"], r["text"]) for r in clean.collect()) if t != before[d]} == {d for d, h in hits.items() if h[1]}
    last = step("bpe_round_trip", clean)
    assert last.count() == one.count()
    assert sorted(r["doc_id"] for r in p.run(spark, SF).collect()) == sorted(r["doc_id"] for r in last.collect())
