"""Registered queries next to their SQL on the smallest supplied tables."""

import importlib.util
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from cliploom import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).is_dir(), reason="supplied tables not found")

_spec = importlib.util.spec_from_file_location("check", pathlib.Path(__file__).resolve().parents[1] / "tools" / "check.py")
check = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(check)

# One query per family; tools/check.py runs all of them.
NAMES = [
    "table_segments", "src3_scenes", "dec1_plan_status", "src12_scene_answers", "agg1_segment_assembly", "jon3_tumbling_windows",
    "jon10_energy_attach", "top2_contact_sheet", "jon9_segment_updates", "prj3_sanitized_decisions", "win5_pacing_warnings",
    "stf3_standard_captions", "jon12_visual_scores", "agg12_budget_check", "top4_enhancement_cap", "agg8_cost_rollup",
    "win11_transition_audit", "src8_job_updates", "prj6_direction_rollup", "prj5_digest_cut_plan", "str5_tumbling_counts",
    "flow2_edit_with_takes",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = check.rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == check.rows_of(names, cur.fetchall())


def test_every_query_has_sql_or_is_a_known_exception():
    # The optional subpackage tests its own queries.
    queries, sql = catalog.load()
    assert set(queries) == set(sql)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
