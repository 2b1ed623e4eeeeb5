"""Registered queries against their DuckDB oracles on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import TABLES, kind, rows_of

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# One query per operator family; ``check_oracles.py`` runs all of them.
CHOSEN = [
    "d1_top_k_cells", "d4_late_fusion", "d7_similar", "d9_vibe", "d12_harmonic_mix", "e1_fit_stats",
    "e4_genre_focus_weights", "e7_precision_at_10", "e13_similarity_profile", "f9_identify",
    "a1_feature_jsonl", "a2_track_csv", "b13_click_rules", "g7_retention_plan", "i6_parse_video_title",
    "i25_playlist_text", "j2_import_new", "j9_f14_expand_catalog", "j14_job_state",
    "k3_genre_weights_stream"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())
    assert {f.name: kind(f.dataType.simpleString()) for f in df.schema} == {
        c: kind(str(t)) for c, t in zip(rel.columns, rel.types)}


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5


def test_scan_prunes_columns_and_pushes_filters(spark):
    plan = QUERIES["b4_count"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan
    plan = QUERIES["e2_feedback_stats"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "struct<user_id:bigint,event_type:string,props:string>" in plan
