from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

DATA = Path("/root/testdata/sf0.001")
SAMPLE = ["normalise_tokens", "mechanical_keys", "keyword_route", "bm25_search", "suggest_terms", "triad_scores", "session_deposit", "latency_percentiles", "stream_log_fold", "stream_session_owner", "stream_index_sync", "decompose_questions",
          "check_findings", "cross_base_references", "note_degrees", "judge_pairs", "qa_accuracy", "orphan_records", "session_owner_asof", "invalidation_cost",
          "chunk_sections", "note_facets", "section_search", "source_records", "sources_listing", "csl_export", "line_marks", "base_settings", "gold_lines", "session_switches", "objection_numbers", "panel_costs", "evidence_sessions", "sampled_items",
          "stream_sticky", "index_sync", "index_ask", "context_slices", "assembled_passages", "snippets", "evidence_taxonomy", "objection_admissibility", "misses_report", "log_reports", "blocks_report",
          "alias_candidates", "proposals_report", "refused_report"]


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_same_as_sql(spark, name):
    db = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        db.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    right = db.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, str(DATA))
    columns = sorted(right.columns)
    assert sorted(got.columns) == columns
    value = lambda x: round(float(x), 5) if isinstance(x, int | float) and not isinstance(x, bool) and not math.isnan(x) else x
    rows = lambda it: sorted((tuple(map(value, r)) for r in it), key=repr)
    assert len(right) > 0  # no rows would prove nothing
    assert rows(right.select(*map(duckdb.ColumnExpression, columns)).fetchall()) == rows(tuple(r[c] for c in columns) for r in got.collect())
