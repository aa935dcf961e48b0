"""The registered queries and their SQL agree on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from scrivenry.plans.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"
CHECKED = (
    "search_evidence", "search_context", "posting_build", "gateway_search", "chunk_pack", "question_plans", "quote_verify", "upsert_actions", "corpus_overview", "monitor_scan", "lease_claim", "event_windows", "table_text",
    "citation_audit", "gateway_delta", "gateway_passages", "pack_clauses", "pack_paragraphs", "workflow_order", "passage_neighbours", "discovery_terms", "document_checks", "search_jurisdiction", "vector_nearest",
)


def test_names_match():
    assert set(SQL) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")
@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):  # noqa: ANN001
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    rows = QUERIES[name](spark, SMALL).collect()
    result = con.execute(SQL[name])
    columns = [c[0] for c in result.description]
    text = lambda x: f"{x:.9g}" if isinstance(x, float) else repr(x)
    expected = sorted(tuple(map(text, r)) for r in result.fetchall())
    assert sorted(tuple(text(r[c]) for c in columns) for r in rows) == expected
