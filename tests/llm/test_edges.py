"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import pytest

from scrivenry.llm import abuse, arrivals, canonical, encoding, leaks, mixing, scans, site_lines

CHUNKS = "chunk_id long, doc_id long, source_id string, reading_order int, page_number int, content string, created_at string, line string, key string, n long"
DOCS = "doc_id long, source_id string, title string, citation string, jurisdiction_code string, batch_no int, text string, n long, key string, y string, p string, score string"
LONG = "word " * 60_000


def chunks(spark, rows):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(*r, None, "clash", "clash", 1) for r in rows], CHUNKS)


def docs(spark, rows):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(*r, 1, "k", "y", "p", "s") for r in rows], DOCS)


@pytest.fixture(scope="module")
def odd_chunks(spark):  # noqa: ANN001, ANN201
    return chunks(spark, [
        (1, 1, "a", 0, 1, "first line of it\n\n", ), (1, 1, "a", 0, 1, "first line of it\n\n"), (2, 1, "a", 1, None, None), (3, None, None, None, None, ""),
        (None, 2, "a", 0, 3, "no id\x00here"), (4, 3, None, 0, -1, LONG), (5, 3, "b", None, 2, "x" * 70_000),
    ])


@pytest.fixture(scope="module")
def odd_docs(spark):  # noqa: ANN001, ANN201
    return docs(spark, [
        (1, "a", "Title", "[2001] XYZC 5", "UK", 0, "some text of no account"), (2, None, None, None, None, None, None), (3, "b", "", " ", "EU", 1, ""), (None, "a", "t", "c", "UK", 2, "t"),
        (4, "a", "T", "[2001] XYZC 5", "UK", 1, LONG), (4, "a", "T", "[2001] XYZC 5", "UK", 1, LONG), (5, "a", "T", "???", "UK", 2, "z" * 60_000),
    ])


def test_site_lines(spark, odd_chunks):  # noqa: ANN001
    found = site_lines.site_lines(odd_chunks)
    assert found.count() == 0
    assert site_lines.mark_site_lines(odd_chunks, found).count() == 0
    texts = {r.doc_id: r.text for r in site_lines.without_site_lines(odd_chunks, found).collect()}
    assert texts[1] == "first line of it\n\n"
    assert site_lines.site_lines(chunks(spark, [])).count() == 0


def test_encoding(spark, odd_chunks, odd_docs):  # noqa: ANN001
    records = encoding.text_records(odd_chunks, odd_docs)
    assert encoding.damaged_words(records).count() == 0
    assert encoding.damaged_words(encoding.text_records(chunks(spark, []), docs(spark, []))).count() == 0


def test_scans(spark, odd_chunks, odd_docs):  # noqa: ANN001
    assert {r.noise_kind for r in scans.Scan(odd_chunks, odd_docs).found().collect()} <= {"furniture"}
    assert scans.Scan(chunks(spark, []), docs(spark, [])).found().count() == 0


def test_arrivals(spark, odd_docs):  # noqa: ANN001
    assert {(r.doc_id, r.original_id) for r in arrivals.duplicates(odd_docs).collect()} == set()
    assert arrivals.duplicates(docs(spark, [])).count() == 0


def test_leaks(spark, odd_docs):  # noqa: ANN001
    items = spark.createDataFrame([(1, None, "d"), (2, "", "d"), (3, "too short", "d"), (None, "an item without an id has none either", "d"), (4, "word " * 30, "d"), (4, "word " * 30, "d")], "item_id long, passage string, doc_id string")
    assert {(r.item_id, r.doc_id) for r in leaks.leaks(odd_docs, items).collect()} == {(4, 4)}
    assert leaks.leaks(docs(spark, []), items).count() == 0
    assert leaks.leaks(odd_docs, items.limit(0)).count() == 0


def test_mixing(spark, odd_docs):  # noqa: ANN001
    targets = spark.createDataFrame([("a", 0.7, 2), ("b", 0.3, 2), ("none", 0.1, 0), (None, 0.1, 1)], "source_id string, target_share double, max_repeats int")
    tokens = mixing.counted_once(odd_docs, targets)
    assert {r.doc_id for r in tokens.collect()} == {1, 3, 4, 5}
    rates = mixing.mix_rates(tokens, targets)
    assert [(r.source_id, r.rate) for r in rates.collect()] == [("a", 2.0)]
    assert mixing.emit(mixing.mix(tokens, rates)).count() == 6
    none = mixing.counted_once(docs(spark, []), targets)
    assert mixing.mix(none, mixing.mix_rates(none, targets)).count() == 0


def test_canonical(spark, odd_docs):  # noqa: ANN001
    entries = spark.createDataFrame([(7, "UK", None, "(2001) XYZC 5"), (7, "UK", None, "(2001) XYZC 5"), (8, None, "(2001) XYZC 5", "")], "entry_id long, jurisdiction string, target_citation string, judgment_citation string")
    listed = spark.createDataFrame([(1, "UK", "[2001] XYZC 5", "A v B", "XYZC", "Court of X", 2001), (2, "UK", None, None, None, None, None), (None, "UK", "x", "x", None, None, 1)], "authority_id long, jurisdiction_code string, citation string, title string, court_code string, court string, issued_year int")
    found = {(r.field, r.record_id, r.authority_id) for r in canonical.map_citations(odd_docs, entries, listed).collect()}
    assert found == {("citator_entries.judgment_citation", 7, 1), ("citator_entries.target_citation", 8, 0), ("documents.citation", 5, 0)}
    assert {r.authority_id for r in canonical.map_citations(odd_docs, entries, listed.limit(0)).collect()} == {0}
    assert canonical.map_citations(docs(spark, []), entries.limit(0), listed).count() == 0


def test_abuse(spark, odd_docs):  # noqa: ANN001
    labels = spark.createDataFrame([(1, 1, None), (2, None, 1), (3, 1, 1), (4, 1, 0)], "label_id long, doc_id long, toxic int")
    scored = {r.doc_id: r.score for r in abuse.score(odd_docs, labels).collect()}
    assert set(scored) == {1, 2, 3, 4, 5}
    assert all(s == 0 for s in scored.values())
    assert abuse.score(docs(spark, []), labels).count() == 0
