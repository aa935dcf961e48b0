"""Audits, chunkers, graphs and text functions on inputs whose answer is known."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrivenry.functions import text as T
from scrivenry.operators import audit, chunking, relations, retrieval


def test_citation_audit(spark):  # noqa: ANN001
    quote = "the employer shall give reasons for the termination"
    answers = spark.createDataFrame([(1, f'As held “{quote.upper()}  ” [P1]'), (2, f'"{quote} and pay at once" [P1; P2, page 3] (F1)'), (3, "no reference"), (4, None), (5, "[P7]")], "answer_id long, answer string")
    passages = spark.createDataFrame([(i, "P1", f"Section 3. {quote.replace(' ', chr(10), 1)}.", False) for i in (1, 2, 3, 4)] + [(2, "P2", None, True)], "answer_id long, label string, content string, ocr boolean")
    got = {r.answer_id: (r.n_labels, r.unknown, r.n_unmatched, r.ocr, r.passed) for r in audit.citation_audit(answers, passages).collect()}
    assert got == {1: (1, "", 0, False, True), 2: (3, "F1", 1, True, False), 3: (0, "", 0, False, False), 4: (0, "", 0, False, False), 5: (1, "P7", 0, False, False)}
    assert audit.citation_audit(answers.limit(0), passages).count() == 0


def test_compatibility_form_counts(spark):  # noqa: ANN001
    cited = spark.createDataFrame([("a", 1, "the ﬁrst  rule"), ("b", 1, "The first rule"), ("c", 2, "x"), ("d", 1, " ")], "answer_id string, resource_id long, quote string")
    sources = spark.createDataFrame([(1, "see the first\nrule"), (3, None)], "resource_id long, text string")
    assert {r.answer_id: r.published for r in audit.published_check(cited, sources).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_verified_values(spark):  # noqa: ANN001
    cells = spark.createDataFrame([(1, 1, "v", "b  c", 0.7), (2, 1, "v", "zz", 0.7), (3, 9, "v", "b", 0.7), (4, 1, "v", None, 0.7)], "cell_id long, resource_id long, value string, quote string, confidence double")
    got = {r.cell_id: (r.value, r.confidence) for r in audit.verified_values(cells, spark.createDataFrame([(1, "a b\nc d")], "resource_id long, text string")).collect()}
    assert got == {1: ("v", 0.7), 2: ("Not found", 0.0), 3: ("Not found", 0.0), 4: ("Not found", 0.0)}


def test_markup(spark):  # noqa: ANN001
    raw = "<!DOCTYPE html><head><title>T &amp; U</title><STYLE>p {}</STYLE></head><h2>One&nbsp;&eacute;</h2><p>Two<br/>three &lt;b&gt; &madeup; <!-- x -->four</p>\n<MarginalNote>note</MarginalNote><table><tr><td>c</td><td>d</td></tr></table>"
    row = spark.createDataFrame([(raw,), (None,)], "raw string").select(T.strip_markup(F.col("raw")).alias("text"), T.markup_title(F.col("raw"), F.lit("none")).alias("title")).collect()
    assert row[0].text == "T & U One é\nTwo three <b> four\nnote\nc d" and row[0].title == "T & U"
    assert row[1].text is None and row[1].title == "none"


def test_neutral_citations_end_at_a_boundary(spark):  # noqa: ANN001
    row = spark.createDataFrame([("[2001] TZCA 12345678 and [2001] TZCA 77, [2001] TZCA 77",)], "t string")
    assert row.select(T.neutral_citations(F.col("t")).alias("x")).first().x == ["[2001] TZCA 77"]
    got = row.select(T.citation_candidates(F.col("t"), F.array(F.lit(" Cap. 3 "), F.lit(None), F.lit("ab"), F.lit("[2001] TZCA 77"))).alias("x")).first().x
    assert got == ["[2001] TZCA 77", "Cap. 3"]


def test_packing_rules(spark):  # noqa: ANN001
    docs = spark.createDataFrame([(1, "aa\r\n\r\nbb\n\ncccccccccccc\n\ndd"), (2, "x; yy;  zz"), (3, " \n "), (4, None)], "doc_id long, text string")
    pieces = lambda **k: {(r.doc_id, r.reading_order): r.content for r in chunking.pack(docs, **k).collect()}
    assert pieces(most=8, split="blank") == {(1, 0): "aa\n\nbb", (1, 1): "cccccccc", (1, 2): "cccc", (1, 3): "dd", (2, 0): "x; yy;", (2, 1): "zz"}
    assert pieces(most=6, split="clause")[(2, 0)] == "x;\nyy;"
    assert chunking.packed(["a b c d"], 2, "\n", trim_cuts=False) == ["a ", "b ", "c ", "d"]
    long = chunking.packed(["word"] * 400_000, 2600, "\n")
    assert len(long) == 770 and sum(map(len, long)) == 400_000 * 5 - 770


def test_structured_nodes(spark):  # noqa: ANN001
    nodes = spark.createDataFrame([(1, "table", 0, "#/t", " cell "), (1, "text", 1, "#/a", "b"), (1, "text", 0, "#/a", "a"), (1, "text", 2, "#/c", " ")], "doc_id long, kind string, node_no long, ref string, content string")
    assert [(r.reading_order, r.ref, r.content) for r in chunking.structured_nodes(nodes).orderBy("reading_order").collect()] == [(0, "#/a", "a"), (1, "#/a:1", "b"), (2, "#/t", "cell")]


def test_graphs_in_order(spark):  # noqa: ANN001
    nodes = spark.createDataFrame([(1, i, k, y) for i, k, y in ((1, "b", 2.0), (2, "a", 2.0), (3, "z", 1.0), (4, "c", None))] + [(2, 1, "a", 0.0), (2, 2, "a", 0.0), (3, 1, "a", 0.0), (4, 1, "a", 0.0), (4, 2, "b", 0.0)], "graph_id long, id long, key string, y double")
    edges = spark.createDataFrame([(1, 1, 3, False), (3, 1, 9, False), (4, 1, 2, False), (4, 2, 1, False)], "graph_id long, source long, target long, conditional boolean")
    got = {r.graph_id: (r["keys"], r.error) for r in relations.ordered_graphs(nodes, edges).collect()}
    assert got == {1: (["c", "a", "b", "z"], None), 2: (None, "duplicate key"), 3: (None, "missing dependency"), 4: (None, "cycle")}


def test_levels_end(spark):  # noqa: ANN001
    edges = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(4)] + [("n1", "n4"), ("alone", "none")], "node string, parent string")
    assert {(r.node, r.level) for r in relations.levels(spark, edges, spark.createDataFrame([("n0",)], "node string")).collect()} == {(f"n{i}", i) for i in range(5)}


def test_nearest_as_brute_force(spark):  # noqa: ANN001
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 8))
    v[7] = v[20]
    rows = [(i, v[i].tolist()) for i in range(200)] + [(200, [0.0] * 8), (201, None), (202, [1.0, 2.0])]
    got = {(r.query_id, r.place): r.vec_id for r in retrieval.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, block=4).collect()}
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    for q in range(0, 200, 20):
        s = np.round(unit @ unit[q], 6)
        best = [i for i in np.lexsort((np.arange(200), -s)) if i != q][:5]
        assert [got[q, p] for p in range(1, 6)] == best
    assert not [k for k in got if k[0] == 200]


def test_topics_and_discovery(spark):  # noqa: ANN001
    row = spark.createDataFrame([("Can my employer end the Employment contract of a director?",), ("Habari",)], "q string").select(T.discovery_terms(F.col("q")).alias("d"), T.topic_queries(F.col("q")).alias("t")).collect()
    assert row[0].d == ["employer", "employment", "contract", "director", "companies", "labour"] and row[0].t[0] == "Employment Labour Relations Act"
    assert row[1].d == ["habari"] and row[1].t == ["Habari"]
