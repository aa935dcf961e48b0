"""Operators on small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrivenry.operators import chunking, corpus, index, relations, retrieval
from scrivenry.streaming import queue


def test_packing(spark):  # noqa: ANN001
    text = "aaa\n\n bbb \ncccc\n" + "x" * 23 + "\ndd\nee"
    rows = chunking.pack(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "  \n")], "doc_id long, text string"), most=10).orderBy("doc_id", "reading_order").collect()
    assert [(r.doc_id, r.reading_order, r.content) for r in rows] == [(1, 0, "aaa\nbbb"), (1, 1, "cccc"), (1, 2, "x" * 10), (1, 3, "x" * 10), (1, 4, "xxx"), (1, 5, "dd\nee")]


def test_windows(spark):  # noqa: ANN001
    rows = chunking.windows(spark.createDataFrame([(1, "x" * 8200), (2, " \0 "), (3, None)], "chunk_id long, content string")).orderBy("window_no").collect()
    assert [(r.chunk_id, r.start, len(r.content)) for r in rows] == [(1, 0, 4000), (1, 3600, 4000), (1, 7200, 1000)]


def test_postings_are_capped_with_titles_first(spark):  # noqa: ANN001
    docs = spark.createDataFrame([(i, "UK", "ledger here", "The ledger" if i == 299 else "none", None) for i in range(300)], "doc_id long, jurisdiction_code string, text string, title string, citation string")
    rows = index.postings(docs).filter("term = 'ledger'").orderBy(F.desc("weight"), "doc_id").collect()
    assert len(rows) == 256 and rows[0].doc_id == 299


def test_tokens(spark):  # noqa: ANN001
    docs = spark.createDataFrame([(1, "constructor Constructor ajira employment " + "y" * 101 + " " + " ".join(f"w{i:05d}" for i in range(4000)))], "doc_id long, text string")
    rows = index.document_tokens(docs).collect()
    counts = {r.term: r.n for r in rows}
    assert len(rows) == 3000 and counts["constructor"] == 2 and counts["ajira"] == 1 and "y" * 101 not in counts


def test_upserts(spark):  # noqa: ANN001
    old = spark.createDataFrame([("a", "1"), ("b", None), ("c", "3")], "k string, v string")
    new = spark.createDataFrame([("a", "2"), ("b", None), ("d", "4")], "k string, v string")
    assert {(r.k, r.action) for r in corpus.upsert_actions(old, new, ["k"], "v").collect()} == {("a", "update"), ("b", "unchanged"), ("d", "insert")}


def test_passages_apart(spark):  # noqa: ANN001
    chunks = spark.createDataFrame([(i, 1, i, None, t) for i, t in enumerate(["unfair unfair dismissal", "unfair", "x", "y", "z", "unfair dismissal", "w", "dismissal", "v", "u"])], "chunk_id long, doc_id long, reading_order int, created_at string, content string")
    questions = spark.createDataFrame([(1, "unfair dismissal")], "question_id long, question string")
    rows = retrieval.best_passages(spark.createDataFrame([(1, 1)], "question_id long, doc_id long"), questions, chunks).collect()
    assert [r.chunk_id for r in sorted(rows, key=lambda r: r.passage_place)] == [0, 5]


def test_fusion_promotes_the_similar(spark):  # noqa: ANN001
    rows = spark.createDataFrame([(0, 1, 0.0), (0, 2, 1.0)], "query_id long, vec_id long, similarity double")
    assert {r.vec_id: r.place for r in retrieval.fused(rows).collect()} == {2: 1, 1: 2}


def test_interleaving(spark):  # noqa: ANN001
    lists = spark.createDataFrame([(1, 0, 1, 10), (1, 0, 2, 11), (1, 1, 1, 11), (1, 1, 2, 12)], "question_id long, list_no long, place long, chunk_id long")
    assert [r.chunk_id for r in retrieval.interleaved(lists).orderBy("place").collect()] == [10, 11, 12]
    assert {r.chunk_id for r in retrieval.first_that_answers(lists.filter("list_no = 1")).collect()} == {11, 12}


def test_leases(spark):  # noqa: ANN001
    jobs = spark.createDataFrame([(1, "t", "running", None, "2024-01-01 00:00:00", "2024-01-02 00:00:00", 1), (2, "t", "queued", "2024-02-01 00:00:00", "2024-01-01 00:00:00", None, 0), (3, "t", "running", None, "2024-01-01 00:00:00", "2024-03-01 00:00:00", 1)], "job_id long, job_type string, status string, available_at string, created_at string, lease_expires_at string, attempts int")
    jobs = jobs.withColumns({c: F.col(c).cast("timestamp") for c in ("available_at", "created_at", "lease_expires_at")})
    rows = queue.claim(jobs, F.lit("2024-01-15 00:00:00").cast("timestamp")).collect()
    assert [(r.job_id, r.attempts) for r in rows] == [(1, 2)]


def test_monitor_mark_waits_for_a_full_scan(spark):  # noqa: ANN001
    monitors = spark.createDataFrame([("m", "UK", None)], "monitor_id string, jurisdiction_code string, topic string").withColumn("since", F.lit("2024-01-01").cast("timestamp"))
    docs = spark.range(120).select(F.col("id").alias("doc_id"), F.lit("UK").alias("jurisdiction_code"), F.lit("t").alias("title"), F.lit("h").alias("content_hash"), F.lit("2024-02-01").cast("timestamp").alias("retrieved_at"))
    seen = spark.createDataFrame([(f"monitor:m:{i}:h",) for i in range(10)], "fingerprint string")
    rows = queue.monitor_scan(monitors, docs, seen).collect()
    assert len(rows) == 100 and not rows[0].advance and min(r.doc_id for r in rows) == 10
    assert all(r.advance for r in queue.monitor_scan(monitors, docs.limit(50), seen).collect())


def test_relations(spark):  # noqa: ANN001
    edges = spark.createDataFrame([("b", "a"), ("c", "b")], "node string, parent string")
    assert {(r.node, r.level) for r in relations.levels(spark, edges, spark.createDataFrame([("a",)], "node string")).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    cells = spark.createDataFrame([(1, 1, 1, "Act"), (1, 1, 2, "Year"), (1, 2, 1, "Companies"), (1, 2, 2, "2002"), (1, 2, 3, " ")], "k long, r long, c long, v string")
    assert relations.table_text(cells, "k", "r", "c", "v").first().content == "Act\tYear\nCompanies\t2002"


def test_urls(spark):  # noqa: ANN001
    rows = spark.createDataFrame([("HTTP://www.A.example/x/?q=1#f",), ("https://u@a.example/x",)], "u string").select(corpus.url_key(F.col("u")).alias("k"), corpus.url_host(F.col("u")).alias("h")).collect()
    assert [tuple(r) for r in rows] == [("https://a.example/x", "a.example"), ("https://u@a.example/x", "")]
