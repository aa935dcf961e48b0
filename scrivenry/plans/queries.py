"""The queries over the reference's own operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivenry.functions import numbers as N
from scrivenry.functions import sensitive
from scrivenry.functions import text as T
from scrivenry.operators import chunking, corpus, index, relations, retrieval
from scrivenry.plans import checks
from scrivenry.plans.sql import SQL
from scrivenry.sources import table
from scrivenry.streaming import queue

__all__ = ["QUERIES", "SQL"]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NOW = "2024-01-15 12:00:00"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _tables(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


def _now() -> Column:
    return F.lit(NOW).cast("timestamp")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.question_rows(table(spark, d, "evaluation_cases"))


@query
def search_evidence(spark: SparkSession, d: str) -> DataFrame:
    docs, chunks, registry = _tables(spark, d, "documents", "chunks", "source_registry")
    return retrieval.search(_questions(spark, d), docs, chunks, registry)


@query
def search_required_terms(spark: SparkSession, d: str) -> DataFrame:
    docs, chunks, registry = _tables(spark, d, "documents", "chunks", "source_registry")
    return retrieval.search(_questions(spark, d), docs, chunks, registry, required=True, most_terms=2)


@query
def search_context(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.with_context(search_evidence(spark, d), table(spark, d, "chunks"))


@query
def search_ladder(spark: SparkSession, d: str) -> DataFrame:
    docs, chunks, registry = _tables(spark, d, "documents", "chunks", "source_registry")
    plans = [(True, 3), (True, 2), (False, 4)]
    lists = [retrieval.search(_questions(spark, d), docs, chunks, registry, required=r, most_terms=n).withColumn("list_no", F.lit(i).cast("long")) for i, (r, n) in enumerate(plans)]
    return retrieval.first_that_answers(lists[0].unionByName(lists[1]).unionByName(lists[2])).select("question_id", "list_no", "chunk_id", "place")


@query
def search_interleaved(spark: SparkSession, d: str) -> DataFrame:
    docs, chunks, registry = _tables(spark, d, "documents", "chunks", "source_registry")
    both = [retrieval.search(_questions(spark, d), docs, chunks, registry, required=r, most_terms=n).withColumn("list_no", F.lit(i).cast("long")) for i, (r, n) in enumerate([(True, 2), (False, 4)])]
    return retrieval.interleaved(both[0].unionByName(both[1]))


@query
def posting_build(spark: SparkSession, d: str) -> DataFrame:
    return index.postings(table(spark, d, "documents"))


@query
def posting_shard_counts(spark: SparkSession, d: str) -> DataFrame:
    return index.shard_counts(posting_build(spark, d))


@query
def gateway_search(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.gateway_candidates(_questions(spark, d), posting_build(spark, d))


@query
def gateway_passages(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.best_passages(gateway_search(spark, d), _questions(spark, d), table(spark, d, "chunks"))


@query
def document_tokens(spark: SparkSession, d: str) -> DataFrame:
    return index.document_tokens(table(spark, d, "documents"))


@query
def vector_nearest(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.nearest(table(spark, d, "embeddings"))


@query
def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fused(retrieval.nearest(table(spark, d, "embeddings"), k=32))


@query
def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    return chunking.pack(table(spark, d, "documents"))


@query
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    return chunking.windows(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")))


@query
def markup_strip(spark: SparkSession, d: str) -> DataFrame:
    chunks = corpus.delivered_chunks(table(spark, d, "chunks"))
    marked = F.concat(F.lit("<!DOCTYPE html><style>p {x}</style><div id='a'><p>"), F.replace(F.replace("content", F.lit("&"), F.lit("&amp;")), F.lit("\n"), F.lit("</p>\n<p>")), F.lit("</p><br/></div><!-- end -->"))
    return chunks.select("chunk_id", T.strip_markup(marked).alias("content"))


@query
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    chunks = corpus.delivered_chunks(table(spark, d, "chunks"))
    return chunks.groupBy("source_id").agg(F.count("*").alias("chunks"), F.sum(T.token_estimate(F.col("content"))).alias("tokens"))


@query
def index_words(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("jurisdiction_code", F.explode(T.index_words(F.col("text"))).alias("term"))
    return docs.groupBy("jurisdiction_code", "term").agg(F.count("*").alias("n"))


@query
def shard_prefix(spark: SparkSession, d: str) -> DataFrame:
    return index_words(spark, d).groupBy(N.shard(F.col("term")).alias("shard")).agg(F.count("*").alias("terms"), F.sum("n").alias("n"))


@query
def question_plans(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "evaluation_cases")
    return cases.select("item_id", F.array_join(T.question_terms(F.col("query")), " ").alias("terms"), F.array_join(T.query_plans(F.col("query")), " | ").alias("plans"))


@query
def title_languages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.groupBy(T.title_language(F.coalesce("title", F.lit(""))).alias("guess"), F.substring(F.lower(F.coalesce("lang", F.lit("und"))), 1, 2).alias("lang")).agg(F.count("*").alias("n"))


@query
def citation_candidates(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "citator_entries").select("entry_id", F.explode(T.neutral_citations(F.concat_ws(" ", "target_citation", "judgment_citation"))).alias("citation"))
    return texts.groupBy("citation").agg(F.countDistinct("entry_id").alias("entries"))


@query
def citator_lookup(spark: SparkSession, d: str) -> DataFrame:
    return corpus.citator_lookup(*_tables(spark, d, "citator_entries", "authorities"))


@query
def quote_verify(spark: SparkSession, d: str) -> DataFrame:
    return corpus.quote_checks(*_tables(spark, d, "citator_entries", "chunks"))


@query
def sensitive_scan(spark: SparkSession, d: str) -> DataFrame:
    # The corpus holds few such strings, so a line that does is put behind every fourth passage.
    chunks = corpus.delivered_chunks(table(spark, d, "chunks"))
    extra = F.when(F.col("chunk_id") % 4 == 1, F.concat(F.lit("\npassport no: AB-"), F.lpad(F.col("chunk_id").cast("string"), 9, "0"))).when(
        F.col("chunk_id") % 4 == 2, F.concat(F.lit("\naccount 4111 1111 1111 "), F.lpad((F.col("chunk_id") % 10000).cast("string"), 4, "0"))
    ).when(F.col("chunk_id") % 8 == 3, F.concat(F.lit("\nkey sk-"), F.lpad(F.col("chunk_id").cast("string"), 24, "a"))).otherwise("")
    found = chunks.select("chunk_id", sensitive.inspect(F.concat("content", extra)).alias("x"))
    return found.select("chunk_id", "x.decision", F.array_join("x.kinds", ",").alias("kinds"), F.md5("x.sanitized").alias("sanitized_md5"))


@query
def latest_chunks(spark: SparkSession, d: str) -> DataFrame:
    return corpus.delivered_chunks(table(spark, d, "chunks")).select("chunk_id", "doc_id", "reading_order", F.length("content").cast("long").alias("n_chars"))


@query
def dedup_hash(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.groupBy(corpus.content_hash(docs).alias("content_hash")).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).filter("n_docs > 1")


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    rows = docs.filter("external_id is not null").select("doc_id", "batch_no", "source_id", corpus.external_key(F.col("external_id")).alias("external_key"), corpus.content_hash(docs).alias("content_hash"))
    return rows


@query
def insert_new(spark: SparkSession, d: str) -> DataFrame:
    rows = _keyed(spark, d)
    return corpus.insert_new(rows.filter("batch_no = 0"), rows.filter("batch_no > 0"), ["source_id", "external_key"]).select("source_id", "external_key", "doc_id")


@query
def upsert_actions(spark: SparkSession, d: str) -> DataFrame:
    rows = _keyed(spark, d)
    old = corpus.latest(rows.filter("batch_no = 0"), ["source_id", "external_key"], [F.desc("doc_id")])
    new = corpus.latest(rows.filter("batch_no > 0"), ["source_id", "external_key"], [F.desc("batch_no"), F.desc("doc_id")])
    return corpus.upsert_actions(old, new, ["source_id", "external_key"], "content_hash").select("source_id", "external_key", "doc_id", "action")


@query
def replace_chunks(spark: SparkSession, d: str) -> DataFrame:
    return corpus.replaced_chunks(table(spark, d, "chunks"))


@query
def version_append(spark: SparkSession, d: str) -> DataFrame:
    return corpus.versions(table(spark, d, "documents"))


@query
def corpus_overview(spark: SparkSession, d: str) -> DataFrame:
    return corpus.overview(*_tables(spark, d, "documents", "chunks"))


@query
def catalogue_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return corpus.reconciled(*_tables(spark, d, "documents", "chunks"))


@query
def missing_documents(spark: SparkSession, d: str) -> DataFrame:
    docs, entries = _tables(spark, d, "documents", "citator_entries")
    return docs.select("doc_id", "source_id").join(entries.select(F.col("source_doc_id").alias("doc_id")), "doc_id", "left_anti")


@query
def duplicate_urls(spark: SparkSession, d: str) -> DataFrame:
    return corpus.duplicate_urls(table(spark, d, "documents"))


@query
def url_official(spark: SparkSession, d: str) -> DataFrame:
    docs, registry = _tables(spark, d, "documents", "source_registry")
    hosts = registry.select("source_id", corpus.url_host(F.concat("base_url", F.lit("/"))).alias("official"))
    host = corpus.url_host(F.col("canonical_url"))
    official = (host == F.col("official")) | F.endswith(host, F.concat(F.lit("."), F.col("official")))
    rows = docs.join(hosts, "source_id").withColumn("state", F.when(F.col("canonical_url").isNull(), "none").when(official, "official").otherwise("foreign"))
    return rows.groupBy("source_id", "state").agg(F.count("*").alias("n"))


@query
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.groupBy("current_status", "document_type").agg(
        F.count("*").alias("n"), F.count("citation").alias("cited"), F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.round(F.avg(F.octet_length("text").cast("double")), 4).alias("mean_bytes")
    )


@query
def capability_gate(spark: SparkSession, d: str) -> DataFrame:
    docs, registry = _tables(spark, d, "documents", "source_registry")
    gates = registry.select("source_id", corpus.capability_allowed("display").alias("display"), corpus.capability_allowed("embedding").alias("embedding"), corpus.capability_allowed("other").alias("other"), corpus.ingest_allowed().alias("ingest"))
    return docs.join(gates, "source_id").groupBy("source_id", "display", "embedding", "other", "ingest").agg(F.count("*").alias("n_docs"))


@query
def provenance(spark: SparkSession, d: str) -> DataFrame:
    return corpus.provenance(table(spark, d, "chunks"))


@query
def record_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("external_id is not null")
    return docs.select("doc_id", N.record_id(F.col("jurisdiction_code"), F.col("external_id")).alias("record_id"))


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    ts = F.col("ts").cast("timestamp")
    status = F.when(F.col("event_id") % 5 == 0, "queued").when(F.col("event_id") % 5 == 1, "running").otherwise("complete")
    return events.select(
        F.col("event_id").alias("job_id"), F.col("event_type").alias("job_type"), status.alias("status"), F.when(F.col("event_id") % 7 != 0, ts + F.expr("INTERVAL 5 MINUTE")).alias("available_at"),
        ts.alias("created_at"), (ts + F.expr("INTERVAL 1 HOUR")).alias("lease_expires_at"), (F.col("event_id") % 4).alias("attempts"), (F.col("event_id") % 3 != 0).alias("retryable"),
    )


@query
def lease_claim(spark: SparkSession, d: str) -> DataFrame:
    return queue.claim(_jobs(spark, d), _now()).select("job_type", "job_id", "place", "attempts", F.unix_seconds("lease_expires_at").alias("lease_end"))


@query
def retry_backoff(spark: SparkSession, d: str) -> DataFrame:
    return queue.failed(_jobs(spark, d).filter("status = 'running'"))


@query
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return queue.over_rate(table(spark, d, "events"), most=2, seconds=6 * 3600)


@query
def monitor_scan(spark: SparkSession, d: str) -> DataFrame:
    docs, registry = _tables(spark, d, "documents", "source_registry")
    docs = docs.join(corpus.public_sources(registry), "source_id", "left_semi").withColumn("content_hash", corpus.content_hash(docs)).withColumn("retrieved_at", F.col("retrieved_at").cast("timestamp"))
    # A monitor for all and one for a topic in every jurisdiction of the registry; what batch 0 brought is known.
    places = registry.select("jurisdiction_code").distinct()
    since = F.lit("2024-06-01").cast("timestamp")
    monitors = places.select(F.concat(F.lit("all-"), "jurisdiction_code").alias("monitor_id"), "jurisdiction_code", F.lit(None).cast("string").alias("topic"), since.alias("since")).unionByName(
        places.select(F.concat(F.lit("act-"), "jurisdiction_code").alias("monitor_id"), "jurisdiction_code", F.lit("act").alias("topic"), since.alias("since"))
    )
    seen = docs.filter("batch_no = 0").join(F.broadcast(monitors), "jurisdiction_code").select(F.concat_ws(":", F.lit("monitor"), "monitor_id", "doc_id", "content_hash").alias("fingerprint"))
    return queue.monitor_scan(monitors, docs, seen).select("monitor_id", "doc_id", "found", "advance")


@query
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return queue.windowed_stream(spark, d, "events.parquet")


@query
def event_properties(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").filter(F.col("event_type").isin("click", "view", "purchase", "signup"))
    k = F.get_json_object("props", "$.k").cast("double")
    kept = rows.select("event_type", F.when((k >= 0) & (k <= 300000), F.round(k)).cast("long").alias("k"))
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("with_k"), F.sum("k").alias("total_k"), F.max("k").alias("most_k"))


@query
def access_matters(spark: SparkSession, d: str) -> DataFrame:
    customer, orders = _tables(spark, d, "customer", "orders")
    items = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("item_id"), F.col("c_nationkey").cast("long").alias("org_id"), F.startswith(F.col("o_orderpriority"), F.lit("1")).alias("restricted"), (F.col("o_custkey") % 50).alias("creator")
    )
    # Customers stand for members (fifty users, each in many organizations), finished orders for granted matters.
    members = customer.select((F.col("c_custkey") % 50).alias("user_id"), F.col("c_nationkey").cast("long").alias("org_id")).distinct()
    grants = orders.filter("o_orderstatus = 'F'").select((F.col("o_orderkey") % 50).alias("user_id"), F.col("o_orderkey").alias("item_id"))
    seen = relations.visible(items, members, grants)
    return seen.groupBy("user_id").agg(F.count("*").alias("n_items"), F.min("item_id").alias("first_item"), F.max("item_id").alias("last_item"))


@query
def workflow_edges(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("step"))
    return relations.linear_edges(steps, "l_orderkey", "step")


@query
def table_text(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    cells = line.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("row"), F.explode(F.array(F.struct(F.lit(1).alias("c"), F.col("l_returnflag").alias("v")), F.struct(F.lit(2).alias("c"), F.col("l_linestatus").alias("v")), F.struct(F.lit(3).alias("c"), F.col("l_partkey").cast("string").alias("v")))).alias("x")).select("l_orderkey", "row", "x.c", "x.v")
    return relations.table_text(cells, "l_orderkey", "row", "c", "v")


@query
def jurisdiction_levels(spark: SparkSession, d: str) -> DataFrame:
    region, nation, customer = _tables(spark, d, "region", "nation", "customer")
    roots = region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    edges = nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent")).unionByName(
        customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent"))
    )
    return relations.levels(spark, edges, roots).groupBy("level").agg(F.count("*").alias("nodes"))


@query
def organization_list(spark: SparkSession, d: str) -> DataFrame:
    customer, orders, nation = _tables(spark, d, "customer", "orders", "nation")
    totals = orders.groupBy("o_custkey").agg(F.count("*").alias("matters"), F.sum((F.col("o_orderstatus") == "F").cast("long")).alias("done"))
    rows = customer.join(totals, F.col("c_custkey") == F.col("o_custkey"), "left").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", "c_name", "n_name", F.coalesce("matters", F.lit(0)).alias("matters"), F.round(F.coalesce("done", F.lit(0)) / F.greatest(F.lit(1), F.coalesce("matters", F.lit(0))), 6).alias("progress"))


@query
def page_offset(spark: SparkSession, d: str) -> DataFrame:
    return relations.page(table(spark, d, "documents").select("doc_id", "title", "source_id"), ["source_id", "doc_id"], start=101, count=200)


@query
def newest_generations(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    runs = docs.groupBy("source_id", "batch_no").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))
    return relations.newest(runs, "source_id", "batch_no").select("source_id", F.col("batch_no").cast("long").alias("batch_no"), "n_docs", "n_chars", "age")


QUERIES.update(checks.QUERIES)
SQL.update(checks.SQL)
