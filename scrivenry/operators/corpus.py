"""The corpus as tables: latest rows, rights, duplicates, overview, reconciliation, writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivenry.functions import text as T


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``. Ranking before the shuffle keeps one row per key and task."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_at", F.row_number().over(at)).filter("_at = 1").drop("_at")


def delivered_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks without second deliveries: the earliest row of each id."""
    return latest(chunks, ["chunk_id"], [F.col("created_at").asc_nulls_last()])


def content_hash(docs: DataFrame) -> Column:
    """The stored hash in lower case, or that of the text where none is stored."""
    return F.coalesce(F.lower(F.nullif(F.trim("content_sha256"), F.lit(""))), F.sha2("text", 256))


def public_sources(registry: DataFrame) -> DataFrame:
    """Sources whose records may be shown; the registry is one row per publisher, a bounded table."""
    return registry.filter("policy_state = 'approved' and commercial_display_allowed").select("source_id")


def capability_allowed(capability: str) -> Column:
    """Whether an approved source allows a capability: null if it isn't approved, false for unknown names."""
    flags = {"display": "commercial_display_allowed", "bulk": "bulk_ingestion_allowed", "embedding": "embedding_allowed", "sync": "sync_enabled"}
    flag = F.coalesce(F.col(flags[capability]), F.lit(False)) if capability in flags else F.lit(False)
    return F.when(F.col("policy_state") == "approved", flag)


def ingest_allowed() -> Column:
    """Whether a source may be read: approved, switched on, all flags true; a null flag fails."""
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in ("commercial_display_allowed", "bulk_ingestion_allowed", "embedding_allowed", "sync_enabled")]
    return (F.col("policy_state") == "approved") & flags[0] & flags[1] & flags[2] & flags[3]


def external_key(external_id: Column) -> Column:
    """An external id as it is compared: lower case, separators alike, no slash at the end."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(external_id)), r"[\s_\-/]+", "/"), "/$", "")


def insert_new(existing: DataFrame, arriving: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``arriving`` whose key isn't there yet, one per key (the least ``doc_id``)."""
    return latest(arriving, keys, [F.col("doc_id")]).join(existing.select(*keys).distinct(), keys, "left_anti")


def upsert_actions(existing: DataFrame, arriving: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Arriving rows with what an upsert does to them: insert, update, or unchanged (null-safe)."""
    old = existing.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_there"))
    joined = arriving.join(old, keys, "left")
    action = F.when(F.col("_there").isNull(), "insert").when(F.col(value).eqNullSafe(F.col("_old")), "unchanged").otherwise("update")
    return joined.withColumn("action", action).drop("_old", "_there")


def replaced_chunks(chunks: DataFrame) -> DataFrame:
    """The passages that replace a document's: without blank ones, renumbered from 0 in reading order."""
    kept = delivered_chunks(chunks).filter(F.trim(F.regexp_replace("content", r"\s+", " ")) != "")
    at = Window.partitionBy("doc_id").orderBy("reading_order", "chunk_id")
    return kept.select("doc_id", "chunk_id", (F.row_number().over(at) - 1).cast("long").alias("reading_order"))


def versions(docs: DataFrame) -> DataFrame:
    """(source_id, external_key, doc_id, version_no, is_canonical): versions by time of retrieval; the last is canonical."""
    by = Window.partitionBy("source_id", "external_key").orderBy(F.col("retrieved_at").asc_nulls_first(), "doc_id")
    whole = Window.partitionBy("source_id", "external_key")
    rows = docs.filter("external_id is not null").select("source_id", external_key(F.col("external_id")).alias("external_key"), "doc_id", "retrieved_at")
    rows = rows.withColumns({"version_no": F.row_number().over(by).cast("long"), "n": F.count("*").over(whole)})
    return rows.select("source_id", "external_key", "doc_id", "version_no", (F.col("version_no") == F.col("n")).alias("is_canonical"))


def overview(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: sources, documents, chunks, searchable documents, and counts by jurisdiction as JSON."""
    per = docs.groupBy("jurisdiction_code").agg(F.count("*").alias("n"))
    by = per.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("jurisdiction_code", "n"))))).alias("by_jurisdiction"))
    totals = docs.agg(F.countDistinct("source_id").alias("sources"), F.count("*").alias("documents"))
    parts = chunks.agg(F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("doc_id").alias("searchable"))
    return totals.crossJoin(parts).crossJoin(by)


def reconciled(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per source: records, those with an address, those with passages, missing ones, and whether the source is complete."""
    indexed = chunks.filter("length(trim(content)) > 0").select("doc_id").distinct().withColumn("indexed", F.lit(1))
    rows = docs.select("source_id", "doc_id", "canonical_url").join(indexed, "doc_id", "left")
    with_url = F.col("canonical_url").isNotNull()
    counts = rows.groupBy("source_id").agg(
        F.count("*").alias("total"), F.sum(with_url.cast("long")).alias("downloadable"), F.count("indexed").alias("indexed"),
        F.sum((F.col("indexed").isNull() & with_url).cast("long")).alias("missing"), F.min(F.when(~with_url, F.col("doc_id"))).alias("first_without_url"),
    )
    return counts.withColumn("complete", (F.col("missing") == 0) & (F.col("downloadable") == F.col("total")))


def url_key(url: Column) -> Column:
    """An address as it is compared: https, lower-case host without www, no query, fragment or slash at the end."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"[?#].*$", ""), r"/+$", "")
    return F.regexp_replace(plain, r"^https?://(www\.)?", "https://")


def url_host(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.trim(url)), r"^https?://(?:www\.)?([^/:@?#]+)(?:[/?#]|$)", 1)


def duplicate_urls(docs: DataFrame, top: int = 30) -> DataFrame:
    """The addresses that most documents of a source share, after bringing them to one form."""
    rows = docs.filter("canonical_url is not null").groupBy("source_id", url_key(F.col("canonical_url")).alias("url")).agg(F.count("*").alias("n"))
    return rows.filter("n > 1").orderBy(F.desc("n"), "source_id", "url").limit(top)


def provenance(chunks: DataFrame) -> DataFrame:
    """Per document: first page, first and last place, mean confidence over its passages."""
    return delivered_chunks(chunks).groupBy("doc_id").agg(
        F.min("page_number").cast("long").alias("first_page"), F.min("reading_order").cast("long").alias("first_place"), F.max("reading_order").cast("long").alias("last_place"),
        F.round(F.avg(F.col("extraction_confidence").cast("double")), 6).alias("confidence"),
    )


def quote_checks(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per citator entry whether its quote stands in the passage it names, and whether that passage exists."""
    entries = latest(entries, ["entry_id"], [F.col("created_at").asc_nulls_last()])
    passages = delivered_chunks(chunks).select(F.col("chunk_id").alias("source_chunk_id"), T.evidence_form(F.col("content")).alias("passage"))
    rows = entries.select("entry_id", "source_chunk_id", T.evidence_form(F.col("evidence_quote")).alias("quote")).join(passages, "source_chunk_id", "left")
    return rows.select("entry_id", F.col("passage").isNotNull().alias("has_passage"), F.coalesce((F.col("quote") != "") & F.contains("passage", "quote"), F.lit(False)).alias("quoted"))


def citator_lookup(entries: DataFrame, authorities: DataFrame) -> DataFrame:
    """Per authority the verified treatments of it: equal citations but for case and white space, in one jurisdiction."""
    entries = latest(entries, ["entry_id"], [F.col("created_at").asc_nulls_last()]).filter("status = 'verified'")
    asked = authorities.select("authority_id", F.col("jurisdiction_code").alias("jurisdiction"), T.citation_key(F.col("citation")).alias("key"))
    given = entries.select("jurisdiction", T.citation_key(F.col("target_citation")).alias("key"), "treatment", "entry_id")
    return asked.join(given, ["jurisdiction", "key"]).groupBy("authority_id", "treatment").agg(F.count("*").alias("n"), F.min("entry_id").alias("first_entry"))
