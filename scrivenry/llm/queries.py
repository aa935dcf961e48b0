"""The queries of the numbered problems, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivenry.llm import abuse, arrivals, canonical, encoding, leaks, mixing, scans, site_lines
from scrivenry.llm.sql import SQL
from scrivenry.sources import table

__all__ = ["QUERIES", "SQL"]


def p1_mapped(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_citations(table(spark, d, "documents"), table(spark, d, "citator_entries"), table(spark, d, "authorities"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_mapped(spark, d).select("field", "record_id", "authority_id").distinct()


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return p1_mapped(spark, d).filter("authority_id = 0").groupBy("field", "value").agg(F.count("*").alias("n_rows"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = arrivals.duplicates(table(spark, d, "documents"))
    return found.select(F.least("doc_id", "original_id").alias("doc_id_a"), F.greatest("doc_id", "original_id").alias("doc_id_b")).distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.damaged_words(encoding.text_records(table(spark, d, "chunks"), table(spark, d, "documents"))).select("record_type", "record_id").distinct()


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    records = encoding.text_records(table(spark, d, "chunks"), table(spark, d, "documents"))
    return encoding.restored_text(records, encoding.damaged_words(records))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.Scan(table(spark, d, "chunks"), table(spark, d, "documents")).found()


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    return scans.Scan(table(spark, d, "chunks"), table(spark, d, "documents")).paragraphs()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    return site_lines.mark_site_lines(chunks, site_lines.site_lines(chunks))


def p5_lines(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    found = site_lines.wording(chunks, site_lines.site_lines(chunks))
    return found.select("source_id", site_lines.line_key(found["line"]).alias("letters"), "n_docs", "source_docs")


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    return site_lines.without_site_lines(chunks, site_lines.site_lines(chunks))


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "evaluation_cases"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_leaks(spark, d).select("item_id", "doc_id")


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    tokens = mixing.counted_once(table(spark, d, "documents"), targets)
    return mixing.emit(mixing.mix(tokens, mixing.mix_rates(tokens, targets)))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    tokens = mixing.counted_once(table(spark, d, "documents"), targets)
    rates = mixing.mix_rates(tokens, targets)
    return mixing.mix_report(mixing.mix(tokens, rates), rates)


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.score(table(spark, d, "documents"), table(spark, d, "labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_scores(spark, d).filter("score >= 0.5").select("doc_id")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(p8_scores(spark, d), table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_mapped, p1_unmatched, p2_found, p3_found, p3_restored, p4_found, p4_clean, p5_found, p5_lines, p5_clean, p6_found, p6_leaks, p7_mixture, p7_report, p8_found, p8_scores, p8_rates)
}
