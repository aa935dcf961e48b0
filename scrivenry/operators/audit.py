"""Checks of answers against their sources: labels, quotes, extracted values."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scrivenry.functions import text as T


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def compatible(text: Column) -> Column:
    """Unicode's compatibility form; texts within ASCII aren't sent to Python."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def quoted(answer: Column, least: int = 30) -> Column:
    """The passages in straight or curly quotes that have at least ``least`` characters."""
    return F.regexp_extract_all(answer, F.lit(rf"[“\"]([^”\"\n]{{{least},}})[”\"]"), F.lit(1))


def labelled(passages: DataFrame, key: str, order: list[Column | str], letter: str = "P") -> DataFrame:
    """``passages`` with a column ``label``: the letter and the place (from 1) of a passage in its list."""
    return passages.withColumn("label", F.concat(F.lit(letter), F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("string")))


def citation_audit(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """(answer_id, n_labels, unknown, n_unmatched, ocr, passed) for each answer.

    ``answers``: (answer_id, answer); ``passages``: (answer_id, label, content, ocr). ``unknown`` are
    labels without a passage, ``n_unmatched`` quotes that stand in none of the answer's passages
    (compatibility form, no case, white space made single), ``ocr`` whether a cited passage is from
    a scan. An answer passes if it has a label, no unknown one and no unmatched quote. Answers
    without passages have all their labels unknown; null answers have none and don't pass.
    """
    labels = answers.select("answer_id", F.explode(T.evidence_labels(F.col("answer"))).alias("label"))
    held = labels.join(passages.select("answer_id", "label", F.coalesce("ocr", F.lit(False)).alias("ocr"), F.lit(True).alias("held")), ["answer_id", "label"], "left")
    by_label = held.groupBy("answer_id").agg(
        F.count("*").alias("n_labels"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("held").isNull(), F.col("label")))), " ").alias("unknown"), F.coalesce(F.bool_or("ocr"), F.lit(False)).alias("ocr")
    )
    quotes = answers.select("answer_id", F.posexplode(quoted(F.col("answer"))).alias("at", "quote")).withColumn("quote", T.evidence_form(compatible(F.col("quote"))))
    # Quotes are few beside the texts: only passages of answers that quote are put into their form.
    texts = passages.join(quotes.select("answer_id").distinct(), "answer_id", "left_semi").select("answer_id", T.evidence_form(compatible(F.coalesce("content", F.lit("")))).alias("text"))
    found = quotes.join(texts, "answer_id", "left").groupBy("answer_id", "at").agg(F.coalesce(F.bool_or(F.contains("text", F.col("quote"))), F.lit(False)).alias("found"))
    by_quote = found.groupBy("answer_id").agg(F.sum((~F.col("found")).cast("long")).alias("n_unmatched"))
    rows = answers.select("answer_id").distinct().join(by_label, "answer_id", "left").join(by_quote, "answer_id", "left").fillna({"n_labels": 0, "unknown": "", "n_unmatched": 0, "ocr": False})
    return rows.withColumn("passed", (F.col("n_labels") > 0) & (F.col("unknown") == "") & (F.col("n_unmatched") == 0))


def published_check(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, n_citations, n_supported, published): an answer is published if every quote stands in the resource it names.

    ``citations``: (answer_id, resource_id, quote); ``sources``: (resource_id, text). Case counts;
    compatibility form and single white space don't. A blank quote or unknown resource is unsupported.
    """
    quotes = citations.select("answer_id", "resource_id", T.squeezed(compatible(F.coalesce("quote", F.lit("")))).alias("quote"))
    texts = sources.join(citations.select("resource_id").distinct(), "resource_id", "left_semi").select("resource_id", T.squeezed(compatible(F.coalesce("text", F.lit("")))).alias("text"))
    ok = F.coalesce((F.col("quote") != "") & F.contains("text", F.col("quote")), F.lit(False))
    rows = quotes.join(texts, "resource_id", "left").select("answer_id", ok.alias("ok"))
    return rows.groupBy("answer_id").agg(F.count("*").alias("n_citations"), F.sum(F.col("ok").cast("long")).alias("n_supported"), F.bool_and("ok").alias("published"))


def verified_values(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """Extracted values whose quote stands in their document; the others become "Not found" with confidence 0.

    ``cells``: (cell_id, resource_id, value, quote, confidence); ``sources``: (resource_id, text).
    """
    rows = cells.join(sources.select("resource_id", T.squeezed(F.coalesce("text", F.lit(""))).alias("text")), "resource_id", "left")
    quote = T.squeezed(F.coalesce("quote", F.lit("")))
    ok = F.coalesce((F.coalesce("quote", F.lit("")) != "") & F.contains("text", quote), F.lit(False))
    return rows.withColumn("verified", ok).select(
        "cell_id", F.when(F.col("verified"), F.col("value")).otherwise("Not found").alias("value"), F.when(F.col("verified"), F.col("confidence")).otherwise(0.0).alias("confidence"), "verified"
    )
