"""The inverted index: postings, shards, tokens of changed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivenry.functions import numbers as N
from scrivenry.functions import text as T


def postings(docs: DataFrame, most: int = 256) -> DataFrame:
    """(jurisdiction_code, shard, term, doc_id, weight): for each term of a jurisdiction its ``most`` heaviest documents.

    Words are counted per document before anything is shuffled by term, and the rank filter is
    applied in every task first, so a word that stands everywhere costs ``most`` rows a task.
    """
    body = docs.select("jurisdiction_code", "doc_id", F.explode(T.index_words(F.col("text"))).alias("term"), F.lit(1).alias("b"), F.lit(0).alias("t"))
    title = docs.select("jurisdiction_code", "doc_id", F.explode(T.index_words(F.concat_ws(" ", "title", "citation"))).alias("term"), F.lit(0).alias("b"), F.lit(1).alias("t"))
    counts = body.unionByName(title).groupBy("jurisdiction_code", "doc_id", "term").agg(F.sum("b").alias("b"), F.sum("t").alias("t"))
    rows = counts.select("jurisdiction_code", "term", "doc_id", N.posting_weight(F.col("b"), F.col("t")).alias("weight"))
    at = Window.partitionBy("jurisdiction_code", "term").orderBy(F.desc("weight"), "doc_id")
    kept = rows.withColumn("at", F.row_number().over(at)).filter(F.col("at") <= most)
    return kept.select("jurisdiction_code", N.shard(F.col("term")).alias("shard"), "term", "doc_id", "weight")


def shard_counts(index: DataFrame) -> DataFrame:
    """(jurisdiction_code, shard, terms, postings): the manifest of an index."""
    return index.groupBy("jurisdiction_code", "shard").agg(F.countDistinct("term").alias("terms"), F.count("*").alias("postings"))


def document_tokens(docs: DataFrame, most: int = 3000, longest: int = 100) -> DataFrame:
    """(doc_id, term, n): the ``most`` commonest words of each document, too long ones left out first."""
    words = docs.select("doc_id", F.explode(T.words(F.col("text"))).alias("term")).filter(F.length("term") <= longest)
    counts = words.groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    at = Window.partitionBy("doc_id").orderBy(F.desc("n"), "term")
    return counts.withColumn("at", F.row_number().over(at)).filter(F.col("at") <= most).select("doc_id", "term", "n")


def write_index(index: DataFrame, path: str, generation: str) -> None:
    """Write an index as one generation, a folder per jurisdiction and shard; a generation is never overwritten."""
    index.repartition("jurisdiction_code", "shard").write.mode("errorifexists").partitionBy("jurisdiction_code", "shard").parquet(f"{path}/generation={generation}")
