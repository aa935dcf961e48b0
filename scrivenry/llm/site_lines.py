"""Lines that belong to a site and not to its documents.

Per source, the number of documents holding a line is compared with the documents of the other
sources by a log-likelihood ratio; the tests are corrected by the Benjamini-Hochberg procedure, and
the lines that stand out are removed by an anti-join before the documents are put together again.

Defined results: null or empty content has no lines; rows delivered twice count once; a null source
has no site; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from scrivenry.sources import materialize


def line_key(line: Column) -> Column:
    """The letters of a line in order, without case: lines with equal keys are the same line."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")


def chunk_lines(chunks: DataFrame, min_letters: int = 20) -> DataFrame:
    """(chunk_id, doc_id, source_id, reading_order, line_no, line, key): a row per line; key is null below ``min_letters``."""
    # A 64-bit hash and the length stand for the letters: fixed width in every shuffle. Lines shorter than that need no regex.
    # The letters are taken where a text is divided: a filter on the key, pushed below a projection, would take them twice.
    parts = F.transform(F.split("content", "\n", -1), lambda x: F.struct(x.alias("line"), F.when(F.length(x) >= min_letters, line_key(x)).alias("letters")))
    keyed = chunks.select("chunk_id", "doc_id", "source_id", "reading_order", F.posexplode(parts).alias("at", "part")).select("*", "part.line", "part.letters")
    return keyed.select(
        "chunk_id", "doc_id", "source_id", "reading_order", (F.col("at") + 1).cast("long").alias("line_no"), "line",
        F.when(F.length("letters") >= min_letters, F.struct(F.xxhash64("letters").alias("h"), F.length("letters").alias("n"))).alias("key"),
    )


@F.pandas_udf(DoubleType())
def _chi2_tail(g: pd.Series) -> pd.Series:
    """P(chi-squared with one degree of freedom >= g)."""
    return g.map(lambda x: math.erfc(math.sqrt(max(x, 0.0) / 2)))


def _term(seen: Column, expected: Column) -> Column:
    return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)


def _bh_threshold(tested: DataFrame, tests: Column, fdr: float) -> DataFrame:
    """One row: the smallest ratio that the Benjamini-Hochberg procedure accepts.

    Works on a histogram of the ratio (steps of 1/4, one step for all above 1000), so that no
    global sort of the tests is needed: at most 4001 rows reach the window.
    """
    step = F.least(F.floor(F.col("llr") * 4), F.lit(4000))
    hist = tested.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.max(tests).alias("m"))
    above = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("step")))
    ok = _chi2_tail(F.col("step") / 4) <= F.lit(fdr) * F.col("rank") / F.col("m")
    return hist.withColumn("rank", above).filter(ok).agg((F.min("step") / 4).alias("least"))


def site_lines(chunks: DataFrame, min_letters: int = 20, min_docs: int = 4, min_share: float = 0.07, fdr: float = 0.05) -> DataFrame:
    """(source_id, key, n_docs, source_docs, share, llr): lines of a source that are in excess there.

    The outside of a source is every other source that doesn't itself repeat the line in
    ``min_share`` of its documents (else a notice shared by several sites would hide itself), and a
    pseudo-source of average size holding half a document with the line. After the test the exact
    rule follows: at least ``min_docs`` documents and ``min_share`` of the source's documents.
    """
    permille = round(min_share * 1000)
    lines = chunk_lines(chunks, min_letters).filter(F.col("source_id").isNotNull() & F.col("doc_id").isNotNull() & F.col("key").isNotNull())
    per_doc = lines.select("source_id", "key", "doc_id").distinct()
    per_source = per_doc.groupBy("source_id", "key").agg(F.count("*").alias("n_docs"))
    sizes = chunks.filter(F.col("source_id").isNotNull()).groupBy("source_id").agg(F.countDistinct("doc_id").alias("source_docs"))
    totals = sizes.agg(F.sum("source_docs").alias("all_docs"), F.count("*").alias("sources"))
    repeated = F.col("n_docs") * 1000 >= F.col("source_docs") * permille
    counted = materialize(per_source.join(sizes, "source_id"), "site_lines")
    outside = (
        counted.filter("n_docs > 1").groupBy("key")
        .agg(F.max("n_docs").alias("most"), F.sum(F.when(repeated, F.col("source_docs"))).alias("repeating_docs"), F.sum(F.when(~repeated, F.col("n_docs"))).alias("other_with"))
        .filter(F.col("most") >= min_docs).drop("most")
    )
    singles = counted.filter("n_docs = 1").join(outside.select("key"), "key", "left_semi").groupBy("key").agg(F.count("*").alias("single_with"))
    tests = counted.agg(F.count("*").alias("tests"))
    k, n = F.col("n_docs").cast("double"), F.col("source_docs").cast("double")
    k2 = F.coalesce(F.col("other_with"), F.lit(0)) + F.coalesce(F.col("single_with"), F.lit(0)) - F.when(repeated, 0).otherwise(F.col("n_docs")) + 0.5
    n2 = F.col("all_docs") - F.coalesce(F.col("repeating_docs"), F.lit(0)) - F.when(repeated, 0).otherwise(F.col("source_docs")) + F.col("all_docs") / F.col("sources")
    tested = (
        counted.filter(F.col("n_docs") >= min_docs).join(outside, "key").join(singles, "key", "left").crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(tests))
        .withColumn("k2", k2).withColumn("n2", n2)
        .withColumn("p", (k + F.col("k2")) / (n + F.col("n2")))
        .withColumn("llr", F.when(k / n > F.col("k2") / F.col("n2"), 2 * (
            _term(k, n * F.col("p")) + _term(n - k, n * (1 - F.col("p"))) + _term(F.col("k2"), F.col("n2") * F.col("p")) + _term(F.col("n2") - F.col("k2"), F.col("n2") * (1 - F.col("p")))
        )).otherwise(0.0))
    )
    tested = materialize(tested.select("source_id", "key", "n_docs", "source_docs", "llr", "tests"), "site_line_tests")
    least = _bh_threshold(tested, F.col("tests"), fdr)
    return (
        tested.crossJoin(F.broadcast(least)).filter((F.col("llr") >= F.col("least")) & repeated)
        .select("source_id", "key", "n_docs", "source_docs", (F.col("n_docs") / F.col("source_docs")).alias("share"), F.round("llr", 6).alias("llr"))
    )


def mark_site_lines(chunks: DataFrame, found: DataFrame, min_letters: int = 20) -> DataFrame:
    """(chunk_id, line_no): where the lines of ``found`` stand, each place once."""
    lines = chunk_lines(chunks, min_letters).filter("key is not null").select("chunk_id", "source_id", "line_no", "key")
    return lines.join(found.select("source_id", "key"), ["source_id", "key"], "left_semi").select("chunk_id", "line_no").distinct()


def wording(chunks: DataFrame, found: DataFrame, min_letters: int = 20) -> DataFrame:
    """``found`` with a column ``line``: the least of the spellings in which each line occurs in its source."""
    lines = chunk_lines(chunks, min_letters).filter("key is not null").select("source_id", "key", "line")
    spelt = lines.join(found.select("source_id", "key"), ["source_id", "key"], "left_semi").groupBy("source_id", "key").agg(F.min("line").alias("line"))
    return found.join(spelt, ["source_id", "key"])


def without_site_lines(chunks: DataFrame, found: DataFrame, min_letters: int = 20) -> DataFrame:
    """(doc_id, text, n_removed): each document from its other lines, in reading order.

    Chunks delivered twice are used once. A document of which nothing is left has the text ''.
    """
    once = chunks.select("chunk_id", "doc_id", "source_id", "reading_order", "content").dropDuplicates(["chunk_id"])
    lines = chunk_lines(once, min_letters)
    site = found.select("source_id", "key", F.lit(1).alias("site"))
    marked = lines.join(site, ["source_id", "key"], "left")
    own = F.collect_list(F.when(F.col("site").isNull(), F.struct("reading_order", "chunk_id", "line_no", "line")))
    return marked.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(own), lambda x: x["line"]), "\n").alias("text"), F.count("site").alias("n_removed")
    )
