"""Answering many questions at once: each is a row, its terms are joined with the passages."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivenry.functions import numbers as N
from scrivenry.functions import text as T
from scrivenry.operators.corpus import delivered_chunks, public_sources

#: The types of primary law, and the terms of a query that weigh more.
PRIMARY_LAW = ("act", "revised_act", "constitution", "code", "primary_legislation")
WEIGHTED_TERMS = ("misconduct", "disciplinary", "hearing", "procedural", "admissibility", "indemnity", "confidentiality")


def question_rows(cases: DataFrame, every: int = 20) -> DataFrame:
    """(question_id, jurisdiction_code, question, terms): the stated set of queries, the cases whose id ``every`` divides."""
    rows = cases.filter(F.col("item_id") % every == 0).select(F.col("item_id").alias("question_id"), "jurisdiction_code", F.col("query").alias("question"))
    return rows.withColumn("terms", T.question_terms(F.col("question")))


def _matches(questions: DataFrame, chunks: DataFrame, delivered: DataFrame, terms: Column) -> DataFrame:
    """(question_id, chunk_id, doc_id, n, distinct_terms): occurrences of any asked term in each delivered passage.

    Texts are taken apart where they are read; only asked words are shuffled. ``delivered``
    (chunk_id, created_at) tells which delivery of a passage counts, without its text.
    """
    asked = questions.select("question_id", F.explode(terms).alias("term"))
    held = chunks.select("chunk_id", "doc_id", "created_at", F.posexplode(T.words(F.col("content"), 1)).alias("at", "term"))
    # The terms of the stated questions are few and bounded.
    held = held.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi").dropDuplicates(["chunk_id", "created_at", "at"])
    own = delivered.select(F.col("chunk_id").alias("own_id"), F.col("created_at").alias("own_at"))
    held = held.join(own, (F.col("chunk_id") == F.col("own_id")) & F.col("created_at").eqNullSafe(F.col("own_at"))).groupBy("chunk_id", "doc_id", "term").agg(F.count("*").alias("n"))
    return held.join(F.broadcast(asked), "term").groupBy("question_id", "chunk_id", "doc_id").agg(F.sum("n").alias("n"), F.count("*").alias("distinct_terms"))


def search(
    questions: DataFrame, docs: DataFrame, chunks: DataFrame, registry: DataFrame, *, required: bool = False, scoped: bool = False, most_terms: int = 4, candidates: int = 400, per_doc: int = 3, limit: int = 24
) -> DataFrame:
    """(question_id, chunk_id, doc_id, rank, place): ranked passages of public sources for each question.

    A passage matches if it holds any (``required``: all) of the first ``most_terms`` terms, or is
    one of the first two of a document whose title does. Rank: a tenth per occurrence, 1.5 for a
    title that matches, 0.16 for primary law. Of the best ``candidates`` at most ``per_doc`` a
    document are kept, then ``limit``. ``scoped``: only documents of the question's jurisdiction.
    """
    limit = max(1, min(limit, 60))
    asked = questions.select("question_id", F.slice("terms", 1, most_terms).alias("terms")).filter("size(terms) > 0")
    passages = delivered_chunks(chunks.select("chunk_id", "doc_id", "reading_order", "created_at"))
    shown = docs.join(F.broadcast(public_sources(registry)), "source_id", "left_semi").select("doc_id", "title", "document_type", F.col("jurisdiction_code").alias("of"))
    body = _matches(asked, chunks, passages, F.col("terms"))
    body = body.join(asked, "question_id").filter(F.col("distinct_terms") == F.size("terms")).drop("terms") if required else body
    titles = shown.select("doc_id", F.array_distinct(T.words(F.coalesce("title", F.lit("")), 1)).alias("words"))
    titled = titles.select("doc_id", F.explode("words").alias("term")).join(F.broadcast(asked.select("question_id", F.size("terms").alias("asked"), F.explode("terms").alias("term"))), "term")
    titled = titled.groupBy("question_id", "doc_id").agg(F.count("*").alias("n_title"), F.first("asked").alias("asked"))
    titled = (titled.filter("n_title = asked") if required else titled).select("question_id", "doc_id", F.lit(True).alias("title_match"))
    at = Window.partitionBy("doc_id").orderBy(F.col("reading_order").asc_nulls_first(), "chunk_id")
    leading = passages.filter(F.coalesce("reading_order", F.lit(0)) <= 1).withColumn("at", F.row_number().over(at)).filter("at <= 2").select("chunk_id", "doc_id")
    by_title = titled.join(leading, "doc_id").select("question_id", "chunk_id", "doc_id", F.lit(0).cast("long").alias("n"))
    both = body.select("question_id", "chunk_id", "doc_id", "n").unionByName(by_title).groupBy("question_id", "chunk_id", "doc_id").agg(F.max("n").alias("n"))
    places = questions.select("question_id", "jurisdiction_code")
    both = both.join(shown.select("doc_id", "document_type", "of"), "doc_id")
    both = both.join(F.broadcast(places), "question_id").filter(F.col("of") == F.col("jurisdiction_code")) if scoped else both
    ranked = both.join(titled, ["question_id", "doc_id"], "left")
    rank = F.round(0.1 * F.col("n").cast("double") + F.when(F.col("title_match"), 1.5).otherwise(0.0) + F.when(F.lower(F.coalesce("document_type", F.lit(""))).isin(*PRIMARY_LAW), 0.16).otherwise(0.0), 6)
    ranked = ranked.select("question_id", "chunk_id", "doc_id", rank.alias("rank"))
    order = [F.desc("rank"), F.col("chunk_id")]
    top = ranked.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy(*order))).filter(F.col("place") <= candidates)
    top = top.withColumn("in_doc", F.row_number().over(Window.partitionBy("question_id", "doc_id").orderBy(*order))).filter(F.col("in_doc") <= per_doc)
    top = top.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy(*order)).cast("long")).filter(F.col("place") <= limit)
    return top.select("question_id", "chunk_id", "doc_id", "rank", "place")


def with_context(hits: DataFrame, chunks: DataFrame, most: int = 12) -> DataFrame:
    """Hits with the passages of their page and the pages beside it, in order, each under its page number.

    The wide text is joined only here, after the limit. Passages without a page stand alone.
    """
    passages = delivered_chunks(chunks).select("chunk_id", "doc_id", "page_number", "reading_order", "content")
    own = hits.join(passages.drop("doc_id", "reading_order"), "chunk_id")
    near = passages.select("doc_id", F.col("chunk_id").alias("near_id"), F.col("page_number").alias("near_page"), F.col("reading_order").alias("near_order"), F.col("content").alias("near_text"))
    # A page meets hits on three pages: an equality join on document and page, no range.
    wanted = own.filter("page_number is not null").select("question_id", "chunk_id", "doc_id", F.explode(F.sequence(F.col("page_number") - 1, F.col("page_number") + 1)).alias("near_page"))
    found = wanted.join(near, ["doc_id", "near_page"])
    at = Window.partitionBy("question_id", "chunk_id").orderBy("near_page", F.col("near_order").asc_nulls_last(), "near_id")
    found = found.withColumn("at", F.row_number().over(at)).filter(F.col("at") <= most)
    line = F.concat(F.lit("[Source PDF page "), F.col("near_page").cast("string"), F.lit("]\n"), F.col("near_text"))
    joined = found.groupBy("question_id", "chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("context"))
    return own.join(joined, ["question_id", "chunk_id"], "left").select("question_id", "chunk_id", "doc_id", "rank", "place", F.coalesce("context", "content").alias("context"))


def gateway_candidates(questions: DataFrame, index: DataFrame, top: int = 8) -> DataFrame:
    """(question_id, doc_id, score, place): the best documents by posting weights, in the question's jurisdiction.

    A term stands for its forms: the heaviest counts. Each term found adds its weight times ten
    beside the weighted postings.
    """
    forms = F.create_map(*[x for k, v in T.VARIANTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    asked = questions.select("question_id", "jurisdiction_code", F.explode(T.gateway_terms(F.col("question"))).alias("asked"))
    asked = asked.select("*", F.explode(F.coalesce(F.try_element_at(forms, F.col("asked")), F.array("asked"))).alias("term"))
    held = index.select("jurisdiction_code", "term", "doc_id", "weight").join(F.broadcast(asked), ["jurisdiction_code", "term"])
    best = held.groupBy("question_id", "asked", "doc_id").agg(F.max("weight").alias("value"))
    df = best.groupBy("question_id", "asked").agg(F.count("*").alias("df"))
    importance = F.when(F.col("asked").isin(*WEIGHTED_TERMS), 2.5).otherwise(1.0)
    weighted = best.join(df, ["question_id", "asked"]).withColumn("w", importance * N.term_weight(F.col("df")))
    score = F.round(F.sum(F.col("value") * F.col("w")) + 10 * F.sum("w"), 6)
    at = Window.partitionBy("question_id").orderBy(F.desc("score"), "doc_id")
    return weighted.groupBy("question_id", "doc_id").agg(score.alias("score")).withColumn("place", F.row_number().over(at).cast("long")).filter(F.col("place") <= top)


def times(text: Column, word: Column) -> Column:
    """How often ``word`` stands in ``text``, also inside other words."""
    return F.floor((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word))


def passage_score(text: Column, terms: Column, weights: Column) -> Column:
    """Score of a passage: each term by its commonest form, 0.15 more for each further occurrence up to three; a quarter for pages of contents.

    ``terms``: array; ``weights``: map from term to weight, 1 where it has none.
    """
    low = F.lower(text)
    forms = F.create_map(*[x for k, v in T.VARIANTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    def part(t: Column) -> Column:
        n = F.array_max(F.transform(F.coalesce(F.try_element_at(forms, t), F.array(t)), lambda v: times(low, v)))
        return F.when(n > 0, F.coalesce(F.try_element_at(weights, t), F.lit(1.0)) * (1 + 0.15 * F.least(F.lit(3), n - 1))).otherwise(0.0)

    score = F.aggregate(terms, F.lit(0.0), lambda s, t: s + part(t))
    return F.when(text.rlike(r"(?i)arrangement\s+of\s+sections|table\s+of\s+contents"), score * 0.25).otherwise(score)


def best_passages(candidates: DataFrame, questions: DataFrame, chunks: DataFrame, per_doc: int = 3, apart: int = 2, weights: Column | None = None) -> DataFrame:
    """(question_id, doc_id, chunk_id, passage_score, passage_place): each candidate's best passages that aren't close to a better one."""
    terms = questions.select("question_id", T.gateway_terms(F.col("question")).alias("terms"))
    passages = delivered_chunks(chunks.select("chunk_id", "doc_id", "reading_order", "created_at", "content"))
    at_doc = Window.partitionBy("doc_id").orderBy("reading_order", "chunk_id")
    numbered = passages.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("at", F.row_number().over(at_doc))
    rows = numbered.join(candidates.select("question_id", "doc_id"), "doc_id").join(terms, "question_id")
    weights = F.create_map(*[F.lit(x) for t in WEIGHTED_TERMS for x in (t, 2.5)]) if weights is None else weights
    scored = rows.withColumn("passage_score", F.round(passage_score(F.col("content"), F.col("terms"), weights), 6)).filter("passage_score > 0").select("question_id", "doc_id", "chunk_id", "at", "passage_score")
    # What is compared are the passages of one document and question: places up to ``apart`` away, by equality.
    better = scored.select("question_id", "doc_id", F.col("at").alias("b_at"), F.col("passage_score").alias("b_score"))
    near = scored.withColumn("b_at", F.explode(F.sequence(F.col("at") - apart, F.col("at") + apart))).join(better, ["question_id", "doc_id", "b_at"])
    beaten = near.filter((F.col("b_score") > F.col("passage_score")) | ((F.col("b_score") == F.col("passage_score")) & (F.col("b_at") < F.col("at")))).select("question_id", "chunk_id").distinct()
    kept = scored.join(beaten, ["question_id", "chunk_id"], "left_anti")
    order = Window.partitionBy("question_id", "doc_id").orderBy(F.desc("passage_score"), "at")
    return kept.withColumn("passage_place", F.row_number().over(order).cast("long")).filter(F.col("passage_place") <= per_doc).select("question_id", "doc_id", "chunk_id", "passage_score", "passage_place")


def with_neighbours(hits: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Columns of ``hits`` and ``context``: the passage with the one before and the one after it, each under its page or reference."""
    passages = delivered_chunks(chunks.select("chunk_id", "doc_id", "reading_order", "page_number", "source_node_ref", "created_at", "content"))
    passages = passages.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    head = F.when(F.coalesce("page_number", F.lit(0)) != 0, F.concat(F.lit("Page "), F.col("page_number").cast("string"))).otherwise(F.coalesce("source_node_ref", F.lit("null")))
    shown = F.concat(F.lit("["), head, F.lit("]\n"), F.coalesce("content", F.lit("")))
    at = Window.partitionBy("doc_id").orderBy("reading_order", "chunk_id")
    own = passages.withColumn("shown", shown).withColumn("context", F.concat_ws("\n\n", F.lag("shown").over(at), "shown", F.lead("shown").over(at)))
    return hits.join(own.select(key, "context"), key)


def delta_scores(questions: DataFrame, delta: DataFrame) -> DataFrame:
    """(question_id, doc_id, score, hits): documents that arrived after the index was built, scored by their word counts.

    ``questions``: (question_id, jurisdiction_code, question); ``delta``: (jurisdiction_code, doc_id,
    term, n). A term counts by its commonest form, 1 + ln(1 + n) times its weight.
    """
    forms = F.create_map(*[x for k, v in T.VARIANTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    asked = questions.select("question_id", "jurisdiction_code", F.explode(T.gateway_terms(F.col("question"))).alias("asked"))
    asked = asked.select("*", F.explode(F.coalesce(F.try_element_at(forms, F.col("asked")), F.array("asked"))).alias("term"))
    best = delta.join(asked, ["jurisdiction_code", "term"]).groupBy("question_id", "asked", "doc_id").agg(F.max("n").alias("n"))
    weight = F.when(F.col("asked").isin(*WEIGHTED_TERMS), 2.5).otherwise(1.0)
    return best.groupBy("question_id", "doc_id").agg(F.round(F.sum((1 + F.log1p(F.col("n").cast("double"))) * weight), 6).alias("score"), F.sum(weight).alias("hits"))


def first_per_url(ranked: DataFrame, url: Column, most: int = 6) -> DataFrame:
    """Rows of ranked lists, the first of each address (of one question), ``most`` at most. ``ranked``: (question_id, list_no, place, ...)."""
    rows = ranked.withColumn("url", url).filter("url is not null")
    first = Window.partitionBy("question_id", "url").orderBy("list_no", "place")
    order = Window.partitionBy("question_id").orderBy("list_no", "place")
    rows = rows.withColumn("_at", F.row_number().over(first)).filter("_at = 1").drop("_at")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= most)


def nearest(vectors: DataFrame, every: int = 20, k: int = 10, block: int = 2_048) -> DataFrame:
    """(query_id, vec_id, similarity, place): the ``k`` nearest rows by cosine for every row whose id ``every`` divides.

    The stated queries are taken in blocks of about ``block`` rows, which is what is sent to the
    tasks; each block meets every row once, as a product of matrices per batch of which only each
    query's best rows leave the task (with a margin, so that rounding decides no tie there). Null and
    zero vectors and those of another length have no similarity.
    """
    spark = vectors.sparkSession
    asked = vectors.filter(F.col("vec_id") % every == 0).select("vec_id", "embedding").filter("embedding is not null")
    blocks = max(1, -(-asked.count() // block))
    parts = []
    for n in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).collect()
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), [np.asarray(r[1], np.float64) for r in rows]))
        parts.append(vectors.select("vec_id", "embedding").filter("embedding is not null").mapInPandas(_near(sent, k), "query_id long, vec_id long, similarity double"))
    scored = reduce(DataFrame.unionByName, parts).withColumn("similarity", F.round("similarity", 6))
    at = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return scored.withColumn("place", F.row_number().over(at).cast("long")).filter(F.col("place") <= k)


def _near(sent, k: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, queries = sent.value
        for p in batches:
            own = [np.asarray(v, np.float64) for v in p["embedding"]]
            for size in {len(v) for v in own} & {len(q) for q in queries}:
                qs, vs = np.array([i for i, q in enumerate(queries) if len(q) == size]), np.array([i for i, v in enumerate(own) if len(v) == size])
                a, b = np.stack([queries[i] for i in qs]), np.stack([own[i] for i in vs])
                la, lb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
                qs, a, vs, b = qs[la > 0], a[la > 0] / la[la > 0, None], vs[lb > 0], b[lb > 0] / lb[lb > 0, None]
                if not len(qs) or not len(vs):
                    continue
                there = p["vec_id"].to_numpy(np.int64)[vs]
                s = a @ b.T
                s[ids[qs][:, None] == there[None, :]] = -np.inf
                least = np.sort(s, axis=1)[:, -min(k, s.shape[1])][:, None] - 2e-6
                i, j = np.nonzero((s >= least) & np.isfinite(s))
                yield pd.DataFrame({"query_id": ids[qs][i], "vec_id": there[j], "similarity": s[i, j]})

    return run


def fused(rows: DataFrame) -> DataFrame:
    """(query_id, vec_id, score, place): two rankings of the same rows made one."""
    lexical = F.row_number().over(Window.partitionBy("query_id").orderBy("vec_id")) - 1
    semantic = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")) - 1
    ranked = rows.withColumns({"lexical": lexical, "semantic": semantic}).withColumn("score", F.round(N.fusion(F.col("lexical"), F.col("semantic")), 9))
    at = Window.partitionBy("query_id").orderBy(F.desc("score"), "lexical")
    return ranked.withColumn("fused_place", F.row_number().over(at).cast("long")).select("query_id", "vec_id", "score", F.col("fused_place").alias("place"))


def interleaved(lists: DataFrame, rounds: int = 24, most: int = 32) -> DataFrame:
    """(question_id, chunk_id, place): ranked lists taken in turn, the first occurrence of a row counts.

    ``lists``: (question_id, list_no, place, chunk_id), places from 1.
    """
    first = lists.filter(F.col("place") <= rounds).groupBy("question_id", "chunk_id").agg(F.min(F.struct("place", "list_no")).alias("at"))
    order = Window.partitionBy("question_id").orderBy("at.place", "at.list_no", "chunk_id")
    return first.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= most).select("question_id", "chunk_id", "place")


def first_that_answers(lists: DataFrame) -> DataFrame:
    """The rows of each question's first list that isn't empty."""
    first = lists.groupBy("question_id").agg(F.min("list_no").alias("list_no"))
    return lists.join(first, ["question_id", "list_no"])


def phrase_search(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, chunk_id, doc_id): delivered passages that hold every phrase and no excluded word.

    ``asked``: (question_id, phrases, without), arrays of phrases and of words. A phrase is its words
    beside each other, without case and punctuation; one without words is held by none. Words are
    joined by equality, a phrase by the place where its first word would stand.
    """
    delivered = delivered_chunks(chunks.select("chunk_id", "doc_id", "created_at"))
    phrases = asked.select("question_id", F.size("phrases").alias("n_phrases"), F.posexplode("phrases").alias("phrase_no", "phrase"))
    words_ = phrases.select("question_id", "n_phrases", "phrase_no", T.words(F.col("phrase"), 1).alias("ws")).select("question_id", "n_phrases", "phrase_no", F.size("ws").alias("n_words"), F.posexplode("ws").alias("i", "term"))
    without = asked.select("question_id", F.explode("without").alias("word")).select("question_id", F.explode(T.words(F.col("word"), 1)).alias("term"))
    held = chunks.select("chunk_id", "created_at", F.posexplode(T.words(F.col("content"), 1)).alias("at", "term"))
    held = held.join(F.broadcast(words_.select("term").union(without.select("term")).distinct()), "term", "left_semi")
    own = delivered.select(F.col("chunk_id").alias("own_id"), "doc_id", F.col("created_at").alias("own_at"))
    held = held.join(own, (F.col("chunk_id") == F.col("own_id")) & F.col("created_at").eqNullSafe(F.col("own_at"))).select("chunk_id", "doc_id", "at", "term").distinct()
    runs = held.join(F.broadcast(words_), "term").groupBy("question_id", "n_phrases", "phrase_no", "n_words", "chunk_id", "doc_id", (F.col("at") - F.col("i")).alias("start")).agg(F.count("*").alias("n"))
    found = runs.filter("n = n_words").groupBy("question_id", "n_phrases", "chunk_id", "doc_id").agg(F.countDistinct("phrase_no").alias("n")).filter("n = n_phrases")
    barred = held.join(F.broadcast(without), "term").select("question_id", "chunk_id").distinct()
    return found.join(barred, ["question_id", "chunk_id"], "left_anti").select("question_id", "chunk_id", "doc_id")


def private_search(questions: DataFrame, passages: DataFrame, most_terms: int = 4, limit: int = 12) -> DataFrame:
    """(question_id, passage_id, rank, place): passages of the asker's own organization that hold any of the terms.

    ``questions``: (question_id, organization_id, terms); ``passages``: (passage_id, organization_id,
    content), those that are ready. Rank: a tenth per occurrence. A passage of another organization
    is never compared: the organization is part of the join.
    """
    asked = questions.select("question_id", "organization_id", F.explode(F.slice("terms", 1, most_terms)).alias("term"))
    held = passages.select("passage_id", "organization_id", F.explode(T.words(F.col("content"), 1)).alias("term")).join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    hits = held.groupBy("passage_id", "organization_id", "term").agg(F.count("*").alias("n")).join(F.broadcast(asked), ["organization_id", "term"])
    ranked = hits.groupBy("question_id", "passage_id").agg(F.round(0.1 * F.sum("n").cast("double"), 6).alias("rank"))
    at = Window.partitionBy("question_id").orderBy(F.desc("rank"), "passage_id")
    return ranked.withColumn("place", F.row_number().over(at).cast("long")).filter(F.col("place") <= max(1, min(limit, 60)))
