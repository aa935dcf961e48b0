"""Further queries over the reference's operators, each beside the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivenry.functions import text as T
from scrivenry.operators import audit, chunking, corpus, index, relations, retrieval
from scrivenry.plans import sql as S
from scrivenry.sources import table

QUERIES: dict[str, object] = {}
SQL: dict[str, str] = {}


def _query(sql: str):  # noqa: ANN202
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return corpus.latest(table(spark, d, "citator_entries"), ["entry_id"], [F.col("created_at").asc_nulls_last()])


_AUDIT = f"""WITH {S._CHUNKS}, {S._ENTRIES},
    a AS (SELECT entry_id, source_doc_id, source_chunk_id, '"' || coalesce(evidence_quote, '') || '" [P1] and (P' || (entry_id % 4 + 1) || ', page 2)' AS answer FROM e),
    p AS (SELECT a.entry_id, trim(regexp_replace(lower(coalesce(c.content, '')), '\\s+', ' ', 'g')) AS text, coalesce(c.extraction_confidence < 0.9, false) AS ocr,
          row_number() OVER (PARTITION BY a.entry_id ORDER BY CASE WHEN c.chunk_id = a.source_chunk_id THEN 0 ELSE 1 END, c.reading_order, c.chunk_id) AS i
          FROM a JOIN c ON c.doc_id = a.source_doc_id QUALIFY i <= 3),
    l AS (SELECT entry_id, unnest(list_distinct(regexp_extract_all(array_to_string(regexp_extract_all(answer, '\\[[^\\]\\n]{{1,200}}\\]|\\([PF]\\d+\\b[^)\\n]{{0,198}}\\)'), ' '), '\\b([PF]\\d+)\\b', 1))) AS label FROM a),
    lb AS (SELECT l.entry_id, count(*) AS n_labels, coalesce(string_agg(CASE WHEN p.i IS NULL THEN label END, ' ' ORDER BY label), '') AS unknown, coalesce(bool_or(ocr), false) AS ocr
           FROM l LEFT JOIN p ON p.entry_id = l.entry_id AND 'P' || p.i = l.label GROUP BY 1),
    q AS (SELECT entry_id, trim(regexp_replace(lower(unnest(regexp_extract_all(answer, '[“"]([^”"\\n]{{30,}})[”"]', 1))), '\\s+', ' ', 'g')) AS quote FROM a),
    qm AS (SELECT entry_id, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.entry_id = q.entry_id AND contains(p.text, q.quote))) AS n_unmatched FROM q GROUP BY 1)
    SELECT a.entry_id AS answer_id, coalesce(n_labels, 0) AS n_labels, coalesce(unknown, '') AS unknown, coalesce(n_unmatched, 0) AS n_unmatched, coalesce(ocr, false) AS ocr,
           coalesce(n_labels, 0) > 0 AND coalesce(unknown, '') = '' AND coalesce(n_unmatched, 0) = 0 AS passed FROM a LEFT JOIN lb USING (entry_id) LEFT JOIN qm USING (entry_id)"""


@_query(_AUDIT)
def citation_audit(spark: SparkSession, d: str) -> DataFrame:
    """Each entry's quote as an answer that refers to its passage, and to the second, third or (not there) fourth of its document."""
    entries = _entries(spark, d)
    answer = F.concat(F.lit('"'), F.coalesce("evidence_quote", F.lit("")), F.lit('" [P1] and (P'), (F.col("entry_id") % 4 + 1).cast("string"), F.lit(", page 2)"))
    answers = entries.select(F.col("entry_id").alias("answer_id"), "source_doc_id", "source_chunk_id", answer.alias("answer"))
    chunks = corpus.delivered_chunks(table(spark, d, "chunks")).select("chunk_id", "doc_id", "reading_order", "content", (F.col("extraction_confidence") < 0.9).alias("ocr"))
    held = answers.join(chunks, F.col("doc_id") == F.col("source_doc_id")).withColumn("own", F.when(F.col("chunk_id") == F.col("source_chunk_id"), 0).otherwise(1))
    passages = audit.labelled(held, "answer_id", ["own", "reading_order", "chunk_id"]).filter(F.col("label").isin("P1", "P2", "P3"))
    return audit.citation_audit(answers.select("answer_id", "answer"), passages.select("answer_id", "label", "content", "ocr"))


_SQ = "trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'))"


@_query(f"""WITH {S._ENTRIES}, r AS (SELECT concat_ws(':', organization_id, treatment) AS answer_id, coalesce({_SQ.format('evidence_quote')} <> '' AND contains({_SQ.format('text')}, {_SQ.format('evidence_quote')}), false) AS ok
        FROM e LEFT JOIN documents d ON d.doc_id = e.source_doc_id)
    SELECT answer_id, count(*) AS n_citations, count(*) FILTER (WHERE ok) AS n_supported, bool_and(ok) AS published FROM r GROUP BY 1""")  # fmt: skip
def published_check(spark: SparkSession, d: str) -> DataFrame:
    cited = _entries(spark, d).select(F.concat_ws(":", "organization_id", "treatment").alias("answer_id"), F.col("source_doc_id").alias("resource_id"), F.col("evidence_quote").alias("quote"))
    return audit.published_check(cited, table(spark, d, "documents").select(F.col("doc_id").alias("resource_id"), "text"))


@_query(f"""WITH {S._ENTRIES}, r AS (SELECT entry_id, target_citation, coalesce(coalesce(evidence_quote, '') <> '' AND contains({_SQ.format('text')}, {_SQ.format('evidence_quote')}), false) AS verified
        FROM e LEFT JOIN documents d ON d.doc_id = e.source_doc_id)
    SELECT entry_id AS cell_id, CASE WHEN verified THEN target_citation ELSE 'Not found' END AS value, CASE WHEN verified THEN 0.9::DOUBLE ELSE 0::DOUBLE END AS confidence, verified FROM r""")  # fmt: skip
def verified_values(spark: SparkSession, d: str) -> DataFrame:
    cells = _entries(spark, d).select(F.col("entry_id").alias("cell_id"), F.col("source_doc_id").alias("resource_id"), F.col("target_citation").alias("value"), F.col("evidence_quote").alias("quote"), F.lit(0.9).alias("confidence"))
    return audit.verified_values(cells, table(spark, d, "documents").select(F.col("doc_id").alias("resource_id"), "text"))


@_query(S.packing("string_split(regexp_replace(text, '\\.\\n', '.' || chr(10) || chr(10), 'g'), chr(10) || chr(10))", 2600, "chr(10) || chr(10)", 2))
def pack_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"\.\n", ".\n\n").alias("text"))
    return chunking.pack(docs, split="blank")


@_query(S.packing(f"string_split(replace(regexp_replace(text, '{S.SPACE}+', ' ', 'g'), '; ', ';' || chr(10)), chr(10))", 2600, "chr(10)", 1))
def pack_clauses(spark: SparkSession, d: str) -> DataFrame:
    return chunking.pack(table(spark, d, "documents"), split="clause")


@_query(S.packing("string_split(text, chr(10))", 2400, "chr(10)", 1, trim_cuts=False))
def pack_passages(spark: SparkSession, d: str) -> DataFrame:
    return chunking.pack(table(spark, d, "documents"), most=2400, trim_cuts=False)


@_query(f"""WITH {S._CHUNKS}, n AS (SELECT doc_id, CASE WHEN chunk_id % 5 = 0 THEN 1 ELSE 0 END AS kind, reading_order AS node_no, chunk_id, coalesce(source_node_ref, '#/body') AS ref, trim(content) AS content FROM c WHERE trim(content) <> ''),
    o AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY kind, node_no, chunk_id) - 1)::INTEGER AS ro FROM n)
    SELECT doc_id, ro AS reading_order, CASE WHEN row_number() OVER (PARTITION BY doc_id, ref ORDER BY ro) > 1 THEN ref || ':' || ro ELSE ref END AS ref, content FROM o""")  # fmt: skip
def structured_nodes(spark: SparkSession, d: str) -> DataFrame:
    chunks = corpus.delivered_chunks(table(spark, d, "chunks"))
    kind = F.when(F.col("chunk_id") % 5 == 0, "table").otherwise("text")
    return chunking.structured_nodes(chunks.select("doc_id", kind.alias("kind"), F.struct("reading_order", "chunk_id").alias("node_no"), F.coalesce("source_node_ref", F.lit("#/body")).alias("ref"), "content"))


def _first(name: str) -> str:
    """A list without later occurrences, in order."""
    return f"list_filter({name}, lambda x, i: list_position({name}, x) = i)"


_EXPANDED = " || ".join(f"CASE WHEN regexp_matches(query, '(?i){p}') THEN {S._list(t)} ELSE [] END" for p, t in T.DISCOVERY_EXPANSIONS)


@_query(f"""WITH w AS (SELECT item_id, query, passage, list_filter(regexp_extract_all(lower(query), '[a-z][a-z0-9-]{{2,}}'), lambda x: NOT list_contains({S._list(T.DISCOVERY_STOP)}, x) AND length(x) >= 4) AS ws FROM evaluation_cases),
    l AS (SELECT item_id, passage, ws[1:8] || {_EXPANDED} AS l FROM w), t AS (SELECT item_id, passage, ({_first('l')})[1:10] AS terms FROM l)
    SELECT item_id, array_to_string(terms, ' ') AS terms, list_sum(list_prepend(0, list_transform(terms, lambda t: CASE WHEN contains(lower(passage), t) THEN CASE WHEN length(t) >= 7 THEN 4 ELSE 2 END ELSE 0 END)))::BIGINT AS score FROM t""")  # fmt: skip
def discovery_terms(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "evaluation_cases").withColumn("terms", T.discovery_terms(F.col("query")))
    return cases.select("item_id", F.array_join("terms", " ").alias("terms"), T.contained_score(F.col("passage"), F.col("terms")).alias("score"))


_TOPIC = "CASE " + " ".join(f"WHEN regexp_matches(title, '(?i){p}') THEN '{t}'" for p, t in T.TOPICS) + " END"


@_query(f"WITH t AS (SELECT doc_id, title, {_TOPIC} AS topic FROM documents WHERE title IS NOT NULL) SELECT doc_id, CASE WHEN topic IS NOT NULL AND topic <> title THEN topic || ' | ' || title ELSE title END AS queries FROM t")
def topic_queries(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("title is not null")
    return docs.select("doc_id", F.array_join(T.topic_queries(F.col("title")), " | ").alias("queries"))


@_query(f"""WITH {S._CHUNKS}, {S._ENTRIES},
    s AS (SELECT chunk_id, doc_id, reading_order, '[' || CASE WHEN coalesce(page_number, 0) <> 0 THEN 'Page ' || page_number ELSE coalesce(source_node_ref, 'null') END || ']' || chr(10) || coalesce(content, '') AS shown FROM c),
    x AS (SELECT chunk_id, concat_ws(chr(10) || chr(10), lag(shown) OVER w, shown, lead(shown) OVER w) AS context FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY reading_order NULLS FIRST, chunk_id))
    SELECT entry_id, source_doc_id AS doc_id, e.source_chunk_id AS chunk_id, context FROM e JOIN x ON x.chunk_id = e.source_chunk_id""")  # fmt: skip
def passage_neighbours(spark: SparkSession, d: str) -> DataFrame:
    hits = _entries(spark, d).select("entry_id", F.col("source_doc_id").alias("doc_id"), F.col("source_chunk_id").alias("chunk_id"))
    return retrieval.with_neighbours(hits, table(spark, d, "chunks")).select("entry_id", "doc_id", "chunk_id", "context")


_DELTA = f"""{S._GATEWAY},
    dw AS (SELECT jurisdiction_code, doc_id, term, count(*) AS n FROM (SELECT jurisdiction_code, doc_id, unnest({S._WORDS3.format('text')}) AS term FROM documents WHERE batch_no = 12) GROUP BY 1, 2, 3),
    db AS (SELECT question_id, asked, doc_id, max(n) AS n FROM dw JOIN g2 USING (jurisdiction_code, term) GROUP BY 1, 2, 3),
    ds AS (SELECT question_id, doc_id, round(sum((1 + ln(1 + n::DOUBLE)) * w), 6) AS score, sum(w) AS hits FROM (
        SELECT *, CASE WHEN asked IN ('misconduct','disciplinary','hearing','procedural','admissibility','indemnity','confidentiality') THEN 2.5::DOUBLE ELSE 1::DOUBLE END AS w FROM db) GROUP BY 1, 2)"""


@_query(f"""WITH {_DELTA}, u AS (SELECT question_id, doc_id, round(score + 10 * hits, 6) AS score, true AS newer FROM ds UNION ALL
        SELECT question_id, doc_id, score, false FROM gateway g WHERE NOT EXISTS (SELECT 1 FROM ds WHERE ds.question_id = g.question_id AND ds.doc_id = g.doc_id))
    SELECT question_id, doc_id, score, newer, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS place FROM u QUALIFY place <= 8""")  # fmt: skip
def gateway_delta(spark: SparkSession, d: str) -> DataFrame:
    """The index's candidates and those of the last batch; a document of the batch takes the place of its older form."""
    docs = table(spark, d, "documents")
    questions = retrieval.question_rows(table(spark, d, "evaluation_cases"))
    base = retrieval.gateway_candidates(questions, index.postings(docs))
    words = docs.filter("batch_no = 12").select("jurisdiction_code", "doc_id", F.explode(T.words(F.col("text"))).alias("term")).groupBy("jurisdiction_code", "doc_id", "term").agg(F.count("*").alias("n"))
    newer = retrieval.delta_scores(questions, words).select("question_id", "doc_id", F.round(F.col("score") + 10 * F.col("hits"), 6).alias("score"), F.lit(True).alias("newer"))
    older = base.join(newer.select("question_id", "doc_id"), ["question_id", "doc_id"], "left_anti").select("question_id", "doc_id", "score", F.lit(False).alias("newer"))
    at = Window.partitionBy("question_id").orderBy(F.desc("score"), "doc_id")
    return newer.unionByName(older).withColumn("place", F.row_number().over(at).cast("long")).filter(F.col("place") <= 8)


@_query(f"""{S._SEARCH}, u AS (SELECT h.question_id, h.chunk_id, h.place AS was, trim(d.canonical_url) AS url, trim(regexp_replace(coalesce(c.content, ''), '\\s+', ' ', 'g'))[1:320] AS excerpt
        FROM hits h JOIN documents d USING (doc_id) JOIN c USING (chunk_id) WHERE d.canonical_url LIKE 'https://%'),
    f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY question_id, url ORDER BY was) = 1)
    SELECT question_id, url, chunk_id, excerpt, row_number() OVER (PARTITION BY question_id ORDER BY was) AS place FROM f QUALIFY place <= 6""")  # fmt: skip
def public_sources_top(spark: SparkSession, d: str) -> DataFrame:
    docs, chunks, registry = (table(spark, d, n) for n in ("documents", "chunks", "source_registry"))
    hits = retrieval.search(retrieval.question_rows(table(spark, d, "evaluation_cases")), docs, chunks, registry)
    urls = docs.filter("canonical_url like 'https://%'").select("doc_id", "canonical_url")
    ranked = hits.join(urls, "doc_id").withColumn("list_no", F.lit(0))
    top = retrieval.first_per_url(ranked, F.trim("canonical_url"))
    texts = corpus.delivered_chunks(chunks).select("chunk_id", F.substring(T.squeezed(F.coalesce("content", F.lit(""))), 1, 320).alias("excerpt"))
    return top.join(texts, "chunk_id").select("question_id", "url", "chunk_id", "excerpt", "place")


@_query(f"WITH {S._CHUNKS}, {S._QTERMS.strip()}, {S._search(False, 4, 'hits', scoped=True).strip()} SELECT * FROM hits")
def search_jurisdiction(spark: SparkSession, d: str) -> DataFrame:
    docs, chunks, registry = (table(spark, d, n) for n in ("documents", "chunks", "source_registry"))
    return retrieval.search(retrieval.question_rows(table(spark, d, "evaluation_cases")), docs, chunks, registry, scoped=True)


@_query("""WITH RECURSIVE n AS (SELECT l_orderkey AS g, l_linenumber AS k, min(l_partkey % 3) AS y FROM lineitem GROUP BY 1, 2),
    t AS (SELECT g, [k] AS done FROM (SELECT g, k, row_number() OVER (PARTITION BY g ORDER BY y, k) AS r FROM n WHERE k // 2 = 0 OR NOT EXISTS (SELECT 1 FROM n m WHERE m.g = n.g AND m.k = n.k // 2)) WHERE r = 1
        UNION ALL SELECT g, list_append(done, k) FROM (SELECT t.g, t.done, n.k, row_number() OVER (PARTITION BY t.g ORDER BY n.y, n.k) AS r FROM t JOIN n ON n.g = t.g
            WHERE NOT list_contains(t.done, n.k) AND (list_contains(t.done, n.k // 2) OR n.k // 2 = 0 OR NOT EXISTS (SELECT 1 FROM n m WHERE m.g = n.g AND m.k = n.k // 2))) WHERE r = 1)
    SELECT g AS graph_id, array_to_string(list_transform(done, lambda x: x::VARCHAR), ' ') AS keys, NULL::VARCHAR AS error FROM t QUALIFY row_number() OVER (PARTITION BY g ORDER BY len(done) DESC) = 1""")  # fmt: skip
def workflow_order(spark: SparkSession, d: str) -> DataFrame:
    """Each order's lines as a design in which a line waits for the one of half its number."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("graph_id"), F.col("l_linenumber").alias("k")).agg(F.min(F.col("l_partkey") % 3).alias("y"))
    nodes = lines.select("graph_id", F.col("k").alias("id"), F.col("k").alias("key"), "y")
    half = F.floor(F.col("k") / 2)
    edges = lines.filter(half > 0).select("graph_id", half.cast("int").alias("source"), F.col("k").alias("target"), F.lit(False).alias("conditional"))
    edges = edges.join(lines.select("graph_id", F.col("k").cast("int").alias("source")), ["graph_id", "source"], "left_semi")
    return relations.ordered_graphs(nodes, edges).select("graph_id", F.array_join("keys", " ").alias("keys"), "error")


@_query(f"WITH k AS (SELECT source_id, {S._KEY} AS k FROM documents WHERE external_id IS NOT NULL) SELECT source_id, count(*) AS n, count(DISTINCT k) AS n_keys, count(*) = count(DISTINCT k) AS is_unique FROM k GROUP BY 1")
def unique_keys(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("external_id is not null").select("source_id", corpus.external_key(F.col("external_id")).alias("k"))
    return docs.groupBy("source_id").agg(F.count("*").alias("n"), F.countDistinct("k").alias("n_keys")).withColumn("is_unique", F.col("n") == F.col("n_keys"))


@_query(f"""WITH k AS (SELECT source_id, {S._KEY} AS k, batch_no, doc_id FROM documents WHERE external_id IS NOT NULL),
    g AS (SELECT source_id, k, arg_max(doc_id, batch_no * 1000000000000 + doc_id) AS doc_id, min(batch_no * 1000000000000 + doc_id) AS pos FROM k GROUP BY 1, 2)
    SELECT source_id, k AS external_key, doc_id, row_number() OVER (PARTITION BY source_id ORDER BY pos) AS place FROM g""")  # fmt: skip
def last_value_first_place(spark: SparkSession, d: str) -> DataFrame:
    """Records keyed as in a dictionary: the last value of a key, at the place of its first."""
    at = F.struct(F.col("batch_no"), F.col("doc_id"))
    docs = table(spark, d, "documents").filter("external_id is not null").select("source_id", corpus.external_key(F.col("external_id")).alias("external_key"), "doc_id", at.alias("at"))
    keyed = docs.groupBy("source_id", "external_key").agg(F.max_by("doc_id", "at").alias("doc_id"), F.min("at").alias("at"))
    return keyed.withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy("at")).cast("long")).drop("at")


@_query(f"WITH {S._CHUNKS} SELECT doc_id, bool_or(coalesce(extraction_confidence < 0.9, false)) AS requires_verification, count(*) AS chunks FROM c GROUP BY 1")
def scanned_documents(spark: SparkSession, d: str) -> DataFrame:
    chunks = corpus.delivered_chunks(table(spark, d, "chunks"))
    return chunks.groupBy("doc_id").agg(F.bool_or(F.coalesce(F.col("extraction_confidence") < 0.9, F.lit(False))).alias("requires_verification"), F.count("*").alias("chunks"))


@_query("""SELECT doc_id, source_id, published FROM (SELECT doc_id, source_id, coalesce(strftime(published_at, '%Y-%m-%d'), '') AS published, regexp_matches(lower(coalesce(title, '')), '\\bact\\b') AS boost FROM documents)
    QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY boost DESC, published DESC, doc_id) <= 12""")  # fmt: skip
def latest_documents(spark: SparkSession, d: str) -> DataFrame:
    """The newest dozen of each source: those whose title names an act first, documents without a date last."""
    docs = table(spark, d, "documents").select("doc_id", "source_id", F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit("")).alias("published"), F.lower(F.coalesce("title", F.lit(""))).rlike(r"\bact\b").alias("boost"))
    at = Window.partitionBy("source_id").orderBy(F.desc("boost"), F.desc("published"), "doc_id")
    return docs.withColumn("at", F.row_number().over(at)).filter("at <= 12").select("doc_id", "source_id", "published")


@_query("SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS age FROM events QUALIFY age <= 100")
def event_tail(spark: SparkSession, d: str) -> DataFrame:
    at = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").select("event_type", "event_id", "ts").withColumn("age", F.row_number().over(at).cast("long")).filter("age <= 100").drop("ts")


@_query("""SELECT doc_id, coalesce(regexp_full_match(content_sha256, '[0-9a-f]{64}'), false) AS sha_ok, strftime(published_at, '%Y') AS year,
        coalesce(regexp_full_match(trim(canonical_url), 'https://[^/@?#:]+([/?#].*)?') AND NOT contains(canonical_url, '..'), false) AS url_ok,
        lower(concat_ws(' ', title, citation)) LIKE '%permit%' OR lower(concat_ws(' ', title, citation)) LIKE '%land%' AS named FROM documents""")  # fmt: skip
def document_checks(spark: SparkSession, d: str) -> DataFrame:
    """Domain checks of each document: hash, year, address (https, no user part, no parent folders), and whether title or citation name one of some terms."""
    docs = table(spark, d, "documents")
    named = F.lower(F.concat_ws(" ", "title", "citation"))
    url = F.trim("canonical_url").rlike(r"^https://[^/@?#:]+([/?#].*)?$") & ~F.contains("canonical_url", F.lit(".."))
    return docs.select(
        "doc_id", F.coalesce(F.col("content_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)).alias("sha_ok"), F.date_format("published_at", "yyyy").alias("year"), F.coalesce(url, F.lit(False)).alias("url_ok"),
        F.exists(F.array(F.lit("permit"), F.lit("land")), lambda t: F.contains(named, t)).alias("named"),
    )


@_query("""SELECT authority_id, CASE WHEN authority_type = 'legislation' THEN 'Cap. ' || n || coalesce(' R.E. ' || issued_year, '') WHEN n <> '' THEN 'No. ' || n END AS composed
    FROM (SELECT *, regexp_extract(citation, '(\\d+)\\D*$', 1) AS n FROM authorities) WHERE n <> ''""")  # fmt: skip
def composed_citations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "authorities").withColumn("n", F.regexp_extract("citation", r"(\d+)\D*$", 1)).filter("n <> ''")
    chapter = F.when(F.col("authority_type") == "legislation", F.col("n"))
    return rows.select("authority_id", T.composed_citation(chapter, F.col("n"), F.col("issued_year").cast("string")).alias("composed"))


@_query(f"""WITH {S._ENTRIES}, x AS (SELECT entry_id, list_filter(regexp_extract_all(concat_ws(' ', target_citation, judgment_citation), '\\[\\d{{4}}\\]\\s*[A-Z][A-Z0-9]{{1,12}}\\s*\\d{{1,7}}\\b') || [trim(coalesce(d.citation, ''))],
        lambda c: length(c) BETWEEN 3 AND 250) AS l FROM e LEFT JOIN documents d ON d.doc_id = e.source_doc_id)
    SELECT entry_id, array_to_string(({_first('l')})[1:80], ' | ') AS citations FROM x""")  # fmt: skip
def entry_citations(spark: SparkSession, d: str) -> DataFrame:
    rows = _entries(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("source_doc_id"), "citation"), "source_doc_id", "left")
    found = T.citation_candidates(F.concat_ws(" ", "target_citation", "judgment_citation"), F.array("citation"))
    return rows.select("entry_id", F.array_join(found, " | ").alias("citations"))


@_query("SELECT source_id, len(list_filter(content_types, lambda x: NOT list_contains(['legislation','judgment','notice','guidance'], x))) = 0 AND len(content_types) BETWEEN 1 AND 8 AS known_types FROM source_registry")
def known_content_types(spark: SparkSession, d: str) -> DataFrame:
    known = F.array(*map(F.lit, ("legislation", "judgment", "notice", "guidance")))
    return table(spark, d, "source_registry").select("source_id", ((F.size(F.array_except("content_types", known)) == 0) & F.size("content_types").between(1, 8)).alias("known_types"))


@_query(f"""WITH {S._CHUNKS}, a AS (SELECT item_id AS question_id, {S._WORDS1.format('passage')} AS ws FROM evaluation_cases WHERE item_id % 4 = 0),
    q AS (SELECT question_id, ' ' || array_to_string(ws[1:3], ' ') || ' ' AS p1, ' ' || array_to_string(ws[7:8], ' ') || ' ' AS p2, ' ' || ws[30] || ' ' AS no FROM a),
    t AS (SELECT chunk_id, doc_id, ' ' || array_to_string({S._WORDS1.format('content')}, ' ') || ' ' AS t FROM c)
    SELECT question_id, chunk_id, doc_id FROM q JOIN t ON contains(t, p1) AND contains(t, p2) AND NOT contains(t, coalesce(no, '\x01'))""")  # fmt: skip
def search_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Passages with the first three and the seventh and eighth word of an item as phrases, without its thirtieth."""
    cases = table(spark, d, "evaluation_cases").filter("item_id % 4 = 0").select(F.col("item_id").alias("question_id"), T.words(F.col("passage"), 1).alias("ws"))
    phrase = lambda at, n: F.array_join(F.slice("ws", at, n), " ")
    asked = cases.select("question_id", F.array(phrase(1, 3), phrase(7, 2)).alias("phrases"), F.array_compact(F.array(F.get("ws", F.lit(29)))).alias("without"))
    return retrieval.phrase_search(asked, table(spark, d, "chunks"))


@_query(f"""WITH {S._ENTRIES}, {S._QTERMS.strip()},
    o AS (SELECT organization_id, row_number() OVER (ORDER BY organization_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT organization_id FROM e WHERE organization_id IS NOT NULL)),
    q AS (SELECT item_id AS question_id, organization_id, term FROM qterms JOIN o ON o.i = item_id % o.n WHERE pos <= 4),
    w AS (SELECT entry_id, organization_id, term, count(*) AS n FROM (SELECT entry_id, organization_id, unnest({S._WORDS1.format('evidence_quote')}) AS term FROM e WHERE reviewed_at IS NOT NULL) GROUP BY ALL),
    r AS (SELECT question_id, entry_id, round(0.1::DOUBLE * sum(n), 6) AS rank FROM w JOIN q USING (organization_id, term) GROUP BY 1, 2)
    SELECT question_id, entry_id AS passage_id, rank, row_number() OVER (PARTITION BY question_id ORDER BY rank DESC, entry_id) AS place FROM r QUALIFY place <= 12""")  # fmt: skip
def private_search(spark: SparkSession, d: str) -> DataFrame:
    """Each item asked by a member of one organization, over the quotes that its reviewers have seen."""
    entries = _entries(spark, d)
    at = F.row_number().over(Window.orderBy("organization_id")) - 1
    # The organizations are the tenants: a list that is small beside their entries.
    organizations = entries.select("organization_id").filter("organization_id is not null").distinct()
    numbered = organizations.withColumn("i", at).crossJoin(F.broadcast(organizations.agg(F.count("*").alias("n"))))
    questions = table(spark, d, "evaluation_cases").select(F.col("item_id").alias("question_id"), T.question_terms(F.col("query")).alias("terms"))
    questions = questions.join(numbered, F.col("question_id") % F.col("n") == F.col("i"))
    passages = entries.filter("reviewed_at is not null").select(F.col("entry_id").alias("passage_id"), "organization_id", F.col("evidence_quote").alias("content"))
    return retrieval.private_search(questions.select("question_id", "organization_id", "terms"), passages)


@_query("SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS part_id, l_returnflag AS flag FROM lineitem")
def json_rows(spark: SparkSession, d: str) -> DataFrame:
    """Typed rows out of JSON arrays: each order's lines, written as one text and read back by a declared schema."""
    packed = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list(F.struct(F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("part_id"), F.col("l_returnflag").alias("flag")))).alias("lines"))
    rows = packed.select(F.col("l_orderkey").alias("order_id"), F.explode(F.from_json("lines", "array<struct<line_no: int, part_id: long, flag: string>>")).alias("x"))
    return rows.select("order_id", "x.line_no", "x.part_id", "x.flag")


@_query(f"""WITH k AS (SELECT source_id, {S._KEY} AS external_key, doc_id, batch_no, {S._HASH} AS content_hash FROM documents WHERE external_id IS NOT NULL),
    l AS (SELECT *, lag(content_hash) OVER (PARTITION BY source_id, external_key ORDER BY batch_no, doc_id) AS before FROM k)
    SELECT source_id, external_key, doc_id, CASE WHEN before IS NULL THEN 'created' ELSE 'changed' END AS event FROM l WHERE before IS NULL OR before <> content_hash""")  # fmt: skip
def state_log(spark: SparkSession, d: str) -> DataFrame:
    """The log of each record: a row when it is created and whenever its content changes, none for what came again unchanged."""
    docs = table(spark, d, "documents")
    rows = docs.filter("external_id is not null").select("source_id", corpus.external_key(F.col("external_id")).alias("external_key"), "doc_id", "batch_no", corpus.content_hash(docs).alias("content_hash"))
    before = F.lag("content_hash").over(Window.partitionBy("source_id", "external_key").orderBy("batch_no", "doc_id"))
    log = rows.withColumn("before", before).filter("before is null or before <> content_hash")
    return log.select("source_id", "external_key", "doc_id", F.when(F.col("before").isNull(), "created").otherwise("changed").alias("event"))


@_query("""WITH t AS (SELECT item_id, query, lag(query) OVER (PARTITION BY jurisdiction_code, lang ORDER BY item_id) AS before FROM evaluation_cases)
    SELECT item_id, CASE WHEN length(query) < 120 AND before IS NOT NULL THEN before || chr(10) || query ELSE query END AS query FROM t""")  # fmt: skip
def carried_questions(spark: SparkSession, d: str) -> DataFrame:
    """Short questions with the one asked before them in the same conversation."""
    before = F.lag("query").over(Window.partitionBy("jurisdiction_code", "lang").orderBy("item_id"))
    cases = table(spark, d, "evaluation_cases").withColumn("before", before)
    return cases.select("item_id", F.when((F.length("query") < 120) & F.col("before").isNotNull(), F.concat("before", F.lit("\n"), "query")).otherwise(F.col("query")).alias("query"))


@_query(f"""WITH k AS (SELECT source_id, {S._KEY} AS external_key, doc_id, batch_no FROM documents WHERE external_id IS NOT NULL),
    l AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY source_id, external_key ORDER BY batch_no DESC, doc_id DESC) = 1)
    SELECT l.doc_id, l.source_id, r.adapter_key, CASE WHEN r.sync_enabled AND r.policy_state = 'approved' THEN 'promote' ELSE 'hold' END AS action FROM l JOIN source_registry r USING (source_id)""")  # fmt: skip
def promoted_records(spark: SparkSession, d: str) -> DataFrame:
    """The latest form of each record beside the adapter of its source, and whether it is taken over."""
    docs = table(spark, d, "documents").filter("external_id is not null").select("source_id", corpus.external_key(F.col("external_id")).alias("external_key"), "doc_id", "batch_no")
    last = corpus.latest(docs, ["source_id", "external_key"], [F.desc("batch_no"), F.desc("doc_id")])
    action = F.when(F.col("sync_enabled") & (F.col("policy_state") == "approved"), "promote").otherwise("hold")
    return last.join(table(spark, d, "source_registry"), "source_id").select("doc_id", "source_id", "adapter_key", action.alias("action"))


@_query(f"""WITH {S._ENTRIES}, v AS (SELECT source_doc_id AS doc_id, arg_max(treatment, entry_id) AS treatment, count(*) AS n FROM e WHERE status = 'verified' GROUP BY 1)
    SELECT d.doc_id, coalesce(v.treatment, d.current_status) AS current_status, coalesce(v.n, 0) AS entries FROM documents d LEFT JOIN v USING (doc_id)""")  # fmt: skip
def updated_status(spark: SparkSession, d: str) -> DataFrame:
    """Documents updated from their last verified entry; the others stay as they are."""
    last = _entries(spark, d).filter("status = 'verified'").groupBy(F.col("source_doc_id").alias("doc_id")).agg(F.max_by("treatment", "entry_id").alias("treatment"), F.count("*").alias("n"))
    rows = table(spark, d, "documents").select("doc_id", "current_status").join(last, "doc_id", "left")
    return rows.select("doc_id", F.coalesce("treatment", "current_status").alias("current_status"), F.coalesce("n", F.lit(0)).alias("entries"))


_OWN = SQL["private_search"].split("SELECT question_id, entry_id AS passage_id")[0].replace("WITH ", "", 1).replace(S._QTERMS.strip() + ",", "")


@_query(f"""{S._SEARCH}, {_OWN}, p AS (SELECT question_id, count(*) AS n FROM hits WHERE place <= 16 GROUP BY 1),
    s AS (SELECT question_id, least(count(*), 12) AS n FROM r GROUP BY 1)
    SELECT item_id AS question_id, coalesce(p.n, 0) AS n_public, coalesce(s.n, 0) AS n_private, CASE WHEN coalesce(p.n, 0) + coalesce(s.n, 0) > 0 THEN 'retrieved' ELSE 'no-evidence' END AS state,
           (coalesce(p.n, 0) = 0) <> (coalesce(s.n, 0) = 0) AS partial FROM evaluation_cases c LEFT JOIN p ON p.question_id = c.item_id LEFT JOIN s ON s.question_id = c.item_id WHERE item_id % 20 = 0""")  # fmt: skip
def evidence_packet(spark: SparkSession, d: str) -> DataFrame:
    """What each stated question gets: at most sixteen public and twelve private passages, and whether one kind is missing."""
    docs, chunks, registry, cases = (table(spark, d, n) for n in ("documents", "chunks", "source_registry", "evaluation_cases"))
    public = retrieval.search(retrieval.question_rows(cases), docs, chunks, registry).filter("place <= 16").groupBy("question_id").agg(F.count("*").alias("n_public"))
    private = private_search(spark, d).groupBy("question_id").agg(F.count("*").alias("n_private"))
    rows = cases.filter("item_id % 20 = 0").select(F.col("item_id").alias("question_id")).join(public, "question_id", "left").join(private, "question_id", "left").fillna(0, ["n_public", "n_private"])
    state = F.when(F.col("n_public") + F.col("n_private") > 0, "retrieved").otherwise("no-evidence")
    return rows.select("question_id", "n_public", "n_private", state.alias("state"), ((F.col("n_public") == 0) != (F.col("n_private") == 0)).alias("partial"))
