"""The same results in DuckDB's SQL."""

from __future__ import annotations

from scrivenry.functions import text as T


def _list(words: list[str] | tuple[str, ...]) -> str:
    return "[" + ",".join(f"'{w}'" for w in words) + "]"


_CHUNKS = "c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY created_at NULLS LAST) = 1)"
_ENTRIES = "e AS (SELECT * FROM citator_entries QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY created_at NULLS LAST) = 1)"
_CANON = "MAP {" + ",".join(f"'{k}':'{v}'" for k, v in T.CANONICAL.items()) + "}"
_WORDS3 = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]{{3,}}')"
_WORDS1 = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]{{1,}}')"
_QTERMS = f"""
    raw AS (SELECT item_id, w, i FROM (SELECT item_id, unnest({_WORDS3.format('query')}) AS w, generate_subscripts({_WORDS3.format('query')}, 1) AS i FROM evaluation_cases)
            WHERE NOT list_contains({_list(T.QUESTION_STOP)}, w) AND NOT regexp_full_match(w, '[0-9]+')),
    once AS (SELECT item_id, w, min(i) AS i FROM raw GROUP BY 1, 2),
    canon AS (SELECT item_id, coalesce({_CANON}[w], w) AS term, CASE WHEN list_contains({_list(T.CONCEPTS)}, w) THEN 0 ELSE 1 END AS rank, i FROM once),
    firsts AS (SELECT * FROM canon QUALIFY row_number() OVER (PARTITION BY item_id, term ORDER BY i) = 1),
    placed AS (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY rank, i) AS pos FROM firsts),
    qterms AS (SELECT item_id, term, pos FROM placed WHERE pos <= 8)"""
_HASH = "coalesce(lower(nullif(trim(content_sha256), '')), sha256(text))"
_KEY = "regexp_replace(regexp_replace(lower(trim(external_id)), '[\\s_\\-/]+', '/', 'g'), '/$', '')"
_KEYED = f"keyed AS (SELECT doc_id, batch_no, source_id, {_KEY} AS external_key, {_HASH} AS content_hash FROM documents WHERE external_id IS NOT NULL)"
_SQUEEZE = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
_HOST = "regexp_extract(lower(trim({0})), '^https?://(?:www\\.)?([^/:@?#]+)(?:[/?#]|$)', 1)"
_SHARD = "lower(printf('%02x', list_reduce(list_prepend(0::BIGINT, list_transform(string_split({0}, ''), lambda x: ord(x)::BIGINT)), lambda h, x: (h * 31 + x) & 4294967295) % 256))"
_TS = "CAST('2024-01-15 12:00:00' AS TIMESTAMP)"


#: White space as Python strips it, as a class of RE2 and as characters.
SPACE = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def packing(pieces: str, most: int, joiner: str, width: int, trim_cuts: bool = True) -> str:
    """Greedy packing of the list ``pieces`` of each document."""
    content = f"substring(t, (s * {most} + 1)::BIGINT, {most})"
    content = strip(content) if trim_cuts else content
    return f"""WITH RECURSIVE pieces AS (
            SELECT doc_id, piece, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, length(piece) AS n FROM (
                SELECT doc_id, {strip('p')} AS piece, i FROM (SELECT doc_id, unnest({pieces}) AS p, generate_subscripts({pieces}, 1) AS i FROM documents)) WHERE piece <> ''),
        packed AS (SELECT doc_id, i, 1::BIGINT AS pack, CASE WHEN n > {most} THEN -1 ELSE n END AS used FROM pieces WHERE i = 1
            UNION ALL SELECT p.doc_id, p.i, CASE WHEN k.used >= 0 AND p.n <= {most} AND k.used + {width} + p.n <= {most} THEN k.pack ELSE k.pack + 1 END,
                CASE WHEN k.used >= 0 AND p.n <= {most} AND k.used + {width} + p.n <= {most} THEN k.used + {width} + p.n WHEN p.n > {most} THEN -1 ELSE p.n END
            FROM packed k JOIN pieces p ON p.doc_id = k.doc_id AND p.i = k.i + 1),
        texts AS (SELECT doc_id, pack, string_agg(piece, {joiner} ORDER BY i) AS t FROM packed JOIN pieces USING (doc_id, i) GROUP BY 1, 2),
        cut AS (SELECT doc_id, pack, {content} AS content, s FROM (SELECT doc_id, pack, t, unnest(range(0, (length(t) + {most - 1}) // {most})) AS s FROM texts))
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pack, s) - 1)::INTEGER AS reading_order, content FROM cut WHERE content <> ''"""


def _search(required: bool, terms: int, name: str, scoped: bool = False) -> str:
    """CTEs that end in ``name`` (question_id, chunk_id, doc_id, rank, place)."""
    body_all = "HAVING count(*) = any_value(asked)" if required else ""
    within = "WHERE s.jurisdiction_code = (SELECT any_value(jurisdiction_code) FROM evaluation_cases WHERE item_id = u.question_id)" if scoped else ""
    return f"""
    q_{name} AS (SELECT item_id AS question_id, term, count(*) OVER (PARTITION BY item_id) AS asked FROM qterms WHERE item_id % 20 = 0 AND pos <= {terms}),
    b_{name} AS (SELECT question_id, chunk_id, doc_id, sum(n)::BIGINT AS n FROM (
            SELECT chunk_id, doc_id, term, count(*) AS n FROM (SELECT chunk_id, doc_id, unnest({_WORDS1.format('content')}) AS term FROM c) GROUP BY ALL)
         JOIN q_{name} USING (term) GROUP BY 1, 2, 3 {body_all}),
    shown_{name} AS (SELECT doc_id, title, document_type, jurisdiction_code FROM documents WHERE source_id IN (SELECT source_id FROM source_registry WHERE policy_state = 'approved' AND commercial_display_allowed)),
    t_{name} AS (SELECT question_id, doc_id FROM (SELECT DISTINCT doc_id, unnest({_WORDS1.format("coalesce(title, '')")}) AS term FROM shown_{name}) JOIN q_{name} USING (term)
         GROUP BY 1, 2 {body_all}),
    lead_{name} AS (SELECT chunk_id, doc_id FROM c WHERE coalesce(reading_order, 0) <= 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY reading_order NULLS FIRST, chunk_id) <= 2),
    u_{name} AS (SELECT question_id, chunk_id, doc_id, max(n) AS n FROM (SELECT * FROM b_{name} UNION ALL SELECT question_id, chunk_id, doc_id, 0 FROM t_{name} JOIN lead_{name} USING (doc_id)) GROUP BY 1, 2, 3),
    r_{name} AS (SELECT u.question_id, u.chunk_id, u.doc_id,
            round(0.1::DOUBLE * u.n + CASE WHEN t.doc_id IS NOT NULL THEN 1.5::DOUBLE ELSE 0 END
                  + CASE WHEN lower(coalesce(s.document_type, '')) IN {tuple(T_PRIMARY)} THEN 0.16::DOUBLE ELSE 0 END, 6) AS rank
         FROM u_{name} u JOIN shown_{name} s USING (doc_id) LEFT JOIN t_{name} t ON t.question_id = u.question_id AND t.doc_id = u.doc_id {within}),
    k_{name} AS (SELECT * FROM r_{name} QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY rank DESC, chunk_id) <= 400),
    v_{name} AS (SELECT * FROM k_{name} QUALIFY row_number() OVER (PARTITION BY question_id, doc_id ORDER BY rank DESC, chunk_id) <= 3),
    {name} AS (SELECT question_id, chunk_id, doc_id, rank, row_number() OVER (PARTITION BY question_id ORDER BY rank DESC, chunk_id) AS place FROM v_{name} QUALIFY place <= 24)"""


T_PRIMARY = ("act", "revised_act", "constitution", "code", "primary_legislation")
_POSTINGS = f"""
    w AS (SELECT jurisdiction_code, doc_id, unnest({_WORDS3.format('text')}) AS term, 1 AS b, 0 AS t FROM documents
          UNION ALL SELECT jurisdiction_code, doc_id, unnest({_WORDS3.format("concat_ws(' ', title, citation)")}), 0, 1 FROM documents),
    n AS (SELECT jurisdiction_code, doc_id, term, sum(b) AS b, sum(t) AS t FROM w WHERE NOT list_contains({_list(T.INDEX_STOP)}, term) GROUP BY 1, 2, 3),
    p AS (SELECT jurisdiction_code, term, doc_id, round(ln(1 + b::DOUBLE) + 15 * t, 3) AS weight FROM n
          QUALIFY row_number() OVER (PARTITION BY jurisdiction_code, term ORDER BY weight DESC, doc_id) <= 256),
    postings AS (SELECT p.*, shard FROM p JOIN (SELECT term, {_SHARD.format('term')} AS shard FROM (SELECT DISTINCT term FROM p)) USING (term))"""
_VARIANTS = ",".join(f"('{k}','{f}')" for k, v in T.VARIANTS.items() for f in v)
_GATEWAY = f"""{_POSTINGS},
    g0 AS (SELECT item_id AS question_id, jurisdiction_code, list_distinct_ordered AS ws FROM (
        SELECT item_id, jurisdiction_code, list_filter({_WORDS3.format('query')}, lambda x: NOT list_contains({_list(T.GATEWAY_STOP)}, x)) AS l,
               list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered FROM evaluation_cases WHERE item_id % 20 = 0)),
    g1 AS (SELECT question_id, jurisdiction_code, unnest(ws[1:10]) AS asked FROM g0),
    forms(asked, term) AS (VALUES {_VARIANTS}),
    g2 AS (SELECT question_id, jurisdiction_code, g1.asked, coalesce(forms.term, g1.asked) AS term FROM g1 LEFT JOIN forms ON forms.asked = g1.asked),
    best AS (SELECT question_id, asked, doc_id, max(weight) AS value FROM postings JOIN g2 USING (jurisdiction_code, term) GROUP BY 1, 2, 3),
    df AS (SELECT question_id, asked, count(*) AS df FROM best GROUP BY 1, 2),
    sc AS (SELECT question_id, doc_id, round(sum(value * w) + 10 * sum(w), 6) AS score FROM (
        SELECT best.*, CASE WHEN asked IN ('misconduct','disciplinary','hearing','procedural','admissibility','indemnity','confidentiality') THEN 2.5::DOUBLE ELSE 1::DOUBLE END
               * greatest(1::DOUBLE, ln(1 + 256::DOUBLE / greatest(1, df))) AS w FROM best JOIN df USING (question_id, asked)) GROUP BY 1, 2),
    gateway AS (SELECT question_id, doc_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS place FROM sc QUALIFY place <= 8)"""
_NEAREST = """
    near AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity
             FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q JOIN embeddings v ON q.vec_id <> v.vec_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS place FROM near WHERE similarity IS NOT NULL)"""

_SEARCH = f"WITH {_CHUNKS}, {_QTERMS.strip()}, {_search(False, 4, 'hits').strip()}"

SQL: dict[str, str] = {
    "search_evidence": f"{_SEARCH} SELECT * FROM hits",
    "search_required_terms": f"WITH {_CHUNKS}, {_QTERMS}, {_search(True, 2, 'hits')} SELECT * FROM hits",
    "search_context": f"""{_SEARCH},
        near AS (SELECT h.question_id, h.chunk_id, n.page_number, n.content, n.reading_order, n.chunk_id AS near_id
                 FROM hits h JOIN c o USING (chunk_id) JOIN c n ON n.doc_id = h.doc_id AND n.page_number BETWEEN o.page_number - 1 AND o.page_number + 1
                 QUALIFY row_number() OVER (PARTITION BY h.question_id, h.chunk_id ORDER BY n.page_number, n.reading_order NULLS LAST, n.chunk_id) <= 12),
        ctx AS (SELECT question_id, chunk_id, string_agg('[Source PDF page ' || page_number || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY page_number, reading_order NULLS LAST, near_id) AS context FROM near GROUP BY 1, 2)
        SELECT h.question_id, h.chunk_id, h.doc_id, h.rank, h.place, coalesce(ctx.context, c.content) AS context FROM hits h JOIN c USING (chunk_id) LEFT JOIN ctx ON ctx.question_id = h.question_id AND ctx.chunk_id = h.chunk_id""",
    "search_ladder": f"""WITH {_CHUNKS}, {_QTERMS}, {_search(True, 3, 'h0')}, {_search(True, 2, 'h1')}, {_search(False, 4, 'h2')},
        lists AS (SELECT *, 0 AS list_no FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2)
        SELECT question_id, list_no::BIGINT AS list_no, chunk_id, place FROM lists QUALIFY list_no = min(list_no) OVER (PARTITION BY question_id)""",
    "search_interleaved": f"""WITH {_CHUNKS}, {_QTERMS}, {_search(True, 2, 'h0')}, {_search(False, 4, 'h1')},
        lists AS (SELECT *, 0 AS list_no FROM h0 UNION ALL SELECT *, 1 FROM h1),
        f AS (SELECT question_id, chunk_id, place, list_no FROM lists WHERE place <= 24 QUALIFY row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY place, list_no) = 1)
        SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY place, list_no, chunk_id) AS place FROM f QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY f.place, list_no, chunk_id) <= 32""",
    "posting_build": f"WITH {_POSTINGS} SELECT jurisdiction_code, shard, term, doc_id, weight FROM postings",
    "posting_shard_counts": f"WITH {_POSTINGS} SELECT jurisdiction_code, shard, count(DISTINCT term) AS terms, count(*) AS postings FROM postings GROUP BY 1, 2",
    "gateway_search": f"WITH {_GATEWAY} SELECT * FROM gateway",
    "document_tokens": f"""WITH w AS (SELECT doc_id, unnest({_WORDS3.format('text')}) AS term FROM documents)
        SELECT doc_id, term, count(*) AS n FROM w WHERE length(term) <= 100 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, term) <= 3000""",
    "vector_nearest": f"WITH {_NEAREST} SELECT query_id, vec_id, similarity, place FROM ranked WHERE place <= 10",
    "rank_fusion": f"""WITH {_NEAREST}, top AS (SELECT query_id, vec_id, similarity FROM ranked WHERE place <= 32),
        two AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vec_id) - 1 AS lexical, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) - 1 AS semantic FROM top),
        s AS (SELECT *, round(0.45::DOUBLE / (20 + lexical) + 0.55::DOUBLE / (20 + semantic), 9) AS score FROM two)
        SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lexical) AS place FROM s""",
    "chunk_pack": packing("string_split(text, chr(10))", 2600, "chr(10)", 1),
    "chunk_windows": """WITH t AS (SELECT doc_id AS chunk_id, trim(replace(text, chr(0), '')) AS t FROM documents),
        w AS (SELECT chunk_id, t, unnest(range(0, CASE WHEN length(t) <= 4000 THEN 1 ELSE 1 + ceil((length(t) - 4000) / 3600.0)::BIGINT END)) AS window_no FROM t WHERE t <> '')
        SELECT chunk_id, window_no, window_no * 3600 AS start, substring(t, window_no * 3600 + 1, 4000) AS content FROM w""",
    "markup_strip": f"""WITH {_CHUNKS}
        SELECT chunk_id, array_to_string(list_filter(list_transform(string_split_regex(content, '\\r\\n|[\\n\\r\\x{{0b}}\\x{{0c}}\\x{{1c}}-\\x{{1e}}\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: trim(regexp_replace(x, '{SPACE}+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS content FROM c""",
    "token_estimates": f"WITH {_CHUNKS} SELECT source_id, count(*) AS chunks, sum(greatest(1, length(content) // 4))::BIGINT AS tokens FROM c GROUP BY 1",
    "index_words": f"""WITH w AS (SELECT jurisdiction_code, unnest({_WORDS3.format('text')}) AS term FROM documents)
        SELECT jurisdiction_code, term, count(*) AS n FROM w WHERE NOT list_contains({_list(T.INDEX_STOP)}, term) GROUP BY 1, 2""",
    "shard_prefix": f"""WITH w AS (SELECT jurisdiction_code, unnest({_WORDS3.format('text')}) AS term FROM documents),
        k AS (SELECT jurisdiction_code, term, count(*) AS n FROM w WHERE NOT list_contains({_list(T.INDEX_STOP)}, term) GROUP BY 1, 2)
        SELECT {_SHARD.format('term')} AS shard, count(*) AS terms, sum(n)::BIGINT AS n FROM k GROUP BY 1""",
    "question_plans": f"""WITH {_QTERMS},
        l AS (SELECT item_id, list(term ORDER BY pos) AS ts FROM qterms GROUP BY 1),
        q AS (SELECT item_id, list_transform(ts, lambda t: '"' || t || '"') AS qs, ts FROM l),
        p AS (SELECT item_id, array_to_string(ts, ' ') AS terms, array_to_string(qs[1:3], ' ') AS a, array_to_string(qs[1:2], ' ') AS b, array_to_string(qs[1:4], ' OR ') AS o FROM q)
        SELECT item_id, coalesce(p.terms, '') AS terms,
               CASE WHEN p.terms IS NULL THEN trim(query) ELSE array_to_string(list_filter([a, CASE WHEN b <> a THEN b END, CASE WHEN o <> a AND o <> b THEN o END], lambda x: x IS NOT NULL), ' | ') END AS plans
        FROM evaluation_cases LEFT JOIN p USING (item_id)""",
    "title_languages": """SELECT CASE WHEN regexp_matches(lower(coalesce(title, '')), '^(sheria|kanuni|katiba)\\b') THEN 'sw' ELSE 'en' END AS guess, substring(lower(coalesce(lang, 'und')), 1, 2) AS lang, count(*) AS n FROM documents GROUP BY 1, 2""",
    "citation_candidates": """SELECT citation, count(DISTINCT entry_id) AS entries FROM (
        SELECT entry_id, unnest(regexp_extract_all(concat_ws(' ', target_citation, judgment_citation), '\\[\\d{4}\\]\\s*[A-Z][A-Z0-9]{1,12}\\s*\\d{1,7}\\b')) AS citation FROM citator_entries) GROUP BY 1""",
    "citator_lookup": f"""WITH {_ENTRIES} SELECT a.authority_id, e.treatment, count(*) AS n, min(e.entry_id) AS first_entry FROM authorities a
        JOIN e ON e.jurisdiction = a.jurisdiction_code AND regexp_replace(lower(e.target_citation), '\\s+', '', 'g') = regexp_replace(lower(a.citation), '\\s+', '', 'g')
        WHERE e.status = 'verified' GROUP BY 1, 2""",
    "quote_verify": f"""WITH {_CHUNKS}, {_ENTRIES} SELECT e.entry_id, c.chunk_id IS NOT NULL AS has_passage,
        coalesce({_SQUEEZE.format('e.evidence_quote')} <> '' AND contains({_SQUEEZE.format('c.content')}, {_SQUEEZE.format('e.evidence_quote')}), false) AS quoted
        FROM e LEFT JOIN c ON c.chunk_id = e.source_chunk_id""",
    "latest_chunks": f"WITH {_CHUNKS} SELECT chunk_id, doc_id, reading_order, length(content) AS n_chars FROM c",
    "dedup_hash": f"SELECT {_HASH} AS content_hash, count(*) AS n_docs, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
    "insert_new": f"""WITH {_KEYED} SELECT source_id, external_key, min(doc_id) AS doc_id FROM keyed k WHERE batch_no > 0
        AND NOT EXISTS (SELECT 1 FROM keyed o WHERE o.batch_no = 0 AND o.source_id = k.source_id AND o.external_key = k.external_key) GROUP BY 1, 2""",
    "upsert_actions": f"""WITH {_KEYED}, o AS (SELECT * FROM keyed WHERE batch_no = 0 QUALIFY row_number() OVER (PARTITION BY source_id, external_key ORDER BY doc_id DESC) = 1),
        n AS (SELECT * FROM keyed WHERE batch_no > 0 QUALIFY row_number() OVER (PARTITION BY source_id, external_key ORDER BY batch_no DESC, doc_id DESC) = 1)
        SELECT n.source_id, n.external_key, n.doc_id, CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN o.content_hash = n.content_hash THEN 'unchanged' ELSE 'update' END AS action
        FROM n LEFT JOIN o ON o.source_id = n.source_id AND o.external_key = n.external_key""",
    "replace_chunks": f"""WITH {_CHUNKS} SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY reading_order, chunk_id) - 1 AS reading_order
        FROM c WHERE trim(regexp_replace(content, '\\s+', ' ', 'g')) <> ''""",
    "version_append": f"""WITH k AS (SELECT source_id, {_KEY} AS external_key, doc_id, retrieved_at FROM documents WHERE external_id IS NOT NULL)
        SELECT source_id, external_key, doc_id, row_number() OVER w AS version_no, row_number() OVER w = count(*) OVER (PARTITION BY source_id, external_key) AS is_canonical
        FROM k WINDOW w AS (PARTITION BY source_id, external_key ORDER BY retrieved_at NULLS FIRST, doc_id)""",
    "corpus_overview": """WITH j AS (SELECT jurisdiction_code, count(*) AS n FROM documents GROUP BY 1)
        SELECT (SELECT count(DISTINCT source_id) FROM documents) AS sources, (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT chunk_id) FROM chunks) AS chunks,
               (SELECT count(DISTINCT doc_id) FROM chunks) AS searchable, (SELECT '{' || string_agg('"' || jurisdiction_code || '":' || n, ',' ORDER BY jurisdiction_code) || '}' FROM j) AS by_jurisdiction""",
    "catalogue_reconcile": """WITH i AS (SELECT DISTINCT doc_id FROM chunks WHERE length(trim(content)) > 0),
        s AS (SELECT d.source_id, count(*) AS total, sum((canonical_url IS NOT NULL)::BIGINT)::BIGINT AS downloadable, count(i.doc_id) AS indexed,
              sum((i.doc_id IS NULL AND canonical_url IS NOT NULL)::BIGINT)::BIGINT AS missing, min(CASE WHEN canonical_url IS NULL THEN d.doc_id END) AS first_without_url
              FROM documents d LEFT JOIN i ON i.doc_id = d.doc_id GROUP BY 1)
        SELECT *, missing = 0 AND downloadable = total AS complete FROM s""",
    "missing_documents": "SELECT doc_id, source_id FROM documents WHERE doc_id NOT IN (SELECT source_doc_id FROM citator_entries WHERE source_doc_id IS NOT NULL)",
    "duplicate_urls": """SELECT source_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(canonical_url)), '[?#].*$', ''), '/+$', ''), '^https?://(www\\.)?', 'https://') AS url, count(*) AS n
        FROM documents WHERE canonical_url IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY n DESC, source_id, url LIMIT 30""",
    "url_official": f"""WITH h AS (SELECT source_id, {_HOST.format("base_url || '/'")} AS official FROM source_registry),
        d AS (SELECT source_id, canonical_url, {_HOST.format('canonical_url')} AS host FROM documents)
        SELECT source_id, CASE WHEN canonical_url IS NULL THEN 'none' WHEN host = official OR ends_with(host, '.' || official) THEN 'official' ELSE 'foreign' END AS state, count(*) AS n
        FROM d JOIN h USING (source_id) GROUP BY 1, 2""",
    "status_counts": """SELECT current_status, document_type, count(*) AS n, count(citation) AS cited, sum(strlen(text))::BIGINT AS bytes, round(avg(strlen(text)::DOUBLE), 4) AS mean_bytes FROM documents GROUP BY 1, 2""",
    "capability_gate": """SELECT source_id, CASE WHEN policy_state = 'approved' THEN coalesce(commercial_display_allowed, false) END AS display, CASE WHEN policy_state = 'approved' THEN coalesce(embedding_allowed, false) END AS embedding,
        CASE WHEN policy_state = 'approved' THEN false END AS other,
        policy_state = 'approved' AND coalesce(commercial_display_allowed, false) AND coalesce(bulk_ingestion_allowed, false) AND coalesce(embedding_allowed, false) AND coalesce(sync_enabled, false) AS ingest, count(*) AS n_docs
        FROM documents JOIN source_registry USING (source_id) GROUP BY ALL""",
    "provenance": f"""WITH {_CHUNKS} SELECT doc_id, min(page_number)::BIGINT AS first_page, min(reading_order)::BIGINT AS first_place, max(reading_order)::BIGINT AS last_place,
        round(avg(extraction_confidence::DOUBLE), 6) AS confidence FROM c GROUP BY 1""",
    "record_ids": "SELECT doc_id, sha256(concat_ws(':', jurisdiction_code, external_id)) AS record_id FROM documents WHERE external_id IS NOT NULL",
    "lease_claim": f"""WITH j AS (SELECT event_id AS job_id, event_type AS job_type, event_id % 5 AS s, CASE WHEN event_id % 7 <> 0 THEN ts + INTERVAL 5 MINUTE END AS available_at, ts AS created_at,
            ts + INTERVAL 1 HOUR AS lease, event_id % 4 AS attempts FROM events)
        SELECT job_type, job_id, row_number() OVER (PARTITION BY job_type ORDER BY coalesce(available_at, created_at), created_at, job_id) AS place, attempts + 1 AS attempts,
               epoch({_TS} + INTERVAL 300 SECOND)::BIGINT AS lease_end
        FROM j WHERE (s = 0 AND available_at <= {_TS}) OR (s = 1 AND lease < {_TS}) QUALIFY place <= 10""",
    "retry_backoff": """SELECT event_id AS job_id, CASE WHEN event_id % 3 <> 0 AND event_id % 4 < 3 THEN 'queued' ELSE 'dead_letter' END AS next_status,
        CASE WHEN event_id % 3 <> 0 AND event_id % 4 < 3 THEN least(3600::DOUBLE, 30 * pow(2::DOUBLE, event_id % 4 - 1))::BIGINT END AS delay_seconds FROM events WHERE event_id % 5 = 1""",
    "rate_limit": """SELECT event_id, user_id, in_window FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21600000000 PRECEDING AND 1 PRECEDING) AS in_window FROM events) WHERE in_window >= 2""",
    "monitor_scan": f"""WITH s AS (SELECT source_id FROM source_registry WHERE policy_state = 'approved' AND commercial_display_allowed),
        d AS (SELECT *, {_HASH} AS content_hash FROM documents WHERE source_id IN (SELECT source_id FROM s)),
        m AS (SELECT DISTINCT 'all-' || jurisdiction_code AS monitor_id, jurisdiction_code, NULL AS topic FROM source_registry UNION ALL SELECT DISTINCT 'act-' || jurisdiction_code, jurisdiction_code, 'act' FROM source_registry),
        h AS (SELECT monitor_id, doc_id, content_hash, retrieved_at, batch_no FROM d JOIN m USING (jurisdiction_code)
              WHERE retrieved_at >= TIMESTAMP '2024-06-01' AND (topic IS NULL OR list_contains(regexp_split_to_array(lower(coalesce(title, '')), '[^\\p{{L}}\\p{{N}}]+'), topic))),
        k AS (SELECT * FROM h WHERE batch_no <> 0 QUALIFY row_number() OVER (PARTITION BY monitor_id ORDER BY retrieved_at, doc_id) <= 100)
        SELECT monitor_id, doc_id, count(*) OVER (PARTITION BY monitor_id) AS found, count(*) OVER (PARTITION BY monitor_id) < 100 AS advance FROM k""",
    "event_windows": """SELECT (epoch_us(ts) // 3600000000) * 3600 AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""",
    "event_properties": """WITH k AS (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events WHERE event_type IN ('click', 'view', 'purchase', 'signup')),
        f AS (SELECT event_type, CASE WHEN k >= 0 AND k <= 300000 THEN round(k)::BIGINT END AS k FROM k)
        SELECT event_type, count(*) AS n, count(k) AS with_k, sum(k)::BIGINT AS total_k, max(k) AS most_k FROM f GROUP BY 1""",
    "access_matters": """WITH i AS (SELECT o_orderkey AS item_id, c_nationkey AS org_id, starts_with(o_orderpriority, '1') AS restricted, o_custkey % 50 AS creator FROM orders JOIN customer ON o_custkey = c_custkey),
        m AS (SELECT DISTINCT c_custkey % 50 AS user_id, c_nationkey AS org_id FROM customer),
        g AS (SELECT o_orderkey % 50 AS user_id, o_orderkey AS item_id FROM orders WHERE o_orderstatus = 'F')
        SELECT user_id, count(*) AS n_items, min(item_id) AS first_item, max(item_id) AS last_item FROM i JOIN m USING (org_id) LEFT JOIN (SELECT *, true AS granted FROM g) g USING (user_id, item_id)
        WHERE NOT restricted OR creator = user_id OR granted GROUP BY 1""",
    "workflow_edges": """SELECT l_orderkey, source, target FROM (SELECT l_orderkey, l_linenumber::BIGINT AS source, lead(l_linenumber::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS target FROM lineitem) WHERE target IS NOT NULL""",
    "table_text": """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, array_to_string(list_filter([l_returnflag, l_linestatus, l_partkey::VARCHAR], lambda x: trim(x) <> ''), chr(9)) AS line FROM lineitem)
        SELECT l_orderkey, string_agg(line, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS content FROM r GROUP BY 1""",
    "jurisdiction_levels": """WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
        t AS (SELECT 'r' || r_regionkey AS node, 0::BIGINT AS level FROM region UNION ALL SELECT e.node, t.level + 1 FROM e JOIN t ON e.parent = t.node) SELECT level, count(*) AS nodes FROM t GROUP BY 1""",
    "organization_list": """WITH o AS (SELECT o_custkey, count(*) AS matters, sum((o_orderstatus = 'F')::BIGINT)::BIGINT AS done FROM orders GROUP BY 1)
        SELECT c_custkey, c_name, n_name, coalesce(matters, 0) AS matters, round(coalesce(done, 0)::DOUBLE / greatest(1, coalesce(matters, 0)), 6) AS progress FROM customer LEFT JOIN o ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "page_offset": "SELECT doc_id, title, source_id FROM documents ORDER BY source_id, doc_id LIMIT 200 OFFSET 100",
    "newest_generations": """SELECT source_id, batch_no::BIGINT AS batch_no, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars, row_number() OVER (PARTITION BY source_id ORDER BY batch_no DESC) AS age
        FROM documents GROUP BY source_id, documents.batch_no QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY documents.batch_no DESC) <= 3""",
}

_TERM_FORMS = ",".join(f"('{k}','{f}')" for k, v in T.VARIANTS.items() for f in v)
SQL["gateway_passages"] = f"""WITH {_GATEWAY.strip()}, {_CHUNKS},
    n0 AS (SELECT chunk_id, doc_id, content, row_number() OVER (PARTITION BY doc_id ORDER BY reading_order NULLS FIRST, chunk_id) AS at_no FROM c WHERE doc_id IN (SELECT doc_id FROM gateway)),
    r0 AS (SELECT g.question_id, n0.*, g1.asked, coalesce(forms.term, g1.asked) AS term FROM gateway g JOIN n0 USING (doc_id) JOIN g1 USING (question_id) LEFT JOIN forms ON forms.asked = g1.asked),
    c0 AS (SELECT question_id, doc_id, chunk_id, at_no, asked, max((length(lower(content)) - length(replace(lower(content), term, ''))) // length(term)) AS k,
           any_value(regexp_matches(content, '(?i)arrangement\\s+of\\s+sections|table\\s+of\\s+contents')) AS contents FROM r0 GROUP BY ALL),
    s0 AS (SELECT question_id, doc_id, chunk_id, at_no, round(sum(CASE WHEN k > 0 THEN
               CASE WHEN asked IN ('misconduct','disciplinary','hearing','procedural','admissibility','indemnity','confidentiality') THEN 2.5::DOUBLE ELSE 1::DOUBLE END * (1 + 0.15::DOUBLE * least(3, k - 1)) ELSE 0::DOUBLE END)
               * CASE WHEN any_value(contents) THEN 0.25::DOUBLE ELSE 1::DOUBLE END, 6) AS score FROM c0 GROUP BY 1, 2, 3, 4),
    p0 AS (SELECT * FROM s0 WHERE score > 0),
    k0 AS (SELECT * FROM p0 a WHERE NOT EXISTS (SELECT 1 FROM p0 b WHERE b.question_id = a.question_id AND b.doc_id = a.doc_id AND abs(b.at_no - a.at_no) <= 2
           AND (b.score > a.score OR (b.score = a.score AND b.at_no < a.at_no))))
    SELECT question_id, doc_id, chunk_id, score AS passage_score, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY score DESC, at_no) AS passage_place FROM k0 QUALIFY passage_place <= 3"""
