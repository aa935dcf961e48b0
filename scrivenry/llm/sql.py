"""The same results in SQL, where SQL can say them and is fast enough on whole tables."""

_LINES = """
lines AS (SELECT DISTINCT chunk_id, doc_id, source_id, reading_order, line_no, line,
                 regexp_replace(lower(line), '[^\\p{L}]+', '', 'g') AS letters
          FROM (SELECT chunk_id, doc_id, source_id, reading_order, unnest(string_split(content, chr(10))) AS line,
                       unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no
                FROM chunks)),
sizes AS (SELECT source_id, count(DISTINCT doc_id) AS source_docs FROM chunks WHERE source_id IS NOT NULL GROUP BY 1),
site AS (SELECT source_id, letters, count(DISTINCT doc_id) AS n_docs, any_value(source_docs) AS source_docs
         FROM lines JOIN sizes USING (source_id)
         WHERE length(letters) >= 20 GROUP BY 1, 2
         HAVING count(DISTINCT doc_id) >= 4 AND count(DISTINCT doc_id) * 1000 >= any_value(source_docs) * 70)
"""

SQL: dict[str, str] = {
    "p5_found": f"WITH {_LINES} SELECT DISTINCT chunk_id, line_no FROM lines JOIN site USING (source_id, letters)",
    "p5_lines": f"WITH {_LINES} SELECT source_id, letters, n_docs, source_docs FROM site",
    "p5_clean": f"""WITH {_LINES},
        marked AS (SELECT lines.*, site.letters IS NOT NULL AS is_site FROM lines LEFT JOIN site USING (source_id, letters))
        SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY reading_order, chunk_id, line_no) FILTER (WHERE NOT is_site), '') AS text,
               count(*) FILTER (WHERE is_site) AS n_removed
        FROM marked GROUP BY doc_id""",
}
