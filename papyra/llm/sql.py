"""SQL that DuckDB can run for the same results, where SQL can express them."""

_PAIRS = """
SELECT DISTINCT '{t}' AS collection, a.id AS id_a, b.id AS id_b
FROM (SELECT id, embedding FROM {t} WHERE len(embedding) = 64 AND NOT list_has_any(embedding, ['nan'::FLOAT]) AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0) a
JOIN (SELECT id, embedding FROM {t} WHERE len(embedding) = 64 AND NOT list_has_any(embedding, ['nan'::FLOAT]) AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0) b
ON a.id < b.id AND list_cosine_similarity(a.embedding, b.embedding) >= 0.9
"""

SQL: dict[str, str] = {
    "p6_found": _PAIRS.format(t="chunk_embeddings") + " UNION ALL " + _PAIRS.format(t="document_embeddings"),
    "p3_found": "SELECT DISTINCT id FROM chunk_embeddings WHERE length(text) > 1000",
    "p9_found": r"""
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
     e AS (SELECT item_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM eval_items WHERE text IS NOT NULL),
     dg AS (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12),
     eg AS (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e WHERE len(w) >= 12),
     g AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS k FROM eg)
SELECT DISTINCT doc_id, item_id FROM dg JOIN g ON array_to_string(dg.w[dg.i:dg.i + 11], ' ') = g.k
""",
}
