"""Queries of this package over the driver's tables."""

from __future__ import annotations

from lodestone.llm import chat, language, licenses, media, near_dedup, packing, quality, search, sentencepiece_backend, toxicity


def queries() -> dict:
    return {
        "op1_bayesian_language": language.op1_bayesian_language,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_sentencepiece": sentencepiece_backend.op3_sentencepiece,
        "op4_subword_quality": quality.op4_subword_quality,
        "op5_telephony_audio": media.op5_telephony_audio,
        "op6_segment_topk": search.op6_segment_topk,
        "op7_chosen_path": near_dedup.op7_chosen_path,
        "op8_convolutional_toxicity": toxicity.op8_convolutional_toxicity,
        "op9_budgeted_windows": chat.op9_budgeted_windows,
        "op10_license_paragraphs": licenses.op10_license_paragraphs,
    }


#: Integer inner products, all rows against all but themselves.
TOPK_SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.i, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.i <> c.i AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id) <= 5
"""

#: Shingles as texts, all pairs that share one, and the closure of the links.
NEAR_SQL = """
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS c FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.c, d.doc_id)) AS component_id, coalesce(m.c, d.doc_id) >= d.doc_id AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can express a query; the others are tested against brute force, round trips or held-out rows."""
    return {"op6_segment_topk": TOPK_SQL, "op7_chosen_path": NEAR_SQL}
