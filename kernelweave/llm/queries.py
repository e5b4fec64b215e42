"""The queries of this subpackage by name, and the SQL that states their results."""

from __future__ import annotations

from . import byte_bpe, curve_search, decontaminate, jaccard, language, licenses, quality, secrets, sharding, toxicity

QUERIES = {
    "op1_curve_search": curve_search.op1_curve_search,
    "op2_jaccard": jaccard.op2_jaccard,
    "op4_byte_bpe": byte_bpe.op4_byte_bpe,
    "op3_language": language.op3_language,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_shards": sharding.op6_shards,
    "op7_licenses": licenses.op7_licenses,
    "op8_quality": quality.op8_quality,
    "op9_secrets": secrets.op9_secrets,
    "op10_toxicity": toxicity.op10_toxicity,
}

#: Every two sets that share a shingle are compared, and links are followed as far as they go.
JACCARD = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS g FROM d
), n AS (SELECT doc_id, len(g) AS n FROM s), u AS (SELECT doc_id, unnest(g) AS h FROM s), p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
    SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), reach AS (
    SELECT doc_id, doc_id AS seen FROM n UNION SELECT r.doc_id, x.b FROM reach r JOIN ways x ON x.a = r.seen
)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(seen) AS component_id FROM n JOIN reach ON reach.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""
ORACLES: dict[str, str] = {"op2_jaccard": JACCARD}
