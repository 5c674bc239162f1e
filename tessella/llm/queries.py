"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from tessella.llm import decontamination, html_extraction, language_id, license_scan, lm_score, near_dup, packing, pii, quality, substring_dedup

QUERIES = {
    "op1_html_extraction": html_extraction.query,
    "op2_decontamination": decontamination.query,
    "op3_near_dup": near_dup.query,
    "op4_pii": pii.query,
    "op5_license_scan": license_scan.query,
    "op6_packing": packing.query,
    "op7_quality": quality.query,
    "op8_language_id": language_id.query,
    "op9_lm_score": lm_score.query,
    "op10_substring_dedup": substring_dedup.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) size, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) t(i) WHERE len(w) > 0),
s AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS win FROM d, s, unnest(range(1, len(w) - size + 2)) t(i) WHERE len(w) >= size),
m AS (SELECT doc_id, i, size, item_id FROM dw JOIN iw USING (win, size)),
h AS (SELECT doc_id, count(DISTINCT i + j) n_hit FROM m, unnest(range(0, size)) t(j) GROUP BY 1),
it AS (SELECT doc_id, count(*) n_items, string_agg(item_id, ',' ORDER BY item_id) ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR item_id FROM m) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op10_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
p AS (SELECT doc_id, i, w[i] word, CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i : i + 19], ' ') END AS win FROM d, unnest(range(1, len(w) + 1)) t(i)),
r AS (SELECT doc_id, i FROM p WHERE win IS NOT NULL QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1),
c AS (SELECT DISTINCT doc_id, i + j AS i, true AS gone FROM r, unnest(range(0, 20)) t(j)),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) FILTER (gone IS NULL) kept, count(gone) n_removed FROM p LEFT JOIN c USING (doc_id, i) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
}
