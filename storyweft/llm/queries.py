"""The corpus operators' named queries and their SQL, where SQL can express them."""

from __future__ import annotations

from storyweft.llm import decontam, langid, lines, media, mixing, neardup, negatives, ngramlm, packing, quality, tokenfiles, topk, turns

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_mixing": mixing.op2_mixing,
    "op3_token_files": tokenfiles.op3_token_files,
    "op4_near_duplicates": neardup.op4_near_duplicates,
    "op5_media": media.op5_media,
    "op6_topk": topk.op6_topk,
    "op7_quality": quality.op7_quality,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_packing": packing.op9_packing,
    "op10_lm_scoring": ngramlm.op10_lm_scoring,
    "op11_decontamination": decontam.op11_decontamination,
    "op12_conversation_repair": turns.op12_conversation_repair,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}

OP4_SQL = r"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM word
), own AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS digest FROM shingle GROUP BY doc_id
), class AS (
  SELECT digest, min(doc_id) AS rep, any_value(n) AS n FROM own GROUP BY digest
), met AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM (SELECT * FROM shingle SEMI JOIN class ON doc_id = rep) x
  JOIN (SELECT * FROM shingle SEMI JOIN class ON doc_id = rep) y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM met JOIN class p ON p.rep = a JOIN class q ON q.rep = b WHERE 100 * i >= 85 * (p.n + q.n - i)
), edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(id, c) AS (
  SELECT rep, rep FROM class UNION SELECT edge.b, reach.c FROM reach JOIN edge ON edge.a = reach.id WHERE reach.c < edge.b
), least AS (SELECT id, min(c) AS c FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(own.n, 0) AS n_shingles, coalesce(least.c, d.doc_id) AS component_id, coalesce(least.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN own USING (doc_id) LEFT JOIN class USING (digest) LEFT JOIN least ON least.id = class.rep
"""

ORACLE = {
    "op4_near_duplicates": OP4_SQL,
    "op6_topk": topk.OP6_SQL,
    "op8_line_dedup": lines.OP8_SQL,
    "op11_decontamination": decontam.OP11_SQL,
    "op12_conversation_repair": turns.OP12_SQL,
    "op13_hard_negatives": negatives.OP13_SQL,
}
