"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from . import binary, decontamination, fingerprints, html, jaccard, langid, mixing, quality, sharding, tokens
from .base import load

QUERIES = {
    "op1_mixing": lambda spark, sf: mixing.op1(load(spark, sf, "documents")),
    "op2_token_counts": lambda spark, sf: tokens.op2(load(spark, sf, "documents")),
    "op3_quality": lambda spark, sf: quality.op3(load(spark, sf, "documents"), load(spark, sf, "labels")),
    "op4_html": lambda spark, sf: html.op4(load(spark, sf, "pages")),
    "op5_decontamination": lambda spark, sf: decontamination.op5(load(spark, sf, "documents"), load(spark, sf, "benchmark")),
    "op6_language": lambda spark, sf: langid.op6(load(spark, sf, "pages"), load(spark, sf, "documents")),
    "op7_jaccard": lambda spark, sf: jaccard.op7(load(spark, sf, "documents")),
    "op8_fingerprints": lambda spark, sf: fingerprints.op8(load(spark, sf, "documents")),
    "op9_token_ids": lambda spark, sf: binary.op9(load(spark, sf, "documents")),
    "op10_sharding": lambda spark, sf: sharding.op10(load(spark, sf, "documents")),
}
#: The join by all pairs that share a shingle, and components by the closure of their links: right, but only for small tables.
JACCARD = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS grams FROM words),
sizes AS (SELECT doc_id, len(grams)::BIGINT AS n FROM sets),
cells AS (SELECT doc_id, n, unnest(grams) AS gram FROM sets JOIN sizes USING (doc_id)),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM cells a JOIN cells b ON a.gram = b.gram AND a.doc_id <> b.doc_id AND a.n * 100 >= b.n * 90 AND b.n * 100 >= a.n * 90
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT doc_id, n AS n_shingles, component_id FROM sizes JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)"""

ORACLE: dict[str, str] = {"op7_jaccard": JACCARD}
