"""DuckDB SQL for the queries of this subpackage that SQL can express."""

SQL: dict[str, str] = {}

SQL["p2_found"] = r"""
WITH lines AS (
  SELECT p.id AS page_id, p.document_id AS file, f.publisher,
         unnest(string_split(p.raw_text, chr(10))) AS line,
         generate_subscripts(string_split(p.raw_text, chr(10)), 1) AS line_no
  FROM pages p JOIN (SELECT DISTINCT id, publisher FROM document_files WHERE publisher IS NOT NULL) f ON p.document_id = f.id
), keyed AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(line), '^[^\pL\p{Nd}]+', ''), '[^\pL\p{Nd}]+$', ''), '\p{Nd}+', '0', 'g'), '[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+', ' ', 'g') AS k
  FROM lines
), total AS (
  SELECT publisher, count(DISTINCT id) AS n FROM document_files WHERE publisher IS NOT NULL GROUP BY 1
), high AS (
  SELECT k.publisher, k.k FROM keyed k JOIN total t USING (publisher)
  WHERE length(regexp_replace(k.k, '\PL+', '', 'g')) >= 12
  GROUP BY 1, 2 HAVING count(DISTINCT k.file) >= 4 AND count(DISTINCT k.file) >= 0.3 * any_value(t.n)
)
SELECT DISTINCT page_id, line_no::INT AS line_no FROM keyed JOIN high USING (publisher, k)
"""

SQL["p5_found"] = r"""
WITH RECURSIVE links AS (
  SELECT DISTINCT least(fact_a_id, fact_b_id) AS a, greatest(fact_a_id, fact_b_id) AS b FROM relationships
  WHERE lower(trim(relationship_type, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) = 'corroborates' AND fact_a_id <> fact_b_id
    AND fact_a_id IN (SELECT id FROM facts) AND fact_b_id IN (SELECT id FROM facts)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(v, w) AS (
  SELECT a, a FROM both_ways
  UNION
  SELECT r.v, e.b FROM reach r JOIN both_ways e ON r.w = e.a
)
SELECT v AS fact_id, min(w) AS group_id FROM reach GROUP BY 1
"""

SQL["p1_found"] = r"""
WITH big AS (SELECT id, block_ids_json FROM chunks WHERE length(text) // 4 > 800),
ids AS (SELECT DISTINCT id, unnest(from_json(block_ids_json, '["VARCHAR"]')) AS block_id FROM big WHERE json_valid(block_ids_json)),
inner_blocks AS (SELECT i.id, i.block_id FROM ids i JOIN blocks b ON b.id = i.block_id WHERE length(b.text) // 4 > 800)
SELECT DISTINCT b.id AS chunk_id, coalesce(i.block_id, '') AS block_id FROM big b LEFT JOIN inner_blocks i ON i.id = b.id
"""
