"""DuckDB SQL of the core queries, over views named like the tables."""

from __future__ import annotations

_REFERENCES = """
refs AS (
  SELECT 'source_documents' AS parent_table, document_id AS ref_id, 'evidence' AS table_name, evidence_id AS record_id, 'document_id' AS ref_field, provenance.extracted_at AS stamp
  FROM evidence WHERE document_id IS NOT NULL
  UNION ALL
  SELECT CASE from_ref.record_type WHEN 'document' THEN 'source_documents' WHEN 'evidence' THEN 'evidence' END, from_ref.record_id, 'relation', relation_id, 'from_ref', provenance.generated_at
  FROM relation WHERE from_ref.record_id IS NOT NULL
  UNION ALL
  SELECT CASE to_ref.record_type WHEN 'document' THEN 'source_documents' WHEN 'evidence' THEN 'evidence' END, to_ref.record_id, 'relation', relation_id, 'to_ref', provenance.generated_at
  FROM relation WHERE to_ref.record_id IS NOT NULL
  UNION ALL
  SELECT 'evidence', key, 'search_units', search_unit_id, 'source_evidence_ids', stamp
  FROM (SELECT search_unit_id, unnest(source_evidence_ids) AS key, provenance.generated_at AS stamp FROM search_units) WHERE key IS NOT NULL
),
live AS (
  SELECT 'source_documents' AS parent_table, document_id AS ref_id FROM source_documents WHERE deleted_at IS NULL
  UNION SELECT 'evidence', evidence_id FROM evidence WHERE deleted_at IS NULL
),
bad AS (
  SELECT table_name, record_id, ref_field, refs.ref_id, refs.parent_table,
    min(CASE WHEN regexp_full_match(stamp, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?(Z|[+-]\\d{2}:\\d{2})')
      THEN strftime(try_cast(stamp AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m') END) AS period
  FROM refs WHERE NOT EXISTS (SELECT 1 FROM live WHERE live.parent_table = refs.parent_table AND live.ref_id = refs.ref_id)
  GROUP BY ALL
)
"""

_PLACED = """
nodes AS (
  SELECT document_id, evidence_id, min(parent_evidence_id) AS parent FROM evidence
  WHERE evidence_id IS NOT NULL GROUP BY document_id, evidence_id
),
linked AS (
  SELECT n.document_id, n.evidence_id, p.evidence_id AS parent
  FROM nodes n LEFT JOIN nodes p ON p.document_id = n.document_id AND p.evidence_id = n.parent
),
placed AS (
  SELECT document_id, evidence_id, evidence_id AS root_id, 0 AS depth, [evidence_id] AS path FROM linked WHERE parent IS NULL
  UNION ALL
  SELECT l.document_id, l.evidence_id, p.root_id, p.depth + 1, list_append(p.path, l.evidence_id)
  FROM linked l JOIN placed p ON p.document_id = l.document_id AND p.evidence_id = l.parent
),
lost AS (
  SELECT * FROM linked l WHERE NOT EXISTS (SELECT 1 FROM placed p WHERE p.document_id IS NOT DISTINCT FROM l.document_id AND p.evidence_id = l.evidence_id)
),
climb AS (
  SELECT document_id, evidence_id AS start, parent AS cur, [evidence_id] AS seen FROM lost
  UNION ALL
  SELECT c.document_id, c.start, l.parent, list_append(c.seen, c.cur)
  FROM climb c JOIN lost l ON l.document_id = c.document_id AND l.evidence_id = c.cur WHERE NOT list_contains(c.seen, c.cur)
),
caught AS (
  SELECT document_id, start AS evidence_id, list_min(list_slice(seen, list_position(seen, cur), len(seen))) AS root_id FROM climb WHERE list_contains(seen, cur)
)
"""

SQL = {
    "p4_found": f"WITH {_REFERENCES} SELECT DISTINCT table_name, record_id, ref_field, ref_id FROM bad",
    "p4_report": f"""WITH {_REFERENCES} SELECT table_name, ref_field, coalesce(period, 'unknown') AS month,
  count(*) AS n_references, count(DISTINCT ref_id) AS n_keys FROM bad GROUP BY ALL""",
    "p6_found": f"""WITH RECURSIVE {_PLACED}
SELECT evidence_id, root_id, CAST(depth AS INTEGER) AS depth FROM placed WHERE depth >= 8
UNION ALL SELECT evidence_id, root_id, -1 FROM caught""",
    "p6_hierarchy": f"""WITH RECURSIVE {_PLACED},
below AS (SELECT document_id, evidence_id, count(*) AS n FROM (SELECT document_id, unnest(list_slice(path, 1, len(path) - 1)) AS evidence_id FROM placed) GROUP BY ALL)
SELECT p.document_id, p.evidence_id, p.root_id, CAST(p.depth AS INTEGER) AS depth, array_to_string(p.path, '/') AS path, CAST(coalesce(b.n, 0) AS BIGINT) AS n_descendants
FROM placed p LEFT JOIN below b ON b.document_id = p.document_id AND b.evidence_id = p.evidence_id
UNION ALL SELECT document_id, evidence_id, root_id, -1, NULL, 0 FROM caught""",
    "p6_descendants": f"""WITH RECURSIVE {_PLACED}
SELECT document_id, ancestor_id, evidence_id AS descendant_id, CAST(depth - pos + 1 AS INTEGER) AS distance
FROM (SELECT document_id, evidence_id, depth, unnest(list_slice(path, 1, len(path) - 1)) AS ancestor_id, unnest(range(1, len(path))) AS pos FROM placed WHERE depth > 0)""",
}
