"""DuckDB SQL of the queries that SQL can express on whole tables."""

CHAT = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    length('<turn ' || replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g') || '>'
      || replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g') || '</turn>' || chr(10)) AS len
  FROM rows_
), costed AS (
  SELECT *, pos = 1 AND role = 'system' AS is_sys, CAST(ceil(len / 4.0) AS BIGINT) AS whole FROM placed
), headed AS (
  SELECT *, CASE WHEN is_sys THEN 0 ELSE whole END AS cost,
    greatest((512 - max(CASE WHEN is_sys THEN whole ELSE 0 END) OVER (PARTITION BY conv_id)) / 2.0, 0.5) AS unit FROM costed
), summed AS (
  SELECT *, sum(cost) OVER upto - cost AS from_, sum(CASE WHEN cost > unit THEN 1 ELSE 0 END) OVER upto AS bigs
  FROM headed WINDOW upto AS (PARTITION BY conv_id ORDER BY pos)
), cut AS (
  SELECT *, CASE WHEN cost > unit THEN [bigs * 2 - 1, 0] ELSE [bigs * 2, floor(from_ / unit)] END AS w FROM summed
), spans AS (
  SELECT conv_id, w, max(from_ + cost) AS end_ FROM cut GROUP BY conv_id, w
), used AS (
  SELECT c.*, s.end_, c.w < max(c.w) OVER (PARTITION BY c.conv_id) AS goes_on FROM cut c JOIN spans s ON s.conv_id = c.conv_id AND s.w = c.w
), windows_ AS (
  SELECT conv_id, count(*) AS n FROM spans GROUP BY conv_id
)
SELECT u.conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(len) + coalesce(sum(len) FILTER (WHERE goes_on AND NOT is_sys AND end_ - from_ <= 128), 0)
    + coalesce(sum(len) FILTER (WHERE is_sys), 0) * (any_value(w.n) - 1) AS BIGINT) AS formatted_chars
FROM used u JOIN windows_ w ON w.conv_id = u.conv_id GROUP BY u.conv_id
"""

ORACLE = {"op8_chat_format": CHAT}
