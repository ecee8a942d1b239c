"""Common table expressions shared by the oracle SQL."""

TRIM = r"'^\s+|\s+$', '', 'g'"

PARTS = rf"""
parts_raw AS (
  SELECT doc_id, lang, source, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents),
parts AS (
  SELECT doc_id, lang, source,
    list_filter(list_transform(regexp_split_to_array(t, '\n{{2,}}'), lambda x: regexp_replace(x, {TRIM})), lambda x: x <> '') AS para,
    list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, {TRIM})), lambda x: x <> '') AS lines
  FROM parts_raw),
chosen AS (SELECT doc_id, lang, source, CASE WHEN len(para) > 1 THEN para ELSE lines END AS p FROM parts),
blocks AS (
  SELECT doc_id, lang, source, CAST(reading_order AS INTEGER) AS reading_order, text,
    'b' || CASE WHEN length(CAST(reading_order AS VARCHAR)) < 4 THEN lpad(CAST(reading_order AS VARCHAR), 4, '0') ELSE CAST(reading_order AS VARCHAR) END
      || '-' || substr(sha1('1:' || reading_order || ':' || text), 1, 8) AS block_id
  FROM (SELECT doc_id, lang, source, unnest(p) AS text, generate_subscripts(p, 1) AS reading_order FROM chosen))
"""
