"""Queries of the records that don't fit their layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow.operators import parse_errors as P
from weirflow.plans.registry import Registry
from weirflow.sources.tables import table

R = Registry()

_COMMA, _TAB = (rf'(?:"(?:[^"]|"")*"|[^"{d}][^{d}]*|)' for d in (",", "\t"))

_PARSED = f"""
WITH rec AS (
  SELECT r.row_id, r.layout_id, l.column_count, l.column_types, l.column_names, l.delimiter AS d,
         regexp_replace(regexp_replace(coalesce(raw, ''), '^﻿', ''), '\\r$', '') AS t
  FROM delimited_rows r JOIN table_layout l USING (layout_id) WHERE r.row_no >= l.data_start_row
), parsed AS (
  SELECT *,
    CASE d WHEN ',' THEN regexp_full_match(t || d, '(?:{_COMMA},)*', 's') ELSE regexp_full_match(t || d, '(?:{_TAB}\t)*', 's') END AS quoted_well,
    CASE d WHEN ',' THEN regexp_extract_all(t || d, '({_COMMA}),', 1, 's') ELSE regexp_extract_all(t || d, '({_TAB})\t', 1, 's') END AS parts
  FROM rec
), cells AS (
  SELECT row_id, layout_id, column_count, column_types, column_names, quoted_well,
    list_transform(parts, lambda v: CASE WHEN v[1] = '"' THEN replace(v[2:-2], '""', '"') ELSE v END) AS cells
  FROM parsed
), flat AS (
  SELECT row_id, layout_id, unnest(range(len(cells))) AS col, unnest(cells) AS value, unnest(column_types) AS kind, unnest(column_names) AS column_name
  FROM cells WHERE quoted_well AND len(cells) = column_count
), judged AS (
  SELECT *, CASE WHEN trim(value, ' ') = '' OR kind = 'string' THEN true
    WHEN kind = 'int' THEN regexp_full_match(trim(value, ' '), '[+-]?[0-9]+') AND try_cast(trim(value, ' ') AS INTEGER) IS NOT NULL
    WHEN kind = 'decimal' THEN regexp_full_match(trim(value, ' '), '[+-]?[0-9]+([.][0-9]+)?')
    WHEN kind = 'date' THEN regexp_full_match(trim(value, ' '), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast(trim(value, ' ') AS DATE) IS NOT NULL
    WHEN kind = 'timestamp' THEN regexp_full_match(trim(value, ' '), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z?') AND try_cast(trim(value, ' ')[:10] AS DATE) IS NOT NULL
    WHEN kind = 'boolean' THEN lower(trim(value, ' ')) IN ('true', 'false') ELSE false END AS good
  FROM flat
)"""

_FOUND = (
    _PARSED
    + """, found AS (
  SELECT row_id, 'quoting' AS reason FROM cells WHERE NOT quoted_well
  UNION ALL SELECT row_id, 'column_count' FROM cells WHERE quoted_well AND len(cells) <> column_count
  UNION ALL SELECT DISTINCT row_id, 'invalid_value' FROM judged WHERE NOT good
)"""
)


@R.add("p1_found", _FOUND + " SELECT row_id, reason FROM found")
def p1_found(spark, sf_dir):
    return P.failures(table(spark, sf_dir, "delimited_rows"), table(spark, sf_dir, "table_layout")).select("row_id", "reason")


@R.add(
    "p1_typed_cells",
    _FOUND
    + """ SELECT row_id, col, column_name, value,
  CASE WHEN kind = 'int' THEN try_cast(trim(value, ' ') AS INTEGER) END AS int_value,
  CASE WHEN kind = 'decimal' THEN try_cast(trim(value, ' ') AS DECIMAL(38, 12)) END AS decimal_value,
  CASE WHEN kind = 'timestamp' THEN try_cast(replace(trim(value, ' ')[:19], 'T', ' ') AS TIMESTAMP) END AS timestamp_value,
  CASE WHEN kind = 'date' THEN try_cast(trim(value, ' ') AS DATE) END AS date_value,
  CASE WHEN kind = 'boolean' AND trim(value, ' ') <> '' THEN lower(trim(value, ' ')) = 'true' END AS boolean_value
FROM judged WHERE row_id NOT IN (SELECT row_id FROM found)""",
)
def p1_typed_cells(spark, sf_dir):
    t = P.typed_cells(table(spark, sf_dir, "delimited_rows"), table(spark, sf_dir, "table_layout"))
    return t.select("row_id", F.col("col").cast("long").alias("col"), "column_name", "value", "int_value", "decimal_value", "timestamp_value", "date_value", "boolean_value")


@R.add(
    "p1_reason_report",
    _FOUND
    + """ SELECT r.layout_id, f.reason, count(*) AS records, count(DISTINCT r.export_id) AS exports
FROM found f JOIN delimited_rows r USING (row_id) GROUP BY ALL""",
)
def p1_reason_report(spark, sf_dir):
    rows, layouts = table(spark, sf_dir, "delimited_rows"), table(spark, sf_dir, "table_layout")
    f = P.failures(rows, layouts).select("row_id", "reason")
    per = f.join(rows.select("row_id", "layout_id", "export_id"), "row_id").groupBy("layout_id", "reason", "export_id").agg(F.count("*").alias("n"))
    return per.groupBy("layout_id", "reason").agg(F.sum("n").alias("records"), F.count("*").alias("exports"))


_WIDTHS = f"""
WITH once AS (SELECT DISTINCT export_id, layout_id, row_no, raw FROM delimited_rows),
rec AS (SELECT export_id, row_no, delimiter AS d, regexp_replace(regexp_replace(coalesce(raw, ''), '^﻿', ''), '\\r$', '') AS t FROM once JOIN table_layout USING (layout_id)),
w AS (SELECT export_id, row_no, CASE WHEN d = ',' AND regexp_full_match(t || d, '(?:{_COMMA},)*', 's') THEN len(regexp_extract_all(t || d, '({_COMMA}),', 1, 's'))
  WHEN d <> ',' AND regexp_full_match(t || d, '(?:{_TAB}\t)*', 's') THEN len(regexp_extract_all(t || d, '({_TAB})\t', 1, 's')) ELSE 0 END AS width FROM rec)"""


@R.add(
    "scan_table_regions",
    _WIDTHS
    + """, per AS (SELECT export_id, width, count(*) AS n, min(row_no) AS first FROM w GROUP BY ALL),
 m AS (SELECT *, row_number() OVER (PARTITION BY export_id ORDER BY CASE WHEN width > 0 THEN n ELSE 0 END DESC, width DESC) AS place, count(*) OVER (PARTITION BY export_id) AS widths FROM per)
SELECT m.export_id, m.width, CASE WHEN m.width > 0 THEN m.n ELSE 0 END AS rows, (SELECT count(*) FROM w WHERE w.export_id = m.export_id AND w.row_no < m.first) AS preamble, m.widths = 1 AND m.width > 1 AS strict FROM m WHERE place = 1""",
)
def scan_table_regions(spark, sf_dir):
    """Where the table of each export begins, and whether all of its rows fit it."""
    return P.regions(table(spark, sf_dir, "delimited_rows"), table(spark, sf_dir, "table_layout"))
