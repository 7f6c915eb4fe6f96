"""Delimited records: typed cells of those that fit their layout, and the others with the reason why they don't.

Every record is exploded into (row, column, value); the layouts, exploded into one rule per column, are joined to the cells; rules are
evaluated; only failing cells are shuffled, to be aggregated per record; clean rows are those without a failure, by anti-join.

The cell grammar runs in the JVM as possessive regular expressions, which neither backtrack nor recurse, so a record of any length is
parsed in one pass.

Defined cases: a null record counts as an empty one (one empty cell). Rows above the layout's data_start_row are titles and appear in no
result. A record whose layout is unknown fails with ``no_layout``. Empty cells, and cells of blanks only, load as null, of strings as they are. Repeated rows keep their own
row_id. Empty tables give empty results. Extra columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.session import bounded_broadcast

REASONS = ("quoting", "column_count", "invalid_value")

_CELL = r'(?:"(?:[^"]++|"")*+"|[^"{d}][^{d}]*+|)'


def _grammar(delimiter: Column, template: str) -> Column:
    """template with {c} for a cell and {d} for the delimiter, as a pattern made of the row's own delimiter."""
    quoted = F.concat(F.lit(r"\Q"), delimiter, F.lit(r"\E"))
    parts = template.replace("{c}", _CELL).split("{d}")
    out = [F.lit(parts[0])]
    for p in parts[1:]:
        out += [quoted, F.lit(p)]
    return F.concat(*out)


def body(raw: Column) -> Column:
    """The record without a byte-order mark at its start and a carriage return at its end; null as the empty record."""
    return F.regexp_replace(F.coalesce(raw, F.lit("")), r"\A\x{FEFF}|\r\z", "")


def well_quoted(text: Column, delimiter: Column) -> Column:
    """Whether every cell that starts with a quote is closed right before a delimiter or the end."""
    return ~F.contains(text, F.lit('"')) | F.regexp_like(F.concat(text, delimiter), _grammar(delimiter, r"\A(?:{c}{d})*+\z"))


def cells(text: Column, delimiter: Column) -> Column:
    """The values of a well quoted record."""
    raw = F.regexp_extract_all(F.concat(text, delimiter), _grammar(delimiter, "({c}){d}"), F.lit(1))
    unquoted = F.transform(raw, lambda v: F.when(v.startswith('"'), F.replace(v.substr(F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"'))).otherwise(v))
    return F.when(F.contains(text, F.lit('"')), unquoted).otherwise(F.split(text, F.concat(F.lit(r"\Q"), delimiter, F.lit(r"\E")), -1))


def _blankless(value: Column) -> Column:
    return F.trim(value)


def valid(kind: Column, value: Column) -> Column:
    """Whether a cell is empty or a value of its column's type (string int decimal date timestamp boolean; other types are never valid)."""
    v = _blankless(value)
    date = F.try_to_date(F.substring(v, 1, 10), "yyyy-MM-dd").isNotNull()
    number = F.regexp_replace(v, r"\A([+-]?)0+(?=[0-9])", "$1").try_cast("decimal(38,0)")  # null beyond 38 digits
    day = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}"
    return (
        F.when((v == "") | (kind == "string"), True)
        .when(kind == "int", v.rlike(r"\A[+-]?[0-9]+\z") & F.coalesce(number.between(-(2**31), 2**31 - 1), F.lit(False)))
        .when(kind == "decimal", v.rlike(r"\A[+-]?[0-9]+(?:\.[0-9]+)?\z"))
        .when(kind == "date", v.rlike(day + r"\z") & date)
        .when(kind == "timestamp", v.rlike(day + r"[T ](?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z?\z") & date)
        .when(kind == "boolean", F.lower(v).isin("true", "false"))
        .otherwise(False)
    )


def layout_rules(layouts: DataFrame) -> DataFrame:
    """One rule per layout and column: layout_id, col (from 0), column_name, kind."""
    zipped = F.arrays_zip(F.col("column_names").alias("n"), F.col("column_types").alias("t"))
    return layouts.select("layout_id", F.posexplode(zipped).alias("col", "rule")).select("layout_id", "col", F.col("rule.n").alias("column_name"), F.coalesce("rule.t", F.lit("string")).alias("kind"))


def exploded(rows: DataFrame, layouts: DataFrame) -> DataFrame:
    """Records as (row_id, layout_id, col, value, column_name, kind, structural): one row per cell, or one for a record with a structural fault."""
    small = bounded_broadcast(layouts.select("layout_id", "data_start_row", "delimiter", "column_count"))
    records = (
        rows.select("row_id", "layout_id", "row_no", "raw")
        .join(small, "layout_id", "left")
        .filter(F.coalesce(F.col("row_no") >= F.col("data_start_row"), F.lit(True)))
        .select("row_id", "layout_id", "column_count", "delimiter", body(F.col("raw")).alias("text"))
        .withColumn("quoted_well", well_quoted(F.col("text"), F.col("delimiter")))
        .withColumn("cells", F.when(F.col("quoted_well"), cells(F.col("text"), F.col("delimiter"))))
        .withColumn(
            "structural",
            F.when(F.col("delimiter").isNull(), "no_layout").when(~F.col("quoted_well"), REASONS[0]).when(F.size("cells") != F.col("column_count"), REASONS[1]),
        )
    )
    parts = F.when(F.col("structural").isNull(), F.col("cells")).otherwise(F.array(F.lit(None).cast("string")))
    return records.select("row_id", "layout_id", "structural", F.posexplode(parts).alias("col", "value")).join(bounded_broadcast(layout_rules(layouts)), ["layout_id", "col"], "left")


def failures(rows: DataFrame, layouts: DataFrame) -> DataFrame:
    """Records that fail: row_id, reason (the first that applies), bad_columns (names of the columns with invalid values, in order)."""
    bad = exploded(rows, layouts).filter(F.col("structural").isNotNull() | ~valid(F.col("kind"), F.col("value")))
    return (
        bad.groupBy("row_id")
        .agg(F.coalesce(F.max("structural"), F.lit(REASONS[2])).alias("reason"), F.array_sort(F.collect_set(F.when(F.col("structural").isNull(), F.struct("col", "column_name")))).alias("b"))
        .select("row_id", "reason", F.col("b.column_name").alias("bad_columns"))
    )


def typed_cells(rows: DataFrame, layouts: DataFrame) -> DataFrame:
    """Cells of the clean records, typed: row_id, layout_id, col, column_name, kind, value and one column per type, of which the cell's own is filled."""
    c = exploded(rows, layouts).filter(F.col("structural").isNull()).join(failures(rows, layouts).select("row_id"), "row_id", "left_anti")
    v = F.nullif(_blankless(F.col("value")), F.lit(""))
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    return c.select(
        "row_id", "layout_id", "col", "column_name", "kind", "value",
        of("string", F.col("value")).alias("string_value"),
        of("int", v.try_cast("int")).alias("int_value"),
        of("decimal", v.try_cast("decimal(38,12)")).alias("decimal_value"),
        of("date", v.try_cast("date")).alias("date_value"),
        of("timestamp", F.try_to_timestamp(F.translate(F.substring(v, 1, 19), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss"))).alias("timestamp_value"),
        of("boolean", F.lower(v) == "true").alias("boolean_value"),
    )


def typed_table(rows: DataFrame, layouts: DataFrame, layout_id: int) -> DataFrame:
    """The clean records of one layout as a wide table: row_id and one column of the right type for each of the layout's columns (clashing names get their position)."""
    rules = layout_rules(layouts).filter(F.col("layout_id") == layout_id).orderBy("col").collect()  # one layout: as many rows as it has columns
    t = typed_cells(rows.filter(F.col("layout_id") == layout_id), layouts)
    seen: set[str] = {"row_id"}
    outs = []
    for r in rules:
        name = r.column_name if r.column_name and r.column_name.lower() not in seen else f"{r.column_name or 'column'}_{r.col}"
        seen.add(name.lower())
        outs.append(F.any_value(F.when(F.col("col") == r.col, F.col(f"{r.kind}_value")), True).alias(name))
    return t.groupBy("row_id").agg(*outs)


def regions(rows: DataFrame, layouts: DataFrame, group: str = "export_id") -> DataFrame:
    """The table that the rows of a group hold: group, width (the most frequent number of cells; of equal ones the wider), rows (that have it), preamble (rows before the first of them), strict (all rows have one width of two and more).

    Rows that aren't well quoted have no width. Rows that were sent twice count once. Widths are counted per group first, so a group of any size is a few rows."""
    small = bounded_broadcast(layouts.select("layout_id", "delimiter"))
    x = rows.select(group, "layout_id", "row_no", "raw").distinct().join(small, "layout_id").select(group, "row_no", "delimiter", body(F.col("raw")).alias("t"))
    w = x.select(group, "row_no", F.when(well_quoted(F.col("t"), F.col("delimiter")), F.size(cells(F.col("t"), F.col("delimiter")))).otherwise(0).cast("long").alias("width"))
    per = w.groupBy(group, "width").agg(F.count("*").alias("n"), F.min("row_no").alias("first"))
    modal = per.groupBy(group).agg(F.max(F.struct(F.when(F.col("width") > 0, F.col("n")).otherwise(0).alias("n"), "width", "first")).alias("m"), F.count("*").alias("widths"))
    modal = modal.select(group, F.col("m.width").alias("width"), F.col("m.n").alias("rows"), F.col("m.first").alias("first"), ((F.col("widths") == 1) & (F.col("m.width") > 1)).alias("strict"))
    before = w.join(modal.select(group, "first"), group).filter(F.col("row_no") < F.col("first")).groupBy(group).agg(F.count("*").alias("preamble"))
    return modal.join(before, group, "left").select(group, "width", "rows", F.coalesce("preamble", F.lit(0)).alias("preamble"), "strict")
