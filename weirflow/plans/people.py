"""Queries of tables of people."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow.operators import parse_errors as P
from weirflow.operators import tables as T
from weirflow.plans.parse_errors import _FOUND, _PARSED
from weirflow.plans.registry import Registry
from weirflow.sources.tables import table

R = Registry()



def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_KIND = (
    "CASE "
    + " ".join(f"WHEN len(list_filter({_list(ls)}, lambda w: k = w OR length(w) >= 5 AND starts_with(k, w))) > 0 THEN '{kind}'" for kind, ls in T.LABELS.items())
    + " "
    + " ".join(f"WHEN len(list_filter({_list(ls)}, lambda w: ends_with(k, w) AND length(k) <= length(w) + 8)) > 0 THEN '{kind}'" for kind, ls in T.ENDINGS.items())
    + " END"
)
_CATEGORY = "CASE " + " ".join(f"WHEN len(list_filter({_list(ls)}, lambda w: contains(k, w))) > 0 THEN '{kind}'" for kind, ls in T.CATEGORIES.items()) + " END"
_HEADERS = rf"""WITH h AS (SELECT layout_id, unnest(range(len(column_names)))::INT AS col, unnest(column_names) AS label FROM table_layout),
 n AS (SELECT *, regexp_replace(lower(trim(nfc_normalize(label), ' ')), '[\s_.:/()（）-]+', '', 'g') AS k FROM h), hc AS (SELECT layout_id, col, label, {_KIND} AS kind, {_CATEGORY} AS category FROM n)"""


def _headers(spark, sf_dir):
    x = table(spark, sf_dir, "table_layout").select("layout_id", F.posexplode("column_names").alias("col", "label")).withColumn("k", T.label_key(F.col("label")))
    return x.select("layout_id", "col", "label", T.identifier_kind(F.col("k")).alias("kind"), T.category(F.col("k")).alias("category"))


@R.add("people_headers", _HEADERS + " SELECT layout_id, col, label, kind, category FROM hc")
def people_headers(spark, sf_dir):
    """Kind of identifier and category that each column label of the layouts names."""
    return _headers(spark, sf_dir)


@R.add(
    "people_classified",
    _HEADERS
    + " SELECT layout_id, count(kind)::INT AS direct_identifier_columns, count(category)::INT AS performance_columns, CASE WHEN count(kind) > 0 AND count(category) > 0 THEN 'restricted' WHEN count(kind) > 0 OR count(category) > 0 THEN 'confidential' ELSE 'none' END AS sensitivity, coalesce(string_agg(kind, ',' ORDER BY col), '') AS types, coalesce((SELECT string_agg(DISTINCT category, ',' ORDER BY category) FROM hc d WHERE d.layout_id = hc.layout_id), '') AS categories FROM hc GROUP BY layout_id",
)
def people_classified(spark, sf_dir):
    """Every layout as a whole: how many of its columns identify persons, which categories go with them, how sensitive it is."""
    g = _headers(spark, sf_dir).groupBy("layout_id").agg(F.array_sort(F.collect_list(F.struct("col", "kind", "category"))).alias("c"))  # as many as a layout has columns
    x = g.select("layout_id", T.header_class(F.col("c.kind"), F.col("c.category")).alias("h"))
    return x.select("layout_id", "h.direct_identifier_columns", "h.performance_columns", "h.sensitivity", F.array_join("h.types", ",").alias("types"), F.array_join("h.categories", ",").alias("categories"))


@R.add("people_sensitivity", "SELECT sensitivity, CASE WHEN direct_identifier_columns > 0 AND performance_columns > 0 THEN 'restricted' WHEN direct_identifier_columns > 0 OR performance_columns > 0 THEN 'confidential' ELSE 'none' END AS computed, count(*) AS exports FROM table_classification GROUP BY ALL")
def people_sensitivity(spark, sf_dir):
    t = table(spark, sf_dir, "table_classification")
    return t.select("sensitivity", T.sensitivity(F.col("direct_identifier_columns"), F.col("performance_columns")).alias("computed")).groupBy("sensitivity", "computed").agg(F.count("*").alias("exports"))


_SHAPE = r"""CASE WHEN v = '' THEN 'empty' WHEN length(v) > 512 THEN 'text' WHEN regexp_matches(v, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$') THEN 'email' WHEN regexp_matches(v, '^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}([T ][0-9:.]+Z?)?$') THEN 'datetime' WHEN regexp_matches(v, '^[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?$') THEN 'time'
 WHEN regexp_matches(v, '^[+(]?[0-9][0-9() .-]{5,}[0-9]$') AND regexp_matches(v, '[-() +.]') AND NOT regexp_matches(v, '^[0-9]+\.[0-9]+$') THEN 'phone' WHEN regexp_matches(v, '^[+-]?[0-9]+(\.[0-9]+)?%?$') THEN 'numeric' WHEN regexp_matches(v, '^[A-Za-z]*[-_]?[0-9][A-Za-z0-9_-]*$') THEN 'code' ELSE 'text' END"""
_CELLS = _FOUND + f", c AS (SELECT layout_id, col, column_name, value, trim(coalesce(value, ''), ' ') AS v FROM judged WHERE row_id NOT IN (SELECT row_id FROM found)), s AS (SELECT *, {_SHAPE} AS shape FROM c)"


def _cells(spark, sf_dir):
    return P.typed_cells(table(spark, sf_dir, "delimited_rows"), table(spark, sf_dir, "table_layout")).select("layout_id", "col", "column_name", "value")


@R.add("people_cell_shapes", _CELLS + " SELECT column_name, shape, count(*) AS cells FROM s GROUP BY ALL")
def people_cell_shapes(spark, sf_dir):
    return _cells(spark, sf_dir).groupBy("column_name", T.cell_shape(F.col("value")).alias("shape")).agg(F.count("*").alias("cells"))


@R.add(
    "people_column_facts",
    _CELLS
    + " SELECT layout_id, col::INT AS col, count(*) AS cells, count_if(shape <> 'empty') AS filled, count(DISTINCT value) FILTER (WHERE shape <> 'empty') AS distinct_values, "
    + ", ".join(f"round(count_if(shape = '{s}') / greatest(count_if(shape <> 'empty'), 1), 4) AS share_{s}" for s in ("email", "phone", "datetime", "numeric", "code", "text"))
    + " FROM s GROUP BY ALL",
)
def people_column_facts(spark, sf_dir):
    return T.column_facts(_cells(spark, sf_dir), ["layout_id", "col"])


@R.add(
    "people_inferred_kinds",
    _CELLS
    + " , f AS (SELECT layout_id, col::INT AS col, count_if(shape <> 'empty') AS filled, count(DISTINCT value) FILTER (WHERE shape <> 'empty') AS d, "
    + ", ".join(f"round(count_if(shape = '{s}') / greatest(count_if(shape <> 'empty'), 1), 4) AS share_{s}" for s in ("email", "phone", "code", "text"))
    + " FROM s GROUP BY ALL), k AS (SELECT layout_id, col, CASE WHEN share_email >= 0.8 THEN 'email' WHEN share_phone >= 0.8 THEN 'phone' WHEN d >= 0.9 * filled AND share_code >= 0.8 THEN 'account-id' WHEN d >= 0.9 * filled AND share_text >= 0.8 THEN 'name' END AS kind FROM f) SELECT layout_id, col, kind FROM k WHERE kind IS NOT NULL",
)
def people_inferred_kinds(spark, sf_dir):
    return people_column_facts(spark, sf_dir).select("layout_id", "col", T.inferred_kind().alias("kind")).filter("kind is not null")


_KEYS = "SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values, count({c}) AS filled, count(DISTINCT {c}) * 20 >= count({c}) AS linkable FROM roster"


@R.add("people_linkable", " UNION ALL ".join(_KEYS.format(c=c) for c in ("student_id", "name", "course", "instructor")))
def people_linkable(spark, sf_dir):
    """Columns with enough distinct values to link rows by."""
    r = table(spark, sf_dir, "roster")
    cols = ("student_id", "name", "course", "instructor")
    x = r.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v")) for c in cols))).alias("x")).select("x.*").filter("v is not null")
    return x.groupBy("column_name", "v").agg(F.count("*").alias("n")).groupBy("column_name").agg(F.count("*").alias("distinct_values"), F.sum("n").alias("filled")).withColumn("linkable", F.col("distinct_values") * 20 >= F.col("filled"))


_TOKENS = "WITH f AS (SELECT student_id, min(roster_id) AS o FROM roster WHERE student_id <> '' GROUP BY 1), t AS (SELECT student_id, row_number() OVER (ORDER BY o) AS n FROM f), k AS (SELECT student_id, 'PERSON-' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS token FROM t)"


@R.add("people_pseudonyms", _TOKENS + " SELECT r.roster_id, r.course, k.token FROM roster r LEFT JOIN k USING (student_id)")
def people_pseudonyms(spark, sf_dir):
    r = table(spark, sf_dir, "roster")
    return r.select("roster_id", "course", "student_id").join(T.entities(r, "student_id", ["roster_id"]), "student_id", "left").select("roster_id", "course", "token")


@R.add("people_join_rate", _TOKENS + ", a AS (SELECT k.token, s.class FROM student_scores s JOIN k USING (student_id)), b AS (SELECT s.record_id, s.class, r.roster_id FROM student_scores s JOIN roster r USING (student_id)) SELECT class, count(*) AS joined, count(DISTINCT token) AS people FROM a GROUP BY 1")
def people_join_rate(spark, sf_dir):
    """Scores joined to the roster by pseudonym: the same rows as by id."""
    tokens = T.entities(table(spark, sf_dir, "roster"), "student_id", ["roster_id"])
    j = table(spark, sf_dir, "student_scores").select("student_id", "class").join(tokens, "student_id")
    return j.groupBy("class", "token").agg(F.count("*").alias("n")).groupBy("class").agg(F.sum("n").alias("joined"), F.count("*").alias("people"))


@R.add("people_conflicts", 'SELECT student_id, count(DISTINCT name) AS "values" FROM student_scores WHERE student_id IS NOT NULL AND name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT name) > 1')
def people_conflicts(spark, sf_dir):
    return T.conflicts(table(spark, sf_dir, "student_scores"), "student_id", "name")


@R.add("people_residue", "SELECT s.class, count(*) AS names_left FROM student_scores s JOIN (SELECT DISTINCT student_id, name FROM roster) r ON s.student_id = r.student_id AND s.name = r.name GROUP BY 1")
def people_residue(spark, sf_dir):
    """Names that still stand beside the id they belong to."""
    r = table(spark, sf_dir, "roster").select("student_id", "name").distinct()
    return table(spark, sf_dir, "student_scores").select("student_id", "name", "class").join(r, ["student_id", "name"]).groupBy("class").agg(F.count("*").alias("names_left"))


@R.add(
    "people_aggregates",
    " UNION ALL ".join(f"SELECT l_returnflag, '{m}' AS metric, count(*) AS records, round(avg({m}), 2) AS mean FROM lineitem GROUP BY 1" for m in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
)
def people_aggregates(spark, sf_dir):
    """Means of the numeric columns in place of the rows."""
    metrics = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("records"), *(F.round(F.avg(m), 2).alias(m) for m in metrics))
    return g.unpivot(["l_returnflag", "records"], list(metrics), "metric", "mean").select("l_returnflag", "metric", "records", "mean")


@R.add(
    "people_serialised",
    _PARSED
    + " , q AS (SELECT c.row_id, l.delimiter, unnest(range(len(cells))) AS i, unnest(cells) AS v FROM cells c JOIN table_layout l USING (layout_id) WHERE quoted_well)"
    + """ SELECT row_id, replace(string_agg(CASE WHEN contains(v, '"') OR contains(v, chr(10)) OR contains(v, chr(13)) OR contains(v, delimiter) THEN '"' || replace(v, '"', '""') || '"' ELSE v END, chr(1) ORDER BY i), chr(1), delimiter) AS record, true AS round_trip FROM q GROUP BY row_id, delimiter""",
)
def people_serialised(spark, sf_dir):
    """Records written again from their cells; whether that gives the record as it was (but for needless quotes)."""
    layouts = table(spark, sf_dir, "table_layout").select("layout_id", "delimiter", "data_start_row")
    d = table(spark, sf_dir, "delimited_rows").join(F.broadcast(layouts), "layout_id").filter("row_no >= data_start_row").select("row_id", "delimiter", P.body(F.col("raw")).alias("t"))
    good = d.filter(P.well_quoted(F.col("t"), F.col("delimiter")))
    out = T.serialised(P.cells(F.col("t"), F.col("delimiter")), F.col("delimiter"))
    return good.select("row_id", out.alias("record"), (P.cells(out, F.col("delimiter")) == P.cells(F.col("t"), F.col("delimiter"))).alias("round_trip"))


_TABULAR = _CELLS + ", " + _HEADERS.removeprefix("WITH ")


@R.add("detect_tabular_identifiers", _TABULAR + " SELECT s.layout_id, s.col::INT AS col, hc.kind, count(*) AS filled, count(DISTINCT s.value) AS distinct_values FROM s JOIN hc ON s.layout_id = hc.layout_id AND s.col = hc.col WHERE hc.kind IS NOT NULL AND s.shape <> 'empty' GROUP BY ALL")
def detect_tabular_identifiers(spark, sf_dir):
    """One finding for each column of a table that identifies persons: its kind, and how many cells hold something."""
    kinds = _headers(spark, sf_dir).filter("kind is not null").select("layout_id", "col", "kind")
    per = _cells(spark, sf_dir).filter(T.cell_shape(F.col("value")) != "empty").groupBy("layout_id", "col", "value").agg(F.count("*").alias("n"))
    return per.join(kinds, ["layout_id", "col"]).groupBy("layout_id", "col", "kind").agg(F.sum("n").alias("filled"), F.count("*").alias("distinct_values"))


_NUMBERS = "count(*) AS filled, count_if(regexp_full_match(v, '[0-9]{5,12}')) AS ids, count_if(regexp_full_match(v, '[0-9]{1,3}([.][0-9]+)?') AND try_cast(v AS DOUBLE) <= 100) AS scores"


@R.add("detect_headerless_scores", _CELLS + f", f AS (SELECT layout_id, col, {_NUMBERS} FROM s WHERE v <> '' GROUP BY ALL) SELECT layout_id, count_if(ids >= 0.8 * filled) AS id_columns, count_if(scores >= 0.8 * filled) AS score_columns FROM f WHERE filled >= 10 GROUP BY 1 HAVING count_if(ids >= 0.8 * filled) > 0 AND count_if(scores >= 0.8 * filled) > 0")
def detect_headerless_scores(spark, sf_dir):
    """Tables that give persons away without any label: a column of long numbers beside one of scores."""
    return T.id_score_tables(_cells(spark, sf_dir), "layout_id", "col", "value")
