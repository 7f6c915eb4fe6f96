"""Queries of the compact views."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow.functions.text import CJK_RE2, line_rows, normalised_line, token_estimate
from weirflow.operators import views as V
from weirflow.plans.registry import Registry
from weirflow.sources.tables import table

R = Registry()


def _q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def tokens_sql(t: str) -> str:
    n = f"len(regexp_extract_all({t}, {_q(CJK_RE2)}))"
    return f"(ceil({n} / 1.5) + ceil((length({t}) - {n}) / 4.0))::BIGINT"


_L = "l AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)"
_ROWS = _L + ", ln AS (SELECT doc_id, source, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS line FROM l)"
_WIN = f"""WITH {_L} SELECT doc_id, CASE WHEN len(ls) >= 120 THEN 'L61-L' || (len(ls) - 40) WHEN strlen(text) >= 6000 THEN 'B2400-B' || (strlen(text) - 800) END AS locator, {tokens_sql('text')} AS tokens_before,
  CASE WHEN len(ls) >= 120 THEN sha256(array_to_string(ls[:60] || ['… ' || (len(ls) - 100) || ' lines withheld → retrieve L61-L' || (len(ls) - 40) || ' …'] || ls[-40:], chr(10))) WHEN strlen(text) >= 6000 THEN sha256(left(text, list_max(list_filter(range(0, 2401), lambda k: strlen(left(text, k)) <= 2400))::INT) || chr(10) || '… ' || (strlen(text) - 3200) || ' bytes withheld → retrieve B2400-B' || (strlen(text) - 800) || ' …' || chr(10) || right(text, list_max(list_filter(range(0, 801), lambda k: strlen(right(text, k)) <= 800))::INT)) ELSE sha256(text) END AS view_hash FROM l"""


@R.add("view_window", _WIN)
def view_window(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull()).withColumn("w", V.window_view(F.col("text")))
    return d.select("doc_id", "w.locator", "w.tokens_before", F.sha2("w.view", 256).alias("view_hash"))


_HITS = _L + f""", ok AS (SELECT doc_id FROM l WHERE len(list_filter(ls, lambda x: trim(x, ' ') <> '')) >= 12 AND len(list_filter(ls, lambda x: trim(x, ' ') <> '' AND regexp_matches(x, {_q(V.HIT)}))) >= 0.66 * len(list_filter(ls, lambda x: trim(x, ' ') <> ''))),
 hits AS (SELECT doc_id, n, regexp_extract(line, {_q(V.HIT)}, 1) AS file, regexp_extract(line, {_q(V.HIT)}, 2)::BIGINT AS line_no, trim(regexp_extract(line, {_q(V.HIT)}, 3), ' ') AS content
 FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS line FROM l SEMI JOIN ok USING (doc_id)) WHERE regexp_matches(line, {_q(V.HIT)})),
 f AS (SELECT doc_id, file, row_number() OVER (PARTITION BY doc_id ORDER BY min(n)) AS place FROM hits GROUP BY doc_id, file),
 a AS (SELECT h.*, place, row_number() OVER (PARTITION BY h.doc_id, h.file, line_no, content ORDER BY n) > 1 AS again FROM hits h JOIN f USING (doc_id, file)),
 dropped AS (SELECT doc_id, n, CASE WHEN again THEN 'duplicate hits' WHEN place > 25 THEN 'files beyond the cap' WHEN row_number() OVER (PARTITION BY doc_id, file, again ORDER BY n) > 5 THEN 'hits beyond the per-file cap' END AS reason FROM a)"""
_RANGES = "SELECT doc_id, 'L' || min(n) || '-L' || max(n) AS locator, min(n) AS first, max(n) AS last, count(*) AS items, array_to_string(list_sort(list_distinct(list(reason))), ', ') AS reasons FROM (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS g FROM dropped WHERE reason IS NOT NULL) GROUP BY doc_id, g"


def _search(spark, sf_dir):
    return V.search_hits(table(spark, sf_dir, "documents"), "doc_id", "text")


@R.add("view_search_omissions", f"WITH {_HITS} {_RANGES}")
def view_search_omissions(spark, sf_dir):
    return V.ranges(V.search_dropped(_search(spark, sf_dir), "doc_id"), "doc_id")


@R.add("view_search_counts", f"WITH {_HITS} SELECT doc_id, count(*) AS hits, count(DISTINCT file) AS files FROM hits GROUP BY doc_id")
def view_search_counts(spark, sf_dir):
    per = _search(spark, sf_dir).groupBy("doc_id", "file").agg(F.count("*").alias("n"))
    return per.groupBy("doc_id").agg(F.sum("n").alias("hits"), F.count("*").alias("files"))


_RENDERED = f"""WITH {_HITS}, r AS ({_RANGES}), ln AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS line FROM l),
 p AS (SELECT ln.doc_id, ln.n, CASE WHEN r.doc_id IS NULL THEN line WHEN ln.n = r.first THEN '… ' || r.items || CASE WHEN r.items = 1 THEN ' line omitted (' ELSE ' lines omitted (' END || r.reasons || ') → retrieve ' || r.locator || ' …' END AS piece FROM ln LEFT JOIN r ON ln.doc_id = r.doc_id AND ln.n BETWEEN r.first AND r.last),
 v AS (SELECT doc_id, string_agg(piece, chr(10) ORDER BY n) AS view FROM p WHERE piece IS NOT NULL GROUP BY 1)"""


@R.add("view_search_rendered", f"{_RENDERED} SELECT doc_id, {tokens_sql('view')} AS tokens_after, sha256(view) AS view_hash FROM v")
def view_search_rendered(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    v = V.rendered(d, "doc_id", "text", V.search_dropped(V.search_hits(d, "doc_id", "text"), "doc_id"))
    return v.select("doc_id", token_estimate(F.col("view")).alias("tokens_after"), F.sha2("view", 256).alias("view_hash"))


_CLASS = "CASE WHEN trim(line, ' ') = '' THEN 'blank' " + " ".join(f"WHEN regexp_matches(line, {_q(p)}) THEN {_q(n)}" for n, p in V.LINE_CLASSES) + " ELSE 'other' END"


@R.add("view_line_classes", f"WITH {_ROWS} SELECT source, class, count(*) AS n FROM (SELECT source, {_CLASS} AS class FROM ln) GROUP BY ALL")
def view_line_classes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    x = d.select("source", F.explode(F.split("text", "\n", -1)).alias("line"))
    return x.select("source", V.line_class(F.col("line")).alias("class")).groupBy("source", "class").agg(F.count("*").alias("n"))


_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '(?i)0x[0-9a-f]+', '0xHEX', 'g'), '(?i)\b[0-9]+(\.[0-9]+)?(ms|s|m)\b', 'NUMt', 'g'), '\b[0-9][0-9_,.]*\b', 'NUM', 'g'), '[ \t\r\n\f]+', ' ', 'g'), ' ')"


@R.add("view_repeated_lines", f"WITH {_ROWS} SELECT doc_id, norm, count(*) AS n, min(n) AS first_n FROM (SELECT doc_id, n, {_NORM} AS norm FROM ln) WHERE norm <> '' GROUP BY ALL HAVING count(*) > 1")
def view_repeated_lines(spark, sf_dir):
    x = line_rows(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("norm", normalised_line(F.col("line"))).filter("norm <> ''")
    return x.groupBy("doc_id", "norm").agg(F.count("*").alias("c"), F.min("n").alias("first_n")).filter("c > 1").select("doc_id", "norm", F.col("c").alias("n"), F.col("first_n").cast("long"))


_TEST = f"""{_L}, c AS (SELECT doc_id, n, line, {_CLASS} AS class, {_NORM} AS norm FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS line FROM l WHERE len(ls) >= 40 AND source = 'ci-runner')),
 t AS (SELECT *, coalesce(lag(class) OVER w = 'blank' AND class = 'blank', false) AS blank_again, sum(CASE WHEN class IN ('frame', 'blank') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS trace FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
 u AS (SELECT *, sum(CASE WHEN class = 'frame' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, trace ORDER BY n ROWS UNBOUNDED PRECEDING) AS depth, row_number() OVER (PARTITION BY doc_id, class, norm ORDER BY n) > 1 AS again FROM t),
 dropped AS (SELECT doc_id, n, CASE WHEN blank_again THEN 'blank' WHEN class = 'frame' AND depth > 6 THEN 'repeated stack frames' WHEN class = 'warning' AND again THEN 'duplicate warnings' WHEN class = 'other' AND again THEN 'duplicate lines' {' '.join(f"WHEN class = '{c}' THEN '{r}'" for c, r in V.DROP_REASONS.items())} END AS reason FROM u)"""


def _ci(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("source = 'ci-runner' and text is not null")


@R.add("view_test_omissions", f"WITH {_TEST} {_RANGES}")
def view_test_omissions(spark, sf_dir):
    return V.ranges(V.test_dropped(_ci(spark, sf_dir), "doc_id", "text"), "doc_id")


_REC = f"""{_L}, ok AS (SELECT doc_id, list_filter(ls, lambda x: trim(x, ' ') <> '') AS q FROM l), ok2 AS (SELECT doc_id FROM ok WHERE len(q) >= 5 AND len(list_filter(q[:50], lambda x: json_valid(x))) >= 0.7 * len(q[:50])),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS r, count(*) OVER (PARTITION BY doc_id) AS last, regexp_matches(line, '(?i)"(error|exception|failed|failure)"\\s*:') AS err FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS line FROM l SEMI JOIN ok2 USING (doc_id)) WHERE trim(line, ' ') <> ''),
 e AS (SELECT *, r <= 3 OR r > last - 3 AS edge FROM r), i AS (SELECT *, sum(CASE WHEN err AND NOT edge THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS nth FROM e),
 dropped AS (SELECT doc_id, n, CASE WHEN NOT edge AND NOT (err AND nth <= 6) THEN 'ndjson records' END AS reason FROM i)"""


@R.add("view_record_omissions", f"WITH {_REC} {_RANGES}")
def view_record_omissions(spark, sf_dir):
    return V.ranges(V.record_dropped(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


_SET = f"""{_L}, ok AS (SELECT doc_id, list_filter(ls, lambda x: trim(x, ' ') <> '' AND NOT regexp_matches(x, '^\\s*[#;]')) AS q FROM l), ok2 AS (SELECT doc_id FROM ok WHERE len(q) >= 8 AND len(list_filter(q, lambda x: regexp_matches(x, {_q(V.ASSIGN)}))) >= 0.8 * len(q)),
 s AS (SELECT doc_id, n, regexp_extract(line, {_q(V.ASSIGN)}, 1) AS name, trim(regexp_extract(line, {_q(V.ASSIGN)}, 2), ' ') AS value FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS line FROM l SEMI JOIN ok2 USING (doc_id)) WHERE regexp_matches(line, {_q(V.ASSIGN)})),
 st AS (SELECT *, CASE WHEN value IN ('', '""', '''''') THEN 'empty' WHEN regexp_matches(value, '(?i)^[''"]?https?://') THEN 'url' WHEN regexp_matches(value, '^-?[0-9]+(\\.[0-9]+)?$') THEN 'number' WHEN regexp_matches(value, '(?i)^(true|false)$') THEN 'boolean' WHEN regexp_matches(value, '^[''"].*[''"]$') THEN 'quoted' ELSE 'string' END AS type FROM s)"""


@R.add("view_settings_conflicts", f"WITH {_SET} SELECT doc_id, name, count(*) AS definitions, count(DISTINCT value) AS different FROM st GROUP BY ALL HAVING count(*) > 1")
def view_settings_conflicts(spark, sf_dir):
    per = V.settings(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("doc_id", "name", "value").agg(F.count("*").alias("n"))
    return per.groupBy("doc_id", "name").agg(F.sum("n").alias("definitions"), F.count("*").alias("different")).filter("definitions > 1")


@R.add("view_settings_types", f"WITH {_SET} SELECT type, count(*) AS n, count(DISTINCT doc_id) AS docs FROM st GROUP BY ALL")
def view_settings_types(spark, sf_dir):
    per = V.settings(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("type", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("type").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@R.add("view_log_outline", f"WITH {_L} SELECT doc_id, len(list_filter(ls, lambda x: trim(x, ' ') <> '')) AS lines, len(regexp_extract_all(text, '(?m)^\\S+ ERROR ')) AS errors, len(regexp_extract_all(text, '(?m)^\\S+ WARN ')) AS warnings, regexp_extract(text, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9:.]+Z)', 1) AS first_at FROM l WHERE source = 'gateway-log'")
def view_log_outline(spark, sf_dir):
    return V.log_outline(table(spark, sf_dir, "documents").filter("source = 'gateway-log'"), "doc_id", "text")


@R.add("view_json_outline")
def view_json_outline(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("content_kind = 'json' and text is not null")
    return d.withColumn("o", V.json_outline(F.col("text"))).select("doc_id", "o.kind", "o.records", "o.fields", "o.depth")


@R.add("view_choice")
def view_choice(spark, sf_dir):
    """Which view each text is delivered in."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")
    hits = V.rendered(d, "doc_id", "text", V.search_dropped(V.search_hits(d, "doc_id", "text"), "doc_id")).select("doc_id", token_estimate(F.col("view")).alias("search_after"))
    x = d.withColumn("w", V.window_view(F.col("text"))).join(hits, "doc_id", "left")
    before = F.col("w.tokens_before")
    return x.select("doc_id", before.alias("tokens_before"), V.chosen(before, [("search", F.col("search_after")), ("window", F.col("w.tokens_after"))]).alias("view"))
