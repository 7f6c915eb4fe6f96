"""Queries of the detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow.operators import detect as D
from weirflow.operators import ordering as O
from weirflow.plans.registry import Registry
from weirflow.session import widen
from weirflow.sources.tables import table

R = Registry()

_LINES = "lines AS (SELECT {k}, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS t FROM (SELECT {k}, string_split({c}, chr(10)) AS l FROM {tbl} WHERE {c} IS NOT NULL))"
_FILE_LINES = _LINES.format(k="file_id", c="content", tbl="scanned_files")
_DOC_LINES = _LINES.format(k="doc_id", c="text", tbl="documents")
_MASK = "left(v, least(4, greatest(0, length(v) - 2))) || repeat('*', least(16, greatest(4, length(v) - least(4, greatest(0, length(v) - 2))))) || CASE WHEN length(v) > 40 THEN ' (len ' || length(v) || ')' ELSE '' END"
_ENTROPY = "list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: -((length(v) - length(replace(v, c, ''))) / length(v)::DOUBLE) * log2((length(v) - length(replace(v, c, ''))) / length(v)::DOUBLE)))"


def _sql(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


_FORMATS = "WITH " + _FILE_LINES + ", hits AS (" + " UNION ALL ".join(f"SELECT file_id, {_sql(d)} AS detector, {_sql(c)} AS category, {_sql(s)} AS severity, line, unnest(regexp_extract_all(t, {_sql(p)})) AS v FROM lines" for d, c, s, p in D.DETECTORS) + ")"


@R.add("detect_formats", _FORMATS + f" SELECT file_id, detector, category, severity, line, {_MASK} AS preview FROM hits")
def detect_formats(spark, sf_dir):
    return D.format_findings(widen(table(spark, sf_dir, "scanned_files").select("file_id", "content")), "file_id", "content")


@R.add("detect_risk_summary", _FORMATS + " SELECT s.severity, count(h.file_id) AS findings FROM (SELECT unnest(['critical', 'high', 'medium', 'low']) AS severity) s LEFT JOIN hits h USING (severity) GROUP BY 1")
def detect_risk_summary(spark, sf_dir):
    return D.risk_summary(detect_formats(spark, sf_dir))


@R.add("detect_public_summary", _FORMATS + " SELECT category, severity, count(*) AS findings, count(DISTINCT file_id) AS files FROM hits GROUP BY ALL")
def detect_public_summary(spark, sf_dir):
    per = detect_formats(spark, sf_dir).groupBy("category", "severity", "file_id").agg(F.count("*").alias("n"))
    return per.groupBy("category", "severity").agg(F.sum("n").alias("findings"), F.count("*").alias("files"))


@R.add("detect_entropy", f"WITH {_FILE_LINES}, tok AS (SELECT file_id, line, unnest(regexp_extract_all(t, {_sql(D.LONG_TOKEN)})[:50]) AS v FROM lines WHERE regexp_matches(t, {_sql(D.KEY_HINT)})) SELECT file_id, line, round({_ENTROPY}, 6) AS bits, {_MASK} AS preview FROM tok WHERE {_ENTROPY} >= 4.0")
def detect_entropy(spark, sf_dir):
    return D.entropy_findings(table(spark, sf_dir, "scanned_files"), "file_id", "content")


_WORDS = ["passport", "address", "Tarnwick", "roster"]


@R.add("detect_keywords", f"WITH {_DOC_LINES} SELECT doc_id, line, keyword FROM (SELECT doc_id, line, list_filter({[w.lower() for w in _WORDS]}, lambda k: contains(lower(t), k))[1] AS keyword FROM lines) WHERE keyword IS NOT NULL")
def detect_keywords(spark, sf_dir):
    return D.keyword_findings(table(spark, sf_dir, "documents"), "doc_id", "text", _WORDS)


@R.add("detect_document_flags", " UNION ALL ".join(f"SELECT record_id, {_sql(d)} AS detector, {_sql(s)} AS severity FROM student_scores WHERE regexp_matches(teacher_note, {_sql(p)})" for d, s, p in D.DOCUMENT_FLAGS))
def detect_document_flags(spark, sf_dir):
    return D.document_flags(table(spark, sf_dir, "student_scores"), "record_id", "teacher_note")


@R.add("detect_fingerprints", "WITH v AS (" + " UNION ALL ".join([f"SELECT file_id, unnest(regexp_extract_all(content, {_sql(p)})) AS v FROM scanned_files" for *_, p in D.DETECTORS] + [f"SELECT file_id, unnest(regexp_extract_all(content, {_sql(D.ASSIGNED)}, 1)) AS v FROM scanned_files"]) + ") SELECT file_id, sha256(v)[:16] AS fingerprint, count(*) AS n FROM v GROUP BY ALL")
def detect_fingerprints(spark, sf_dir):
    return D.secret_fingerprints(table(spark, sf_dir, "scanned_files"), "file_id", "content")


@R.add(
    "detect_watched_values",
    "SELECT record_id, sha256(r.student_id)[:16] AS fingerprint, sum((length(teacher_note) - length(replace(teacher_note, r.student_id, ''))) // length(r.student_id)) AS n FROM student_scores s JOIN (SELECT DISTINCT student_id FROM roster WHERE length(student_id) >= 7) r ON contains(s.teacher_note, r.student_id) GROUP BY ALL",
)
def detect_watched_values(spark, sf_dir):
    """Roster ids that a note gives away."""
    return D.watched(table(spark, sf_dir, "student_scores"), "record_id", "teacher_note", table(spark, sf_dir, "roster"), "student_id", least=7).groupBy("record_id", "fingerprint").agg(F.sum("n").alias("n"))


_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@R.add("detect_left_after_redaction", f"WITH x AS (SELECT file_id, regexp_extract_all(coalesce(redacted, ''), {_sql(D.DETECTORS[5][3])}) AS a, regexp_extract_all(coalesce(content, ''), {_sql(D.DETECTORS[5][3])}) AS b FROM redact_results JOIN scanned_files USING (file_id)) SELECT file_id, len(a) AS after_values, len(b) AS before_values, len(list_distinct(list_filter(a, lambda v: NOT list_contains(b, v)))) AS new_values FROM x WHERE len(a) + len(b) > 0")
def detect_left_after_redaction(spark, sf_dir):
    x = table(spark, sf_dir, "redact_results").select("file_id", "redacted").join(table(spark, sf_dir, "scanned_files").select("file_id", "content"), "file_id")
    from weirflow.functions.text import java

    n = lambda c: F.coalesce(F.regexp_count(F.col(c), F.lit(java(D.DETECTORS[5][3]))), F.lit(0))
    y = x.withColumn("after_values", n("redacted")).withColumn("before_values", n("content")).filter("after_values + before_values > 0")
    return y.select("file_id", "after_values", "before_values", F.size(D.new_matches(y, "content", "redacted", D.DETECTORS[5][3])).alias("new_values"))


_TAILED = "SELECT row_id, raw, coalesce(lag(right(raw, 256)) OVER (PARTITION BY export_id ORDER BY row_no NULLS FIRST, row_id NULLS FIRST), '') AS tail FROM delimited_rows"


@R.add(
    "detect_across_chunks",
    f"SELECT row_id, len(regexp_extract_all(tail || raw, {_sql(_EMAIL)})) AS with_tail, len(regexp_extract_all(raw, {_sql(_EMAIL)})) AS alone FROM ({_TAILED}) WHERE contains(raw, '@') OR contains(tail, '@')",
)
def detect_across_chunks(spark, sf_dir):
    """Matches in each chunk of an export with the tail of the chunk before it, wherever that lies; an export of any length is spread over ranges. Chunks without a sign in themselves or their tail can't hold a match."""
    return _across(spark, sf_dir, F.contains("raw", F.lit("@")) | F.contains("tail", F.lit("@")))


def _across(spark, sf_dir, asked):
    d = table(spark, sf_dir, "delimited_rows").select("row_id", "export_id", "row_no", F.expr("right(raw, 256)").alias("end"), "raw")
    x = O.previous_in_group(d, ["export_id"], ["row_no", "row_id"], "end", "tail").withColumn("tail", F.coalesce("tail", F.lit(""))).filter(F.col("raw").isNotNull() & asked)
    n = lambda c: F.regexp_count(c, F.lit(_EMAIL))
    return x.select("row_id", n(F.concat("tail", "raw")).alias("with_tail"), n(F.col("raw")).alias("alone"))


@R.add(
    "detect_across_export",
    f"SELECT row_id, len(regexp_extract_all(tail || raw, {_sql(_EMAIL)})) AS with_tail, len(regexp_extract_all(raw, {_sql(_EMAIL)})) AS alone FROM ({_TAILED}) WHERE contains(raw, '@')",
)
def detect_across_export(spark, sf_dir):
    """Those of detect_across_chunks whose own chunk holds the sign."""
    return _across(spark, sf_dir, F.contains("raw", F.lit("@")))


@R.add("detect_detector_summary", _FORMATS + " SELECT detector, severity, count(*) AS findings, count(DISTINCT file_id) AS files FROM hits GROUP BY ALL")
def detect_detector_summary(spark, sf_dir):
    per = detect_formats(spark, sf_dir).groupBy("detector", "severity", "file_id").agg(F.count("*").alias("n"))
    return per.groupBy("detector", "severity").agg(F.sum("n").alias("findings"), F.count("*").alias("files"))


_VALUES = "list_distinct(flatten([" + ", ".join(f"regexp_extract_all(coalesce(content, ''), {_sql(p)})" for *_, p in D.DETECTORS) + "]))"


@R.add("detect_residue", f"WITH x AS (SELECT file_id, {_VALUES} AS vals, redacted FROM redact_results JOIN scanned_files USING (file_id) WHERE redacted IS NOT NULL) SELECT file_id, len(vals) AS known_values, len(list_filter(vals, lambda v: contains(redacted, v))) AS left_values FROM x WHERE len(vals) > 0")
def detect_residue(spark, sf_dir):
    """Delivered texts that still hold a value that was found in their source."""
    x = table(spark, sf_dir, "redact_results").select("file_id", "redacted").filter("redacted is not null").join(table(spark, sf_dir, "scanned_files").select("file_id", D.format_values(F.col("content")).alias("vals")), "file_id")
    return x.filter(F.size("vals") > 0).select("file_id", F.size("vals").cast("long").alias("known_values"), F.size(D.still_there(F.col("redacted"), F.col("vals"))).cast("long").alias("left_values"))
