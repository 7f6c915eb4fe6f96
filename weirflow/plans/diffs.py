"""Queries of equal and changed content."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow.operators import diffs as D
from weirflow.plans.registry import Registry
from weirflow.sources.tables import table

R = Registry()


@R.add("diff_exact_families", "SELECT sha256(text) AS digest, count(*) AS members, min(doc_id) AS canonical, any_value(strlen(text)) AS octets, any_value(strlen(text)) * (count(*) - 1) AS duplicate_octets FROM documents WHERE text <> '' GROUP BY 1 HAVING count(*) > 1")
def diff_exact_families(spark, sf_dir):
    return D.families(table(spark, sf_dir, "documents"), "doc_id", "text")


@R.add("diff_family_savings", "WITH f AS (SELECT source, sha256(text) AS d, count(*) AS n, any_value(strlen(text)) AS o FROM documents WHERE text <> '' GROUP BY ALL) SELECT source, count(*) AS families, sum(n - 1)::BIGINT AS copies, sum((n - 1) * o)::BIGINT AS octets FROM f WHERE n > 1 GROUP BY 1")
def diff_family_savings(spark, sf_dir):
    f = table(spark, sf_dir, "documents").filter("text <> ''").groupBy("source", F.sha2("text", 256).alias("d")).agg(F.count("*").alias("n"), F.any_value(F.octet_length("text").cast("long")).alias("o")).filter("n > 1")
    return f.groupBy("source").agg(F.count("*").alias("families"), F.sum(F.col("n") - 1).alias("copies"), F.sum((F.col("n") - 1) * F.col("o")).alias("octets"))


@R.add("diff_file_families", r"SELECT sha256(content) AS digest, count(*) AS members, arg_min(file_id, {'a': NOT regexp_matches(relpath, '\.(md|txt|csv|tsv)$'), 'b': -size, 'c': relpath, 'd': file_id}) AS canonical FROM scanned_files WHERE content <> '' AND relpath IS NOT NULL AND size IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def diff_file_families(spark, sf_dir):
    """Families of equal files; text formats come first, then the largest, then by path."""
    f = table(spark, sf_dir, "scanned_files").filter("relpath is not null and size is not null")
    return D.canonical_families(f, "file_id", "content", [~F.col("relpath").rlike(r"\.(md|txt|csv|tsv)$"), -F.col("size"), F.col("relpath")])


_B = "b AS (SELECT relpath AS path, min(sha256(content)) AS db FROM scanned_files WHERE content IS NOT NULL GROUP BY 1)"
_A = "a AS (SELECT CASE WHEN file_id % 7 = 3 THEN relpath || '.moved' ELSE relpath END AS path, min(sha256(CASE WHEN file_id % 5 = 2 THEN coalesce(redacted, content || '#') ELSE content END)) AS da FROM scanned_files LEFT JOIN redact_results USING (file_id) WHERE content IS NOT NULL AND file_id % 11 <> 4 GROUP BY 1)"
_SNAP = f"""WITH {_B}, {_A}, j AS (SELECT coalesce(b.path, a.path) AS path, db, da FROM b FULL JOIN a ON b.path = a.path), gone AS (SELECT path, db AS d FROM j WHERE da IS NULL), new AS (SELECT path, da AS d FROM j WHERE db IS NULL),
 ren AS (SELECT g.p AS old_path, n.p AS path FROM (SELECT d, min(path) AS p FROM gone GROUP BY 1 HAVING count(*) = 1) g JOIN (SELECT d, min(path) AS p FROM new GROUP BY 1 HAVING count(*) = 1) n USING (d)),
 out AS (SELECT path, NULL AS old_path, 'modified' AS change FROM j WHERE db <> da UNION ALL SELECT path, NULL, 'deleted' FROM gone WHERE path NOT IN (SELECT old_path FROM ren) UNION ALL SELECT path, NULL, 'added' FROM new WHERE path NOT IN (SELECT path FROM ren) UNION ALL SELECT path, old_path, 'renamed' FROM ren)"""


def _snapshots(spark, sf_dir):
    """The scanned tree, and the same tree with some files moved, some rewritten and some removed."""
    f = table(spark, sf_dir, "scanned_files").filter("content is not null").select("file_id", "relpath", "content")
    before = f.select(F.col("relpath").alias("path"), F.sha2("content", 256).alias("digest"))
    g = f.join(table(spark, sf_dir, "redact_results").select("file_id", "redacted"), "file_id", "left").filter("file_id % 11 <> 4")
    path = F.when(F.col("file_id") % 7 == 3, F.concat("relpath", F.lit(".moved"))).otherwise(F.col("relpath"))
    text = F.when(F.col("file_id") % 5 == 2, F.coalesce("redacted", F.concat("content", F.lit("#")))).otherwise(F.col("content"))
    return before, g.select(path.alias("path"), F.sha2(text, 256).alias("digest"))


@R.add("diff_snapshots", _SNAP + " SELECT path, old_path, change FROM out")
def diff_snapshots(spark, sf_dir):
    return D.snapshot_diff(*_snapshots(spark, sf_dir))


@R.add("diff_integrity", f"WITH {_B}, {_A} SELECT count_if(db IS NULL) AS added, count_if(da IS NULL) AS missing, count_if(db <> da) AS changed, count_if(db = da) AS same FROM b FULL JOIN a ON b.path = a.path")
def diff_integrity(spark, sf_dir):
    b, a = _snapshots(spark, sf_dir)
    j = b.groupBy("path").agg(F.min("digest").alias("db")).join(a.groupBy("path").agg(F.min("digest").alias("da")), "path", "full_outer")
    return j.agg(F.count_if(F.col("db").isNull()).alias("added"), F.count_if(F.col("da").isNull()).alias("missing"), F.count_if(F.col("db") != F.col("da")).alias("changed"), F.count_if(F.col("db") == F.col("da")).alias("same"))


@R.add("diff_context", "SELECT p.file_id, CASE WHEN r.file_id IS NULL THEN 'removed' WHEN r.redaction_count > 0 THEN 'action-changed' ELSE 'content-changed' END AS change FROM scanned_files p LEFT JOIN redact_results r USING (file_id) WHERE r.file_id IS NULL OR r.redaction_count > 0 OR sha256(r.redacted) IS DISTINCT FROM sha256(p.content)")
def diff_context(spark, sf_dir):
    p, r = table(spark, sf_dir, "scanned_files").select("file_id", "content"), table(spark, sf_dir, "redact_results").select("file_id", "redacted", "redaction_count", F.lit(True).alias("there"))
    j = p.join(r, "file_id", "left")
    change = F.when(F.col("there").isNull(), "removed").when(F.col("redaction_count") > 0, "action-changed").when(~F.sha2("redacted", 256).eqNullSafe(F.sha2("content", 256)), "content-changed")
    return j.select("file_id", change.alias("change")).filter("change is not null")


@R.add(
    "diff_tree_hash",
    "WITH x AS (SELECT workspace, ('0x' || sha256(relpath)[:2])::INT AS bucket, relpath || chr(0) || coalesce(sha256(content), '-') AS line FROM scanned_files), h AS (SELECT workspace, bucket, sha256(array_to_string(list_sort(list(line)), chr(10))) AS h FROM x GROUP BY ALL) SELECT workspace, sha256(array_to_string(list_sort(list(lpad(bucket::VARCHAR, 3, '0') || ':' || h)), chr(10))) AS tree_hash FROM h GROUP BY 1",
)
def diff_tree_hash(spark, sf_dir):
    return D.tree_hash(table(spark, sf_dir, "scanned_files").select("workspace", "relpath", F.sha2("content", 256).alias("d")), "workspace", "relpath", "d")


@R.add("diff_unreachable", "SELECT f.workspace, count(*) AS objects, sum(size)::BIGINT AS octets FROM scanned_files f WHERE file_id NOT IN (SELECT file_id FROM redact_results) AND workspace NOT IN (SELECT workspace FROM documents WHERE workspace IS NOT NULL AND content_kind = 'json') GROUP BY 1")
def diff_unreachable(spark, sf_dir):
    f = table(spark, sf_dir, "scanned_files").select(F.col("file_id").alias("object_id"), "workspace", "size")
    x = D.unreachable(f, table(spark, sf_dir, "redact_results").select(F.col("file_id").alias("object_id")))
    held = table(spark, sf_dir, "documents").filter("content_kind = 'json'").select("workspace").distinct()
    return x.join(held, "workspace", "left_anti").groupBy("workspace").agg(F.count("*").alias("objects"), F.sum("size").alias("octets"))


@R.add("diff_line_ranges", "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS part, strpos(text, 'the ') AS first_the FROM documents WHERE text IS NOT NULL")
def diff_line_ranges(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", D.line_range(F.col("text"), 2, 4).alias("part"), F.instr("text", "the ").alias("first_the"))


@R.add("diff_json_paths", "SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.ref') AS ref FROM events WHERE props IS NOT NULL")
def diff_json_paths(spark, sf_dir):
    p = F.try_parse_json("props")
    return table(spark, sf_dir, "events").filter("props is not null").select("event_id", F.try_variant_get(p, "$.page", "string").alias("page"), F.try_variant_get(p, "$.ref", "string").alias("ref"))


@R.add("diff_path_aliases", "SELECT workspace, lower(relpath) AS alias, count(*) AS paths FROM scanned_files GROUP BY ALL HAVING count(*) > 1")
def diff_path_aliases(spark, sf_dir):
    """Paths of a workspace that a file system without letter case takes for one."""
    return table(spark, sf_dir, "scanned_files").groupBy("workspace", F.lower("relpath").alias("alias")).agg(F.count("*").alias("paths")).filter("paths > 1")


@R.add("diff_manifest", "SELECT f.workspace, count(*) AS files, count(r.file_id) AS delivered, count_if(f.content IS NULL) AS local_only, count(DISTINCT sha256(r.redacted)) AS distinct_outputs FROM scanned_files f LEFT JOIN redact_results r USING (file_id) GROUP BY 1")
def diff_manifest(spark, sf_dir):
    r = table(spark, sf_dir, "redact_results").select("file_id", F.sha2("redacted", 256).alias("out"), F.lit(1).alias("there"))
    j = table(spark, sf_dir, "scanned_files").select("file_id", "workspace", F.col("content").isNull().alias("none")).join(r, "file_id", "left")
    per = j.groupBy("workspace", "out").agg(F.count("*").alias("n"), F.sum("there").alias("d"), F.count_if("none").alias("l"))
    return per.groupBy("workspace").agg(F.sum("n").alias("files"), F.coalesce(F.sum("d"), F.lit(0)).alias("delivered"), F.sum("l").alias("local_only"), F.count("out").alias("distinct_outputs"))


@R.add("diff_hunks")
def diff_hunks(spark, sf_dir):
    j = table(spark, sf_dir, "redact_results").select("file_id", "redacted").join(table(spark, sf_dir, "scanned_files").select("file_id", "content"), "file_id")
    return j.select("file_id", F.explode(D.hunks(F.col("content"), F.col("redacted"))).alias("h")).select("file_id", "h.*")


@R.add("diff_table_families")
def diff_table_families(spark, sf_dir):
    """Exports that hold the same rows, whatever their order, delimiter, line ends and blanks."""
    t = D.table_digest(table(spark, sf_dir, "delimited_rows"), "export_id", "raw")
    return t.groupBy("rows_hash", "rows").agg(F.count("*").alias("members"), F.min("export_id").alias("canonical")).filter("members > 1")
