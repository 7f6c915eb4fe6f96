"""Queries of scans, decisions and transformations of files and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow.operators import policy as P
from weirflow.operators import scan as S
from weirflow.operators import transform as X
from weirflow.operators.detect import DETECTORS
from weirflow.plans.registry import Registry
from weirflow.sources.tables import table

R = Registry()


def _q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


_SKIP = ", ".join(map(_q, S.SKIPPED))
_WALK = f"""WITH o AS (SELECT workspace, flatten(list(explicit_include_dirs)) AS asked FROM walk_options GROUP BY 1), x AS (SELECT f.*, list_filter(string_split(relpath, '/')[:-2], lambda d: d = '.git' OR d IN ({_SKIP}) AND NOT coalesce(list_contains(asked, d), false))[1] AS skipped_dir FROM scanned_files f LEFT JOIN o USING (workspace))"""


@R.add("scan_walk", _WALK + f" SELECT file_id, skipped_dir, CASE WHEN skipped_dir IS NOT NULL THEN 'skipped' WHEN is_symlink THEN 'link' WHEN size > {S.READ_MOST} THEN 'listed' ELSE 'read' END AS status FROM x")
def scan_walk(spark, sf_dir):
    return S.walked(table(spark, sf_dir, "scanned_files"), table(spark, sf_dir, "walk_options")).select("file_id", "skipped_dir", "status")


_IGNORE = ["*.map", "build/", "!build/*.ts", "/packages/*/dist", "# comment", "**/__snapshots__/**"]


@R.add("scan_ignored", r"SELECT file_id, CASE WHEN regexp_matches(relpath, '^(?:.*/)?(?:[^/]+/)*__snapshots__/.*(?:/.*)?$') THEN true WHEN regexp_matches(relpath, '^packages/[^/]*/dist(?:/.*)?$') THEN true WHEN regexp_matches(relpath, '^build/[^/]*\.ts(?:/.*)?$') THEN false WHEN regexp_matches(relpath, '^(?:.*/)?build(?:/.*)?$') THEN true WHEN regexp_matches(relpath, '^(?:.*/)?[^/]*\.map(?:/.*)?$') THEN true ELSE false END AS ignored FROM scanned_files")
def scan_ignored(spark, sf_dir):
    return table(spark, sf_dir, "scanned_files").select("file_id", S.ignored(F.col("relpath"), _IGNORE).alias("ignored"))


@R.add("scan_types", "SELECT CASE WHEN e IN ('pdf', 'xlsx', 'csv', 'tsv', 'docx', 'pptx') THEN e WHEN e IN ('zip', 'gz', 'tgz', 'tar', '7z', 'rar', 'bz2', 'xz', 'jar') THEN 'archive' ELSE 'text' END AS type, count(*) AS files, sum(size)::BIGINT AS size, count_if(coalesce(tracked, false)) AS tracked FROM (SELECT lower(regexp_extract(relpath, '\\.([A-Za-z0-9]+)$', 1)) AS e, size, tracked FROM scanned_files) GROUP BY 1")
def scan_types(spark, sf_dir):
    f = table(spark, sf_dir, "scanned_files").select(S.capabilities(F.col("relpath"))["type"].alias("type"), "size", "tracked")
    return f.groupBy("type").agg(F.count("*").alias("files"), F.sum("size").alias("size"), F.count_if(F.coalesce("tracked", F.lit(False))).alias("tracked"))


@R.add("scan_size_verdicts", "SELECT verdict, count(*) AS files, max(size) AS largest FROM (SELECT size, CASE WHEN e = 'pdf' AND size > 67108864 OR e IN ('xlsx', 'docx', 'pptx') AND size > 134217728 THEN 'too-large' WHEN coalesce(e, '') NOT IN ('pdf', 'xlsx', 'docx', 'pptx') AND size > 2000000 THEN 'large' ELSE 'ok' END AS verdict FROM (SELECT size, lower(regexp_extract(relpath, '\\.([A-Za-z0-9]+)$', 1)) AS e FROM scanned_files)) GROUP BY 1")
def scan_size_verdicts(spark, sf_dir):
    f = table(spark, sf_dir, "scanned_files").select("size", S.size_verdict(F.col("relpath"), F.col("size")).alias("verdict"))
    return f.groupBy("verdict").agg(F.count("*").alias("files"), F.max("size").alias("largest"))


@R.add("scan_text_facts", "WITH x AS (SELECT doc_id, text, len(regexp_extract_all(text, chr(13) || chr(10))) AS crlf, len(regexp_extract_all(text, chr(10))) AS lf FROM documents WHERE text IS NOT NULL) SELECT doc_id, starts_with(text, '﻿') AS bom, CASE WHEN lf = 0 THEN 'none' WHEN crlf = 0 THEN 'lf' WHEN crlf = lf THEN 'crlf' ELSE 'mixed' END AS eol, lf + 1 AS lines, len(regexp_extract_all(left(text, 8000), '[\\x01-\\x08\\x0b\\x0e-\\x1a\\x1c-\\x1f]')) > 0.3 * length(left(text, 8000)) AS is_binary FROM x")
def scan_text_facts(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null").withColumn("f", S.text_facts(F.col("text"))).select("doc_id", "f.bom", "f.eol", "f.lines", F.col("f.binary").alias("is_binary"))


@R.add("scan_env_entries", r"""WITH l AS (SELECT file_id, unnest(range(len(s))) AS i, unnest(s) AS line FROM (SELECT file_id, string_split_regex(content, '\r?\n') AS s FROM scanned_files WHERE regexp_matches(relpath, '\.env')))
SELECT file_id, name, max_by(CASE WHEN length(v) > 1 AND (v[1] = '"' AND v[-1] = '"' OR v[1] = '''' AND v[-1] = '''') THEN v[2:-2] ELSE v END, i) AS value FROM (SELECT file_id, i, regexp_extract(line, '^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$', 1) AS name, regexp_extract(line, '^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$', 2) AS v FROM l) WHERE name <> '' GROUP BY ALL""")
def scan_env_entries(spark, sf_dir):
    return S.env_entries(table(spark, sf_dir, "scanned_files").filter(F.col("relpath").rlike(r"\.env")), "file_id", "content")


RULES = [
    P.Rule("keep-env-local", "local-only", ("**/.env*", "!**/.env.example")),
    P.Rule("redact-secrets", "redact", detectors=("api-key", "access-token", "private-key", "password")),
    P.Rule("summarise-tests", "local-ai", ("packages/*/tests/**",)),
    P.Rule("ask-scripts", "ask", ("packages/*/scripts/*.sh",)),
    P.Rule("send-docs", "send", ("**/*.{md,txt}",)),
]
STRICT = [P.Rule("strict-json", "keep-local", ("**/*.{json,csv}",)), P.Rule("strict-findings", "block", detectors=("private-key",))]
_DET = "coalesce(list_transform(findings, lambda f: f.detector), [])"
_HITS = [
    ("keep-env-local", 6, r"regexp_matches(relpath, '^(?:[^/]+/)*\.env[^/]*$') AND NOT regexp_matches(relpath, '^(?:[^/]+/)*\.env\.example$')", "path"),
    ("redact-secrets", 3, f"list_has_any({_DET}, ['api-key', 'access-token', 'private-key', 'password'])", "detector"),
    ("summarise-tests", 2, "regexp_matches(relpath, '^packages/[^/]*/tests/.*$')", "path"),
    ("ask-scripts", 7, r"regexp_matches(relpath, '^packages/[^/]*/scripts/[^/]*\.sh$')", "path"),
    ("send-docs", 0, r"regexp_matches(relpath, '^(?:[^/]+/)*[^/]*\.(?:md|txt)$')", "path"),
]
_MORE = [("strict-json", 6, r"regexp_matches(relpath, '^(?:[^/]+/)*[^/]*\.(?:json|csv)$')", "path"), ("strict-findings", 8, f"list_has_any({_DET}, ['private-key'])", "detector")]


def _decided_sql(hits) -> str:
    cases = ", ".join(f"CASE WHEN {c} THEN {{'rank': {k}, 'ord': {-i}, 'rule': '{n}', 'via': '{v}'}} END" for i, (n, k, c, v) in enumerate(hits))
    names = "[" + ", ".join(map(_q, P.ACTIONS)) + "]"
    return f"WITH m AS (SELECT file_id, list_max(list_filter([{cases}], lambda s: s IS NOT NULL)) AS b FROM scanned_files), d AS (SELECT file_id, coalesce(CASE WHEN b.rank = 7 THEN 'block' ELSE {names}[b.rank + 1] END, 'allow') AS action, coalesce(b.rule, 'default') AS rule, b.via AS via FROM m)"


def _decided(spark, sf_dir, rules):
    f = table(spark, sf_dir, "scanned_files").select("file_id", "relpath", "findings")
    return P.decided(f, rules, "relpath", F.coalesce(F.col("findings.detector"), F.array().cast("array<string>"))).select("file_id", "action", "rule", "via", "destinations")


@R.add("policy_decisions", _decided_sql(_HITS) + " SELECT file_id, action, rule, via FROM d")
def policy_decisions(spark, sf_dir):
    return _decided(spark, sf_dir, RULES).drop("destinations")


@R.add("policy_by_action", _decided_sql(_HITS) + ", n AS (SELECT action, count(*) AS files FROM d GROUP BY 1) SELECT a AS action, coalesce(files, 0) AS files FROM (SELECT unnest([" + ", ".join(map(_q, P.ACTIONS)) + "]) AS a) LEFT JOIN n ON action = a")
def policy_by_action(spark, sf_dir):
    return P.by_action(_decided(spark, sf_dir, RULES))


@R.add("policy_strict", _decided_sql(_HITS + _MORE) + " SELECT file_id, action, rule, CASE WHEN action IN ('allow', 'redact', 'prepare-locally') THEN true ELSE false END AS visible FROM d")
def policy_strict(spark, sf_dir):
    """The same rules with stricter ones after them: they can only raise a decision."""
    return _decided(spark, sf_dir, RULES + STRICT).select("file_id", "action", "rule", F.col("action").isin(*P.VISIBLE).alias("visible"))


def _redact_sql(c: str) -> str:
    for _, category, _, p in DETECTORS:
        c = f"regexp_replace({c}, {_q(p)}, '«REDACTED:{category}»', 'g')"
    return c


@R.add("transform_redacted", f"SELECT file_id, sha256({_redact_sql('content')}) AS out_hash FROM scanned_files WHERE content IS NOT NULL")
def transform_redacted(spark, sf_dir):
    return table(spark, sf_dir, "scanned_files").filter("content is not null").select("file_id", F.sha2(X.redacted(F.col("content")), 256).alias("out_hash"))


@R.add("transform_redacted_spans")
def transform_redacted_spans(spark, sf_dir):
    """Every file with all its secret places, merged, replaced; no SQL: DuckDB's patterns have no places. Tested against brute force."""
    f = table(spark, sf_dir, "scanned_files").filter(F.col("content").isNotNull()).select("file_id", X.redacted_spans(F.col("content")).alias("r"))
    return f.select("file_id", F.col("r.count").alias("places"), F.sha2("r.text", 256).alias("out_hash"))


@R.add("transform_key_material", f"SELECT file_id, sha256(regexp_replace(content, {_q(X.PEM)}, '«KEY»', 'g')) AS out_hash, len(regexp_extract_all(content, {_q(X.PEM)})) AS keys FROM scanned_files WHERE contains(content, 'PRIVATE KEY-----')")
def transform_key_material(spark, sf_dir):
    f = table(spark, sf_dir, "scanned_files").filter(F.contains("content", F.lit("PRIVATE KEY-----")))
    return f.select("file_id", F.sha2(X.key_material_masked(F.col("content")), 256).alias("out_hash"), F.regexp_count("content", F.lit(X.PEM)).cast("long").alias("keys"))


@R.add("transform_literals", "SELECT doc_id, CASE WHEN coalesce(workspace, '') <> '' THEN replace(t, workspace, '«WORKSPACE»') ELSE t END AS out FROM (SELECT doc_id, workspace, CASE WHEN coalesce(source, '') <> '' THEN replace(relpath, source, '«SOURCE»') ELSE relpath END AS t FROM documents)")
def transform_literals(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.literals_replaced(F.col("relpath"), [(F.col("source"), "SOURCE"), (F.col("workspace"), "WORKSPACE")]).alias("out"))


@R.add("transform_pseudonyms", "SELECT roster_id, 'STU-' || upper(sha256('salt' || chr(0) || student_id)[:6]) AS alias, 'INS-' || upper(sha256('salt' || chr(0) || instructor)[:6]) AS teacher FROM roster")
def transform_pseudonyms(spark, sf_dir):
    return table(spark, sf_dir, "roster").select("roster_id", X.pseudonym("STU", F.col("student_id"), "salt").alias("alias"), X.pseudonym("INS", F.col("instructor"), "salt").alias("teacher"))


@R.add("transform_env_sanitised", rf"""WITH l AS (SELECT file_id, string_split_regex(content, '\r?\n') AS s FROM scanned_files WHERE regexp_matches(relpath, '\.env') AND content IS NOT NULL)
SELECT file_id, array_to_string(list_transform(s, lambda x: CASE WHEN strpos(x, '=') > 1 AND NOT regexp_matches(x, '^\s*(#|$)') AND regexp_matches(regexp_replace(trim(split_part(x, '=', 1), ' '), '^export\s+', ''), '^[A-Za-z_][A-Za-z0-9_]*$')
  AND NOT (NOT regexp_matches(regexp_replace(trim(split_part(x, '=', 1), ' '), '^export\s+', ''), {_q(X.SENSITIVE_NAME)}) AND regexp_matches(regexp_replace(trim(split_part(x, '=', 1), ' '), '^export\s+', ''), {_q(X.SAFE_NAME)}) AND length(trim(x[strpos(x, '=') + 1:], ' ')) <= 256 AND NOT regexp_matches(x[strpos(x, '=') + 1:], {_q(X.KEY_BLOCK)}))
  THEN split_part(x, '=', 1) || '=${{' || regexp_replace(trim(split_part(x, '=', 1), ' '), '^export\s+', '') || '}}' ELSE x END), chr(10)) AS out FROM l""")
def transform_env_sanitised(spark, sf_dir):
    f = table(spark, sf_dir, "scanned_files").filter(F.col("relpath").rlike(r"\.env") & F.col("content").isNotNull())
    return f.select("file_id", X.env_sanitised(F.col("content")).alias("out"))


@R.add("transform_chunks")
def transform_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.select("doc_id", F.posexplode(X.chunks(F.col("text"), 2000)).alias("chunk", "part")).select("doc_id", "chunk", F.char_length("part").alias("size"), F.sha2("part", 256).alias("part_hash"))


@R.add("transform_thoughts", r"SELECT doc_id, regexp_replace(t, '(?i)^(?:\s*<think>[\s\S]*?</think>)+\s*', '') = text AS same FROM (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN '<think>plan</think> <THINK>more</think>' ELSE '' END || text AS t FROM documents WHERE text <> '' AND NOT regexp_matches(text, '^\s'))")
def transform_thoughts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter((F.col("text") != "") & ~F.col("text").rlike(r"\A\s"))
    t = F.concat(F.when(F.col("doc_id") % 2 == 0, "<think>plan</think> <THINK>more</think>").otherwise(""), "text")
    return d.select("doc_id", (X.thoughts_stripped(t)["text"] == F.col("text")).alias("same"))


@R.add("transform_shape_counts", "SELECT record_id, loaded_at, " + ", ".join(f"len(regexp_extract_all(teacher_note, {_q(p)})) AS {k.replace('-', '_')}" for k, p, _ in X.SHAPES) + " FROM student_scores WHERE teacher_note IS NOT NULL")
def transform_shape_counts(spark, sf_dir):
    s = table(spark, sf_dir, "student_scores").filter("teacher_note is not null")
    return s.select("record_id", "loaded_at", X.shape_counts(F.col("teacher_note")).alias("c")).select("record_id", "loaded_at", "c.*")


@R.add("transform_deidentified")
def transform_deidentified(spark, sf_dir):
    s = table(spark, sf_dir, "student_scores").filter("teacher_note is not null")
    return s.select("record_id", "loaded_at", X.deidentified(F.col("teacher_note")).alias("note"))


@R.add("transform_json_deidentified")
def transform_json_deidentified(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("content_kind = 'json' and text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return d.filter("line <> ''").select("doc_id", "n", X.json_deidentified(F.col("line")).alias("record"))


@R.add("transform_routes")
def transform_routes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null").select("source", X.content_route(F.col("text")).alias("route"))
    return d.groupBy("source", "route").agg(F.count("*").alias("docs"))


@R.add("transform_public_ids", r"SELECT doc_id, 'doc-' || sha256('salt:document:' || relpath)[:12] || CASE WHEN regexp_matches(relpath, '\.(md|txt|json|jsonl|log)$') THEN regexp_extract(relpath, '(\.[a-z]+)$', 1) ELSE '' END AS public_id FROM documents WHERE relpath IS NOT NULL")
def transform_public_ids(spark, sf_dir):
    ext = F.when(F.col("relpath").rlike(r"\.(md|txt|json|jsonl|log)$"), F.regexp_extract("relpath", r"(\.[a-z]+)$", 1)).otherwise("")
    return table(spark, sf_dir, "documents").filter("relpath is not null").select("doc_id", F.concat(F.lit("doc-"), F.sha2(F.concat(F.lit("salt:document:"), "relpath"), 256).substr(1, 12), ext).alias("public_id"))


@R.add("transform_path_pseudonyms")
def transform_path_pseudonyms(spark, sf_dir):
    """Paths with pseudonyms for ids; paths that become equal get a number each."""
    from weirflow.operators.ordering import rank_in_group

    d = table(spark, sf_dir, "documents").filter("relpath is not null").select("doc_id", X.path_pseudonym(F.col("relpath")).alias("alias"))
    return rank_in_group(d, ["alias"], ["doc_id"], "n").select("doc_id", F.when(F.col("n") > 1, F.concat("alias", F.lit("-"), F.col("n").cast("string"))).otherwise(F.col("alias")).alias("alias"))
