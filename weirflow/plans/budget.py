"""Queries of sizes, savings and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow.functions.text import half_up, token_estimate
from weirflow.operators import budget as B
from weirflow.operators.ordering import rank_in_group, running_sum
from weirflow.plans.registry import Registry
from weirflow.plans.views import _CLASS, tokens_sql
from weirflow.sources.tables import table

R = Registry()
_RANK = r"CASE WHEN regexp_matches(relpath, '(?i)(^|/)(index|main|app)\.[a-z]+$') THEN 0 WHEN regexp_matches(relpath, '(?i)\.(json|ya?ml|toml|env|properties)$|(^|/)\.env') THEN 1 WHEN regexp_matches(relpath, '(?i)(^|/)(src|lib)/') THEN 2 WHEN regexp_matches(relpath, '(?i)(^|/)(tests?|scripts)/') THEN 3 ELSE 4 END"


@R.add("budget_token_estimates", f"SELECT doc_id, {tokens_sql('text')} AS tokens, ceil(length(text) / 4.0)::BIGINT AS flat_tokens, strlen(text) AS octets, length(text) AS code_points FROM documents WHERE text IS NOT NULL")
def budget_token_estimates(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").filter(t.isNotNull()).select("doc_id", token_estimate(t).alias("tokens"), F.ceil(F.char_length(t) / 4).alias("flat_tokens"), F.octet_length(t).cast("long").alias("octets"), F.char_length(t).cast("long").alias("code_points"))


@R.add(
    "budget_reduction_report",
    f"WITH x AS (SELECT workspace, {tokens_sql('content')} AS b, {tokens_sql('redacted')} AS a FROM redact_results JOIN scanned_files USING (file_id) WHERE content IS NOT NULL AND redacted IS NOT NULL) SELECT workspace, sum(b)::BIGINT AS tokens_before, sum(a)::BIGINT AS tokens_after, (sum(b) - sum(a))::BIGINT AS saved, round((sum(b) - sum(a)) * 100 / sum(b), 1) AS percent, round(sum(a) / 1000 * 0.003, 6) AS cost FROM x GROUP BY 1",
)
def budget_reduction_report(spark, sf_dir):
    f = table(spark, sf_dir, "scanned_files").filter("content is not null").select("file_id", "workspace", token_estimate(F.col("content")).alias("b"))
    r = table(spark, sf_dir, "redact_results").filter("redacted is not null").select("file_id", token_estimate(F.col("redacted")).alias("a"))
    g = f.join(r, "file_id").groupBy("workspace").agg(F.sum("b").alias("tokens_before"), F.sum("a").alias("tokens_after"))
    x = g.withColumn("r", B.reduction(F.col("tokens_before"), F.col("tokens_after")))
    return x.select("workspace", "tokens_before", "tokens_after", "r.saved", "r.percent", F.round(F.col("tokens_after") / 1000 * 0.003, 6).alias("cost"))


_SEL = f"""WITH f AS (SELECT workspace, file_id, {_RANK} AS rank, size FROM scanned_files), d AS (SELECT *, CASE WHEN rank > 0 THEN coalesce(size, 0) ELSE 0 END AS d, sum(coalesce(size, 0)) OVER (PARTITION BY workspace) AS total FROM f),
 r AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY workspace ORDER BY rank DESC, size DESC, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d), k AS (SELECT workspace, file_id, rank, size, rank = 0 OR total - before <= 60000 AS keep FROM r)"""


def _selected(spark, sf_dir):
    f = table(spark, sf_dir, "scanned_files").select("workspace", "file_id", B.importance(F.col("relpath")).alias("rank"), "size")
    return B.selection(f, "workspace", "file_id", "rank", "size", 60_000)


@R.add("budget_selection", _SEL + " SELECT workspace, file_id, rank, size, keep FROM k")
def budget_selection(spark, sf_dir):
    return _selected(spark, sf_dir)


@R.add("budget_summary", _SEL + " SELECT workspace, count(*) AS files, count_if(keep) AS kept, sum(size)::BIGINT AS full_size, coalesce(sum(size) FILTER (WHERE keep), 0)::BIGINT AS kept_size, CASE WHEN coalesce(sum(size) FILTER (WHERE keep), 0) <= 60000 THEN 'met' ELSE 'unmet' END AS status FROM k GROUP BY 1")
def budget_summary(spark, sf_dir):
    g = _selected(spark, sf_dir).groupBy("workspace").agg(F.count("*").alias("files"), F.count_if("keep").alias("kept"), F.sum("size").alias("full_size"), F.coalesce(F.sum(F.when(F.col("keep"), F.col("size"))), F.lit(0)).alias("kept_size"))
    return g.withColumn("status", F.when(F.col("kept_size") <= 60_000, "met").otherwise("unmet"))


@R.add("budget_session_running", "SELECT event_id, user_id, sum(length(props)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS used, 100000 - sum(length(props)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS remaining FROM events")
def budget_session_running(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.char_length("props").cast("long").alias("n"))
    return running_sum(e, ["user_id"], ["ts", "event_id"], "n", "used").select("event_id", "user_id", "used", (100_000 - F.col("used")).alias("remaining"))


@R.add("budget_repeated_work", "SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS repeats, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 3 AS hint FROM events")
def budget_repeated_work(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return rank_in_group(e, ["user_id", "event_type"], ["ts", "event_id"], "place").select("event_id", "user_id", "event_type", (F.col("place") - 1).alias("repeats"), (F.col("place") == 3).alias("hint"))


@R.add("budget_generation_cache", "SELECT event_type, count(*) AS requests, count_if(event_id > first) AS hits FROM (SELECT event_id, event_type, min(event_id) OVER (PARTITION BY user_id, event_type) AS first FROM events) GROUP BY 1")
def budget_generation_cache(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return B.first_uses(e, ["user_id", "event_type"], "event_id").groupBy("event_type").agg(F.count("*").alias("requests"), F.count_if("hit").alias("hits"))


@R.add("budget_context_savings", "SELECT workspace, sum(floor(strlen(coalesce(content, '')) / 4.0 + 0.5))::BIGINT AS before_tokens, coalesce(sum(floor(strlen(redacted) / 4.0 + 0.5)), 0)::BIGINT AS after_tokens, count(redacted) AS replaced FROM scanned_files LEFT JOIN redact_results USING (file_id) GROUP BY 1")
def budget_context_savings(spark, sf_dir):
    j = table(spark, sf_dir, "scanned_files").select("file_id", "workspace", half_up(F.octet_length(F.coalesce("content", F.lit(""))) / 4).alias("b")).join(table(spark, sf_dir, "redact_results").select("file_id", half_up(F.octet_length("redacted") / 4).alias("a")), "file_id", "left")
    return j.groupBy("workspace").agg(F.sum("b").alias("before_tokens"), F.coalesce(F.sum("a"), F.lit(0)).alias("after_tokens"), F.count("a").alias("replaced"))


@R.add("budget_prepared_metrics", "SELECT workspace, count(*) AS files, count_if(is_symlink) AS links, count_if(content IS NULL AND NOT is_symlink) AS unread, count_if(coalesce(tracked, false)) AS tracked, count_if(len(findings) > 0) AS with_findings, coalesce(sum(len(findings)), 0)::BIGINT AS findings, count_if(len(list_filter(findings, lambda f: f.severity IN ('critical', 'high'))) > 0) AS sensitive FROM scanned_files GROUP BY 1")
def budget_prepared_metrics(spark, sf_dir):
    f = table(spark, sf_dir, "scanned_files").select("workspace", "is_symlink", F.col("content").isNull().alias("none"), "tracked", "findings")
    n = F.coalesce(F.array_size("findings"), F.lit(0))
    return f.groupBy("workspace").agg(
        F.count("*").alias("files"), F.count_if("is_symlink").alias("links"), F.count_if(F.col("none") & ~F.col("is_symlink")).alias("unread"), F.count_if(F.coalesce("tracked", F.lit(False))).alias("tracked"), F.count_if(n > 0).alias("with_findings"),
        F.sum(n.cast("long")).alias("findings"), F.count_if(F.coalesce(F.exists("findings", lambda x: x["severity"].isin("critical", "high")), F.lit(False))).alias("sensitive"),
    )


_LEVEL = "CASE WHEN len(list_filter(coalesce(findings, []), lambda f: f.severity IN ('critical', 'high'))) > 0 THEN 'restricted' WHEN len(coalesce(findings, [])) > 0 THEN 'confidential' WHEN content IS NULL THEN 'unknown' ELSE 'public' END"


@R.add("budget_readiness", f"SELECT workspace, round(count_if(level = 'public') * 100.0 / count(*), 1) AS ready_percent, greatest(1, 5 - count_if(level = 'restricted')) AS stars FROM (SELECT workspace, {_LEVEL} AS level FROM scanned_files) GROUP BY 1")
def budget_readiness(spark, sf_dir):
    x = F.coalesce(F.col("findings"), F.array().cast("array<struct<detector:string,line:int,severity:string,masked_preview:string>>"))
    level = F.when(F.exists(x, lambda f: f["severity"].isin("critical", "high")), "restricted").when(F.size(x) > 0, "confidential").when(F.col("content").isNull(), "unknown").otherwise("public")
    g = table(spark, sf_dir, "scanned_files").select("workspace", level.alias("level")).groupBy("workspace")
    return g.agg(F.round(F.count_if(F.col("level") == "public") * 100.0 / F.count("*"), 1).alias("ready_percent"), F.greatest(F.lit(1), 5 - F.count_if(F.col("level") == "restricted")).alias("stars"))


@R.add("budget_overview", r"SELECT module, count(*) AS files, sum(size)::BIGINT AS size FROM (SELECT split_part(relpath, '/', 2) AS module, size FROM scanned_files) GROUP BY 1 ORDER BY files DESC, module LIMIT 8")
def budget_overview(spark, sf_dir):
    """The eight modules with most files (a report of the top ones)."""
    f = table(spark, sf_dir, "scanned_files").select(F.split_part("relpath", F.lit("/"), F.lit(2)).alias("module"), "size")
    return f.groupBy("module").agg(F.count("*").alias("files"), F.sum("size").alias("size")).orderBy(F.desc("files"), "module").limit(8)


@R.add("budget_medians", "SELECT event_type, count(*) AS n, median(round(value)) AS median_value, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 4) AS success_rate, median(round(value)) <= 100 AS within FROM events GROUP BY 1")
def budget_medians(spark, sf_dir):
    """Medians of whole numbers: partial aggregates keep a count per distinct number, so their size doesn't grow with the rows."""
    e = table(spark, sf_dir, "events").select("event_type", F.round("value").alias("v"), "value")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.median("v").alias("median_value"), F.round(F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)), 4).alias("success_rate"), (F.median("v") <= 100).alias("within"))
