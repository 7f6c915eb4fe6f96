"""Queries of delivery records and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow.functions.text import token_estimate
from weirflow.operators import ledger as L
from weirflow.operators import policy as P
from weirflow.operators import views as V
from weirflow.plans.registry import Registry
from weirflow.plans.views import _HITS, _RANGES, tokens_sql
from weirflow.sources.tables import table

R = Registry()


@R.add("ledger_tallies", "SELECT event_type, count(*) AS records, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY 1")
def ledger_tallies(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return per.groupBy("event_type").agg(F.sum("n").alias("records"), F.count("user_id").alias("users"), F.round(F.sum("v"), 4).alias("total"))


@R.add("ledger_latest", "SELECT user_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS event_type, arg_max(value, {'t': ts, 'e': event_id}) AS value, count(*) AS records FROM events GROUP BY 1")
def ledger_latest(spark, sf_dir):
    return L.latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "value"])


@R.add("ledger_pinned", "SELECT event_id, e.user_id, p.pinned FROM events e LEFT JOIN (SELECT user_id, event_type, arg_min(sha256(props), {'t': ts, 'e': event_id}) AS pinned FROM events WHERE value > 20 GROUP BY ALL) p ON e.user_id = p.user_id AND e.event_type = p.event_type")
def ledger_pinned(spark, sf_dir):
    """What every delivery of a key has to repeat: the first that passed."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.sha2("props", 256).alias("h"), "value")
    return L.pinned(e, ["user_id", "event_type"], ["ts", "event_id"], "h", F.col("value") > 20).select("event_id", "user_id", "pinned")


@R.add("ledger_kept", "SELECT event_type, count(*) AS records FROM events WHERE ts IS NULL OR ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAYS GROUP BY 1")
def ledger_kept(spark, sf_dir):
    return L.kept(table(spark, sf_dir, "events").select("event_type", "ts"), "ts", 30).groupBy("event_type").agg(F.count("*").alias("records"))


@R.add("ledger_usage", "SELECT doc_id, list_last(regexp_extract_all(text, '\"tokens\": ([0-9]+)', 1))::BIGINT AS tokens, len(regexp_extract_all(text, '\"tokens\": ([0-9]+)', 1)) AS records FROM documents WHERE regexp_matches(text, '\"tokens\": [0-9]+')")
def ledger_usage(spark, sf_dir):
    """The last usage figure that a text states."""
    all_of = F.regexp_extract_all("text", F.lit('"tokens": ([0-9]+)'), F.lit(1))
    d = table(spark, sf_dir, "documents").select("doc_id", all_of.alias("a")).filter(F.size("a") > 0)
    return d.select("doc_id", F.element_at("a", -1).cast("long").alias("tokens"), F.size("a").cast("long").alias("records"))


@R.add("ledger_retrievals", f"WITH x AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, strlen(text) AS o, {tokens_sql('text')} AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN n < 1 THEN 'empty' WHEN n > 300 THEN 'lines: ask to L300' WHEN o > 32768 THEN 'octets' WHEN t > 8000 THEN 'tokens' ELSE 'ok' END AS verdict FROM x")
def ledger_retrievals(spark, sf_dir):
    t = F.col("text")
    d = table(spark, sf_dir, "documents").filter(t.isNotNull())
    return d.select("doc_id", L.served(F.lit(1), F.size(F.split(t, "\n", -1)), F.octet_length(t), token_estimate(t)).alias("verdict"))


def _asked(spark, sf_dir):
    """Omitted ranges of search results, and the ranges asked for: each of them, and the same moved by a line."""
    r = V.ranges(V.search_dropped(V.search_hits(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id"), "doc_id").select("doc_id", "first", "last")
    return r, r.unionByName(r.select("doc_id", (F.col("first") + 1).alias("first"), (F.col("last") + 1).alias("last")))


_ASKED = f"WITH {_HITS}, rng AS ({_RANGES}), asked AS (SELECT doc_id, first, last FROM rng UNION ALL SELECT doc_id, first + 1, last + 1 FROM rng)"


@R.add("ledger_within_exposed", f"{_ASKED} SELECT doc_id, first, last, EXISTS (SELECT 1 FROM rng r WHERE r.doc_id = a.doc_id AND a.first >= r.first AND a.last <= r.last) AS allowed FROM asked a")
def ledger_within_exposed(spark, sf_dir):
    """Ranges asked for (every omitted range, and the same moved by a line) and whether an exposed range of the text holds them. Exposed ranges of a text don't overlap, so each asked range meets at most one: the last that begins before it."""
    r, asked = _asked(spark, sf_dir)
    asked = asked.select("doc_id", F.col("first").alias("f"), F.col("last").alias("l"))
    exposed = r.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("exposed"))
    return asked.join(exposed, "doc_id", "left").select("doc_id", F.col("f").alias("first"), F.col("l").alias("last"), F.exists("exposed", lambda e: P.within(F.col("f"), F.col("l"), e["first"], e["last"])).alias("allowed"))


@R.add(
    "ledger_repeated_retrievals",
    f"{_ASKED} SELECT doc_id, first, last, CASE WHEN EXISTS (SELECT 1 FROM asked b WHERE b.doc_id = a.doc_id AND b.first <= a.first AND b.last >= a.last AND (b.first < a.first OR b.last > a.last)) THEN 'contained' WHEN EXISTS (SELECT 1 FROM asked b WHERE b.doc_id = a.doc_id AND (b.first < a.first OR b.first = a.first AND b.last > a.last) AND b.last >= a.first) THEN 'overlapping' ELSE 'new' END AS work FROM (SELECT DISTINCT * FROM asked) a",
)
def ledger_repeated_retrievals(spark, sf_dir):
    """How much of each range asked for was asked for before it in the text: all (contained), a part (overlapping), nothing (new)."""
    return L.repeated_ranges(_asked(spark, sf_dir)[1], ["doc_id"])


_INTENT = "CASE WHEN lower(tool) IN ('grep', 'search', 'glob') THEN 'find' WHEN lower(tool) IN ('read', 'view', 'cat') THEN 'read' WHEN lower(tool) IN ('bash', 'shell', 'run') THEN 'execute' WHEN lower(tool) IN ('edit', 'write') THEN 'change' ELSE 'other' END"


@R.add(
    "ledger_plans",
    f"""WITH x AS (SELECT doc_id, content_kind AS kind, {tokens_sql('text')} AS tokens, CASE source WHEN 'search-tool' THEN 'Grep' WHEN 'ci-runner' THEN 'Bash' ELSE 'Read' END AS tool, sha256(text) AS h FROM documents WHERE text IS NOT NULL),
 s AS (SELECT *, {_INTENT} AS intent, doc_id > min(doc_id) OVER (PARTITION BY h) AS seen FROM x)
SELECT doc_id, intent, CASE WHEN tokens = 0 THEN 'pass:empty' WHEN seen THEN 'reference:delivered-before' WHEN tokens > 10000 THEN 'reference:over-budget' WHEN kind = 'json' THEN 'compress:structured' WHEN intent = 'find' AND tokens > 400 THEN 'compress:search' WHEN kind = 'test-output' AND tokens > 400 THEN 'compress:test'
 WHEN kind IN ('log', 'text', 'markdown') AND tokens <= 20000 AND intent = 'read' THEN 'pass:scan-guard' WHEN tokens > 2000 THEN 'compress:window' ELSE 'pass:small' END AS plan FROM s""",
)
def ledger_plans(spark, sf_dir):
    t = F.col("text")
    d = table(spark, sf_dir, "documents").filter(t.isNotNull()).select("doc_id", F.col("content_kind").alias("kind"), token_estimate(t).alias("tokens"), F.when(F.col("source") == "search-tool", "Grep").when(F.col("source") == "ci-runner", "Bash").otherwise("Read").alias("tool"), F.sha2(t, 256).alias("h"))
    from weirflow.operators.budget import first_uses

    x = first_uses(d, ["h"], "doc_id").withColumn("intent", L.intent(F.col("tool")))
    return x.select("doc_id", "intent", L.plan(F.col("kind"), F.col("tokens"), F.lit(10_000), F.col("hit"), F.col("intent")).alias("plan"))


@R.add("ledger_snapshot", "SELECT event_type, date_trunc('day', ts) AS day, count(*) AS records, count_if(value > 100) AS large, max(length(props)) AS longest FROM events GROUP BY ALL")
def ledger_snapshot(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("records"), F.count_if(F.col("value") > 100).alias("large"), F.max(F.char_length("props")).alias("longest"))
