"""Queries of background work. A user's request for a kind of event stands for a request for work: its value is the priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow.operators import queue as W
from weirflow.plans.registry import Registry
from weirflow.sources.tables import table

R = Registry()


def _requests(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("kind"), F.col("value").alias("priority"), F.col("ts").alias("asked_at"), "event_id")


_Q = "q AS (SELECT user_id, event_type AS kind, min(event_id) FILTER (WHERE r = 1) AS event_id, min(ts) AS asked_at, max(value) AS priority, count(*) AS asked FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) GROUP BY ALL)"


@R.add("queue_enqueued", f"WITH {_Q} SELECT user_id, kind, event_id, asked_at, priority, asked FROM q")
def queue_enqueued(spark, sf_dir):
    """Each piece of work once, however often it was asked for."""
    return W.enqueued(_requests(spark, sf_dir), ["user_id", "kind"], ["asked_at", "event_id"])


@R.add("queue_next", f"WITH {_Q} SELECT kind, event_id, priority, place FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY coalesce(priority, '-infinity'::DOUBLE) DESC, asked_at, event_id) AS place FROM q) WHERE place <= 4")
def queue_next(spark, sf_dir):
    """What runs next: four of each kind at a time."""
    return W.next_items(queue_enqueued(spark, sf_dir), "event_id", 4).select("kind", "event_id", "priority", "place")


@R.add("queue_batches", f"WITH {_Q}, b AS (SELECT *, (row_number() OVER (ORDER BY coalesce(priority, '-infinity'::DOUBLE) DESC, asked_at, event_id) - 1) // 64 AS batch FROM q) SELECT batch, count(*) AS items, min(priority) AS least, max(priority) AS most FROM b GROUP BY 1")
def queue_batches(spark, sf_dir):
    """All queued work in batches of 64, the most urgent first."""
    return W.in_batches(queue_enqueued(spark, sf_dir), "event_id", 64).groupBy("batch").agg(F.count("*").alias("items"), F.min("priority").alias("least"), F.max("priority").alias("most"))


_STATE = "CASE WHEN value > 150 THEN 'done' WHEN value > 100 THEN 'failed' WHEN value > 40 THEN 'running' ELSE 'queued' END"


@R.add(
    "queue_states",
    f"WITH e AS (SELECT user_id, event_type, ts, event_id, {_STATE} AS event FROM events), l AS (SELECT user_id, event_type, arg_max(event, {{'t': ts, 'e': event_id}}) AS event, max(ts) AS ts, count_if(event = 'running') AS tries FROM e GROUP BY ALL) SELECT user_id, event_type, CASE WHEN event = 'running' AND ts < (SELECT max(ts) FROM events) - INTERVAL 3600 SECONDS THEN 'lost' ELSE event END AS state, tries FROM l",
)
def queue_states(spark, sf_dir):
    """Where each piece of work stands; what has run for over an hour is lost and may be queued again."""
    v = F.col("value")
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", F.when(v > 150, "done").when(v > 100, "failed").when(v > 40, "running").otherwise("queued").alias("event"))
    return W.states(e, ["user_id", "event_type"], ["ts", "event_id"], 3600)
