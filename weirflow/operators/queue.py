"""Background work as tables: requests are queued once per key, the next ones are chosen by priority within a bound for each kind, and lost ones go back.

A queue row has key, kind, priority, asked_at. Null priorities are the least. Ties are settled by asked_at, then key, so every result is determined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.operators.ordering import rank_in_group


def enqueued(requests: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first request holds, with the highest priority that any request of the key has, and asked (how often). Combined partially, so a key that is asked for very often is one small aggregate."""
    rest = [c for c in requests.columns if c not in (*keys, "priority")]
    g = requests.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"), F.max("priority").alias("priority"), F.count("*").alias("asked"))
    return g.select(*keys, "_first.*", "priority", "asked")


def next_items(queue: DataFrame, key: str, most: int) -> DataFrame:
    """The rows that may run next: of each kind the most urgent ones, at most so many, with their place. Ranks are taken over ranges of a kind, so one kind may hold any share of the queue."""
    x = queue.withColumn("_p", -F.coalesce(F.col("priority"), F.lit(float("-inf"))))
    return rank_in_group(x, ["kind"], ["_p", "asked_at", key], "place").filter(F.col("place") <= most).drop("_p")


def states(events: DataFrame, keys: list[str], order: list[str], timeout_seconds: int) -> DataFrame:
    """State of each key after its last event (column event: queued, running, done, failed), as seen at the latest event of all: keys, state, tries. A key that has been running for longer than the timeout is queued again (lost)."""
    last = events.groupBy(*keys).agg(F.max_by(F.struct("event", "ts"), F.struct(*order)).alias("x"), F.count_if(F.col("event") == "running").alias("tries"))
    now = events.agg(F.max("ts").alias("now"))  # one row
    lost = (F.col("x.event") == "running") & (F.col("x.ts") < F.col("now") - F.make_interval(secs=F.lit(timeout_seconds)))
    return last.crossJoin(F.broadcast(now)).select(*keys, F.when(lost, "lost").otherwise(F.col("x.event")).alias("state"), "tries")


def in_batches(queue: DataFrame, key: str, size: int) -> DataFrame:
    """queue with batch (from 0): rows in order of urgency, so many a batch."""
    w = rank_in_group(queue.withColumn("_p", -F.coalesce(F.col("priority"), F.lit(float("-inf")))), [], ["_p", "asked_at", key], "place")
    return w.withColumn("batch", F.floor((F.col("place") - 1) / size).cast("long")).drop("_p", "place")
