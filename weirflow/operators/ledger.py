"""Records of deliveries and retrievals: tallies, the latest state, pinned first deliveries, what may be fetched, plans for the next delivery.

Records are append-only rows with an order that tells any two apart. Latest and first rows of a key are partial aggregates (max_by, min_by), never sorted groups. Null kinds are counted under null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The most that one retrieval gives.
MOST_LINES, MOST_OCTETS, MOST_TOKENS = 300, 32_768, 8_000


def latest(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """keys, columns of the last row, and the number of rows."""
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_x"), F.count("*").alias("records"))
    return g.select(*keys, "_x.*", "records")


def pinned(df: DataFrame, keys: list[str], order: list[str], value: str, passed: Column) -> DataFrame:
    """df with pinned: the value of the first row of the key that passed its gates; null where none did."""
    first = df.filter(passed).groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias("pinned"))
    return df.join(first, keys, "left")


def kept(df: DataFrame, at: str, days: int) -> DataFrame:
    """Rows of the last days before the latest one; rows without a time stay."""
    last = df.agg(F.max(at).alias("_last"))
    return df.crossJoin(F.broadcast(last)).filter(F.col(at).isNull() | (F.col(at) >= F.col("_last") - F.expr(f"INTERVAL {days} DAYS"))).drop("_last")  # last is one row


def served(first: Column, last: Column, octets: Column, tokens: Column) -> Column:
    """Verdict on a retrieval: ok, or the bound that it exceeds and the last line that may be asked for."""
    return F.when(last < first, "empty").when(last - first + 1 > MOST_LINES, F.concat(F.lit("lines: ask to L"), (first + MOST_LINES - 1).cast("string"))).when(octets > MOST_OCTETS, "octets").when(tokens > MOST_TOKENS, "tokens").otherwise("ok")


def repeated_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, first, last, work of the distinct ranges of an object: contained in another one, overlapping one that begins before it, or new. One pass over the ranges of an object in their order: only the farthest end so far is needed, no pairs are made."""
    before = Window.partitionBy(*keys).orderBy("first", F.col("last").desc()).rowsBetween(Window.unboundedPreceding, -1)
    x = ranges.select(*keys, "first", "last").distinct().withColumn("_reach", F.max("last").over(before))
    work = F.when(F.col("_reach") >= F.col("last"), "contained").when(F.col("_reach") >= F.col("first"), "overlapping").otherwise("new")
    return x.select(*keys, "first", "last", work.alias("work"))


def intent(tool: Column) -> Column:
    t = F.lower(tool)
    return F.when(t.isin("grep", "search", "glob"), "find").when(t.isin("read", "view", "cat"), "read").when(t.isin("bash", "shell", "run"), "execute").when(t.isin("edit", "write"), "change").otherwise("other")


def plan(kind: Column, tokens: Column, budget: Column, seen: Column, intent_: Column) -> Column:
    """Rule by which a result is delivered; the first that applies."""
    return (
        F.when(tokens == 0, "pass:empty")
        .when(seen, "reference:delivered-before")
        .when(tokens > budget, "reference:over-budget")
        .when(kind == "json", "compress:structured")
        .when((intent_ == "find") & (tokens > 400), "compress:search")
        .when((kind == "test-output") & (tokens > 400), "compress:test")
        .when(kind.isin("log", "text", "markdown") & (tokens <= 20_000) & (intent_ == "read"), "pass:scan-guard")
        .when(tokens > 2_000, "compress:window")
        .otherwise("pass:small")
    )
