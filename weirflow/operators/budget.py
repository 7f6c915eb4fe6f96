"""Sizes, savings and budgets of prepared files and sessions.

Null sizes count as 0. Ties are settled by the key, so every result is determined. Running sums and places in a group are computed over ranges of it
(see ordering), so a workspace or user with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.operators.ordering import running_sum


def reduction(before: Column, after: Column) -> Column:
    """struct<saved, percent>: signed, not clamped; percent is null where nothing was there before."""
    return F.struct((before - after).alias("saved"), F.when(before > 0, F.round((before - after) * 100 / before, 1)).alias("percent"))


#: Reasons to keep a file, in the order in which they are tried, as (reason, rank); others rank by what they are.
KEEP = (("entry", 0), ("config", 1), ("policy", 2))


def importance(path: Column) -> Column:
    """Rank of a file: 0 must be kept; the higher, the sooner it is dropped."""
    return (
        F.when(path.rlike(r"(?i)(^|/)(index|main|app)\.[a-z]+$"), 0)
        .when(path.rlike(r"(?i)\.(json|ya?ml|toml|env|properties)$|(^|/)\.env"), 1)
        .when(path.rlike(r"(?i)(^|/)(src|lib)/"), 2)
        .when(path.rlike(r"(?i)(^|/)(tests?|scripts)/"), 3)
        .otherwise(4)
    )


def selection(files: DataFrame, group: str, key: str, rank: str, size: str, budget: int) -> DataFrame:
    """files with keep: within each group the files of the highest rank, then the largest, then by key, are dropped until the rest fits the budget. Files of rank 0 always stay."""
    total = files.groupBy(group).agg(F.coalesce(F.sum(size), F.lit(0)).alias("_total"))
    x = files.withColumn("_r", -F.col(rank)).withColumn("_s", -F.coalesce(F.col(size), F.lit(0)))
    droppable = F.when(F.col(rank) > 0, F.coalesce(F.col(size), F.lit(0))).otherwise(0)
    x = running_sum(x.withColumn("_d", droppable), [group], ["_r", "_s", key], "_d", "_upto")
    y = x.join(total, x[group].eqNullSafe(total[group])).drop(total[group])
    before = F.col("_upto") - F.col("_d")
    return y.withColumn("keep", (F.col(rank) == 0) | (F.col("_total") - before <= budget)).drop("_r", "_s", "_d", "_upto", "_total")


def first_uses(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """df with hit: whether an earlier row has the same keys. Rows are compared with their group's least order, found by partial aggregation; order must be unique."""
    first = df.groupBy(*keys).agg(F.min(order).alias("_first"))
    on = [df[k].eqNullSafe(first[k]) for k in keys]
    return df.join(first, on).select(df["*"], (df[order] > first["_first"]).alias("hit"))
