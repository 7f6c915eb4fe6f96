"""Ranks, running sums and first rows per group without putting a group into one task.

Rows are ranged by (group, order) over the partitions; what precedes a partition is added from a table of partition totals. A group of any size is spread
over as many partitions as it fills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ranged(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The partition of a row must not depend on a later plan: the rows are written once.
    from weirflow.session import cut

    return cut(df.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id()))


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of value over the rows of the group up to and with this row; null values count as 0. order must name every row of a group apart."""
    r = _ranged(df, group, order)
    here = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    per = r.groupBy("_part", *group).agg(F.coalesce(F.sum(value), F.lit(0)).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    off = per.select("_part", *group, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    on = [r["_part"] == off["_part"], *(r[g].eqNullSafe(off[g]) for g in group)]
    out = r.join(off, on, "left").select(r["*"], off["_before"])
    return out.withColumn(name, F.coalesce(F.sum(value).over(here), F.lit(0)) + F.col("_before")).drop("_part", "_before")


def rank_in_group(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df with the place (from 1) of each row in its group."""
    return running_sum(df.withColumn("_one", F.lit(1)), group, order, "_one", name).drop("_one").withColumn(name, F.col(name).cast("long"))


def previous_in_group(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with value of the row before each row of the group (null for its first row). order must name every row of a group apart; nulls come first."""
    r = _ranged(df, group, order)
    here = Window.partitionBy("_part", *group).orderBy(*order)
    last = r.groupBy("_part", *group).agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    off = last.select("_part", *group, F.lag("_last").over(Window.partitionBy(*group).orderBy("_part")).alias("_before"))
    on = [r["_part"] == off["_part"], *(r[g].eqNullSafe(off[g]) for g in group)]
    out = r.join(off, on, "left").select(r["*"], off["_before"])
    return out.withColumn(name, F.coalesce(F.lag(F.struct(value)).over(here), F.col("_before"))[value]).drop("_part", "_before")
