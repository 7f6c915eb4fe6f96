"""Queries of garbled text."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow.llm import encoding as E
from weirflow.plans.registry import Registry
from weirflow.sources.tables import table

R = Registry()
FIELDS = (("delimited_rows", "row_id", "raw"), ("student_scores", "record_id", "teacher_note"))


def _all(spark, sf_dir):
    parts = [E.garbled_rows(table(spark, sf_dir, t), k, f).select(F.lit(t).alias("tbl"), F.col(k).alias("row_key"), F.lit(f).alias("field"), "restored", "pairs") for t, k, f in FIELDS]
    return parts[0].unionByName(parts[1])


@R.add("p4_found")
def p4_found(spark, sf_dir):
    return _all(spark, sf_dir).select("tbl", "row_key", "field").distinct()


@R.add("p4_restored")
def p4_restored(spark, sf_dir):
    return _all(spark, sf_dir).groupBy("tbl", "row_key", "field").agg(F.min("restored").alias("restored"), F.min("pairs").alias("pairs"))


@R.add("p4_pair_report")
def p4_pair_report(spark, sf_dir):
    return _all(spark, sf_dir).groupBy("tbl", "pairs").agg(F.countDistinct("row_key").alias("records"))
