"""Queries of personal data in text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm import personal as P
from weirflow.plans.registry import Registry
from weirflow.session import widen
from weirflow.sources.tables import table

R = Registry()
#: Table, key, field, and the kinds that don't count there.
FIELDS = (("student_scores", "record_id", "teacher_note", ()), ("student_scores", "record_id", "name", ("name",)), ("customer_list", "list_id", "email", ()))


def _each(spark, sf_dir, judge) -> DataFrame:
    """judge(text, frequent words, kinds) of each field: tbl, row_key, field, x. Word frequencies are counted where names are looked for."""
    parts = []
    for tbl, key, field, without in FIELDS:
        t = table(spark, sf_dir, tbl).select(key, field)
        frequent = frozenset() if "name" in without else P.frequent_words(t.select(F.col(field).alias("text")))
        kinds = tuple(k for k in P.KINDS if k not in without)
        parts.append(widen(t).select(F.lit(tbl).alias("tbl"), F.col(key).alias("row_key"), F.lit(field).alias("field"), judge(F.col(field), frequent, kinds).alias("x")))
    return reduce(DataFrame.unionByName, parts)


@R.add("p3_found")
def p3_found(spark, sf_dir):
    return _each(spark, sf_dir, P.kinds_found).select("tbl", "row_key", "field", F.explode("x").alias("kind")).distinct()


@R.add("p3_redacted")
def p3_redacted(spark, sf_dir):
    return _each(spark, sf_dir, P.replaced).withColumnRenamed("x", "text").distinct()


@R.add("p3_kind_report")
def p3_kind_report(spark, sf_dir):
    return p3_found(spark, sf_dir).groupBy("tbl", "field", "kind").agg(F.count("*").alias("values"))
