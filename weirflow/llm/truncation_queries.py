"""Queries of cut texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow.llm import truncation as T
from weirflow.plans.registry import Registry
from weirflow.session import widen
from weirflow.sources.tables import table

R = Registry()


@R.add("p9_found")
def p9_found(spark, sf_dir):
    return T.judged(widen(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))).filter("cut").select("doc_id").distinct()


@R.add("p9_source_rates")
def p9_source_rates(spark, sf_dir):
    return T.judged(widen(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))).groupBy("source").agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut_texts"), (F.count_if("cut") / F.count("*")).alias("cut_rate"))
