"""Queries of values written with look-alike characters."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow.llm import lookalike as L
from weirflow.plans.registry import Registry
from weirflow.sources.tables import table

R = Registry()


def _cases(spark, sf_dir):
    scores = table(spark, sf_dir, "student_scores")
    labels = table(spark, sf_dir, "table_classification").select("export_id", F.explode("direct_identifier_types").alias("label"))
    of = lambda tbl, k, field, df, col, plain: L.disguised(df, k, F.col(col), plain).select(F.lit(tbl).alias("tbl"), F.col(k).alias("row_key"), F.lit(field).alias("field"), "value", F.col("plain"))
    return (
        of("student_scores", "record_id", "name", scores, "name", False)
        .unionByName(of("student_scores", "record_id", "student_id", scores, "student_id", True))
        .unionByName(of("table_classification", "export_id", "direct_identifier_types", labels, "label", True))
    )


@R.add("p2_found")
def p2_found(spark, sf_dir):
    return _cases(spark, sf_dir).select("tbl", "row_key", "field").distinct()


@R.add("p2_plain_values")
def p2_plain_values(spark, sf_dir):
    return _cases(spark, sf_dir).distinct()


@R.add("p2_roster_matches")
def p2_roster_matches(spark, sf_dir):
    """Scores whose id and name meet the roster once both are in one form, per class: scores, by_id, by_id_and_name."""
    roster = table(spark, sf_dir, "roster").select(L.compare_key(F.col("student_id"), True).alias("k"), L.compare_key(F.col("name")).alias("roster_name")).groupBy("k").agg(F.min("roster_name").alias("roster_name"))
    s = table(spark, sf_dir, "student_scores").select("class", L.compare_key(F.col("student_id"), True).alias("k"), L.compare_key(F.col("name")).alias("n"))
    return s.join(roster, "k", "left").groupBy("class").agg(F.count("*").alias("scores"), F.count("roster_name").alias("by_id"), F.count_if(F.col("n") == F.col("roster_name")).alias("by_id_and_name"))


@R.add("p2_label_counts")
def p2_label_counts(spark, sf_dir):
    t = table(spark, sf_dir, "table_classification").select("export_id", F.explode("direct_identifier_types").alias("label"))
    return t.select("export_id", L.compare_key(F.col("label"), True).alias("label")).groupBy("label").agg(F.count("*").alias("labels"), F.countDistinct("export_id").alias("exports"))
