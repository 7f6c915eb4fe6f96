"""Queries of credentials."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow.llm import credentials as C
from weirflow.plans.registry import Registry
from weirflow.session import widen
from weirflow.sources.tables import table

R = Registry()
FIELDS = (("scanned_files", "content"), ("redact_results", "redacted"))


@R.add("p5_found")
def p5_found(spark, sf_dir):
    parts = [C.credential_lines(widen(table(spark, sf_dir, t).select("file_id", f)), "file_id", f).select(F.lit(t).alias("tbl"), F.col("file_id").alias("row_key"), "line_no") for t, f in FIELDS]
    return parts[0].unionByName(parts[1])


@R.add("p5_redacted")
def p5_redacted(spark, sf_dir):
    parts = [widen(table(spark, sf_dir, t).select("file_id", f)).select(F.lit(t).alias("tbl"), F.col("file_id").alias("row_key"), C.redacted(F.col(f)).alias("text")) for t, f in FIELDS]
    return parts[0].unionByName(parts[1])


@R.add("p5_missed_by_redaction")
def p5_missed_by_redaction(spark, sf_dir):
    """Per workspace: credentials that the older redaction left, and files that still hold any."""
    left = C.credential_lines(widen(table(spark, sf_dir, "redact_results").select("file_id", "redacted")), "file_id", "redacted")
    files = table(spark, sf_dir, "scanned_files").select("file_id", "workspace")
    return left.groupBy("file_id").agg(F.count("*").alias("n")).join(files, "file_id").groupBy("workspace").agg(F.sum("n").alias("credentials_left"), F.count("*").alias("files"))
