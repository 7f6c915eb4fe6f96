"""Queries of files that aren't hand-written."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow.llm import sourcefiles as S
from weirflow.plans.registry import Registry
from weirflow.session import cut, widen
from weirflow.sources.tables import table

R = Registry()


def _seen(spark, sf_dir):
    return cut(S.examined(widen(table(spark, sf_dir, "scanned_files").select("file_id", "workspace", "relpath", "content"))))


@R.add("p6_found")
def p6_found(spark, sf_dir):
    return S.not_handwritten(_seen(spark, sf_dir)).select("file_id").distinct()


@R.add("p6_handwritten")
def p6_handwritten(spark, sf_dir):
    files = table(spark, sf_dir, "scanned_files")
    return files.filter(F.col("content").rlike(r"\S")).select("file_id", "workspace", "relpath", "size").join(S.not_handwritten(_seen(spark, sf_dir)).select("file_id"), "file_id", "left_anti")


@R.add("p6_kind_report")
def p6_kind_report(spark, sf_dir):
    """Per workspace and kind: files, and whether the workspace asked for directories that are skipped by default."""
    asked = table(spark, sf_dir, "walk_options").groupBy("workspace").agg(F.max(F.size("explicit_include_dirs")).alias("asked_dirs"))
    return S.not_handwritten(_seen(spark, sf_dir)).groupBy("workspace", "kind").agg(F.count("*").alias("files")).join(asked, "workspace", "left")
