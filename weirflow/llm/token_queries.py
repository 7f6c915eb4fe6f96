"""Queries of token ids and of the mixture by tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow.llm import mixing as M
from weirflow.llm import tokens as T
from weirflow.plans.registry import Registry
from weirflow.session import widen
from weirflow.sources.tables import table

R = Registry()


@R.add("p7_ids")
def p7_ids(spark, sf_dir):
    T.small_batches(spark)
    return widen(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.token_ids(F.col("text")).alias("ids"))


@R.add("p7_token_report")
def p7_token_report(spark, sf_dir):
    T.small_batches(spark)
    d = widen(table(spark, sf_dir, "documents").select("source", "text")).select("source", T.token_count(F.col("text")).alias("n"))
    return d.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"), F.max("n").alias("longest"))


def counted(spark, sf_dir):
    T.small_batches(spark)
    return widen(table(spark, sf_dir, "documents").select("doc_id", "source", "text").filter(F.col("text") != "")).select("doc_id", "source", T.token_count(F.col("text")).alias("n_tokens"))


@R.add("p8_mix")
def p8_mix(spark, sf_dir):
    from weirflow.session import cut

    return M.mixed(cut(counted(spark, sf_dir)), table(spark, sf_dir, "mix_targets"))


@R.add("p8_shares")
def p8_shares(spark, sf_dir):
    from weirflow.session import cut

    targets = table(spark, sf_dir, "mix_targets")
    return M.shares(M.mixed(cut(counted(spark, sf_dir)), targets), targets)
