"""Delivery of a stream of results per session: sequence numbers, the running budget, and whether a result was delivered before.

Each micro-batch is numbered by running sums over ranges (operators/ordering), so a session with a third of all rows is spread over many tasks; what went before is one row per session and kind of result in a
written table of totals. A batch writes its result and the new totals under its number, so a batch that is run again after a loss gives the same rows once. Within a micro-batch the rows of a session are taken in
the order of (ts, event_id). The batch twins (budget_session_running, budget_repeated_work) give the same numbers for one batch.

Defined cases: repeated event_ids are delivered once while the watermark covers them; null kinds are one kind, null sizes count 0; a stream without rows gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.operators.ordering import running_sum

OUT = "event_id bigint, user_id bigint, seq bigint, used bigint, repeats bigint"
TOTALS = "user_id bigint, kind string, n bigint, used bigint"


def delivered(stream: DataFrame) -> DataFrame:
    """stream: event_id, user_id, event_type, ts, props, each event once: event_id, user_id, kind, ts, size."""
    once = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "30 days").dropDuplicatesWithinWatermark(["event_id"])
    return once.select("event_id", "user_id", F.coalesce("event_type", F.lit("")).alias("kind"), "ts", F.coalesce(F.char_length("props"), F.lit(0)).cast("long").alias("size"))


def numbered(rows: DataFrame, before: DataFrame) -> DataFrame:
    """rows of one batch with seq, used and repeats that go on from the totals before (user_id, kind, n, used)."""
    order = ["ts", "event_id"]
    x = running_sum(rows.withColumn("one", F.lit(1).cast("long")), ["user_id"], order, "one", "seq")
    x = running_sum(x, ["user_id"], order, "size", "used")
    x = running_sum(x, ["user_id", "kind"], order, "one", "repeats")
    of_user = before.groupBy("user_id").agg(F.sum("n").alias("n0"), F.sum("used").alias("u0"))
    of_kind = before.groupBy("user_id", "kind").agg(F.sum("n").alias("k0"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    x = x.join(of_user, "user_id", "left").join(of_kind, ["user_id", "kind"], "left")
    return x.select("event_id", "user_id", (F.col("seq") + z("n0")).alias("seq"), (F.col("used") + z("u0")).alias("used"), (F.col("repeats") - 1 + z("k0")).alias("repeats"))


def _batch(base: str) -> Callable[[DataFrame, int], None]:
    def run(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        before = spark.read.schema(TOTALS).parquet(f"{base}/totals/{number - 1}") if number else spark.createDataFrame([], TOTALS)
        rows = rows.persist()
        numbered(rows, before).write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        now = rows.groupBy("user_id", "kind").agg(F.count("*").alias("n"), F.sum("size").alias("used"))
        before.unionByName(now).groupBy("user_id", "kind").agg(F.sum("n").alias("n"), F.sum("used").alias("used")).write.mode("overwrite").parquet(f"{base}/totals/{number}")
        rows.unpersist()

    return run


def run_available(stream: DataFrame, base: str) -> DataFrame:
    """Process what is there now, write it under base, stop, and return what was written."""
    spark: SparkSession = stream.sparkSession
    q = stream.writeStream.foreachBatch(_batch(base)).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/out")
    there = out.getFileSystem(spark._jsc.hadoopConfiguration()).exists(out)
    return spark.read.schema(OUT).parquet(f"{base}/out").drop("batch") if there else spark.createDataFrame([], OUT)
