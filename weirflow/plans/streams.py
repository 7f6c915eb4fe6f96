"""Queries that run as streams over what is there, and return what they wrote."""

from __future__ import annotations

import os
import uuid

from weirflow.plans.registry import Registry
from weirflow.session import checkpoint_dir
from weirflow.streaming import sessions as S

R = Registry()


@R.add(
    "stream_delivery",
    "SELECT event_id, user_id, row_number() OVER w AS seq, sum(length(props)) OVER w AS used, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS repeats FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
)
def stream_delivery(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
    stream = reader.parquet(path) if folder else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return S.run_available(S.delivered(stream), os.path.join(checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}"))
