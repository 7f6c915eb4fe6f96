"""Trees of files as tables, and tables as trees of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.operators.scan import READ_MOST, decoded


def read_tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """relpath, size, modified, content of the files below root; files that are too large are listed without content, whose bytes are then never read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    b = r.load(root)
    rel = F.regexp_replace("path", r"^(?:[a-z]+:)?/*" + root.strip("/").replace(".", r"\.") + "/", "")
    small = b.filter(F.col("length") <= READ_MOST).select(rel.alias("relpath"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), decoded(F.col("content")).alias("content"))
    large = b.filter(F.col("length") > READ_MOST).select(rel.alias("relpath"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.lit(None).cast("string").alias("content"))
    return small.unionByName(large)


def append_lines(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines, one file per partition."""
    df.write.mode("append").json(path)
