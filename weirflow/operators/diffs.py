"""Equal and changed content: families of copies, differences of snapshots, hashes of trees, reachability, ranges and paths within objects.

Null content equals null content only where said. Paths are compared by code point. Repeated rows of a snapshot's path count once (the least hash).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def families(df: DataFrame, key: str, content: str) -> DataFrame:
    """digest, members, canonical (least key), octets, duplicate_octets of contents that stand in several rows. Only digests are shuffled."""
    d = df.filter(F.coalesce(F.col(content) != "", F.lit(False))).select(key, F.sha2(content, 256).alias("digest"), F.octet_length(content).cast("long").alias("octets"))
    g = d.groupBy("digest").agg(F.count("*").alias("members"), F.min(key).alias("canonical"), F.any_value("octets").alias("octets"))
    return g.filter("members > 1").withColumn("duplicate_octets", F.col("octets") * (F.col("members") - 1))


def canonical_families(df: DataFrame, key: str, content: str, preferred: list[Column]) -> DataFrame:
    """digest, members, canonical of contents that stand in several rows; canonical is the key of the row that comes first by the preferred columns, then by key. Each row is in at most one family, as it has one digest."""
    d = df.filter(F.coalesce(F.col(content) != "", F.lit(False))).select(F.col(key).alias("_k"), F.sha2(content, 256).alias("digest"), F.struct(*preferred, F.col(key)).alias("_o"))
    return d.groupBy("digest").agg(F.count("*").alias("members"), F.min_by("_k", "_o").alias("canonical")).filter("members > 1")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, old_path, change (renamed, deleted, added, modified) between snapshots (path, digest). A rename is a digest that one deleted and one added path have alone."""
    b = before.groupBy("path").agg(F.min("digest").alias("db"))
    a = after.groupBy("path").agg(F.min("digest").alias("da"))
    j = b.join(a, "path", "full_outer")
    gone, new = j.filter("da is null").select(F.col("path").alias("old_path"), F.col("db").alias("digest")), j.filter("db is null").select("path", F.col("da").alias("digest"))
    once = lambda x, p: x.groupBy("digest").agg(F.count("*").alias("n"), F.min(p).alias(p)).filter("n = 1").drop("n")
    renamed = once(gone, "old_path").join(once(new, "path"), "digest").select("path", "old_path")
    rest = (
        j.filter("da is not null and db is not null and da <> db").select("path", F.lit(None).cast("string").alias("old_path"), F.lit("modified").alias("change"))
        .unionByName(gone.join(renamed.select("old_path"), "old_path", "left_anti").select(F.col("old_path").alias("path"), F.lit(None).cast("string").alias("old_path"), F.lit("deleted").alias("change")))
        .unionByName(new.join(renamed.select("path"), "path", "left_anti").select("path", F.lit(None).cast("string").alias("old_path"), F.lit("added").alias("change")))
    )
    return rest.unionByName(renamed.withColumn("change", F.lit("renamed")))


def tree_hash(df: DataFrame, group: str, path: str, digest: str, buckets: int = 256) -> DataFrame:
    """group, tree_hash: a two-level hash of the sorted lines 'path digest'. Paths go to a fixed number of buckets by their own hash, so no task gathers a whole tree; the root hashes the sorted bucket hashes."""
    line = F.concat_ws("\0", path, F.coalesce(F.col(digest), F.lit("-")))
    bucket = F.conv(F.substring(F.sha2(path, 256), 1, 2), 16, 10).cast("int") % buckets
    level = df.groupBy(group, bucket.alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("h"))
    return level.groupBy(group).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.lpad(F.col("bucket").cast("string"), 3, "0"), "h"))), "\n"), 256).alias("tree_hash"))


def unreachable(objects: DataFrame, *references: DataFrame) -> DataFrame:
    """Objects (object_id and more) that no reference (object_id) names; null references name nothing."""
    for r in references:
        objects = objects.join(r.select("object_id").distinct(), "object_id", "left_anti")
    return objects


def line_range(text: Column, first: int, last: int) -> Column:
    """Lines first to last (from 1) of a text; empty where there are none."""
    return F.array_join(F.slice(F.split(text, "\n", -1), F.lit(first), F.lit(last - first + 1)), "\n")


def hunks(before: Column, after: Column, gap: int = 6) -> Column:
    """array<struct<old_start, old_lines, new_start, new_lines>> of line changes; changes at most gap lines apart share a hunk. Nulls count as empty texts."""

    @F.pandas_udf("array<struct<old_start: int, old_lines: int, new_start: int, new_lines: int>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        import difflib

        out = []
        for x, y in zip(a, b, strict=True):
            ops = [o for o in difflib.SequenceMatcher(None, (x or "").split("\n"), (y or "").split("\n"), autojunk=False).get_opcodes() if o[0] != "equal"]
            groups: list[list[int]] = []
            for _, i1, i2, j1, j2 in ops:
                if groups and i1 - groups[-1][1] <= gap:
                    groups[-1][1], groups[-1][3] = i2, j2
                else:
                    groups.append([i1, i2, j1, j2])
            out.append([{"old_start": i1 + 1, "old_lines": i2 - i1, "new_start": j1 + 1, "new_lines": j2 - j1} for i1, i2, j1, j2 in groups])
        return pd.Series(out, dtype=object)

    return run(before, after)


def table_digest(df: DataFrame, group: str, raw: str) -> DataFrame:
    """group, rows_hash, rows: a hash of a delimited table that doesn't depend on row order, line ends, a byte-order mark, the delimiter or blanks around cells. The sum of row hashes stands for the sorted rows, so a table of any size is combined partially."""
    text = F.regexp_replace(F.coalesce(F.col(raw), F.lit("")), r"\A\x{FEFF}|\r\z", "")
    cells = F.array_join(F.transform(F.split(text, "[,\t]", -1), lambda c: F.trim(c)), "\0")
    parts = [F.conv(F.substring(F.sha2(cells, 256), i, 8), 16, 10).cast("decimal(38,0)") for i in (1, 9, 17, 25)]
    return df.groupBy(group).agg(*(F.sum(p).alias(f"s{i}") for i, p in enumerate(parts)), F.count("*").alias("rows")).select(group, F.concat_ws("-", "s0", "s1", "s2", "s3").alias("rows_hash"), "rows")
