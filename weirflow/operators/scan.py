"""What a tree of files is: which entries are walked, what type they have, what their text looks like, settings within them.

Null paths never match a pattern. Files without content (links, too large) have facts without text. Rows of a tree are independent: no operator here shuffles but the join with the walk options.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.session import bounded_broadcast

# Directories that a walk skips always, and those it skips unless a workspace asks for them; sizes that are listed but not read.
NEVER = (".git",)
SKIPPED = ("node_modules", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", "__pycache__", ".next", ".turbo", "dist", "build", "coverage", "target", "out", ".pnpm-store", ".yarn", ".cache", ".gradle")
LARGE, READ_MOST = 5_000_000, 2_000_000
LIMITS = {"pdf": 64 << 20, "xlsx": 128 << 20, "docx": 128 << 20, "pptx": 128 << 20}


def glob_regex(glob: str) -> str:
    """A path pattern (*, **, ?, [..], {a,b}) as a regular expression over whole paths; dot files match like others."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "{" and "}" in glob[i:]:
            j = glob.index("}", i)
            out, i = out + "(?:" + "|".join(glob_regex(g)[1:-1] for g in glob[i + 1 : j].split(",")) + ")", j + 1
        elif c == "[" and "]" in glob[i:]:
            j = glob.index("]", i)
            out, i = out + "[" + glob[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


def ignore_regex(line: str) -> str | None:
    """A line of an ignore file as a regular expression over paths; None for blank lines and comments. Negations are given without their mark."""
    p = line.strip().lstrip("!")
    if not p or p.startswith("#"):
        return None
    anchored = "/" in p.rstrip("/")
    body = glob_regex(p.strip("/"))[1:-1]
    return f"^{'' if anchored else '(?:.*/)?'}{body}(?:/.*)?$"


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether the last line of an ignore file that matches a path excludes it."""
    out = F.lit(False)
    for line in lines:
        rx = ignore_regex(line)
        if rx:
            out = F.when(path.rlike(rx), F.lit(not line.strip().startswith("!"))).otherwise(out)
    return out


def walked(files: DataFrame, options: DataFrame) -> DataFrame:
    """files with status: skipped (with the directory that is skipped), link, listed (too large to be read) or read. options: workspace, explicit_include_dirs."""
    dirs = F.slice(F.split("relpath", "/"), F.lit(1), F.greatest(F.size(F.split("relpath", "/")) - 1, F.lit(0)))
    asked = options.groupBy("workspace").agg(F.array_distinct(F.flatten(F.collect_list("explicit_include_dirs"))).alias("_asked"))
    x = files.join(bounded_broadcast(asked), "workspace", "left")
    bad = F.filter(dirs, lambda d: d.isin(*NEVER) | d.isin(*SKIPPED) & ~F.coalesce(F.array_contains("_asked", d), F.lit(False)))
    x = x.withColumn("skipped_dir", F.get(bad, 0))
    status = F.when(F.col("skipped_dir").isNotNull(), "skipped").when(F.col("is_symlink"), "link").when(F.col("size") > READ_MOST, "listed").otherwise("read")
    return x.withColumn("status", status).drop("_asked")


def file_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("pdf", "xlsx", "csv", "tsv", "docx", "pptx"), ext).when(ext.isin("zip", "gz", "tgz", "tar", "7z", "rar", "bz2", "xz", "jar"), "archive").otherwise("text")


def size_verdict(path: Column, size: Column) -> Column:
    """How a file of this name and size is treated: too-large (beyond its format's limit), large (only listed), or ok; null sizes are ok."""
    limit = F.lit(None).cast("long")
    for kind, most in LIMITS.items():
        limit = F.when(file_type(path) == kind, most).otherwise(limit)
    return F.when(size > limit, "too-large").when(limit.isNull() & (size > F.least(F.lit(LARGE), F.lit(READ_MOST))), "large").otherwise("ok")


def capabilities(path: Column) -> Column:
    """struct<type, parser, transformers>: what can be done with a file of this name."""
    t = file_type(path)
    table = F.array(F.lit("pseudonymize"), F.lit("aggregate"), F.lit("safety-check"))
    return F.struct(t.alias("type"), (~t.isin("pdf", "archive")).alias("parser"), F.when(t.isin("csv", "tsv"), table).when(t == "xlsx", F.array(F.lit("pseudonymize"), F.lit("safety-check"))).when(t == "text", F.array(F.lit("redact"), F.lit("pseudonymize"), F.lit("safety-check"))).otherwise(F.array().cast("array<string>")).alias("transformers"))


def text_facts(text: Column) -> Column:
    """struct<bom, eol, lines, binary>: eol is lf, crlf, mixed or none; binary by control characters in the first 8000."""
    head = F.substring(text, 1, 8000)
    crlf, lf = F.regexp_count(text, F.lit("\r\n")), F.regexp_count(text, F.lit("\n"))
    control = F.regexp_count(head, F.lit(r"[\x01-\x08\x0b\x0e-\x1a\x1c-\x1f]"))
    return F.struct(
        text.startswith("﻿").alias("bom"),
        F.when(lf == 0, "none").when(crlf == 0, "lf").when(crlf == lf, "crlf").otherwise("mixed").alias("eol"),
        (lf + 1).alias("lines"),
        (F.contains(head, F.lit("\0")) | (control > 0.3 * F.char_length(head))).alias("binary"),
    )


def decoded(raw: Column) -> Column:
    """Text of bytes: UTF-8, or Shift-JIS where that leaves strictly fewer replacement characters. Null stays null."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            t = bytes(b).decode("utf-8", "replace")
            if "�" not in t:
                return t
            s = bytes(b).decode("shift_jis", "replace")
            return s if s.count("�") < t.count("�") else t

        return pd.Series([one(b) for b in values], dtype=object)

    return run(raw)


def env_entries(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, name, value of settings files (NAME=value lines); the last definition of a name holds. Comments and lines without a valid name are left out; quotes around a value are removed."""
    x = df.select(key, F.posexplode(F.split(text, r"\r?\n", -1)).alias("i", "line"))
    rx = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$"
    v = F.regexp_extract("line", rx, 2)
    value = F.when(v.rlike("^\"[\\s\\S]*\"$") & (F.char_length(v) > 1) | v.rlike("^'[\\s\\S]*'$") & (F.char_length(v) > 1), v.substr(F.lit(2), F.char_length(v) - 2)).otherwise(v)
    return x.filter(F.col("line").rlike(rx)).select(key, "i", F.regexp_extract("line", rx, 1).alias("name"), value.alias("value")).groupBy(key, "name").agg(F.max_by("value", "i").alias("value"))
