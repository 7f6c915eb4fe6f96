"""Compact views of long texts: what is kept, what is left out, and where the rest can be fetched (L<first>-L<last> for lines, B<first>-B<last> for bytes).

Every view is a function of the text alone. Kept lines and omitted ranges together are the text. Null texts have no view; empty ones are passed through. A
view that isn't shorter than its text is refused, the text is passed instead. Lines are worked on within their row: only the search view and the test view compare lines of a text
with each other, by windows over one text.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions.text import java, line_rows, lines, normalised_line, token_estimate

# Sizes of the window view, caps of the search and test views, and the share that a view must save.
HEAD, TAIL = 60, 40
WINDOW_LINES = HEAD + TAIL + 20
BYTES_FROM, HEAD_BYTES, TAIL_BYTES = 6_000, 2_400, 800
PER_FILE, FILES, HITS = 5, 25, 12
TEST_LINES, FRAMES = 40, 6
RECORDS, INTERESTING, RECORD_LINES = 3, 6, 5
SAVING = 0.15


def _split_bytes(raw: Column, at: Column, step: int) -> Column:
    """How many bytes from a cut before byte at (from 1) to the next edge of a character of UTF-8, backwards (step -1) or onwards (1): 0 where the cut is one, 3 at most. Decoding half a character would fail."""
    inside = [raw.substr(at + step * k, F.lit(1)).between(F.lit(b"\x80"), F.lit(b"\xbf")) for k in range(3)]
    return F.when(~inside[0], 0).when(~inside[1], 1).when(~inside[2], 2).otherwise(3)


def window_view(text: Column) -> Column:
    """struct<view, locator, tokens_before, tokens_after>: head and tail of long texts, with a marker for what is between; by bytes where there are few lines."""
    ls = lines(text)
    n, size = F.size(ls), F.octet_length(text)
    mid = F.concat(F.lit("… "), (n - HEAD - TAIL).cast("string"), F.lit(" lines withheld → retrieve L61-L"), (n - TAIL).cast("string"), F.lit(" …"))
    by_lines = F.array_join(F.concat(F.slice(ls, 1, HEAD), F.array(mid), F.slice(ls, n - TAIL + 1, F.lit(TAIL))), "\n")
    raw = text.cast("binary")
    cut = F.concat(F.lit("… "), (size - HEAD_BYTES - TAIL_BYTES).cast("string"), F.lit(f" bytes withheld → retrieve B{HEAD_BYTES}-B"), (size - TAIL_BYTES).cast("string"), F.lit(" …"))
    head = raw.substr(F.lit(1), F.lit(HEAD_BYTES) - _split_bytes(raw, F.lit(HEAD_BYTES + 1), -1)).cast("string")
    tail = raw.substr(size - TAIL_BYTES + 1 + _split_bytes(raw, size - TAIL_BYTES + 1, 1), F.lit(TAIL_BYTES)).cast("string")
    by_bytes = F.concat(head, F.lit("\n"), cut, F.lit("\n"), tail)
    view = F.when(n >= WINDOW_LINES, by_lines).when(size >= BYTES_FROM, by_bytes).otherwise(text)
    locator = F.when(n >= WINDOW_LINES, F.concat(F.lit(f"L{HEAD + 1}-L"), (n - TAIL).cast("string"))).when(size >= BYTES_FROM, F.concat(F.lit(f"B{HEAD_BYTES}-B"), (size - TAIL_BYTES).cast("string")))
    return F.struct(view.alias("view"), locator.alias("locator"), token_estimate(text).alias("tokens_before"), token_estimate(view).alias("tokens_after"))


def ranges(dropped: DataFrame, key: str) -> DataFrame:
    """key, locator, first, last, items, reasons of dropped lines (key, n, reason): neighbours become one range."""
    w = Window.partitionBy(key).orderBy("n")
    x = dropped.dropDuplicates([key, "n"]).withColumn("g", F.col("n") - F.row_number().over(w))
    r = x.groupBy(key, "g").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.count("*").alias("items"), F.array_join(F.array_sort(F.collect_set("reason")), ", ").alias("reasons"))
    return r.select(key, F.concat(F.lit("L"), F.col("first").cast("string"), F.lit("-L"), F.col("last").cast("string")).alias("locator"), "first", "last", "items", "reasons")


def rendered(df: DataFrame, key: str, text: str, dropped: DataFrame) -> DataFrame:
    """key, view: the lines of the text without the dropped ones, a marker standing for each range."""
    r = ranges(dropped, key)
    marker = F.concat(F.lit("… "), F.col("items").cast("string"), F.when(F.col("items") == 1, " line omitted (").otherwise(" lines omitted ("), "reasons", F.lit(") → retrieve "), "locator", F.lit(" …"))
    marks = r.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("first", marker))).alias("marks"))
    gone = dropped.groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("n", F.lit(True)))).alias("gone"))  # looked up by line, so a text takes time in proportion to its lines
    x = df.select(key, text).join(marks, key, "left").join(gone, key, "left")
    out = F.transform(lines(F.col(text)), lambda line, i: F.coalesce(F.element_at("marks", (i + 1).cast("long")), F.when(F.element_at("gone", (i + 1).cast("long")).isNull(), line)))
    return x.select(key, F.when(F.col("marks").isNull(), F.col(text)).otherwise(F.array_join(F.filter(out, lambda v: v.isNotNull()), "\n")).alias("view"))


HIT = r"^([^\s:][^:]*):([0-9]+):(.*)$"


def search_hits(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, n, file, line_no, content of search hits in texts that are mostly hits (two thirds of at least HITS lines that aren't blank)."""
    ls = F.filter(lines(F.col(text)), lambda x: F.trim(x) != "")
    n = F.size(ls)
    good = F.size(F.filter(ls, lambda x: F.regexp_like(x, F.lit(HIT))))
    d = df.filter((n >= HITS) & (good >= 0.66 * n))
    x = line_rows(d, key, text).filter(F.col("line").rlike(HIT))
    return x.select(key, "n", F.regexp_extract("line", HIT, 1).alias("file"), F.regexp_extract("line", HIT, 2).cast("long").alias("line_no"), F.trim(F.regexp_extract("line", HIT, 3)).alias("content"))


def search_dropped(hits: DataFrame, key: str) -> DataFrame:
    """key, n, reason: hits that the view leaves out: repeats, files beyond FILES by first appearance, and those beyond PER_FILE of a file."""
    first = Window.partitionBy(key, "file", "line_no", "content").orderBy("n")
    files = hits.groupBy(key, "file").agg(F.min("n").alias("first_n"))
    files = files.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("first_n")))
    x = hits.withColumn("again", F.row_number().over(first) > 1).join(files.select(key, "file", "place"), [key, "file"])
    kept = Window.partitionBy(key, "file", "again").orderBy("n")
    reason = F.when(F.col("again"), "duplicate hits").when(F.col("place") > FILES, "files beyond the cap").when(F.row_number().over(kept) > PER_FILE, "hits beyond the per-file cap")
    return x.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(key, "n", "reason")


# Classes of lines of test output, in the order in which they are tried; the patterns mean the same in Java and RE2.
LINE_CLASSES = (
    ("exit", r"(?i)(exit(ed)?[ \t]+(code|status))[ \t]*[:=]?[ \t]*[0-9]+"),
    ("summary", r"(?i)\b([0-9]+)[ \t]+(passed|failed|skipped|pending|todo|passing|failing|errors?)\b|^[ \t]*(Test Files|Tests|Suites|Snapshots|Duration|Time|Ran all)\b"),
    ("command", r"^[ \t]*[$>»][ \t]+\S"),
    ("failure", r"(^|\s)(FAIL|FAILED|✗|×|✕|●|ERROR|E\s{2,})|(AssertionError|Unhandled|Uncaught)|^\s*(Error|TypeError|ReferenceError|SyntaxError|RangeError|expected|Expected|Received|Actual|Diff|-\s|\+\s|assert)"),
    ("frame", r"^\s*(at\s+\S|File\s+\"|\s+#[0-9]+\s+0x|from\s+\S+:[0-9]+)"),
    ("warning", r"(?i)^\s*(warn(ing)?|DeprecationWarning|npm warn)\b"),
    ("anchor", r"(?i)(^|[\s(])([A-Za-z0-9_./~@-]+\.[a-z]{1,5}):([0-9]+)(:([0-9]+))?"),
    ("passing", r"^\s*(PASS\b|✓|√|ok\s+[0-9]+|·|\s*✔)|\s(PASS|passed)\s*$"),
    ("progress", r"\r|^\s*[\[#=>\-|/\\]+\s*[0-9]{1,3}%|^\s*[0-9]{1,3}%\s|^\s*[|/\-\\]\s*$|^\s*\.{3,}\s*$"),
    ("install", r"^\s*(added|removed|changed|audited)\s+[0-9]+\s+packages|^\s*Progress:\s+resolved|^\s*(npm|pnpm|yarn)\s+(notice|info|sill|http)\b"),
    ("framework", r"^\s*(RUN|DEV|WAIT|WATCH)\s+v?[0-9]|^\s*(Determining test suites|Using|Loaded config|Starting|Collecting)\b"),
)
DROP_REASONS = {"passing": "passing test records", "progress": "progress output", "install": "install noise", "framework": "framework output"}


def line_class(line: Column) -> Column:
    out = F.when(F.trim(line) == "", "blank")
    for name, p in LINE_CLASSES:
        out = out.when(line.rlike(java(p)), name)
    return out.otherwise("other")


def test_dropped(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, n, reason of lines that the view of test output leaves out (texts of at least TEST_LINES lines)."""
    d = df.filter(F.size(lines(F.col(text))) >= TEST_LINES)
    x = line_rows(d, key, text).withColumn("class", line_class(F.col("line"))).withColumn("norm", normalised_line(F.col("line")))
    by = Window.partitionBy(key).orderBy("n")
    blank_before = (F.lag("class").over(by) == "blank") & (F.col("class") == "blank")
    x = x.withColumn("blank_again", F.coalesce(blank_before, F.lit(False)))
    # frames since the last line that is neither frame nor blank
    x = x.withColumn("trace", F.sum(F.when(F.col("class").isin("frame", "blank"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    depth = F.sum(F.when(F.col("class") == "frame", 1).otherwise(0)).over(Window.partitionBy(key, "trace").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    again = F.row_number().over(Window.partitionBy(key, "class", "norm").orderBy("n")) > 1
    reason = (
        F.when(F.col("blank_again"), "blank")
        .when((F.col("class") == "frame") & (depth > FRAMES), "repeated stack frames")
        .when((F.col("class") == "warning") & again, "duplicate warnings")
        .when((F.col("class") == "other") & again, "duplicate lines")
    )
    for c, r in DROP_REASONS.items():
        reason = reason.when(F.col("class") == c, r)
    return x.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(key, "n", "reason")


def record_dropped(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, n, reason of JSON records (one a line) that the view leaves out: all but the first and last RECORDS and the first INTERESTING that name an error."""
    ls = F.filter(lines(F.col(text)), lambda x: F.trim(x) != "")
    head = F.slice(ls, 1, 50)
    parsed = F.size(F.filter(head, lambda x: F.try_parse_json(x).isNotNull()))
    d = df.filter((F.size(ls) >= RECORD_LINES) & (parsed >= 0.7 * F.size(head)))
    x = line_rows(d, key, text).filter(F.trim("line") != "")
    w = Window.partitionBy(key).orderBy("n")
    x = x.withColumn("r", F.row_number().over(w)).withColumn("last", F.count("*").over(Window.partitionBy(key)))
    x = x.withColumn("edge", (F.col("r") <= RECORDS) | (F.col("r") > F.col("last") - RECORDS)).withColumn("err", F.col("line").rlike(r'(?i)"(error|exception|failed|failure)"\s*:'))
    nth = F.sum(F.when(F.col("err") & ~F.col("edge"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("nth", nth).filter(~F.col("edge") & ~(F.col("err") & (F.col("nth") <= INTERESTING))).select(key, "n", F.lit("ndjson records").alias("reason"))


ASSIGN = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_.]*)\s*=\s*([^\r\n]*)"


def settings(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, n, name, value, type of the assignments of texts that are mostly assignments (at least 8, four fifths of the lines that aren't blank or comments)."""
    ls = F.filter(lines(F.col(text)), lambda x: (F.trim(x) != "") & ~F.regexp_like(x, F.lit(r"^\s*[#;]")))
    d = df.filter((F.size(ls) >= 8) & (F.size(F.filter(ls, lambda x: F.regexp_like(x, F.lit(ASSIGN)))) >= 0.8 * F.size(ls)))
    x = line_rows(d, key, text).filter(F.col("line").rlike(ASSIGN)).select(key, "n", F.regexp_extract("line", ASSIGN, 1).alias("name"), F.trim(F.regexp_extract("line", ASSIGN, 2)).alias("value"))
    v = F.col("value")
    kind = F.when(v.isin("", '""', "''"), "empty").when(v.rlike(r"(?i)^['\"]?https?://"), "url").when(v.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), "number").when(v.rlike("(?i)^(true|false)$"), "boolean").when(v.rlike("^['\"].*['\"]$"), "quoted").otherwise("string")
    return x.withColumn("type", kind)


def log_outline(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, lines, errors, warnings, first, last of logs."""
    ls = F.filter(lines(F.col(text)), lambda x: F.trim(x) != "")
    return df.filter(F.col(text).isNotNull()).select(
        key,
        F.size(ls).cast("long").alias("lines"),
        F.regexp_count(text, F.lit(r"(?m)^\S+ ERROR ")).cast("long").alias("errors"),
        F.regexp_count(text, F.lit(r"(?m)^\S+ WARN ")).cast("long").alias("warnings"),
        F.regexp_extract(text, r"([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+Z)", 1).alias("first_at"),
    )


def json_outline(text: Column) -> Column:
    """struct<kind, records, fields, depth> of JSON texts and of texts with one JSON value a line; null for others. fields are paths with the types seen, sorted."""

    def walk(v, path, out, depth):
        t = "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, int | float) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"
        out.setdefault(path, set()).add(t)
        deepest = depth
        if isinstance(v, dict) and depth < 4:
            for k, x in v.items():
                deepest = max(deepest, walk(x, f"{path}.{k}", out, depth + 1))
        elif isinstance(v, list) and depth < 4:
            for x in v[:1000]:
                deepest = max(deepest, walk(x, f"{path}[*]", out, depth + 1))
        return deepest

    @F.pandas_udf("kind string, records int, fields array<string>, depth int")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            row = (None, None, None, None)
            if t and t.strip()[:1] in ("{", "["):
                try:
                    values, kind = [json.loads(t)], "json"
                except ValueError:
                    values, kind = [], "ndjson"
                    for line in t.split("\n"):
                        if line.strip():
                            try:
                                values.append(json.loads(line))
                            except ValueError:
                                pass
                if values:
                    out: dict[str, set[str]] = {}
                    deep = max(walk(v, "$", out, 0) for v in values)
                    n = len(values[0]) if kind == "json" and isinstance(values[0], list) else len(values)
                    row = (kind, n, sorted(f"{p}:{'|'.join(sorted(x))}" for p, x in out.items()), deep)
            rows.append(row)
        return pd.DataFrame(rows, columns=["kind", "records", "fields", "depth"])

    return run(text)


def chosen(before: Column, views: list[tuple[str, Column]]) -> Column:
    """Name of the first view that saves SAVING of the tokens, else of the one that saves most, else 'full'. views: name and tokens after (null where the view doesn't apply)."""
    good = F.coalesce(*(F.when(t <= before * (1 - SAVING), F.lit(n)) for n, t in views))
    best = F.array_min(F.filter(F.array(*(F.struct(t.alias("t"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, t) in enumerate(views))), lambda x: x["t"].isNotNull() & (x["t"] < before)))
    return F.coalesce(good, best["name"], F.lit("full"))
