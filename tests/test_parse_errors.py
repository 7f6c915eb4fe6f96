import datetime
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from weirflow.operators import parse_errors as P


def brute(raw, delimiter, count, kinds):
    """The rule read word for word, character by character."""
    s = (raw or "").removeprefix("﻿").removesuffix("\r")
    cells, i = [], 0
    while True:
        if i < len(s) and s[i] == '"':
            i, out = i + 1, ""
            while True:
                if i >= len(s):
                    return "quoting"
                if s[i] == '"':
                    if s[i + 1 : i + 2] == '"':
                        out, i = out + '"', i + 2
                        continue
                    i += 1
                    break
                out, i = out + s[i], i + 1
            if i < len(s) and s[i] != delimiter:
                return "quoting"
            cells.append(out)
        else:
            j = s.find(delimiter, i)
            j = len(s) if j < 0 else j
            cells.append(s[i:j])
            i = j
        if i >= len(s):
            break
        i += 1
    if len(cells) != count:
        return "column_count"
    return None if all(good(k, v.strip(" ")) for k, v in zip(kinds, cells, strict=True)) else "invalid_value"


def good(kind, v):
    if v == "" or kind == "string":
        return True
    try:
        if kind == "int":
            return bool(re.fullmatch("[+-]?[0-9]+", v)) and -(2**31) <= int(v) < 2**31
        if kind == "decimal":
            return bool(re.fullmatch(r"[+-]?[0-9]+(\.[0-9]+)?", v))
        if kind == "date":
            return bool(re.fullmatch(r"\d{4}-\d\d-\d\d", v, re.A)) and bool(datetime.date.fromisoformat(v))
        if kind == "timestamp":
            return bool(re.fullmatch(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\dZ?", v, re.A)) and bool(datetime.datetime.fromisoformat(v.rstrip("Z")))
        return v.lower() in ("true", "false")
    except ValueError:
        return False


KINDS = ["string", "int", "date", "boolean", "timestamp", "decimal"]
LAYOUT = "layout_id int, data_start_row int, delimiter string, column_count int, column_names array<string>, column_types array<string>"
ROWS = "row_id long, layout_id int, row_no long, raw string, extra string"


def layouts(spark):
    return spark.createDataFrame([(1, 1, ",", 2, ["a", "b"], ["string", "int"]), (2, 0, "\t", 6, list("abcdef"), KINDS), (3, 0, ",", 1, ["row_id"], ["string"])], LAYOUT)


def found(spark, raws, layout):
    rows = spark.createDataFrame([(i, layout, 5, r, "x") for i, r in enumerate(raws)], ROWS)
    return {r.row_id: r.reason for r in P.failures(rows, layouts(spark)).collect()}


def test_against_brute_force(spark):
    @settings(max_examples=6, deadline=None)
    @given(st.lists(st.text(alphabet='a1,"\n\r -', max_size=14), min_size=30, max_size=60))
    def check(raws):
        got = found(spark, raws, 1)
        assert got == {i: r for i, x in enumerate(raws) if (r := brute(x, ",", 2, ["string", "int"]))}

    check()


def test_types(spark):
    values = [
        ["x", "1", "2026-02-28", "TRUE", "2026-01-01T10:00:00Z", "1.5"],
        ["", "", "", "", "", ""],
        ["x", " 5 ", "2026-02-29", "false", "2026-01-01 10:00:00", "+1"],
        ["x", "2147483648", "", "", "", ""],
        ["x", "-2147483648", "", "", "2026-01-01T24:00:00", ""],
        ["x", "1", "2026-2-01", "yes", "", ".5"],
        ["x", "１", "", "", "", ""],
        ["x", "1\xa0", "", "", "", ""],
        ['he said "hi"', "1", "", "", "", "1."],
        ["x", "9" * 60, "", "", "", "9" * 60],
        ["x", "-" + "0" * 60 + "7", "", "", "", ""],
    ]
    raws = ["\t".join(v) for v in values] + ["﻿" + "\t".join(values[0]) + "\r", None, "", '"a\tb"' + "\t1\t\t\t\t", '"a""b"\t1\t\t\t\t', '"a"b"\t1\t\t\t\t']
    assert found(spark, raws, 2) == {i: r for i, x in enumerate(raws) if (r := brute(x, "\t", 6, KINDS))}


def test_long_records_and_ties(spark):
    long = '"' + 'a""' * 60_000 + '",1'
    many = "," * 30_000
    assert found(spark, [long, long, many, '"' + "x" * 100_000], 1) == {2: "column_count", 3: "quoting"}


def test_titles_unknown_layouts_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 1, 0, "title", ""), (2, 1, 1, "bad", ""), (3, 9, 1, "x", ""), (4, 3, 0, None, "")], ROWS)
    assert {(r.row_id, r.reason) for r in P.failures(rows, layouts(spark)).collect()} == {(2, "column_count"), (3, "no_layout")}
    assert P.failures(rows.limit(0), layouts(spark)).count() == 0
    assert P.typed_cells(rows.limit(0), layouts(spark)).count() == 0


def test_typed_rows_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, 2, 0, "x\t 7\t2026-01-02\tTrue\t2026-01-02T03:04:05Z\t1.25", ""), (2, 2, 0, "x\tno\t\t\t\t", "")], ROWS)
    t = P.typed_table(rows, layouts(spark), 2).collect()
    assert len(t) == 1 and t[0].b == 7 and t[0].c == datetime.date(2026, 1, 2) and t[0].d is True and float(t[0].f) == 1.25
    wide = P.typed_table(spark.createDataFrame([(1, 3, 0, "v", "")], ROWS), layouts(spark), 3)
    assert wide.columns == ["row_id", "row_id_0"]
