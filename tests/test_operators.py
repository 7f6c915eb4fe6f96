import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from weirflow.functions import text as T
from weirflow.operators import budget, detect, diffs, ledger, ordering, policy, scan, tables, transform, views
from weirflow.sources import office
from weirflow.sources.trees import append_lines, read_tree


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(("value", "bits"), [("aabb", 1.0), ("aaaa", 0.0), ("", 0.0), ("abcd", 2.0)])
def test_entropy(spark, value, bits):
    assert one(spark, value, T.entropy) == pytest.approx(bits)


def test_masks_and_estimates(spark):
    assert one(spark, "AKIA1234567890", T.mask) == "AKIA" + "*" * 10
    assert one(spark, "x" * 50, T.mask).endswith("(len 50)")
    assert one(spark, "abcd日本語", T.token_estimate) == 3
    assert one(spark, "", T.token_estimate) == 0
    assert one(spark, "took 12ms at 0xFF, 3,400 rows", T.normalised_line) == "took NUMt at 0xHEX, NUM rows"


def test_word_edges_are_ascii(spark):
    df = spark.createDataFrame([(1, "éAKIA" + "A" * 16), (2, "xAKIA" + "A" * 16), (3, None), (4, "")], "k int, t string")
    assert {r.k for r in detect.format_findings(df, "k", "t").collect()} == {1}


def test_findings_cap(spark):
    token = "AKIA" + "B" * 16
    df = spark.createDataFrame([(1, "\n".join([token] * 1200)), (2, token)], "k int, t string")
    assert {(r.k, r["count"]) for r in detect.format_findings(df, "k", "t").groupBy("k").count().collect()} == {(1, 1000), (2, 1)}


def test_keywords_entropy_and_watched(spark):
    df = spark.createDataFrame([(1, "the Passport\nnothing"), (2, None), (3, "token = Zx9Qw3Er7Ty1Ui5Op2As6Df4Gh8Jk0Lz")], "k int, t string")
    assert [(r.k, r.line, r.keyword) for r in detect.keyword_findings(df, "k", "t", ["passport", "pass"]).collect()] == [(1, 1, "passport")]
    assert detect.keyword_findings(df, "k", "t", []).count() == 0
    assert [r.k for r in detect.entropy_findings(df, "k", "t").collect()] == [3]
    values = spark.createDataFrame([("abab",), ("abab",), (None,), ("zz",)], "v string")
    got = detect.watched(spark.createDataFrame([(1, "abababab abab"), (2, ""), (3, None)], "k int, t string"), "k", "t", values, "v", least=3).collect()
    assert [(r.k, r.n) for r in got] == [(1, 3)]
    blocks = detect.watched(spark.createDataFrame([(1, "v1 v22 v333")], "k int, t string"), "k", "t", spark.createDataFrame([(f"v{i}",) for i in (1, 22, 333)], "v string"), "v", least=2, block=1).collect()
    assert len(blocks) == 3  # each of the three values, from several blocks


def test_ranks_over_ranges(spark):
    rows = [("hot", i, i % 3) for i in range(300)] + [("a", 1, None), (None, 5, 2), (None, 6, 3)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    got = {(r.g, r.o): (r.n, r.s) for r in ordering.running_sum(ordering.rank_in_group(df, ["g"], ["o"], "n"), ["g"], ["o"], "v", "s").collect()}
    total = 0
    for g, o, v in rows[:300]:
        total += v
        assert got[g, o] == (o + 1, total)
    assert got["a", 1] == (1, 0) and got[None, 6] == (2, 5)


def test_previous_rows_over_ranges(spark):
    rows = [("hot", i, f"v{i}") for i in range(300)] + [("a", 1, None), ("a", 2, "x"), (None, 5, "y"), (None, 6, "z")]
    got = {(r.g, r.o): r.p for r in ordering.previous_in_group(spark.createDataFrame(rows, "g string, o int, v string"), ["g"], ["o"], "v", "p").collect()}
    assert all(got["hot", i] == (f"v{i - 1}" if i else None) for i in range(300))
    assert got["a", 1] is None and got["a", 2] is None and got[None, 5] is None and got[None, 6] == "y"


def test_chunks_across_stretches(spark, tmp_path):
    rows = [(i, 1, i, "x" * 10 + ("jo" if i == 63 else "") if i != 64 else "e@mail.test") for i in range(130)] + [(200 + i, 2, i, "b" if i != 64 else "@mail.test") for i in range(63, 66)]
    spark.createDataFrame(rows, "row_id long, export_id long, row_no int, raw string").write.parquet(f"{tmp_path}/delimited_rows.parquet")
    from weirflow.plans.detect import detect_across_export

    got = {r.row_id: (r.with_tail, r.alone) for r in detect_across_export(spark, str(tmp_path)).collect()}
    assert got == {64: (1, 1), 264: (1, 0)}


def test_budget_selection(spark):
    df = spark.createDataFrame([("w", 1, 0, 100), ("w", 2, 3, 50), ("w", 3, 3, 60), ("w", 4, 1, 10), ("w", 5, 2, None)], "g string, k int, r int, s int")
    assert {r.k: r.keep for r in budget.selection(df, "g", "k", "r", "s", 120).collect()} == {1: True, 2: False, 3: False, 4: True, 5: True}


def test_rules(spark):
    rules = [policy.Rule("a", "redact", ("src/**", "!src/ok.*")), policy.Rule("b", "block", detectors=("key",)), policy.Rule("c", "ask", ("**/*.sh",))]
    df = spark.createDataFrame([("src/x.py", []), ("src/ok.py", []), ("t.py", ["key"]), ("d/run.sh", None), (None, [])], "p string, d array<string>")
    got = {r.p: (r.action, r.rule, r.via) for r in policy.decided(df, rules, "p", F.coalesce("d", F.array().cast("array<string>"))).collect()}
    assert got == {"src/x.py": ("redact", "a", "path"), "src/ok.py": ("allow", "default", None), "t.py": ("block", "b", "detector"), "d/run.sh": ("block", "c", "path"), None: ("allow", "default", None)}


def test_walk_and_ignore(spark):
    f = spark.createDataFrame([(1, "w", "a/build/x.js", 5, False), (2, "v", "a/build/x.js", 5, False), (3, "v", ".git/x", 5, False), (4, "v", "a.ts", 9_000_000, False), (5, "v", "l", 1, True)], "id int, workspace string, relpath string, size long, is_symlink boolean")
    o = spark.createDataFrame([("w", ["build"]), ("w", None)], "workspace string, explicit_include_dirs array<string>")
    assert {r.id: r.status for r in scan.walked(f, o).collect()} == {1: "read", 2: "skipped", 3: "skipped", 4: "listed", 5: "link"}
    p = spark.createDataFrame([("a/x.map",), ("build/a.ts",), ("build/a.js",)], "p string")
    assert [r.i for r in p.select(scan.ignored(F.col("p"), ["*.map", "build/", "!build/*.ts"]).alias("i")).collect()] == [True, False, True]


def test_windows_and_omissions(spark):
    text = "\n".join(f"l{i}" for i in range(1, 201))
    w = one(spark, text, views.window_view)
    assert w.locator == "L61-L160" and w.view.count("\n") == 100 and "100 lines withheld" in w.view
    b = one(spark, "é" * 5000, views.window_view)
    assert b.locator == "B2400-B9200" and b.tokens_after < b.tokens_before
    assert one(spark, "short", views.window_view).view == "short"
    d = spark.createDataFrame([(1, n, "r") for n in (2, 3, 5)], "k int, n int, reason string")
    assert {(r.locator, r["items"]) for r in views.ranges(d, "k").collect()} == {("L2-L3", 2), ("L5-L5", 1)}
    out = views.rendered(spark.createDataFrame([(1, "a\nb\nc\nd\ne"), (2, "x")], "k int, t string"), "k", "t", d).collect()
    assert {r.k: r.view.split("\n")[0] for r in out} == {1: "a", 2: "x"}


def test_choice_where_a_byte_window_cuts_a_character(spark, tmp_path):
    from weirflow.plans.views import view_choice

    texts = ["a" + "é" * 5000, "é" * 5000 + "a", "a" + "日" * 3000 + "bb", "ab" + "😀" * 2500 + "abc", "x" + "�" * 3000, "é" * 100]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.view for r in view_choice(spark, str(tmp_path)).collect()} == {i: "window" if i < 5 else "full" for i in range(6)}


def test_json_outline(spark):
    o = one(spark, '{"a": [{"b": 1}, {"b": null}]}', views.json_outline)
    assert o.kind == "json" and "$.a[*].b:null|number" in o.fields
    assert one(spark, "no json", views.json_outline).kind is None


def test_transformations(spark):
    assert one(spark, "x " + "AKIA" + "C" * 16 + " y", transform.redacted) == "x «REDACTED:api-key» y"
    assert one(spark, "API_KEY=1\nPORT=80\n# c\nPATHX=/a", transform.env_sanitised) == "API_KEY=${API_KEY}\nPORT=80\n# c\nPATHX=${PATHX}"
    assert one(spark, "aa\nbb\ncc", lambda c: transform.chunks(c, 5)) == ["aa\nbb", "cc"]
    assert one(spark, "", transform.chunks) == []
    assert one(spark, "<think>a</think> b", transform.thoughts_stripped).text == "b"
    assert one(spark, "<think>a", transform.thoughts_stripped).error == "MALFORMED"
    assert one(spark, "a@b.cd, c@d.ef, a@b.cd", transform.deidentified) == "EMAIL-001, EMAIL-002, EMAIL-001"
    assert one(spark, '{"id": 1, "name": "Ann", "x": "a@b.cd"}', transform.json_deidentified) == '{"id": 1, "name": "FIELD-001", "x": "EMAIL-001"}'
    assert one(spark, "nope", transform.json_deidentified) is None
    assert one(spark, "a/12345/x_20240131.txt", transform.path_pseudonym).startswith("a/ID-")


def test_families_diffs_and_trees(spark):
    d = spark.createDataFrame([(1, "x"), (2, "x"), (3, ""), (4, None)], "k int, t string")
    assert [(r.members, r.canonical) for r in diffs.families(d, "k", "t").collect()] == [(2, 1)]
    b = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "path string, digest string")
    a = spark.createDataFrame([("a", "1"), ("b", "9"), ("e", "3"), ("f", "7")], "path string, digest string")
    assert {(r.path, r.change, r.old_path) for r in diffs.snapshot_diff(b, a).collect()} == {("b", "modified", None), ("e", "renamed", "c"), ("d", "deleted", None), ("f", "added", None)}
    t = lambda x: diffs.tree_hash(x.withColumn("g", F.lit(1)), "g", "path", "digest").first().tree_hash
    assert t(b) == t(b.repartition(3)) != t(a)
    h = spark.createDataFrame([("a\nb\nc", "a\nx\nc\nd")], "x string, y string").select(diffs.hunks(F.col("x"), F.col("y")).alias("h")).first().h
    assert [(r.old_start, r.old_lines, r.new_start, r.new_lines) for r in h] == [(2, 2, 2, 3)]
    rows = spark.createDataFrame([(1, "a,b"), (1, "c,d"), (2, "﻿c\td\r"), (2, " a\tb"), (3, "a,b")], "g int, raw string")
    assert len({r.rows_hash for r in diffs.table_digest(rows, "g", "raw").collect()}) == 2


def test_tables(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, ""), (5, None)], "o int, k string")
    assert {r.k: r.token for r in tables.entities(df, "k", ["o"]).collect()} == {"b": "PERSON-001", "a": "PERSON-002"}
    shapes = {v: one(spark, v, tables.cell_shape) for v in ("", "a@b.cd", "2026-01-02", "10:30", "03-1234-5678", "12.5", "S-10001", "hello", None)}
    assert list(shapes.values()) == ["empty", "email", "datetime", "time", "phone", "numeric", "code", "text", "empty"]
    keys = spark.createDataFrame([("Ｅ－ｍａｉｌ",), ("Student_ID",), ("氏名",), (None,)], "x string").select(tables.label_key(F.col("x")).alias("k"))
    assert [r.kind for r in keys.select(tables.identifier_kind(F.col("k")).alias("kind")).collect()] == ["email", "student-id", "name", None]
    assert one(spark, ["a", 'b"c', "d,e"], lambda c: tables.serialised(c, F.lit(",")), "array<string>") == 'a,"b""c","d,e"'


def test_ledger(spark):
    ts = datetime.datetime(2026, 1, 1)
    df = spark.createDataFrame([(1, ts, "a", 5), (1, ts, "b", 7), (2, None, "c", 1)], "u int, ts timestamp, e string, v int")
    assert {(r.u, r.e, r.records) for r in ledger.latest(df, ["u"], ["v"], ["e"]).collect()} == {(1, "b", 2), (2, "c", 1)}
    assert ledger.kept(df, "ts", 1).count() == 3


def _zip(**parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in parts.items():
            z.writestr(k.replace("__", "/").replace("_dot_", "."), v)
    return b.getvalue()


def test_office(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = _zip(word__document_dot_xml=f"<w:document {w}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    book = _zip(xl__workbook_dot_xml=f'<workbook {s}><sheets><sheet name="S"/></sheets></workbook>', xl__worksheets__sheet1_dot_xml=f'<worksheet {s}><sheetData><row><c r="A1"><v>1</v></c><c r="C1" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    got = one(spark, doc, office.read_docx, "binary")
    assert got.content.paragraphs == ["Hello"] and got.content.tables == [[["c"]]]
    assert one(spark, book, office.read_xlsx, "binary").content[0].rows == [["1", "", "x"]]
    assert one(spark, b"junk", office.read_docx, "binary").error == "no archive"
    with pytest.raises(office.Refused):
        office.opened(_zip(bomb="0" * 5_000_000))
    assert list(office.opened(_zip(**{"..__evil": "x", "ok": "y"}))) == ["ok"]


def test_trees_and_decoding(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes("日本".encode("shift_jis"))
    (tmp_path / "b.txt").write_text("hi")
    got = {r.relpath: r.content for r in read_tree(spark, str(tmp_path)).collect()}
    assert got == {"a/x.txt": "日本", "b.txt": "hi"}
    append_lines(spark.range(2), str(tmp_path / "out"))
    append_lines(spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 5


def test_stream_goes_on_from_the_batches_before(spark):
    from weirflow.streaming import sessions

    rows = lambda ids: spark.createDataFrame([(i, i % 2, "a" if i % 3 else None, f"2026-01-01 00:00:{i:02d}", 10) for i in ids], "event_id long, user_id long, kind string, ts string, size long").fillna("", ["kind"])
    whole = {r.event_id: r for r in sessions.numbered(rows(range(20)), spark.createDataFrame([], sessions.TOTALS)).collect()}
    before = rows(range(12)).groupBy("user_id", "kind").agg(F.count("*").alias("n"), F.sum("size").alias("used"))
    later = {r.event_id: r for r in sessions.numbered(rows(range(12, 20)), before).collect()}
    assert later == {i: whole[i] for i in range(12, 20)}
    assert [(whole[i].seq, whole[i].used, whole[i].repeats) for i in (0, 2, 6)] == [(1, 10, 0), (2, 20, 0), (4, 40, 1)]


def test_merged_redaction(spark):
    """Against brute force: every place of every detector by itself, then painted character by character."""
    import re

    key, rand = "sk-" + "aB3" * 12, "Zx9Qw7Er5Ty3Ui1Op0As8Df6Gh4"
    texts = [f"a {key} b", f"token={rand} {key}", f"secret: x{key}", "", None, "plain text\nno secret", f"token = postgres://u:p@h {rand}\n{rand}", "AKIA" + "ABCD1234" * 2 + " key " + rand]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: (r.x.text, r.x["count"]) for r in df.select("k", transform.redacted_spans(F.col("t")).alias("x")).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i] == (None, 0)
            continue
        painted = [None] * (len(t) + 1)
        spans = [(*m.span(), c) for _, c, _, p in detect.DETECTORS for m in re.finditer(p, t)]
        for m in re.finditer(detect.LONG_TOKEN, t):
            line = t[t.rfind("\n", 0, m.start()) + 1 :].split("\n")[0]
            v = m.group()
            bits = -sum(v.count(c) / len(v) * __import__("math").log2(v.count(c) / len(v)) for c in set(v))
            if re.search(detect.KEY_HINT, line) and bits >= 4:
                spans.append((*m.span(), "high-entropy-string"))
        for s, e, _ in spans:
            for j in range(s, e):
                painted[j] = True
        kept = "".join(c for j, c in enumerate(t) if not painted[j])
        assert re.sub("«REDACTED:[a-z-]+»", "", got[i][0]) == kept
        assert got[i][1] == got[i][0].count("«REDACTED:") and (rand not in got[i][0] or "\n" in t)
    assert transform.merged_spans([(5, 9, "b"), (0, 5, "a"), (12, 13, "c")]) == [(0, 9, "a"), (12, 13, "c")]


def test_a_key_block_is_no_harmless_setting(spark):
    block = "HOST=-----BEGIN RSA PRIVATE KEY-----abc"
    assert one(spark, block + "\nPORT=80", transform.env_sanitised) == "HOST=${HOST}\nPORT=80"


def test_labels(spark):
    labels = {"学生証番号6桁": "student-card", "保護者氏名": "name", "受診者番号": "account-id", "student id (required)": "student-id", "Passport No": "passport-number", "口座番号": "bank-account", "連絡先メール": "email", "tel": "phone", "score": None, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in labels], "x string").withColumn("k", tables.label_key(F.col("x")))
    assert {r.x: r.kind for r in df.select("x", tables.identifier_kind(F.col("k")).alias("kind")).collect()} == labels


def test_repeated_ranges(spark):
    df = spark.createDataFrame([("o", 1, 10), ("o", 3, 5), ("o", 8, 12), ("o", 20, 30), ("o", 20, 25), ("p", 2, 3), ("p", 2, 3)], "k string, first int, last int")
    got = {(r.k, r.first, r.last): r.work for r in ledger.repeated_ranges(df, ["k"]).collect()}
    assert got == {("o", 1, 10): "new", ("o", 3, 5): "contained", ("o", 8, 12): "overlapping", ("o", 20, 30): "new", ("o", 20, 25): "contained", ("p", 2, 3): "new"}
    assert ledger.repeated_ranges(df.limit(0), ["k"]).count() == 0


def test_queue(spark):
    from weirflow.operators import queue

    rows = [("a", "x", 1.0, 5, 1), ("a", "x", 9.0, 7, 2), ("b", "x", 9.0, 6, 3), ("c", "x", None, 1, 4), ("d", "y", 2.0, 3, 5), ("d", "y", 2.0, 3, 6), ("e", None, 1.0, 1, 7)]
    df = spark.createDataFrame(rows, "k string, kind string, priority double, asked_at int, id int")
    q = queue.enqueued(df, ["k", "kind"], ["asked_at", "id"])
    got = {r.k: (r.id, r.priority, r.asked) for r in q.collect()}
    assert got == {"a": (1, 9.0, 2), "b": (3, 9.0, 1), "c": (4, None, 1), "d": (5, 2.0, 2), "e": (7, 1.0, 1)}
    assert {(r.k, r.place) for r in queue.next_items(q, "id", 2).collect()} == {("a", 1), ("b", 2), ("d", 1), ("e", 1)}
    assert sorted((r.batch, r.k) for r in queue.in_batches(q, "id", 2).collect()) == [(0, "a"), (0, "b"), (1, "d"), (1, "e"), (2, "c")]
    assert queue.next_items(queue.enqueued(df.limit(0), ["k", "kind"], ["asked_at", "id"]), "id", 2).count() == 0
    ev = spark.createDataFrame([("a", "queued", "2026-01-01 00:00:00", 1), ("a", "running", "2026-01-01 00:01:00", 2), ("b", "running", "2026-01-01 01:00:00", 3), ("c", "done", "2026-01-01 01:05:00", 4)], "k string, event string, ts string, id int").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {(r.k, r.state, r.tries) for r in queue.states(ev, ["k"], ["ts", "id"], 600).collect()} == {("a", "lost", 1), ("b", "running", 1), ("c", "done", 0)}


def test_regions_and_unlabelled_tables(spark):
    from weirflow.operators import parse_errors

    layouts = spark.createDataFrame([(1, ","), (2, "\t")], "layout_id int, delimiter string")
    rows = [(1, 1, 0, "Report"), (1, 1, 1, "a,b"), (1, 1, 2, '"x,1",2'), (1, 1, 2, '"x,1",2'), (2, 2, 0, "a\tb"), (2, 2, 1, "c\td\r"), (3, 1, 0, "a,b"), (3, 1, 1, "a,b,c"), (4, 1, 0, '"open'), (5, 1, 0, None)]
    df = spark.createDataFrame(rows, "export_id long, layout_id int, row_no long, raw string")
    got = {r.export_id: (r.width, r.rows, r.preamble, r.strict) for r in parse_errors.regions(df, layouts).collect()}
    assert got == {1: (2, 2, 1, False), 2: (2, 2, 0, True), 3: (3, 1, 1, False), 4: (0, 0, 0, False), 5: (1, 1, 0, False)}
    assert parse_errors.regions(df.limit(0), layouts).count() == 0
    cells = [(1, 0, str(20_000 + i)) for i in range(10)] + [(1, 1, str(i)) for i in range(9)] + [(1, 1, "ill"), (1, 2, None)] + [(2, 0, str(20_000 + i)) for i in range(10)] + [(3, 0, "77777")]
    t = tables.id_score_tables(spark.createDataFrame(cells, "t int, c int, v string"), "t", "c", "v")
    assert [tuple(r) for r in t.collect()] == [(1, 1, 1)]


def test_families_have_one_canonical_row(spark):
    df = spark.createDataFrame([(1, "b.bin", "x"), (2, "a.txt", "x"), (3, "a.txt", "x"), (4, "c", None), (5, "d", ""), (6, "e", "y")], "id int, p string, t string")
    got = diffs.canonical_families(df, "id", "t", [~F.col("p").endswith(".txt"), F.col("p")]).collect()
    assert [(r.members, r.canonical) for r in got] == [(3, 2)]
