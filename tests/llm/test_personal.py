import pytest

pytest.importorskip("weirflow.llm")
from pyspark.sql import functions as F  # noqa: E402

from weirflow.llm import personal as P  # noqa: E402
from weirflow.llm.personal_sample import labelled  # noqa: E402


def test_held_out_accuracy():
    model = P.fitted()
    held = labelled(600, seed=77)
    for kind in P.KINDS:
        tp = fp = fn = 0
        for (_, gold), spans in zip(held, model.judge([P.plain(t) for t, _ in held]), strict=True):
            want, got = kind in {k for *_, k in gold}, kind in {k for _, _, k, _ in spans}
            tp, fp, fn = tp + (want and got), fp + (got and not want), fn + (want and not got)
        assert tp / (tp + fp) > 0.95 and tp / (tp + fn) > 0.95, (kind, tp, fp, fn)


def kinds(text):
    return sorted({k for _, _, k, _ in P.fitted().judge([P.plain(text)])[0]})


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write to pai.nu (at) pinecone (dot) example, please", ["email"]), ("ｌｕ＿ｇｒｉ＠ｑｕｉｌｌ．ｅｘａｍｐｌｅ bounced", ["email"]), ("3 @ 50 points each, capped", []), ("contact@", []), ("@post.test", []), ("tel 07700 900 371", ["phone"]), ("SSN 000-43-4686", ["id_number"]),
        ("マイナンバー 7164 1247 5983", ["id_number"]), ("Ordered workbook 978-0-00-11956-19", []), ("(student S-97176)", []), ("wohnt Birkenhofstraße 33", ["street_address"]), ("moved to 71 rue des Tilleules-Gris", ["street_address"]), ("moved to room 3-91 after the break", []),
        ("Trip to Tarnwick Museum on the 27th", []), ("Mr Wona Leasen will tutor on Friday", ["name"]), ("祖母（青原友人）が来校。", ["name"]), ("", []),
    ],
)
def test_kinds(text, want):
    assert kinds(text) == want


def test_columns(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "mail to a.b@c.example; tel 07700 900 371"), (3, "mail to a.b@c.example; tel 07700 900 371"), (4, "nothing here"), (5, "call +44 7700 900288 " + "x " * 20_000)], "k int, t string")
    frequent = P.frequent_words(df.select(F.col("t").alias("text")))
    got = {r.k: r.x for r in df.select("k", P.kinds_found(F.col("t"), frequent).alias("x")).collect()}
    assert got == {1: [], 2: [], 3: ["email", "phone"], 4: [], 5: ["phone"]}
    out = {r.k: r.x for r in df.select("k", P.replaced(F.col("t"), frequent).alias("x")).collect()}
    assert out[1] is None and out[2] == "" and out[3] == "mail to [EMAIL]; tel [PHONE]" and out[4] == "nothing here" and out[5].startswith("call [PHONE] x x")


def test_small_letters_reach_the_model(spark, tmp_path):
    from weirflow.llm.personal_queries import p3_found, p3_redacted

    spark.createDataFrame([(1, "x", "spoke with anna keller"), (2, "x", "call mr keller today"), (3, "x", "good progress this term"), (4, "x", " "), (5, "x", None)], "record_id long, name string, teacher_note string").write.parquet(f"{tmp_path}/student_scores.parquet")
    spark.createDataFrame([(1, "x")], "list_id long, email string").write.parquet(f"{tmp_path}/customer_list.parquet")
    assert {(r.field, r.row_key) for r in p3_found(spark, str(tmp_path)).collect()} == {("teacher_note", 1), ("teacher_note", 2)}
    text = {r.row_key: r.text for r in p3_redacted(spark, str(tmp_path)).filter("field = 'teacher_note'").collect()}
    assert "keller" not in text[1] + text[2]
    assert (text[3], text[4], text[5]) == ("good progress this term", " ", None)


def test_sample_has_no_wording_of_the_tables(spark):
    """No fixed piece of 12 characters or more, and no host, stands in a value of the tables that the model is applied to."""
    from weirflow.llm import personal_sample as S

    values = []
    for tbl, field in (("student_scores", "teacher_note"), ("student_scores", "name"), ("customer_list", "email")):
        values += [r[0].lower() for r in spark.read.parquet(f"/root/testdata/sf0.1/{tbl}.parquet").select(field).filter(F.col(field).isNotNull()).distinct().collect()]
    whole = "\n".join(values)
    assert [p for p in [*S.fixed_pieces(12), *S._HOSTS] if p.lower() in whole] == []


def test_kinds_that_do_not_count_are_not_looked_for():
    assert P.fitted().judge(["Anna Keller <a.keller@post.example>"], ("email",))[0][0][2] == "email"
    assert len(P.fitted().judge(["Anna Keller <a.keller@post.example>"], ("email",))[0]) == 1


def test_garbled_text_is_redacted_where_it_stands(spark):
    df = spark.createDataFrame([(1, "rÃ©union avec Mme LÃ©a Moreau, tel 07700 900 371, Ã©tÃ©")], "k int, t string")
    out = df.select(P.replaced(F.col("t"), frozenset()).alias("x")).first().x
    assert out == "rÃ©union avec Mme [NAME], tel [PHONE], Ã©tÃ©"
