import re

import pytest

pytest.importorskip("weirflow.llm")
from pyspark.sql import functions as F  # noqa: E402

from weirflow.llm import encoding as E  # noqa: E402
from weirflow.llm import lookalike as L  # noqa: E402


@pytest.mark.parametrize(
    ("value", "plain"),
    [
        ("Ｋａｅｔｔｉ　Ｔｒｏ", "Kaetti Tro"), ("Praí", "Praí"), ("S‐12770", "S-12770"), ("a​b﻿", "ab"), ("x y", "x y"), ("Сofia", "Cofia"), ("stuԁent", "student"),
        ("Севушин Зарислав", "Севушин Зарислав"), ("Ceвушин", "Севушин"), ("ﾌﾞﾒ", "ブメ"), ("⼭凪", "山凪"), ("福", "福"), ("二ナコ", "ニナコ"), ("ヒケ夕゙コ", "ヒケダコ"), ("Soquišt", "Soquišt"), ("Νίκος", "Νίκος"), ("", ""), ("plain-1", "plain-1"),
    ],
)
def test_visible(value, plain):
    assert L.visible(value) == plain
    assert L.visible(plain) == plain


def test_ascii_fields_and_keys():
    assert L.visible("рһоne", True) == "phone"
    assert L.visible("Ꮪ-12849", True) == "S-12849"
    assert L.key("  STRASSE  x ") == L.key("Straße x") == "strasse x"
    long = "Ａ" * 200_000
    assert L.visible(long) == "A" * 200_000


def test_lookalike_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Ａb", "x"), (3, "Ａb", "x"), (4, "Ab  c", "x")], "k int, value string, plain string")
    assert [(r.k, r.plain) for r in L.disguised(df, "k", F.col("value")).collect()] == [(3, "Ab")] * 2
    got = df.select(L.visible_form(F.col("value")).alias("v"), L.compare_key(F.col("value")).alias("c")).collect()
    assert [r.v for r in got] == [None, "", "Ab", "Ab", "Ab  c"] and got[4].c == "ab c"
    assert L.disguised(df.limit(0), "k", F.col("value")).count() == 0


TEXTS = ["Élève sérieuse, très à l'aise.", "Debe practicar más la lección 53.", "Übt fleißig mit der Gruppe 19", "宿題91ページが未提出。", "Нужна помощь с дробями", "発表がとても丁寧だった。"]


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1251", "cp437", "mac_roman", "cp1250"])
@pytest.mark.parametrize("text", TEXTS)
def test_utf8_round_trip(text, wrong):
    broken = E._garble(text.encode(), wrong)
    garbled, restored, _ = E.examine("see page 3, " + broken)
    assert garbled and restored == "see page 3, " + text


@pytest.mark.parametrize(("true", "wrong", "text"), [("cp932", "latin-1", TEXTS[3]), ("cp932", "cp1252", TEXTS[5]), ("euc_jp", "latin-1", TEXTS[3]), ("cp1252", "mac_roman", TEXTS[0]), ("cp1252", "cp437", "Participación excelente este año"), ("cp1251", "koi8_r", TEXTS[4])])
def test_other_pairs_are_found(true, wrong, text):
    assert E.examine(E._garble(text.encode(true), wrong))[0]


def test_twice_and_in_part():
    twice = E._garble(E._garble("Résultat très bon".encode(), "cp1252").encode("cp1252"), "cp1252")
    assert E.examine(twice)[:2] == (True, "Résultat très bon")
    mixed = "宿題は未提出。 / " + E._garble("Prüfung".encode(), "cp1252") + " / Âge requis"
    assert E.examine(mixed)[1] == "宿題は未提出。 / Prüfung / Âge requis"


@pytest.mark.parametrize("text", [*TEXTS, "ﾃｽﾄの範囲を間違えた。", "AVALIAÇÃO DE SÃO MARTIM: nota 4", "½ page missing, error ±12", "calle 12, 7º B", "Truwiam Soquišt", "Skîtri Féllôw", "☎ +81 90 0749 1341", "文字化けしたプリント", "", "plain", "“quoted” – text…"])
def test_proper_text_is_no_case(text):
    assert E.examine(text)[:2] == (False, text)


def test_lost_bytes_shifted_text_and_nulls(spark):
    assert E.examine("Pr�fung")[0] and E.examine("\x1b$B$N\x1b(B x")[0]
    df = spark.createDataFrame([(1, None), (2, ""), (3, "mÃ¡s"), (3, "mÃ¡s"), (4, "más")], "k int, t string")
    assert [(r.k, r.restored) for r in E.garbled_rows(df, "k", "t").collect()] == [(3, "más")] * 2
    assert [r.t for r in E.restored_rows(df, "t").orderBy("k").collect()] == [None, "", "más", "más", "más"]
    assert E.examine("mÃ¡s " * 20_000)[1] == "más " * 20_000


@pytest.mark.parametrize("text", ["naïvet{é}", "今日はcaf{é}です", "日本{é}語", "これは正しい文で{ここだけ}続く", "привет,мир{привет}", "schöner{Grüße}", "これは正しい文です。", "naïveté", "Größe–Maß"])
def test_part_of_a_token(text):
    garbled = re.sub(r"\{(.*)\}", lambda m: E._garble(m[1].encode(), "cp1252"), text)
    assert E.examine(garbled)[1] == text.replace("{", "").replace("}", "")
    assert E.examine(garbled)[0] == ("{" in text)


def test_only_the_matched_spans_are_replaced():
    from weirflow.llm import encoding as E

    for garbled, right in (("café and naÃ¯veté", "café and naïveté"), ("brûlÃ©e", "brûlée"), ("今日はÃ©tÃ©です", "今日はétéです"), ("ÃƒÂ©tÃƒÂ©", "été")):
        assert E.examine(garbled)[:2] == (True, right)
        text, places = E.restored_places(garbled)
        assert text == right and len(places) == len(right) and places[0][0] == 0 and places[-1][1] == len(garbled)
    for plain in ("Café Zürich", "naïveté, brûlée", "Ærøskøbing", "今日は", "Москва"):
        assert E.examine(plain)[0] is False and E.restored_places(plain) == (plain, None)


def test_text_misread_many_times_is_restored():
    from weirflow.llm import encoding as E

    t = "Grüße aus Köln"
    for _ in range(4):
        t = t.encode("utf-8").decode("latin-1")
    assert E.examine(t)[1] == "Grüße aus Köln"
