"""Tables of people: what their columns hold, which keys link rows, pseudonyms that stay joinable, and aggregates in place of rows.

Cells are strings; null cells count as empty. Column facts are partial aggregates, so no column is gathered. Ordinals of pseudonyms follow first appearance and are ranked over ranges.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.operators.ordering import rank_in_group

# Column labels by the kind of identifier they name, in the order in which the kinds are tried.
LABELS = {
    "name": ("fullname", "studentname", "name", "フルネーム", "氏名", "学生氏名", "名前"),
    "name-reading": ("フリガナ", "ふりがな", "カナ", "カナ氏名", "氏名カナ", "フリガナ氏名", "セイメイカナ", "namekana", "kana", "furigana", "phonetic"),
    "student-card": ("studentcardnumber", "学生証番号"),
    "student-id": ("studentid", "studentnumber", "学籍番号", "idナンバ"),
    "employee-id": ("employeeid", "employeenumber", "社員番号", "従業員番号"),
    "account-id": ("accountid", "memberid", "会員番号"),
    "email": ("email", "emailaddress", "メール", "メールアドレス"),
    "phone": ("phone", "phonenumber", "電話", "電話番号"),
    "address": ("address", "住所"),
    "my-number": ("マイナンバー", "個人番号", "mynumber", "individualnumber"),
    "passport-number": ("パスポート番号", "旅券番号", "passportnumber", "passport"),
    "bank-account": ("口座番号", "銀行口座", "預金口座", "bankaccount", "accountnumber", "iban"),
    "credit-card": ("クレジットカード番号", "クレジットカード", "カード番号", "creditcard", "cardnumber"),
    "biometric-id": ("生体認証", "指紋", "顔認証", "biometric", "fingerprint"),
    "government-id": ("governmentid", "住民票コード", "residentregistercode"),
    "course-code": ("授業コード", "科目コード", "コースコード", "coursecode", "classcode", "courseid", "classid"),
    "staff-id": ("教員番号", "職員番号", "担当教員", "教員id", "staffid", "teacherid", "instructorid"),
    "application-number": ("申込番号", "受付番号", "整理番号", "applicationnumber", "applicantid"),
    "record-id": ("レコードid", "管理番号", "伝票番号", "recordid", "orderid", "contractid"),
    "institutional-id": ("institutionalid",),
}
# Parts at the end of a compound label that name its kind, where no label above does; at most 8 characters stand before them.
ENDINGS = {
    "name-reading": ("フリガナ", "ふりがな", "氏名カナ", "カナ"),
    "name": ("氏名", "名前", "フルネーム", "なまえ"),
    "email": ("メールアドレス", "メール"),
    "phone": ("電話番号", "電話", "tel"),
    "address": ("住所",),
    "account-id": ("番号", "id", "コード"),
}
# Parts of labels by the category of associated data.
CATEGORIES = {
    "education-performance": ("grade", "grades", "score", "scores", "quiz", "coursetotal", "attendance", "評定", "評点", "成績", "点数", "小テスト", "コース合計", "出席", "出席率"),
    "salary": ("salary", "compensation", "給与", "賃金", "報酬"),
    "performance-evaluation": ("performanceevaluation", "evaluation", "人事評価", "勤務評定"),
    "health": ("health", "diagnosis", "medical", "健康", "診断", "病歴"),
    "disciplinary": ("disciplinary", "discipline", "懲戒", "処分"),
}
#: Kinds by what they identify: persons directly, or rows and roles of an organisation.
OPERATIONAL = ("employee-id", "account-id", "student-id", "student-card", "course-code", "staff-id", "application-number", "record-id", "institutional-id")
DIRECT = tuple(k for k in LABELS if k not in OPERATIONAL)


def label_key(label: Column) -> Column:
    """A column label without case, width, blanks and signs; null stays null."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else re.sub(r"[\s_.:/()（）-]+", "", unicodedata.normalize("NFKC", v.removeprefix("\ufeff")).strip().lower()) for v in x], dtype=object)

    ascii_form = F.regexp_replace(F.lower(F.trim(label)), r"[\s_.:/()-]+", "")
    return F.when(label.rlike(r"\A[ -~]*\z"), ascii_form).otherwise(run(F.when(~label.rlike(r"\A[ -~]*\z"), label)))


def identifier_kind(key: Column) -> Column:
    """Kind of identifier that a label's key names: by a label exactly, or (labels of five characters and more) at its start, else by its ending; null if none."""
    out = F.when(key.isNull(), F.lit(None).cast("string"))
    for kind, labels in LABELS.items():
        for x in labels:
            out = out.when(key == x, kind) if len(x) < 5 else out.when(key.startswith(x), kind)
    for kind, endings in ENDINGS.items():
        for x in endings:
            out = out.when(key.endswith(x) & (F.char_length(key) <= len(x) + 8), kind)
    return out


def category(key: Column) -> Column:
    """Category of associated data that a label's key names; null if none."""
    out = F.when(key.isNull(), F.lit(None).cast("string"))
    for kind, labels in CATEGORIES.items():
        out = out.when(F.exists(F.array(*(F.lit(x) for x in labels)), lambda x: F.contains(key, x)), kind)
    return out


def header_class(kinds: Column, categories: Column) -> Column:
    """struct<direct_identifier_columns, performance_columns, sensitivity, types, categories> of a table from the kinds and categories of its labels (arrays with nulls), in their order."""
    named = F.filter(kinds, lambda k: k.isNotNull())
    judged = F.filter(categories, lambda c: c.isNotNull())
    return F.struct(F.size(named).alias("direct_identifier_columns"), F.size(judged).alias("performance_columns"), sensitivity(F.size(named), F.size(judged)).alias("sensitivity"), named.alias("types"), F.array_sort(F.array_distinct(judged)).alias("categories"))


def sensitivity(identifiers: Column, categories: Column) -> Column:
    return F.when((identifiers > 0) & (categories > 0), "restricted").when((identifiers > 0) | (categories > 0), "confidential").otherwise("none")


def cell_shape(value: Column) -> Column:
    """empty, email, datetime, time, phone, numeric, code or text; cells beyond 512 characters are text."""
    v = F.trim(F.coalesce(value, F.lit("")))
    return (
        F.when(v == "", "empty")
        .when(F.char_length(v) > 512, "text")
        .when(v.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"), "email")
        .when(v.rlike(r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}([T ][0-9:.]+Z?)?$"), "datetime")
        .when(v.rlike(r"^[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?$"), "time")
        .when(v.rlike(r"^[+(]?[0-9][0-9() .-]{5,}[0-9]$") & v.rlike("[-() +.]") & ~v.rlike(r"^[0-9]+\.[0-9]+$"), "phone")
        .when(v.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?%?$"), "numeric")
        .when(v.rlike(r"^[A-Za-z]*[-_]?[0-9][A-Za-z0-9_-]*$"), "code")
        .otherwise("text")
    )


def column_facts(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cells, filled, distinct_values, share of each shape of the filled cells. cells: keys and value. Values are counted per key first, so a hot column is combined before it is shuffled again."""
    per = cells.groupBy(*keys, "value").agg(F.count("*").alias("n")).withColumn("shape", cell_shape(F.col("value")))
    full = F.col("shape") != "empty"
    filled = F.sum(F.when(full, F.col("n")).otherwise(0))
    share = lambda s: F.round(F.sum(F.when(F.col("shape") == s, F.col("n")).otherwise(0)) / F.greatest(filled, F.lit(1)), 4)
    return per.groupBy(*keys).agg(F.sum("n").alias("cells"), filled.alias("filled"), F.count_if(full).alias("distinct_values"), *(share(s).alias(f"share_{s}") for s in ("email", "phone", "datetime", "numeric", "code", "text")))


def id_score_tables(cells: DataFrame, table: str, col: str, value: str, least: int = 10, share: float = 0.8) -> DataFrame:
    """table, id_columns, score_columns of tables with a column of long numbers and one of numbers up to 100, each in at least this share of at least so many filled cells. Values are counted before they are judged."""
    v = F.trim(F.coalesce(F.col(value), F.lit("")))
    per = cells.select(table, col, v.alias("v")).filter("v <> ''").groupBy(table, col, "v").agg(F.count("*").alias("n"))
    is_id, is_score = F.col("v").rlike(r"\A[0-9]{5,12}\z"), F.col("v").rlike(r"\A[0-9]{1,3}([.][0-9]+)?\z") & (F.col("v").try_cast("double") <= 100)
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    f = per.groupBy(table, col).agg(F.sum("n").alias("filled"), count(is_id).alias("ids"), count(is_score).alias("scores")).filter(F.col("filled") >= least)
    out = f.groupBy(table).agg(F.count_if(F.col("ids") >= share * F.col("filled")).alias("id_columns"), F.count_if(F.col("scores") >= share * F.col("filled")).alias("score_columns"))
    return out.filter("id_columns > 0 and score_columns > 0")


def inferred_kind() -> Column:
    """Kind of a column from its facts alone."""
    unique = F.col("distinct_values") >= 0.9 * F.col("filled")
    return F.when(F.col("share_email") >= 0.8, "email").when(F.col("share_phone") >= 0.8, "phone").when(unique & (F.col("share_code") >= 0.8), "account-id").when(unique & (F.col("share_text") >= 0.8), "name")


def entities(df: DataFrame, key: str, order: list[str], prefix: str = "PERSON") -> DataFrame:
    """key, token for every distinct key that isn't null or empty, numbered by first appearance: PERSON-001, and without padding beyond 999."""
    o = F.struct(*order)
    first = df.filter(F.coalesce(F.col(key) != "", F.lit(False))).groupBy(key).agg(F.min(o).alias("_o"))
    r = rank_in_group(first, [], ["_o"], "_n")
    n = F.col("_n").cast("string")
    return r.select(key, F.concat(F.lit(f"{prefix}-"), F.when(F.col("_n") < 1000, F.lpad(n, 3, "0")).otherwise(n)).alias("token"))


def conflicts(df: DataFrame, key: str, other: str) -> DataFrame:
    """Keys that stand for several values of another column: key, values. Such keys can't tell entities apart."""
    return df.filter(F.col(key).isNotNull() & F.col(other).isNotNull()).groupBy(key, other).agg(F.count("*").alias("n")).groupBy(key).agg(F.count("*").alias("values")).filter("values > 1")


def serialised(cells: Column, delimiter: Column) -> Column:
    """A record of cells as text: cells with quotes, line breaks or the delimiter are quoted."""
    quote = lambda c: F.when(F.contains(c, F.lit('"')) | F.contains(c, F.lit("\n")) | F.contains(c, F.lit("\r")) | F.contains(c, delimiter), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    out = F.transform(cells, quote)
    return F.aggregate(F.slice(out, F.lit(2), F.greatest(F.size(out) - 1, F.lit(0))), F.get(out, 0), lambda acc, c: F.concat(acc, delimiter, c))
