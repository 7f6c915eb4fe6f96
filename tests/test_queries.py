"""Every core query with SQL gives the rows of its SQL on the smallest tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from weirflow.plans.catalog import REGISTRIES

QUERIES = {n: f for r in REGISTRIES for n, f in r.queries.items()}
SQL = {n: s for r in REGISTRIES for n, s in r.sql.items()}


def norm(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float | decimal.Decimal):
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


def test_window_cut_within_characters(spark, tmp_path):
    """The edges of a byte window fall on every byte of characters of one to four bytes; a U+FFFD beside the cut belongs to the text."""
    texts = [f"{'a' * i}{c * (6400 // len(c.encode()))}{'b' * i}" for c in ("é", "日", "😀", "�", "日é") for i in range(5)]
    spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["view_window"](spark, str(tmp_path)).select("doc_id", "locator", "tokens_before", "view_hash").collect()
    want = c.execute(f"SELECT doc_id, locator, tokens_before, view_hash FROM ({SQL['view_window']})").fetchall()
    assert len(got) == len(texts) and sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, sf, tmp_path_factory, name):
    global EMPTY
    if "EMPTY" not in globals():
        EMPTY = str(tmp_path_factory.mktemp("empty"))
        for p in Path(sf).glob("*.parquet"):
            spark.read.parquet(str(p)).limit(0).write.parquet(f"{EMPTY}/{p.stem}.parquet")
    QUERIES[name](spark, EMPTY).collect()
