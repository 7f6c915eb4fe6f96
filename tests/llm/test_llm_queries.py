import pytest

pytest.importorskip("weirflow.llm")
from pathlib import Path  # noqa: E402

from weirflow.llm.catalog import REGISTRIES  # noqa: E402

QUERIES = {n: f for r in REGISTRIES for n, f in r.queries.items()}
COLUMNS = {
    "p2_found": ["tbl", "row_key", "field"], "p3_found": ["tbl", "row_key", "field", "kind"], "p4_found": ["tbl", "row_key", "field"], "p5_found": ["tbl", "row_key", "line_no"], "p6_found": ["file_id"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert len(rows) == (len({tuple(map(str, r)) for r in rows}))


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.endswith(("_found", "_ids", "_mix"))))
def test_empty_tables(spark, sf, tmp_path, name):
    for p in Path(sf).glob("*.parquet"):
        spark.read.parquet(str(p)).limit(0).write.parquet(f"{tmp_path}/{p.stem}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_nothing_else_imports_this_package():
    root = Path(__file__).resolve().parents[2] / "weirflow"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "weirflow.llm" not in p.read_text()
