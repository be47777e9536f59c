"""Every query with SQL against DuckDB on the smallest tables."""

import decimal
import importlib.util
import math
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")
spec = importlib.util.spec_from_file_location("entry_under_test", ROOT / "__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return None if isinstance(v, float) and math.isnan(v) else v


def same(a, b):
    return all(math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-4) if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & set(entry.queries())))
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = entry.queries()[name](spark, str(DATA))
    result = con.sql(entry.oracle_sql()[name])
    assert sorted(result.columns) == sorted(df.columns)
    order = [result.columns.index(c) for c in sorted(df.columns)]
    key = lambda r: tuple((v is None, round(v, 3) if isinstance(v, float) else v) if not isinstance(v, str) else (False, v) for v in r)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*sorted(df.columns)).collect()), key=lambda r: str(key(r)))
    want = sorted((tuple(plain(row[i]) for i in order) for row in result.fetchall()), key=lambda r: str(key(r)))
    assert len(got) == len(want) and all(same(a, b) for a, b in zip(got, want))


def test_entry(spark):
    if DATA.exists():
        assert entry.entry(spark).count() > 0
