"""Every registered query of the library against its SQL on the smallest tables."""

import decimal
import math
import os

import pytest

from gleanery.plans import registry

SF = os.environ.get("GLEANERY_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_its_sql(spark, duck, name):
    rows = registry.queries()[name](spark, SF)
    columns = sorted(rows.columns)
    got = sorted((tuple(plain(x) for x in r) for r in rows.select(columns).collect()), key=str)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    assert sorted(duck.sql(sql).columns) == columns
    want = sorted((tuple(plain(x) for x in r) for r in duck.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize(("name", "rows", "size"), [("catalogue_scan", "SHELF_ROWS", 50), ("paged_scan", "PAGE_ROWS", 40)])
def test_long_listings_lie_in_chains(spark, duck, monkeypatch, name, rows, size):
    """Pages of two rows: chains of at most two of them, one folder for each chain and not for each page."""
    from gleanery.plans import files

    made, path = [], files.shared_path
    monkeypatch.setattr(files, "shared_path", lambda *a: made.append(path(*a)) or made[-1])
    monkeypatch.setattr(files, rows, 2)
    monkeypatch.setattr(files, "CHAIN_PAGES", 2, raising=False)
    got = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql()[name].replace(f"// {size})", "// 2)").replace(f"% {size})", "% 2)")
    want = duck.sql(sql)
    assert sorted((tuple(r) for r in got.select(want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)
    table, group = {"catalogue_scan": ("part", "p_partkey % 4"), "paged_scan": ("customer", "c_nationkey")}[name]
    chains = duck.sql(f"SELECT sum((n + 3) // 4) FROM (SELECT count(*) AS n FROM {table} GROUP BY {group})").fetchall()[0][0]
    assert sum("=" in x for x in os.listdir(made[0].removeprefix("file://"))) == chains
