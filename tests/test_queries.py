"""Every named query of the engine against DuckDB on the smallest tables."""

import duckdb
import pytest

from lodestone.plans import catalogue


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in catalogue.KEYS:
        c.sql(f"create view {name} as select * from '/root/testdata/sf0.001/{name}.parquet'")
    return c


def plain(rows):
    return sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    columns = sorted(df.columns)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert plain([[r[c] for c in columns] for r in df.collect()]) == plain([[r[k] for k in order] for r in want.fetchall()])


def test_array_lookup_covers_all_of_lineitem(spark):
    sf = "/root/testdata/sf0.01"
    got = catalogue.queries()["lookup_array_local_all"](spark, sf)
    want = duckdb.sql(catalogue.oracle_sql()["lookup_array_local_all"].replace("lineitem", f"'{sf}/lineitem.parquet'").replace("part ON", f"'{sf}/part.parquet' ON")).fetchall()
    assert plain(got.select("_id", "n", "size").collect()) == plain(want)
    assert got.count() == spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey").distinct().count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
