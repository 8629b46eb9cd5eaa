"""Every registered association query against its DuckDB twin, at scale 0.01."""

import os

import duckdb
import pytest

from strataloom.plans import registry

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name[:-8]} as select * from '{DATA}/{name}'")
    return con


def cells(rows):
    def cell(v):
        if str(v) in ("None", "<NA>", "nan", "NaT"):
            return "null"
        return str(v) if isinstance(v, (str, bool)) or "bool" in type(v).__name__ else f"{float(v):.5f}"

    return sorted(tuple(cell(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    ours = registry.queries()[name](spark, DATA).toPandas()
    theirs = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(ours) == sorted(theirs)
    columns = sorted(ours)
    assert cells(ours[columns].values.tolist()) == cells(theirs[columns].values.tolist())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_others_give_rows(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0
