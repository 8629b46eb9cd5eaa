"""Queries whose design is too large to broadcast: the long form gives what SQL gives, and nothing is sent to the driver."""

import os

import duckdb
import pytest

from strataloom.operators import packed, scans
from strataloom.plans import registry

from .test_queries import cells

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["T10_linear_score", "T15_naive_rescale", "T15_optimal_rescale", "T8_interaction", "T8_interaction_detail", "T12_S11_gene_run", "T3_logistic_wald", "N3_T10_cox_score", "T6_odd_variants_linear"])
def test_large_designs_take_the_long_form(spark, monkeypatch, name):
    monkeypatch.setattr(scans, "LONG", 0)
    monkeypatch.setattr(packed, "LIMIT", 0)  # a packed design raises
    ours = registry.queries()[name](spark, DATA).toPandas()
    con = duckdb.connect()
    for table in os.listdir(DATA):
        con.execute(f"create view {table[:-8]} as select * from '{DATA}/{table}'")
    theirs = con.execute(registry.oracle_sql()[name]).df()
    columns = sorted(theirs)
    assert sorted(ours) == columns and len(ours) and cells(ours[columns].values.tolist()) == cells(theirs[columns].values.tolist())
