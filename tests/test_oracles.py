"""Queries against their DuckDB oracles on the smallest tables, and plans without single-task exchanges of facts."""

import os

import duckdb
import pytest

from holdfast.plans.oracles import ORACLES
from holdfast.plans.queries import QUERIES

from .conftest import DATA

#: One query of each mart; the driver holds all of them against their oracles.
SOME = ["monthly_retention_trend", "customer_retention_features", "cohort_retention", "monthly_dimensional_trend", "churn_driver_ranking", "risk_kpi_cube", "risk_priority_ranked", "quality_checks", "contract_checks"]


def rows(cols, got):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return sorted(cols), sorted(([x if not isinstance(x, float) else round(x, 7) for x in (r[k] for k in order)] for r in got), key=str)


def test_keys_match():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", SOME)
def test_against_oracle(spark, name):
    folder = f"{DATA}/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    found = QUERIES[name](spark, folder)
    wanted = con.sql(ORACLES[name])
    assert rows(found.columns, map(tuple, found.collect())) == rows(wanted.columns, wanted.fetchall())
