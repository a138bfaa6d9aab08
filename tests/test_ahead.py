"""The star read ahead: facts of the orders make one pass, aggregated by hashing, do for subscriptions, first orders and payments."""

import os
import re

import pytest
from pyspark.sql import functions as F

from holdfast.plans import marts
from holdfast.plans.marts import Marts
from holdfast.plans.queries import QUERIES
from holdfast.sources import binding

from .conftest import DATA

PLACE = f"{DATA}/sf0.001"


def test_snapshot_cells_pass_over_the_orders_once_and_sort_none_of_them(spark, monkeypatch):
    plans, cut = [], marts._checkpoint
    monkeypatch.setattr(marts, "_checkpoint", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    QUERIES["snapshot_agg"](spark, PLACE)
    scans = lambda table: sum(len(re.findall(rf"FileScan parquet .*/{table}\.parquet", p)) for p in plans)
    assert len(plans) == 3  # owners, features, scores
    assert not any("SortAggregate" in p for p in plans)
    assert scans("orders") == 2 and scans("lineitem") == 1  # owners, and the usage's customers


@pytest.fixture
def star(spark, tmp_path):
    """A folder with changed orders beside the given tables."""

    def made(change):
        for t in ("customer", "lineitem", "nation", "region"):
            os.symlink(f"{PLACE}/{t}.parquet", tmp_path / f"{t}.parquet")
        change(spark.read.parquet(f"{PLACE}/orders.parquet")).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
        return str(tmp_path)

    return made


def _holes(orders):
    return orders.withColumns({
        "o_orderpriority": F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")),
        "o_orderdate": F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate")),
        "o_totalprice": F.when(F.col("o_orderkey") % 7 > 0, F.col("o_totalprice")),
    })


CHANGES = {
    "none": (lambda df: df, True, True),
    "priorities missing": (lambda df: df.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority"))), True, True),
    "holes": (_holes, False, True),
    "parts of cents, keys far apart": (lambda df: df.withColumns({"o_totalprice": F.col("o_totalprice") + 0.0037}).withColumn("o_orderdate", F.when(F.col("o_orderkey") > 0, F.col("o_orderdate")).otherwise(F.to_timestamp(F.lit("0001-01-01")).cast(dict(df.dtypes)["o_orderdate"]))).withColumn("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey") + 2**61)), False, False),
    "large amounts": (lambda df: df.withColumn("o_totalprice", F.col("o_totalprice") + 2e9), True, False),
    "no orders": (lambda df: df.where("false"), False, True),
}


@pytest.mark.parametrize("name", CHANGES)
def test_features_read_ahead_are_those_of_the_operators(spark, star, name):
    change, packed, cents = CHANGES[name]
    folder = star(change)
    facts = binding.Star(spark, folder, ahead=True)._facts
    assert (facts.levels is not None, facts.cents) == (packed, cents)
    rows = {}
    for cut in (True, False):
        m = Marts.of_star(spark, folder, cut=cut)
        rows[cut] = [m.snapshot.first(), *sorted(m.features.collect(), key=str)]
        m.release()
    assert rows[True] == rows[False] and (len(rows[True]) > 100) == (name != "no orders")


def test_first_orders_with_more_priorities_than_are_numbered(spark, monkeypatch):
    few = {r.customer_id: r.first_priority for r in binding.Star(spark, PLACE, ahead=True).owners.collect()}
    monkeypatch.setattr(binding, "LEVELS", 2)
    s = binding.Star(spark, PLACE, ahead=True)
    assert s._facts.levels is None and s._facts.cents and s._facts.last_day
    assert few == {r.customer_id: r.first_priority for r in s.owners.collect()}
