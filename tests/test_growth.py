"""Steps that the queries on features and scores share, as they grow: no nested loops, compiled range search, nothing kept that is read once."""

import re
from bisect import bisect_left
from datetime import date

import pytest
from pyspark.sql import functions as F

from holdfast.functions.ranks import _below, percent_rank_avg
from holdfast.operators.features import snapshot_date
from holdfast.plans.marts import Marts
from holdfast.plans.queries import QUERIES
from holdfast.sources.binding import Star

from .conftest import DATA


def _plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_one_row_tables_are_values_and_not_nested_loops(spark):
    m = Marts.of_star(spark, f"{DATA}/sf0.001")
    for rows in (m.subscriptions, m.usage, m.features):
        assert "NestedLoop" not in _plan(rows) and "CartesianProduct" not in _plan(rows)


@pytest.mark.parametrize("name", ["risk_kpi_lookup", "scored_filtered"])
def test_accounts_that_are_read_once_are_not_kept(spark, name):
    assert "InMemoryTableScan" not in _plan(QUERIES[name](spark, f"{DATA}/sf0.001"))


@pytest.mark.parametrize("others, last, wanted", [([3], [1, None, 5], 5), ([3], [1, 3], 3), ([None], [2, 4], 4), ([3, None], [None], 3), ([], [1], 1), ([2], [], 2), ([None], [], None)])
def test_latest_day_with_the_largest_table_read_beyond_the_others(spark, others, last, wanted):
    day = lambda k: k and date(2020, 1, k)
    a, b = (spark.createDataFrame([(day(k),) for k in ks], f"{c} date") for ks, c in ((others, "a"), (last, "b")))
    (row,) = snapshot_date((a, "a"), last=(b, "b")).collect()
    assert row.snapshot_date == day(wanted)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7])
def test_cuts_below_a_value(spark, n):
    cuts = [float(2 * k) for k in range(n)]
    rows = spark.range(-1, 16).select(F.col("id").cast("double").alias("v"), F.lit(cuts).cast("array<double>").alias("cuts") if n else F.expr("array()").cast("array<double>").alias("cuts"))
    assert all(r.out == bisect_left(cuts, r.v) for r in _below(rows, "cuts", "v", "out", 7).collect())


def test_customers_are_not_sent_to_the_driver_to_meet_their_nations(spark):
    rows = Star(spark, f"{DATA}/sf0.001").customers()
    rows.collect()
    met = [x for x in _plan(rows).splitlines() if "Join [c_nationkey" in x or "Join [n_nationkey" in x]
    assert met and all("BroadcastHashJoin [c_nationkey" in x and "BuildRight" in x for x in met)


def test_percent_ranks_broadcast_by_whole_numbers(spark):
    rows = percent_rank_avg(spark.range(50).select("id", (F.col("id") % 7).alias("a"), (F.col("id") % 5).alias("b")), "id", "a", "b")
    sent = re.findall(r"HashedRelationBroadcastMode\(List\((.*?)\),", _plan(rows))
    assert sent and all("bigint" in x and "string" not in x for x in sent)


def test_customers_and_subscriptions_come_from_one_pass_over_the_orders(spark, monkeypatch):
    calls, own = [], Star._orders
    monkeypatch.setattr(Star, "_orders", lambda self: calls.append(1) or own(self))
    m = Marts.of_star(spark, f"{DATA}/sf0.001", shared=True, cut=True)
    assert len(calls) == 3  # last day, owners, payments
    assert "o_orderdate" not in m.subscriptions._jdf.queryExecution().analyzed().toString()
    m.release()


def test_contexts_are_made_where_they_are_read(spark):
    m = Marts.of_star(spark, f"{DATA}/sf0.001", shared=True, cut=True)
    (kept,) = [x for x in m.scores._jdf.queryExecution().analyzed().toString().splitlines() if "LogicalRDD" in x]
    assert "recommended_action" in kept and "recommendation_context" not in kept and "recommendation_context" in m.scores.columns
    m.release()
