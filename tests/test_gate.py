"""All cross-mart checks together: one aggregate a view, short plans, and the same rows as each by itself."""

import time

import pytest
from pyspark.sql import functions as F

from holdfast.operators import validate
from holdfast.operators.cubes import ACCOUNT_COLUMNS
from holdfast.plans.marts import Marts
from holdfast.plans.queries import QUERIES
from holdfast.sources.binding import Star

from .conftest import DATA


@pytest.fixture(scope="module")
def marts(spark):
    m = Marts.of_star(spark, f"{DATA}/sf0.001", shared=True, cut=True)
    yield m
    m.release()


def test_all_checks_are_evaluated_at_once_with_a_short_plan(marts):
    graded = marts.graded
    began = time.time()
    views = {v for c in validate.all_checks({n: 1 for n in marts.raw}, ACCOUNT_COLUMNS).values() for v in c.over}
    again = marts.checked()
    plan = again._jdf.queryExecution().analyzed().toString()
    assert time.time() - began < 20
    # each view is aggregated once; what the marts are made of is not in the plan any more
    assert {"features", "scores", "trend"} <= views and "c_mktsegment" not in plan and "LogicalRDD" in plan and graded.count() == 31
    one = {r.check_name: (r.status, r.evidence) for k in ("cohort_logic", "score_drift", "kpi_cube_vs_trend") for r in marts.checked(k).collect()}
    every = {r.check_name: (r.status, r.evidence) for r in again.collect()}
    assert len(every) == 31 and one.items() <= every.items()


def test_a_check_that_finds_nothing_to_read_does_not_pass(spark):
    check = validate.Check("c", "n", {"empty": {"most": F.max("x")}}, lambda f: f("most") <= 1, "WARN", ("most",))
    empty = spark.createDataFrame([], "x int")
    assert validate.rows({"k": check}, {"empty": lambda: empty}).first().status == "WARN"


def test_figures_of_several_views_meet_in_one_row(spark):
    a, b = spark.createDataFrame([(1.5,), (2.5,)], "x double"), spark.createDataFrame([(4,)], "y int")
    check = validate.Check("c", "n", {"a": {"s": F.sum("x")}, "b": {"t": F.sum("y")}}, lambda f: f("d") == 0, "FAIL", ("s", "t"), {"d": lambda f: f("s") - f("t")})
    (row,) = validate.rows({"k": check}, {"a": lambda: a, "b": lambda: b}).collect()
    assert tuple(row) == ("c", "n", "PASS", "s=4.000000; t=4")


@pytest.mark.parametrize("block", [3, 4, 100])
def test_rank_neighbours_meet_across_blocks(spark, block):
    scores = [9.0, 8.0, 8.0, 7.0, 7.5, 1.0, 0.0]
    ranked = spark.createDataFrame([(k + 1, v) for k, v in enumerate(scores)], "priority_rank long, retention_priority_score double")
    got = sorted((r[0], r[1]) for r in validate.rank_neighbours(ranked, block).where("next is not null").collect())
    assert got == sorted(zip(scores, scores[1:], strict=False))


def test_summary_is_read_off_the_graded_rows(spark):
    (row,) = QUERIES["validation_summary"](spark, f"{DATA}/sf0.001").collect()
    assert row.checks == 31 and row.passed + row.warned + row.failed == 31


def test_tables_that_grow_are_merged_and_not_broadcast(spark):
    for rows in (Star(spark, f"{DATA}/sf0.001").usage(), Star(spark, f"{DATA}/sf0.001").subscriptions_multi()):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("name", ["risk_tier", "scored_filtered", "contract_row_count_nonzero", "val_priority_monotone"])
def test_scored_queries_carry_no_plan_of_the_features(spark, name):
    rows = QUERIES[name](spark, f"{DATA}/sf0.001")
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert "LogicalRDD" in plan and "c_mktsegment" not in plan and rows.count() > 0


def test_checkpoints_have_as_many_parts_as_their_rows_are_worth(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        m = Marts.of_star(spark, f"{DATA}/sf0.001", shared=True, cut=True)
        assert m.features.rdd.getNumPartitions() < 10
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
