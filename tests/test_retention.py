"""Operators on small hand-written rows: month edges, windows, ties, null keys, dirty input and the gate."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from holdfast.functions.ranks import ordinal, percent_rank_avg, quantiles
from holdfast.operators import cohorts, contracts, cubes, drivers, features, profile, quality, release, risk, trend, validate
from holdfast.sources import tables

SUBS = "subscription_id long, customer_id long, subscription_start_date date, subscription_end_date date, monthly_revenue double, contract_type string, billing_cycle string, status string"


def d(text):
    return dt.date.fromisoformat(text) if text else None


def subs(spark, rows):
    return spark.createDataFrame([(k, k, d(a), d(b), float(v), "Annual", cycle, status) for k, a, b, v, cycle, status in rows], SUBS)


def day(spark, text):
    return spark.createDataFrame([(d(text),)], "snapshot_date date")


@pytest.fixture(scope="module")
def edges(spark):
    return subs(
        spark,
        [
            (1, "2024-01-01", None, 10, "Monthly", "active"),
            (2, "2024-01-15", "2024-03-01", 20, "Monthly", "churned"),
            (3, "2024-02-10", "2024-02-20", 30, "Monthly", "churned"),
            (4, "2024-01-31", "2024-02-29", 40, "Annual", "churned"),
        ],
    )


def test_trend_edges(spark, edges):
    rows = {str(r.month): r for r in trend.monthly_trend(edges, day(spark, "2024-03-31")).collect()}
    assert [rows[f"2024-0{k}-01"].active_customers_start for k in (1, 2, 3)] == [1, 3, 2]
    assert [rows[f"2024-0{k}-01"].churned_customers for k in (1, 2, 3)] == [0, 2, 1]
    assert rows["2024-02-01"].active_mrr_start == 70.0 and rows["2024-02-01"].churned_mrr == 70.0
    assert rows["2024-03-01"].customer_churn_rate == 0.5 and rows["2024-03-01"].retention_rate == 0.5


def test_trend_without_base(spark):
    one = subs(spark, [(1, "2024-01-15", "2024-01-20", 10, "Monthly", "churned")])
    (row,) = trend.monthly_trend(one, day(spark, "2024-01-31")).collect()
    assert row.active_customers_start == 0 and row.churned_customers == 1 and row.customer_churn_rate is None
    (row,) = trend.monthly_kpis(one, day(spark, "2024-01-31")).collect()
    assert row.customer_churn_rate == 0.0


def test_cohorts(spark, edges):
    rows = {(str(r.cohort_month), str(r.observation_month)): r for r in cohorts.cohort_retention(edges, day(spark, "2024-03-31")).collect()}
    assert rows["2024-01-01", "2024-01-01"].retained_customers == 3
    assert rows["2024-01-01", "2024-02-01"].retained_customers == 2  # an end on the month's last day is a loss
    assert rows["2024-02-01", "2024-02-01"].retained_customers == 0
    assert rows["2024-01-01", "2024-03-01"].revenue_retention == round(10 / 70, 6)


@pytest.mark.parametrize(
    ("start", "cycle", "want"),
    [("2024-01-31", "Monthly", "2024-03-29"), ("2024-06-01", "Monthly", "2024-06-01"), (None, "Monthly", None), ("2023-02-29"[:8] + "28", "Annual", "2025-02-28"), ("2024-02-29", "Quarterly", "2024-05-29")],
)
def test_next_renewal(spark, start, cycle, want):
    rows = subs(spark, [(1, start, None, 1, cycle, "active")])
    (row,) = features.renewals(rows, day(spark, "2024-02-29")).collect()
    assert row.next_renewal_date == d(want)


def test_windows_have_open_starts(spark):
    today = d("2024-06-30")
    rows = [(1, today - dt.timedelta(days=n), 1, 50.0, 1, 10) for n in (0, 29, 30, 59, 60, 89, 90)]
    usage = spark.createDataFrame(rows, "customer_id long, usage_date date, sessions int, feature_adoption_score double, support_tickets int, nps_score int")
    (row,) = features.usage_windows(usage, day(spark, "2024-06-30")).collect()
    assert (row.recent_sessions_30d, row.recent_sessions_90d) == (2, 6)


def test_payments(spark):
    today = d("2024-06-30")
    rows = [(1, 1, today, 85.0, "paid"), (2, 1, today - dt.timedelta(days=100), 100.0, "paid"), (3, 2, today, 5.0, "failed"), (4, 3, today, 84.0, "paid"), (5, 3, today - dt.timedelta(days=100), 100.0, "paid")]
    pays = spark.createDataFrame(rows, "payment_id long, customer_id long, payment_date date, amount double, payment_status string")
    s = subs(spark, [(1, "2024-01-01", None, 1, "Monthly", "active"), (3, "2024-01-01", None, 1, "Weekly", "active")])
    got = {r.customer_id: r for r in features.payment_windows(pays, s, day(spark, "2024-06-30")).collect()}
    assert set(got) == {1, 3} and got[1].contraction_flag == 0 and got[3].contraction_flag == 1
    assert {r.customer_id: r.failed_payments_90d for r in features.payment_windows(pays, s, day(spark, "2024-06-30"), True).collect()}[2] == 1


def test_mean_payments_round_as_their_exact_mean(spark):
    # added as doubles, the cents are lost beside the large amounts, all or some of them as the order has it
    amounts = [float(v) for v in "3E14 0.01 0.01 0.01 -3E14".split()]
    rows = [(k, 1, d("2024-06-01"), v, "paid") for k, v in enumerate(amounts)]
    pays = spark.createDataFrame(rows, "payment_id long, customer_id long, payment_date date, amount double, payment_status string")
    s = subs(spark, [(1, "2024-01-01", None, 1, "Quarterly", "active")])
    for some in (pays, pays.orderBy(F.desc("payment_id")), pays.repartition(3, "payment_id")):
        assert features.payment_windows(some, s, day(spark, "2024-06-30")).first().avg_monthly_revenue_calc == 0.002


def test_differences_from_the_trend_are_rounded_once(spark):
    # 0.00200049699... is 0.0020004970 to eight places and 0.002000 to six: apart by 0.0000004970, not by 0.0000005
    facts = spark.createDataFrame([(d("2024-01-01"), 40_240_000, 1.0, 80_500, 0.0)], "month date, active_customers_start long, active_mrr_start double, churned_customers long, churned_mrr double")
    official = spark.createDataFrame([(d("2024-01-01"), 80_500 / 40_240_000 - 4.97e-7, 0.0)], "month date, customer_churn_rate double, revenue_churn_rate double")
    refolded = trend.trend_filtered(facts)
    (row,) = validate.rows({"k": validate._dashboard([])["kpi_cube_vs_trend"]}, {"refolded": lambda: validate.refolded_beside(refolded, official)}).collect()
    assert row.status == "PASS" and "max_customer_diff=0.000000;" in row.evidence


def test_percent_rank_shares_ties(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, -3.0), (5, 1e9)], "k long, v double")
    got = {r.k: r["rank"] for r in percent_rank_avg(rows, "k", "v").collect()}
    assert got == {4: 0.2, 3: 0.4, 1: 0.7, 2: 0.7, 5: 1.0}
    places = {r.k: r.place for r in ordinal(rows, "v", "k", out="place").collect()}
    assert places == {5: 1, 1: 2, 2: 3, 3: 4, 4: 5}


def test_driver_ties_take_the_first(spark):
    names = ["usage_decline_signal", "failed_payments_signal", "support_burden_signal", "low_nps_signal", "low_adoption_signal", "contract_renewal_risk_signal"]
    rows = spark.createDataFrame([(0.0,) * 6, (0.0, 0.0, 0.0, 0.5, 0.0, 0.0)], ", ".join(f"{n} double" for n in names))
    assert [r[0] for r in rows.select(risk.main_driver()).collect()] == ["usage decline", "low NPS"]


@pytest.mark.parametrize(("p", "c", "v", "want"), [(75, 0, 0, "critical"), (50, 85, 70, "critical"), (60, 0, 0, "high"), (40, 0, 0, "medium"), (39.99, 84.99, 99, "low")])
def test_tiers(spark, p, c, v, want):
    rows = spark.createDataFrame([(float(p), float(c), float(v))], "retention_priority_score double, churn_risk_score double, revenue_risk_score double")
    assert rows.select(risk.tier()).first()[0] == want


def feats(spark, rows):
    return spark.createDataFrame(rows, "customer_id long, segment string, region string, acquisition_channel string, plan_type string, churn_flag int, at_risk_flag int, current_mrr double, avg_monthly_revenue double")


def test_equal_values_make_one_tier(spark):
    rows = feats(spark, [(k, "a", "b", "c", "d", k % 2, 0, 1.0, 7.0) for k in range(4)])
    (row,) = drivers.value_tier_churn_mix(rows).collect()
    assert row.value_tier == "Low" and row.customers == 4 and row.share_of_churned_customers == 1.0


def test_null_dimension_stays_out(spark):
    rows = feats(spark, [(1, "a", None, "c", "d", 1, 0, 1.0, 7.0), (2, "a", "r", "c", "d", 0, 0, 1.0, 7.0)])
    assert [r.region for r in drivers.churn_by(rows, "region").collect()] == ["r"]


def test_dirty_subscriptions(spark):
    rows = spark.createDataFrame(
        [(1, 1, d("2024-01-01"), None, float("nan"), "x", "Monthly", None), (2, 1, d("2024-03-01"), d("2024-02-01"), -1.0, "Annual", None, "active")], SUBS
    )
    got = {r.check_name: r.failed_rows for r in quality.subscription_checks(rows).collect()}
    assert got == {"impossible_revenue_values": 2, "invalid_subscription_status": 1, "invalid_contract_type": 1, "invalid_billing_cycle": 1, "subscription_end_before_start": 1}
    assert quality.overlapping_subscriptions(rows, day(spark, "2024-06-30")).first().failed_rows == 1
    assert validate.overlap_customers(rows).first().status == "FAIL"


def test_contract(spark):
    rows = spark.createDataFrame([("a",), ("a",), (" ",), (None,)], "k string")
    got = {r.check_name: r.evidence for r in contracts.contract_checks("t", rows, contracts.Contract("k", ("k", "z"))).collect()}
    assert got["required_columns_present"] == "missing_columns=['z']"
    assert got["primary_key_not_null"].endswith("null_rows=2") and got["primary_key_unique"].endswith("duplicate_rows=1")


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(validate.QUALITY, "Duplicate handling", "FAIL")], "publish-blocked"),
        ([(validate.GOVERNANCE, "x", "FAIL")], "publish-blocked"),
        ([(validate.QUALITY, "Payment consistency", "WARN")], "decision-support only"),
        ([(validate.QUALITY, "Payment consistency", "WARN"), (validate.INTEGRITY, "Overclaiming risk", "WARN")], "screening-grade only"),
    ],
)
def test_gate(spark, rows, want):
    checks = spark.createDataFrame([(*r, "") for r in rows], "category string, check_name string, status string, evidence string")
    assert release.release_matrix(release.with_severity(checks)).first().recommended_state == want


def test_clean_gate_without_simulation(spark):
    checks = spark.createDataFrame([(validate.QUALITY, "x", "PASS", "")], "category string, check_name string, status string, evidence string")
    assert release.release_matrix(release.with_severity(checks), synthetic_data=False).first().recommended_state == "analytically acceptable"


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "subscriptions.csv").write_text(
        "subscription_id,customer_id,subscription_start_date,subscription_end_date,monthly_revenue,contract_type,billing_cycle,status\n"
        "s1,c1,2024-01-01,,NaN,Annual,Monthly,active\ns2,c2,oops,2024-02-01,5.5,Annual,Monthly,churned\n"
    )
    rows = tables.load(spark, str(tmp_path), "subscriptions", "csv")
    a, b = rows.orderBy("subscription_id").collect()
    assert a.subscription_end_date is None and a.monthly_revenue is None and b.subscription_start_date is None
    assert tables.clean_subscriptions(rows).count() == 1
    tables.write(rows, str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).where(F.col("status") == "churned").count() == 1


def test_a_write_that_fails_leaves_the_old_mart_whole(spark, tmp_path):
    place = str(tmp_path / "mart")
    tables.write(spark.range(5).toDF("x"), place)
    broken = spark.range(5).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        tables.write(broken, place)
    assert spark.read.parquet(place).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["mart"]
    tables.write(spark.read.parquet(place).where("x < 3"), place)  # from itself
    assert sorted(r.x for r in spark.read.parquet(place).collect()) == [0, 1, 2] and [p.name for p in tmp_path.iterdir()] == ["mart"]


def test_rows_repeat_only_if_all_columns_and_nulls_are_alike(spark):
    rows = spark.createDataFrame([("a", None, 1.0), ("a", None, 1.0), (None, "a", 1.0), ("", "a", 1.0), ("a", "", None), ("aa", None, 1.0)], "x string, y string, z double")
    assert profile.repeated_rows(rows).first().repeats == profile.repeats(rows, "x", "y", "z").first().repeats == 1


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_payments_meet_the_billing_cycle_as_sums(spark):
    pays = spark.createDataFrame([(1, 1, d("2024-06-01"), 30.0, "paid"), (2, 1, d("2024-06-02"), 60.0, "paid")], "payment_id long, customer_id long, payment_date date, amount double, payment_status string")
    two = spark.createDataFrame([(1, "Monthly"), (1, "Quarterly")], "customer_id long, billing_cycle string")
    rows = features.payment_windows(pays, two, day(spark, "2024-06-30"))
    said = plan(rows)
    assert "Join LeftOuter" in said and said.index("Join LeftOuter") < said.rindex("Aggregate [customer_id")  # aggregated below the join
    (row,) = rows.collect()
    # a payment counts once for each subscription, as if it were joined to both
    assert row.lifetime_revenue == 180.0 and row.avg_monthly_revenue_calc == (30 + 60 + 10 + 20) / 4


def test_a_cell_is_not_a_cube(spark):
    names = ["segment", "region", "acquisition_channel", "plan_type", "risk_tier"]
    rows = spark.createDataFrame(
        [(k, *(f"{n}{k % 2}" for n in names[:4]), "high" if k % 3 else "critical", 10.0 * k, 1, 50.0, float(k)) for k in range(12)],
        "customer_id long, segment string, region string, acquisition_channel string, plan_type string, risk_tier string, current_mrr double, at_risk_flag int, churn_risk_score double, retention_priority_score double",
    ).withColumn("churn_flag", F.lit(0))
    cube = cubes.risk_kpi_cube(rows)
    for scope, tier in (({}, cubes.ALL), ({"segment": "segment1"}, "high"), ({"region": "region0", "plan_type": "all"}, cubes.ALL), ({"segment": "none"}, cubes.ALL)):
        cell = cubes.kpi_cell(rows, scope, tier)
        assert "Expand" not in plan(cell) and cell.collect() == cubes.kpi_lookup(cube, scope, tier).collect()


def test_ranks_across_many_cuts_and_ties(spark):
    r = random.Random(4)
    rows = [(k, r.choice([0.0, 0.0, 1.5, -2.0, r.uniform(-5, 5), float(r.randint(0, 30))]), None if k % 11 == 0 else float(r.randint(0, 3))) for k in range(400)]
    df = spark.createDataFrame(rows, "k long, v double, w double").repartition(3)
    for drawn in (0, 5, 40, 1023):
        got = {(x.k, x.name): x["rank"] for x in percent_rank_avg(df, "k", "v", "w", drawn=drawn).collect()}
        for name, at in (("v", 1), ("w", 2)):
            values = [x[at] for x in rows if x[at] is not None]
            want = {x[0]: (sum(y < x[at] for y in values) + (sum(y == x[at] for y in values) + 1) / 2) / len(values) for x in rows if x[at] is not None}
            assert {k: v for (k, n), v in got.items() if n == name} == pytest.approx(want)
        places = {x.k: x.place for x in ordinal(df, "v", F.col("w").isNull(), -F.col("w"), "k", out="place", drawn=drawn).collect()}
        order = sorted(rows, key=lambda x: (-x[1], x[2] is None, -(x[2] or 0), x[0]))
        assert places == {x[0]: n + 1 for n, x in enumerate(order)}
    said = ordinal(df, "v", "k").select("rank")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(v" not in said


def test_quantiles_put_few_buckets_in_order(spark):
    r = random.Random(9)
    rows = [(k % 2, r.choice([0.0, 3.0, r.gauss(0, 50)])) for k in range(501)] + [(0, None)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(3)
    for p in (0.0, 0.25, 0.4, 0.75, 0.995, 1.0):
        for by in ((), ("g",)):
            for row in quantiles(df, {"q": ("v", p)}, *by).collect():
                values = sorted(v for g, v in rows if v is not None and (not by or g == row.g))
                at = p * (len(values) - 1)
                low, high = values[math.floor(at)], values[math.ceil(at)]
                assert row.q == pytest.approx(low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high)
    assert "percentile" not in plan(quantiles(df, {"q": ("v", 0.5)}))


def test_contracts_come_from_a_file_and_missing_datasets_are_issues(spark, tmp_path):
    (tmp_path / "contracts.json").write_text(
        '{"version": 1, "datasets": {"people": {"path": "raw/people.csv", "primary_key": "id", "required_columns": ["id", "name"]},'
        ' "gone": {"path": "raw/gone.csv", "primary_key": "id", "required_columns": ["id"]}, "cells": {"path": "cells", "primary_key": "k", "required_columns": ["k", "z"]}}}'
    )
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "people.csv").write_text("id,name\n1,a\n2,b\n2,c\n,d\n")
    spark.range(3).toDF("k").write.parquet(str(tmp_path / "cells"))
    declared = contracts.read_contracts(spark, str(tmp_path / "contracts.json"))
    assert declared["people"] == contracts.Contract("id", ("id", "name"), "raw/people.csv")
    checks = contracts.check_files(spark, str(tmp_path), declared)
    assert checks.columns == ["dataset", "check_name", "status", "severity", "evidence"] and checks.count() == 5 + 1 + 5
    got = {(r.dataset, r.check_name): r.evidence for r in contracts.issues(checks).collect()}
    assert got == {
        ("gone", "dataset_exists"): "path=raw/gone.csv; exists=False",
        ("people", "primary_key_not_null"): "primary_key=id; null_rows=1",
        ("people", "primary_key_unique"): "primary_key=id; duplicate_rows=1",
        ("cells", "required_columns_present"): "missing_columns=['z']",
    }
