"""Layouts of tables: usage by month, marts bucketed by customer; the gate's policy from a file."""

import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from holdfast.operators import features, release
from holdfast.plans.marts import Marts
from holdfast.sources import tables

USAGE = tables.SCHEMAS["product_usage"]


def day(text):
    return datetime.date.fromisoformat(text)


def usage_rows():
    days = ["2024-01-15", "2024-03-31", "2024-04-01", "2024-04-02", "2024-05-20", "2024-06-30", None]
    return [(f"u{n}-{c}", c, d and day(d), n + 1, 0.5 * n, n % 2, 10 - n) for n, d in enumerate(days) for c in ("c1", "c2")]


def test_months_before_the_windows_are_not_read(spark, tmp_path):
    """The old months' files can't be read, and need not be; the windows are those of the plain table."""
    usage, snapshot = spark.createDataFrame(usage_rows(), USAGE), spark.sql("select date'2024-06-30' as snapshot_date")
    tables.write_usage(usage, str(tmp_path))
    place = tmp_path / tables.USAGE_BY_MONTH
    months = {p.name.partition("=")[2] for p in place.iterdir() if p.is_dir()}
    assert months == {"2024-01-01", "2024-03-01", "2024-04-01", "2024-05-01", "2024-06-01", "__HIVE_DEFAULT_PARTITION__"}
    want = sorted(map(tuple, features.usage_windows(usage, snapshot).collect()))
    for old in ("2024-01-01", "2024-03-01"):
        for f in Path(place / f"usage_month={old}").glob("*"):
            f.write_bytes(b"not parquet at all")
    recent = tables.recent_usage(spark, str(tmp_path), snapshot)
    assert recent.columns == usage.columns and recent.count() == 6
    assert sorted(map(tuple, features.usage_windows(recent, snapshot).collect())) == want and len(want) == 2


def test_recent_usage_of_empty_tables(spark, tmp_path):
    usage = spark.createDataFrame(usage_rows(), USAGE)
    tables.write_usage(usage, str(tmp_path))
    none = spark.sql("select cast(null as date) as snapshot_date")
    assert tables.recent_usage(spark, str(tmp_path), none).count() == 0


@pytest.fixture
def raw(spark, tmp_path):
    """Raw CSV files with text ids; c1 has two subscriptions, c2 one that has ended."""
    (tmp_path / "customers.csv").write_text(
        "customer_id,signup_date,segment,region,acquisition_channel,plan_type\nc1,2023-01-05,SMB,EU,Paid,Basic\nc2,2023-02-01,Enterprise,NA,Organic,Premium\n"
    )
    (tmp_path / "subscriptions.csv").write_text(
        "subscription_id,customer_id,subscription_start_date,subscription_end_date,monthly_revenue,contract_type,billing_cycle,status\n"
        "s1,c1,2023-01-05,2023-12-31,100.0,Monthly,Monthly,churned\ns2,c1,2024-01-01,,150.0,Annual,Annual,active\ns3,c2,2023-02-01,2024-05-15,900.0,Annual,Quarterly,churned\n"
    )
    spark.createDataFrame(usage_rows(), USAGE).coalesce(1).toPandas().to_csv(tmp_path / "product_usage.csv", index=False)
    (tmp_path / "payments.csv").write_text(
        "payment_id,customer_id,payment_date,amount,payment_status\np1,c1,2024-01-01,1800,paid\np2,c1,2024-06-01,,failed\np3,c2,2024-02-01,2700,paid\n"
    )
    return str(tmp_path)


def test_raw_text_files_end_to_end(spark, raw):
    """From raw CSV to features and scores, with usage as it is and by month."""
    plain = Marts.of_raw(spark, raw, "csv")
    want = sorted(map(tuple, plain.features.collect()))
    got = [(r.customer_id, r.current_mrr, r.churn_flag, r.recent_sessions_30d, r.recent_sessions_90d, r.lifetime_revenue) for r in plain.features.collect()]
    # one row a subscription; several of a customer repeat its payments, which the checks report
    assert sorted(got) == [("c1", 0.0, 1, 6, 15, 3600.0), ("c1", 150.0, 0, 6, 15, 3600.0), ("c2", 0.0, 1, 6, 15, 2700.0)]
    assert plain.scores.count() == 1 and plain.checked("join_inflation").first().status == "FAIL"
    tables.write_usage(plain.usage, raw)
    by_month = Marts.of_raw(spark, raw, "csv")
    assert sorted(map(tuple, by_month.features.collect())) == want
    plain.release()
    by_month.release()


def test_bucketed_marts_join_without_an_exchange(spark, raw):
    marts = Marts.of_raw(spark, raw, "csv")
    for _ in range(2):  # the second time replaces the first's tables
        marts.write_tables("layout_", 4)
    found = [spark.table(f"layout_{n}").hint("merge") for n in ("customer_retention_features", "customer_risk_scores")]
    joined = found[0].join(found[1].select("customer_id", "churn_risk_score"), "customer_id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 2 and "SortMergeJoin" in plan and "Exchange" not in plan
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("layout_")] == ["layout_customer_retention_features", "layout_customer_risk_scores"]
    with pytest.raises(Exception, match="oops"):
        tables.write_table(spark.table("layout_customer_risk_scores").withColumn("x", F.raise_error(F.lit("oops"))), "layout_customer_risk_scores", "customer_id", 4)
    assert spark.table("layout_customer_risk_scores").count() == 1
    for n in ("customer_retention_features", "customer_risk_scores"):
        spark.sql(f"DROP TABLE layout_{n}")
    marts.release()


YAML = """
version: 1
warn_policy:
  major_warn_threshold_for_analytical_acceptance: 0   # none
  major_warn_threshold_for_decision_support: 2
synthetic_data_policy:
  committee_grade_allowed: true
"""
JSON = '{"warn_policy": {"major_warn_threshold_for_analytical_acceptance": 0, "major_warn_threshold_for_decision_support": 2},\n "synthetic_data_policy": {"committee_grade_allowed": true}}'


@pytest.mark.parametrize("text", [YAML, JSON.replace(", ", ",\n").replace("{", "{\n")])
def test_policy_of_a_file(spark, tmp_path, text):
    (tmp_path / "policy").write_text(text)
    policy = release.read_policy(spark, str(tmp_path / "policy"))
    assert policy == release.Policy(0, 2, True)
    checks = [("Data Quality", "Payment consistency", "WARN"), ("Analytical Integrity", "Overclaiming risk", "WARN")]
    graded = release.with_severity(spark.createDataFrame([(*c, "") for c in checks], "category string, check_name string, status string, evidence string"))
    active = {r.state for r in release.release_matrix(graded, policy=policy).where("active").collect()}
    assert active == {"technically valid", "decision-support only", "screening-grade only", "not committee-grade"}
    passed = release.with_severity(spark.createDataFrame([("Data Quality", "x", "PASS", "")], "category string, check_name string, status string, evidence string"))
    states = lambda p: {r.state for r in release.release_matrix(passed, policy=p).where("active").collect()}
    assert "not committee-grade" not in states(policy) and "not committee-grade" in states(release.Policy())


def test_policy_that_says_nothing_or_nonsense(spark, tmp_path):
    (tmp_path / "none").write_text("version: 1\n")
    assert release.read_policy(spark, str(tmp_path / "none")) == release.Policy()
    (tmp_path / "bad").write_text("major_warn_threshold_for_decision_support: many\n")
    with pytest.raises(ValueError, match="many"):
        release.read_policy(spark, str(tmp_path / "bad"))
