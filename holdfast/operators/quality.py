"""Row-level quality checks: one row a check, with failed rows over a denominator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import beside, count_if, rnd, share
from ..params import CONTRACTS, CYCLE_MONTHS, PAYMENT_STATUSES, STATUSES
from .profile import repeats


def _outside(c: str, values) -> Column:
    """Not one of the values; a null isn't one either."""
    return ~F.coalesce(F.col(c).isin(*values), F.lit(False))


def not_positive(c: str) -> Column:
    v = F.col(c)
    return v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v <= 0)


def _rows(counts: DataFrame, table: str, checks: list[tuple[str, Column, Column, str]]) -> DataFrame:
    """Checks read off one row of counts."""
    listed = F.array(
        *[
            F.struct(
                F.lit(f"dq_{name}").alias("check_name"), failed.cast("bigint").alias("failed_rows"), of.cast("bigint").alias("denominator"), F.lit(severity).alias("severity")
            )
            for name, failed, of, severity in checks
        ]
    )
    rows = counts.select(F.explode(listed).alias("c")).select(F.lit(table).alias("table_name"), "c.*")
    rate = rnd(F.coalesce(share(F.col("failed_rows"), F.col("denominator")), F.lit(0.0)), 6)
    return rows.select(
        "table_name", F.expr("substr(check_name, 4)").alias("check_name"), "failed_rows", "denominator", rate.alias("failure_rate"), "severity",
        F.when(F.col("failed_rows") > 0, "FAIL").otherwise("PASS").alias("status"),
    )


def overlapping_subscriptions(subscriptions: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Starts that don't come after the end of the customer's subscription before, an open one ending at the snapshot."""
    w = Window.partitionBy("customer_id").orderBy(F.asc_nulls_last("subscription_start_date"), F.asc_nulls_last("subscription_end_date"))
    end = F.coalesce("subscription_end_date", "snapshot_date")
    rows = beside(subscriptions, snapshot).select("customer_id", (F.col("subscription_start_date") <= F.lag(end).over(w)).alias("bad"))
    by_customer = rows.groupBy("customer_id").agg(count_if(F.col("bad")).alias("n"))
    counts = by_customer.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("bad"), F.count("customer_id").alias("customers"))
    return _rows(counts, "subscriptions", [("overlapping_subscriptions", F.col("bad"), F.col("customers"), "high")])


def subscription_checks(subscriptions: DataFrame) -> DataFrame:
    n = F.col("n")
    counts = subscriptions.agg(
        F.count("*").alias("n"),
        count_if(not_positive("monthly_revenue")).alias("revenue"),
        count_if(_outside("status", STATUSES)).alias("status"),
        count_if(_outside("contract_type", CONTRACTS)).alias("contract"),
        count_if(_outside("billing_cycle", CYCLE_MONTHS)).alias("cycle"),
        count_if(F.col("subscription_end_date") < F.col("subscription_start_date")).alias("dates"),
    )
    c = F.col
    return _rows(
        counts,
        "subscriptions",
        [
            ("impossible_revenue_values", c("revenue"), n, "high"),
            ("invalid_subscription_status", c("status"), n, "high"),
            ("invalid_contract_type", c("contract"), n, "medium"),
            ("invalid_billing_cycle", c("cycle"), n, "medium"),
            ("subscription_end_before_start", c("dates"), n, "high"),
        ],
    )


def _periods(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.select("customer_id", "subscription_start_date", "subscription_end_date")


def usage_outside_subscription_period(usage: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Usage without a subscription, or before or after it; a row for each subscription of the customer."""
    day, a, b = F.col("usage_date"), F.col("subscription_start_date"), F.col("subscription_end_date")
    rows = usage.select("customer_id", "usage_date").join(_periods(subscriptions), "customer_id", "left")
    counts = rows.agg(count_if(a.isNull() | (day < a) | F.coalesce(day > b, F.lit(False))).alias("bad"), F.count("*").alias("n"))
    return _rows(counts, "product_usage", [("usage_outside_subscription_period", F.col("bad"), F.col("n"), "high")])


def payment_inconsistencies(payments: DataFrame, subscriptions: DataFrame) -> DataFrame:
    day, a, b = F.col("payment_date"), F.col("subscription_start_date"), F.col("subscription_end_date")
    off = F.coalesce(day < a, F.lit(False)) | F.coalesce(day > b, F.lit(False)) | a.isNull()
    rows = payments.join(_periods(subscriptions), "customer_id", "left")
    bad = rows.agg(count_if(_outside("payment_status", PAYMENT_STATUSES) | not_positive("amount") | off).alias("bad"))
    counts = bad.crossJoin(payments.agg(F.count("*").alias("n")))
    return _rows(counts, "payments", [("payment_inconsistencies", F.col("bad"), F.col("n"), "high")])


def usage_checks(usage: DataFrame) -> DataFrame:
    c, n = F.col, F.col("n")
    beyond = lambda x, lo, hi: count_if((c(x) < lo) | (c(x) > hi))
    counts = usage.agg(
        F.count("*").alias("n"),
        count_if(c("sessions") < 0).alias("sessions"),
        beyond("feature_adoption_score", 0, 100).alias("adoption"),
        count_if(c("support_tickets") < 0).alias("tickets"),
        beyond("nps_score", -100, 100).alias("nps"),
    )
    return _rows(
        counts,
        "product_usage",
        [
            ("negative_sessions", c("sessions"), n, "high"),
            ("feature_adoption_out_of_range", c("adoption"), n, "high"),
            ("negative_support_tickets", c("tickets"), n, "high"),
            ("nps_out_of_range", c("nps"), n, "high"),
        ],
    )


def signup_date_in_future(customers: DataFrame, snapshot: DataFrame) -> DataFrame:
    counts = beside(customers, snapshot).agg(count_if(F.col("signup_date") > F.col("snapshot_date")).alias("bad"), F.count("*").alias("n"))
    return _rows(counts, "customers", [("signup_date_in_future", F.col("bad"), F.col("n"), "medium")])


def duplicate_payment_id(payments: DataFrame) -> DataFrame:
    counts = repeats(payments, "payment_id").crossJoin(payments.agg(F.count("*").alias("n")))
    return _rows(counts, "payments", [("duplicate_payment_id", F.col("repeats"), F.col("n"), "high")])


def all_checks(customers: DataFrame, subscriptions: DataFrame, usage: DataFrame, payments: DataFrame, snapshot: DataFrame) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [
            overlapping_subscriptions(subscriptions, snapshot),
            subscription_checks(subscriptions),
            usage_outside_subscription_period(usage, subscriptions),
            payment_inconsistencies(payments, subscriptions),
            usage_checks(usage),
            signup_date_in_future(customers, snapshot),
            duplicate_payment_id(payments),
        ],
    )
