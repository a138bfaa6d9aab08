"""Churn and retention by calendar month."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import beside, money, month, rnd, share
from ..params import ALL, DIMS, MIN_TREND_BASE

_CENTS = "decimal(28,4)"


def month_spine(subscriptions: DataFrame, snapshot: DataFrame) -> DataFrame:
    """All months from the first start to the snapshot's."""
    first = subscriptions.agg(F.min("subscription_start_date").alias("first"))
    return first.crossJoin(snapshot).select(F.explode(F.expr("sequence(trunc(first, 'month'), trunc(snapshot_date, 'month'), interval 1 month)")).alias("month"))


def month_changes(subscriptions: DataFrame, *keys: str) -> DataFrame:
    """What each subscription changes: it becomes active at the first month start in it, and goes after the last.

    A churn event falls in the end date's month in any case. Amounts are exact decimals,
    so that adding and taking away leaves nothing.
    """
    start, end = F.col("subscription_start_date"), F.col("subscription_end_date")
    on = F.when(F.dayofmonth(start) == 1, start).otherwise(F.add_months(month(start), 1))
    last = month(end)
    lives = start.isNotNull() & (end.isNull() | (on <= last))
    mrr = F.col("monthly_revenue").cast(_CENTS)
    zero = F.lit(0).cast(_CENTS)
    event = lambda when, at, n, m, cn, cm: F.when(when, F.struct(at.alias("month"), F.lit(n).alias("n"), m.alias("m"), F.lit(cn).alias("cn"), cm.alias("cm")))
    events = F.array(
        event(lives, on, 1, mrr, 0, zero),
        event(lives & end.isNotNull(), F.add_months(last, 1), -1, (-mrr).cast(_CENTS), 0, zero),
        event(end.isNotNull(), last, 0, zero, 1, mrr),
    )
    rows = subscriptions.select(*keys, F.explode(F.array_compact(events)).alias("e")).select(*keys, "e.*")
    return rows.groupBy("month", *keys).agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("cn").alias("cn"), F.sum("cm").alias("cm"))


def _run_up(subscriptions: DataFrame, snapshot: DataFrame) -> DataFrame:
    spine = month_spine(subscriptions, snapshot)
    upto = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)  # a row for each month
    zero = F.lit(0).cast(_CENTS)
    return spine.join(month_changes(subscriptions), "month", "left").select(
        "month",
        F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("active_customers_start"),
        F.coalesce(F.sum("m").over(upto), zero).cast("double").alias("active"),
        F.coalesce("cn", F.lit(0)).cast("bigint").alias("churned_customers"),
        F.coalesce("cm", zero).cast("double").alias("churned"),
    )


def monthly_trend(subscriptions: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Active at month start, churned within the month, and rates; rates of an empty month are null."""
    rate = share(F.col("churned_customers"), F.col("active_customers_start"))
    return _run_up(subscriptions, snapshot).select(
        "month",
        "active_customers_start",
        rnd("active", 2).alias("active_mrr_start"),
        "churned_customers",
        rnd("churned", 2).alias("churned_mrr"),
        rnd(rate, 6).alias("customer_churn_rate"),
        rnd(share(F.col("churned"), F.col("active")), 6).alias("revenue_churn_rate"),
        rnd(1 - rate, 6).alias("retention_rate"),
    )


def monthly_kpis(subscriptions: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The mart's variant: rates of an empty month are 0, and there is no retention rate."""
    zero = F.lit(0.0)
    return _run_up(subscriptions, snapshot).select(
        "month",
        "active_customers_start",
        rnd("active", 4).alias("active_mrr_start"),
        "churned_customers",
        rnd("churned", 4).alias("churned_mrr"),
        rnd(F.coalesce(share(F.col("churned_customers"), F.col("active_customers_start")), zero), 9).alias("customer_churn_rate"),
        rnd(F.coalesce(share(F.col("churned"), F.col("active")), zero), 9).alias("revenue_churn_rate"),
    )


def dimensional_trend(features: DataFrame, subscriptions: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Monthly counts and revenue by dimensions; combinations without an active or churned customer have no row.

    Each combination's changes run up over its own months; customers without all dimensions stay out.
    """
    dims = list(DIMS)
    subs = subscriptions.join(features.select("customer_id", *dims).dropna(subset=dims).hint("merge"), "customer_id")
    changes = month_changes(subs, *dims)
    first = changes.groupBy(*dims).agg(F.min("month").alias("first"))
    grid = beside(first, snapshot).select(
        *dims, F.explode(F.expr("case when first <= snapshot_date then sequence(first, trunc(snapshot_date, 'month'), interval 1 month) else array() end")).alias("month")
    )
    upto = Window.partitionBy(*dims).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast(_CENTS)
    rows = grid.join(changes, [*dims, "month"], "left").select(
        "month",
        *dims,
        F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("active_customers_start"),
        rnd(F.coalesce(F.sum("m").over(upto), zero), 2).alias("active_mrr_start"),
        F.coalesce("cn", F.lit(0)).cast("bigint").alias("churned_customers"),
        rnd(F.coalesce("cm", zero), 2).alias("churned_mrr"),
    )
    return rows.where("active_customers_start > 0 or churned_customers > 0")


def churn_slope(trend: DataFrame, months: int = 12) -> DataFrame:
    """One row: least-squares slope and mean of the rates over the last full months."""
    last = trend.where(F.col("active_customers_start") >= MIN_TREND_BASE).orderBy(F.desc("month")).limit(months)
    last = last.withColumn("i", F.row_number().over(Window.orderBy("month")) - 1)
    slope = lambda c: rnd(F.when(F.count("*") >= 3, F.regr_slope(c, F.col("i").cast("double"))).otherwise(0.0), 8)
    return last.agg(
        slope("customer_churn_rate").alias("customer_churn_slope_last12"),
        slope("revenue_churn_rate").alias("revenue_churn_slope_last12"),
        rnd(F.avg("customer_churn_rate"), 8).alias("avg_customer_churn_last12"),
        rnd(F.avg("revenue_churn_rate"), 8).alias("avg_revenue_churn_last12"),
    )


def overall_health(features: DataFrame, subscriptions: DataFrame, trend: DataFrame) -> DataFrame:
    """One row of totals beside the trend's slopes."""
    churned = F.col("churn_flag") == 1
    totals = features.agg(
        F.count("*").alias("total_customers"),
        F.count_if(~churned).alias("active_customers"),
        F.count_if(churned).alias("churned_customers"),
        F.count_if(F.col("at_risk_flag") == 1).alias("at_risk_customers"),
        money("avg_monthly_revenue").alias("total_monthly_value"),
        money(F.when(churned, F.col("avg_monthly_revenue"))).alias("churned_monthly_value"),
        money(F.when(F.col("at_risk_flag") == 1, F.col("current_mrr"))).alias("at_risk_mrr"),
    )
    day = subscriptions.agg(F.greatest(F.max("subscription_start_date"), F.max("subscription_end_date")).alias("snapshot_date"))
    c = F.coalesce(share(F.col("churned_customers"), F.col("total_customers")), F.lit(0.0))
    r = F.coalesce(share(F.col("churned_monthly_value"), F.col("total_monthly_value")), F.lit(0.0))
    return day.crossJoin(totals).crossJoin(churn_slope(trend)).select(
        "snapshot_date",
        "total_customers",
        "active_customers",
        "churned_customers",
        "at_risk_customers",
        rnd(c, 8).alias("customer_churn_rate"),
        rnd("total_monthly_value", 2).alias("total_monthly_value"),
        rnd("churned_monthly_value", 2).alias("churned_monthly_value"),
        rnd(r, 8).alias("revenue_churn_rate"),
        rnd("at_risk_mrr", 2).alias("at_risk_mrr"),
        rnd(r - c, 8).alias("customer_vs_revenue_churn_delta"),
        "avg_customer_churn_last12",
        "avg_revenue_churn_last12",
        "customer_churn_slope_last12",
        "revenue_churn_slope_last12",
    )


def rolling3(trend: DataFrame) -> DataFrame:
    """Trailing means of three months; fewer at the start, nulls left out."""
    w = Window.orderBy("month").rowsBetween(-2, 0)
    return trend.select("month", *[x for c in ("customer_churn_rate", "revenue_churn_rate") for x in (F.col(c), rnd(F.avg(c).over(w), 8).alias(f"{c}_3m"))])


def trend_filtered(facts: DataFrame, filters: dict[str, str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The monthly facts of a scope summed up again; rates of an empty base are 0."""
    rows = facts
    for dim, value in (filters or {}).items():
        if value not in (None, "all", ALL):
            rows = rows.where(F.col(dim) == value)
    if start:
        rows = rows.where(F.col("month") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("month") <= F.lit(end).cast("date"))
    rows = rows.groupBy("month").agg(
        F.sum("active_customers_start").alias("active_customers_start"),
        rnd(money("active_mrr_start"), 2).alias("active_mrr_start"),
        F.sum("churned_customers").alias("churned_customers"),
        rnd(money("churned_mrr"), 2).alias("churned_mrr"),
    )
    zero = F.lit(0.0)
    rate = share(F.col("churned_customers"), F.col("active_customers_start"))
    return rows.withColumns(
        {
            "customer_churn_rate": rnd(F.coalesce(rate, zero), 8),
            "revenue_churn_rate": rnd(F.coalesce(share(F.col("churned_mrr"), F.col("active_mrr_start")), zero), 8),
            "retention_rate": rnd(F.coalesce(1 - rate, zero), 8),
        }
    )


def last_months(trend: DataFrame, months: int | None) -> DataFrame:
    """The last so many months of what is covered; all without a number."""
    if months is None:
        return trend
    end = trend.agg(F.max("month").alias("_end"))
    return beside(trend, end).where(F.col("month") >= F.add_months("_end", 1 - months)).drop("_end")


def latest_vs_prior(trend: DataFrame) -> DataFrame:
    """One row: the last month and its change from the one before."""
    w = Window.orderBy("month")
    before = lambda c: F.lag(c).over(w)
    rows = trend.select(
        "month",
        "active_customers_start",
        "churned_customers",
        "customer_churn_rate",
        "revenue_churn_rate",
        (F.col("active_customers_start") - before("active_customers_start")).alias("active_delta"),
        rnd((F.col("customer_churn_rate") - before("customer_churn_rate")) * 100, 4).alias("customer_churn_delta_pp"),
        rnd((F.col("revenue_churn_rate") - before("revenue_churn_rate")) * 100, 4).alias("revenue_churn_delta_pp"),
    )
    return rows.orderBy(F.desc("month")).limit(1)
