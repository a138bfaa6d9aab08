"""Retention by start-month cohort, and by segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import beside, count_if, money, month, month_number, rnd, share
from ..params import COHORT_TREND_STEP


def cohort_retention(subscriptions: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Every cohort in every month from its own to the snapshot's.

    A customer is retained in a month if the subscription is open or ends after the
    month's last day. Losses are summed by cohort and end month, then run up over the grid.
    """
    subs = subscriptions.where("subscription_start_date is not null").select(
        month("subscription_start_date").alias("cohort_month"), month("subscription_end_date").alias("lost_month"), "monthly_revenue"
    )
    size = subs.groupBy("cohort_month").agg(F.count("*").alias("active_customers"), F.sum(F.col("monthly_revenue").cast("decimal(28,4)")).alias("mrr"))
    lost = subs.where("lost_month is not null").groupBy("cohort_month", F.greatest("lost_month", "cohort_month").alias("observation_month"))
    lost = lost.agg(F.count("*").alias("n"), F.sum(F.col("monthly_revenue").cast("decimal(28,4)")).alias("m"))
    grid = beside(size, snapshot).withColumn(
        "observation_month", F.explode(F.expr("case when cohort_month <= snapshot_date then sequence(cohort_month, trunc(snapshot_date, 'month'), interval 1 month) else array() end"))
    )
    upto = Window.partitionBy("cohort_month").orderBy("observation_month").rowsBetween(Window.unboundedPreceding, 0)
    rows = grid.join(lost, ["cohort_month", "observation_month"], "left")
    gone, worth = F.coalesce(F.sum("n").over(upto), F.lit(0)), F.coalesce(F.sum("m").over(upto), F.lit(0))
    rows = rows.select("cohort_month", "observation_month", "active_customers", "mrr", (F.col("active_customers") - gone).alias("kept"), (F.col("mrr") - worth).alias("kept_mrr"))
    return rows.select(
        "cohort_month",
        "observation_month",
        "active_customers",
        F.col("kept").alias("retained_customers"),
        rnd(F.col("kept") / F.col("active_customers"), 6).alias("retention_rate"),
        rnd(F.coalesce(share(F.col("kept_mrr").cast("double"), F.col("mrr").cast("double")), F.lit(0.0)), 6).alias("revenue_retention"),
    )


def segment_retention(features: DataFrame) -> DataFrame:
    churned, risk = F.col("churn_flag") == 1, F.col("at_risk_flag") == 1
    exposed = F.when(risk, F.col("current_mrr")).otherwise(0.0) + F.when(churned, F.col("avg_monthly_revenue")).otherwise(0.0)
    return features.where("segment is not null").groupBy("segment").agg(
        count_if(~churned).alias("active_customers"),
        count_if(churned).alias("churned_customers"),
        rnd(F.avg("churn_flag"), 6).alias("churn_rate"),
        rnd(money(exposed), 2).alias("revenue_at_risk"),
        rnd(F.avg("tenure_days"), 2).alias("avg_tenure"),
        rnd(F.avg("nps_score_recent"), 2).alias("avg_nps"),
        rnd(F.avg("usage_trend"), 4).alias("avg_usage_trend"),
    )


def with_age(cohorts: DataFrame) -> DataFrame:
    return cohorts.withColumn("cohort_age_months", month_number("observation_month") - month_number("cohort_month"))


def cohort_health(cohorts: DataFrame) -> DataFrame:
    """One row: how the newer cohorts at six months compare with the older ones."""
    aged = with_age(cohorts)
    six = aged.where("cohort_age_months = 6").select("cohort_month", "retention_rate", "revenue_retention")
    # a row for each cohort month: a single task is enough
    order = Window.orderBy("cohort_month")
    six = six.withColumns({"up": F.row_number().over(order), "down": F.row_number().over(Window.orderBy(F.desc("cohort_month")))})
    six = six.withColumn("w", F.least(F.lit(6), F.floor((F.col("up") + F.col("down") - 1) / 2)))
    early, late, enough = F.col("up") <= F.col("w"), F.col("down") <= F.col("w"), F.count("*") >= 6
    delta = lambda c: F.when(enough, F.avg(F.when(late, F.col(c))) - F.avg(F.when(early, F.col(c)))).otherwise(0.0)
    one = six.agg(
        F.count("*").alias("mature_cohort_count_at_6m"),
        rnd(F.avg("retention_rate"), 6).alias("avg_6m_retention"),
        rnd(F.avg("revenue_retention"), 6).alias("avg_6m_revenue_retention"),
        rnd(delta("retention_rate"), 6).alias("retention_delta_recent_vs_early_6m"),
        rnd(delta("revenue_retention"), 6).alias("revenue_retention_delta_recent_vs_early_6m"),
    )
    d = F.col("retention_delta_recent_vs_early_6m")
    label = F.when(d > COHORT_TREND_STEP, "improving").when(d < -COHORT_TREND_STEP, "deteriorating").otherwise("mixed/stable")
    return aged.agg(F.count_distinct("cohort_month").alias("cohort_count")).crossJoin(one).withColumn("cohort_trend_label", label)


def cohort_curves_sample(cohorts: DataFrame, curves: int = 10, months: int = 18) -> DataFrame:
    """Curves of up to ``curves`` cohorts, evenly spaced by their place."""
    rows = with_age(cohorts).where(F.col("cohort_age_months").between(0, months))
    place = rows.select("cohort_month").distinct().withColumn("i", F.row_number().over(Window.orderBy("cohort_month")) - 1)
    n = place.agg(F.count("*").alias("n"))
    steps = rows.sparkSession.range(curves).crossJoin(n).select(F.floor(F.col("id") * (F.col("n") - 1) / (curves - 1)).alias("i")).distinct()
    chosen = place.crossJoin(F.broadcast(n)).join(steps.withColumn("hit", F.lit(1)), "i", "left").where((F.col("n") <= curves) | (F.col("hit") == 1))
    return rows.join(F.broadcast(chosen.select("cohort_month")), "cohort_month").select("cohort_month", "cohort_age_months", "retention_rate")


def cohort_revenue_matrix(cohorts: DataFrame, newest: int = 18, months: int = 12) -> DataFrame:
    rows = with_age(cohorts).where(F.col("cohort_age_months").between(0, months))
    last = rows.select("cohort_month").distinct().orderBy(F.desc("cohort_month")).limit(newest)
    wide = rows.join(F.broadcast(last), "cohort_month").groupBy("cohort_month").pivot("cohort_age_months", list(range(months + 1))).agg(rnd(F.avg("revenue_retention"), 6))
    return wide.select("cohort_month", *[F.col(str(k)).alias(f"age_{k}") for k in range(months + 1)])


def cohort_filtered(cohorts: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows whose observation month is in the range, with their age."""
    rows = with_age(cohorts)
    if start:
        rows = rows.where(F.col("observation_month") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("observation_month") <= F.lit(end).cast("date"))
    return rows.select("cohort_month", "observation_month", "cohort_age_months", "active_customers", "retained_customers", "retention_rate", "revenue_retention")


def cohort_latest_revenue(cohorts: DataFrame, newest: int = 12) -> DataFrame:
    return (
        cohorts.groupBy("cohort_month")
        .agg(F.max("observation_month").alias("observation_month"), F.max_by("revenue_retention", "observation_month").alias("revenue_retention"))
        .orderBy(F.desc("cohort_month"))
        .limit(newest)
    )


def cohort_recent_curves(cohorts: DataFrame, newest: int = 8) -> DataFrame:
    last = cohorts.select("cohort_month").distinct().orderBy(F.desc("cohort_month")).limit(newest)
    return with_age(cohorts).join(F.broadcast(last), "cohort_month").select("cohort_month", "cohort_age_months", "retention_rate")
