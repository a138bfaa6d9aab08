"""Customer features at a snapshot day."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import beside, count_if, flag, money, month_number, rnd
from ..params import CONTRACTION_SHARE, CYCLE_MONTHS, RENEWAL_NEAR_DAYS


def snapshot_date(*columns: tuple[DataFrame, str], last: tuple[DataFrame, str] | None = None) -> DataFrame:
    """One row: the latest day of all given columns, nulls left out. Each table is read once.

    ``last`` is the column of the largest table. Only its days after the others' latest can change the
    result, so that the others are dropped where it is read, before what it is made of meets.
    """
    tables: dict[int, tuple[DataFrame, list[str]]] = {}
    for df, c in columns:
        tables.setdefault(id(df), (df, []))[1].append(c)
    latest = lambda cs: F.greatest(*[F.max(c) for c in cs]) if len(cs) > 1 else F.max(cs[0])
    days = [df.agg(latest(cs).alias("day")) for df, cs in tables.values()]
    found = reduce(DataFrame.union, days).agg(F.max("day").alias("snapshot_date"))
    if last is None:
        return found
    df, c = last
    later = df.where(F.coalesce(F.col(c) > found.scalar(), F.lit(True))).agg(F.max(c).alias("day"))
    return found.union(later).agg(F.max("snapshot_date").alias("snapshot_date"))


def cycle_months(c: str = "billing_cycle") -> Column:
    """Months of a billing cycle; 1 for an unknown one."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in CYCLE_MONTHS.items() for x in kv])[F.col(c)], F.lit(1))


def usage_windows(usage: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Sums and means over the last 30 and 90 days and the 30 before the last 30, a row for each customer in them.

    The days are held against a value of the snapshot alone, so that the filter reaches the scan.
    """
    age = F.datediff("snapshot_date", "usage_date")
    in30, prior = age < 30, (age >= 30) & (age < 60)
    return (
        beside(usage.where(F.col("usage_date") > snapshot.select(F.date_sub("snapshot_date", 90)).scalar()), snapshot)
        .where(age < 90)
        .groupBy("customer_id")
        .agg(
            F.coalesce(F.sum(F.when(in30, F.col("sessions"))), F.lit(0)).cast("bigint").alias("recent_sessions_30d"),
            F.coalesce(F.sum("sessions"), F.lit(0)).cast("bigint").alias("recent_sessions_90d"),
            F.coalesce(F.sum(F.when(in30, F.col("support_tickets"))), F.lit(0)).cast("bigint").alias("support_tickets_30d"),
            F.coalesce(F.sum("support_tickets"), F.lit(0)).cast("bigint").alias("support_tickets_90d"),
            F.coalesce(F.avg(F.when(in30, F.col("feature_adoption_score"))), F.lit(0.0)).alias("feature_adoption_score_recent"),
            F.coalesce(F.avg("nps_score"), F.lit(0.0)).alias("nps_score_recent"),
            F.coalesce(F.avg(F.when(in30, F.col("sessions"))), F.lit(0.0)).alias("recent_30_avg_sessions"),
            F.coalesce(F.avg(F.when(prior, F.col("sessions"))), F.lit(0.0)).alias("prior_30_avg_sessions"),
        )
        .withColumn("usage_trend", rnd(F.col("recent_30_avg_sessions") - F.col("prior_30_avg_sessions"), 4))
    )


def next_renewal(start: Column, today: Column, cycle: Column) -> Column:
    """The first renewal after ``today``: whole cycles since the start month, and one more if that day has come."""
    steps = F.floor((month_number(today) - month_number(start)) / cycle).cast("int")
    here = F.add_months(start, steps * cycle)
    return F.when(start > today, start).otherwise(F.when(here <= today, F.add_months(here, cycle)).otherwise(here))


def monthly_equivalents(payments: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Payments with their amount per month of the customer's billing cycle."""
    cycles = subscriptions.select("customer_id", cycle_months().alias("cycle_months"))
    rows = payments.join(cycles, "customer_id", "left").withColumn("cycle_months", F.coalesce("cycle_months", F.lit(1)))
    return rows.withColumn("monthly_equivalent_amount", F.col("amount") / F.col("cycle_months"))


#: Sums of amounts among ``payment_sums``.
PAYMENT_AMOUNTS = ("revenue", "all_sum", "recent_sum", "prior_sum")


def payment_sums(exact: Callable[[Column], Column] = lambda c: c.cast("decimal(28,4)")) -> dict[str, Column]:
    """Sums and counts of a customer's payments, taken beside ``snapshot_date``; ``exact`` makes amounts that add up exactly."""
    age, paid, amount = F.datediff("snapshot_date", "payment_date"), F.col("payment_status") == "paid", F.col("amount")
    recent, prior = age < 90, (age >= 90) & (age < 180)
    out = {"n_paid": count_if(paid), "revenue": F.sum(F.when(paid, exact(amount))), "failed": count_if(recent & (F.col("payment_status") == "failed"))}
    for name, when in (("all", paid), ("recent", recent & paid), ("prior", prior & paid)):
        out |= {f"{name}_sum": F.sum(F.when(when, exact(amount))), f"{name}_n": count_if(when & amount.isNotNull())}
    return out


def _paid(total: Callable[[Column], Column]) -> list[Column]:
    """Means and sums of the sums beside ``cycle_months``, several of which ``total`` adds up.

    Means are a whole number of ten-thousandths over another, divided once, so that they are the doubles next to
    the exact means whatever order payments come in, and round as these do.
    """
    year = lcm(*CYCLE_MONTHS.values())
    whole = lambda name: total(F.col(f"{name}_sum") * F.expr(f"{year} div cycle_months").cast("int") * 10_000).cast("double")
    per_month = lambda name: F.try_divide(whole(name), total(F.col(f"{name}_n")) * year * 10_000)
    return [
        total(F.col("n_paid")).alias("n_paid"),
        F.coalesce(total(F.col("revenue")), F.lit(0).cast("decimal(38,4)")).cast("double").alias("lifetime_revenue"),
        per_month("all").alias("avg_monthly_revenue_calc"),
        total(F.col("failed")).alias("failed_payments_90d"),
        F.coalesce(per_month("recent"), F.lit(0.0)).alias("recent_paid"),
        F.coalesce(per_month("prior"), F.lit(0.0)).alias("prior_paid"),
    ]


def _windows() -> dict[str, Column]:
    less = (F.col("prior_paid") > 0) & (F.col("recent_paid") < F.col("prior_paid") * CONTRACTION_SHARE)
    own = {c: F.col(c) for c in ("lifetime_revenue", "avg_monthly_revenue_calc", "failed_payments_90d", "recent_paid", "prior_paid")}
    return own | {"payment_failure_flag": flag(F.col("failed_payments_90d") > 0), "contraction_flag": flag(less)}


def payment_windows(payments: DataFrame, subscriptions: DataFrame, snapshot: DataFrame, count_unpaid: bool = False) -> DataFrame:
    """Revenue, failures of the last 90 days and contraction, a row for each customer who has ever paid.

    A customer without a paid payment has no row, so failures don't count either, unless ``count_unpaid``.
    """
    # sums and counts by customer first, so that payments meet no join; the billing cycle divides sums of amounts alike
    own = beside(payments, snapshot).groupBy("customer_id").agg(*[c.alias(n) for n, c in payment_sums().items()])
    cycles = subscriptions.select("customer_id", cycle_months().alias("cycle_months"))
    rows = own.join(cycles.hint("merge"), "customer_id", "left").withColumn("cycle_months", F.coalesce("cycle_months", F.lit(1)))
    rows = rows.groupBy("customer_id").agg(*_paid(F.sum))
    rows = rows if count_unpaid else rows.where("n_paid > 0")
    return rows.select("customer_id", *[c.alias(n) for n, c in _windows().items()])


def with_payment_windows(subscriptions: DataFrame) -> DataFrame:
    """Subscriptions, one a customer, with the windows of ``payment_windows`` in place of the payments' sums that they are beside."""
    sums = payment_sums()
    own = [c for c in subscriptions.columns if c not in sums]
    rows = subscriptions.withColumn("cycle_months", cycle_months()).select(*own, *_paid(lambda c: c))
    return rows.select(*own, *[F.when(F.col("n_paid") > 0, c).alias(n) for n, c in _windows().items()])


def customer_features(customers: DataFrame, subscriptions: DataFrame, usage: DataFrame, payments: DataFrame, snapshot: DataFrame) -> DataFrame:
    """One row for each customer with a subscription; no usage and no payments count as zero."""
    rows = customers.join(subscriptions.hint("merge"), "customer_id")
    return account_features(rows.join(payment_windows(payments, subscriptions, snapshot).hint("merge"), "customer_id", "left"), usage, snapshot)


def account_features(accounts: DataFrame, usage: DataFrame, snapshot: DataFrame) -> DataFrame:
    """``customer_features`` of customers that are beside their subscriptions and payment windows."""
    today, start = F.col("snapshot_date"), F.col("subscription_start_date")
    churned = F.col("status") == "churned"
    renewal = F.datediff(next_renewal(start, today, cycle_months()), today)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = beside(accounts, snapshot).join(usage_windows(usage, snapshot).hint("merge"), "customer_id", "left")
    return rows.select(
        "customer_id",
        "segment",
        "region",
        "acquisition_channel",
        "plan_type",
        F.greatest(F.datediff(F.coalesce("subscription_end_date", today), start), F.lit(0)).cast("bigint").alias("tenure_days"),
        rnd(F.when(churned, 0.0).otherwise(F.col("monthly_revenue")), 2).alias("current_mrr"),
        rnd(F.coalesce("avg_monthly_revenue_calc", "monthly_revenue"), 2).alias("avg_monthly_revenue"),
        rnd(F.coalesce("lifetime_revenue", F.lit(0.0)), 2).alias("lifetime_revenue"),
        zero("recent_sessions_30d").alias("recent_sessions_30d"),
        zero("recent_sessions_90d").alias("recent_sessions_90d"),
        F.coalesce("usage_trend", F.lit(0.0)).alias("usage_trend"),
        rnd(F.coalesce("feature_adoption_score_recent", F.lit(0.0)), 4).alias("feature_adoption_score_recent"),
        zero("support_tickets_30d").alias("support_tickets_30d"),
        zero("support_tickets_90d").alias("support_tickets_90d"),
        rnd(F.coalesce("nps_score_recent", F.lit(0.0)), 4).alias("nps_score_recent"),
        zero("failed_payments_90d").alias("failed_payments_90d"),
        zero("payment_failure_flag").alias("payment_failure_flag"),
        flag(~churned & renewal.between(0, RENEWAL_NEAR_DAYS)).alias("renewal_near_flag"),
        zero("contraction_flag").alias("contraction_flag"),
        flag(churned).alias("churn_flag"),
        flag(F.col("status") == "at_risk").alias("at_risk_flag"),
    )


def renewals(subscriptions: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Next renewal of each subscription and whether it is near (churned ones never are)."""
    today = F.col("snapshot_date")
    rows = beside(subscriptions, snapshot).withColumn("next_renewal_date", next_renewal(F.col("subscription_start_date"), today, cycle_months()))
    near = (F.col("status") != "churned") & F.datediff("next_renewal_date", today).between(0, RENEWAL_NEAR_DAYS)
    return rows.select("subscription_id", "next_renewal_date", flag(near).alias("renewal_near_flag"))


def customer_features_as_of(customers: DataFrame, subscriptions: DataFrame, payments: DataFrame, as_of: DataFrame) -> DataFrame:
    """The plainer mart: all customers, first start to last end, revenue of active status only, failures since ``as_of - 90``.

    ``as_of`` is a one-row table with the day.
    """
    subs = subscriptions.groupBy("customer_id").agg(
        F.min("subscription_start_date").alias("a"),
        F.max("subscription_end_date").alias("b"),
        F.max(F.when(F.col("status") == "active", F.col("monthly_revenue")).otherwise(0.0)).alias("current_mrr"),
        F.avg("monthly_revenue").alias("avg_monthly_revenue"),
    )
    failed = (F.col("payment_status") == "failed") & (F.datediff("as_of", "payment_date") <= 90)
    pays = beside(payments, as_of).groupBy("customer_id").agg(
        F.sum(F.when(F.col("payment_status") == "paid", F.col("amount")).otherwise(0.0).cast("decimal(28,4)")).cast("double").alias("lifetime_revenue"),
        count_if(failed).alias("failed_payments_90d"),
    )
    rows = beside(customers, as_of).join(subs, "customer_id", "left").join(pays, "customer_id", "left")
    return rows.select(
        "customer_id",
        "segment",
        "region",
        "acquisition_channel",
        "plan_type",
        F.datediff(F.coalesce("b", "as_of"), "a").cast("bigint").alias("tenure_days"),
        "current_mrr",
        rnd("avg_monthly_revenue", 2).alias("avg_monthly_revenue"),
        rnd("lifetime_revenue", 2).alias("lifetime_revenue"),
        "failed_payments_90d",
        flag(F.col("failed_payments_90d") > 0).alias("payment_failure_flag"),
    )
