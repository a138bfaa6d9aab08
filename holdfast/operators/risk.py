"""Risk scores, tiers, drivers and actions of customers who have not churned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import beside, flag, money, rnd, share
from ..functions.ranks import ordinal, percent_rank_avg
from ..params import ACTIONS, CHURN_SHARE, CONTRACTION_POINTS, DORMANCY_POINTS, RANK_WEIGHTS, REVENUE_SHARE, TIERS, WEIGHTS


def _unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def _signals() -> dict[str, Column]:
    return {
        "usage decline": _unit(-F.col("usage_trend") / 4.0),
        "failed payments": _unit(F.col("failed_payments_90d") / 2.0),
        "support burden": _unit(F.col("support_tickets_90d") / 6.0),
        "low NPS": _unit((F.lit(25.0) - F.col("nps_score_recent")) / 35.0),
        "low adoption": _unit((F.lit(55.0) - F.col("feature_adoption_score_recent")) / 35.0),
    }


_NAMES = {n: n.lower().replace(" ", "_") + "_signal" for n in WEIGHTS}


def risk_signals(features: DataFrame) -> DataFrame:
    """Features of customers who have not churned, with a signal from 0 to 1 for each driver.

    The renewal signal rises with the strongest of the others but support.
    """
    rows = features.where("churn_flag = 0").withColumns({_NAMES[n]: c for n, c in _signals().items()})
    strongest = F.greatest(*[F.col(_NAMES[n]) for n in ("usage decline", "failed payments", "low NPS", "low adoption")])
    return rows.withColumn(_NAMES["contract renewal risk"], F.col("renewal_near_flag") * (F.lit(0.60) + F.lit(0.40) * strongest))


def churn_scores(signals: DataFrame) -> DataFrame:
    base = sum((F.col(_NAMES[n]) * w for n, w in WEIGHTS.items()), F.lit(0.0))
    score = base * 100.0 + F.col("contraction_flag") * CONTRACTION_POINTS + flag(F.col("recent_sessions_30d") == 0) * DORMANCY_POINTS
    return signals.withColumn("churn_risk_score", rnd(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)), 2))


def revenue_scores(rows: DataFrame) -> DataFrame:
    """From the mean percent ranks of three amounts, ties sharing theirs."""
    weight = F.create_map(*[F.lit(x) for kv in RANK_WEIGHTS.items() for x in kv])[F.col("name")]
    ranks = percent_rank_avg(rows, "customer_id", *RANK_WEIGHTS).groupBy("customer_id").agg(F.sum(F.col("rank") * weight).alias("_ranks"))
    return rows.join(ranks.hint("merge"), "customer_id").withColumn("revenue_risk_score", rnd(F.col("_ranks") * 100.0, 2)).drop("_ranks")


def priority(churn: Column, revenue: Column) -> Column:
    return rnd(churn * CHURN_SHARE + revenue * REVENUE_SHARE, 2)


def tier() -> Column:
    p, c, r = (F.col(x) for x in ("retention_priority_score", "churn_risk_score", "revenue_risk_score"))
    return F.when((p >= 75) | ((c >= 85) & (r >= 70)), "critical").when(p >= 60, "high").when(p >= 40, "medium").otherwise("low")


def main_driver() -> Column:
    """The largest weighted signal; of equals the first in the order of the weights."""
    parts = F.array(*[F.col(_NAMES[n]) * w * 100.0 for n, w in WEIGHTS.items()])
    return F.element_at(F.array(*map(F.lit, WEIGHTS)), F.array_position(parts, F.array_max(parts)).cast("int"))


def action() -> Column:
    t, d, c, r = (F.col(x) for x in ("risk_tier", "main_risk_driver", "churn_risk_score", "revenue_risk_score"))
    return (
        F.when((t == "critical") & (r >= 70), "executive save motion")
        .when((d == "failed payments") & (c >= 45), "billing intervention")
        .when((d == "contract renewal risk") & (t.isin("medium", "high", "critical") | (r >= 85)), "renewal conversation")
        .when(d.isin("usage decline", "low adoption") & (c >= 35), "product adoption campaign")
        .when(t.isin("high", "critical"), "customer success outreach")
        .when((t == "medium") & d.isin("support burden", "low NPS"), "customer success outreach")
        .otherwise("monitor only")
    )


def context() -> Column:
    one, two = (lambda c: F.format_string("%.1f", rnd(c, 1))), (lambda c: F.format_string("%.2f", rnd(c, 2)))
    return F.concat(
        F.lit("Tier="), F.col("risk_tier"), F.lit("; driver="), F.col("main_risk_driver"), F.lit("; churn_risk="), one("churn_risk_score"),
        F.lit("; revenue_risk="), one("revenue_risk_score"), F.lit("; priority="), one("retention_priority_score"),
        F.lit("; current_mrr=$"), two("current_mrr"), F.lit("."),
    )


COLUMNS = [
    "customer_id", "segment", "region", "acquisition_channel", "plan_type", "tenure_days", "current_mrr", "avg_monthly_revenue", "lifetime_revenue",
    "churn_risk_score", "revenue_risk_score", "retention_priority_score", "risk_tier", "main_risk_driver", "recommended_action", "recommendation_context",
    "at_risk_flag", "payment_failure_flag", "renewal_near_flag", "contraction_flag", "usage_trend", "support_tickets_90d", "nps_score_recent",
    "feature_adoption_score_recent", "failed_payments_90d",
]


def scored(features: DataFrame) -> DataFrame:
    """All scores but their context, one row for each customer who has not churned."""
    rows = revenue_scores(churn_scores(risk_signals(features)))
    rows = rows.withColumn("retention_priority_score", priority(F.col("churn_risk_score"), F.col("revenue_risk_score")))
    rows = rows.withColumns({"risk_tier": tier(), "main_risk_driver": main_driver()}).withColumn("recommended_action", action())
    return rows.select(*[c for c in COLUMNS if c != "recommendation_context"])


def with_context(scores: DataFrame) -> DataFrame:
    """The context is a text of the other columns, longer than they are, and made where it is read."""
    return scores.withColumn("recommendation_context", context()).select(*COLUMNS)


def risk_scores(features: DataFrame) -> DataFrame:
    return with_context(scored(features))


def ranked(scores: DataFrame) -> DataFrame:
    """Scores with their place by priority, then revenue, then id."""
    return ordinal(scores, "retention_priority_score", F.col("current_mrr").isNull(), -F.col("current_mrr"), "customer_id", out="priority_rank")


def top_accounts(scores: DataFrame, n: int) -> DataFrame:
    return scores.orderBy(F.desc("retention_priority_score"), F.desc("current_mrr"), "customer_id").limit(n)


def tier_summary(scores: DataFrame) -> DataFrame:
    rows = scores.groupBy("risk_tier").agg(
        F.count("customer_id").alias("customers"),
        rnd(money("current_mrr"), 2).alias("total_current_mrr"),
        rnd(F.avg("churn_risk_score"), 2).alias("avg_churn_risk_score"),
        rnd(F.avg("revenue_risk_score"), 2).alias("avg_revenue_risk_score"),
        rnd(F.avg("retention_priority_score"), 2).alias("avg_retention_priority_score"),
    )
    total = rows.agg(F.sum("customers").alias("_all"))
    place = F.array_position(F.array(*map(F.lit, TIERS)), F.col("risk_tier")).cast("int")
    return beside(rows, total).select(
        "risk_tier", place.alias("tier_order"), "customers", rnd(F.col("customers") / F.col("_all"), 6).alias("share_of_scored_base"),
        "total_current_mrr", "avg_churn_risk_score", "avg_revenue_risk_score", "avg_retention_priority_score",
    )


def driver_distribution(scores: DataFrame, n: int = 8) -> DataFrame:
    return scores.groupBy("main_risk_driver").agg(F.count("*").alias("customers")).orderBy(F.desc("customers"), "main_risk_driver").limit(n)


def action_playbook(scores: DataFrame) -> DataFrame:
    """All actions, those that nobody gets too; the top segment is that of most revenue, if any has some."""
    spark = scores.sparkSession
    listed = spark.createDataFrame([(a, k) for k, a in enumerate(ACTIONS)], "recommended_action string, action_order int")
    cells = scores.groupBy("recommended_action", "segment").agg(F.count("*").alias("n"), F.sum(F.col("current_mrr").cast("decimal(28,4)")).alias("m"), F.sum("retention_priority_score").alias("p"))
    best = F.max(F.when((F.col("m") > 0) & F.col("segment").isNotNull(), F.struct("m", "segment")))
    rows = cells.groupBy("recommended_action").agg(F.sum("n").alias("n"), F.sum("m").cast("double").alias("m"), F.sum("p").alias("p"), best.alias("best"))
    zero = F.lit(0.0)
    return listed.join(rows, "recommended_action", "left").select(
        "recommended_action", "action_order", F.coalesce("n", F.lit(0)).alias("customers"), rnd(F.coalesce("m", zero), 2).alias("current_mrr"),
        rnd(F.coalesce(share(F.col("p"), F.col("n")), zero), 4).alias("avg_priority_score"), F.coalesce("best.segment", F.lit("n/a")).alias("top_segment"),
    )


def exposed_mrr() -> Column:
    return F.when((F.col("at_risk_flag") == 1) | F.col("risk_tier").isin("high", "critical"), F.col("current_mrr"))


def revenue_by_segment(scores: DataFrame) -> DataFrame:
    return scores.groupBy(F.coalesce("segment", F.lit("Unknown")).alias("segment")).agg(rnd(money(exposed_mrr()), 2).alias("revenue_at_risk"))


def scope_summary(by_segment: DataFrame, trend: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: top churn segment, last month's rates, and how much of the scope is at high risk."""
    top = by_segment.agg(F.max(F.struct("churn_rate", "segment")).alias("t")).select(F.col("t.segment").alias("top_segment"), F.col("t.churn_rate").alias("top_segment_churn_rate"))
    last = trend.agg(F.max_by("customer_churn_rate", "month").alias("latest_customer_churn_rate"), F.max_by("revenue_churn_rate", "month").alias("latest_revenue_churn_rate"))
    high = F.col("risk_tier").isin("high", "critical")
    zero = F.lit(0.0)
    risk = scores.agg(
        F.count("*").alias("scored_customers"),
        rnd(F.coalesce(share(F.count_if(high), F.count("*")), zero), 8).alias("high_critical_share"),
        rnd(F.coalesce(share(money(F.when(high, F.col("current_mrr"))), money("current_mrr")), zero), 8).alias("high_critical_mrr_share"),
        rnd(F.coalesce(share(F.count_if(high & (F.col("usage_trend") < 0)), F.count_if(high)), zero), 8).alias("usage_decline_share"),
    )
    return top.crossJoin(last).crossJoin(risk)
