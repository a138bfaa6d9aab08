"""Every operator as a query over the star schema, by key."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import rnd
from ..functions.ranks import percent_rank_avg
from ..operators import cohorts, contracts, cubes, drivers, features, profile, quality, release, risk, trend
from ..params import DIMS
from ..sources.tables import SCHEMAS, clean_subscriptions, remove, shared_folder, typed
from .marts import Marts

SCOPE = {"segment": "BUILDING", "region": "ASIA"}
FROM, TO = "1999-01-01", "2001-03-01"


def _usage(m: Marts, *cols: str) -> DataFrame:
    rows = features.usage_windows(m.recent_usage, m.snapshot)
    return rows.select("customer_id", *[rnd(c, 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes if c in cols])


def _payments(m: Marts, *cols: str) -> DataFrame:
    rows = features.payment_windows(m.payments, m.subscriptions, m.snapshot)
    return rows.select("customer_id", *[rnd(c, 4).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes if c in cols])


def _as_of(m: Marts) -> DataFrame:
    return m.snapshot.select(F.col("snapshot_date").alias("as_of"))


def _text(df: DataFrame) -> DataFrame:
    """Subscriptions as a staging table has them: dates as text, an open end blank."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("subscription_start_date", "subscription_end_date")})


def _typed(m: Marts) -> DataFrame:
    """Payments with all columns as text, some blank, cast to their declared types."""
    blank = F.when(F.col("payment_status") == "failed", F.lit(" "))
    text = m.payments.select(*[F.coalesce(blank, F.col(c).cast("string")).alias(c) if c == "amount" else F.col(c).cast("string").alias(c) for c in m.payments.columns])
    return typed(text, T.StructType.fromDDL(SCHEMAS["payments"]))


def _round_trip(m: Marts) -> DataFrame:
    """A mart written as CSV and loaded with its own types, in a folder that driver and executors share."""
    spark = m.payments.sparkSession
    folder = f"{shared_folder(spark)}/marts-{uuid.uuid4().hex}"
    try:
        m.write(folder, "csv", ["customer_risk_priority_ranked"])
        back = m.load(folder, "customer_risk_priority_ranked", "csv")
        return back.select("customer_id", "priority_rank", "retention_priority_score", "current_mrr", "risk_tier", "recommended_action").checkpoint()
    finally:
        remove(spark, folder)


def _signals(m: Marts) -> DataFrame:
    rows = risk.risk_signals(m.features)
    return rows.select("customer_id", *[rnd(c, 6).alias(c) for c in rows.columns if c.endswith("_signal") and not c.startswith("contract")])


def _snapshots(m: Marts) -> DataFrame:
    named = {"features": m.snapshot, "profile": m.profile_snapshot, "trend": m.subscription_snapshot}
    rows = [df.select(F.lit(n).alias("sources"), "snapshot_date") for n, df in named.items()]
    return rows[0].union(rows[1]).union(rows[2])


#: Queries of a single chain of marts.
PLAIN: dict[str, Callable[[Marts], DataFrame]] = {
    "stg_subscriptions_clean": lambda m: clean_subscriptions(_text(m.subscriptions)),
    "typed_tables": _typed,
    "month_spine": lambda m: trend.month_spine(m.subscriptions, m.snapshot),
    "snapshot_date": _snapshots,
    "usage_window_30d": lambda m: _usage(m, "recent_sessions_30d", "support_tickets_30d", "feature_adoption_score_recent", "recent_30_avg_sessions"),
    "usage_window_90d": lambda m: _usage(m, "recent_sessions_90d", "support_tickets_90d", "nps_score_recent"),
    "usage_prior_30d": lambda m: _usage(m, "prior_30_avg_sessions"),
    "usage_trend": lambda m: _usage(m, "usage_trend"),
    "next_renewal_date": lambda m: features.renewals(m.subscriptions, m.snapshot).select("subscription_id", "next_renewal_date"),
    "renewal_near_flag": lambda m: features.renewals(m.subscriptions, m.snapshot).select("subscription_id", "renewal_near_flag"),
    "payment_monthly_equivalent": lambda m: features.monthly_equivalents(m.payments, m.subscriptions).select(
        "payment_id", "cycle_months", rnd("monthly_equivalent_amount", 4).alias("monthly_equivalent_amount")
    ),
    "failed_payments_90d": lambda m: _payments(m, "failed_payments_90d", "payment_failure_flag"),
    "lifetime_revenue": lambda m: _payments(m, "lifetime_revenue", "avg_monthly_revenue_calc"),
    "contraction_flag": lambda m: _payments(m, "recent_paid", "prior_paid", "contraction_flag"),
    "customer_retention_features": lambda m: m.features,
    "customer_features_sql": lambda m: features.customer_features_as_of(m.customers, m.subscriptions, m.payments, _as_of(m)),
    "cohort_retention": lambda m: m.cohorts,
    "segment_retention_summary": lambda m: m.segments,
    "cohort_age": lambda m: cohorts.with_age(m.cohorts).select("cohort_month", "observation_month", "cohort_age_months"),
    "cohort_health_6m": lambda m: cohorts.cohort_health(m.cohorts),
    "cohort_curves_sample": lambda m: cohorts.cohort_curves_sample(m.cohorts),
    "cohort_revenue_matrix": lambda m: cohorts.cohort_revenue_matrix(m.cohorts),
    "cohort_latest_revenue": lambda m: cohorts.cohort_latest_revenue(m.cohorts),
    "cohort_recent_curves": lambda m: cohorts.cohort_recent_curves(m.cohorts),
    "cohort_filtered": lambda m: cohorts.cohort_filtered(m.cohorts, FROM, TO),
    "monthly_retention_trend": lambda m: m.trend,
    "monthly_churn_kpis_sql": lambda m: trend.monthly_kpis(m.subscriptions, m.subscription_snapshot),
    "monthly_dimensional_trend": lambda m: m.facts,
    "overall_health": lambda m: m.overall,
    "churn_slope_last12": lambda m: trend.churn_slope(m.trend),
    "trend_rolling3": lambda m: trend.rolling3(m.trend),
    "trend_filtered": lambda m: trend.trend_filtered(m.facts, SCOPE, FROM, TO),
    "period_preset": lambda m: trend.last_months(m.trend, 6),
    "kpi_latest_vs_prior": lambda m: trend.latest_vs_prior(m.trend),
    **{f"churn_by_{d}": (lambda m, d=d: drivers.churn_by(m.features, d)) for d in DIMS},
    "churn_by_dimensions": lambda m: m.by_dimension,
    "feature_thresholds": lambda m: drivers.thresholds(m.features),
    "behavioral_relationships": lambda m: m.relations,
    "churn_driver_ranking": lambda m: drivers.churn_driver_ranking(m.features),
    "hidden_risk": lambda m: drivers.hidden_risk(m.features),
    "revenue_at_risk_summary": lambda m: drivers.revenue_at_risk_summary(m.features),
    "high_value_at_risk": lambda m: drivers.high_value_at_risk(m.features),
    "segment_revenue_risk": lambda m: m.segment_risk,
    "value_tier_churn_mix": lambda m: drivers.value_tier_churn_mix(m.features),
    "intervention_priorities": lambda m: m.plays,
    "usage_trend_distribution": lambda m: drivers.usage_trend_distribution(m.features),
    "support_tickets_by_churn": lambda m: drivers.support_tickets_by_churn(m.features),
    "top_n_plus_other": lambda m: drivers.top_n_plus_other(drivers.churn_by(m.features, "region"), "region", 4),
    "risk_signals": _signals,
    "renewal_risk_signal": lambda m: risk.risk_signals(m.features).select("customer_id", rnd("contract_renewal_risk_signal", 6).alias("contract_renewal_risk_signal")),
    "churn_risk_score": lambda m: risk.churn_scores(risk.risk_signals(m.features)).select("customer_id", "churn_risk_score"),
}
#: Queries whose plan reads the features or scores several times; these are kept while it runs.
SHARED: dict[str, Callable[[Marts], DataFrame]] = {
    "percent_rank_avg": lambda m: percent_rank_avg(m.features.where("churn_flag = 0"), "customer_id", "current_mrr").select(
        "customer_id", rnd("rank", 8).alias("percent_rank")
    ),
    "revenue_risk_score": lambda m: m.scores.select("customer_id", "revenue_risk_score"),
    "retention_priority_score": lambda m: m.scores.select("customer_id", "retention_priority_score"),
    "risk_tier": lambda m: m.scores.select("customer_id", "risk_tier"),
    "main_risk_driver": lambda m: m.scores.select("customer_id", "main_risk_driver"),
    "recommended_action": lambda m: m.scores.select("customer_id", "recommended_action"),
    "recommendation_context": lambda m: m.scores.select("customer_id", "recommendation_context"),
    "customer_risk_scores": lambda m: m.scores,
    "risk_priority_ranked": lambda m: m.ranked.select("customer_id", "priority_rank", "retention_priority_score", "current_mrr"),
    "risk_tier_summary": lambda m: risk.tier_summary(m.scores),
    "top_priority_accounts": lambda m: risk.top_accounts(m.scores, 20).select("customer_id", "retention_priority_score", "current_mrr", "risk_tier"),
    "risk_driver_distribution": lambda m: risk.driver_distribution(m.scores),
    "action_playbook_summary": lambda m: risk.action_playbook(m.scores),
    "risk_revenue_by_segment": lambda m: risk.revenue_by_segment(m.scores),
    "executive_scope_summary": lambda m: risk.scope_summary(drivers.churn_by(m.features, "segment"), m.trend, m.scores),
    "diagnostic_means": lambda m: drivers.diagnostic_means(m.cells),
    "snapshot_enriched": lambda m: m.enriched.select("customer_id", *DIMS, "churn_flag", "current_mrr", "risk_tier", "main_risk_driver", "recommended_action"),
    "snapshot_agg": lambda m: m.cells,
    "scored_accounts": lambda m: m.accounts,
    "risk_kpi_cube": lambda m: m.cube,
    "risk_kpi_lookup": lambda m: cubes.kpi_cell(m.accounts, SCOPE),
    "dimension_domains": lambda m: cubes.dimension_domains(m.features),
    "monthly_fact_encoded": lambda m: cubes.monthly_fact_encoded(m.facts),
    "snapshot_filtered": lambda m: cubes.scoped(m.cells, SCOPE, "low"),
    "scored_filtered": lambda m: cubes.scoped(m.accounts, SCOPE, "medium"),
    "dashboard_accounts": lambda m: m.exports(["dashboard_accounts"])["dashboard_accounts"],
    "mart_round_trip": _round_trip,
    "priority_table_sorted": lambda m: cubes.sorted_accounts(m.accounts, "churn_risk_score").select("customer_id", "churn_risk_score", "current_mrr"),
    "tier_distribution": lambda m: cubes.tier_distribution(m.accounts),
    "table_profile": lambda m: profile.table_profile(m.raw),
    "column_profile": lambda m: m.columns,
    "dimension_cardinality": lambda m: profile.dimension_cardinality(m.columns),
    "date_coverage": lambda m: profile.date_coverage(m.raw),
    "column_classification": lambda m: profile.column_classification(m.columns),
    "suspicious_values": lambda m: profile.suspicious_values(m.raw),
    "dq_overlapping_subscriptions": lambda m: quality.overlapping_subscriptions(m.many, m.snapshot),
    "dq_usage_outside_subscription_period": lambda m: quality.usage_outside_subscription_period(m.usage, m.subscriptions),
    "dq_payment_inconsistencies": lambda m: quality.payment_inconsistencies(m.payments, m.subscriptions),
    "dq_signup_date_in_future": lambda m: quality.signup_date_in_future(m.customers, m.snapshot),
    "dq_duplicate_payment_id": lambda m: quality.duplicate_payment_id(m.payments),
    **{
        f"dq_{n}": (lambda m, n=n: quality.subscription_checks(m.subscriptions).where(F.col("check_name") == n))
        for n in ("impossible_revenue_values", "invalid_subscription_status", "invalid_contract_type", "invalid_billing_cycle", "subscription_end_before_start")
    },
    **{
        f"dq_{n}": (lambda m, n=n: quality.usage_checks(m.usage).where(F.col("check_name") == n))
        for n in ("negative_sessions", "feature_adoption_out_of_range", "negative_support_tickets", "nps_out_of_range")
    },
    "quality_checks": lambda m: m.quality_checks,
    **{
        f"contract_{k}": (lambda m, n=n: m.contract_checks.where(F.col("check_name") == n))
        for k, n in (("row_count_nonzero", "row_count_nonzero"), ("pk_not_null", "primary_key_not_null"), ("pk_unique", "primary_key_unique"))
    },
    "contract_checks": lambda m: m.contract_checks,
    "contract_issues": lambda m: contracts.issues(contracts.contract_checks("raw_usage", m.usage, contracts.Contract("usage_id", ("usage_id", "channel")))),
    **{
        f"val_{k}": (lambda m, k=k: m.checked(k))
        for k in (
            "row_column_sanity", "duplicate_handling", "null_handling", "status_consistency", "impossible_dates", "impossible_revenue", "overlap_customers",
            "usage_outside_period", "payment_consistency", "churn_flag_logic", "at_risk_flag_logic", "customer_churn_tieout", "revenue_churn_tieout",
            "revenue_at_risk_tieout", "retention_rate", "trend_metrics", "cohort_logic", "join_inflation", "incomplete_periods", "denominators", "survivorship",
            "overclaiming", "tier_summary_tieout", "priority_monotone", "tier_score_monotone", "action_rules", "financial_tieout",
            "score_drift", "kpi_cube_vs_trend", "cube_has_all_scope",
        )
    },
}
#: Those of them that read the raw tables alone; the others have the features or scores between cut from their plan.
RAW = {k for k in SHARED if k.startswith("dq_")} | {
    "table_profile", "column_profile", "dimension_cardinality", "date_coverage", "column_classification", "suspicious_values", "quality_checks", "contract_issues",
    *(
        f"val_{k}"
        for k in (
            "row_column_sanity", "duplicate_handling", "null_handling", "status_consistency", "impossible_dates", "impossible_revenue", "overlap_customers",
            "usage_outside_period", "payment_consistency", "retention_rate", "trend_metrics", "cohort_logic", "incomplete_periods",
        )
    ),
}
#: Queries over many marts; those between are cut from their plan.
GATE: dict[str, Callable[[Marts], DataFrame]] = {
    "structured_findings": lambda m: m.findings,
    "val_conclusions_supported": lambda m: m.checked("conclusions_supported"),
    "check_severity": lambda m: m.graded.select("category", "check_name", "status", "severity", "gate_level", "is_blocker"),
    "release_matrix": lambda m: release.release_matrix(m.graded),
    "validation_issues": lambda m: release.issues(m.graded).select("category", "check_name", "severity", "gate_level", "is_blocker", "status", "fix_applied"),
    "validation_summary": lambda m: release.summary(m.graded),
}


def _query(f: Callable[[Marts], DataFrame], **how: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        marts = Marts.of_star(spark, folder, **how)
        rows = f(marts)
        weakref.finalize(rows, marts.release).atexit = False  # what was kept for it goes with it
        return rows

    return run


QUERIES = {k: _query(f) for k, f in PLAIN.items()} | {k: _query(f, shared=True, cut=k not in RAW) for k, f in SHARED.items()} | {k: _query(f, shared=True, cut=True) for k, f in GATE.items()}
