"""What goes with churn, and the revenue that it puts at risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import beside, count_if, flag, money, rnd, rnd_large, share
from ..functions.ranks import quantiles
from ..params import DIMS


def _churned() -> Column:
    return F.col("churn_flag") == 1


def _at_risk() -> Column:
    return F.col("at_risk_flag") == 1


def churn_by(features: DataFrame, dimension: str) -> DataFrame:
    return features.where(F.col(dimension).isNotNull()).groupBy(dimension).agg(
        F.count("customer_id").alias("customers"),
        F.sum("churn_flag").alias("churned_customers"),
        rnd(F.avg("churn_flag"), 8).alias("churn_rate"),
        rnd(money(F.when(_churned(), F.col("avg_monthly_revenue"))), 2).alias("churned_revenue"),
        rnd(F.avg("avg_monthly_revenue"), 6).alias("avg_monthly_revenue"),
    )


def churn_by_dimensions(features: DataFrame) -> DataFrame:
    """All dimensions in one pass: ``dimension, value`` and the measures of ``churn_by``."""
    entries = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in DIMS])
    rows = features.select("churn_flag", "customer_id", "avg_monthly_revenue", F.explode(entries).alias("e")).where("e.value is not null")
    return rows.groupBy("e.dimension", "e.value").agg(
        F.count("customer_id").alias("customers"),
        F.sum("churn_flag").alias("churned_customers"),
        rnd(F.avg("churn_flag"), 8).alias("churn_rate"),
        rnd(money(F.when(_churned(), F.col("avg_monthly_revenue"))), 2).alias("churned_revenue"),
        rnd(F.avg("avg_monthly_revenue"), 6).alias("avg_monthly_revenue"),
    )


def thresholds(features: DataFrame) -> DataFrame:
    """One row of exact, interpolated quantiles over all customers."""
    wanted = {
        "q75_tickets": ("support_tickets_90d", 0.75),
        "q25_nps": ("nps_score_recent", 0.25),
        "q25_adoption": ("feature_adoption_score_recent", 0.25),
        "q40_adoption": ("feature_adoption_score_recent", 0.40),
    }
    return quantiles(features, wanted)


def _limited(features: DataFrame, limits: DataFrame | None) -> DataFrame:
    """Features beside their thresholds, which may be at hand."""
    return beside(features, thresholds(features) if limits is None else limits)


def behaviours() -> list[tuple[str, Column]]:
    """Names and conditions of the behavioural flags, over features beside their thresholds."""
    return [
        ("usage_decline_flag", F.col("usage_trend") < 0),
        ("high_support_ticket_flag", F.col("support_tickets_90d") >= F.col("q75_tickets")),
        ("failed_payment_flag", F.col("payment_failure_flag") == 1),
        ("low_nps_flag", F.col("nps_score_recent") <= F.col("q25_nps")),
        ("low_feature_adoption_flag", F.col("feature_adoption_score_recent") <= F.col("q25_adoption")),
    ]


def _flags(rows: DataFrame, *keep: str) -> DataFrame:
    listed = F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(c, F.lit(False)).alias("holds")) for n, c in behaviours()])
    return rows.select(*keep, F.explode(listed).alias("f")).select(*keep, "f.name", "f.holds")


def behavioral_relationships(features: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Churn inside and outside each flag's group, in one pass."""
    rows = _flags(_limited(features, limits), "churn_flag").groupBy("name").agg(
        F.count_if("holds").alias("n_in"),
        F.count_if(~F.col("holds")).alias("n_out"),
        F.avg(F.when(F.col("holds"), F.col("churn_flag"))).alias("r_in"),
        F.avg(F.when(~F.col("holds"), F.col("churn_flag"))).alias("r_out"),
    )
    return rows.select(
        F.col("name").alias("relationship"),
        F.col("n_in").alias("customers_in_group"),
        rnd(F.col("n_in") / (F.col("n_in") + F.col("n_out")), 6).alias("share_of_base"),
        rnd("r_in", 6).alias("churn_rate_in_group"),
        rnd("r_out", 6).alias("churn_rate_out_group"),
        rnd(share(F.col("r_in"), F.col("r_out")), 6).alias("churn_rate_lift"),
        rnd((F.col("r_in") - F.col("r_out")) * 100, 3).alias("churn_rate_delta_pp"),
    )


def churn_driver_ranking(features: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Flags and dimension values whose churn is above the base, by the revenue that the excess costs."""
    base = features.agg(F.avg("churn_flag").cast("double").alias("base"), F.count("*").alias("everyone"))
    entries = F.array_compact(
        F.array(
            *[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in behaviours()],
            *[F.when(F.col(d).isNotNull(), F.concat(F.lit(f"{d}="), F.col(d).cast("string"))) for d in DIMS],
        )
    )
    rows = _limited(features, limits).select("churn_flag", "avg_monthly_revenue", F.explode(entries).alias("driver"))
    rows = rows.groupBy("driver").agg(F.count("*").alias("n"), F.avg("churn_flag").alias("rate"), F.avg("avg_monthly_revenue").alias("value"))
    return beside(rows, base).where("rate > base").select(
        "driver",
        F.col("n").alias("impacted_customers"),
        rnd(F.col("n") / F.col("everyone"), 6).alias("share_of_base"),
        rnd("rate", 6).alias("churn_rate"),
        rnd("base", 6).alias("baseline_churn_rate"),
        rnd(share(F.col("rate"), F.col("base")), 4).alias("churn_rate_lift"),
        rnd("value", 2).alias("avg_monthly_revenue"),
        rnd((F.col("rate") - F.col("base")) * F.col("n") * F.col("value"), 2).alias("estimated_excess_mrr_loss"),
    )


def _hidden() -> Column:
    quiet = (F.col("usage_trend") < 0) & ((F.col("support_tickets_90d") >= F.col("q75_tickets")) | (F.col("nps_score_recent") <= F.col("q25_nps")))
    return ~_churned() & ~_at_risk() & ((F.col("payment_failure_flag") == 1) | quiet)


def hidden_risk(features: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Customers whose status shows no risk but whose behaviour does."""
    return _limited(features, limits).where(_hidden()).select("customer_id", "segment", "current_mrr")


def _value_threshold(features: DataFrame) -> DataFrame:
    return quantiles(features.where(_at_risk()), {"q": ("current_mrr", 0.75)}).select(F.coalesce("q", F.lit(0.0)).alias("high_value_threshold"))


def high_value_at_risk(features: DataFrame) -> DataFrame:
    rows = beside(features.where(_at_risk()), _value_threshold(features)).where("current_mrr >= high_value_threshold")
    return rows.select("customer_id", "segment", "region", "acquisition_channel", "plan_type", "current_mrr")


def revenue_at_risk_summary(features: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    rows = beside(_limited(features, limits), _value_threshold(features))
    high = _at_risk() & (F.col("current_mrr") >= F.col("high_value_threshold"))
    mrr = F.col("current_mrr")
    return rows.agg(
        rnd(money(F.when(_at_risk(), mrr)), 2).alias("at_risk_mrr"),
        rnd(money(F.when(_hidden(), mrr)), 2).alias("hidden_at_risk_mrr"),
        rnd(money(F.when(_at_risk() | _hidden(), mrr)), 2).alias("future_revenue_at_risk"),
        rnd(money(F.when(_churned(), F.col("avg_monthly_revenue"))), 2).alias("realized_churned_revenue"),
        count_if(high).alias("high_value_at_risk_count"),
        rnd(money(F.when(high, mrr)), 2).alias("high_value_at_risk_mrr"),
        rnd(F.max("high_value_threshold"), 4).alias("high_value_threshold"),
    )


def segment_revenue_risk(features: DataFrame) -> DataFrame:
    risk, lost = F.when(_at_risk(), F.col("current_mrr")), F.when(_churned(), F.col("avg_monthly_revenue"))
    return features.where("segment is not null").groupBy("segment").agg(
        F.count("customer_id").alias("customers"),
        F.sum("at_risk_flag").alias("at_risk_customers"),
        F.sum("churn_flag").alias("churned_customers"),
        rnd(money(risk), 2).alias("at_risk_mrr"),
        rnd(money(lost), 2).alias("churned_revenue"),
        rnd(money(risk), 2).alias("future_revenue_risk"),
        rnd(money(risk) + money(lost), 2).alias("total_revenue_loss_proxy"),
    )


def value_tier_churn_mix(features: DataFrame) -> DataFrame:
    """Quartiles of monthly revenue, right-closed; a quartile that ties leave empty has no row."""
    v = F.col("avg_monthly_revenue")
    q = quantiles(features, {f"q{k}": ("avg_monthly_revenue", k / 4) for k in (1, 2, 3)})
    tier = F.when(v <= F.col("q1"), "Low").when(v <= F.col("q2"), "Mid-Low").when(v <= F.col("q3"), "Mid-High").otherwise("High")
    rows = beside(features.where(v.isNotNull()), q).groupBy(tier.alias("value_tier")).agg(
        F.count("customer_id").alias("customers"),
        F.sum("churn_flag").alias("churned_customers"),
        rnd(F.avg("churn_flag"), 8).alias("churn_rate"),
        money(F.when(_churned(), v)).alias("churned_revenue"),
        rnd(F.avg(v), 6).alias("avg_monthly_revenue"),
    )
    everything = Window.partitionBy()  # of four rows
    return rows.select(
        "value_tier",
        "customers",
        "churned_customers",
        "churn_rate",
        rnd("churned_revenue", 2).alias("churned_revenue"),
        "avg_monthly_revenue",
        rnd(F.col("churned_customers") / F.greatest(F.sum("churned_customers").over(everything), F.lit(1)), 8).alias("share_of_churned_customers"),
        rnd(F.col("churned_revenue") / F.greatest(F.sum("churned_revenue").over(everything), F.lit(1.0)), 8).alias("share_of_churned_revenue"),
    )


# The plays and their standing descriptions.
PLAYS = {
    "Payment Rescue": "Collections + payment method refresh + retry sequencing",
    "Renewal Save Desk": "Pre-renewal save playbook with tailored offers and success plans",
    "Adoption Reactivation": "Usage coaching, onboarding refresh, and feature activation campaign",
    "Service Recovery": "Escalated support workflow and proactive success outreach",
}


def intervention_priorities(features: DataFrame, top: int = 2, limits: DataFrame | None = None) -> DataFrame:
    """Each play's recoverable customers and revenue, times the churn of customers like them."""
    decline, failed = F.col("usage_trend") < 0, F.col("payment_failure_flag") == 1
    low_nps, near = F.col("nps_score_recent") <= F.col("q25_nps"), F.col("renewal_near_flag") == 1
    signal = _at_risk() | failed | decline | low_nps
    adoption = decline & (F.col("feature_adoption_score_recent") <= F.col("q40_adoption"))
    service = (F.col("support_tickets_90d") >= F.col("q75_tickets")) | low_nps
    rules = {
        "Payment Rescue": (failed, failed),
        "Renewal Save Desk": (near & signal, signal),
        "Adoption Reactivation": (adoption, adoption),
        "Service Recovery": (service & (_at_risk() | decline), service),
    }
    listed = F.array(
        *[
            F.struct(F.lit(n).alias("opportunity"), flag(~_churned() & can).alias("can"), flag(like).alias("like"))
            for n, (can, like) in rules.items()
        ]
    )
    rows = _limited(features, limits).select("segment", "current_mrr", "churn_flag", F.explode(listed).alias("p"))
    rows = rows.select("segment", "current_mrr", "churn_flag", "p.*")
    plays = rows.groupBy("opportunity").agg(
        F.sum("can").alias("recoverable_customers"),
        money(F.when(F.col("can") == 1, F.col("current_mrr"))).alias("mrr"),
        F.coalesce(F.avg(F.when(F.col("like") == 1, F.col("churn_flag"))), F.lit(0.0)).alias("rate"),
    )
    by_segment = rows.where("can = 1 and segment is not null").groupBy("opportunity", "segment").agg(money("current_mrr").alias("m"))
    place = F.row_number().over(Window.partitionBy("opportunity").orderBy(F.desc("m"), "segment"))
    said = F.concat(F.col("segment"), F.lit(" ($"), F.format_number(rnd_large("m", 0), 0), F.lit(")"))
    focus = by_segment.withColumn("r", place).where(F.col("r") <= top).groupBy("opportunity").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", said.alias("s")))), lambda x: x["s"]), ", ").alias("segment_focus")
    )
    action = F.create_map(*[F.lit(x) for kv in PLAYS.items() for x in kv])[F.col("opportunity")]
    return plays.join(focus, "opportunity", "left").select(
        "opportunity",
        "recoverable_customers",
        rnd_large("mrr", 2).alias("recoverable_mrr"),
        rnd("rate", 6).alias("benchmark_churn_rate"),
        rnd_large(F.col("mrr") * F.col("rate"), 2).alias("priority_score"),
        F.coalesce("segment_focus", F.lit("n/a")).alias("segment_focus"),
        action.alias("recommended_action"),
    )


_pct = lambda c: F.concat(F.format_number(rnd(F.col(c) * 100, 1), 1), F.lit("%"))


def driver_finding(by_dimension: DataFrame, relations: DataFrame) -> DataFrame:
    """The third of the findings below: the dimensions' top values and the strongest relation."""
    tops = by_dimension.groupBy("dimension").agg(F.max(F.struct("churn_rate", "value")).alias("t"))
    top = tops.agg(*[F.max(F.when(F.col("dimension") == d, F.col(f"t.{k}"))).alias(f"{d}_{k}") for d in DIMS for k in ("value", "churn_rate")])
    strongest = relations.agg(F.max_by("relationship", F.struct("churn_rate_lift", "relationship")).alias("relationship"), F.max("churn_rate_lift").alias("lift"))
    return top.crossJoin(strongest).select(
        F.lit("3. Churn Drivers").alias("section"),
        F.concat(*[x for label, d in (("Highest segment churn: ", "segment"), ("; region: ", "region"), ("; channel: ", "acquisition_channel"), ("; plan: ", "plan_type"))
                   for x in (F.lit(label), F.col(f"{d}_value"), F.lit(" ("), _pct(f"{d}_churn_rate"), F.lit(")"))],
                 F.lit("; strongest behavioral lift: "), F.col("relationship"), F.lit(" ("), F.format_number(rnd("lift", 2), 2), F.lit("x).")).alias("result"),
        F.col("lift").alias("value"),
    )


def structured_findings(
    overall: DataFrame, cohorts: DataFrame, by_dimension: DataFrame, relations: DataFrame, risk: DataFrame, segments: DataFrame, tiers: DataFrame, plays: DataFrame
) -> DataFrame:
    """Five findings, each a sentence of a mart's figures, which stand beside it as numbers."""
    pct = _pct
    usd = lambda c: F.concat(F.lit("$"), F.format_number(rnd_large(c, 0), 0))
    count = lambda c: F.format_number(F.col(c), 0)
    loss = segments.agg(F.max(F.struct("total_revenue_loss_proxy", "segment")).alias("s")).select(F.col("s.segment").alias("segment"), F.col("s.total_revenue_loss_proxy").alias("loss"))
    high = tiers.where(F.col("value_tier").isin("Mid-High", "High")).agg(F.sum("share_of_churned_customers").alias("high_share"))
    best = plays.agg(F.max(F.struct("priority_score", "opportunity", "recoverable_mrr", "benchmark_churn_rate")).alias("p")).select("p.*")
    said = [
        overall.select(
            F.lit("1. Overall Retention Health").alias("section"),
            F.concat(F.lit("Active base "), count("active_customers"), F.lit(" / "), count("total_customers"), F.lit("; customer churn "), pct("customer_churn_rate"),
                     F.lit("; revenue churn "), pct("revenue_churn_rate"), F.lit("; at-risk MRR "), usd("at_risk_mrr"), F.lit(".")).alias("result"),
            F.col("customer_churn_rate").alias("value"),
        ),
        cohorts.select(
            F.lit("2. Cohort Retention"),
            F.concat(F.lit("6-month retention "), pct("avg_6m_retention"), F.lit("; 6-month revenue retention "), pct("avg_6m_revenue_retention"),
                     F.lit("; trend is "), F.col("cohort_trend_label"), F.lit(".")),
            F.col("avg_6m_retention"),
        ),
        driver_finding(by_dimension, relations),
        risk.crossJoin(loss).crossJoin(high).select(
            F.lit("4. Revenue at Risk"),
            F.concat(F.lit("Future revenue at risk "), usd("future_revenue_at_risk"), F.lit("; high-value at-risk MRR "), usd("high_value_at_risk_mrr"),
                     F.lit("; largest loss segment "), F.col("segment"), F.lit(" ("), usd("loss"), F.lit("); high-tier share of churned customers "), pct("high_share"), F.lit(".")),
            F.col("future_revenue_at_risk"),
        ),
        best.select(
            F.lit("5. Retention Opportunities"),
            F.concat(F.lit("Top play: "), F.col("opportunity"), F.lit(" with recoverable MRR "), usd("recoverable_mrr"), F.lit(" and benchmark churn "), pct("benchmark_churn_rate"), F.lit(".")),
            F.col("recoverable_mrr"),
        ),
    ]
    out = said[0]
    for part in said[1:]:
        out = out.union(part)
    return out


def usage_trend_distribution(features: DataFrame) -> DataFrame:
    """Quartiles of usage trend by churn, and the furthest values within 1.5 quartile ranges of them."""
    q = quantiles(features, {"q1": ("usage_trend", 0.25), "median": ("usage_trend", 0.5), "q3": ("usage_trend", 0.75)}, "churn_flag")
    v, reach = F.col("usage_trend"), (F.col("q3") - F.col("q1")) * 1.5
    return features.select("churn_flag", "usage_trend").join(F.broadcast(q), "churn_flag").groupBy("churn_flag").agg(
        F.count("*").alias("customers"),
        rnd(F.first("q1"), 6).alias("q1"),
        rnd(F.first("median"), 6).alias("median"),
        rnd(F.first("q3"), 6).alias("q3"),
        rnd(F.min(F.when(v >= F.col("q1") - reach, v)), 6).alias("whisker_low"),
        rnd(F.max(F.when(v <= F.col("q3") + reach, v)), 6).alias("whisker_high"),
    )


def support_tickets_by_churn(features: DataFrame) -> DataFrame:
    means = features.groupBy("churn_flag").agg(rnd(F.avg("support_tickets_90d"), 6).alias("avg_support_tickets_90d"))
    q = quantiles(features, {"q": ("support_tickets_90d", 0.75)}, "churn_flag")
    return means.join(F.broadcast(q), "churn_flag", "left").select("churn_flag", "avg_support_tickets_90d", rnd("q", 6).alias("p75_support_tickets_90d"))


def diagnostic_means(snapshot_cells: DataFrame) -> DataFrame:
    """Means of retained and churned customers from the additive cells."""
    mean = lambda c: rnd(F.coalesce(F.try_divide(F.sum(c), F.sum("customer_count")), F.lit(0.0)), 6)
    return snapshot_cells.groupBy("churn_flag").agg(
        F.sum("customer_count").alias("customers"),
        mean("usage_sum").alias("avg_usage_trend"),
        mean("support_sum").alias("avg_support_tickets"),
        mean("nps_sum").alias("avg_nps"),
        mean("payment_failure_sum").alias("failed_payment_incidence"),
    )


def top_n_plus_other(by_dimension: DataFrame, dimension: str, limit: int) -> DataFrame:
    """The first ``limit - 1`` values by churn, the others as one; all if there are no more than ``limit``."""
    w = Window.orderBy(F.desc("churn_rate"), dimension)  # a row for each value
    everything = Window.partitionBy()
    rows = by_dimension.select(F.col(dimension).cast("string").alias("label"), "customers", "churned_customers", F.row_number().over(w).alias("r"), F.count("*").over(everything).alias("n"))
    label = F.when((F.col("n") <= limit) | (F.col("r") < limit), F.col("label")).otherwise("Other")
    rows = rows.groupBy(label.alias("label")).agg(F.sum("customers").alias("customers"), F.sum("churned_customers").alias("churned"))
    return rows.select("label", "customers", rnd(F.coalesce(share(F.col("churned"), F.col("customers")), F.lit(0.0)), 8).alias("churn_rate"))
