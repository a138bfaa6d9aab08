"""Checks across the marts, each one row: category, name, status and its figures.

A check declares its figures as named aggregates over views, which are marts or rows derived
from them. ``rows`` evaluates any number of checks together: all figures over a view are one
aggregate of it, and the checks are read off the single row that these make up.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import pairwise
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_if, money, rnd, share
from ..params import ALL, BASELINE_PRIORITY, BASELINE_SHARES, DIMS, MAX_PRIORITY_DRIFT, MAX_TIER_DRIFT, MIN_TREND_BASE, PAYMENT_STATUSES, SHAPES, STATUSES, TIERS
from .contracts import CONTRACTS
from .profile import repeats

QUALITY, METRIC, INTEGRITY, DASHBOARD, GOVERNANCE = "Data Quality", "Metric Correctness", "Analytical Integrity", "Dashboard Review", "Governance & Release"


Of = Callable[[str], Column]


class Check(NamedTuple):
    """``good`` and ``otherwise`` (the status if it isn't) take a function from a figure's name to its column."""

    category: str
    name: str
    #: aggregates by figure, for each view that they are over
    over: dict[str, dict[str, Column]]
    good: Callable[[Of], Column]
    otherwise: str | Callable[[Of], Column]
    #: figures of the evidence, in order
    shown: tuple[str, ...]
    #: figures that come from others
    then: dict[str, Callable[[Of], Column]] = {}


def rows(checks: dict[str, Check], views: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """``category, check_name, status, evidence`` of the checks, from one aggregate a view.

    The evidence lists figures as ``name=value``. A check whose figures are null fails.
    """
    of = lambda key: lambda figure: F.col(f"{key}__{figure}")
    by_view: dict[str, list[Column]] = {}
    for key, check in checks.items():
        for view, figures in check.over.items():
            by_view.setdefault(view, []).extend(c.alias(f"{key}__{figure}") for figure, c in figures.items())
    one = _beside_each_other([views[view]().agg(*cols) for view, cols in by_view.items()])
    if more := {f"{key}__{figure}": made(of(key)) for key, check in checks.items() for figure, made in check.then.items()}:
        one = one.withColumns(more)
    kinds = dict(one.dtypes)

    def row(key: str, check: Check) -> Column:
        value = lambda c: F.col(c).cast("decimal(38,6)") if kinds[c] == "double" else F.col(c)  # noqa: E731  no exponents
        said = F.concat_ws("; ", *[F.concat(F.lit(f"{c}="), value(f"{key}__{c}").cast("string")) for c in check.shown])
        bad = F.lit(check.otherwise) if isinstance(check.otherwise, str) else check.otherwise(of(key))
        status = F.when(F.coalesce(check.good(of(key)), F.lit(False)), "PASS").otherwise(bad)
        return F.struct(F.lit(check.category).alias("category"), F.lit(check.name).alias("check_name"), status.alias("status"), said.alias("evidence"))

    return one.select(F.inline(F.array(*[row(k, c) for k, c in checks.items()])))


def _beside_each_other(ones: list[DataFrame]) -> DataFrame:
    """One row of all one-row tables; by halves, so that no part is analysed over and over."""
    if len(ones) == 1:
        return ones[0]
    return _beside_each_other(ones[: len(ones) // 2]).crossJoin(_beside_each_other(ones[len(ones) // 2 :]))


def _zero(*figures: str) -> Callable[[Of], Column]:
    return lambda f: reduce(lambda a, b: a & b, [f(c) == 0 for c in figures])


def _counted(category: str, name: str, otherwise: str, view: str, figures: dict[str, Column]) -> Check:
    """A check that counts faults over one view."""
    return Check(category, name, {view: figures}, _zero(*figures), otherwise, tuple(figures))


# --- views: rows that some checks' figures are over


def with_signup(subscriptions: DataFrame, customers: DataFrame) -> DataFrame:
    return subscriptions.join(customers.select("customer_id", "signup_date").hint("merge"), "customer_id", "left")


def overlapping(subscriptions: DataFrame) -> DataFrame:
    """Whether a customer has a start no later than the latest end so far; an open end is the end of time."""
    w = Window.partitionBy("customer_id").orderBy("subscription_start_date", F.asc_nulls_last("subscription_end_date")).rowsBetween(Window.unboundedPreceding, -1)
    spans = subscriptions.where("subscription_start_date is not null").withColumn("end", F.coalesce("subscription_end_date", F.lit("9999-12-31").cast("date")))
    spans = spans.select("customer_id", (F.col("subscription_start_date") <= F.max("end").over(w)).alias("bad"))
    return spans.groupBy("customer_id").agg(F.max(F.coalesce("bad", F.lit(False)).cast("int")).alias("bad"))


def outside(usage: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Usage that none of the customer's subscriptions contains."""
    u, s = usage.where("usage_date is not null").alias("u"), subscriptions.alias("s")
    inside = (F.col("u.usage_date") >= F.col("s.subscription_start_date")) & (F.col("s.subscription_end_date").isNull() | (F.col("u.usage_date") <= F.col("s.subscription_end_date")))
    return u.join(s.hint("merge"), (F.col("u.customer_id") == F.col("s.customer_id")) & inside, "left_anti")


def with_span(payments: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Payments with the first start (``a``) and last end (``b``) of the customer's subscriptions, and whether one is ``open``."""
    spans = subscriptions.groupBy("customer_id").agg(
        F.min("subscription_start_date").alias("a"), F.max("subscription_end_date").alias("b"), F.max(F.col("subscription_end_date").isNull()).alias("open")
    )
    return payments.join(spans.hint("merge"), "customer_id", "left")


def with_status(features: DataFrame, subscriptions: DataFrame) -> DataFrame:
    return features.select("customer_id", "churn_flag", "at_risk_flag").join(subscriptions.select("customer_id", "status").hint("merge"), "customer_id", "left")


def risk_again(features: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments with their revenue at risk (``v``) summed from the features."""
    again = features.groupBy("segment").agg(
        (money(F.when(F.col("at_risk_flag") == 1, F.col("current_mrr"))) + money(F.when(F.col("churn_flag") == 1, F.col("avg_monthly_revenue")))).alias("v")
    )
    return segments.join(again, "segment", "left")


def cohort_faults(cohorts: DataFrame) -> DataFrame:
    """By cohort: observations before it, whether its size varies, and rises of what can only fall."""
    w = Window.partitionBy("cohort_month").orderBy("observation_month")
    up = lambda c: (F.col(c) > F.lag(c).over(w) + 1e-9)
    found = cohorts.select("cohort_month", "observation_month", "active_customers", up("retention_rate").alias("u1"), up("revenue_retention").alias("u2"))
    return found.groupBy("cohort_month").agg(
        count_if(F.col("observation_month") < F.col("cohort_month")).alias("before"),
        (F.count_distinct("active_customers") > 1).cast("int").alias("varies"),
        (count_if(F.col("u1")) + count_if(F.col("u2"))).alias("rises"),
    )


def thin_months(trend: DataFrame) -> DataFrame:
    return trend.where(F.col("active_customers_start") < MIN_TREND_BASE).select("month").withColumn("r", F.row_number().over(Window.orderBy("month")))


def said_of_tops(findings: DataFrame, by_dimension: DataFrame, relations: DataFrame) -> DataFrame:
    """Every top value beside what the third finding says."""
    tops = by_dimension.groupBy("dimension").agg(F.max(F.struct("churn_rate", "value"))["value"].alias("v"))
    tops = tops.select("v").union(relations.agg(F.max_by("relationship", F.struct("churn_rate_lift", "relationship"))))
    third = findings.where(F.col("section").startswith("3.")).agg(F.max("result").alias("said"))
    return tops.crossJoin(F.broadcast(third))


def tiers_again(scores: DataFrame, summary: DataFrame) -> DataFrame:
    again = scores.groupBy("risk_tier").agg(F.count("*").alias("n"))
    return again.join(summary.select("risk_tier", "customers"), "risk_tier", "full")


def rank_neighbours(ranked: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Scores beside the ``next`` one by rank. Blocks of ranks are put in order each by itself; a block's first row closes the one before too."""
    number = F.floor((F.col("priority_rank") - 1) / block)
    first = (F.col("priority_rank") - 1) % block == 0
    places = F.when(first & (number > 0), F.array(number, number - 1)).otherwise(F.array(number))
    spread = ranked.select("priority_rank", "retention_priority_score", F.explode(places).alias("block"))
    return spread.select("retention_priority_score", F.lead("retention_priority_score").over(Window.partitionBy("block").orderBy("priority_rank")).alias("next"))


def refolded_beside(refolded: DataFrame, trend: DataFrame) -> DataFrame:
    """The dimensional facts summed up by month beside the official trend; their rates are not rounded, so that no difference is rounded twice."""
    zero = F.lit(0.0)
    again = {
        "customer_churn_rate": share(F.col("churned_customers"), F.col("active_customers_start")),
        "revenue_churn_rate": share(F.col("churned_mrr"), F.col("active_mrr_start")),
    }
    ours = refolded.select("month", *[F.coalesce(r, zero).alias(f"{c}_a") for c, r in again.items()])
    return ours.join(trend.select("month", *[F.coalesce(c, zero).alias(f"{c}_b") for c in again]), "month")


# --- checks


def all_checks(widths: dict[str, int], account_columns: list[str]) -> dict[str, Check]:
    """The cross-mart checks by key, over the views of ``Marts.views``; ``widths`` are the raw tables' numbers of columns."""
    return {**_quality(widths), **_metrics(), **_integrity(), **_governance(), **_dashboard(account_columns)}


def _quality(widths: dict[str, int]) -> dict[str, Check]:
    start, end, day, known = (F.col(c) for c in ("subscription_start_date", "subscription_end_date", "payment_date", "open"))
    fits = lambda f: reduce(lambda a, b: a & b, [f(n).between(*SHAPES[n][:2]) & F.lit(w == SHAPES[n][2]) for n, w in widths.items()])
    others = ("subscription_id", "customer_id", "subscription_start_date", "monthly_revenue", "contract_type", "billing_cycle", "status")
    invalid = lambda c, ok: F.count_distinct(F.when(~F.coalesce(F.col(c).isin(*ok), F.lit(False)), F.coalesce(c, F.lit(""))))
    return {
        "row_column_sanity": Check(QUALITY, "Row/column count sanity", {n: {n: F.count("*")} for n in widths}, fits, "WARN", tuple(widths)),
        "duplicate_handling": Check(QUALITY, "Duplicate handling", {f"{n} repeats": {n: F.max("repeats")} for n in widths}, _zero(*widths), "FAIL", tuple(widths)),
        "null_handling": Check(
            QUALITY, "Null handling",
            {"subscriptions": {"open": F.count_if(end.isNull()), "unexpected_nulls": reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in others])}},
            _zero("unexpected_nulls"), "WARN", ("open", "unexpected_nulls"),
        ),
        "status_consistency": Check(
            QUALITY, "Status consistency",
            {"subscriptions": {"invalid_subscription": invalid("status", STATUSES)}, "payments": {"invalid_payment": invalid("payment_status", PAYMENT_STATUSES)}},
            _zero("invalid_subscription", "invalid_payment"), "FAIL", ("invalid_subscription", "invalid_payment"),
        ),
        "impossible_dates": _counted(QUALITY, "Impossible date logic", "FAIL", "subscriptions with signup", {"end_before_start": count_if(end < start), "signup_after_start": count_if(F.col("signup_date") > start)}),
        "impossible_revenue": _counted(QUALITY, "Impossible revenue values", "FAIL", "subscriptions", {"not_positive": count_if(F.col("monthly_revenue") <= 0)}),
        "overlap_customers": _counted(QUALITY, "Overlapping subscriptions where not expected", "FAIL", "overlapping", {"customers": F.coalesce(F.sum("bad"), F.lit(0))}),
        "usage_outside_period": _counted(QUALITY, "Usage dates outside subscription periods", "WARN", "usage outside", {"outside": F.count("*")}),
        "payment_consistency": _counted(
            QUALITY, "Payment consistency", "WARN", "payments with span",
            {
                "not_positive": count_if(F.col("amount") <= 0),
                "before_start": count_if(day.isNotNull() & known.isNotNull() & (F.col("a").isNull() | (day < F.col("a")))),
                "after_end": count_if(~known & (day > F.col("b"))),
            },
        ),
    }


def _metrics() -> dict[str, Check]:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rate = lambda a, b: zero(F.try_divide(a, b))
    off = lambda flag, status: count_if(F.col(flag) != F.coalesce(F.col("status") == status, F.lit(False)).cast("int"))
    apart = {"d": lambda f: F.abs(f("a") - f("b"))}
    retained, r = rate(F.col("retained_customers"), F.col("active_customers")), F.col("retention_rate")
    churn, lost = zero(F.col("customer_churn_rate")), zero(F.col("revenue_churn_rate"))
    churn_again = rate(F.col("churned_customers"), F.col("active_customers_start"))
    lost_again = zero(F.when(F.col("active_mrr_start") > 0, F.col("churned_mrr") / F.col("active_mrr_start")))
    wrong = count_if((F.abs(churn - churn_again) > 1.1e-6) | (F.abs(lost - lost_again) > 1e-4))
    also = count_if((F.col("active_customers_start") > 0) & (F.abs(zero(r) - (1 - churn)) > 1.1e-6))
    faults = {"observation_before_cohort": "before", "denominator_varies": "varies", "monotonicity_violations": "rises"}
    return {
        "churn_flag_logic": _counted(
            METRIC, "churn_flag logic", "FAIL", "features with status",
            {"churn_mismatches": off("churn_flag", "churned"), "both_flags": count_if((F.col("churn_flag") == 1) & (F.col("at_risk_flag") == 1))},
        ),
        "at_risk_flag_logic": _counted(METRIC, "at_risk_flag logic", "FAIL", "features with status", {"at_risk_mismatches": off("at_risk_flag", "at_risk")}),
        "customer_churn_tieout": Check(
            METRIC, "Customer churn rate calculation",
            {
                "features": {"a": rate(F.sum("churn_flag"), F.count("*"))},
                "segments": {"b": rate(F.sum("churned_customers"), F.sum(F.col("active_customers") + F.col("churned_customers")))},
            },
            lambda f: f("d") <= 1e-6, "FAIL", ("features_rate", "segment_rate"),
            {"features_rate": lambda f: rnd(f("a"), 6), "segment_rate": lambda f: rnd(f("b"), 6), **apart},
        ),
        "revenue_churn_tieout": Check(
            METRIC, "Revenue churn rate calculation",
            {"features": {"a": money(F.when(F.col("churn_flag") == 1, F.col("avg_monthly_revenue")))}, "churn by segment": {"b": money("churned_revenue")}},
            lambda f: f("d") <= 1e-6, "FAIL", ("features_value", "segment_value"),
            {"features_value": lambda f: rnd(f("a"), 2), "segment_value": lambda f: rnd(f("b"), 2), **apart},
        ),
        "revenue_at_risk_tieout": Check(
            METRIC, "Revenue at risk calculation", {"risk again": {"max_diff": rnd(zero(F.max(F.abs(zero(F.col("v")) - F.col("revenue_at_risk")))), 4)}},
            lambda f: f("max_diff") <= 0.01, "FAIL", ("max_diff",),
        ),
        "retention_rate": _counted(
            METRIC, "Retention rate correctness", "FAIL", "cohorts",
            {"mismatches": count_if(F.abs(r - retained) > 1.1e-6), "bounds": count_if((F.col("retained_customers") > F.col("active_customers")) | (r < 0) | (r > 1))},
        ),
        "trend_metrics": _counted(METRIC, "Monthly trend metric correctness", "FAIL", "trend", {"inconsistencies": wrong + also}),
        "cohort_logic": _counted(METRIC, "Cohort logic correctness", "WARN", "cohort faults", {n: F.coalesce(F.sum(c), F.lit(0)) for n, c in faults.items()}),
    }


def _integrity() -> dict[str, Check]:
    n, c = F.col("customers"), F.col("churned_customers")
    named = {"customers": "customers", "subscriptions": "subscriptions' customers", "features": "features", "risk_scores": "scores"}
    first = F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= 6, F.col("month").cast("string")))), ", ")
    issues = count_if((n <= 0) | (c > n)) + count_if(F.abs(F.col("churn_rate") - F.coalesce(F.try_divide(c, n), F.lit(0.0))) > 1.1e-6)
    return {
        "join_inflation": Check(
            INTEGRITY, "Join inflation risk", {view: {f"{k}_rows": F.count("*"), f"{k}_customers": F.count_distinct("customer_id")} for k, view in named.items()},
            lambda f: reduce(lambda a, b: a & b, [f(f"{k}_rows") == f(f"{k}_customers") for k in named]), "FAIL", tuple(f"{k}_{x}" for k in named for x in ("rows", "customers")),
        ),
        "incomplete_periods": Check(INTEGRITY, "Incomplete period comparison risk", {"thin months": {"months": F.count("*"), "first_months": first}}, _zero("months"), "WARN", ("months", "first_months")),
        "denominators": _counted(INTEGRITY, "Denominator correctness", "FAIL", "by dimension", {"issues": issues}),
        "survivorship": Check(
            INTEGRITY, "Survivorship bias risk", {"scores": {"scored": F.count("*")}, "features": {"not_churned": F.count_if(F.col("churn_flag") == 0)}},
            lambda f: f("scored") == f("not_churned"), "WARN", ("scored", "not_churned"),
        ),
        "overclaiming": _counted(INTEGRITY, "Overclaiming risk", "WARN", "relations", {"signals_without_lift": count_if(F.coalesce("churn_rate_lift", F.lit(0.0)) <= 1.0)}),
        "conclusions_supported": Check(
            INTEGRITY, "Conclusions supported by evidence", {"said of tops": {"missing": count_if(~F.contains(F.col("said"), F.col("v"))), "named": F.count("*")}},
            _zero("missing"), "WARN", ("missing", "named"),
        ),
    }


def _governance() -> dict[str, Check]:
    a, t, d, c, r = (F.col(x) for x in ("recommended_action", "risk_tier", "main_risk_driver", "churn_risk_score", "revenue_risk_score"))
    guards = {
        "executive save motion": (t == "critical") & (r >= 70),
        "billing intervention": (d == "failed payments") & (c >= 45),
        "renewal conversation": (d == "contract renewal risk") & (t.isin("medium", "high", "critical") | (r >= 85)),
        "product adoption campaign": d.isin("usage decline", "low adoption") & (c >= 35),
    }
    rises = lambda f: reduce(lambda x, y: x + y, [F.coalesce(f(x) < f(y) - 1e-9, F.lit(False)).cast("bigint") for x, y in pairwise(TIERS)])
    risk, lost = F.when(F.col("at_risk_flag") == 1, F.col("current_mrr")), F.when(F.col("churn_flag") == 1, F.col("avg_monthly_revenue"))
    diff = F.abs(F.coalesce("n", F.lit(0)) - F.coalesce("customers", F.lit(0)))
    return {
        "tier_summary_tieout": _counted(GOVERNANCE, "Risk tier summary cross-output consistency", "FAIL", "tiers again", {"count_diff": F.coalesce(F.sum(diff), F.lit(0))}),
        "priority_monotone": _counted(GOVERNANCE, "Priority ranking monotonicity", "FAIL", "rank neighbours", {"violations": count_if(F.col("next") > F.col("retention_priority_score") + 1e-9)}),
        "tier_score_monotone": Check(
            GOVERNANCE, "Risk tier score monotonicity", {"scores": {x: F.avg(F.when(t == x, F.col("retention_priority_score"))) for x in TIERS}},
            _zero("violations"), "FAIL", ("violations",), {"violations": rises},
        ),
        "action_rules": _counted(GOVERNANCE, "Recommended-action rule consistency", "FAIL", "scores", {"violations": reduce(lambda x, y: x + y, [count_if((a == n) & ~g) for n, g in guards.items()])}),
        "financial_tieout": Check(
            GOVERNANCE, "Financial tie-out consistency",
            {"features": {"a": money(risk), "b": money(risk) + money(lost)}, "segment risk": {"c": money("future_revenue_risk"), "d": money("total_revenue_loss_proxy")}},
            lambda f: f("max_diff") <= 0.01, "FAIL", ("max_diff",), {"max_diff": lambda f: rnd(F.greatest(F.abs(f("a") - f("c")), F.abs(f("b") - f("d"))), 4)},
        ),
        "score_drift": score_drift(),
    }


def score_drift(shares: dict[str, float] = BASELINE_SHARES, mean_priority: float = BASELINE_PRIORITY) -> Check:
    n = F.greatest(F.count("*"), F.lit(1))
    off = F.greatest(*[F.abs(F.count_if(F.col("risk_tier") == t) / n - s) for t, s in shares.items()])
    figures = {"tier_share_drift": rnd(off, 4), "priority_drift": rnd(F.abs(F.coalesce(F.avg("retention_priority_score"), F.lit(0.0)) - mean_priority), 4)}
    good = lambda f: (f("tier_share_drift") <= MAX_TIER_DRIFT) & (f("priority_drift") <= MAX_PRIORITY_DRIFT)
    return Check(GOVERNANCE, "Score stability baseline drift", {"scores": figures}, good, "WARN", tuple(figures))


def _dashboard(account_columns: list[str]) -> dict[str, Check]:
    diff = lambda c: F.max(F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")))
    customers, revenue = diff("customer_churn_rate"), diff("revenue_churn_rate")
    wanted = {*CONTRACTS["processed_risk_scores"].required, *DIMS, "current_mrr", "at_risk_flag"}
    every = reduce(lambda a, b: a & b, [F.col(c) == ALL for c in (*DIMS, "risk_tier_filter")])
    return {
        "kpi_cube_vs_trend": Check(
            DASHBOARD, "Consistency between KPI cards and trend charts",
            {"refolded": {"months": F.count("*"), "max_customer_diff": rnd(customers, 6), "max_revenue_diff": rnd(revenue, 6), "d": F.greatest(customers, revenue)}},
            lambda f: (f("months") > 0) & (f("d") <= 1.1e-6), lambda f: F.when(f("months") == 0, "WARN").otherwise("FAIL"), ("months", "max_customer_diff", "max_revenue_diff"),
        ),
        "cube_has_all_scope": Check(
            DASHBOARD, "Risk chart/table logic consistency", {"cube": {"all_scope_rows": F.count_if(every)}},
            lambda f: (f("all_scope_rows") > 0) & (f("columns_missing") == 0), "FAIL", ("all_scope_rows", "columns_missing"),
            {"columns_missing": lambda f: F.lit(len(wanted - set(account_columns)))},
        ),
    }


def overlap_customers(subscriptions: DataFrame) -> DataFrame:
    """That check alone, of any subscriptions."""
    return rows({"overlap_customers": _quality({})["overlap_customers"]}, {"overlapping": lambda: overlapping(subscriptions)})
