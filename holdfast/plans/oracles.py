"""DuckDB SQL that gives each query's rows by its own way: theta joins instead of running sums, one scan a condition."""

from __future__ import annotations

import re

from ..operators.contracts import CONTRACTS
from ..operators.drivers import PLAYS
from ..operators.profile import CONFIGS
from ..operators.release import BLOCKERS, GATES, MAJOR
from ..params import ACTIONS, BASELINE_PRIORITY, BASELINE_SHARES, DIMS, SHAPES, TIERS, WEIGHTS

D = ", ".join(DIMS)


def r(e: str, n: int) -> str:
    return f"CAST(round(CAST({e} AS DECIMAL(38,10)), {n}) AS DOUBLE)"


def m(e: str) -> str:
    """Exact sum of cents."""
    return f"CAST(coalesce(sum(CAST({e} AS DECIMAL(28,4))), 0) AS DOUBLE)"


def big(e: str) -> str:
    return f"CAST({e} AS BIGINT)"


def i32(e: str) -> str:
    return f"CAST({e} AS INTEGER)"


def iff(cond: str, then: str = "1", other: str = "0") -> str:
    return f"CASE WHEN {cond} THEN {then} ELSE {other} END"


CYCLE = "CASE billing_cycle WHEN 'Monthly' THEN 1 WHEN 'Quarterly' THEN 3 WHEN 'Annual' THEN 12 ELSE 1 END"
MONTHS = "(year({0}) * 12 + month({0}))"
CH, AR = "churn_flag = 1", "at_risk_flag = 1"
_SPINE = "SELECT CAST(unnest(generate_series(date_trunc('month', {a}), date_trunc('month', {b}), INTERVAL 1 MONTH)) AS DATE) AS month"

_CTES: dict[str, str] = {
    "o": "SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders",
    "ld": "SELECT max(day) AS last_day FROM o",
    "customers": """SELECT c_custkey AS customer_id, f.day AS signup_date, c_mktsegment AS segment, r_name AS region, f.o_orderpriority AS acquisition_channel,
  CASE WHEN c_acctbal < 0 THEN 'Basic' WHEN c_acctbal < 3000 THEN 'Growth' WHEN c_acctbal < 6500 THEN 'Pro' ELSE 'Enterprise' END AS plan_type
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey) AS rn FROM o) f ON f.o_custkey = c_custkey AND f.rn = 1""",
    "subs": f"""SELECT o_custkey AS subscription_id, o_custkey AS customer_id, a AS subscription_start_date,
  CASE WHEN last_day - b >= 365 THEN b END AS subscription_end_date,
  {r(f"CAST(total AS DOUBLE) / ({MONTHS.format('b')} - {MONTHS.format('a')} + 1)", 2)} AS monthly_revenue,
  CASE WHEN o_custkey % 2 = 0 THEN 'Annual' ELSE 'Monthly' END AS contract_type,
  CASE o_custkey % 3 WHEN 0 THEN 'Monthly' WHEN 1 THEN 'Quarterly' ELSE 'Annual' END AS billing_cycle,
  CASE WHEN last_day - b >= 365 THEN 'churned' WHEN last_day - b >= 180 THEN 'at_risk' ELSE 'active' END AS status
  FROM (SELECT o_custkey, min(day) AS a, max(day) AS b, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM o GROUP BY 1), ld""",
    "many": """SELECT o_orderkey AS subscription_id, o_custkey AS customer_id, day AS subscription_start_date, e AS subscription_end_date, o_totalprice AS monthly_revenue
  FROM o JOIN (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS e FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
    "usage": f"""SELECT l_orderkey || '-' || l_linenumber AS usage_id, o_custkey AS customer_id, CAST(l_shipdate AS DATE) AS usage_date, {i32("l_quantity")} AS sessions,
  {r("100.0 - l_discount * 1000", 2)} AS feature_adoption_score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS support_tickets,
  {i32("l_linenumber * 25 - 100")} AS nps_score FROM lineitem JOIN o ON l_orderkey = o_orderkey, ld WHERE CAST(l_shipdate AS DATE) <= last_day""",
    "payments": """SELECT o_orderkey AS payment_id, o_custkey AS customer_id, day AS payment_date, o_totalprice AS amount,
  CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'paid' END AS payment_status FROM o""",
    "subsnap": "SELECT greatest(max(subscription_start_date), max(subscription_end_date)) AS snapshot_date FROM subs",
    "snap": """SELECT greatest((SELECT snapshot_date FROM subsnap), (SELECT max(usage_date) FROM usage), (SELECT max(payment_date) FROM payments)) AS snapshot_date""",
    "u30": """SELECT customer_id, sum(sessions) AS s, sum(support_tickets) AS t, avg(feature_adoption_score) AS a, avg(sessions) AS v
  FROM usage, snap WHERE usage_date > snapshot_date - 30 GROUP BY 1""",
    "u90": "SELECT customer_id, sum(sessions) AS s, sum(support_tickets) AS t, avg(nps_score) AS n FROM usage, snap WHERE usage_date > snapshot_date - 90 GROUP BY 1",
    "u60": "SELECT customer_id, avg(sessions) AS v FROM usage, snap WHERE usage_date > snapshot_date - 60 AND usage_date <= snapshot_date - 30 GROUP BY 1",
    "uw": f"""SELECT u90.customer_id, {big("coalesce(u30.s, 0)")} AS recent_sessions_30d, {big("u90.s")} AS recent_sessions_90d, {big("coalesce(u30.t, 0)")} AS support_tickets_30d,
  {big("u90.t")} AS support_tickets_90d, coalesce(u30.a, 0.0) AS feature_adoption_score_recent, coalesce(u90.n, 0.0) AS nps_score_recent,
  coalesce(u30.v, 0.0) AS recent_30_avg_sessions, coalesce(u60.v, 0.0) AS prior_30_avg_sessions,
  {r("coalesce(u30.v, 0.0) - coalesce(u60.v, 0.0)", 4)} AS usage_trend FROM u90 LEFT JOIN u30 USING (customer_id) LEFT JOIN u60 USING (customer_id)""",
    "pm": f"""SELECT p.*, {i32("coalesce(" + CYCLE + ", 1)")} AS cycle_months, amount / coalesce({CYCLE}, 1) AS me FROM payments p LEFT JOIN subs s USING (customer_id)""",
    "paid": "SELECT customer_id, sum(CAST(amount AS DECIMAL(28,4))) AS life, avg(me) AS avg_me FROM pm WHERE payment_status = 'paid' GROUP BY 1",
    "failed": "SELECT customer_id, count(*) AS n FROM pm, snap WHERE payment_status = 'failed' AND payment_date > snapshot_date - 90 GROUP BY 1",
    "p90": "SELECT customer_id, avg(me) AS v FROM pm, snap WHERE payment_status = 'paid' AND payment_date > snapshot_date - 90 GROUP BY 1",
    "p180": "SELECT customer_id, avg(me) AS v FROM pm, snap WHERE payment_status = 'paid' AND payment_date > snapshot_date - 180 AND payment_date <= snapshot_date - 90 GROUP BY 1",
    "pw": f"""SELECT customer_id, CAST(life AS DOUBLE) AS lifetime_revenue, avg_me AS avg_monthly_revenue_calc, coalesce(failed.n, 0) AS failed_payments_90d,
  {i32(iff("coalesce(failed.n, 0) > 0"))} AS payment_failure_flag, coalesce(p90.v, 0.0) AS recent_paid, coalesce(p180.v, 0.0) AS prior_paid,
  {i32(iff("coalesce(p180.v, 0.0) > 0 AND coalesce(p90.v, 0.0) < p180.v * 0.85"))} AS contraction_flag
  FROM paid LEFT JOIN failed USING (customer_id) LEFT JOIN p90 USING (customer_id) LEFT JOIN p180 USING (customer_id)""",
    "ren0": f"""SELECT subscription_id, customer_id, status, snapshot_date, subscription_start_date AS s, {CYCLE} AS c,
  CAST(subscription_start_date + to_months(CAST(({MONTHS.format('snapshot_date')} - {MONTHS.format('subscription_start_date')}) // {CYCLE} * {CYCLE} AS INTEGER)) AS DATE) AS here
  FROM subs, snap""",
    "ren": """SELECT subscription_id, customer_id, status, snapshot_date,
  CASE WHEN s > snapshot_date THEN s WHEN here <= snapshot_date THEN CAST(here + to_months(CAST(c AS INTEGER)) AS DATE) ELSE here END AS next_renewal_date FROM ren0""",
    "feat": f"""SELECT customer_id, {D}, {big("greatest(coalesce(subscription_end_date, snap.snapshot_date) - subscription_start_date, 0)")} AS tenure_days,
  {r("CASE WHEN s.status = 'churned' THEN 0.0 ELSE monthly_revenue END", 2)} AS current_mrr, {r("coalesce(avg_monthly_revenue_calc, monthly_revenue)", 2)} AS avg_monthly_revenue,
  {r("coalesce(lifetime_revenue, 0.0)", 2)} AS lifetime_revenue, {big("coalesce(recent_sessions_30d, 0)")} AS recent_sessions_30d, {big("coalesce(recent_sessions_90d, 0)")} AS recent_sessions_90d,
  coalesce(usage_trend, 0.0) AS usage_trend, {r("coalesce(feature_adoption_score_recent, 0.0)", 4)} AS feature_adoption_score_recent,
  {big("coalesce(support_tickets_30d, 0)")} AS support_tickets_30d, {big("coalesce(support_tickets_90d, 0)")} AS support_tickets_90d, {r("coalesce(nps_score_recent, 0.0)", 4)} AS nps_score_recent,
  {big("coalesce(failed_payments_90d, 0)")} AS failed_payments_90d, {i32("coalesce(payment_failure_flag, 0)")} AS payment_failure_flag,
  {i32(iff("s.status <> 'churned' AND next_renewal_date - snap.snapshot_date BETWEEN 0 AND 45"))} AS renewal_near_flag, {i32("coalesce(contraction_flag, 0)")} AS contraction_flag,
  {i32(iff("s.status = 'churned'"))} AS churn_flag, {i32(iff("s.status = 'at_risk'"))} AS at_risk_flag
  FROM customers JOIN subs s USING (customer_id) JOIN ren USING (customer_id) LEFT JOIN uw USING (customer_id) LEFT JOIN pw USING (customer_id), snap""",
    "cspine": _SPINE.format(a="(SELECT min(subscription_start_date) FROM subs)", b="(SELECT snapshot_date FROM snap)"),
    "tspine": _SPINE.format(a="(SELECT min(subscription_start_date) FROM subs)", b="(SELECT snapshot_date FROM subsnap)"),
    "cohort": f"""SELECT cohort_month, month AS observation_month, {big("count(*)")} AS active_customers,
  {big("count(*) FILTER (WHERE subscription_end_date IS NULL OR subscription_end_date > last_day(month))")} AS retained_customers,
  {r("count(*) FILTER (WHERE subscription_end_date IS NULL OR subscription_end_date > last_day(month)) / count(*)", 6)} AS retention_rate,
  {r("coalesce(CASE WHEN sum(monthly_revenue) > 0 THEN " + m("CASE WHEN subscription_end_date IS NULL OR subscription_end_date > last_day(month) THEN monthly_revenue END") + " / " + m("monthly_revenue") + " END, 0.0)", 6)} AS revenue_retention
  FROM (SELECT *, CAST(date_trunc('month', subscription_start_date) AS DATE) AS cohort_month FROM subs) JOIN cspine ON month >= cohort_month GROUP BY 1, 2""",
    "aged": f"SELECT *, {MONTHS.format('observation_month')} - {MONTHS.format('cohort_month')} AS cohort_age_months FROM cohort",
    "segs": f"""SELECT segment, {big(f"count(*) FILTER (WHERE churn_flag = 0)")} AS active_customers, {big(f"count(*) FILTER (WHERE {CH})")} AS churned_customers, {r("avg(churn_flag)", 6)} AS churn_rate,
  {r(m(f"CASE WHEN {AR} THEN current_mrr ELSE 0 END + CASE WHEN {CH} THEN avg_monthly_revenue ELSE 0 END"), 2)} AS revenue_at_risk, {r("avg(tenure_days)", 2)} AS avg_tenure,
  {r("avg(nps_score_recent)", 2)} AS avg_nps, {r("avg(usage_trend)", 4)} AS avg_usage_trend FROM feat GROUP BY 1""",
    "act": f"SELECT month, count(*) AS n, {m('monthly_revenue')} AS v FROM tspine JOIN subs ON subscription_start_date <= month AND (subscription_end_date IS NULL OR subscription_end_date >= month) GROUP BY 1",
    "chn": f"SELECT month, count(*) AS n, {m('monthly_revenue')} AS v FROM tspine JOIN subs ON subscription_end_date >= month AND subscription_end_date <= last_day(month) GROUP BY 1",
    "t0": "SELECT month, coalesce(act.n, 0) AS n, coalesce(act.v, 0.0) AS v, coalesce(chn.n, 0) AS cn, coalesce(chn.v, 0.0) AS cv FROM tspine LEFT JOIN act USING (month) LEFT JOIN chn USING (month)",
    "trend": f"""SELECT month, {big("n")} AS active_customers_start, {r("v", 2)} AS active_mrr_start, {big("cn")} AS churned_customers, {r("cv", 2)} AS churned_mrr,
  {r("CASE WHEN n > 0 THEN cn / n END", 6)} AS customer_churn_rate, {r("CASE WHEN v > 0 THEN cv / v END", 6)} AS revenue_churn_rate, {r("CASE WHEN n > 0 THEN 1 - cn / n END", 6)} AS retention_rate FROM t0""",
    "dsubs": f"SELECT s.*, {D} FROM subs s JOIN customers USING (customer_id) WHERE " + " AND ".join(f"{d} IS NOT NULL" for d in DIMS),
    "dact": f"SELECT month, {D}, count(*) AS n, {m('monthly_revenue')} AS v FROM tspine JOIN dsubs ON subscription_start_date <= month AND (subscription_end_date IS NULL OR subscription_end_date >= month) GROUP BY ALL",
    "dchn": f"SELECT month, {D}, count(*) AS n, {m('monthly_revenue')} AS v FROM tspine JOIN dsubs ON subscription_end_date >= month AND subscription_end_date <= last_day(month) GROUP BY ALL",
    "facts": f"""SELECT month, {D}, {big("coalesce(dact.n, 0)")} AS active_customers_start, {r("coalesce(dact.v, 0.0)", 2)} AS active_mrr_start, {big("coalesce(dchn.n, 0)")} AS churned_customers,
  {r("coalesce(dchn.v, 0.0)", 2)} AS churned_mrr FROM dact FULL JOIN dchn USING (month, {D})""",
    "slope": f"""SELECT {r("CASE WHEN count(*) >= 3 THEN regr_slope(customer_churn_rate, i) ELSE 0.0 END", 8)} AS customer_churn_slope_last12,
  {r("CASE WHEN count(*) >= 3 THEN regr_slope(revenue_churn_rate, i) ELSE 0.0 END", 8)} AS revenue_churn_slope_last12, {r("avg(customer_churn_rate)", 8)} AS avg_customer_churn_last12,
  {r("avg(revenue_churn_rate)", 8)} AS avg_revenue_churn_last12
  FROM (SELECT *, -row_number() OVER (ORDER BY month DESC) AS i FROM trend WHERE active_customers_start >= 100 ORDER BY month DESC LIMIT 12)""",
    "ov": f"""SELECT count(*) AS total_customers, count(*) FILTER (WHERE churn_flag = 0) AS active_customers, count(*) FILTER (WHERE {CH}) AS churned_customers,
  count(*) FILTER (WHERE {AR}) AS at_risk_customers, {m("avg_monthly_revenue")} AS tv, {m(f"CASE WHEN {CH} THEN avg_monthly_revenue END")} AS cv, {m(f"CASE WHEN {AR} THEN current_mrr END")} AS am FROM feat""",
    "overall": f"""SELECT snapshot_date, total_customers, active_customers, churned_customers, at_risk_customers, {r("churned_customers / total_customers", 8)} AS customer_churn_rate,
  {r("tv", 2)} AS total_monthly_value, {r("cv", 2)} AS churned_monthly_value, {r("cv / tv", 8)} AS revenue_churn_rate, {r("am", 2)} AS at_risk_mrr,
  {r("cv / tv - churned_customers / total_customers", 8)} AS customer_vs_revenue_churn_delta, slope.* FROM subsnap, ov, slope""",
    "health0": "SELECT *, row_number() OVER (ORDER BY cohort_month) AS i, count(*) OVER () AS n FROM aged WHERE cohort_age_months = 6",
    "health1": f"""SELECT count(*) AS mature_cohort_count_at_6m, {r("avg(retention_rate)", 6)} AS avg_6m_retention, {r("avg(revenue_retention)", 6)} AS avg_6m_revenue_retention,
  {r("CASE WHEN count(*) >= 6 THEN avg(retention_rate) FILTER (WHERE i > n - least(6, n // 2)) - avg(retention_rate) FILTER (WHERE i <= least(6, n // 2)) ELSE 0.0 END", 6)} AS retention_delta_recent_vs_early_6m,
  {r("CASE WHEN count(*) >= 6 THEN avg(revenue_retention) FILTER (WHERE i > n - least(6, n // 2)) - avg(revenue_retention) FILTER (WHERE i <= least(6, n // 2)) ELSE 0.0 END", 6)} AS revenue_retention_delta_recent_vs_early_6m
  FROM health0""",
    "health": """SELECT (SELECT count(DISTINCT cohort_month) FROM cohort) AS cohort_count, *,
  CASE WHEN retention_delta_recent_vs_early_6m > 0.02 THEN 'improving' WHEN retention_delta_recent_vs_early_6m < -0.02 THEN 'deteriorating' ELSE 'mixed/stable' END AS cohort_trend_label FROM health1""",
    "bydim": " UNION ALL ".join(
        f"""SELECT '{d}' AS dimension, {d} AS value, count(customer_id) AS customers, {big("sum(churn_flag)")} AS churned_customers, {r("avg(churn_flag)", 8)} AS churn_rate,
  {r(m(f"CASE WHEN {CH} THEN avg_monthly_revenue END"), 2)} AS churned_revenue, {r("avg(avg_monthly_revenue)", 6)} AS avg_monthly_revenue FROM feat WHERE {d} IS NOT NULL GROUP BY {d}"""
        for d in DIMS
    ),
    "thr": """SELECT quantile_cont(support_tickets_90d, 0.75) AS q75_tickets, quantile_cont(nps_score_recent, 0.25) AS q25_nps,
  quantile_cont(feature_adoption_score_recent, 0.25) AS q25_adoption, quantile_cont(feature_adoption_score_recent, 0.40) AS q40_adoption FROM feat""",
    "ft": "SELECT feat.*, thr.* FROM feat, thr",
}

_FLAGS = {
    "usage_decline_flag": "usage_trend < 0",
    "high_support_ticket_flag": "support_tickets_90d >= q75_tickets",
    "failed_payment_flag": "payment_failure_flag = 1",
    "low_nps_flag": "nps_score_recent <= q25_nps",
    "low_feature_adoption_flag": "feature_adoption_score_recent <= q25_adoption",
}
_HIDDEN = f"churn_flag = 0 AND at_risk_flag = 0 AND (payment_failure_flag = 1 OR (usage_trend < 0 AND (support_tickets_90d >= q75_tickets OR nps_score_recent <= q25_nps)))"
_SIGNAL = "(at_risk_flag = 1 OR payment_failure_flag = 1 OR usage_trend < 0 OR nps_score_recent <= q25_nps)"
_ADOPT = "(usage_trend < 0 AND feature_adoption_score_recent <= q40_adoption)"
_SERVICE = "(support_tickets_90d >= q75_tickets OR nps_score_recent <= q25_nps)"
_RULES = {
    "Payment Rescue": ("payment_failure_flag = 1", "payment_failure_flag = 1"),
    "Renewal Save Desk": (f"renewal_near_flag = 1 AND {_SIGNAL}", _SIGNAL),
    "Adoption Reactivation": (_ADOPT, _ADOPT),
    "Service Recovery": (f"{_SERVICE} AND (at_risk_flag = 1 OR usage_trend < 0)", _SERVICE),
}
_FOCUS = """coalesce((SELECT string_agg(segment || ' ($' || format('{{:,}}', CAST(m AS BIGINT)) || ')', ', ' ORDER BY i) FROM
  (SELECT segment, {m} AS m, row_number() OVER (ORDER BY {s} DESC, segment) AS i FROM ft WHERE churn_flag = 0 AND {can} AND segment IS NOT NULL GROUP BY segment) WHERE i <= 2), 'n/a')"""
_UNIT = "least(greatest({0}, 0.0), 1.0)"
_S = {
    "usage decline": _UNIT.format("-usage_trend / 4.0"),
    "failed payments": _UNIT.format("failed_payments_90d / 2.0"),
    "support burden": _UNIT.format("support_tickets_90d / 6.0"),
    "low NPS": _UNIT.format("(25.0 - nps_score_recent) / 35.0"),
    "low adoption": _UNIT.format("(55.0 - feature_adoption_score_recent) / 35.0"),
}
_C = {n: f"s{k}" for k, n in enumerate(WEIGHTS)}
_PCT = "format('{{:.1f}}', " + "{0}) || '%'"


def _pct(e: str) -> str:
    return f"(format('{{:.1f}}', {r(f'({e}) * 100', 1)}) || '%')"


def _usd(e: str) -> str:
    return f"('$' || format('{{:,}}', CAST({r(e, 0)} AS BIGINT)))"


def _rank(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count(*) OVER ()"


_CTES |= {
    "rel": " UNION ALL ".join(
        f"""SELECT '{n}' AS relationship, count(*) FILTER (WHERE {c}) AS customers_in_group, {r(f"count(*) FILTER (WHERE {c}) / count(*)", 6)} AS share_of_base,
  {r(f"avg(churn_flag) FILTER (WHERE {c})", 6)} AS churn_rate_in_group, {r(f"avg(churn_flag) FILTER (WHERE NOT ({c}))", 6)} AS churn_rate_out_group,
  {r(f"CASE WHEN avg(churn_flag) FILTER (WHERE NOT ({c})) > 0 THEN avg(churn_flag) FILTER (WHERE {c}) / avg(churn_flag) FILTER (WHERE NOT ({c})) END", 6)} AS churn_rate_lift,
  {r(f"(avg(churn_flag) FILTER (WHERE {c}) - avg(churn_flag) FILTER (WHERE NOT ({c}))) * 100", 3)} AS churn_rate_delta_pp FROM ft"""
        for n, c in _FLAGS.items()
    ),
    "drv0": " UNION ALL ".join(
        [f"SELECT '{n}' AS driver, count(*) AS n, avg(churn_flag) AS rate, avg(avg_monthly_revenue) AS value FROM ft WHERE {c}" for n, c in _FLAGS.items()]
        + [f"SELECT '{d}=' || {d}, count(*), avg(churn_flag), avg(avg_monthly_revenue) FROM ft WHERE {d} IS NOT NULL GROUP BY {d}" for d in DIMS]
    ),
    "hv": f"SELECT coalesce(quantile_cont(current_mrr, 0.75), 0.0) AS hv FROM feat WHERE {AR}",
    "risksum": f"""SELECT {r(m(f"CASE WHEN {AR} THEN current_mrr END"), 2)} AS at_risk_mrr, {r(m(f"CASE WHEN {_HIDDEN} THEN current_mrr END"), 2)} AS hidden_at_risk_mrr,
  {r(m(f"CASE WHEN {AR} OR ({_HIDDEN}) THEN current_mrr END"), 2)} AS future_revenue_at_risk, {r(m(f"CASE WHEN {CH} THEN avg_monthly_revenue END"), 2)} AS realized_churned_revenue,
  count(*) FILTER (WHERE {AR} AND current_mrr >= hv) AS high_value_at_risk_count, {r(m(f"CASE WHEN {AR} AND current_mrr >= hv THEN current_mrr END"), 2)} AS high_value_at_risk_mrr,
  {r("max(hv)", 4)} AS high_value_threshold FROM ft, hv""",
    "segrisk": f"""SELECT segment, count(*) AS customers, {big("sum(at_risk_flag)")} AS at_risk_customers, {big("sum(churn_flag)")} AS churned_customers,
  {r(m(f"CASE WHEN {AR} THEN current_mrr END"), 2)} AS at_risk_mrr, {r(m(f"CASE WHEN {CH} THEN avg_monthly_revenue END"), 2)} AS churned_revenue,
  {r(m(f"CASE WHEN {AR} THEN current_mrr END"), 2)} AS future_revenue_risk,
  {r(m(f"CASE WHEN {AR} THEN current_mrr END") + " + " + m(f"CASE WHEN {CH} THEN avg_monthly_revenue END"), 2)} AS total_revenue_loss_proxy FROM feat GROUP BY 1""",
    "quart": "SELECT quantile_cont(avg_monthly_revenue, 0.25) AS a, quantile_cont(avg_monthly_revenue, 0.5) AS b, quantile_cont(avg_monthly_revenue, 0.75) AS c FROM feat",
    "tiers0": f"""SELECT CASE WHEN avg_monthly_revenue <= a THEN 'Low' WHEN avg_monthly_revenue <= b THEN 'Mid-Low' WHEN avg_monthly_revenue <= c THEN 'Mid-High' ELSE 'High' END AS value_tier,
  count(*) AS customers, sum(churn_flag) AS cc, avg(churn_flag) AS rate, {m(f"CASE WHEN {CH} THEN avg_monthly_revenue END")} AS cr, avg(avg_monthly_revenue) AS v FROM feat, quart GROUP BY 1""",
    "tiers": f"""SELECT value_tier, customers, {big("cc")} AS churned_customers, {r("rate", 8)} AS churn_rate, {r("cr", 2)} AS churned_revenue, {r("v", 6)} AS avg_monthly_revenue,
  {r("cc / greatest(sum(cc) OVER (), 1)", 8)} AS share_of_churned_customers, {r("cr / greatest(sum(cr) OVER (), 1.0)", 8)} AS share_of_churned_revenue FROM tiers0""",
    "plays": " UNION ALL ".join(
        f"""SELECT '{n}' AS opportunity, {big(f"count(*) FILTER (WHERE churn_flag = 0 AND {can})")} AS recoverable_customers, {r(m(f"CASE WHEN churn_flag = 0 AND {can} THEN current_mrr END"), 2)} AS recoverable_mrr,
  {r(f"coalesce(avg(churn_flag) FILTER (WHERE {like}), 0.0)", 6)} AS benchmark_churn_rate,
  {r(m(f"CASE WHEN churn_flag = 0 AND {can} THEN current_mrr END") + f" * coalesce(avg(churn_flag) FILTER (WHERE {like}), 0.0)", 2)} AS priority_score,
  {_FOCUS.format(m=r(m("current_mrr"), 0), s=m("current_mrr"), can=can)} AS segment_focus, '{PLAYS[n]}' AS recommended_action FROM ft"""
        for n, (can, like) in _RULES.items()
    ),
    "tops": "SELECT dimension, arg_max(value, (churn_rate, value)) AS v, max(churn_rate) AS c FROM bydim GROUP BY 1",
    "strong": "SELECT arg_max(relationship, (churn_rate_lift, relationship)) AS rel, max(churn_rate_lift) AS lift FROM rel",
    "findings": f"""SELECT '1. Overall Retention Health' AS section, 'Active base ' || format('{{:,}}', active_customers) || ' / ' || format('{{:,}}', total_customers) || '; customer churn ' || {_pct("customer_churn_rate")}
  || '; revenue churn ' || {_pct("revenue_churn_rate")} || '; at-risk MRR ' || {_usd("at_risk_mrr")} || '.' AS result, customer_churn_rate AS value FROM overall
  UNION ALL SELECT '2. Cohort Retention', '6-month retention ' || {_pct("avg_6m_retention")} || '; 6-month revenue retention ' || {_pct("avg_6m_revenue_retention")} || '; trend is ' || cohort_trend_label || '.', avg_6m_retention FROM health
  UNION ALL SELECT '3. Churn Drivers', 'Highest segment churn: ' || (SELECT v || ' (' || {_pct("c")} || ')' FROM tops WHERE dimension = 'segment') || '; region: ' || (SELECT v || ' (' || {_pct("c")} || ')' FROM tops WHERE dimension = 'region')
  || '; channel: ' || (SELECT v || ' (' || {_pct("c")} || ')' FROM tops WHERE dimension = 'acquisition_channel') || '; plan: ' || (SELECT v || ' (' || {_pct("c")} || ')' FROM tops WHERE dimension = 'plan_type')
  || '; strongest behavioral lift: ' || rel || ' (' || format('{{:.2f}}', {r("lift", 2)}) || 'x).', lift FROM strong
  UNION ALL SELECT '4. Revenue at Risk', 'Future revenue at risk ' || {_usd("future_revenue_at_risk")} || '; high-value at-risk MRR ' || {_usd("high_value_at_risk_mrr")} || '; largest loss segment '
  || (SELECT arg_max(segment, (total_revenue_loss_proxy, segment)) || ' (' || {_usd("max(total_revenue_loss_proxy)")} || ')' FROM segrisk) || '; high-tier share of churned customers '
  || (SELECT {_pct("sum(share_of_churned_customers)")} FROM tiers WHERE value_tier IN ('Mid-High', 'High')) || '.', future_revenue_at_risk FROM risksum
  UNION ALL SELECT '5. Retention Opportunities', 'Top play: ' || opportunity || ' with recoverable MRR ' || {_usd("recoverable_mrr")} || ' and benchmark churn ' || {_pct("benchmark_churn_rate")} || '.', recoverable_mrr
  FROM (SELECT * FROM plays ORDER BY priority_score DESC, opportunity DESC LIMIT 1)""",
    "sig0": f"SELECT *, {', '.join(f'{e} AS {_C[n]}' for n, e in _S.items())} FROM feat WHERE churn_flag = 0",
    "sig": f"SELECT *, renewal_near_flag * (0.60 + 0.40 * greatest(s0, s1, s3, s4)) AS s5 FROM sig0",
    "sc0": f"""SELECT *, {r("least(greatest((" + " + ".join(f"{_C[n]} * {w}" for n, w in WEIGHTS.items()) + ") * 100.0 + contraction_flag * 8.0 + CASE WHEN recent_sessions_30d = 0 THEN 6.0 ELSE 0.0 END, 0.0), 100.0)", 2)} AS churn_risk_score,
  {r(f"100.0 * (0.60 * {_rank('current_mrr')} + 0.30 * {_rank('avg_monthly_revenue')} + 0.10 * {_rank('lifetime_revenue')})", 2)} AS revenue_risk_score FROM sig""",
    "sc1": f"SELECT *, {r('0.65 * churn_risk_score + 0.35 * revenue_risk_score', 2)} AS retention_priority_score, [{', '.join(f'{_C[n]} * {w} * 100.0' for n, w in WEIGHTS.items())}] AS parts FROM sc0",
    "sc2": f"""SELECT *, CASE WHEN retention_priority_score >= 75 OR (churn_risk_score >= 85 AND revenue_risk_score >= 70) THEN 'critical' WHEN retention_priority_score >= 60 THEN 'high'
  WHEN retention_priority_score >= 40 THEN 'medium' ELSE 'low' END AS risk_tier, [{', '.join(f"'{n}'" for n in WEIGHTS)}][list_position(parts, list_max(parts))] AS main_risk_driver FROM sc1""",
    "sc3": """SELECT *, CASE WHEN risk_tier = 'critical' AND revenue_risk_score >= 70 THEN 'executive save motion'
  WHEN main_risk_driver = 'failed payments' AND churn_risk_score >= 45 THEN 'billing intervention'
  WHEN main_risk_driver = 'contract renewal risk' AND (risk_tier IN ('medium', 'high', 'critical') OR revenue_risk_score >= 85) THEN 'renewal conversation'
  WHEN main_risk_driver IN ('usage decline', 'low adoption') AND churn_risk_score >= 35 THEN 'product adoption campaign'
  WHEN risk_tier IN ('high', 'critical') THEN 'customer success outreach'
  WHEN risk_tier = 'medium' AND main_risk_driver IN ('support burden', 'low NPS') THEN 'customer success outreach' ELSE 'monitor only' END AS recommended_action FROM sc2""",
    "scores": f"""SELECT customer_id, {D}, tenure_days, current_mrr, avg_monthly_revenue, lifetime_revenue, churn_risk_score, revenue_risk_score, retention_priority_score, risk_tier, main_risk_driver, recommended_action,
  'Tier=' || risk_tier || '; driver=' || main_risk_driver || '; churn_risk=' || format('{{:.1f}}', {r("churn_risk_score", 1)}) || '; revenue_risk=' || format('{{:.1f}}', {r("revenue_risk_score", 1)})
  || '; priority=' || format('{{:.1f}}', {r("retention_priority_score", 1)}) || '; current_mrr=$' || format('{{:.2f}}', current_mrr) || '.' AS recommendation_context,
  at_risk_flag, payment_failure_flag, renewal_near_flag, contraction_flag, usage_trend, support_tickets_90d, nps_score_recent, feature_adoption_score_recent, failed_payments_90d FROM sc3""",
    "rkd": "SELECT *, row_number() OVER (ORDER BY retention_priority_score DESC, current_mrr DESC, customer_id) AS priority_rank FROM scores",
    "tsum": f"""SELECT risk_tier, {i32(f"list_position([{', '.join(repr(t) for t in TIERS)}], risk_tier)")} AS tier_order, count(*) AS customers, {r("count(*) / (SELECT count(*) FROM scores)", 6)} AS share_of_scored_base,
  {r(m("current_mrr"), 2)} AS total_current_mrr, {r("avg(churn_risk_score)", 2)} AS avg_churn_risk_score, {r("avg(revenue_risk_score)", 2)} AS avg_revenue_risk_score,
  {r("avg(retention_priority_score)", 2)} AS avg_retention_priority_score FROM scores GROUP BY risk_tier""",
    "enr": f"""SELECT f.*, s.churn_risk_score, s.revenue_risk_score, s.retention_priority_score, coalesce(s.risk_tier, CASE WHEN {CH} THEN 'churned' ELSE 'low' END) AS risk_tier,
  coalesce(s.main_risk_driver, 'historical churn') AS main_risk_driver, coalesce(s.recommended_action, 'monitor only') AS recommended_action FROM feat f LEFT JOIN scores s USING (customer_id)""",
    "cells": f"""SELECT {D}, risk_tier, churn_flag, count(*) AS customer_count, {r(m("current_mrr"), 2)} AS current_mrr_sum, {r(m("usage_trend"), 4)} AS usage_sum, {big("sum(support_tickets_90d)")} AS support_sum,
  {r(m("nps_score_recent"), 4)} AS nps_sum, {big("sum(payment_failure_flag)")} AS payment_failure_sum, {big("count(*) FILTER (WHERE usage_trend < 0)")} AS usage_decline_count,
  {r(m(f"CASE WHEN {AR} THEN current_mrr END"), 2)} AS at_risk_mrr_component, {r(m(f"CASE WHEN {CH} THEN avg_monthly_revenue END"), 2)} AS churned_revenue_component FROM enr GROUP BY ALL""",
    "acc": f"""SELECT customer_id, {D}, {r("current_mrr", 2)} AS current_mrr, at_risk_flag, {r("usage_trend", 2)} AS usage_trend, support_tickets_90d, {r("nps_score_recent", 2)} AS nps_score_recent, payment_failure_flag,
  churn_risk_score, revenue_risk_score, retention_priority_score, risk_tier, main_risk_driver, recommended_action FROM enr WHERE churn_flag = 0""",
    "exp": f"""SELECT {', '.join(f"unnest([{d}, '__all__']) AS {d}" for d in DIMS[:1])}, * EXCLUDE (segment) FROM acc""",
    "exp2": "SELECT unnest([region, '__all__']) AS region, * EXCLUDE (region) FROM exp",
    "exp3": "SELECT unnest([acquisition_channel, '__all__']) AS acquisition_channel, * EXCLUDE (acquisition_channel) FROM exp2",
    "exp4": "SELECT unnest([plan_type, '__all__']) AS plan_type, * EXCLUDE (plan_type) FROM exp3",
    "exp5": "SELECT unnest([risk_tier, '__all__']) AS risk_tier_filter, * FROM exp4",
    "cube": f"""SELECT {D}, risk_tier_filter, count(*) AS scored_customers, {r(m("current_mrr"), 2)} AS total_current_mrr,
  {r(m(f"CASE WHEN {AR} OR risk_tier IN ('high', 'critical') THEN current_mrr END"), 2)} AS revenue_at_risk, {big("count(*) FILTER (WHERE risk_tier IN ('high', 'critical'))")} AS high_risk_customers,
  {big("count(*) FILTER (WHERE risk_tier = 'critical')")} AS critical_customers, {r(m("retention_priority_score"), 2)} AS priority_sum,
  {r(r(m("retention_priority_score"), 2) + " / count(*)", 2)} AS avg_priority_score FROM exp5 GROUP BY ALL""",
    "refold": f"""SELECT month, {big("sum(active_customers_start)")} AS active_customers_start, {r(m("active_mrr_start"), 2)} AS active_mrr_start, {big("sum(churned_customers)")} AS churned_customers, {r(m("churned_mrr"), 2)} AS churned_mrr FROM facts GROUP BY 1""",
}

_RAW = {"customers": "customers", "subscriptions": "subs", "product_usage": "usage", "payments": "payments"}
_TYPES = {
    "customers": "customer_id bigint, signup_date date, segment string, region string, acquisition_channel string, plan_type string",
    "subscriptions": "subscription_id bigint, customer_id bigint, subscription_start_date date, subscription_end_date date, monthly_revenue double, contract_type string, billing_cycle string, status string",
    "product_usage": "usage_id string, customer_id bigint, usage_date date, sessions int, feature_adoption_score double, support_tickets int, nps_score int",
    "payments": "payment_id bigint, customer_id bigint, payment_date date, amount double, payment_status string",
}


def _cols(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split(" ")) for c in _TYPES[table].split(", ")]


_CTES["colprof"] = " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, '{c}' AS column_name, '{k}' AS dtype, '{CONFIGS[t].kind(c)}' AS classification, count(*) FILTER (WHERE {c} IS NULL) AS null_count,
  {r(f"coalesce(count(*) FILTER (WHERE {c} IS NULL) / nullif(count(*), 0), 0.0)", 6)} AS null_rate, count(DISTINCT {c}) AS distinct_count FROM {_RAW[t]}"""
    for t in _RAW
    for c, k in _cols(t)
)


def _dq(table: str, name: str, failed: str, of: str, severity: str) -> str:
    return f"""SELECT '{table}' AS table_name, '{name}' AS check_name, {big("f")} AS failed_rows, {big("d")} AS denominator, {r("coalesce(f / nullif(d, 0), 0.0)", 6)} AS failure_rate,
  '{severity}' AS severity, CASE WHEN f > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM (SELECT {failed} AS f, {of} AS d)"""


def _count(table: str, where: str | None = None) -> str:
    return f"(SELECT count(*) FROM {table}" + (f" WHERE {where})" if where else ")")


_LAGGED = "(SELECT count(*) FROM (SELECT subscription_start_date AS a, lag(coalesce(subscription_end_date, snapshot_date)) OVER (PARTITION BY customer_id ORDER BY subscription_start_date NULLS LAST, subscription_end_date NULLS LAST) AS b FROM {0}, snap) WHERE a <= b)"
_US = "(SELECT count(*) FROM usage u LEFT JOIN subs s USING (customer_id) WHERE s.subscription_start_date IS NULL OR usage_date < s.subscription_start_date OR usage_date > s.subscription_end_date)"
_PS = """(SELECT count(*) FROM payments p LEFT JOIN subs s USING (customer_id) WHERE coalesce(payment_status NOT IN ('paid', 'failed'), true) OR amount IS NULL OR amount <= 0 OR isinf(amount) OR isnan(amount)
  OR s.subscription_start_date IS NULL OR payment_date < s.subscription_start_date OR payment_date > s.subscription_end_date)"""
_SN, _UN = _count("subs"), _count("usage")
_DQ = {
    "overlapping_subscriptions": ("subscriptions", _LAGGED.format("subs"), "(SELECT count(DISTINCT customer_id) FROM subs)", "high"),
    "impossible_revenue_values": ("subscriptions", _count("subs", "monthly_revenue IS NULL OR isnan(monthly_revenue) OR isinf(monthly_revenue) OR monthly_revenue <= 0"), _SN, "high"),
    "invalid_subscription_status": ("subscriptions", _count("subs", "status IS NULL OR status NOT IN ('active', 'at_risk', 'churned')"), _SN, "high"),
    "usage_outside_subscription_period": ("product_usage", _US, "(SELECT count(*) FROM usage LEFT JOIN subs USING (customer_id))", "high"),
    "payment_inconsistencies": ("payments", _PS, _count("payments"), "high"),
    "invalid_contract_type": ("subscriptions", _count("subs", "contract_type IS NULL OR contract_type NOT IN ('Annual', 'Monthly')"), _SN, "medium"),
    "invalid_billing_cycle": ("subscriptions", _count("subs", "billing_cycle IS NULL OR billing_cycle NOT IN ('Monthly', 'Quarterly', 'Annual')"), _SN, "medium"),
    "subscription_end_before_start": ("subscriptions", _count("subs", "subscription_end_date < subscription_start_date"), _SN, "high"),
    "negative_sessions": ("product_usage", _count("usage", "sessions < 0"), _UN, "high"),
    "feature_adoption_out_of_range": ("product_usage", _count("usage", "feature_adoption_score < 0 OR feature_adoption_score > 100"), _UN, "high"),
    "negative_support_tickets": ("product_usage", _count("usage", "support_tickets < 0"), _UN, "high"),
    "nps_out_of_range": ("product_usage", _count("usage", "nps_score < -100 OR nps_score > 100"), _UN, "high"),
    "signup_date_in_future": ("customers", "(SELECT count(*) FROM customers, snap WHERE signup_date > snapshot_date)", _count("customers"), "medium"),
    "duplicate_payment_id": ("payments", "(SELECT count(*) - count(DISTINCT payment_id) FROM payments)", _count("payments"), "high"),
}
_DQSQL = {n: _dq(t, n, f, d, s) for n, (t, f, d, s) in _DQ.items()}
_DATA = {"raw_customers": "customers", "raw_subscriptions": "subs", "processed_customer_features": "feat", "processed_risk_scores": "scores"}


def _contract(name: str, good: str, evidence: str, dataset: str) -> str:
    return f"SELECT '{dataset}' AS dataset, '{name}' AS check_name, CASE WHEN {good} THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN {good} THEN 'info' ELSE 'blocker' END AS severity, {evidence} AS evidence"


def _contracts(dataset: str, table: str, key: str, missing: list[str] = ()) -> dict[str, str]:
    dup = f"(SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM {table} GROUP BY {key}))"
    null = _count(table, f"{key} IS NULL OR trim(CAST({key} AS VARCHAR)) = ''")
    listed = str(list(missing)).replace("'", "''")
    return {
        "required_columns_present": _contract("required_columns_present", "false" if missing else "true", f"'missing_columns={listed}'", dataset),
        "row_count_nonzero": _contract("row_count_nonzero", f"{_count(table)} > 0", f"'row_count=' || {_count(table)}", dataset),
        "primary_key_not_null": _contract("primary_key_not_null", f"{null} = 0", f"'primary_key={key}; null_rows=' || {null}", dataset),
        "primary_key_unique": _contract("primary_key_unique", f"{dup} = 0", f"'primary_key={key}; duplicate_rows=' || CAST({dup} AS BIGINT)", dataset),
    }


_CON = {ds: _contracts(ds, t, CONTRACTS[ds].primary_key) for ds, t in _DATA.items()}


_DOUBLES = {"features_rate", "segment_rate", "features_value", "segment_value", "max_diff", "tier_share_drift", "priority_drift", "max_customer_diff", "max_revenue_diff"}


def _val(category: str, name: str, good: str, other: str, figures: dict[str, str]) -> str:
    value = lambda k: f"CAST({k} AS DECIMAL(38,6))" if k in _DOUBLES else k
    said = " || '; ' || ".join(f"'{k}=' || CAST({value(k)} AS VARCHAR)" for k in figures)
    inner = ", ".join(f"{e} AS {k}" for k, e in figures.items())
    return f"SELECT '{category}' AS category, '{name}' AS check_name, CASE WHEN {good} THEN 'PASS' ELSE '{other}' END AS status, {said} AS evidence FROM (SELECT {inner})"


def _one(e: str, table: str, where: str = "") -> str:
    return f"(SELECT {e} FROM {table}{' WHERE ' + where if where else ''})"


def _zero(*names: str) -> str:
    return " AND ".join(f"{n} = 0" for n in names)


def _dups(table: str, key: str) -> str:
    return f"(SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM {table} GROUP BY {key}))"


_Q, _M, _I, _B, _G = "Data Quality", "Metric Correctness", "Analytical Integrity", "Dashboard Review", "Governance & Release"
_RUN = "(SELECT count(DISTINCT customer_id) FROM (SELECT customer_id, subscription_start_date AS a, max(coalesce(subscription_end_date, DATE '9999-12-31')) OVER (PARTITION BY customer_id ORDER BY subscription_start_date, subscription_end_date NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {0}) WHERE a <= b)"
_OUT = "(SELECT count(*) FROM usage u WHERE NOT EXISTS (SELECT 1 FROM {0} s WHERE s.customer_id = u.customer_id AND u.usage_date >= s.subscription_start_date AND (s.subscription_end_date IS NULL OR u.usage_date <= s.subscription_end_date)))"
_F = "(SELECT count(*) FROM feat LEFT JOIN subs USING (customer_id) WHERE {0})"
_SPAN = "(SELECT count(*) FROM payments p JOIN (SELECT customer_id, min(subscription_start_date) AS a, max(subscription_end_date) AS b, bool_or(subscription_end_date IS NULL) AS open FROM subs GROUP BY 1) USING (customer_id) WHERE {0})"
_LOST, _RISK = m(f"CASE WHEN {CH} THEN avg_monthly_revenue END"), m(f"CASE WHEN {AR} THEN current_mrr END")
_LAGC = "SELECT cohort_month, (retention_rate > lag(retention_rate) OVER w + 1e-9) AS u1, (revenue_retention > lag(revenue_retention) OVER w + 1e-9) AS u2 FROM cohort WINDOW w AS (PARTITION BY cohort_month ORDER BY observation_month)"
_C0 = "coalesce({0}, 0.0)"
_TM = """(SELECT CAST(coalesce(sum(CASE WHEN abs(c - c2) > 1.1e-6 OR abs(rr - r2) > 1e-4 THEN 1 ELSE 0 END + CASE WHEN n > 0 AND abs(ret - (1 - c)) > 1.1e-6 THEN 1 ELSE 0 END), 0) AS BIGINT)
  FROM (SELECT active_customers_start AS n, coalesce(customer_churn_rate, 0.0) AS c, coalesce(revenue_churn_rate, 0.0) AS rr, coalesce(retention_rate, 0.0) AS ret,
  coalesce(churned_customers / nullif(active_customers_start, 0), 0.0) AS c2, coalesce(CASE WHEN active_mrr_start > 0 THEN churned_mrr / active_mrr_start END, 0.0) AS r2 FROM trend))"""
_KD = "(SELECT {0} FROM (SELECT abs(coalesce(a.churned_customers / nullif(a.active_customers_start, 0), 0.0) - coalesce(b.customer_churn_rate, 0.0)) AS c, abs(coalesce(CASE WHEN a.active_mrr_start > 0 THEN a.churned_mrr / a.active_mrr_start END, 0.0) - coalesce(b.revenue_churn_rate, 0.0)) AS v FROM refold a JOIN trend b USING (month)))"
_SHAPE = " AND ".join(f"{t} BETWEEN {SHAPES[t][0]} AND {SHAPES[t][1]}" + ("" if len(_cols(t)) == SHAPES[t][2] else " AND false") for t in _RAW)
_GUARDS = """(action = 'executive save motion' AND NOT (t = 'critical' AND v >= 70)) OR (action = 'billing intervention' AND NOT (d = 'failed payments' AND c >= 45))
  OR (action = 'renewal conversation' AND NOT (d = 'contract renewal risk' AND (t IN ('medium', 'high', 'critical') OR v >= 85))) OR (action = 'product adoption campaign' AND NOT (d IN ('usage decline', 'low adoption') AND c >= 35))"""
_VAL: dict[str, str] = {
    "row_column_sanity": _val(_Q, "Row/column count sanity", _SHAPE, "WARN", {t: _count(c) for t, c in _RAW.items()}),
    "duplicate_handling": _val(_Q, "Duplicate handling", _zero(*_RAW), "FAIL", {t: _dups(c, CONFIGS[t].key) for t, c in _RAW.items()}),
    "null_handling": _val(_Q, "Null handling", "unexpected_nulls = 0", "WARN", {
        "open": _count("subs", "subscription_end_date IS NULL"), "unexpected_nulls": " + ".join(_count("subs", f"{c} IS NULL") for c, _ in _cols("subscriptions") if c != "subscription_end_date")}),
    "status_consistency": _val(_Q, "Status consistency", _zero("invalid_subscription", "invalid_payment"), "FAIL", {
        "invalid_subscription": _one("count(DISTINCT coalesce(status, ''))", "subs", "status IS NULL OR status NOT IN ('active', 'at_risk', 'churned')"),
        "invalid_payment": _one("count(DISTINCT coalesce(payment_status, ''))", "payments", "payment_status IS NULL OR payment_status NOT IN ('paid', 'failed')")}),
    "impossible_dates": _val(_Q, "Impossible date logic", _zero("end_before_start", "signup_after_start"), "FAIL", {
        "end_before_start": _count("subs", "subscription_end_date < subscription_start_date"), "signup_after_start": "(SELECT count(*) FROM subs JOIN customers USING (customer_id) WHERE signup_date > subscription_start_date)"}),
    "impossible_revenue": _val(_Q, "Impossible revenue values", "not_positive = 0", "FAIL", {"not_positive": _count("subs", "monthly_revenue <= 0")}),
    "overlap_customers": _val(_Q, "Overlapping subscriptions where not expected", "customers = 0", "FAIL", {"customers": _RUN.format("many")}),
    "usage_outside_period": _val(_Q, "Usage dates outside subscription periods", "outside = 0", "WARN", {"outside": _OUT.format("many")}),
    "payment_consistency": _val(_Q, "Payment consistency", _zero("not_positive", "before_start", "after_end"), "WARN", {
        "not_positive": _count("payments", "amount <= 0"), "before_start": _SPAN.format("a IS NULL OR payment_date < a"), "after_end": _SPAN.format("NOT open AND payment_date > b")}),
    "churn_flag_logic": _val(_M, "churn_flag logic", _zero("churn_mismatches", "both_flags"), "FAIL", {
        "churn_mismatches": _F.format("churn_flag <> CASE WHEN status = 'churned' THEN 1 ELSE 0 END"), "both_flags": _count("feat", f"{CH} AND {AR}")}),
    "at_risk_flag_logic": _val(_M, "at_risk_flag logic", "at_risk_mismatches = 0", "FAIL", {"at_risk_mismatches": _F.format("at_risk_flag <> CASE WHEN status = 'at_risk' THEN 1 ELSE 0 END")}),
    "customer_churn_tieout": _val(_M, "Customer churn rate calculation", "abs(features_rate - segment_rate) <= 1e-6", "FAIL", {
        "features_rate": _one(r("sum(churn_flag) / count(*)", 6), "feat"), "segment_rate": _one(r("sum(churned_customers) / sum(active_customers + churned_customers)", 6), "segs")}),
    "revenue_churn_tieout": _val(_M, "Revenue churn rate calculation", "abs(features_value - segment_value) <= 1e-6", "FAIL", {
        "features_value": _one(r(_LOST, 2), "feat"), "segment_value": _one(r(m("churned_revenue"), 2), "bydim", "dimension = 'segment'")}),
    "revenue_at_risk_tieout": _val(_M, "Revenue at risk calculation", "max_diff <= 0.01", "FAIL", {
        "max_diff": f"(SELECT {r('coalesce(max(abs(coalesce(v, 0.0) - revenue_at_risk)), 0.0)', 4)} FROM segs LEFT JOIN (SELECT segment, {_RISK} + {_LOST} AS v FROM feat GROUP BY 1) USING (segment))"}),
    "retention_rate": _val(_M, "Retention rate correctness", _zero("mismatches", "bounds"), "FAIL", {
        "mismatches": _count("cohort", "abs(retention_rate - coalesce(retained_customers / nullif(active_customers, 0), 0.0)) > 1.1e-6"),
        "bounds": _count("cohort", "retained_customers > active_customers OR retention_rate < 0 OR retention_rate > 1")}),
    "trend_metrics": _val(_M, "Monthly trend metric correctness", "inconsistencies = 0", "FAIL", {"inconsistencies": _TM}),
    "cohort_logic": _val(_M, "Cohort logic correctness", _zero("observation_before_cohort", "denominator_varies", "monotonicity_violations"), "WARN", {
        "observation_before_cohort": _count("cohort", "observation_month < cohort_month"),
        "denominator_varies": "(SELECT count(*) FROM (SELECT cohort_month FROM cohort GROUP BY 1 HAVING count(DISTINCT active_customers) > 1))",
        "monotonicity_violations": f"(SELECT count(*) FILTER (WHERE u1) + count(*) FILTER (WHERE u2) FROM ({_LAGC}))"}),
    "join_inflation": _val(_I, "Join inflation risk", " AND ".join(f"{n}_rows = {n}_customers" for n in ("customers", "subscriptions", "features", "risk_scores")), "FAIL", {
        f"{n}_{k}": _one(e, t) for n, t in (("customers", "customers"), ("subscriptions", "subs"), ("features", "feat"), ("risk_scores", "scores")) for k, e in (("rows", "count(*)"), ("customers", "count(DISTINCT customer_id)"))}),
    "incomplete_periods": _val(_I, "Incomplete period comparison risk", "months = 0", "WARN", {
        "months": _count("trend", "active_customers_start < 100"),
        "first_months": "(SELECT coalesce(string_agg(CAST(month AS VARCHAR), ', ' ORDER BY month), '') FROM (SELECT month FROM trend WHERE active_customers_start < 100 ORDER BY month LIMIT 6))"}),
    "denominators": _val(_I, "Denominator correctness", "issues = 0", "FAIL", {
        "issues": _count("bydim", "customers <= 0 OR churned_customers > customers") + " + " + _count("bydim", "abs(churn_rate - coalesce(churned_customers / nullif(customers, 0), 0.0)) > 1.1e-6")}),
    "survivorship": _val(_I, "Survivorship bias risk", "scored = not_churned", "WARN", {"scored": _count("scores"), "not_churned": _count("feat", "churn_flag = 0")}),
    "overclaiming": _val(_I, "Overclaiming risk", "signals_without_lift = 0", "WARN", {"signals_without_lift": _count("rel", "coalesce(churn_rate_lift, 0.0) <= 1.0")}),
    "conclusions_supported": _val(_I, "Conclusions supported by evidence", "missing = 0", "WARN", {
        "missing": "(SELECT count(*) FROM (SELECT v FROM tops UNION ALL SELECT rel FROM strong), findings WHERE section LIKE '3.%' AND NOT contains(result, v))", "named": "(SELECT count(*) + 1 FROM tops)"}),
    "tier_summary_tieout": _val(_G, "Risk tier summary cross-output consistency", "count_diff = 0", "FAIL", {
        "count_diff": "(SELECT CAST(coalesce(sum(abs(coalesce(a.n, 0) - coalesce(b.customers, 0))), 0) AS BIGINT) FROM (SELECT risk_tier, count(*) AS n FROM scores GROUP BY 1) a FULL JOIN tsum b USING (risk_tier))"}),
    "priority_monotone": _val(_G, "Priority ranking monotonicity", "violations = 0", "FAIL", {
        "violations": "(SELECT count(*) FROM (SELECT retention_priority_score AS p, lead(retention_priority_score) OVER (ORDER BY priority_rank) AS q FROM rkd) WHERE q > p + 1e-9)"}),
    "tier_score_monotone": _val(_G, "Risk tier score monotonicity", "violations = 0", "FAIL", {
        "violations": " + ".join(f"(SELECT CASE WHEN avg(retention_priority_score) FILTER (WHERE risk_tier = '{a}') < avg(retention_priority_score) FILTER (WHERE risk_tier = '{b}') - 1e-9 THEN 1 ELSE 0 END FROM scores)" for a, b in zip(TIERS, TIERS[1:]))}),
    "action_rules": _val(_G, "Recommended-action rule consistency", "violations = 0", "FAIL", {
        "violations": f"(SELECT count(*) FROM (SELECT recommended_action AS action, risk_tier AS t, main_risk_driver AS d, churn_risk_score AS c, revenue_risk_score AS v FROM scores) WHERE {_GUARDS})"}),
    "financial_tieout": _val(_G, "Financial tie-out consistency", "max_diff <= 0.01", "FAIL", {
        "max_diff": r(f"greatest(abs((SELECT {_RISK} FROM feat) - (SELECT {m('future_revenue_risk')} FROM segrisk)), abs((SELECT {_RISK} + {_LOST} FROM feat) - (SELECT {m('total_revenue_loss_proxy')} FROM segrisk)))", 4)}),
    "score_drift": _val(_G, "Score stability baseline drift", "tier_share_drift <= 0.03 AND priority_drift <= 3.0", "WARN", {
        "tier_share_drift": "(SELECT " + r("greatest(" + ", ".join(f"abs(count(*) FILTER (WHERE risk_tier = '{t}') / count(*) - {s})" for t, s in BASELINE_SHARES.items()) + ")", 4) + " FROM scores)",
        "priority_drift": f"(SELECT {r(f'abs(avg(retention_priority_score) - {BASELINE_PRIORITY})', 4)} FROM scores)"}),
    "kpi_cube_vs_trend": _val(_B, "Consistency between KPI cards and trend charts", "greatest(" + _KD.format("max(c)") + ", " + _KD.format("max(v)") + ") <= 1.1e-6", "FAIL", {
        "months": _KD.format("count(*)"), "max_customer_diff": _KD.format(r("max(c)", 6)), "max_revenue_diff": _KD.format(r("max(v)", 6))}),
    "cube_has_all_scope": _val(_B, "Risk chart/table logic consistency", "all_scope_rows > 0 AND columns_missing = 0", "FAIL", {
        "all_scope_rows": _count("cube", " AND ".join(f"{d} = '__all__'" for d in (*DIMS, "risk_tier_filter"))), "columns_missing": "0"}),
}
_own = {**_VAL}
_own["overlap_customers"] = _val(_Q, "Overlapping subscriptions where not expected", "customers = 0", "FAIL", {"customers": _RUN.format("subs")})
_own["usage_outside_period"] = _val(_Q, "Usage dates outside subscription periods", "outside = 0", "WARN", {"outside": _OUT.format("subs")})


def _listed(lists: dict) -> str:
    return "(" + ", ".join(f"('{c}', '{n}')" for c, names in lists.items() for n in names) + ")"


_CTES["checks"] = " UNION ALL ".join(_own.values())
_CTES["graded"] = f"""SELECT category, check_name, status,
  CASE WHEN status = 'FAIL' AND (category, check_name) IN {_listed(BLOCKERS)} THEN 'blocker' WHEN status = 'FAIL' THEN 'critical' WHEN status = 'WARN' AND (category, check_name) IN {_listed(MAJOR)} THEN 'major'
  WHEN status = 'WARN' THEN 'minor' ELSE 'info' END AS severity, CASE category {' '.join(f"WHEN '{c}' THEN '{g}'" for c, g in GATES.items())} ELSE 'general' END AS gate_level,
  (category, check_name) IN {_listed(BLOCKERS)} AS is_blocker, evidence FROM checks"""
_CTES["gate"] = """SELECT *, technical = 0 AND blockers = 0 AS tech, technical = 0 AND blockers = 0 AND analytical = 0 AND majors <= 1 AS fine FROM
  (SELECT count(*) FILTER (WHERE status = 'FAIL') AS fails, count(*) FILTER (WHERE status = 'WARN') AS warns, count(*) FILTER (WHERE status = 'FAIL' AND is_blocker) AS blockers, count(*) FILTER (WHERE severity = 'major') AS majors,
  count(*) FILTER (WHERE status = 'FAIL' AND gate_level IN ('technical_validity', 'decision_product_quality')) AS technical, count(*) FILTER (WHERE status = 'FAIL' AND gate_level = 'analytical_validity') AS analytical FROM graded)"""
_STATES = {
    "technically valid": "tech",
    "analytically acceptable": "fine",
    "decision-support only": "fine",
    "screening-grade only": "tech AND NOT fine",
    "not committee-grade": "true",
    "publish-blocked": "blockers > 0 OR fails > 0",
}
_BEST = "CASE WHEN blockers > 0 OR fails > 0 THEN 'publish-blocked' WHEN tech AND NOT fine THEN 'screening-grade only' WHEN fine THEN 'decision-support only' WHEN tech THEN 'technically valid' ELSE 'not committee-grade' END"

_SCOPE = "segment = 'BUILDING' AND region = 'ASIA'"
_RANGE = "BETWEEN DATE '1999-01-01' AND DATE '2001-03-01'"
_SELECTS: dict[str, str] = {
    "typed_tables": "SELECT CAST(payment_id AS VARCHAR) AS payment_id, CAST(customer_id AS VARCHAR) AS customer_id, payment_date, CASE WHEN payment_status = 'failed' THEN NULL ELSE amount END AS amount, payment_status FROM payments",
    "dashboard_accounts": "SELECT * FROM acc ORDER BY retention_priority_score DESC, current_mrr DESC, customer_id LIMIT 800",
    "mart_round_trip": "SELECT customer_id, priority_rank, retention_priority_score, current_mrr, risk_tier, recommended_action FROM rkd",
    "stg_subscriptions_clean": "SELECT * FROM subs WHERE subscription_start_date IS NOT NULL",
    "month_spine": "SELECT month FROM cspine",
    "snapshot_date": "SELECT 'features' AS sources, snapshot_date FROM snap UNION ALL SELECT 'profile', greatest(snapshot_date, (SELECT max(signup_date) FROM customers)) FROM snap UNION ALL SELECT 'trend', snapshot_date FROM subsnap",
    "usage_window_30d": f"SELECT customer_id, recent_sessions_30d, support_tickets_30d, {r('feature_adoption_score_recent', 6)} AS feature_adoption_score_recent, {r('recent_30_avg_sessions', 6)} AS recent_30_avg_sessions FROM uw",
    "usage_window_90d": f"SELECT customer_id, recent_sessions_90d, support_tickets_90d, {r('nps_score_recent', 6)} AS nps_score_recent FROM uw",
    "usage_prior_30d": f"SELECT customer_id, {r('prior_30_avg_sessions', 6)} AS prior_30_avg_sessions FROM uw",
    "usage_trend": "SELECT customer_id, usage_trend FROM uw",
    "next_renewal_date": "SELECT subscription_id, next_renewal_date FROM ren",
    "renewal_near_flag": f"SELECT subscription_id, {i32(iff(chr(115) + 'tatus <> ' + repr('churned') + ' AND next_renewal_date - snapshot_date BETWEEN 0 AND 45'))} AS renewal_near_flag FROM ren",
    "payment_monthly_equivalent": f"SELECT payment_id, cycle_months, {r('me', 4)} AS monthly_equivalent_amount FROM pm",
    "failed_payments_90d": "SELECT customer_id, failed_payments_90d, payment_failure_flag FROM pw",
    "lifetime_revenue": f"SELECT customer_id, {r('lifetime_revenue', 4)} AS lifetime_revenue, {r('avg_monthly_revenue_calc', 4)} AS avg_monthly_revenue_calc FROM pw",
    "contraction_flag": f"SELECT customer_id, {r('recent_paid', 4)} AS recent_paid, {r('prior_paid', 4)} AS prior_paid, contraction_flag FROM pw",
    "customer_retention_features": "SELECT * FROM feat",
    "customer_features_sql": f"""SELECT c.customer_id, {D}, {big("coalesce(b, snapshot_date) - a")} AS tenure_days, s.current_mrr, {r("v", 2)} AS avg_monthly_revenue, {r("CAST(life AS DOUBLE)", 2)} AS lifetime_revenue, n AS failed_payments_90d,
  {i32(iff("n > 0"))} AS payment_failure_flag FROM customers c LEFT JOIN (SELECT customer_id, min(subscription_start_date) AS a, max(subscription_end_date) AS b, max(CASE WHEN status = 'active' THEN monthly_revenue ELSE 0.0 END) AS current_mrr, avg(monthly_revenue) AS v FROM subs GROUP BY 1) s USING (customer_id)
  LEFT JOIN (SELECT customer_id, sum(CAST(CASE WHEN payment_status = 'paid' THEN amount ELSE 0.0 END AS DECIMAL(28,4))) AS life, count(*) FILTER (WHERE payment_status = 'failed' AND payment_date >= snapshot_date - 90) AS n FROM payments, snap GROUP BY 1) p USING (customer_id), snap""",
    "cohort_retention": "SELECT * FROM cohort",
    "segment_retention_summary": "SELECT * FROM segs",
    "cohort_age": f"SELECT cohort_month, observation_month, {i32('cohort_age_months')} AS cohort_age_months FROM aged",
    "cohort_health_6m": "SELECT * FROM health",
    "cohort_curves_sample": f"""SELECT cohort_month, {i32("cohort_age_months")} AS cohort_age_months, retention_rate FROM aged JOIN (SELECT cohort_month, row_number() OVER (ORDER BY cohort_month) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT cohort_month FROM aged)) USING (cohort_month)
  WHERE cohort_age_months BETWEEN 0 AND 18 AND (n <= 10 OR i IN (SELECT k * ((SELECT count(DISTINCT cohort_month) FROM aged) - 1) // 9 FROM range(10) AS x(k)))""",
    "cohort_revenue_matrix": f"""SELECT cohort_month, {', '.join(f"{r(f'avg(revenue_retention) FILTER (WHERE cohort_age_months = {k})', 6)} AS age_{k}" for k in range(13))} FROM aged
  WHERE cohort_month IN (SELECT DISTINCT cohort_month FROM aged ORDER BY 1 DESC LIMIT 18) GROUP BY 1""",
    "cohort_latest_revenue": "SELECT cohort_month, max(observation_month) AS observation_month, arg_max(revenue_retention, observation_month) AS revenue_retention FROM cohort GROUP BY 1 ORDER BY 1 DESC LIMIT 12",
    "cohort_recent_curves": f"SELECT cohort_month, {i32('cohort_age_months')} AS cohort_age_months, retention_rate FROM aged WHERE cohort_month IN (SELECT DISTINCT cohort_month FROM aged ORDER BY 1 DESC LIMIT 8)",
    "cohort_filtered": f"SELECT cohort_month, observation_month, {i32('cohort_age_months')} AS cohort_age_months, active_customers, retained_customers, retention_rate, revenue_retention FROM aged WHERE observation_month {_RANGE}",
    "monthly_retention_trend": "SELECT * FROM trend",
    "monthly_churn_kpis_sql": f"""SELECT month, {big("n")} AS active_customers_start, {r("v", 4)} AS active_mrr_start, {big("cn")} AS churned_customers, {r("cv", 4)} AS churned_mrr, {r("CASE WHEN n = 0 THEN 0.0 ELSE cn / n END", 9)} AS customer_churn_rate,
  {r("CASE WHEN v = 0 THEN 0.0 ELSE cv / v END", 9)} AS revenue_churn_rate FROM t0""",
    "monthly_dimensional_trend": "SELECT * FROM facts",
    "overall_health": "SELECT * FROM overall",
    "churn_slope_last12": "SELECT * FROM slope",
    "trend_rolling3": f"SELECT month, customer_churn_rate, {r('avg(customer_churn_rate) OVER w', 8)} AS customer_churn_rate_3m, revenue_churn_rate, {r('avg(revenue_churn_rate) OVER w', 8)} AS revenue_churn_rate_3m FROM trend WINDOW w AS (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
    "trend_filtered": f"""SELECT *, {r("coalesce(churned_customers / nullif(active_customers_start, 0), 0.0)", 8)} AS customer_churn_rate, {r("coalesce(CASE WHEN active_mrr_start > 0 THEN churned_mrr / active_mrr_start END, 0.0)", 8)} AS revenue_churn_rate,
  {r("coalesce(1 - churned_customers / nullif(active_customers_start, 0), 0.0)", 8)} AS retention_rate FROM (SELECT month, {big("sum(active_customers_start)")} AS active_customers_start, {r(m("active_mrr_start"), 2)} AS active_mrr_start,
  {big("sum(churned_customers)")} AS churned_customers, {r(m("churned_mrr"), 2)} AS churned_mrr FROM facts WHERE {_SCOPE} AND month {_RANGE} GROUP BY 1)""",
    "period_preset": "SELECT * FROM trend ORDER BY month DESC LIMIT 6",
    "kpi_latest_vs_prior": f"""SELECT month, active_customers_start, churned_customers, customer_churn_rate, revenue_churn_rate, active_customers_start - lag(active_customers_start) OVER w AS active_delta,
  {r("(customer_churn_rate - lag(customer_churn_rate) OVER w) * 100", 4)} AS customer_churn_delta_pp, {r("(revenue_churn_rate - lag(revenue_churn_rate) OVER w) * 100", 4)} AS revenue_churn_delta_pp
  FROM trend WINDOW w AS (ORDER BY month) ORDER BY month DESC LIMIT 1""",
    **{f"churn_by_{d}": f"SELECT value AS {d}, customers, churned_customers, churn_rate, churned_revenue, avg_monthly_revenue FROM bydim WHERE dimension = '{d}'" for d in DIMS},
    "churn_by_dimensions": "SELECT * FROM bydim",
    "feature_thresholds": "SELECT * FROM thr",
    "behavioral_relationships": "SELECT * FROM rel",
    "churn_driver_ranking": f"""SELECT driver, n AS impacted_customers, {r("n / everyone", 6)} AS share_of_base, {r("rate", 6)} AS churn_rate, {r("base", 6)} AS baseline_churn_rate, {r("CASE WHEN base > 0 THEN rate / base END", 4)} AS churn_rate_lift,
  {r("value", 2)} AS avg_monthly_revenue, {r("(rate - base) * n * value", 2)} AS estimated_excess_mrr_loss FROM drv0, (SELECT avg(churn_flag) AS base, count(*) AS everyone FROM feat) WHERE n > 0 AND rate > base""",
    "hidden_risk": f"SELECT customer_id, segment, current_mrr FROM ft WHERE {_HIDDEN}",
    "revenue_at_risk_summary": "SELECT * FROM risksum",
    "high_value_at_risk": f"SELECT customer_id, {D}, current_mrr FROM feat, hv WHERE {AR} AND current_mrr >= hv",
    "segment_revenue_risk": "SELECT * FROM segrisk",
    "value_tier_churn_mix": "SELECT * FROM tiers",
    "intervention_priorities": "SELECT * FROM plays",
    "structured_findings": "SELECT * FROM findings",
    "usage_trend_distribution": f"""SELECT churn_flag, count(*) AS customers, {r("max(q1)", 6)} AS q1, {r("max(md)", 6)} AS median, {r("max(q3)", 6)} AS q3, {r("min(usage_trend) FILTER (WHERE usage_trend >= q1 - (q3 - q1) * 1.5)", 6)} AS whisker_low,
  {r("max(usage_trend) FILTER (WHERE usage_trend <= q3 + (q3 - q1) * 1.5)", 6)} AS whisker_high FROM feat JOIN (SELECT churn_flag, quantile_cont(usage_trend, 0.25) AS q1, quantile_cont(usage_trend, 0.5) AS md, quantile_cont(usage_trend, 0.75) AS q3 FROM feat GROUP BY 1) USING (churn_flag) GROUP BY 1""",
    "support_tickets_by_churn": f"SELECT churn_flag, {r('avg(support_tickets_90d)', 6)} AS avg_support_tickets_90d, {r('quantile_cont(support_tickets_90d, 0.75)', 6)} AS p75_support_tickets_90d FROM feat GROUP BY 1",
    "top_n_plus_other": f"""SELECT CASE WHEN n <= 4 OR i < 4 THEN region ELSE 'Other' END AS label, {big("sum(c)")} AS customers, {r("sum(x) / sum(c)", 8)} AS churn_rate
  FROM (SELECT value AS region, customers AS c, churned_customers AS x, row_number() OVER (ORDER BY churn_rate DESC, value) AS i, count(*) OVER () AS n FROM bydim WHERE dimension = 'region') GROUP BY 1""",
    "risk_signals": "SELECT customer_id, " + ", ".join(f"{r(_C[n], 6)} AS {n.lower().replace(' ', '_')}_signal" for n in _S) + " FROM sig",
    "renewal_risk_signal": f"SELECT customer_id, {r('s5', 6)} AS contract_renewal_risk_signal FROM sig",
    "churn_risk_score": "SELECT customer_id, churn_risk_score FROM sc0",
    "percent_rank_avg": f"SELECT customer_id, {r(_rank('current_mrr'), 8)} AS percent_rank FROM feat WHERE churn_flag = 0",
    **{c: f"SELECT customer_id, {c} FROM scores" for c in ("revenue_risk_score", "retention_priority_score", "risk_tier", "main_risk_driver", "recommended_action", "recommendation_context")},
    "customer_risk_scores": "SELECT * FROM scores",
    "risk_priority_ranked": "SELECT customer_id, priority_rank, retention_priority_score, current_mrr FROM rkd",
    "risk_tier_summary": "SELECT * FROM tsum",
    "top_priority_accounts": "SELECT customer_id, retention_priority_score, current_mrr, risk_tier FROM rkd WHERE priority_rank <= 20",
    "risk_driver_distribution": "SELECT main_risk_driver, count(*) AS customers FROM scores GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8",
    "action_playbook_summary": f"""SELECT a AS recommended_action, {i32("k")} AS action_order, count(customer_id) AS customers, {r(m("current_mrr"), 2)} AS current_mrr, {r("coalesce(avg(retention_priority_score), 0.0)", 4)} AS avg_priority_score,
  coalesce((SELECT segment FROM scores WHERE recommended_action = a AND segment IS NOT NULL GROUP BY segment HAVING sum(current_mrr) > 0 ORDER BY sum(CAST(current_mrr AS DECIMAL(28,4))) DESC, segment DESC LIMIT 1), 'n/a') AS top_segment
  FROM (VALUES {', '.join(f"('{a}', {k})" for k, a in enumerate(ACTIONS))}) AS x(a, k) LEFT JOIN scores ON recommended_action = a GROUP BY a, k""",
    "risk_revenue_by_segment": f"SELECT segment, {r(m(f'CASE WHEN {AR} OR risk_tier IN ' + str(('high', 'critical')) + ' THEN current_mrr END'), 2)} AS revenue_at_risk FROM scores GROUP BY 1",
    "executive_scope_summary": f"""SELECT (SELECT v FROM tops WHERE dimension = 'segment') AS top_segment, (SELECT c FROM tops WHERE dimension = 'segment') AS top_segment_churn_rate,
  (SELECT arg_max(customer_churn_rate, month) FROM trend) AS latest_customer_churn_rate, (SELECT arg_max(revenue_churn_rate, month) FROM trend) AS latest_revenue_churn_rate, count(*) AS scored_customers,
  {r("count(*) FILTER (WHERE risk_tier IN ('high', 'critical')) / count(*)", 8)} AS high_critical_share, {r(m("CASE WHEN risk_tier IN ('high', 'critical') THEN current_mrr END") + " / " + m("current_mrr"), 8)} AS high_critical_mrr_share,
  {r("coalesce(count(*) FILTER (WHERE risk_tier IN ('high', 'critical') AND usage_trend < 0) / nullif(count(*) FILTER (WHERE risk_tier IN ('high', 'critical')), 0), 0.0)", 8)} AS usage_decline_share FROM scores""",
    "diagnostic_means": f"""SELECT churn_flag, {big("sum(customer_count)")} AS customers, {r("sum(usage_sum) / sum(customer_count)", 6)} AS avg_usage_trend, {r("sum(support_sum) / sum(customer_count)", 6)} AS avg_support_tickets,
  {r("sum(nps_sum) / sum(customer_count)", 6)} AS avg_nps, {r("sum(payment_failure_sum) / sum(customer_count)", 6)} AS failed_payment_incidence FROM cells GROUP BY 1""",
    "snapshot_enriched": f"SELECT customer_id, {D}, churn_flag, current_mrr, risk_tier, main_risk_driver, recommended_action FROM enr",
    "snapshot_agg": "SELECT * FROM cells",
    "scored_accounts": "SELECT * FROM acc",
    "risk_kpi_cube": "SELECT * FROM cube",
    "risk_kpi_lookup": f"""SELECT {', '.join(f"CAST(coalesce(max({c}), 0) AS BIGINT) AS {c}" for c in ("scored_customers", "high_risk_customers", "critical_customers"))}, {', '.join(f"coalesce(max({c}), 0.0) AS {c}" for c in ("total_current_mrr", "revenue_at_risk", "avg_priority_score"))}
  FROM cube WHERE {_SCOPE} AND acquisition_channel = '__all__' AND plan_type = '__all__' AND risk_tier_filter = '__all__'""",
    "dimension_domains": " UNION ALL ".join(f"SELECT DISTINCT '{d}' AS dimension, {d} AS value FROM feat WHERE {d} IS NOT NULL" for d in DIMS) + " UNION ALL " + " UNION ALL ".join(f"SELECT 'risk_tier', '{t}'" for t in (*TIERS, "churned")),
    "monthly_fact_encoded": f"SELECT {', '.join(f'{i32(f'dense_rank() OVER (ORDER BY {c}) - 1')} AS {c}_index' for c in ('month', *DIMS))}, active_customers_start, active_mrr_start, churned_customers, churned_mrr FROM facts",
    "snapshot_filtered": f"SELECT * FROM cells WHERE {_SCOPE} AND risk_tier = 'low'",
    "scored_filtered": f"SELECT * FROM acc WHERE {_SCOPE} AND risk_tier = 'medium'",
    "priority_table_sorted": "SELECT customer_id, churn_risk_score, current_mrr FROM acc ORDER BY churn_risk_score DESC, customer_id LIMIT 300",
    "tier_distribution": f"SELECT risk_tier, {i32(f'list_position([{', '.join(repr(t) for t in TIERS)}], risk_tier)')} AS tier_order, count(*) AS customers, {r('count(*) / (SELECT count(*) FROM acc)', 8)} AS share FROM acc GROUP BY 1",
    "table_profile": " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, '{CONFIGS[t].grain}' AS grain, {_count(c)} AS row_count, {i32(str(len(_cols(t))))} AS column_count, '{CONFIGS[t].key}' AS candidate_primary_key,
  {_count(c, CONFIGS[t].key + ' IS NULL')} = 0 AND {_dups(c, CONFIGS[t].key)} = 0 AS candidate_pk_valid, {_count(c, CONFIGS[t].key + ' IS NULL')} AS candidate_pk_nulls, {_dups(c, CONFIGS[t].key)} AS candidate_pk_duplicates,
  {_dups(c, 'ALL')} AS duplicate_row_count""".replace("(SELECT count(*) AS n FROM " + c + " GROUP BY ALL)", f"(SELECT {', '.join(x for x, _ in _cols(t))}, count(*) AS n FROM {c} GROUP BY ALL)")
        for t, c in _RAW.items()
    ),
    "column_profile": "SELECT * FROM colprof",
    "dimension_cardinality": "SELECT table_name, column_name AS dimension, distinct_count AS cardinality FROM colprof WHERE " + " OR ".join(f"(table_name = '{t}' AND column_name = '{c}')" for t, cfg in CONFIGS.items() for c in cfg.dimension),
    "date_coverage": " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS date_field, min({c}) AS min_date, max({c}) AS max_date, {big(f'max({c}) - min({c})')} AS coverage_days FROM {_RAW[t]}" for t, cfg in CONFIGS.items() for c in cfg.temporal),
    "column_classification": "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{c}', '{k}')" for t, c, k in sorted({(t, c, k) for t, cfg in CONFIGS.items() for c, k in cfg.listed()})) + ") AS x(table_name, column_name, classification)",
    "suspicious_values": f"""SELECT 'subscriptions' AS table_name, 'extreme_high_monthly_revenue' AS issue, count(*) FILTER (WHERE monthly_revenue > t) AS affected_rows, {r("max(t)", 4)} AS threshold FROM subs, (SELECT quantile_cont(monthly_revenue, 0.995) * 2.0 AS t FROM subs)
  UNION ALL SELECT 'product_usage', 'zero_session_events', {_count("usage", "sessions = 0")}, NULL UNION ALL SELECT 'payments', 'failed_payment_events', {_count("payments", "payment_status = 'failed'")}, NULL""",
    **{f"dq_{n}": q for n, q in _DQSQL.items()},
    "dq_overlapping_subscriptions": _dq("subscriptions", "overlapping_subscriptions", _LAGGED.format("many"), "(SELECT count(DISTINCT customer_id) FROM many)", "high"),
    "quality_checks": " UNION ALL ".join(_DQSQL.values()),
    **{f"contract_{k}": " UNION ALL ".join(c[n] for c in _CON.values()) for k, n in (("row_count_nonzero", "row_count_nonzero"), ("pk_not_null", "primary_key_not_null"), ("pk_unique", "primary_key_unique"))},
    "contract_checks": " UNION ALL ".join(q for c in _CON.values() for q in c.values()),
    "contract_issues": "SELECT * FROM (" + " UNION ALL ".join(_contracts("raw_usage", "usage", "usage_id", ["channel"]).values()) + ") WHERE status <> 'PASS'",
    **{f"val_{k}": q for k, q in _VAL.items()},
    "check_severity": "SELECT category, check_name, status, severity, gate_level, is_blocker FROM graded",
    "release_matrix": " UNION ALL ".join(f"SELECT '{s}' AS state, {c} AS active, {_BEST} AS recommended_state FROM gate" for s, c in _STATES.items()),
    "validation_issues": "SELECT category, check_name, severity, gate_level, is_blocker, status, 'No (validation-only scope)' AS fix_applied FROM graded WHERE status IN ('FAIL', 'WARN')",
    "validation_summary": """SELECT count(*) AS checks, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'WARN') AS warned, count(*) FILTER (WHERE status = 'FAIL') AS failed,
  CASE WHEN count(*) FILTER (WHERE status = 'FAIL') > 0 THEN 'Needs revision' WHEN count(*) FILTER (WHERE status = 'WARN') > 0 THEN 'Share with caveats' ELSE 'Ready to share' END AS confidence FROM graded""",
}


def _needs(sql: str) -> set[str]:
    """Names of the common tables that a query reads, directly or through others."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        for w in set(re.findall(r"\w+", todo.pop())) & _CTES.keys() - found:
            found.add(w)
            todo.append(_CTES[w])
    return found


def _whole(sql: str) -> str:
    used = _needs(sql)
    if not used:
        return sql
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in _CTES.items() if n in used) + "\n" + sql


ORACLES = {k: _whole(q) for k, q in _SELECTS.items()}
