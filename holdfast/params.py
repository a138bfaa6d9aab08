"""Thresholds and fixed lists of the retention model, in one place."""

# Domains, weights, limits and names that results depend on.
DIMS = ("segment", "region", "acquisition_channel", "plan_type")
STATUSES = ("active", "at_risk", "churned")
PAYMENT_STATUSES = ("paid", "failed")
CONTRACTS = ("Annual", "Monthly")
CYCLE_MONTHS = {"Monthly": 1, "Quarterly": 3, "Annual": 12}
TIERS = ("critical", "high", "medium", "low")
ALL = "__all__"

RENEWAL_NEAR_DAYS = 45
CONTRACTION_SHARE = 0.85
MIN_TREND_BASE = 100
DASHBOARD_ACCOUNTS = 800
COHORT_TREND_STEP = 0.02

# Divisors and offsets of the signals, and their weights in the order that ties are broken by.
WEIGHTS = {
    "usage decline": 0.24,
    "failed payments": 0.22,
    "support burden": 0.16,
    "low NPS": 0.18,
    "low adoption": 0.14,
    "contract renewal risk": 0.06,
}
CONTRACTION_POINTS, DORMANCY_POINTS = 8.0, 6.0
CHURN_SHARE, REVENUE_SHARE = 0.65, 0.35
RANK_WEIGHTS = {"current_mrr": 0.60, "avg_monthly_revenue": 0.30, "lifetime_revenue": 0.10}

ACTIONS = (
    "billing intervention",
    "customer success outreach",
    "product adoption campaign",
    "renewal conversation",
    "executive save motion",
    "monitor only",
)

# Score baseline of the drift check.
BASELINE_SHARES = {"critical": 0.0, "high": 0.005889281507656066, "medium": 0.20926580290537888, "low": 0.784844915586965}
BASELINE_PRIORITY = 31.805206124852763
MAX_TIER_DRIFT, MAX_PRIORITY_DRIFT = 0.03, 3.0

# Plausible shapes: rows from, rows to, columns.
SHAPES = {
    "customers": (3500, 3500, 6),
    "subscriptions": (3500, 3500, 8),
    "product_usage": (200_000, 900_000, 7),
    "payments": (20_000, 90_000, 5),
}
