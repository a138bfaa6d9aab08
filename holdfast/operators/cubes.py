"""Pre-aggregated cells for reports, and the filters that read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import flag, money, rnd, share
from ..params import ALL, DIMS, TIERS
from .risk import exposed_mrr

_RISK = ("churn_risk_score", "revenue_risk_score", "retention_priority_score", "risk_tier", "main_risk_driver", "recommended_action")

ACCOUNT_COLUMNS = ["customer_id", *DIMS, "current_mrr", "at_risk_flag", "usage_trend", "support_tickets_90d", "nps_score_recent", "payment_failure_flag", *_RISK]


def snapshot_enriched(features: DataFrame, scores: DataFrame) -> DataFrame:
    """All customers with their scores; who has none is churned, or low where not churned."""
    rows = features.join(scores.select("customer_id", *_RISK).hint("merge"), "customer_id", "left")
    return rows.withColumns(
        {
            "risk_tier": F.coalesce("risk_tier", F.when(F.col("churn_flag") == 1, "churned").otherwise("low")),
            "main_risk_driver": F.coalesce("main_risk_driver", F.lit("historical churn")),
            "recommended_action": F.coalesce("recommended_action", F.lit("monitor only")),
        }
    )


def snapshot_cells(snapshot: DataFrame) -> DataFrame:
    """Additive sums by dimensions, tier and churn."""
    exact = lambda c, d: rnd(money(c), d)
    return snapshot.dropna(subset=list(DIMS)).groupBy(*DIMS, "risk_tier", "churn_flag").agg(
        F.count("*").alias("customer_count"),
        exact("current_mrr", 2).alias("current_mrr_sum"),
        exact("usage_trend", 4).alias("usage_sum"),
        F.sum("support_tickets_90d").alias("support_sum"),
        exact("nps_score_recent", 4).alias("nps_sum"),
        F.sum("payment_failure_flag").cast("bigint").alias("payment_failure_sum"),
        F.sum(flag(F.col("usage_trend") < 0)).alias("usage_decline_count"),
        exact(F.when(F.col("at_risk_flag") == 1, F.col("current_mrr")), 2).alias("at_risk_mrr_component"),
        exact(F.when(F.col("churn_flag") == 1, F.col("avg_monthly_revenue")), 2).alias("churned_revenue_component"),
    )


def scored_accounts(snapshot: DataFrame) -> DataFrame:
    two = {"current_mrr", "usage_trend", "nps_score_recent", *_RISK[:3]}
    return snapshot.where("churn_flag = 0").select(*[rnd(c, 2).alias(c) if c in two else F.col(c) for c in ACCOUNT_COLUMNS])


def _finest(accounts: DataFrame) -> DataFrame:
    """Exact sums by all dimensions and the tier, which the cube expands in place of accounts."""
    keys = [*DIMS, "risk_tier"]
    high = F.col("risk_tier").isin("high", "critical")
    rows = accounts.dropna(subset=keys).withColumns({"mrr": F.col("current_mrr"), "exposed": exposed_mrr(), "high": flag(high), "critical": flag(F.col("risk_tier") == "critical")})
    cents = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(28,4)")), F.lit(0).cast("decimal(28,4)"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), cents("mrr").alias("mrr"), cents("exposed").alias("exposed"), F.sum("high").alias("high"), F.sum("critical").alias("critical"),
        cents("retention_priority_score").alias("priority"),
    )


def _measures() -> list[Column]:
    total = lambda c: rnd(F.sum(c).cast("double"), 2)
    return [
        F.sum("n").alias("scored_customers"),
        total("mrr").alias("total_current_mrr"),
        total("exposed").alias("revenue_at_risk"),
        F.sum("high").alias("high_risk_customers"),
        F.sum("critical").alias("critical_customers"),
        total("priority").alias("priority_sum"),
    ]


def _average() -> Column:
    return rnd(F.col("priority_sum") / F.col("scored_customers"), 2).alias("avg_priority_score")


def risk_kpi_cube(accounts: DataFrame) -> DataFrame:
    """Every combination of the dimensions and the tier, or all of any of them."""
    keys = [*DIMS, "risk_tier"]
    cells = _finest(accounts).cube(*keys).agg(*[F.grouping(k).alias(f"all_{k}") for k in keys], *_measures())
    name = lambda k: F.when(F.col(f"all_{k}") == 1, ALL).otherwise(F.col(k))
    return cells.select(
        *[name(k).alias(k) for k in DIMS],
        name("risk_tier").alias("risk_tier_filter"),
        "scored_customers", "total_current_mrr", "revenue_at_risk", "high_risk_customers", "critical_customers", "priority_sum", _average(),
    )


def kpi_cell(accounts: DataFrame, filters: dict[str, str] | None = None, risk_tier: str = ALL) -> DataFrame:
    """``kpi_lookup`` from the accounts: of all the cube's grouping sets only the scope's own, as a filter on them."""
    cell = _finest(scoped(accounts, filters, risk_tier)).agg(*_measures()).withColumn("avg_priority_score", _average())
    return _or_zeros(cell)


def kpi_lookup(cube: DataFrame, filters: dict[str, str] | None = None, risk_tier: str = ALL) -> DataFrame:
    """The cell of a scope in a cube that is at hand; one row of zeros if there is none."""
    wanted = {d: (filters or {}).get(d, ALL) for d in DIMS} | {"risk_tier_filter": risk_tier}
    rows = cube
    for k, v in wanted.items():
        rows = rows.where(F.col(k) == (ALL if v == "all" else v))
    return _or_zeros(rows)


def _or_zeros(rows: DataFrame) -> DataFrame:
    n, m = ("scored_customers", "high_risk_customers", "critical_customers"), ("total_current_mrr", "revenue_at_risk", "avg_priority_score")
    return rows.agg(*[F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias(c) for c in n], *[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in m])


def dimension_domains(features: DataFrame) -> DataFrame:
    """Distinct values of each dimension, and the tiers."""
    spark = features.sparkSession
    listed = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in DIMS])
    found = features.select(F.explode(listed).alias("e")).select("e.*").where("value is not null").distinct()
    tiers = spark.createDataFrame([("risk_tier", t) for t in (*TIERS, "churned")], "dimension string, value string")
    return found.unionByName(tiers)


def monthly_fact_encoded(facts: DataFrame) -> DataFrame:
    """Monthly facts with months and values as places in their sorted domains, which have few rows."""
    rows = facts
    for c in ("month", *DIMS):
        domain = facts.select(c).where(F.col(c).isNotNull()).distinct().withColumn(f"{c}_index", (F.dense_rank().over(Window.orderBy(c)) - 1).cast("int"))
        rows = rows.join(domain, c)
    return rows.select(*[f"{c}_index" for c in ("month", *DIMS)], "active_customers_start", "active_mrr_start", "churned_customers", "churned_mrr")


def scoped(rows: DataFrame, filters: dict[str, str] | None = None, risk_tier: str | None = None) -> DataFrame:
    """Rows of a scope, of snapshot cells or of accounts."""
    for k, v in {**(filters or {}), "risk_tier": risk_tier}.items():
        if v not in (None, "all", ALL):
            rows = rows.where(F.col(k) == v)
    return rows


def sorted_accounts(accounts: DataFrame, by: str, falling: bool = True, n: int = 300) -> DataFrame:
    return accounts.orderBy(F.desc_nulls_last(by) if falling else F.asc_nulls_first(by), "customer_id").limit(n)


def tier_distribution(accounts: DataFrame) -> DataFrame:
    rows = accounts.groupBy(F.coalesce("risk_tier", F.lit("low")).alias("risk_tier")).agg(F.count("*").alias("customers"))
    total = rows.agg(F.sum("customers").alias("_all"))
    place = F.array_position(F.array(*map(F.lit, TIERS)), F.col("risk_tier")).cast("int")
    return rows.crossJoin(F.broadcast(total)).select("risk_tier", place.alias("tier_order"), "customers", rnd(share(F.col("customers"), F.col("_all")), 8).alias("share"))
