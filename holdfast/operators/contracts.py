"""Contracts of datasets: required columns, rows, and keys."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import exists


@dataclass(frozen=True)
class Contract:
    primary_key: str
    required: tuple[str, ...]
    #: where the dataset is, for contracts that are read from a file
    path: str = ""


# The contracts of the raw and processed tables.
CONTRACTS = {
    "raw_customers": Contract("customer_id", ("customer_id", "signup_date", "segment", "region", "acquisition_channel", "plan_type")),
    "raw_subscriptions": Contract(
        "subscription_id",
        ("subscription_id", "customer_id", "subscription_start_date", "subscription_end_date", "monthly_revenue", "contract_type", "billing_cycle", "status"),
    ),
    "processed_customer_features": Contract(
        "customer_id",
        ("customer_id", "churn_flag", "at_risk_flag", "current_mrr", "avg_monthly_revenue", "usage_trend", "support_tickets_90d", "nps_score_recent", "payment_failure_flag"),
    ),
    "processed_risk_scores": Contract(
        "customer_id",
        ("customer_id", "churn_risk_score", "revenue_risk_score", "retention_priority_score", "risk_tier", "main_risk_driver", "recommended_action"),
    ),
}


# The names and evidence texts of the checks below.


def _check(name: str, good: Column, evidence: Column) -> Column:
    return F.struct(
        F.lit(name).alias("check_name"),
        F.when(good, "PASS").otherwise("FAIL").alias("status"),
        F.when(good, "info").otherwise("blocker").alias("severity"),
        evidence.alias("evidence"),
    )


def _said(label: str, c: Column | str) -> Column:
    return F.concat(F.lit(label), F.col(c).cast("string") if isinstance(c, str) else c)


def contract_checks(dataset: str, df: DataFrame, contract: Contract) -> DataFrame:
    """All checks of one dataset from one count by key. Only columns and schema are read on the driver."""
    key = contract.primary_key
    missing = sorted(set(contract.required) - set(df.columns))
    counts = df.agg(F.count("*").alias("n"))
    checks = [
        _check("required_columns_present", F.lit(not missing), F.lit(f"missing_columns={missing}")),
        _check("row_count_nonzero", F.col("n") > 0, _said("row_count=", "n")),
    ]
    if key and key in df.columns:
        blank = F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")
        counts = df.groupBy(key).agg(F.count("*").alias("many")).agg(
            *[F.coalesce(F.sum(x), F.lit(0)).alias(name) for name, x in (("n", F.col("many")), ("blank", F.when(blank, F.col("many"))), ("repeats", F.col("many") - 1))]
        )
        checks += [
            _check("primary_key_not_null", F.col("blank") == 0, _said(f"primary_key={key}; null_rows=", "blank")),
            _check("primary_key_unique", F.col("repeats") == 0, _said(f"primary_key={key}; duplicate_rows=", "repeats")),
        ]
    else:
        checks.append(_check("primary_key_declared_and_present", F.lit(False), F.lit(f"primary_key={key}; available_columns={df.columns}")))
    return counts.select(F.lit(dataset).alias("dataset"), F.explode(F.array(*checks)).alias("c")).select("dataset", "c.*")


def all_contracts(datasets: dict[str, DataFrame], contracts: dict[str, Contract] = CONTRACTS) -> DataFrame:
    return reduce(DataFrame.unionByName, [contract_checks(n, datasets[n], c) for n, c in contracts.items()])


def read_contracts(spark: SparkSession, path: str) -> dict[str, Contract]:
    """Contracts by dataset from a JSON file: ``{"datasets": {name: {"path", "primary_key", "required_columns"}}}``."""
    said = json.loads(spark.read.text(path, wholetext=True).first().value).get("datasets", {})
    return {n: Contract(str(c.get("primary_key", "")), tuple(map(str, c.get("required_columns", ()))), str(c.get("path", ""))) for n, c in said.items()}


def check_files(spark: SparkSession, root: str, contracts: dict[str, Contract]) -> DataFrame:
    """Checks of datasets at their contracts' paths below a root; one that isn't there fails ``dataset_exists`` and has no others.

    Paths that end in ``.csv`` have a header line; ``.json`` has a row a line; others are Parquet.
    """
    found = []
    for name, c in contracts.items():
        path = f"{root.rstrip('/')}/{c.path}"
        there = bool(c.path) and exists(spark, path)
        check = _check("dataset_exists", F.lit(there), F.lit(f"path={c.path}; exists={there}"))
        found.append(spark.range(1).select(F.lit(name).alias("dataset"), F.inline(F.array(check))))
        if there:
            df = spark.read.csv(path, header=True) if path.endswith(".csv") else spark.read.json(path) if path.endswith(".json") else spark.read.parquet(path)
            found.append(contract_checks(name, df, c))
    return reduce(DataFrame.unionByName, found)


def issues(checks: DataFrame) -> DataFrame:
    return checks.where("status <> 'PASS'")
