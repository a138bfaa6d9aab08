"""From checks to a release state."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import count_if
from .validate import DASHBOARD, INTEGRITY, METRIC, QUALITY

# Checks whose failure blocks, checks whose warning is major, and the categories' gates.
BLOCKERS = {
    QUALITY: ("Duplicate handling", "Status consistency", "Impossible date logic", "Overlapping subscriptions where not expected"),
    METRIC: ("churn_flag logic", "at_risk_flag logic", "Customer churn rate calculation", "Revenue churn rate calculation", "Monthly trend metric correctness"),
    INTEGRITY: ("Join inflation risk", "Denominator correctness"),
    DASHBOARD: ("Governed data-source usage", "Dashboard payload integrity", "Consistency between KPI cards and trend charts", "Version stamping and traceability"),
}
MAJOR = {
    QUALITY: ("Usage dates outside subscription periods", "Payment consistency"),
    METRIC: ("Cohort logic correctness",),
    INTEGRITY: ("Incomplete period comparison risk", "Survivorship bias risk", "Overclaiming risk"),
    DASHBOARD: ("Filtered vs aggregated output consistency", "Responsive/layout safety", "Payload size/performance sanity"),
}
GATES = {
    QUALITY: "technical_validity",
    METRIC: "analytical_validity",
    INTEGRITY: "analytical_validity",
    "Visualization Review": "communication_quality",
    DASHBOARD: "decision_product_quality",
}


@dataclass(frozen=True)
class Policy:
    """How many major warnings a release may have, and whether synthetic data may be committee-grade."""

    major_acceptable: int = 1
    #: for decision support; None: as for acceptance
    major_decision_support: int | None = None
    synthetic_committee_grade: bool = False


# The keys of a policy file.
POLICY_KEYS = {
    "major_acceptable": "major_warn_threshold_for_analytical_acceptance",
    "major_decision_support": "major_warn_threshold_for_decision_support",
    "synthetic_committee_grade": "committee_grade_allowed",
}


def read_policy(spark: SparkSession, path: str) -> Policy:
    """A policy from a YAML or JSON file, wherever in it the keys stand; missing keys keep their default, other values are an error."""
    text, said = spark.read.text(path, wholetext=True).first().value, {}
    for field, key in POLICY_KEYS.items():
        if found := re.search(rf"^[\s{{,]*[\"']?{key}[\"']?\s*:\s*([^\s,}}#]+)", text, re.MULTILINE):
            value = found[1].strip("\"'").lower()
            if not re.fullmatch(r"true|false" if field == "synthetic_committee_grade" else r"\d+", value):
                raise ValueError(f"{key} can't be {value}")
            said[field] = value == "true" if field == "synthetic_committee_grade" else int(value)
    return Policy(**said)


def _listed(lists: dict[str, tuple[str, ...]]) -> Column:
    return F.concat_ws("|", "category", "check_name").isin([f"{c}|{n}" for c, names in lists.items() for n in names])


def with_severity(checks: DataFrame) -> DataFrame:
    """Checks with their severity, gate level and whether they block."""
    status, blocks = F.col("status"), _listed(BLOCKERS)
    severity = F.when((status == "FAIL") & blocks, "blocker").when(status == "FAIL", "critical").when((status == "WARN") & _listed(MAJOR), "major").when(status == "WARN", "minor").otherwise("info")
    gate = F.coalesce(F.create_map(*[F.lit(x) for kv in GATES.items() for x in kv])[F.col("category")], F.lit("general"))
    return checks.select("category", "check_name", "status", severity.alias("severity"), gate.alias("gate_level"), blocks.alias("is_blocker"), "evidence")


def issues(graded: DataFrame) -> DataFrame:
    return graded.where(F.col("status").isin("FAIL", "WARN")).withColumn("fix_applied", F.lit("No (validation-only scope)"))


def summary(graded: DataFrame) -> DataFrame:
    n = lambda s: count_if(F.col("status") == s)
    one = graded.agg(F.count("*").alias("checks"), n("PASS").alias("passed"), n("WARN").alias("warned"), n("FAIL").alias("failed"))
    label = F.when(F.col("failed") > 0, "Needs revision").when(F.col("warned") > 0, "Share with caveats").otherwise("Ready to share")
    return one.withColumn("confidence", label)


def release_matrix(graded: DataFrame, synthetic_data: bool = True, policy: Policy = Policy()) -> DataFrame:
    """Six states, each active or not under a policy, and the recommended one."""
    fail, warn = F.col("status") == "FAIL", F.col("status") == "WARN"
    one = graded.agg(
        count_if(fail).alias("fails"),
        count_if(warn).alias("warns"),
        count_if(fail & F.col("is_blocker")).alias("blockers"),
        count_if(F.col("severity") == "major").alias("majors"),
        count_if(fail & F.col("gate_level").isin("technical_validity", "decision_product_quality")).alias("technical"),
        count_if(fail & (F.col("gate_level") == "analytical_validity")).alias("analytical"),
    )
    synthetic = F.lit(synthetic_data)
    supported = policy.major_acceptable if policy.major_decision_support is None else policy.major_decision_support
    one = one.withColumn("tech", (F.col("technical") == 0) & (F.col("blockers") == 0))
    sound = F.col("tech") & (F.col("analytical") == 0)
    one = one.withColumn("fine", sound & (F.col("majors") <= policy.major_acceptable))
    states = {
        "technically valid": F.col("tech"),
        "analytically acceptable": F.col("fine"),
        "decision-support only": sound & (F.col("majors") <= supported) & ((F.col("warns") > 0) | synthetic),
        "screening-grade only": F.col("tech") & ~F.col("fine"),
        "not committee-grade": F.lit(synthetic_data and not policy.synthetic_committee_grade) | (F.col("warns") > 0),
        "publish-blocked": (F.col("blockers") > 0) | (F.col("fails") > 0),
    }
    best = F.lit("not committee-grade")
    for name in ("technically valid", "analytically acceptable", "decision-support only", "screening-grade only", "publish-blocked"):
        best = F.when(states[name], name).otherwise(best)
    listed = F.array(*[F.struct(F.lit(n).alias("state"), c.alias("active")) for n, c in states.items()])
    return one.select(F.explode(listed).alias("s"), best.alias("recommended_state")).select("s.state", "s.active", "recommended_state")
