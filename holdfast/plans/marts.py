"""The chain from raw tables to marts, each mart a lazy property."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..operators import cohorts, contracts, cubes, drivers, features, profile, quality, release, risk, trend, validate
from ..params import DASHBOARD_ACCOUNTS, DIMS
from ..sources import tables as sources
from ..sources.binding import Star


def _checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written down and cut from its plan. Its shuffles have as many parts as their rows are worth, and so has it."""
    sources.shared_folder(df.sparkSession)
    return df.checkpoint()


class Marts:
    """Marts over one set of raw tables.

    With ``shared`` the marts that others read are kept (in memory and on disk) once they
    are computed, so that a report over many of them plans and runs each once; without it
    every mart is its own plan. With ``cut`` the marts that many others are made from are
    written as checkpoints when they are first asked for, so that what reads them is planned
    without what they were made of, and its tasks don't carry it. ``release`` gives the kept ones back.
    """

    def __init__(self, customers: DataFrame, subscriptions: DataFrame, usage: DataFrame, payments: DataFrame, shared: bool = False, many: Callable[[], DataFrame] | None = None, recent: Callable[[DataFrame], DataFrame] | None = None, cut: bool = False):
        self._customers, self.subscriptions, self.usage, self.payments, self.shared, self.cut = customers, subscriptions, usage, payments, shared, cut
        self._many, self._recent = many, recent
        self._star: Star | None = None
        self._kept: list[DataFrame] = []

    @classmethod
    def of_star(cls, spark: SparkSession, folder: str, shared: bool = False, cut: bool = False) -> Marts:
        s = Star(spark, folder, ahead=cut)
        if cut:
            s.owners = _checkpoint(s.owners)
        out = cls(s.customers(), s.subscriptions(), s.usage(), s.payments(), shared, s.subscriptions_multi, s.recent_usage, cut)
        out._star = s
        if not cut:
            out.subscriptions = out._keep(out.subscriptions)
            out._kept.append(s.last_day)
        return out

    @classmethod
    def of_raw(cls, spark: SparkSession, folder: str, form: str = "parquet", shared: bool = True) -> Marts:
        """Raw tables of a folder; usage that is laid out by month (``sources.write_usage``) is read from the months that its windows reach."""
        recent = (lambda snapshot: sources.recent_usage(spark, folder, snapshot)) if sources.exists(spark, f"{folder}/{sources.USAGE_BY_MONTH}") else None
        return cls(*[sources.load(spark, folder, n, form) for n in ("customers", "subscriptions", "product_usage", "payments")], shared, recent=recent)

    def _keep(self, df: DataFrame) -> DataFrame:
        if not self.shared:
            return df
        self._kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self._kept[-1]

    def _base(self, df: DataFrame) -> DataFrame:
        """A table or mart that others are made from."""
        return _checkpoint(df) if self.cut else self._keep(df)

    def release(self) -> None:
        while self._kept:
            self._kept.pop().unpersist()

    @cached_property
    def customers(self) -> DataFrame:
        return self._base(self._customers) if self._star else self._customers

    @cached_property
    def many(self) -> DataFrame:
        """Several subscriptions a customer, for the checks that look for overlaps."""
        return self._many() if self._many else self.subscriptions

    @property
    def raw(self) -> dict[str, DataFrame]:
        return {"customers": self.customers, "subscriptions": self.subscriptions, "product_usage": self.usage, "payments": self.payments}

    @cached_property
    def snapshot(self) -> DataFrame:
        if self._star and self.cut:
            return self._star.snapshot
        s = self.subscriptions
        days = features.snapshot_date((s, "subscription_start_date"), (s, "subscription_end_date"), (self.payments, "payment_date"), last=(self.usage, "usage_date"))
        self._kept.append(days.persist())  # one row
        return days

    @cached_property
    def profile_snapshot(self) -> DataFrame:
        s = self.subscriptions
        return features.snapshot_date(
            (self.customers, "signup_date"), (s, "subscription_start_date"), (s, "subscription_end_date"), (self.payments, "payment_date"), last=(self.usage, "usage_date")
        )

    @cached_property
    def subscription_snapshot(self) -> DataFrame:
        self._kept.append(features.snapshot_date((self.subscriptions, "subscription_start_date"), (self.subscriptions, "subscription_end_date")).persist())
        return self._kept[-1]

    @cached_property
    def recent_usage(self) -> DataFrame:
        """Usage that the windows up to the snapshot may need."""
        return self._recent(self.snapshot) if self._recent else self.usage

    @cached_property
    def features(self) -> DataFrame:
        if not (self._star and self.cut):
            return self._base(features.customer_features(self.customers, self.subscriptions, self.recent_usage, self.payments, self.snapshot))
        return self._base(features.account_features(self._star.accounts(), self.recent_usage, self.snapshot))

    @cached_property
    def cohorts(self) -> DataFrame:
        return self._base(cohorts.cohort_retention(self.subscriptions, self.snapshot))

    @cached_property
    def segments(self) -> DataFrame:
        return self._keep(cohorts.segment_retention(self.features))

    @cached_property
    def trend(self) -> DataFrame:
        return self._base(trend.monthly_trend(self.subscriptions, self.subscription_snapshot))

    @cached_property
    def facts(self) -> DataFrame:
        return self._base(trend.dimensional_trend(self.customers, self.subscriptions, self.subscription_snapshot))

    @cached_property
    def overall(self) -> DataFrame:
        return self._base(trend.overall_health(self.features, self.subscriptions, self.trend))

    @cached_property
    def by_dimension(self) -> DataFrame:
        return self._keep(drivers.churn_by_dimensions(self.features))

    @cached_property
    def limits(self) -> DataFrame:
        """The quantiles that behaviour is held against, one row."""
        return self._base(drivers.thresholds(self.features))

    @cached_property
    def health(self) -> DataFrame:
        return self._base(cohorts.cohort_health(self.cohorts))

    @cached_property
    def tiers(self) -> DataFrame:
        return self._base(drivers.value_tier_churn_mix(self.features))

    @cached_property
    def exposed(self) -> DataFrame:
        return self._base(drivers.revenue_at_risk_summary(self.features, self.limits))

    @cached_property
    def relations(self) -> DataFrame:
        return self._base(drivers.behavioral_relationships(self.features, self.limits))

    @cached_property
    def plays(self) -> DataFrame:
        return self._base(drivers.intervention_priorities(self.features, limits=self.limits))

    @cached_property
    def segment_risk(self) -> DataFrame:
        return self._keep(drivers.segment_revenue_risk(self.features))

    @cached_property
    def findings(self) -> DataFrame:
        return self._base(drivers.structured_findings(self.overall, self.health, self.by_dimension, self.relations, self.exposed, self.segment_risk, self.tiers, self.plays))

    @cached_property
    def scores(self) -> DataFrame:
        return risk.with_context(self._base(risk.scored(self.features)))

    @cached_property
    def ranked(self) -> DataFrame:
        return self._keep(risk.ranked(self.scores))

    @cached_property
    def enriched(self) -> DataFrame:
        return cubes.snapshot_enriched(self.features, self.scores)

    @cached_property
    def cells(self) -> DataFrame:
        return cubes.snapshot_cells(self.enriched)

    @cached_property
    def accounts(self) -> DataFrame:
        rows = cubes.scored_accounts(self.enriched)
        return rows if self.cut else self._keep(rows)  # two checkpoints that are merged: a scope's filter reaches them

    @cached_property
    def cube(self) -> DataFrame:
        return self._keep(cubes.risk_kpi_cube(self.accounts))

    @cached_property
    def columns(self) -> DataFrame:
        return profile.column_profile(self.raw)

    @cached_property
    def quality_checks(self) -> DataFrame:
        return quality.all_checks(self.customers, self.subscriptions, self.usage, self.payments, self.profile_snapshot)

    @cached_property
    def contract_checks(self) -> DataFrame:
        return contracts.all_contracts(
            {"raw_customers": self.customers, "raw_subscriptions": self.subscriptions, "processed_customer_features": self.features, "processed_risk_scores": self.scores}
        )

    @cached_property
    def views(self) -> dict[str, Callable[[], DataFrame]]:
        """What the checks' figures are over, by name; none is planned before it is called."""
        v, s = validate, self.subscriptions
        keys = {"customers": "customer_id", "subscriptions": "subscription_id", "product_usage": "usage_id", "payments": "payment_id"}
        return {
            **{n: (lambda df=df: df) for n, df in self.raw.items()},
            **{f"{n} repeats": (lambda df=df, n=n: profile.repeats(df, keys[n])) for n, df in self.raw.items()},
            "subscriptions' customers": lambda: s,
            "subscriptions with signup": lambda: v.with_signup(s, self.customers),
            "overlapping": lambda: v.overlapping(self.many),
            "usage outside": lambda: v.outside(self.usage, self.many),
            "payments with span": lambda: v.with_span(self.payments, s),
            "features": lambda: self.features,
            "features with status": lambda: v.with_status(self.features, s),
            "segments": lambda: self.segments,
            "churn by segment": lambda: drivers.churn_by(self.features, "segment"),
            "risk again": lambda: v.risk_again(self.features, self.segments),
            "cohorts": lambda: self.cohorts,
            "cohort faults": lambda: v.cohort_faults(self.cohorts),
            "trend": lambda: self.trend,
            "thin months": lambda: v.thin_months(self.trend),
            "by dimension": lambda: self.by_dimension,
            "relations": lambda: self.relations,
            "said of tops": lambda: v.said_of_tops(drivers.driver_finding(self.by_dimension, self.relations), self.by_dimension, self.relations),
            "scores": lambda: self.scores,
            "tiers again": lambda: v.tiers_again(self.scores, risk.tier_summary(self.scores)),
            "rank neighbours": lambda: v.rank_neighbours(self.ranked),
            "segment risk": lambda: self.segment_risk,
            "refolded": lambda: v.refolded_beside(trend.trend_filtered(self.facts), self.trend),
            "cube": lambda: self.cube,
        }

    def checked(self, *keys: str, views: dict[str, Callable[[], DataFrame]] | None = None) -> DataFrame:
        """The cross-mart checks of these keys, or all, evaluated together; ``views`` replaces some of the marts' own."""
        checks = validate.all_checks({n: len(df.columns) for n, df in self.raw.items()}, cubes.ACCOUNT_COLUMNS)
        return validate.rows({k: checks[k] for k in keys or checks}, self.views | (views or {}))

    @cached_property
    def graded(self) -> DataFrame:
        """All cross-mart checks with severity and gate. The subscriptions' own overlap counts here, not that of ``many``."""
        own = {"overlapping": lambda: validate.overlapping(self.subscriptions), "usage outside": lambda: validate.outside(self.usage, self.subscriptions)}
        return self._keep(release.with_severity(self.checked(views=own)))

    @cached_property
    def _exports(self) -> dict[str, Callable[[], DataFrame]]:
        """The marts that are written, by name; none is planned before it is called."""
        f = lambda: self.features
        return {
            "customer_retention_features": lambda: self.features,
            "cohort_retention_table": lambda: self.cohorts,
            "segment_retention_summary": lambda: self.segments,
            "overall_retention_trend_monthly": lambda: self.trend,
            "monthly_dimensional_trend": lambda: self.facts,
            **{f"churn_by_{d}": (lambda d=d: drivers.churn_by(f(), d)) for d in DIMS},
            "behavioral_churn_relationships": lambda: self.relations,
            "churn_driver_ranking": lambda: drivers.churn_driver_ranking(f(), self.limits),
            "segment_revenue_risk_contribution": lambda: self.segment_risk,
            "intervention_priorities": lambda: self.plays,
            "main_analysis_structured_findings": lambda: self.findings,
            "customer_risk_scores": lambda: self.scores,
            "customer_risk_priority_ranked": lambda: self.ranked,
            "risk_tier_summary": lambda: risk.tier_summary(self.scores),
            "risk_kpi_cube": lambda: self.cube,
            "snapshot_agg": lambda: self.cells,
            "dashboard_accounts": lambda: risk.top_accounts(self.accounts, DASHBOARD_ACCOUNTS),
            "cohort_latest_revenue": lambda: cohorts.cohort_latest_revenue(self.cohorts),
            "dimension_domains": lambda: cubes.dimension_domains(f()),
            "monthly_fact_rows": lambda: cubes.monthly_fact_encoded(self.facts),
            "data_quality_checks": lambda: self.quality_checks,
            "data_contract_checks": lambda: self.contract_checks,
            "final_validation_checks": lambda: self.graded,
            "release_readiness_matrix": lambda: release.release_matrix(self.graded),
        }

    def exports(self, names: list[str] | None = None) -> dict[str, DataFrame]:
        """The marts that are written, all or some, by name."""
        return {n: mart() for n, mart in self._exports.items() if names is None or n in names}

    def load(self, folder: str, name: str, form: str = "parquet") -> DataFrame:
        """A mart as ``write`` left it, with its own types; a later stage can start from it."""
        return sources.load_mart(self.payments.sparkSession, f"{folder}/{name}", self.exports([name])[name].schema, form)

    def write(self, folder: str, form: str = "parquet", names: list[str] | None = None) -> None:
        for name, mart in self.exports(names).items():
            sources.write(mart, f"{folder}/{name}", form)

    def write_tables(self, prefix: str, buckets: int, names: list[str] | None = None) -> None:
        """Marts with a row a customer as tables ``<prefix><name>``, bucketed so that they join by customer without an exchange."""
        for name in names or ("customer_retention_features", "customer_risk_scores"):
            sources.write_table(self._exports[name](), f"{prefix}{name}", "customer_id", buckets)
