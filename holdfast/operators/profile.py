"""Profiles of the raw tables: keys, columns, dates and odd values."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import rnd, share
from ..functions.ranks import quantiles


@dataclass(frozen=True)
class Config:
    """What a table's columns are for; a column's class is the first of these that lists it."""

    grain: str
    key: str
    identifier: tuple[str, ...] = ()
    dimension: tuple[str, ...] = ()
    metric: tuple[str, ...] = ()
    temporal: tuple[str, ...] = ()
    boolean: tuple[str, ...] = ()
    text: tuple[str, ...] = ()

    def listed(self) -> list[tuple[str, str]]:
        kinds = ("identifier", "dimension", "metric", "temporal", "boolean", "text")
        return [(c, kind) for kind in kinds for c in getattr(self, kind)]

    def kind(self, column: str) -> str:
        return next((kind for c, kind in self.listed() if c == column), "dimension")


# What the four tables' columns are.
CONFIGS = {
    "customers": Config("One row per customer account", "customer_id", ("customer_id",), ("segment", "region", "acquisition_channel", "plan_type"), (), ("signup_date",)),
    "subscriptions": Config(
        "One row per subscription record", "subscription_id", ("subscription_id", "customer_id"), ("contract_type", "billing_cycle", "status"),
        ("monthly_revenue",), ("subscription_start_date", "subscription_end_date"),
    ),
    "product_usage": Config(
        "One row per customer usage event date", "usage_id", ("usage_id", "customer_id"), ("customer_id",),
        ("sessions", "feature_adoption_score", "support_tickets", "nps_score"), ("usage_date",),
    ),
    "payments": Config("One row per payment attempt", "payment_id", ("payment_id", "customer_id"), ("payment_status", "customer_id"), ("amount",), ("payment_date",)),
}


def _each(tables: dict[str, DataFrame], f) -> DataFrame:
    return reduce(DataFrame.unionByName, [f(name, df) for name, df in tables.items()])


def repeats(df: DataFrame, *keys: str) -> DataFrame:
    """One row: how many rows repeat an earlier row's key; nulls are one value."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeats"))


def repeated_rows(df: DataFrame) -> DataFrame:
    """``repeats`` of whole rows, by 128-bit fingerprints: 16 bytes a row are exchanged. Which columns are null is part of them."""
    said = [*df.columns, F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in df.columns])]
    return repeats(df.select(F.xxhash64(*said).alias("_a"), F.xxhash64(F.lit("second"), *said).alias("_b")), "_a", "_b")


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    def one(name: str, df: DataFrame) -> DataFrame:
        c = CONFIGS[name]
        basics = df.agg(F.count("*").alias("row_count"), F.count_if(F.col(c.key).isNull()).alias("candidate_pk_nulls"))
        keys = repeats(df, c.key).withColumnRenamed("repeats", "candidate_pk_duplicates")
        rows = repeated_rows(df).withColumnRenamed("repeats", "duplicate_row_count")
        return basics.crossJoin(keys).crossJoin(rows).select(
            F.lit(name).alias("table_name"), F.lit(c.grain).alias("grain"), "row_count", F.lit(len(df.columns)).alias("column_count"), F.lit(c.key).alias("candidate_primary_key"),
            ((F.col("candidate_pk_nulls") == 0) & (F.col("candidate_pk_duplicates") == 0)).alias("candidate_pk_valid"),
            "candidate_pk_nulls", "candidate_pk_duplicates", "duplicate_row_count",
        )

    return _each(tables, one)


def column_profile(tables: dict[str, DataFrame], approximate: bool = False) -> DataFrame:
    """Nulls and distinct values of every column, one pass over each table.

    Exact counts take one long pass of (column, 128-bit hash of the value), counted within
    tasks before anything is shuffled.
    """

    def exact(name: str, df: DataFrame) -> DataFrame:
        kinds = [F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("dtype"), F.lit(CONFIGS[name].kind(c)).alias("classification")) for c, t in df.dtypes]
        hashes = [F.struct(F.lit(k).alias("k"), F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias("a"), F.xxhash64(F.lit("second"), c).alias("b")) for k, c in enumerate(df.columns)]
        groups = df.select(F.explode(F.array(*hashes)).alias("h")).groupBy("h.k", "h.a", "h.b").agg(F.count("*").alias("n"))
        found = groups.groupBy("k").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("a").isNull(), F.col("n")).otherwise(0)).alias("null_count"), F.count("a").alias("distinct_count"))
        every = df.sparkSession.range(len(df.columns)).select(F.col("id").cast("int").alias("k"), F.element_at(F.array(*kinds), F.col("id").cast("int") + 1).alias("c"))
        return F.broadcast(every).join(found, "k", "left").select(
            F.lit(name).alias("table_name"), "c.column_name", "c.dtype", "c.classification", F.coalesce("null_count", F.lit(0)).cast("bigint").alias("null_count"),
            rnd(F.coalesce(share(F.col("null_count"), F.col("rows")), F.lit(0.0)), 6).alias("null_rate"), F.coalesce("distinct_count", F.lit(0)).cast("bigint").alias("distinct_count"),
        )

    def one(name: str, df: DataFrame) -> DataFrame:
        if not approximate:
            return exact(name, df)
        distinct = F.approx_count_distinct
        wide = df.agg(F.count("*").alias("rows"), *[x for c in df.columns for x in (F.count_if(F.col(c).isNull()).alias(f"n_{c}"), distinct(F.col(c)).alias(f"d_{c}"))])
        listed = F.array(
            *[
                F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("dtype"), F.lit(CONFIGS[name].kind(c)).alias("classification"), F.col(f"n_{c}").alias("null_count"), F.col(f"d_{c}").alias("distinct_count"))
                for c, t in df.dtypes
            ]
        )
        long = wide.select("rows", F.explode(listed).alias("c"))
        return long.select(
            F.lit(name).alias("table_name"), "c.column_name", "c.dtype", "c.classification", "c.null_count",
            rnd(F.coalesce(share(F.col("c.null_count"), F.col("rows")), F.lit(0.0)), 6).alias("null_rate"), "c.distinct_count",
        )

    return _each(tables, one)


def dimension_cardinality(columns: DataFrame) -> DataFrame:
    """Distinct values of the declared dimensions, of a column profile."""
    declared = [f"{t}.{c}" for t, cfg in CONFIGS.items() for c in cfg.dimension]
    name = F.concat_ws(".", "table_name", "column_name")
    return columns.where(name.isin(declared)).select("table_name", F.col("column_name").alias("dimension"), F.col("distinct_count").alias("cardinality"))


def date_coverage(tables: dict[str, DataFrame]) -> DataFrame:
    def one(name: str, df: DataFrame) -> DataFrame:
        cols = [c for c in CONFIGS[name].temporal if c in df.columns]
        wide = df.agg(*[x for c in cols for x in (F.min(c).alias(f"a_{c}"), F.max(c).alias(f"b_{c}"))])
        listed = F.array(*[F.struct(F.lit(c).alias("date_field"), F.col(f"a_{c}").alias("a"), F.col(f"b_{c}").alias("b")) for c in cols])
        long = wide.select(F.explode(listed).alias("d"))
        return long.select(F.lit(name).alias("table_name"), "d.date_field", F.col("d.a").alias("min_date"), F.col("d.b").alias("max_date"), F.datediff("d.b", "d.a").cast("bigint").alias("coverage_days"))

    return _each(tables, one)


def column_classification(columns: DataFrame) -> DataFrame:
    """Declared classes of the columns that a column profile finds; a column may have several."""
    spark = columns.sparkSession
    rows = sorted({(t, c, kind) for t, cfg in CONFIGS.items() for c, kind in cfg.listed()})
    declared = spark.createDataFrame(rows, "table_name string, column_name string, classification string")
    return columns.select("table_name", "column_name").join(F.broadcast(declared), ["table_name", "column_name"])


def suspicious_values(tables: dict[str, DataFrame]) -> DataFrame:
    subs, revenue = tables["subscriptions"], F.col("monthly_revenue")
    limit = quantiles(subs, {"q": ("monthly_revenue", 0.995)}).select((F.col("q") * 2.0).alias("threshold"))
    high = subs.crossJoin(F.broadcast(limit)).agg(F.count_if(revenue > F.col("threshold")).alias("n"), rnd(F.max("threshold"), 4).alias("threshold"))
    none = F.lit(None).cast("double")
    return (
        high.select(F.lit("subscriptions").alias("table_name"), F.lit("extreme_high_monthly_revenue").alias("issue"), F.col("n").alias("affected_rows"), "threshold")
        .union(tables["product_usage"].agg(F.count_if(F.col("sessions") == 0).alias("n")).select(F.lit("product_usage"), F.lit("zero_session_events"), "n", none))
        .union(tables["payments"].agg(F.count_if(F.col("payment_status") == "failed").alias("n")).select(F.lit("payments"), F.lit("failed_payment_events"), "n", none))
    )
