"""Schemas of the four raw tables, loaders and sinks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "customers": "customer_id string, signup_date date, segment string, region string, acquisition_channel string, plan_type string",
    "subscriptions": "subscription_id string, customer_id string, subscription_start_date date, subscription_end_date date, monthly_revenue double, contract_type string, billing_cycle string, status string",
    "product_usage": "usage_id string, customer_id string, usage_date date, sessions int, feature_adoption_score double, support_tickets int, nps_score int",
    "payments": "payment_id string, customer_id string, payment_date date, amount double, payment_status string",
}


#: Usage as ``write_usage`` lays it out, beside the raw tables, and the column that its folders are named by.
USAGE_BY_MONTH, MONTH = "product_usage_by_month", "usage_month"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; only in local mode one is made where it is unset."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if place:
        return place.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext.getCheckpointDir()


def load(spark: SparkSession, folder: str, name: str, form: str = "parquet") -> DataFrame:
    """A raw table with its declared types; CSV and JSON text that can't be cast becomes null."""
    schema = T.StructType.fromDDL(SCHEMAS[name])
    if form == "csv":
        raw = spark.read.csv(f"{folder}/{name}.csv", header=True)
    elif form == "json":
        raw = spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema])).json(f"{folder}/{name}.json")
    else:
        raw = spark.read.format(form).load(f"{folder}/{name}.{form}")
    return typed(raw, schema)


def write_usage(usage: DataFrame, folder: str) -> None:
    """Usage in a folder a month of ``usage_date``, rows without a day in one of their own; large months are split over several files."""
    rows = typed(usage, T.StructType.fromDDL(SCHEMAS["product_usage"])).withColumn(MONTH, F.trunc("usage_date", "month")).hint("rebalance", MONTH)
    write(rows, f"{folder.rstrip('/')}/{USAGE_BY_MONTH}", by=(MONTH,))


def recent_usage(spark: SparkSession, folder: str, snapshot: DataFrame, days: int = 90) -> DataFrame:
    """Usage of the last days before a snapshot; folders of earlier months are passed over once the snapshot's day is known."""
    usage = spark.read.schema(f"{SCHEMAS['product_usage']}, {MONTH} date").parquet(f"{folder.rstrip('/')}/{USAGE_BY_MONTH}")
    first = F.date_sub("snapshot_date", days - 1)
    near = F.col(MONTH) >= snapshot.select(F.trunc(first, "month")).scalar()
    return usage.where(near & (F.col("usage_date") >= snapshot.select(first).scalar())).drop(MONTH)


def load_mart(spark: SparkSession, path: str, schema: T.StructType, form: str = "parquet") -> DataFrame:
    """A written mart with its declared types; text formats are read as text and cast."""
    if form == "csv":
        return typed(spark.read.csv(path, header=True), schema)
    if form == "json":
        return typed(spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema])).json(path), schema)
    return typed(spark.read.format(form).load(path), schema)


def typed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Declared columns cast; blank text and NaN are null."""
    cols = []
    for f in schema:
        c = F.col(f.name)
        if isinstance(raw.schema[f.name].dataType, T.StringType):
            c = F.nullif(F.trim(c), F.lit(""))
        c = c.try_cast(f.dataType)
        if isinstance(f.dataType, T.DoubleType):
            c = F.when(~F.isnan(c), c)
        cols.append(c.alias(f.name))
    return raw.select(*cols)


def clean_subscriptions(raw: DataFrame) -> DataFrame:
    """Staging view: dates cast, blank end dates open, rows without a start date dropped."""
    date = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).try_cast("date")
    return raw.select(
        "subscription_id",
        "customer_id",
        date("subscription_start_date").alias("subscription_start_date"),
        date("subscription_end_date").alias("subscription_end_date"),
        "monthly_revenue",
        "contract_type",
        "billing_cycle",
        "status",
    ).where("subscription_start_date is not null")


def _store(spark: SparkSession, path: str):
    """A path, and the file system that it is on."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, store = _store(spark, path)
    return store.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    where, store = _store(spark, path)
    store.delete(where, True)


def write(mart: DataFrame, path: str, form: str = "parquet", by: tuple[str, ...] = ()) -> None:
    """One folder a mart, with one below for each value of the columns ``by``; NaN goes out as null in text formats.

    Nothing is overwritten in place: rows go to a folder of their own beside ``path``, which
    takes its name once they are all there. If writing fails, what was there before stays
    whole; the mart may be read from ``path`` itself.
    """
    spark, path = mart.sparkSession, path.rstrip("/")
    if form in ("csv", "json"):
        mart = mart.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in mart.dtypes])
    staged, before = (f"{path}.{state}-{uuid.uuid4().hex}" for state in ("staged", "before"))
    try:
        writer = mart.write.format(form).partitionBy(*by) if by else mart.write.format(form)
        (writer.option("header", True) if form == "csv" else writer).save(staged)
        there = exists(spark, path)
        if there:
            _renamed(spark, path, before)
        try:
            _renamed(spark, staged, path)
        except Exception:
            if there:
                _renamed(spark, before, path)
            raise
        if there:
            remove(spark, before)
    finally:
        remove(spark, staged)


def write_table(mart: DataFrame, table: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted by a key; tables of equal buckets join and group by it without an exchange.

    As with ``write``, rows go to a table of their own first, which then takes the name.
    """
    spark, tag = mart.sparkSession, uuid.uuid4().hex
    staged, before = f"{table}_staged_{tag}", f"{table}_before_{tag}"
    try:
        mart.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(staged)
        there = spark.catalog.tableExists(table)
        if there:
            spark.sql(f"ALTER TABLE {table} RENAME TO {before}")
        try:
            spark.sql(f"ALTER TABLE {staged} RENAME TO {table}")
        except Exception:
            if there:
                spark.sql(f"ALTER TABLE {before} RENAME TO {table}")
            raise
        if there:
            spark.sql(f"DROP TABLE {before}")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {staged}")


def _renamed(spark: SparkSession, path: str, to: str) -> None:
    where, store = _store(spark, path)
    if not store.rename(where, _store(spark, to)[0]):
        raise OSError(f"{path} can't be renamed to {to}")
