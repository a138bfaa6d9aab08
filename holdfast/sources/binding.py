"""The retention tables as views of an order-management star schema."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from decimal import Decimal
from functools import cached_property
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import beside, one_row
from ..operators.features import PAYMENT_AMOUNTS, payment_sums, with_payment_windows

#: Order priorities that are numbered; with more of them a customer's first order is found by its columns.
LEVELS = 100
_SUBSCRIPTION = ("subscription_id", "customer_id", "subscription_start_date", "subscription_end_date", "monthly_revenue", "contract_type", "billing_cycle", "status")


class _Facts(NamedTuple):
    last_day: date | None
    levels: list[str] | None  # the priorities, where a first order fits into one whole number
    d0: int | None
    k0: int | None
    keys: int
    cents: bool  # all amounts are whole cents below 1e9, within which their doubles tell so, and sums of them stay below 2^62


class Star:
    """Lazy views of customers, subscriptions, product usage and payments over one folder of tables.

    Tables that grow meet by merging. Their files are small beside their rows, so that Spark would take
    a few of their columns for small enough to send to the driver and to all executors.

    With ``ahead`` facts of the orders are read at once: the last day is a constant of all plans then, and ``owners``
    has the payments' windows too, from its one pass over the orders.
    """

    def __init__(self, spark: SparkSession, folder: str, ahead: bool = False):
        self.spark, self.ahead = spark, ahead
        self._folder, self._tables = folder, {}

    def _read(self, name: str) -> DataFrame:
        """A table; its files are listed and its schema read once."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self._folder}/{name}.parquet")
        return self._tables[name]

    def _orders(self) -> DataFrame:
        return self._read("orders").withColumn("day", F.col("o_orderdate").cast("date"))

    @cached_property
    def _facts(self) -> _Facts:
        """What the orders are like, by one pass over four of their columns; with more than ``LEVELS`` priorities by another."""
        day, key, amount = F.unix_date("day"), F.col("o_orderkey"), F.abs("o_totalprice")
        types = dict(self._read("orders").dtypes)
        facts = [
            F.count("*").alias("n"), F.max("day").alias("last_day"), F.min(day).alias("d0"), F.max(day).alias("d1"), F.min(key).alias("k0"), F.max(key).alias("k1"),
            F.max(amount.cast("double")).alias("most"), F.bool_or(day.isNull() | key.isNull()).alias("gaps"),
            F.bool_or(F.coalesce(F.abs(amount.cast("double") * 100 - F.rint(amount.cast("double") * 100)) >= 1e-4, F.lit(False))).alias("broken"),
        ]
        rows = self._orders().groupBy("o_orderpriority").agg(*facts).limit(LEVELS + 1).collect()
        levels = sorted(r.o_orderpriority for r in rows if r.o_orderpriority is not None) if len(rows) <= LEVELS else None
        if levels is None:
            rows = self._orders().agg(*facts).collect()
        of = lambda f, c: f((r[c] for r in rows if r[c] is not None), default=None)
        n, d0, k0 = sum(r.n for r in rows), of(min, "d0"), of(min, "k0")
        keys = of(max, "k1") - k0 + 1 if types["o_orderkey"] in ("int", "bigint") and k0 is not None else 0
        fits = bool(levels is not None and d0 is not None and keys and not any(r.gaps for r in rows)) and (of(max, "d1") - d0 + 1) * keys * (len(levels) + 1) < 2**62
        most = of(max, "most") or 0.0
        cents = types["o_totalprice"] == "double" and not any(r.broken for r in rows) and most < 1e9 and most * 100 * n < 2**62
        return _Facts(of(max, "last_day"), levels if fits else None, d0, k0, keys, cents)

    @cached_property
    def last_day(self) -> DataFrame:
        """One row, the last order day; kept, or a constant."""
        if self.ahead:
            return one_row(self.spark, last_day=F.lit(self._facts.last_day).cast("date"))
        return self._orders().agg(F.max("day").alias("last_day")).persist()

    @property
    def snapshot(self) -> DataFrame:
        """The latest day of subscriptions, usage and payments: payments have every order's day, subscriptions
        start and end on order days, and usage has no day after the last one."""
        return self.last_day.withColumnRenamed("last_day", "snapshot_date")

    def _first(self) -> tuple[Column, Column]:
        """An aggregate, ``first``: a customer's first order by day and key, nulls last; and its priority as a column of it.

        Where day, key and the priority's place fit into one whole number, that is aggregated by hashing; to aggregate texts or structs Spark sorts the orders.
        """
        levels = self._facts.levels if self.ahead else None
        if levels is None:
            return F.min(F.struct(F.col("day").isNull(), "day", F.col("o_orderkey").isNull(), "o_orderkey", "o_orderpriority")), F.col("first.o_orderpriority")
        f, named = self._facts, F.array(*map(F.lit, levels)).cast("array<string>")
        level = F.coalesce(F.array_position(named, F.col("o_orderpriority")), F.lit(0))  # from 1; 0 for none
        number = ((F.unix_date("day") - f.d0).cast("bigint") * f.keys + (F.col("o_orderkey") - f.k0)) * (len(levels) + 1) + level
        place = F.pmod(F.col("first"), F.lit(len(levels) + 1)).cast("int")
        return F.min(number), F.when(place > 0, F.get(named, place - 1))

    def _sums(self) -> tuple[Column, dict[str, Column], Callable[[str], Column]]:
        """The sum of a customer's orders, the sums of their payments, and what makes an amount of a sum: whole cents are summed as such, others as decimals."""
        if not self.ahead:
            return F.sum(F.col("o_totalprice").cast("decimal(18,2)")), {}, F.col
        if not self._facts.cents:
            return F.sum(F.col("o_totalprice").cast("decimal(18,2)")), payment_sums(), F.col
        cents = lambda c: F.rint(c * 100).cast("bigint")
        return F.sum(cents(F.col("o_totalprice"))), payment_sums(cents), lambda c: (F.col(c).cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast("decimal(38,4)")

    @cached_property
    def owners(self) -> DataFrame:
        """Subscriptions beside the priority of their customer's first order, from one pass over the orders; read ahead, beside the payments' windows too."""
        months = lambda d: F.year(d) * 12 + F.month(d)
        first, priority = self._first()
        total, sums, amount = self._sums()
        orders = beside(self._orders().withColumns(self._payment()), self.snapshot) if sums else self._orders()
        own = orders.groupBy("o_custkey").agg(
            first.alias("first"), F.min("day").alias("a"), F.max("day").alias("b"), total.alias("total"), *[c.alias(n) for n, c in sums.items()]
        )
        idle = F.datediff("last_day", "b")
        per_month = (amount("total").cast("double") / (months(F.col("b")) - months(F.col("a")) + 1)).cast("decimal(38,10)")
        k = F.col("o_custkey")
        rows = beside(own, self.last_day).select(
            k.alias("subscription_id"),
            k.alias("customer_id"),
            F.col("a").alias("subscription_start_date"),
            F.when(idle >= 365, F.col("b")).alias("subscription_end_date"),
            F.round(per_month, 2).cast("double").alias("monthly_revenue"),
            F.when(k % 2 == 0, "Annual").otherwise("Monthly").alias("contract_type"),
            F.when(k % 3 == 0, "Monthly").when(k % 3 == 1, "Quarterly").otherwise("Annual").alias("billing_cycle"),
            F.when(idle >= 365, "churned").when(idle >= 180, "at_risk").otherwise("active").alias("status"),
            priority.alias("first_priority"),
            *[(amount(n) if n in PAYMENT_AMOUNTS else F.col(n)).alias(n) for n in sums],
        )
        return with_payment_windows(rows) if sums else rows

    def _customers(self, owners: DataFrame, how: str, *beside: str) -> DataFrame:
        places = self._read("nation").join(self._read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        plan = F.when(F.col("c_acctbal") < 0, "Basic").when(F.col("c_acctbal") < 3000, "Growth").when(F.col("c_acctbal") < 6500, "Pro").otherwise("Enterprise")
        return (
            self._read("customer")
            .join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))  # by hint: of two small tables joined Spark thinks them larger than customers
            .join(owners.hint("merge"), F.col("c_custkey") == F.col("customer_id"), how)
            .select(
                F.col("c_custkey").alias("customer_id"),
                F.col("subscription_start_date").alias("signup_date"),
                F.col("c_mktsegment").alias("segment"),
                F.col("r_name").alias("region"),
                F.col("first_priority").alias("acquisition_channel"),
                plan.alias("plan_type"),
                *beside,
            )
        )

    def customers(self) -> DataFrame:
        return self._customers(self.owners.select("customer_id", "subscription_start_date", "first_priority"), "left")

    def accounts(self) -> DataFrame:
        """Customers beside their subscriptions and, if read ahead, payment windows; both come from ``owners``, which they meet once."""
        return self._customers(self.owners, "inner", *[c for c in self.owners.columns if c not in ("customer_id", "first_priority")])

    def subscriptions(self) -> DataFrame:
        return self.owners.select(*_SUBSCRIPTION)

    def subscriptions_multi(self) -> DataFrame:
        """One subscription an order, so that overlaps and gaps occur."""
        last = self._read("lineitem").groupBy("l_orderkey").agg(F.max(F.col("l_shipdate").cast("date")).alias("subscription_end_date"))
        return self._orders().join(last.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey")).select(
            F.col("o_orderkey").alias("subscription_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("day").alias("subscription_start_date"),
            "subscription_end_date",
            F.col("o_totalprice").alias("monthly_revenue"),
        )

    def usage(self, lines: DataFrame | None = None) -> DataFrame:
        lines = self._read("lineitem") if lines is None else lines
        lines = lines.withColumn("usage_date", F.col("l_shipdate").cast("date"))
        owner = self._read("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("customer_id"))
        return (
            beside(lines.join(owner.hint("merge"), "l_orderkey"), self.last_day)
            .where("usage_date <= last_day")
            .select(
                F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("usage_id"),
                "customer_id",
                "usage_date",
                F.col("l_quantity").cast("int").alias("sessions"),
                F.round((F.lit(100.0) - F.col("l_discount") * 1000).cast("decimal(38,10)"), 2).cast("double").alias("feature_adoption_score"),
                F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("support_tickets"),
                (F.col("l_linenumber") * 25 - 100).cast("int").alias("nps_score"),
            )
        )

    def recent_usage(self, snapshot: DataFrame, days: int = 90) -> DataFrame:
        """Usage of the last days before a snapshot; the filter is on the stored column, and so reaches the scan."""
        lines = self._read("lineitem")
        first = snapshot.select(F.date_sub("snapshot_date", days - 1).cast(lines.schema["l_shipdate"].dataType)).scalar()
        return self.usage(lines.where(F.col("l_shipdate") >= first))

    def _payment(self) -> dict[str, Column]:
        return {"payment_date": F.col("day"), "amount": F.col("o_totalprice"), "payment_status": F.when(F.col("o_orderstatus") == "P", "failed").otherwise("paid")}

    def payments(self) -> DataFrame:
        return self._orders().select(F.col("o_orderkey").alias("payment_id"), F.col("o_custkey").alias("customer_id"), *[x.alias(c) for c, x in self._payment().items()])
