"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def rnd(c: Column | str, digits: int) -> Column:
    """Rounding half away from zero of the decimal value, so that ties don't hang on binary fractions."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("decimal(38,10)"), digits).cast("double")


def rnd_large(c: Column | str, digits: int) -> Column:
    """``rnd`` of amounts beyond some 4e8, with ties as the SQL's cast to DECIMAL(38,10) leaves them.

    The cast takes the double nearest to 10^10 times the amount, in which half a unit of large amounts may come
    a little lower; ``rnd`` takes the amount's decimal digits, and always rounds half a unit up.
    """
    c = F.col(c) if isinstance(c, str) else c
    unit, part = 10 ** (10 - digits), 2**32
    held = F.abs(c) * 1e10
    high = F.floor(held / part)  # both parts are whole numbers, so that no digit of the product is lost
    low = F.rint(held - high * float(part)).cast("bigint")
    whole = high.cast("decimal(19,0)") * F.lit(part).cast("decimal(10,0)") + low.cast("decimal(10,0)")
    units = F.call_function("div", whole + F.lit(unit // 2).cast("decimal(10,0)"), F.lit(unit).cast("decimal(11,0)"))
    return F.when(F.abs(c) < 1e15, F.signum(c) * units / 10**digits + F.lit(0.0)).otherwise(rnd(c, digits))


def money(c: Column | str) -> Column:
    """Exact sum of a column of cents, as a double; of no rows it is 0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(c.cast("decimal(28,4)")), F.lit(0).cast("decimal(28,4)")).cast("double")


def share(a: Column, b: Column) -> Column:
    """``a / b``; null when ``b`` is not positive."""
    return F.when(b > 0, a / b)


def count_if(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def month(c: Column | str) -> Column:
    return F.trunc(F.col(c) if isinstance(c, str) else c, "month")


def month_number(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.year(c) * 12 + F.month(c)


def one_row(spark: SparkSession, **values: Column) -> DataFrame:
    """A one-row table of constants. A scalar value of it is a constant of the plan, not a query of its own."""
    return spark.sql("SELECT 0").select(*[v.alias(c) for c, v in values.items()])


def beside(df: DataFrame, one: DataFrame) -> DataFrame:
    """Every row of ``df`` with the columns of a one-row table.

    They come as a scalar value, not by a nested loop join: where there is such a join Spark leaves
    a shuffle in parts of 1 MB at most, each of which opens a file for each part of the next.
    """
    value = one.select(F.struct(*one.columns).alias("one")).scalar()
    return df.select("*", *[value[c].alias(c) for c in one.columns])
