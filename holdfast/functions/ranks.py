"""Ranks and quantiles over whole tables without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import beside

#: Rows that are drawn to cut an order into ranges.
DRAWN = 255


def _bucket(v: Column) -> Column:
    """Buckets that grow with their values' size, 64 a power of two: some 60,000 at most."""
    return F.floor(F.signum(v) * F.log2(F.lit(1.0) + F.abs(v)) * 64)


def _listed(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """``name, v`` of each column's values beside the kept columns, nulls left out."""
    entries = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])
    return df.select(*keep, F.explode(entries).alias("e")).select(*keep, "e.name", "e.v").where("v is not null")


def quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]], *by: str) -> DataFrame:
    """Exact, interpolated quantiles: for each name the one of (column, share), one row, or one for each value of ``by``.

    By radix selection: a histogram of buckets, counted in the tasks first, names the few
    with the wanted places, and only these buckets' values are shuffled and put in order.
    """
    keys, v = [*by, "name"], F.col("v")
    rows = _listed(df, sorted({c for c, _ in wanted.values()}), *by).withColumn("bucket", _bucket(v))
    every = Window.partitionBy(*keys)
    upto = every.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "bucket").agg(F.count("*").alias("m"))
    totals = totals.select(*keys, "bucket", "m", F.coalesce(F.sum("m").over(upto), F.lit(0)).alias("base"), F.sum("m").over(every).alias("everyone"))
    asked = F.array(*[F.struct(F.lit(out).alias("out"), F.lit(c).alias("of"), F.lit(float(p)).alias("p")) for out, (c, p) in wanted.items()])
    place = F.col("p") * (F.col("everyone") - 1)
    places = totals.select(*keys, "bucket", "base", "m", "everyone", F.inline(asked)).where("of = name")
    places = places.select(*keys, "bucket", "base", "m", "out", place.alias("place"), F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("k"))
    # two rows at most for each quantile and value of ``by``
    places = F.broadcast(places.where("base <= k and k < base + m").drop("m"))
    inside = Window.partitionBy(*keys, "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.join(places.select(*keys, "bucket"), [*keys, "bucket"], "left_semi").groupBy(*keys, "bucket", "v").agg(F.count("*").alias("n"))
    near = near.select(*keys, "bucket", "v", "n", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("below"))
    met = near.join(places, [*keys, "bucket"]).where("base + below <= k and k < base + below + n")
    low, high = (F.max(F.when(F.col("k") == f("place"), v)) for f in (F.floor, F.ceil))
    place = F.max("place")
    mean = F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)
    found = met.groupBy(*by, "out").agg(mean.alias("q"))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("out") == out, F.col("q"))).alias(out) for out in wanted])


def _cuts(df: DataFrame, columns: list[Column], drawn: int, by: list[Column]) -> DataFrame:
    """One row: for each column the sorted distinct values of ``drawn`` rows, those of the smallest hashes, so that they are the same each time."""
    some = df.select(F.xxhash64(*by).alias("h"), *[c.alias(f"c{k}") for k, c in enumerate(columns)])
    some = some.orderBy("h", *[f"c{k}" for k in range(len(columns))]).limit(drawn)
    return some.agg(*[F.array_sort(F.collect_set(f"c{k}")).alias(f"cuts{k}") for k in range(len(columns))])


def _below(df: DataFrame, cuts: str, v: str, out: str, drawn: int) -> DataFrame:
    """``df`` with the number of its sorted ``cuts``, ``drawn`` at most, that are smaller than ``v``.

    By halving, each step a column of its own: the steps are compiled, as functions of arrays are not.
    """
    rows = df.withColumn(out, F.lit(0))
    for step in (1 << k for k in reversed(range(drawn.bit_length()))):
        rows = rows.withColumn(out, F.col(out) + F.when(F.get(cuts, F.col(out) + (step - 1)) < F.col(v), step).otherwise(0))
    return rows


def percent_rank_avg(df: DataFrame, key: str, *values: str, drawn: int = DRAWN) -> DataFrame:
    """``key, name, rank``: for each of the columns, the mean rank of ties over the number of rows with a value.

    All columns are ranked together, and their rows are exchanged once. Drawn values cut
    each column into ranges, whose rows are ranked by themselves, on top of the rows below.
    Rows with a drawn value are all tied: their number alone gives their rank, so they are
    dealt out by key. A value that many rows share is drawn almost surely, so no range has
    many more rows than others.
    """
    spread = F.array(*[F.struct(F.lit(k).alias("of"), F.col(f"cuts{k}").alias("cuts")) for k in range(len(values))])
    cuts = _cuts(df, [F.col(c).cast("double") for c in values], drawn, [F.col(key)]).select(F.inline(spread))
    entries = F.array(*[F.struct(F.lit(k).alias("of"), F.col(c).cast("double").alias("v")) for k, c in enumerate(values)])
    rows = df.select(key, F.inline(entries)).where("v is not null")
    rows = _below(rows.join(F.broadcast(cuts), "of"), "cuts", "v", "range", drawn)
    tied = F.coalesce(F.get("cuts", F.col("range")) == F.col("v"), F.lit(False)).cast("int")
    # column, range and tie as one number: rows are sorted by it, and counts by a whole number are broadcast as they are, not in pages of up to 64 MB
    rows = rows.select(key, "v", ((F.col("of") * (drawn + 1) + F.col("range")) * 2 + tied).alias("part"))
    of, tied = F.floor(F.col("part") / (2 * (drawn + 1))).cast("int"), F.col("part") % 2 == 1
    every = Window.partitionBy(of)
    upto = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # of the ranges' counts
    counts = rows.groupBy("part").agg(F.count("*").alias("m"))
    counts = counts.select("part", "m", F.coalesce(F.sum("m").over(upto), F.lit(0)).alias("base"), F.sum("m").over(every).alias("everyone"))
    inside = Window.partitionBy("part", "dealt").orderBy("v")
    own = F.when(tied, (F.col("m") + 1) / 2).otherwise((F.rank().over(inside) + F.count("*").over(inside)) / 2)
    rows = rows.withColumn("dealt", F.when(tied, F.pmod(F.xxhash64(key), F.lit(1024))).otherwise(0)).join(F.broadcast(counts), "part")
    name = F.get(F.array(*map(F.lit, values)), of)
    return rows.select(key, name.alias("name"), ((F.col("base") + own) / F.col("everyone")).alias("rank"))


def ordinal(df: DataFrame, first: str, *then: str | Column, out: str = "rank", drawn: int = DRAWN) -> DataFrame:
    """``df`` with its place (from 1) by falling ``first``, then by rising ``then``.

    Drawn rows cut the whole order, not ``first`` alone, into ranges; a range's rows are
    numbered by themselves, on top of the rows of the ranges before.
    """
    order = [F.col(first).isNull(), -F.col(first), *(F.col(c) if isinstance(c, str) else c for c in then)]
    place = F.struct(*[c.alias(f"k{k}") for k, c in enumerate(order)])
    rows = beside(df.withColumn("_place", place), _cuts(df, [place], drawn, order))
    rows = _below(rows, "cuts0", "_place", "_range", drawn).drop("cuts0")
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # of the ranges' counts
    counts = rows.groupBy("_range").agg(F.count("*").alias("_m")).select("_range", F.coalesce(F.sum("_m").over(upto), F.lit(0)).alias("_base"))
    number = F.row_number().over(Window.partitionBy("_range").orderBy("_place"))
    rows = rows.join(F.broadcast(counts), "_range").withColumn(out, F.col("_base") + number)
    return rows.drop("_place", "_range", "_base")
