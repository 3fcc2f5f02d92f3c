"""Order statistics of groups of any size: exact quantiles and tied ranks from counts of values.

Equal values are counted first, so what is sorted are distinct values. These are dealt over ranges of values that hold about equally
many rows (the ranges come from one sketch over all rows, so a group that has most of the rows also has most of the
ranges). A value's place is the rows in lower ranges of its group and the rows before it in its own; no group is sorted in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges for each shuffle partition.
RANGES = 2


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _range_of(cuts: list[float], x: Column) -> Column:
    """How many of the ascending cuts are not above ``x``: first by blocks of them, then inside one."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) or 1
    lits = lambda some: F.array(*[F.lit(float(c)) for c in some])
    upto = lambda some: F.size(F.filter(some, lambda c: c <= x))
    block = upto(lits(cuts[step - 1 :: step]))
    return block * step + upto(F.slice(lits(cuts), block * step + 1, F.lit(step)))


def _count(weight: str | None) -> Column:
    return F.sum(weight) if weight else F.count("*")


def value_cuts(df: DataFrame, value: str, n: int) -> list[float]:
    """Values that divide all rows into about ``n`` equal parts, by a sketch; at most ``n - 1`` of them."""
    if n < 2:
        return []
    found = df.agg(F.percentile_approx(F.col(value).cast("double"), [i / n for i in range(1, n)], 20 * n).alias("cuts")).first().cuts
    return sorted(set(found or []))


def value_places(df: DataFrame, value: str, keys: list[str], weight: str | None = None) -> DataFrame:
    """``keys, value, n, before, total``: how often each value stands in its group, the rows with smaller ones, and all of the group.

    Null values are left out; NaN counts as the largest. Null keys are a group. ``weight`` names a column that says how often a row stands.
    """
    cuts = value_cuts(df, value, RANGES * _partitions(df))
    x = F.col(value)
    counts = df.where(x.isNotNull()).groupBy(*keys, value).agg(_count(weight).alias("n")).withColumn("_range", _range_of(cuts, x.cast("double")))
    sums = counts.groupBy(*keys, "_range").agg(F.sum("n").alias("_n"))
    lower = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges, at most
    sums = sums.withColumns({"_lower": F.coalesce(F.sum("_n").over(lower), F.lit(0)), "total": F.sum("_n").over(Window.partitionBy(*keys))}).drop("_n")
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "_range"]]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return counts.alias("c").join(sums.alias("s"), on).select(*(F.col(f"c.{k}") for k in keys), F.col(f"c.{value}"), "c.n", (F.col("_lower") + F.col("_inside")).alias("before"), "total")


def quantiles(df: DataFrame, value: str, keys: list[str], parts: list[float]) -> DataFrame:
    """``keys, q``: the exact quantiles of each group, between neighbours by linear interpolation; a row for each group with a value."""
    places = value_places(df, value, keys)
    position = [F.lit(p) * (F.col("total") - 1) for p in parts]
    at = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col(value).cast("double")))
    found = places.groupBy(*keys).agg(F.max("total").alias("total"), *(at(f(p)).alias(f"_{side}{i}") for i, p in enumerate(position) for side, f in (("lo", F.floor), ("hi", F.ceil))))
    position = [F.lit(p) * (F.col("total") - 1) for p in parts]
    between = [F.when(F.floor(p) == F.ceil(p), F.col(f"_lo{i}")).otherwise((F.ceil(p) - p) * F.col(f"_lo{i}") + (p - F.floor(p)) * F.col(f"_hi{i}")) for i, p in enumerate(position)]
    return found.select(*keys, F.array(*between).alias("q"))


def with_rank(df: DataFrame, value: str, keys: list[str], name: str, weight: str | None = None, centred: bool = False) -> DataFrame:
    """``df`` with the rank of ``value`` in its group, equal values sharing the mean of their places; null values have none and go.

    Ranks are looked up by value. Values with more rows than a partition has on average, which are fewer than partitions, are looked up in
    a broadcast table, so that a value that a group is full of isn't one task's. ``weight``: how often a row stands. ``centred``: less the mean rank of
    the group.
    """
    rank = F.col("before") + (F.col("n") - F.col("total") if centred else F.col("n") + 1) / 2.0
    places = value_places(df, value, keys, weight).select(*keys, value, F.col("n"), rank.alias(name))
    many = F.col("n") > F.lit((df.agg(_count(weight)).first()[0] or 0) / _partitions(df))
    on = [*keys, value]

    def looked_up(rows: DataFrame, table: DataFrame, how: str) -> DataFrame:
        same = None
        for k in on:
            one = F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}"))
            same = one if same is None else same & one
        return rows.alias("r").join(table.alias("t"), same, how).select(*(F.col(f"r.{c}") for c in rows.columns), F.col(f"t.{name}"))

    rows = looked_up(df.where(F.col(value).isNotNull()), F.broadcast(places.where(many)), "left")
    rest = looked_up(rows.where(F.col(name).isNull()).drop(name), places.where(~many), "inner")
    return rows.where(F.col(name).isNotNull()).unionByName(rest)
