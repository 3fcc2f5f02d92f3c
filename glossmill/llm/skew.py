"""Joins in which a key may have a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heavy_keys(rows: DataFrame, key: str, total: int, n: int) -> DataFrame:
    """``key, _of``: keys with more rows than one of ``n`` parts of ``total`` rows has, of which there are fewer than ``n``, and how many parts they fill."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > total / n)
    return counts.select(key, F.ceil(F.col("_n") * n / max(1, total)).cast("int").alias("_of"))


def spread_join(many: DataFrame, one: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """``many`` joined to ``one``, which has one or a few rows for each key; nulls meet nothing.

    Rows of ``heavy`` keys are dealt over as many tasks as they fill, by all their columns, and what ``one`` has of the key is copied to
    each: fewer than twice as many copies of a row as parts in all. The table of heavy keys is broadcast; it has fewer rows than parts.
    """
    told = F.broadcast(heavy)
    rows = many.join(told, key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*many.columns), F.col("_of")), F.lit(0)).cast("int")).drop("_of")
    copies = one.join(told, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_of", F.lit(1)) - 1))).drop("_of")
    return rows.join(copies, [key, "_part"]).drop("_part")
