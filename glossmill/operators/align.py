"""Articles against quarterly and fiscal-year series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import quantiles

LAST_DAY = 28  #: windows end on this day of the quarter's last month


#: Outlets in the order they are shown in, and how they are called there.
SHOWN = {"guardian": "The Guardian", "independent": "The Independent", "express": "Daily Express", "mirror": "Daily Mirror"}


def article_date(date: Column) -> Column:
    """The first ten characters as a date; null where they are none."""
    return F.try_to_date(F.substring(date.cast("string"), 1, 10), "yyyy-MM-dd")


def _quarter(year: Column, month: Column) -> Column:
    return F.floor((year * 12 + month - 1) / 3).cast("long")


def rolling_year(articles: DataFrame, series: DataFrame, features: list[str], group: str = "outlet", date: str = "date", least: int = 10, month_end: bool = False) -> DataFrame:
    """Each quarter of the series with group means over the twelve months that end with it.

    As all windows end on the 28th of a quarter's last month (or, if asked, with the month), an
    article belongs to one quarter of shifted days, and a window is four of them: rows are
    summed by group and quarter once, then sums run over at most four of those. Groups with fewer
    than ``least`` articles in a window go; means skip nulls, the count does not.
    """
    d = F.col("_d")
    late = F.lit(0) if month_end else F.when(F.dayofmonth(d) > LAST_DAY, 1).otherwise(0)
    q = F.floor((F.year(d) * 12 + F.month(d) - 1 + late) / 3).cast("long")
    rows = articles.withColumn("_d", article_date(F.col(date))).where("_d is not null").groupBy(group, q.alias("_q"))
    sums = rows.agg(F.count("*").alias("_n"), *[F.sum(f).alias(f"_s_{f}") for f in features], *[F.count(f).alias(f"_c_{f}") for f in features])
    ends = series.withColumn("_end", _quarter(F.col("quarter_end_year"), F.col("quarter_end_month")))
    spread = sums.select("*", F.explode(F.sequence(F.col("_q"), F.col("_q") + 3)).alias("_end"))
    total = spread.groupBy(group, "_end").agg(F.sum("_n").alias("n_articles"), *[F.round(F.try_divide(F.sum(f"_s_{f}"), F.sum(f"_c_{f}")), 10).alias(f) for f in features])
    return total.where(F.col("n_articles") >= least).join(ends, "_end").select(group, *series.columns, "n_articles", *features)


def rolling_year_by_range(articles: DataFrame, series: DataFrame, features: list[str], group: str = "outlet", date: str = "date", least: int = 10) -> DataFrame:
    """The same by a range join; to hold ``rolling_year`` against, for small series."""
    end = F.make_date("quarter_end_year", "quarter_end_month", F.lit(LAST_DAY))
    ends = series.withColumn("_end", end).withColumn("_start", F.date_add(F.add_months("_end", -12), 1))
    rows = articles.withColumn("_d", article_date(F.col(date))).join(ends, F.col("_d").between(F.col("_start"), F.col("_end")))
    return rows.groupBy(group, *series.columns).agg(F.count("*").alias("n_articles"), *[F.round(F.avg(f), 10).alias(f) for f in features]).where(F.col("n_articles") >= least)


def fiscal_year(articles: DataFrame, series: DataFrame, features: list[str], group: str = "outlet", date: str = "date", least: int = 10) -> DataFrame:
    """Each fiscal year (1 April to 31 March) of the series with group means."""
    d = article_date(F.col(date))
    rows = articles.withColumn("fy_start_year", F.year(F.add_months(d, -3)).cast("int")).where("fy_start_year is not null")
    means = rows.groupBy(group, "fy_start_year").agg(F.count("*").alias("n_articles"), *[F.round(F.avg(f), 10).alias(f) for f in features])
    return means.where(F.col("n_articles") >= least).join(series, "fy_start_year").select(group, *series.columns, "n_articles", *features)


def descriptives(df: DataFrame, features: list[str], group: str = "outlet") -> DataFrame:
    """Size, mean, deviation, median, extremes and quartiles of each feature in each group."""
    long = df.unpivot([group], features, "feature", "value").where("value is not null")
    r = lambda c: F.round(c, 4)
    keys = [group, "feature"]
    found = long.groupBy(*keys).agg(F.count("value").alias("n"), r(F.avg("value")).alias("mean"), r(F.stddev_samp("value")).alias("std"), r(F.min("value")).alias("min"), r(F.max("value")).alias("max"))
    cut = quantiles(long, "value", keys, [0.25, 0.5, 0.75]).withColumnRenamed(group, "_group").withColumnRenamed("feature", "_feature")
    both = found.join(cut, F.col(group).eqNullSafe(F.col("_group")) & (F.col("feature") == F.col("_feature")))
    return both.select(group, "feature", "n", "mean", "std", r(F.col("q")[1]).alias("median"), "min", "max", r(F.col("q")[0]).alias("q25"), r(F.col("q")[2]).alias("q75"))


def annual_means(df: DataFrame, features: list[str], group: str = "outlet", year: str = "year") -> DataFrame:
    return df.where(F.col(year).isNotNull()).groupBy(group, year).agg(F.count("*").alias("n_articles"), *[F.round(F.avg(f), 4).alias(f) for f in features])


def composition(df: DataFrame, parts: list[str], group: str = "outlet") -> DataFrame:
    """Mean of each part and its share of the sum of the means."""
    long = df.groupBy(group).agg(*[F.avg(p).alias(p) for p in parts]).unpivot([group], parts, "subcategory", "m")
    return long.select(group, "subcategory", F.round("m", 4).alias("mean_density"), F.round(F.try_divide("m", F.sum("m").over(Window.partitionBy(group))), 4).alias("share"))


def largest_part(shares: DataFrame, group: str = "outlet") -> DataFrame:
    return shares.groupBy(group).agg(F.max_by("subcategory", F.struct("share", "subcategory")).alias("subcategory"), F.max("share").alias("share"))


def stacked(shares: DataFrame, order: list[str], group: str = "outlet", label_above: float = 0.06) -> DataFrame:
    """Where each part of a stacked bar begins, and its label if it is wide enough."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("subcategory"))
    upto = Window.partitionBy(group).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    label = F.when(F.col("share") > label_above, F.format_string("%.0f%%", 100 * F.col("share")))
    return shares.select(group, "subcategory", "share", F.round(F.coalesce(F.sum("share").over(upto), F.lit(0.0)), 4).alias("begins"), label.alias("label"))


def pivoted(shares: DataFrame, parts: list[str], group: str = "outlet") -> DataFrame:
    return shares.groupBy(group).pivot("subcategory", parts).agg(F.first("share"))


def dual_series(aligned: DataFrame, value: str, outcome: str, group: str = "outlet", shown: dict[str, str] = SHOWN, per: float = 1000.0, broke: str = "2020-03-01") -> DataFrame:
    """Two series on two axes by quarter, ready to plot: the outcome in thousands, a panel's place and title, and whether the
    quarter is from before the measure changed. Groups that are not shown go.
    """
    names = F.array(*map(F.lit, shown))
    date = F.make_date("quarter_end_year", "quarter_end_month", F.lit(1))
    rows = aligned.where(F.col(group).isin(list(shown))).withColumn("date", date)
    title = F.element_at(F.array(*map(F.lit, shown.values())), F.array_position(names, F.col(group)).cast("int"))
    return rows.select(F.array_position(names, F.col(group)).alias("panel"), title.alias("title"), "date", F.col(value), (F.col(outcome) / per).alias(f"{outcome}_thousands"), (F.col("date") < F.lit(broke).cast("date")).alias("before_break"))
