"""Relational pieces: guards, unions, keyed joins, first rows, outlet names, labels and stance."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import quantiles

#: Spellings of outlets and their codes.
OUTLETS = {
    "guardian": "guardian", "the guardian": "guardian", "daily express": "express", "express": "express", "the independent": "independent",
    "independent": "independent", "daily mirror": "mirror", "mirror": "mirror",
}
#: What to look for in file names, in order, when features are made, and when texts are cleaned.
FILE_HINTS = ("guardian", "express", "independent", "mirror")
CLEANING_HINTS = ("express", "independent", "star", "guardian")


def require_columns(df: DataFrame, names: list[str], on_missing: str = "error") -> bool:
    """Whether all columns are there; if not, an error, a warning, or just False (``skip``)."""
    missing = [n for n in names if n not in df.columns]
    if missing and on_missing == "error":
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if missing and on_missing == "warn":
        warnings.warn(f"missing columns: {', '.join(missing)}", stacklevel=2)
    return not missing


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows of all frames by column name; what a frame lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def first_rows(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key by the given order; rows are reduced before the shuffle."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def resume(queue: DataFrame, *ledgers: DataFrame, key: str = "url") -> DataFrame:
    """Rows of the queue whose key is in none of the ledgers."""
    for ledger in ledgers:
        queue = queue.join(ledger.select(key), key, "left_anti")
    return queue


def attach(features: DataFrame, scores: DataFrame, key: str = "url", null_safe: bool = True) -> DataFrame:
    """Every feature row with its scores, one for each match; null keys meet each other if ``null_safe``."""
    right = scores.withColumnRenamed(key, "_key")
    on = F.col(key).eqNullSafe(F.col("_key")) if null_safe else F.col(key) == F.col("_key")
    return features.join(right, on, "left").drop("_key")


def match_rate(joined: DataFrame, label: str) -> DataFrame:
    return joined.agg(F.count("*").alias("n_rows"), F.count(label).alias("n_matched"), F.round(F.try_divide(F.count(label), F.count("*")), 6).alias("match_rate"))


def outlet_of_file(name: Column, hints: tuple[str, ...] = FILE_HINTS) -> Column:
    """The first hint in a file's name, else its stem."""
    return F.coalesce(hinted_outlet(name, hints), F.regexp_replace(F.lower(F.element_at(F.split(name, "/"), -1)), r"\.[^.]*$", ""))


def hinted_outlet(name: Column, hints: tuple[str, ...]) -> Column:
    """The first hint in a file's name, else null."""
    lowered = F.lower(F.element_at(F.split(name, "/"), -1))
    return F.coalesce(*[F.when(F.contains(lowered, F.lit(h)), F.lit(h)) for h in hints])


def canonical_outlet(df: DataFrame, hint: str | None = None, outlets: dict[str, str] = OUTLETS) -> DataFrame:
    """Outlets by their code, a missing one from the file hint; an unknown one is an error when the row is read."""
    name = F.trim(F.lower(F.coalesce(F.col("outlet"), F.lit(hint).cast("string"))))
    code = F.element_at(F.create_map(*[F.lit(x) for kv in outlets.items() for x in kv]), name)
    return df.withColumn("outlet", F.when(name.isNull() | code.isNotNull(), code).otherwise(F.raise_error(F.concat(F.lit("unknown outlet: "), name))))


def in_month(date: Column, year: Column, month: Column, sitemap_date: Column | None = None) -> Column:
    """Whether the date string found in a page lies in the target month; what can't be read doesn't.

    For an outlet whose dates come from the sitemap (``sitemap_date`` is given) the month isn't tested and every row stays.
    """
    if sitemap_date is not None:
        return F.lit(True)
    parts = F.substring(date, 1, 4).try_cast("int"), F.substring(date, 6, 2).try_cast("int")
    return F.coalesce((parts[0] == year) & (parts[1] == month), F.lit(False))


def article_day(date: Column, sitemap_date: Column | None = None) -> Column:
    """The date of an article: the sitemap's, if there is such a column and it says one, else the page's."""
    return date if sitemap_date is None else F.coalesce(F.nullif(sitemap_date, F.lit("")), date)


def stance_label(pro: Column, anti: Column, margin: float = 0.1) -> Column:
    """Neutral within the margin, else the larger score's side; on unrounded scores."""
    return F.when(F.abs(pro - anti) < margin, "neutral").when(pro > anti, "pro").when(pro.isNotNull() & anti.isNotNull(), "anti")


def score_counts(df: DataFrame, score: str, cuts: tuple[float, ...] = (0.5, 0.7, 0.9)) -> DataFrame:
    """Mean, median, deviation, and how many rows lie above each cut."""
    c = F.col(score)
    above = [F.count_if(c > x).alias(f"above_{str(x).replace('.', '_')}") for x in cuts]
    found = df.agg(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("std"), *above)
    half = quantiles(df.select(F.lit(0).alias("_all"), c.alias("_score")), "_score", ["_all"], [0.5]).select(F.round(F.col("q")[0], 6).alias("median"))
    return found.join(half, how="left").select("n", "mean", "median", "std", *(n for n in found.columns if n.startswith("above_")))  # a row each, or none


def binary_agreement(df: DataFrame, human: str, machine: str) -> DataFrame:
    """Confusion counts of 0/1 labels, accuracy, precision, recall and F1, 0 where nothing is there to divide by; blank labels don't count."""
    h, m = F.col(human), F.col(machine)
    n = lambda a, b: F.count_if((h == a) & (m == b))
    c = df.where(h.isin(0, 1) & m.isin(0, 1)).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    return c.select("*", *_scores(F.col("tp"), F.col("fp"), F.col("fn")), F.round(F.coalesce(F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), F.lit(0.0)), 4).alias("accuracy"))


def _scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    part = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    return [part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"), part(2 * tp, 2 * tp + fp + fn).alias("f1")]


def class_agreement(df: DataFrame, human: str, machine: str) -> DataFrame:
    """One row for each class that occurs: precision, recall, F1 and support; pairs are counted first."""
    pairs = df.where(F.col(human).isNotNull() & F.col(machine).isNotNull()).groupBy(F.col(human).cast("string").alias("h"), F.col(machine).cast("string").alias("m")).agg(F.count("*").alias("n"))
    sides = pairs.select("h", "m", "n", F.explode(F.array_distinct(F.array("h", "m"))).alias("class"))
    mine, theirs = F.col("h") == F.col("class"), F.col("m") == F.col("class")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0).cast("long"))
    counts = sides.groupBy("class").agg(total(mine & theirs).alias("tp"), total(~mine & theirs).alias("fp"), total(mine & ~theirs).alias("fn"))
    return counts.select("class", *_scores(F.col("tp"), F.col("fp"), F.col("fn")), (F.col("tp") + F.col("fn")).alias("support"))


def balanced_sample(df: DataFrame, score: str, threshold: float, each: int = 150, key: str = "url", seed: int = 42) -> DataFrame:
    """``each`` rows at or above the threshold and as many below, the same ones every time, in mixed order.

    Each side is a top-k by hash, so no stratum meets in one task.
    """
    order = F.xxhash64(F.col(key), F.lit(seed)), F.col(key)
    above, below = (df.where(c).orderBy(*order).limit(each) for c in (F.col(score) >= threshold, F.col(score) < threshold))
    return above.union(below).withColumn("human_label", F.lit("")).orderBy(F.xxhash64(F.col(key), F.lit(seed + 1)), F.col(key))


def quota_sample(df: DataFrame, label: str, most: int = 200, floor: int = 10, key: str = "url", seed: int = 42) -> DataFrame:
    """A share of each label, ``floor`` at least where there are so many, cut to ``most`` rows.

    Quotas come from counts by label. No quota is over ``most``, so rows are first reduced to that many for each of 64
    hashed parts of a label, then ranked.
    """
    h, part = F.xxhash64(F.col(key), F.lit(seed)), F.pmod(F.xxhash64(F.col(key), F.lit(seed + 2)), F.lit(64))
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_all", F.sum("_n").over(Window.partitionBy())).withColumn("_quota", F.least("_n", F.greatest(F.lit(floor), F.floor(most * F.col("_n") / F.col("_all")))))
    some = df.withColumn("_h", h).withColumn("_part", part)
    some = some.withColumn("_r", F.row_number().over(Window.partitionBy(label, "_part").orderBy("_h", key))).where(F.col("_r") <= max(most, floor))
    some = some.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy("_h", key))).join(sizes.drop("_all", "_n"), label).where(F.col("_r") <= F.col("_quota"))
    return some.orderBy(F.xxhash64(F.col(key), F.lit(seed + 1)), F.col(key)).limit(most).drop("_h", "_part", "_r", "_quota").withColumn("human_label", F.lit(""))


def stance_sample(scored: DataFrame, stance: DataFrame, key: str = "url", order: str = "url", most: int = 200, floor: int = 10, seed: int = 42) -> DataFrame:
    """Judged articles with their bodies, drawn by stance label, with an empty column for a reader's label.

    An article that was never scored is not drawn. Only keys are joined before the draw; bodies are read for the rows drawn,
    each from the first scored row of its key by ``order``.
    """
    drawn = quota_sample(stance.join(scored.select(key), key, "left_semi"), "stance_label", most, floor, key, seed)
    bodies = first_rows(scored.join(drawn.select(key), key, "left_semi").select(*dict.fromkeys([key, "outlet", "body", order])), key, order)
    return drawn.join(bodies, key).select("outlet", key, "body", "pro_score", "anti_score", "stance_label", "human_label")


def top_by_size(df: DataFrame, value: str, n: int, *ties: str) -> DataFrame:
    """The ``n`` rows of the largest absolute value."""
    return df.orderBy(F.abs(F.col(value)).desc_nulls_last(), *ties).limit(n)
