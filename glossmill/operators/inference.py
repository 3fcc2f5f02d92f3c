"""Correlation, variance, regression and trend tests of aligned series, by group."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pvalues import correlation_p, f_two, student_t, t_quantile
from ..functions.text import stars
from ..shared import stored
from .order import quantiles, with_rank


def rank_correlation(df: DataFrame, x: str, y: str, keys: list[str], least: int = 5) -> DataFrame:
    """``keys, n, rho, p``: Spearman's correlation of pairs without nulls; null without variance, no row under ``least`` pairs.

    Equal pairs are counted before they are ranked. Ranks come from counts of values, so no group is sorted in one task. The pairs are
    written once: ranks are looked up by value, and means that are computed twice may differ in their last digits.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = stored(rows.groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_m")))
    ranked = with_rank(with_rank(pairs, "_x", keys, "rx", "_m", centred=True), "_y", keys, "ry", "_m", centred=True)
    a, b, m = F.col("rx"), F.col("ry"), F.col("_m")
    s = ranked.groupBy(*keys).agg(F.sum(m).alias("n"), F.sum(m * a * b).alias("ab"), F.sum(m * a * a).alias("aa"), F.sum(m * b * b).alias("bb"))
    s = s.withColumn("rho", F.try_divide(F.col("ab"), F.sqrt("aa") * F.sqrt("bb")))
    rho = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round("rho", 12)))
    s = s.where(F.col("n") >= least).select(*keys, "n", F.when(F.col("rho").isNotNull(), rho).alias("rho"))
    return s.withColumn("p", F.when(F.col("rho").isNotNull(), correlation_p(F.col("rho"), F.col("n"))))


def spearman(df: DataFrame, features: list[str], outcome: str, group: str = "outlet", least: int = 5) -> DataFrame:
    """Each feature of each group against the outcome, with rounded values and stars of the exact p."""
    long = df.unpivot([group, outcome], features, "feature", "value")
    found = rank_correlation(long, "value", outcome, [group, "feature"], least)
    return found.select(group, "feature", F.lit(outcome).alias("outcome"), "n", F.round("rho", 4).alias("rho"), F.round("p", 6).alias("p_value"), stars(F.col("p")).alias("sig"))


def tertile(x: Column, cuts: Column) -> Column:
    """Low, mid or high by two cuts, the lower side taking what is equal; null where the cuts or ends are equal."""
    return F.when(cuts[0] < cuts[1], F.when(x <= cuts[0], "low").when(x <= cuts[1], "mid").otherwise("high"))


def anova(df: DataFrame, features: list[str], outcome: str, group: str = "outlet", least: int = 9) -> DataFrame:
    """One-way analysis of each feature over tertiles of the outcome.

    Cuts come from all outcomes of a group, before null features are left out. Needs ``least``
    rows and three tertiles of two rows or more.
    """
    rows = df.where(F.col(outcome).isNotNull())
    cuts = quantiles(rows, outcome, [group], [0.0, 1 / 3, 2 / 3, 1.0])
    cuts = cuts.where((F.col("q")[0] < F.col("q")[1]) & (F.col("q")[2] < F.col("q")[3])).select(group, F.slice("q", 2, 2).alias("cuts"))
    tagged = rows.join(cuts, group).withColumn("tertile", tertile(F.col(outcome), F.col("cuts"))).where("tertile is not null")
    long = tagged.unpivot([group, "tertile"], features, "feature", "value").where("value is not null")
    cells = long.groupBy(group, "feature", "tertile").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    each = [F.max(F.when(F.col("tertile") == t, F.col(c))).alias(f"{c}_{t}") for t in ("low", "mid", "high") for c in ("n", "m", "v")]
    s = cells.groupBy(group, "feature").agg(F.sum("n").alias("n"), F.try_divide(F.sum(F.col("n") * F.col("m")), F.sum("n")).alias("mean"), F.min("n").alias("least"), F.count("*").alias("k"), F.sum((F.col("n") - 1) * F.col("v")).alias("ssw"), *each)
    s = s.where((F.col("n") >= least) & (F.col("least") >= 2) & (F.col("k") == 3))
    ssb = sum((F.col(f"n_{t}") * F.pow(F.col(f"m_{t}") - F.col("mean"), 2) for t in ("low", "mid", "high")), F.lit(0.0))
    s = s.withColumn("ssb", ssb).withColumn("mse", F.col("ssw") / (F.col("n") - 3)).withColumn("f", F.try_divide(F.col("ssb") / 2, F.col("mse")))
    p = f_two(F.col("f"), F.col("n") - 3)
    r = F.round
    means = [r(F.col(f"m_{t}"), 4).alias(f"mean_{t}") for t in ("low", "mid", "high")] + [r(F.sqrt(f"v_{t}"), 4).alias(f"sd_{t}") for t in ("low", "mid", "high")]
    return s.select(group, "feature", F.lit(outcome).alias("outcome"), "n", F.lit(2).alias("df_between"), (F.col("n") - 3).alias("df_within"), r("f", 4).alias("F"), r("mse", 6).alias("MSE"), r(F.try_divide("ssb", F.col("ssb") + F.col("ssw")), 4).alias("partial_eta_sq"), r(p, 6).alias("p_value"), stars(p).alias("sig"), *means)


def methodology_flag(methodology: Column, year: Column, change: int = 2020) -> Column:
    """1 under the later method, by its name, or by year where it has none."""
    return F.when(methodology.isNotNull(), (methodology == "LTIM").cast("int")).otherwise((year >= change).cast("int"))


def _regression(df: DataFrame, features: list[str], x1: str, x2: str, group: str, least: int) -> DataFrame:
    long = df.unpivot([group, x1, x2], features, "feature", "y").where(F.col("y").isNotNull() & F.col(x1).isNotNull() & F.col(x2).isNotNull())
    a, b, y = F.col(x1).cast("double"), F.col(x2).cast("double"), F.col("y").cast("double")
    pairs = {"s11": (a, a), "s22": (b, b), "s12": (a, b), "s1y": (a, y), "s2y": (b, y), "syy": (y, y)}
    s = long.groupBy(group, "feature").agg(F.count("*").alias("n"), F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.avg(y).alias("my"), *[(F.covar_pop(*v) * F.count("*")).alias(k) for k, v in pairs.items()])
    c = F.col
    det = c("s11") * c("s22") - c("s12") * c("s12")
    s = s.where(c("n") >= least).withColumn("det", F.when(det > 1e-12 * c("s11") * c("s22"), det))
    s = s.withColumn("b1", F.try_divide(c("s22") * c("s1y") - c("s12") * c("s2y"), c("det"))).withColumn("b2", F.try_divide(c("s11") * c("s2y") - c("s12") * c("s1y"), c("det")))
    s = s.withColumn("b0", c("my") - c("b1") * c("m1") - c("b2") * c("m2")).withColumn("sse", F.when(c("det").isNotNull(), F.greatest(F.lit(0.0), c("syy") - c("b1") * c("s1y") - c("b2") * c("s2y"))))
    s = s.withColumn("df", (c("n") - 3)).withColumn("s2", F.try_divide("sse", "df"))
    se = lambda v: F.sqrt(F.try_divide(c("s2") * v, c("det")))
    zero = F.sqrt(c("s2") * (1 / c("n") + F.try_divide(c("m1") * c("m1") * c("s22") - 2 * c("m1") * c("m2") * c("s12") + c("m2") * c("m2") * c("s11"), c("det"))))
    return s.withColumns({"se0": zero, "se1": se(c("s22")), "se2": se(c("s11")), "F": F.try_divide((c("syy") - c("sse")) / 2, c("s2"))})


def regression(df: DataFrame, features: list[str], x1: str = "net_migration", x2: str = "methodology_dummy", group: str = "outlet", least: int = 6) -> DataFrame:
    """Least squares of each feature on a constant and two regressors, in closed form from grouped sums.

    A singular system (a constant regressor) has null results.
    """
    s, c, r = _regression(df, features, x1, x2, group, least), F.col, F.round
    r2 = 1 - F.try_divide("sse", "syy")
    p, p1 = f_two(c("F"), c("df")), student_t(F.try_divide("b1", "se1"), c("df"))
    return s.select(group, "feature", "n", r(r2, 4).alias("r_squared"), r(1 - (1 - r2) * (c("n") - 1) / c("df"), 4).alias("adj_r_squared"), r("F", 4).alias("F"), F.lit(2).alias("df_model"), c("df").alias("df_resid"), r(p, 6).alias("model_p"), stars(p).alias("model_sig"), r("b1", 6).alias("x1_beta"), r(p1, 6).alias("x1_p"), stars(p1).alias("x1_sig"), F.coalesce(p1 < 0.05, F.lit(False)).alias("x1_survives"))


def coefficients(df: DataFrame, features: list[str], x1: str = "net_migration", x2: str = "methodology_dummy", group: str = "outlet", least: int = 6, most_df: int = 400) -> DataFrame:
    """A row for each coefficient: value, error, t, p, stars and 95 % interval.

    Quantiles come from a table of whole degrees of freedom up to ``most_df``; above it, from the
    normal quantile with its first corrections, which is exact to seven digits there.
    """
    s, c, r = _regression(df, features, x1, x2, group, least), F.col, F.round
    table = F.array(*[F.lit(t_quantile(k)) for k in range(1, most_df + 1)])
    z = 1.959963984540054
    far = z + (z**3 + z) / 4 / c("df") + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / c("df") ** 2
    crit = F.when(c("df") <= most_df, F.get(table, (c("df") - 1).cast("int"))).otherwise(far)
    terms = F.array(*[F.struct(F.lit(t).alias("term"), c(f"b{i}").alias("b"), c(f"se{i}").alias("se")) for i, t in enumerate(("const", x1, x2))])
    rows = s.select(group, "feature", "df", F.explode(terms).alias("t")).select(group, "feature", "df", "t.*")
    t = F.try_divide("b", "se")
    p = student_t(t, c("df"))
    return rows.select(group, "feature", "term", r("b", 6).alias("beta"), r("se", 6).alias("std_err"), r(t, 4).alias("t"), r(p, 6).alias("p"), stars(p).alias("sig"), r(c("b") - crit * c("se"), 6).alias("ci_low"), r(c("b") + crit * c("se"), 6).alias("ci_high"))


def detrended(df: DataFrame, value: str, keys: list[str], order: list[str], least: int = 0) -> DataFrame:
    """``_t``, the place in the order among rows with a value, and ``<value>_detrended``, what a line over it leaves."""
    rows = df.where(F.col(value).isNotNull())
    rows = rows if "_t" in df.columns else rows.withColumn("_t", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    w = Window.partitionBy(*keys)
    line = F.regr_intercept(F.col(value), F.col("_t")).over(w) + F.regr_slope(F.col(value), F.col("_t")).over(w) * F.col("_t")
    return rows.withColumn(f"{value}_detrended", F.when(F.count("*").over(w) >= least, F.round(F.col(value) - line, 9)))


def differenced(df: DataFrame, values: list[str], keys: list[str], order: list[str]) -> DataFrame:
    """``<value>_diff``: the change from the row before; the first rows go, gaps in time don't matter."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_i", F.row_number().over(w)).withColumns({f"{v}_diff": F.col(v) - F.lag(v).over(w) for v in values}).where("_i > 1").drop("_i")


def benjamini_hochberg(df: DataFrame, p: str, ties: list[str], family: list[str] | None = None, nan_policy: str = "omit") -> DataFrame:
    """``q``: the least ``p * n / rank`` from a p upwards, at most 1, within a family.

    Null p-values are left out and have a null q; with ``nan_policy="last"`` they count as the
    largest and have q 1. A family is a table of test results, so one task ranks it.
    """
    keys = family or []
    known = F.col(p).isNotNull()
    n = F.count(F.when(known, 1) if nan_policy == "omit" else F.lit(1)).over(Window.partitionBy(*keys))
    up = Window.partitionBy(*keys).orderBy(F.col(p).asc_nulls_last(), *ties)
    rows = df.withColumn("_k", F.row_number().over(up)).withColumn("_v", F.when(known, F.col(p) * n / F.col("_k")))
    q = F.least(F.lit(1.0), F.min("_v").over(up.rowsBetween(0, Window.unboundedFollowing)))
    return rows.withColumn("q", F.when(known, F.round(q * 1e6) / 1e6).otherwise(F.lit(None) if nan_policy == "omit" else F.lit(1.0))).drop("_k", "_v")


def most_lags(n: Column) -> Column:
    """As many lags as a series of ``n`` values is tried with; below 0: too few values."""
    return F.least(F.ceil(12 * F.pow(n / 100.0, 0.25)), F.floor(n / 2) - 2).cast("int")


def _mackinnon(tau: float) -> float:
    """Published response surface for a constant and one series."""
    import math

    if tau > 2.74:
        return 1.0
    if tau < -18.83:
        return 0.0
    small = 2.1659 + 1.4412 * tau + 0.038269 * tau**2
    large = 1.7339 + 0.93202 * tau - 0.12745 * tau**2 - 0.010368 * tau**3
    return 0.5 * math.erfc(-(small if tau <= -1.61 else large) / math.sqrt(2))


def _unit_root(moments, heads: list, rows: int, most: int) -> float | None:  # noqa: ANN001
    """p of a series from the cross-products of its rows: 1, the value before, the change, and the ``most`` changes before that.

    ``moments`` are of the rows that have all of them, ``rows`` many; ``heads`` are the rows before these, a change longer each. All
    numbers of lags are solved from leading blocks of one matrix; the chosen one also takes the heads that are long enough.
    """
    import math

    import numpy as np

    def fit(m, count: int, lags: int) -> tuple[float, float]:  # noqa: ANN001
        x = [0, 1, *range(3, 3 + lags)]
        if count <= len(x):
            return math.inf, math.nan
        inverse = np.linalg.pinv(m[np.ix_(x, x)])
        beta = inverse @ m[x, 2]
        sse = float(m[2, 2] - m[x, 2] @ beta)
        if sse <= 1e-13 * float(m[2, 2]):
            return math.inf, math.nan
        se = math.sqrt(sse / (count - len(x)) * inverse[1, 1]) if inverse[1, 1] > 0 else 0.0
        return count * (math.log(2 * math.pi * sse / count) + 1) + 2 * len(x), float(beta[1] / se) if se else math.nan

    lags = min(range(most + 1), key=lambda k: fit(moments, rows, k)[0])
    size = 3 + lags
    more = [np.asarray(h[:size]) for h in heads if len(h) >= size]
    last = moments[:size, :size] + (sum(np.outer(h, h) for h in more) if more else 0)
    tau = fit(last, rows + len(more), lags)[1]
    return None if math.isnan(tau) else _mackinnon(tau)


def adf(df: DataFrame, value: str, group: str, order: list[str]) -> DataFrame:
    """``group, n, adf_p``: the unit-root test of each group's series, with a constant, lags by AIC; null under 8 values or without variance.

    A series is walked in order once, with as many changes back as it is tried with; tasks sum cross-products as they go, and what
    is shuffled and solved is a matrix for each group and task, never a series. Values are centred and scaled first, which leaves the
    test as it is.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"), F.struct(*order).alias("o"))
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"), F.avg("v").alias("mid"), F.stddev_pop("v").alias("wide"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    sizes = sizes.withColumn("most", most_lags(F.col("n")))
    tried = sizes.where((F.col("n") >= 8) & (F.col("most") >= 0) & (F.col("lo") < F.col("hi")) & (F.col("wide") > 0))
    longest = tried.agg(F.max("most")).first()[0] or 0
    r, t = rows.alias("r"), tried.alias("t")
    scaled = r.join(t, F.col("r.g").eqNullSafe(F.col("t.g"))).select("r.g", "o", "most", ((F.col("v") - F.col("mid")) / F.col("wide")).alias("y"))
    w = Window.partitionBy("g").orderBy("o")
    changes = scaled.withColumns({"before": F.lag("y").over(w)}).withColumn("change", F.col("y") - F.col("before"))
    # newest first: the change itself and those before it, as many as there are up to the group's lags
    back = F.reverse(F.collect_list("change").over(w.rowsBetween(-longest, 0)))
    vectors = changes.withColumn("back", F.slice(back, F.lit(1), F.col("most") + 1)).where("before is not null").select("g", "most", F.concat(F.array(F.lit(1.0), F.col("before")), "back").alias("x"))

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            whole = batch["x"].map(len) == batch["most"] + 3
            out = [(g, most, x, 0) for g, most, x in zip(batch["g"][~whole], batch["most"][~whole], batch["x"][~whole])]
            for (g, most), some in batch[whole].groupby(["g", "most"], dropna=False):
                m = np.stack(some["x"].to_numpy())
                out.append((None if pd.isna(g) else g, most, (m.T @ m).ravel(), len(m)))
            yield pd.DataFrame(out, columns=["g", "most", "x", "k"])

    parts = vectors.mapInPandas(summed, f"g {rows.schema['g'].dataType.simpleString()}, most int, x array<double>, k long")

    @F.pandas_udf("double")
    def solved(heads: pd.Series, sums: pd.Series, counts: pd.Series, mosts: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for head, some, k, most in zip(heads, sums, counts, mosts):
            size = most + 3
            out.append(_unit_root(np.sum(np.stack(some), axis=0).reshape(size, size), list(head), int(k), int(most)) if len(some) else None)
        return pd.Series(out, dtype="float64")

    part = F.col("k") > 0
    found = parts.groupBy("g", "most").agg(F.collect_list(F.when(~part, F.col("x"))).alias("h"), F.collect_list(F.when(part, F.col("x"))).alias("m"), F.sum("k").alias("k"))
    found = found.select(F.col("g").alias("_g"), F.round(solved("h", "m", "k", "most"), 6).alias("adf_p"))
    return sizes.join(found, F.col("g").eqNullSafe(F.col("_g")), "left").select(F.col("g").alias(group), "n", "adf_p")


def trend_robust(df: DataFrame, value: str, outcome: str, group: str, order: list[str]) -> DataFrame:
    """Raw, detrended and first-difference correlations of each group, with unit-root tests and q-values.

    Groups of fewer than five pairs have no row. A correlation that isn't there (no variance, too few changes) has null figures and
    no stars. A q-value of exactly 0.05 survives.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(outcome).isNotNull())
    raw = rank_correlation(rows, value, outcome, [group])
    flat = detrended(detrended(rows, value, [group], order), outcome, [group], order)
    flat = rank_correlation(flat, f"{value}_detrended", f"{outcome}_detrended", [group])
    diff = rank_correlation(differenced(rows, [value, outcome], [group], order), f"{value}_diff", f"{outcome}_diff", [group])
    named = lambda d, k: d.select(group, F.round("rho", 4).alias(f"rho_{k}"), F.round("p", 6).alias(f"p_{k}"), stars(F.col("p")).alias(f"sig_{k}"))
    out = raw.select(group, "n").join(named(raw, "raw"), group).join(named(flat, "detrended"), group, "left").join(named(diff, "first_diff"), group, "left")
    out = out.join(adf(rows, value, group, order).select(group, F.col("adf_p").alias("adf_p_value")), group, "left").join(adf(rows, outcome, group, order).select(group, F.col("adf_p").alias("adf_p_outcome")), group, "left")
    out = out.withColumns({f"sig_{k}": F.coalesce(f"sig_{k}", F.lit("")) for k in ("raw", "detrended", "first_diff")})
    for k in ("raw", "detrended"):
        out = benjamini_hochberg(out, f"p_{k}", [group]).withColumnRenamed("q", f"q_{k}_fdr").withColumn(f"{k}_survives_fdr", F.coalesce(F.col(f"q_{k}_fdr") <= 0.05, F.lit(False)))
    return out


def subcategory_family(df: DataFrame, features: list[str], outcome: str, group: str, order: list[str], least: int = 5) -> DataFrame:
    """Each feature of each group against the outcome, as it is and with a line over time taken off both, as one family of tests.

    Rows without an outcome are left out, and ``n`` counts the others of a group; time is their place in the order. Values
    that are null don't enter a correlation. ``q_raw_fdr`` comes from the raw p-values to six places, over all groups and features.
    """
    rows = df.where(F.col(outcome).isNotNull()).withColumn("_t", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)
    sizes = rows.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    flat = detrended(rows, outcome, [group], order)
    long = flat.unpivot([group, "_t", outcome, f"{outcome}_detrended"], features, "subcategory", "value")
    keys = [group, "subcategory"]

    def named(found: DataFrame, kind: str) -> DataFrame:
        return found.select(*keys, F.round("rho", 4).alias(f"rho_{kind}"), F.round("p", 6).alias(f"p_{kind}"), stars(F.col("p")).alias(f"sig_{kind}"))

    raw = named(rank_correlation(long, "value", outcome, keys, least), "raw")
    line = named(rank_correlation(detrended(long, "value", keys, order), "value_detrended", f"{outcome}_detrended", keys, least), "detrended")
    both = raw.join(line, keys, "left").join(sizes, group).withColumn("sig_detrended", F.coalesce("sig_detrended", F.lit("")))
    tested = benjamini_hochberg(both, "p_raw", keys).withColumnRenamed("q", "q_raw_fdr")
    return tested.withColumn("survives_fdr", F.coalesce(F.col("q_raw_fdr") <= 0.05, F.lit(False)))
