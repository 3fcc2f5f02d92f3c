"""P-values as column expressions, from the finite series for whole degrees of freedom."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def student_t(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t; null where ``t`` is null or ``df`` < 1."""
    angle = F.atan(F.try_divide(F.abs(t), F.sqrt(df.cast("double"))))
    sin, cos = F.sin(angle), F.cos(angle)
    even = df % 2 == 0
    last = F.when(even, F.floor((df - 2) / 2)).otherwise(F.floor((df - 3) / 2)).cast("int")
    start = F.struct(F.when(even, F.lit(1.0)).otherwise(cos).alias("c"), F.lit(0.0).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        grow = F.when(even, (2 * i + 1) / (2 * i + 2)).otherwise((2 * i + 2) / (2 * i + 3))
        return F.struct((s["c"] * grow * cos * cos).alias("c"), (s["sum"] + s["c"]).alias("sum"))

    total = F.aggregate(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), start, step)["sum"]
    inside = F.when(df == 1, 2 * angle / math.pi).when(even, sin * total).otherwise(2 / math.pi * (angle + sin * total))
    return F.when(t.isNotNull() & (df >= 1), F.greatest(F.lit(0.0), 1 - inside))


def f_two(f: Column, df2: Column) -> Column:
    """Upper tail of F with 2 and ``df2`` degrees of freedom."""
    return F.when(df2 >= 1, F.pow(1 + 2 * f / df2, -df2 / 2.0))


def correlation_p(rho: Column, n: Column) -> Column:
    """Two-sided p of a correlation over ``n`` pairs; 0 where it is complete."""
    t = rho * F.sqrt(F.try_divide((n - 2).cast("double"), (1 - rho) * (1 + rho)))
    return F.when(F.abs(rho) >= 1, 0.0).otherwise(student_t(t, n - 2))


def t_quantile(df: int, p: float = 0.975) -> float:
    """Quantile of Student's t by bisection on its finite series; for a table of few degrees of freedom."""

    def upto(t: float) -> float:
        angle = math.atan(t / math.sqrt(df))
        c, total, k = (1.0 if df % 2 == 0 else math.cos(angle)), 0.0, (df - 2) // 2 if df % 2 == 0 else (df - 3) // 2
        for i in range(k + 1):
            total += c
            c *= ((2 * i + 1) / (2 * i + 2) if df % 2 == 0 else (2 * i + 2) / (2 * i + 3)) * math.cos(angle) ** 2
        if df == 1:
            return 0.5 + angle / math.pi
        return 0.5 + (math.sin(angle) * total / 2 if df % 2 == 0 else (angle + math.sin(angle) * total) / math.pi)

    low, high = 0.0, 1e5
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if upto(mid) < p else (low, mid)
    return (low + high) / 2
