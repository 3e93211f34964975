"""Trailing, expanding and adaptive windows, reflected sums and running maxima of a series column.

Every function takes Columns and returns a Column over windows partitioned by ``series_id`` and ordered by ``order`` (a total order), so
that all of them share one shuffle and one sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

KEY = "series_id"


def by(order: str = "t") -> WindowSpec:
    return Window.partitionBy(KEY).orderBy(order)


def upto(order: str = "t") -> WindowSpec:
    return by(order).rowsBetween(Window.unboundedPreceding, 0)


def trailing(w: int, order: str = "t") -> WindowSpec:
    return by(order).rowsBetween(-(w - 1), 0)


def roll(x: Column, w: int, order: str = "t") -> Column:
    """Mean of exactly w observations, else null."""
    over = trailing(w, order)
    return F.when(F.count(x).over(over) == w, F.sum(x).over(over) / F.lit(float(w)))


def expand(x: Column, order: str = "t") -> Column:
    return F.sum(x).over(upto(order)) / F.count(x).over(upto(order))


def prefix(x: Column, order: str = "t") -> Column:
    return F.sum(x).over(upto(order))


def adaptive(df: DataFrame, x: str, name: str, parts: int = 2, order: str = "t") -> DataFrame:
    """Mean over the last max((t + 1) div parts, 1) observations: a prefix sum less the one where the window begins."""
    held = df.withColumn("_c", prefix(F.col(x), order)).withColumn("_w", F.greatest(F.floor((F.col(order) + 1) / parts), F.lit(1)).cast("long"))
    start = held.select(F.col(KEY).alias("_k"), F.col(order).alias("_t"), F.col("_c").alias("_b"))
    joined = held.join(start, (F.col(KEY) == F.col("_k")) & (F.col(order) - F.col("_w") == F.col("_t")), "left")
    return joined.withColumn(name, (F.col("_c") - F.coalesce(F.col("_b"), F.lit(0))) / F.col("_w")).drop("_c", "_w", "_k", "_t", "_b")


def reflected(df: DataFrame, x: Column, name: str, order: str = "t") -> DataFrame:
    """C_t - min(0, C_0 .. C_t) of the running sums C."""
    held = df.withColumn("_c", prefix(x, order))
    return held.withColumn(name, F.col("_c") - F.least(F.lit(0).cast(held.schema["_c"].dataType), F.min("_c").over(upto(order)))).drop("_c")


def reflected_late(df: DataFrame, x: Column, name: str, order: str = "t") -> DataFrame:
    """C_t less the least of 0 and the earlier C's: unlike ``reflected`` it may fall below zero."""
    held = df.withColumn("_c", prefix(x, order))
    before = by(order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(held.schema["_c"].dataType)
    return held.withColumn(name, F.col("_c") - F.least(zero, F.coalesce(F.min("_c").over(before), zero))).drop("_c")


def cusum_pair(df: DataFrame, x: Column, k: Column, order: str = "t", up: str = "up", down: str = "down") -> DataFrame:
    return reflected(reflected(df, x - k, up, order), -x - k, down, order)


def page_hinkley(df: DataFrame, x: str, delta: float, up: str = "up", down: str = "down", order: str = "t") -> DataFrame:
    """Reflected sums of the deviation from the running mean, less delta, on either side."""
    held = df.withColumn("_d", F.col(x) - expand(F.col(x), order))
    return reflected(reflected(held, F.col("_d") - F.lit(delta), up, order), -F.col("_d") - F.lit(delta), down, order).drop("_d")


def glr_dyadic(df: DataFrame, x: str, top: int = 9, order: str = "t") -> DataFrame:
    """Over windows of 1, 2, 4 .. 2^top: ``best``, the largest S^2 / 2L, and ``mix``, the log of the mean exponential of them."""
    c = df.withColumn("_c", prefix(F.col(x), order)).withColumn("_k", F.count(x).over(upto(order)))
    made = {}
    for j in range(top + 1):  # window sums are differences of prefix sums: one frame, whatever the number of windows
        s = F.col("_c") - F.coalesce(F.lag("_c", 1 << j).over(by(order)), F.lit(0.0))
        made[f"_g{j}"] = F.when(F.col("_k") >= 1 << j, s * s / F.lit(2.0 * (1 << j)))
    held = c.withColumns(made).withColumn("best", F.greatest(*made) if top else F.col("_g0"))
    total = sum((F.coalesce(F.exp(F.col(g) - F.col("best")), F.lit(0.0)) for g in made), F.lit(0.0))
    n = sum((F.when(F.col(g).isNotNull(), 1.0).otherwise(0.0) for g in made), F.lit(0.0))
    return held.withColumn("mix", F.col("best") + F.ln(total / n)).drop("_c", "_k", *made)


def decayed_peak(x: Column, half_life: int = 64, order: str = "t") -> Column:
    """max over the past of x times 2^(-age / half_life), for x > 0, in logs."""
    rate = -0.6931471805599453 / half_life
    return F.exp(F.col(order) * rate + F.max(F.ln(x) - F.col(order) * rate).over(upto(order)))


def peak_shape(df: DataFrame, x: str, order: str = "t") -> DataFrame:
    """peak, time since the last peak, share of observations at half the running peak or more, slope over 16, and current over peak."""
    held = df.withColumn("peak", F.max(x).over(upto(order)))
    at = F.max(F.when(F.col(x) == F.col("peak"), F.col(order))).over(upto(order))
    return (
        held.withColumn("since_peak", F.col(order) - at)
        .withColumn("persistence", F.avg(F.when(F.col(x) >= 0.5 * F.col("peak"), 1.0).otherwise(0.0)).over(upto(order)))
        .withColumn("slope16", (F.col(x) - F.lag(x, 16).over(by(order))) / 16.0)
        .withColumn("rel_peak", F.when(F.col("peak") > 0, F.col(x) / F.col("peak")))
    )


def runs(df: DataFrame, flag: Column, name: str = "run", order: str = "t") -> DataFrame:
    """Length of the current run of true flags (0 where false)."""
    last = F.max(F.when(~flag, F.col(order))).over(upto(order))
    first = F.min(order).over(Window.partitionBy(KEY))
    return df.withColumn(name, F.when(flag, F.col(order) - F.coalesce(last, first - 1)).otherwise(F.lit(0)).cast("long"))
