"""Null calibration: how large a window statistic gets on the break-free history alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import roll

GRID = (5, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024)
FLOOR = 1e-12


def rolled(hist: DataFrame, x: str, grid: tuple[int, ...] = GRID, n_col: str | None = None, order: str = "i") -> DataFrame:
    """(series_id, w, v): the history's rolling means at every window of the grid up to half of its length."""
    wide = hist.select("series_id", order, *([n_col] if n_col else []), *[roll(F.col(x), w, order).alias(f"w{w}") for w in grid])
    cells = F.explode(F.array(*[F.struct(F.lit(w).cast("long").alias("w"), F.col(f"w{w}").alias("v")) for w in grid]))
    n = F.col(n_col) if n_col else F.count("*").over(Window.partitionBy("series_id"))
    return wide.withColumn("_n", n).select("series_id", "_n", cells.alias("c")).filter("c.v is not null and c.w * 2 <= _n").select("series_id", "c.w", "c.v")


def table(nulls: DataFrame) -> DataFrame:
    """mu = median and sd = max(IQR / 1.349, population sd, 1e-12) for each series and window."""
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = nulls.groupBy("series_id", "w").agg(F.count("*").alias("n"), q.alias("q"), F.stddev_pop("v").alias("s"))
    return g.select("series_id", "w", "n", F.col("q")[1].alias("mu"), F.greatest((F.col("q")[2] - F.col("q")[0]) / 1.349, F.col("s"), F.lit(FLOOR)).alias("sd"))


def percentiles(values: DataFrame, nulls: DataFrame, v: str = "v") -> DataFrame:
    """values (series_id, w, t, v) with pct = mid-rank among the nulls of the same series and window, by one window over both."""
    both = nulls.select("series_id", "w", F.lit(None).cast("long").alias("t"), F.col("v")).unionByName(values.select("series_id", "w", "t", F.col(v).alias("v")))
    null = F.when(F.col("t").isNull(), 1).otherwise(0)
    of = Window.partitionBy("series_id", "w")
    hi = F.sum(null).over(of.orderBy("v").rangeBetween(Window.unboundedPreceding, 0))
    same = F.sum(null).over(Window.partitionBy("series_id", "w", "v"))
    ranked = both.withColumn("hi", hi).withColumn("same", same).withColumn("n", F.sum(null).over(of))
    return ranked.filter("t is not null").select("series_id", "w", "t", "v", "n", (0.5 * (2 * F.col("hi") - F.col("same")) / F.col("n")).alias("pct"))


def surprise(pct: Column, n: Column) -> Column:
    """-log10 of the two-sided p-value, with a floor of 1 / 2n."""
    return -F.log10(F.greatest(2 * F.least(pct, 1 - pct), 1 / (2 * n)))


def interpolated_z(values: DataFrame, nulls: DataFrame, length: str, v: str, name: str = "z") -> DataFrame:
    """(v - mu(L)) / sd(L): mu linear and sd log-linear in log L between the grid's windows, flat outside. The grid has few rows for each
    series; each value meets only the brackets of its own series."""
    grid = nulls.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("w", "mu", "sd"))).alias("g"))
    j = values.join(grid, "series_id")
    length_c = F.greatest(F.least(F.col(length).cast("double"), F.element_at("g", -1)["w"].cast("double")), F.col("g")[0]["w"].cast("double"))
    below = F.filter("g", lambda s: s["w"] <= length_c)
    above = F.filter("g", lambda s: s["w"] >= length_c)
    j = j.withColumn("_a", F.element_at(below, -1)).withColumn("_b", F.element_at(above, 1)).withColumn("_l", length_c)
    span = F.ln(F.col("_b.w").cast("double")) - F.ln(F.col("_a.w").cast("double"))
    f = F.when(F.col("_a.w") == F.col("_b.w"), 0.0).otherwise((F.ln("_l") - F.ln(F.col("_a.w").cast("double"))) / span)
    mu = F.col("_a.mu") + f * (F.col("_b.mu") - F.col("_a.mu"))
    sd = F.exp(F.ln("_a.sd") + f * (F.ln("_b.sd") - F.ln("_a.sd")))
    return j.withColumn(name, (F.col(v) - mu) / sd).drop("g", "_a", "_b", "_l")
