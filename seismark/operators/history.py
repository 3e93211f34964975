"""What a series' break-free history says about it: one row for each series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 1e-9
QUANTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99)


def moments(hist: DataFrame) -> DataFrame:
    """n, mu, sd (n - 1 in the denominator, floored) from exact integer sums."""
    s = hist.groupBy("series_id").agg(F.count("*").alias("n"), F.sum("cents").alias("s1"), F.sum(F.col("cents") * F.col("cents")).alias("s2"))
    mean = F.col("s1").cast("double") / F.col("n")
    var = (F.col("s2").cast("double") - F.col("s1").cast("double") * F.col("s1").cast("double") / F.col("n")) / (F.col("n") - 1)
    return s.select("series_id", "n", (mean / 100.0).alias("mu"), F.greatest(F.sqrt(F.greatest(var, F.lit(0.0))) / 100.0, F.lit(FLOOR)).alias("sd"))


def parameters(hist: DataFrame) -> DataFrame:
    """Moments, linear quantiles, interquartile range and scaled median absolute deviation."""
    q = hist.groupBy("series_id").agg(F.percentile("x", F.array(*[F.lit(p / 100) for p in QUANTILES])).alias("q"))
    named = q.select("series_id", *[F.col("q")[k].alias(f"q{p:02d}") for k, p in enumerate(QUANTILES)])
    mad = hist.join(named.select("series_id", "q50"), "series_id").groupBy("series_id").agg(F.percentile(F.abs(F.col("x") - F.col("q50")), F.lit(0.5)).alias("m"))
    out = moments(hist).join(named, "series_id").join(mad, "series_id")
    return out.withColumn("mad", F.greatest(F.col("m") * 1.4826, F.lit(FLOOR))).withColumn("iqr", F.greatest(F.col("q75") - F.col("q25"), F.lit(FLOOR))).drop("m")


def pit(online: DataFrame, hist: DataFrame) -> DataFrame:
    """u = (mid-rank among the history + 0.5) / (n + 1). Ranks come from one window over both together: no pairs are made."""
    both = hist.select("series_id", "cents", F.lit(None).cast("long").alias("t")).unionByName(online.select("series_id", "cents", "t"))
    h = F.when(F.col("t").isNull(), 1).otherwise(0)
    value = Window.partitionBy("series_id").orderBy("cents")
    ranked = both.withColumn("hi", F.sum(h).over(value.rangeBetween(Window.unboundedPreceding, 0))).withColumn("same", F.sum(h).over(Window.partitionBy("series_id", "cents"))).withColumn("n", F.sum(h).over(Window.partitionBy("series_id")))
    lo = F.col("hi") - F.col("same")
    return ranked.filter("t is not null").select("series_id", "t", ((0.5 * (lo + F.col("hi")) + 0.5) / (F.col("n") + 1)).alias("u"))


def ar1(obs: DataFrame, x: str = "z", order: str = "i", ridge: float = 1e-6, least: int = 20) -> DataFrame:
    """Least-squares AR(1) without intercept with ridge * n; 0 for histories under ``least`` points."""
    pairs = obs.withColumn("_l", F.lag(x).over(Window.partitionBy("series_id").orderBy(order)))
    s = pairs.groupBy("series_id").agg(F.count("*").alias("n"), F.sum(F.col(x) * F.col("_l")).alias("xy"), F.sum(F.when(F.col("_l").isNotNull(), F.col("_l") * F.col("_l"))).alias("yy"))
    return s.select("series_id", F.when(F.col("n") < least, 0.0).otherwise(F.col("xy") / (F.col("yy") + ridge * F.col("n"))).alias("phi"))


def ar2(obs: DataFrame, x: str = "z", order: str = "i", ridge: float = 1e-6, least: int = 30) -> DataFrame:
    """Least-squares AR(2) in closed form."""
    w = Window.partitionBy("series_id").orderBy(order)
    p = obs.withColumn("a", F.lag(x, 1).over(w)).withColumn("b", F.lag(x, 2).over(w)).filter("b is not null")
    s = p.groupBy("series_id").agg(F.count("*").alias("m"), *[F.sum(F.col(c) * F.col(d)).alias(c + d) for c, d in (("a", "a"), ("a", "b"), ("b", "b"))], F.sum(F.col(x) * F.col("a")).alias("xa"), F.sum(F.col(x) * F.col("b")).alias("xb"))
    n = F.col("m") + 2
    aa, bb, ab = F.col("aa") + ridge * n, F.col("bb") + ridge * n, F.col("ab")
    det = aa * bb - ab * ab
    fit = lambda num: F.when(n < least, 0.0).otherwise(num / det)
    return s.select("series_id", fit(F.col("xa") * bb - F.col("xb") * ab).alias("phi1"), fit(F.col("xb") * aa - F.col("xa") * ab).alias("phi2"))


def arp(obs: DataFrame, p: int, x: str = "z", order: str = "i", ridge: float = 1e-6) -> DataFrame:
    """Least-squares AR(p) without intercept, ridge * pairs on the diagonal: phi1 .. phip, 0 for histories under 10 p + 10 points. The normal equations are sums, and
    are solved by elimination in columns (they are positive definite, so no pivots are chosen)."""
    w = Window.partitionBy("series_id").orderBy(order)
    lagged = obs.withColumns({f"_l{j}": F.lag(x, j).over(w) for j in range(1, p + 1)}).filter(F.col(f"_l{p}").isNotNull())
    names = [f"_l{j}" for j in range(1, p + 1)]
    sums = {f"a{i}{j}": F.sum(F.col(names[i]) * F.col(names[j])) for i in range(p) for j in range(i, p)} | {f"b{i}": F.sum(F.col(names[i]) * F.col(x)) for i in range(p)}
    g = lagged.groupBy("series_id").agg(F.count("*").alias("m"), *[c.alias(n) for n, c in sums.items()])
    g = g.withColumns({f"a{i}{i}": F.col(f"a{i}{i}") + ridge * F.col("m") for i in range(p)})
    for k in range(p - 1):
        share = lambda i, k=k: F.col(f"a{k}{i}") / F.col(f"a{k}{k}")  # noqa: E731  the matrix stays symmetric: its upper half is enough
        g = g.withColumns({f"a{i}{j}": F.col(f"a{i}{j}") - share(i) * F.col(f"a{k}{j}") for i in range(k + 1, p) for j in range(i, p)} | {f"b{i}": F.col(f"b{i}") - share(i) * F.col(f"b{k}") for i in range(k + 1, p)})
    for i in reversed(range(p)):
        g = g.withColumn(f"b{i}", (F.col(f"b{i}") - sum((F.col(f"a{i}{j}") * F.col(f"b{j}") for j in range(i + 1, p)), F.lit(0.0))) / F.col(f"a{i}{i}"))
    return g.select("series_id", *[F.when(F.col("m") + p < 10 * p + 10, 0.0).otherwise(F.col(f"b{i}")).alias(f"phi{i + 1}") for i in range(p)])


def residuals(obs: DataFrame, fit: DataFrame, x: str = "z", order: str = "i") -> DataFrame:
    """z_t - phi z_{t-1} along history and online rows together, so that online rows are warmed by the history."""
    lagged = obs.withColumn("_l", F.lag(x).over(Window.partitionBy("series_id").orderBy(order)))
    return lagged.join(fit, "series_id").withColumn("e", F.col(x) - F.col("phi") * F.coalesce(F.col("_l"), F.lit(0.0))).drop("_l")


def standardise(obs: DataFrame, params: DataFrame) -> DataFrame:
    return obs.join(params.select("series_id", "mu", "sd"), "series_id").withColumn("z", (F.col("x") - F.col("mu")) / F.col("sd"))


def transforms(obs: DataFrame, params: DataFrame, order: str = "t") -> dict[str, Column]:
    """The per-point columns, over ``obs`` joined with ``params`` (and u, e where present)."""
    del obs, params
    w = Window.partitionBy("series_id").orderBy(order)
    z, x = F.col("z"), F.col("x")
    clip = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    r = (x - F.col("q50")) / F.col("mad")
    lag = lambda c, k: F.coalesce(c * F.lag(c, k).over(w), F.lit(0.0))
    return {
        "mean": z, "sq": z * z, "abs": F.abs(z), "rmean": r, "rabs": F.abs(r),
        "tail_hi": flag(x > F.col("q95")), "tail_lo": flag(x < F.col("q05")), "tail_x": flag((x > F.col("q99")) | (x < F.col("q01"))), "center": flag((x > F.col("q25")) & (x < F.col("q75"))),
        "sign": F.signum(z), "cube": clip * clip * clip, "quart": clip * clip * clip * clip, "logabs": F.ln(F.abs(z) + 1e-3),
        "lag1": lag(z, 1), "lag2": lag(z, 2), "abslag1": lag(F.abs(z), 1),
    }
