"""Causal monitors stated as window arithmetic: occupancy distances, dependence, spectra, wavelets, ordinal patterns, likelihood ratios,
betting processes. Columns over windows by series; integers wherever the data allow."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import by, trailing, upto


def occupancy(df: DataFrame, edges: DataFrame, bins: int, window: int, x: str = "cents", order: str = "t") -> DataFrame:
    """Counts of the trailing window in ``bins`` bins whose inner edges (array ``edges``) come with each series."""
    j = df.join(edges, "series_id")
    b = F.aggregate("edges", F.lit(0), lambda acc, e: acc + F.when(F.col(x) > e, 1).otherwise(0))
    over = trailing(window, order)
    held = j.withColumn("bin", b).withColumn("n", F.count("*").over(over))
    return held.withColumns({f"b{k}": F.sum(F.when(F.col("bin") == k, 1).otherwise(0)).over(over) for k in range(bins)}).drop("edges")


def divergences(bins: int) -> dict[str, Column]:
    """Distances of occupancies b0.. (of n) to the uniform law: chi2, ks * sqrt(w), cvm * w / B, w1, js, hellinger, tv, entropy, maxdev."""
    n = F.col("n").cast("double")
    p = [F.col(f"b{k}") / n for k in range(bins)]
    u = 1.0 / bins
    total = lambda xs: sum(xs[1:], xs[0])
    cum, run = [], F.lit(0.0)
    for k in range(bins):
        run = run + p[k]
        cum.append(run - (k + 1) * u)
    xlogx = lambda a, b: F.when(a > 0, a * F.ln(a / b)).otherwise(0.0)
    mid = [(q + u) / 2 for q in p]
    return {
        "chi2": total([(q - u) * (q - u) / u for q in p]) * n,
        "ks": F.greatest(*[F.abs(c) for c in cum]) * F.sqrt(n),
        "cvm": total([c * c for c in cum]) * n / bins,
        "w1": total([F.abs(c) for c in cum]) / bins,
        "js": total([0.5 * xlogx(q, m) + 0.5 * u * F.ln(u / m) for q, m in zip(p, mid, strict=True)]),
        "hellinger": F.sqrt(F.greatest(1 - total([F.sqrt(q * u) for q in p]), F.lit(0.0))),
        "tv": 0.5 * total([F.abs(q - u) for q in p]),
        "entropy": -total([F.when(q > 0, q * F.ln(q)).otherwise(0.0) for q in p]) / math.log(bins),
        "maxdev": F.greatest(*[F.abs(q - u) for q in p]),
    }


def relative_distances(bins: int) -> dict[str, Column]:
    """The unscaled set: ks without sqrt(w), and an energy distance of twice the squared cumulative gaps' mean."""
    d = divergences(bins)
    n = F.col("n").cast("double")
    return {"rd_ks": d["ks"] / F.sqrt(n), "rd_ene": 2 * d["cvm"] / n, "rd_tv": d["tv"], "rd_w1": d["w1"]}


def lagged_sums(x: Column, lag: int, window: int, order: str = "t") -> tuple[Column, Column]:
    """(sum of x_t x_{t-lag}, sum of x_t^2) over the window."""
    over = trailing(window, order)
    return F.sum(x * F.lag(x, lag).over(by(order))).over(over), F.sum(x * x).over(over)


def autocorrelation(df: DataFrame, x: str, lags: tuple[int, ...], window: int, order: str = "t") -> DataFrame:
    w = by(order)
    held = df.withColumns({f"_p{k}": F.col(x) * F.lag(x, k).over(w) for k in lags})
    over = trailing(window, order)
    full = F.count("*").over(over) == window
    q = F.sum(F.col(x) * F.col(x)).over(over)
    return held.withColumns({f"acf{k}": F.when(full & (q > 0), F.sum(f"_p{k}").over(over) / q) for k in lags}).drop(*[f"_p{k}" for k in lags])


def variance_ratio(df: DataFrame, x: str, q: int, window: int, order: str = "t") -> DataFrame:
    """Mean square of q-sums over q times the mean square of single values, in the window."""
    held = df.withColumn("_q", F.when(F.count(x).over(trailing(q, order)) == q, F.sum(x).over(trailing(q, order))))
    over = trailing(window, order)
    full = F.count("_q").over(over) == window
    return held.withColumn("vr", F.when(full & (F.sum(F.col(x) * F.col(x)).over(over) > 0), F.sum(F.col("_q") * F.col("_q")).over(over) / (F.lit(float(q)) * F.sum(F.col(x) * F.col(x)).over(over)))).drop("_q")


def drift(df: DataFrame, x: str, window: int, order: str = "t") -> DataFrame:
    """Least-squares slope against time in the window, from sums of x and t x."""
    over = trailing(window, order)
    held = df.withColumn("_tx", F.col(order) * F.col(x))
    n, mid = float(window), F.col(order) - (window - 1) / 2.0
    sxx = n * (n * n - 1) / 12
    return held.withColumn("slope", F.when(F.count(x).over(over) == window, (F.sum("_tx").over(over) - mid * F.sum(x).over(over)) / sxx)).drop("_tx")


def mann_kendall(df: DataFrame, x: str, lag: int, window: int, order: str = "t") -> DataFrame:
    """Mean sign of x_t - x_{t-lag} in the window."""
    held = df.withColumn("_s", F.signum((F.col(x) - F.lag(x, lag).over(by(order))).cast("double")))
    over = trailing(window, order)
    return held.withColumn("mk", F.when(F.count("_s").over(over) == window, F.sum("_s").over(over) / float(window))).drop("_s")


def band_power(df: DataFrame, x: str, window: int, freqs: tuple[float, ...], order: str = "t") -> DataFrame:
    """Periodogram of the window at fixed frequencies (cycles per step)."""
    over = trailing(window, order)
    made = {}
    for k, f in enumerate(freqs):
        c = F.sum(F.col(x) * F.cos(F.lit(2 * math.pi * f) * F.col(order))).over(over)
        s = F.sum(F.col(x) * F.sin(F.lit(2 * math.pi * f) * F.col(order))).over(over)
        made[f"pw{k}"] = F.when(F.count(x).over(over) == window, (c * c + s * s) / float(window))
    return df.withColumns(made)


def haar(df: DataFrame, x: str, scale: int, window: int, order: str = "t") -> DataFrame:
    """Windowed mean of squared Haar details: (sum of the last s - sum of the s before) squared, over 2 s."""
    a, b = F.sum(x).over(trailing(scale, order)), F.sum(x).over(trailing(2 * scale, order))
    full = F.count(x).over(trailing(2 * scale, order)) == 2 * scale
    held = df.withColumn("_d", F.when(full, (2 * a - b) * (2 * a - b) / F.lit(2.0 * scale)))
    over = trailing(window, order)
    return held.withColumn(f"haar{scale}", F.when(F.count("_d").over(over) == window, F.sum("_d").over(over) / float(window))).drop("_d")


def ordinal_code(x: str, order: str = "t") -> Column:
    """4 (a > b) + 2 (a > c) + (b > c) of three consecutive values, oldest first; ties count as not greater."""
    w = by(order)
    a, b, c = F.lag(x, 2).over(w), F.lag(x, 1).over(w), F.col(x)
    bit = lambda cond, v: F.when(cond, v).otherwise(0)
    return F.when(a.isNotNull(), bit(a > b, 4) + bit(a > c, 2) + bit(b > c, 1))


CODES = (0, 1, 3, 4, 6, 7)


def ordinal_entropy(df: DataFrame, x: str, window: int, order: str = "t") -> DataFrame:
    held = df.withColumn("_o", ordinal_code(x, order))
    over = trailing(window, order)
    held = held.withColumns({f"_n{c}": F.sum(F.when(F.col("_o") == c, 1).otherwise(0)).over(over) for c in CODES})
    n = float(window)
    h = sum((F.when(F.col(f"_n{c}") > 0, -(F.col(f"_n{c}") / n) * F.ln(F.col(f"_n{c}") / n)).otherwise(0.0) for c in CODES), F.lit(0.0))
    return held.withColumn("entropy", F.when(F.count("_o").over(over) == window, h / math.log(6))).drop("_o", *[f"_n{c}" for c in CODES])


def transition_kl(df: DataFrame, x: str, alpha: float = 0.5, order: str = "t") -> DataFrame:
    """Per series: divergence of consecutive-pattern transition counts from their time reversal, with pseudo-count alpha."""
    w = by(order)
    o = df.withColumn("_o", ordinal_code(x, order))
    o = o.withColumn("_p", F.lag("_o").over(w)).filter("_p is not null")
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in CODES for b in CODES]))
    full = o.select("series_id").distinct().select("series_id", grid.alias("g")).select("series_id", "g.a", "g.b")
    n = o.groupBy("series_id", F.col("_p").alias("a"), F.col("_o").alias("b")).agg(F.count("*").alias("n"))
    cell = full.join(n, ["series_id", "a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + alpha)
    back = cell.select("series_id", F.col("a").alias("b"), F.col("b").alias("a"), F.col("n").alias("m"))
    j = cell.join(back, ["series_id", "a", "b"]).withColumn("s", F.sum("n").over(Window.partitionBy("series_id")))
    return j.groupBy("series_id").agg(F.sum(F.col("n") / F.col("s") * F.ln(F.col("n") / F.col("m"))).alias("kl"))


def third_moment_asymmetry(df: DataFrame, x: str, window: int, order: str = "t") -> DataFrame:
    """Sum of cubed differences over the 3/2 power of the sum of their squares, in the window."""
    held = df.withColumn("_d", (F.col(x) - F.lag(x).over(by(order))).cast("double"))
    over = trailing(window, order)
    q = F.sum(F.col("_d") * F.col("_d")).over(over)
    return held.withColumn("asym", F.when((F.count("_d").over(over) == window) & (q > 0), F.sum(F.col("_d") * F.col("_d") * F.col("_d")).over(over) / F.pow(q, F.lit(1.5)))).drop("_d")


def dependence_lr(df: DataFrame, z: str, window: int, order: str = "t") -> DataFrame:
    """m ln(base / free): the AR(1) likelihood ratio with the variance profiled out, from three windowed sums over the window's pairs."""
    held = df.withColumn("_y", F.lag(z).over(by(order)))
    over = trailing(window, order)
    pair = F.when(F.col("_y").isNotNull(), F.col(z))
    xx, yy, xy = F.sum(pair * pair).over(over), F.sum(F.col("_y") * F.col("_y")).over(over), F.sum(F.col(z) * F.col("_y")).over(over)
    m = F.count("_y").over(over)
    return held.withColumn("dep_lr", F.when((m == window) & (yy > 0), m * F.ln(xx / F.greatest(xx - xy * xy / yy, xx * 1e-9)))).drop("_y")


def llr_monitor(df: DataFrame, z: str, window: int, order: str = "t", least: int = 8) -> DataFrame:
    """q - ln(max(q - m^2, 1e-6)) - 1 of the window's mean m and mean square q."""
    over = trailing(window, order)
    n = F.count(z).over(over)
    m, q = F.sum(z).over(over) / n, F.sum(F.col(z) * F.col(z)).over(over) / n
    return df.withColumn("llr", F.when(n >= least, q - F.ln(F.greatest(q - m * m, F.lit(1e-6))) - 1))


def mixture_bet(df: DataFrame, u: str, bets: tuple[float, ...] = (-1.5, -0.75, 0.75, 1.5), order: str = "t") -> DataFrame:
    """Log wealth of the mean of fixed bets 1 + l (u - 1/2)."""
    over = upto(order)
    logs = [F.sum(F.ln(1 + l * (F.col(u) - 0.5))).over(over) for l in bets]  # noqa: E741
    top = F.greatest(*logs)
    return df.withColumn("log_wealth", top + F.ln(sum((F.exp(v - top) for v in logs), F.lit(0.0)) / float(len(bets))))


def power_martingale(df: DataFrame, u: str, epsilons: tuple[float, ...] = (0.3, 0.5, 0.7, 0.9), order: str = "t") -> DataFrame:
    """Log of the mean over epsilon of the products of epsilon u^(epsilon - 1)."""
    over = upto(order)
    logs = [F.sum(F.lit(math.log(e)) + (e - 1) * F.ln(u)).over(over) for e in epsilons]
    top = F.greatest(*logs)
    return df.withColumn("log_martingale", top + F.ln(sum((F.exp(v - top) for v in logs), F.lit(0.0)) / float(len(epsilons))))


def focus_exact(df: DataFrame, x: str = "cents", order: str = "t") -> DataFrame:
    """max over starts s <= t of (S_t - S_s)^2 / 2 (t - s), every start against every end: for short series and as a check."""
    c = df.select("series_id", (F.col(order) + 1).alias("n"), F.sum(x).over(upto(order)).cast("double").alias("c"))
    starts = c.select("series_id", F.col("n").alias("m"), F.col("c").alias("b")).unionByName(c.select("series_id").distinct().select("series_id", F.lit(0).cast("long").alias("m"), F.lit(0.0).alias("b")))
    j = c.join(starts, "series_id").filter("m < n")
    g = (F.col("c") - F.col("b")) * (F.col("c") - F.col("b")) / (2.0 * (F.col("n") - F.col("m")))
    return j.groupBy("series_id", (F.col("n") - 1).alias("t")).agg(F.max(g).alias("focus"))


def scale_survival(df: DataFrame, x: str, scales: tuple[int, ...], limits: tuple[float, ...], order: str = "t") -> DataFrame:
    """At how many dyadic scales the windowed mean exceeds a limit, and the largest such scale."""
    made = [F.when(F.count(x).over(trailing(s, order)) == s, F.sum(x).over(trailing(s, order)) / float(s)) for s in scales]
    out = {}
    for k, limit in enumerate(limits):
        hit = [F.when(m > limit, 1).otherwise(0) for m in made]
        out[f"survive{k}"] = sum(hit[1:], hit[0]).cast("long")
        out[f"largest{k}"] = F.greatest(*[F.when(m > limit, s).otherwise(0) for m, s in zip(made, scales, strict=True)]).cast("long")
    return df.withColumns(out)
