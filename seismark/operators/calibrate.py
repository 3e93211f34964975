"""Score calibration against elapsed time, blends, cross-fitting, folds, samples and controls."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .ranks import order_statistics, positions, prefixes, tile


def anchors(longest: int, n: int = 12) -> list[int]:
    """Log-spaced anchor times from 0 to the longest elapsed index."""
    top = math.log1p(longest)
    return sorted({int(round(math.expm1(top * k / (n - 1)))) for k in range(n)})


def fit_time_cdf(rows: DataFrame, at: list[int], quantiles: int = 16, least: int = 400, score: str = "score") -> DataFrame:
    """(a, k, q): for each anchor a the k-th of ``quantiles`` order statistics of the scores within half the mean log gap of it; the pooled
    scores where fewer than ``least`` lie there. Order statistics come from counted distinct scores."""
    logs = [math.log1p(a) for a in at]
    half = (logs[-1] - logs[0]) / max(len(at) - 1, 1)
    spread = F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(round(math.expm1(x - half), 9)).alias("lo"), F.lit(round(math.expm1(x + half), 9)).alias("hi")) for a, x in zip(at, logs, strict=True)]))
    tagged = rows.select("t", F.col(score).alias("s"), spread.alias("w"))
    near = tagged.filter((F.col("t") >= F.col("w.lo")) & (F.col("t") <= F.col("w.hi"))).groupBy("w.a", "s").agg(F.count("*").alias("n"))
    # the pooled scores are one more anchor, whose few order statistics thin anchors take over
    pool = rows.groupBy(F.lit(-1).cast("long").alias("a"), F.col(score).alias("s")).agg(F.count("*").alias("n"))
    c = prefixes(near.unionByName(pool), ["a"], "s", ["n"])
    # statistic k stands at place floor(k (n - 1) / (quantiles - 1)): a score that holds the places from x to below y has the k from ceil(x (quantiles - 1) / (n - 1)) to below the same of y
    gaps, last = quantiles - 1, F.col("n_all") - 1
    first = lambda x: F.when(last > 0, F.expr(f"(({x}) * {gaps} + n_all - 2) div greatest(n_all - 1, 1)")).otherwise(F.when(F.expr(x) > 0, gaps + 1).otherwise(0)).cast("long")
    held = c.select("a", F.col("n_all").alias("m"), F.col("s").alias("q"), first("n_below").alias("lo"), F.least(first("n_below + n") - 1, F.lit(gaps).cast("long")).alias("hi")).filter("lo <= hi")
    grid = materialize(held.select("a", "m", "q", F.explode(F.sequence("lo", "hi")).alias("k")), "grid")  # quantiles rows for each anchor
    near_enough = grid.filter((F.col("a") >= 0) & (F.col("m") >= least)).select("a", "k", "q")
    thin = grid.filter((F.col("a") >= 0) & (F.col("m") < least)).select("a").distinct()
    return near_enough.unionByName(thin.crossJoin(F.broadcast(grid.filter("a = -1").select("k", "q"))).select("a", "k", "q"))


#: Time coordinates: the log of the rows seen, t + 1; and the older log of t, with t = 0 at the place of t = 1.
COORDINATES = ("log_n_seen", "log_t_clamped")


def apply_time_cdf(rows: DataFrame, grid: DataFrame, score: str = "score", name: str = "cal", coordinate: str = COORDINATES[0]) -> DataFrame:
    """Left rank among an anchor's grid over its length, linear in the time coordinate between anchors. The grid is anchors x quantiles values, collected
    into one row."""
    if coordinate not in COORDINATES:
        raise ValueError(f"unknown time coordinate {coordinate!r}: it is one of {', '.join(COORDINATES)}")
    one = grid.groupBy("a").agg(F.array_sort(F.collect_list("q")).alias("qs")).agg(F.array_sort(F.collect_list(F.struct("a", "qs"))).alias("g"))
    j = rows.crossJoin(F.broadcast(one))  # one row
    t = F.least(F.col("t"), F.element_at("g", -1)["a"])
    lo = F.element_at(F.filter("g", lambda s: s["a"] <= t), -1)
    hi = F.element_at(F.filter("g", lambda s: s["a"] >= t), 1)
    rank = lambda s: F.size(F.filter(s["qs"], lambda q: q < F.col(score))) / F.size(s["qs"])
    j = j.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_t", t)
    x = (lambda c: F.ln(c.cast("double") + 1)) if coordinate == COORDINATES[0] else lambda c: F.ln(F.greatest(c.cast("double"), F.lit(1.0)))
    f = F.when(x(F.col("_lo.a")) == x(F.col("_hi.a")), 0.0).when(F.col("_lo.a") == F.col("_hi.a"), 0.0).otherwise((x(F.col("_t")) - x(F.col("_lo.a"))) / (x(F.col("_hi.a")) - x(F.col("_lo.a"))))
    a, b = rank(F.col("_lo")), rank(F.col("_hi"))
    return j.withColumn(name, a + f * (b - a)).drop("g", "_lo", "_hi", "_t")


def grid_payload(grid: DataFrame, coordinate: str = COORDINATES[0]) -> str:
    """A fitted grid as JSON: its coordinate, anchors, and each anchor's order statistics (a bounded number of values)."""
    held: dict[int, list[float]] = {}
    for r in grid.orderBy("a", "k").collect():
        held.setdefault(int(r["a"]), []).append(float(r["q"]))
    return json.dumps({"time_coord": coordinate, "anchors": list(held), "grids": list(held.values())})


def grid_of_payload(spark: SparkSession, payload: str) -> tuple[DataFrame, str]:
    """The grid and its coordinate; a payload that names none is of the older kind."""
    d = json.loads(payload)
    coordinate = d.get("time_coord", COORDINATES[1])
    if coordinate not in COORDINATES or len(d["anchors"]) != len(d["grids"]):
        raise ValueError("the payload holds no grid of a known kind")
    return spark.createDataFrame([(int(a), k, float(q)) for a, qs in zip(d["anchors"], d["grids"], strict=True) for k, q in enumerate(qs)], "a long, k long, q double"), coordinate


def blend_mean(cols: list[str]) -> Column:
    """Mean of members; a missing or non-finite one counts as 0.5; clipped to [0, 1]."""
    ok = [F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")), 0.5).otherwise(F.col(c)) for c in cols]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum(ok[1:], ok[0]) / float(len(cols))))


def blend_logit(cols: list[str], eps: float = 1e-6) -> Column:
    clip = [F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.coalesce(F.col(c), F.lit(0.5)))) for c in cols]
    z = [F.ln(p / (1 - p)) for p in clip]
    return 1 / (1 + F.exp(-(sum(z[1:], z[0]) / float(len(cols)))))


def rank_cdf(rows: DataFrame, score: str, name: str, by: tuple[str, ...] = (), counted: DataFrame | None = None) -> DataFrame:
    """Left rank over count among all rows (of ``by``), through counted distinct scores. When several maps are joined one after another,
    give the plain rows as ``counted``, so that each count does not run through the joins before it."""
    c = (rows if counted is None else counted).groupBy(*by, F.col(score).alias("_s")).agg(F.count("*").alias("_n"))
    c = prefixes(c, by, "_s", ["_n"]).select(*[F.col(b).alias(f"_{b}") for b in by], "_s", (F.col("_n_below") / F.col("_n_all")).alias(name))
    return rows.join(c, [F.col(score) == F.col("_s")] + [F.col(b) == F.col(f"_{b}") for b in by]).drop("_s", *[f"_{b}" for b in by])


def fold_of(key: Column, n: int = 5) -> Column:
    return F.pmod(key * 2_654_435 + 97, F.lit(10_007)) % n


def stratified_folds(meta: DataFrame, n: int = 5, lockbox: int = 10) -> DataFrame:
    """Strata of has_break x tau quartile x length tertile; within each, in a hashed order, every ``lockbox``-th series is -1 (set
    aside) and the others are dealt to n folds in turn."""
    m = meta.withColumn("_b", F.col("has_break").cast("int"))
    for c, k in (("tau", 4), ("n_online", 3)):
        m = positions(m, ["_b"], c, "series_id").withColumn(f"_{c}", tile(F.col("pos"), F.col("n"), k)).drop("pos", "n")
    m = m.withColumn("stratum", F.concat_ws("-", F.col("_b").cast("string"), F.when(F.col("has_break"), F.col("_tau")).otherwise(F.lit(0)).cast("string"), F.col("_n_online").cast("string")))
    m = positions(m.withColumn("_h", shuffled("series_id")), ["stratum"], "_h", "series_id")
    return m.withColumn("fold", F.when(F.col("pos") % lockbox == lockbox - 1, -1).otherwise(F.col("pos") % n).cast("long")).drop("pos", "n", "_h", "_b", "_tau", "_n_online")


def shuffled(key: str) -> Column:
    return F.pmod(F.col(key) * 7919 + 13, F.lit(10_007))


def derange(df: DataFrame, by: str, key: str, value: str, name: str) -> DataFrame:
    """Each row gets the value of the next row of its group in a hashed order, the last one that of the first: no row keeps its own place."""
    held = materialize(positions(df.withColumn("_h", shuffled(key)), [by], "_h", key).withColumnRenamed("n", "_n"), "positions")
    after = held.select(F.col(by).alias("_b"), F.col("pos").alias("_q"), F.col(value).alias(name))
    return held.join(after, (F.col(by) == F.col("_b")) & (F.col("_q") == (F.col("pos") + 1) % F.col("_n"))).drop("_h", "pos", "_n", "_b", "_q")


def standardiser(train: DataFrame, cols: list[str]) -> DataFrame:
    """Quartiles of each column over the training rows, as arrays: one row."""
    long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")).select("x.c", "x.v")
    q = order_statistics(long, "v", (0.25, 0.5, 0.75), ("c",))
    return q.agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("c") == c, F.struct("k", "q")))), lambda s: s["q"]).alias(c) for c in cols])  # three rows a column


def standardise(rows: DataFrame, fit: DataFrame, cols: list[str], clip: float = 20.0) -> DataFrame:
    """(x - median) / IQR clipped, 0 for missing values, and a flag for them."""
    j = rows.crossJoin(F.broadcast(fit.select(*[F.col(c).alias(f"_{c}") for c in cols])))  # one row
    out = {}
    for c in cols:
        q = F.col(f"_{c}")
        z = (F.col(c) - q[1]) / F.greatest(q[2] - q[0], F.lit(1e-9))
        out[c] = F.coalesce(F.greatest(F.lit(-clip), F.least(F.lit(clip), z)), F.lit(0.0))
        out[f"{c}_missing"] = F.when(F.col(c).isNull(), 1.0).otherwise(0.0)
    return j.withColumns(out).drop(*[f"_{c}" for c in cols])


def residualise(rows: DataFrame, score: str, x: str, by: str = "t") -> DataFrame:
    """score minus its per-step least-squares line in x (steps with no spread in x: minus the mean)."""
    g = rows.groupBy(by).agg(F.avg(score).alias("_y"), F.avg(x).alias("_x"), F.var_pop(x).alias("_xx"), F.covar_pop(x, score).alias("_xy"))  # centred sums: large values do not cancel
    b = F.when(F.col("_xx") > 0, F.col("_xy") / F.col("_xx")).otherwise(0.0)
    g = g.select(F.col(by).alias("_by"), b.alias("_b"), (F.col("_y") - b * F.col("_x")).alias("_a"))
    return rows.join(g, F.col(by) == F.col("_by")).withColumn("residual", F.col(score) - F.col("_a") - F.col("_b") * F.col(x)).drop("_a", "_b", "_by")
