"""Samples, resampling, attribution and training weights over panels of series, and statistics of whole segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import windows as w
from .calibrate import shuffled
from .panel import cells, midranks, weighted_bootstrap
from .ranks import order_statistics, positions, prefixes, tile

#: Parts of column names that give away what is to be predicted.
FORBIDDEN = ("tau", "n_online", "has_break", "label", "fold", "future")


def select_columns(names: list[str], keep: str | None = None, drop: tuple[str, ...] = ()) -> list[str]:
    """The names that match the regular expression ``keep`` (all without one) and contain none of ``drop``."""
    import re

    return [n for n in names if (keep is None or re.search(keep, n)) and not any(d in n for d in drop)]


def guard_columns(names: list[str], forbidden: tuple[str, ...] = FORBIDDEN) -> None:
    """Raises if a feature's name has a forbidden word between its underscores."""
    bad = [n for n in names if any(f"_{f}_" in f"_{n.split('__')[-1]}_" for f in forbidden)]
    if bad:
        raise ValueError(f"columns that give the target away: {bad}")


def screen(meta: DataFrame, by: str, most: int = 500, key: str = "series_id") -> DataFrame:
    """At most ``most`` series of each group, always the same ones."""
    return positions(meta.withColumn("_h", shuffled(key)), [by], "_h", key).filter(F.col("pos") < most).drop("_h", "pos", "n")


def uniform_sample(rows: DataFrame, n: int) -> DataFrame:
    """n rows without replacement, by the hash of their key: always the same ones. The n-th smallest hash is found in counted hashes; only rows with that very hash are put in an order."""
    h = F.pmod(F.col("series_id") * 7919 + F.col("t") * 104_729 + 13, F.lit(1_000_003))
    held = rows.withColumn("_h", h)
    c = prefixes(held.groupBy("_h").agg(F.count("*").alias("_k")), [], "_h", ["_k"])
    edge = c.filter((F.col("_k_below") < n) & (F.col("_k_below") + F.col("_k") >= n)).agg(F.max("_h").alias("_edge"), F.max(n - F.col("_k_below")).alias("_left"))
    j = held.crossJoin(F.broadcast(edge))  # one row, empty where there are fewer rows than n
    tied = j.filter("_h = _edge").withColumn("_place", F.row_number().over(Window.partitionBy("_h").orderBy("series_id", "t"))).filter("_place <= _left").drop("_place")
    return j.filter("_edge is null or _h < _edge").unionByName(tied).drop("_h", "_edge", "_left")


def rolling_sd(x: str, n: int, order: str = "t") -> Column:
    """Standard deviation of exactly n trailing integers, else null; from sums, so any engine gives the same."""
    over = w.trailing(n, order)
    c = F.col(x)
    return F.when(F.count(c).over(over) == n, F.sqrt((n * F.sum(c * c).over(over) - F.sum(c).over(over) * F.sum(c).over(over)).cast("double")) / n)


def excursions(df: DataFrame, size: Column, cut: Column) -> DataFrame:
    """run (rows in a row with size over cut), mass (excess since the run began) and longest (the longest run so far)."""
    held = w.runs(df.withColumn("_x", F.greatest(size - cut, F.lit(0).cast("long"))), size > cut, "run").withColumn("_m", F.sum("_x").over(w.upto()))
    calm = F.max(F.when(F.col("run") == 0, F.col("_m"))).over(w.upto())  # the sum does not fall, so its largest value at rest is the last one
    return held.withColumns({"mass": F.col("_m") - F.coalesce(calm, F.lit(0).cast("long")), "longest": F.max("run").over(w.upto())}).drop("_x", "_m")


def latched(df: DataFrame, x: str, high: float, low: float, full: int = 8) -> DataFrame:
    """latch: 1 from a value over ``high`` until one under ``low``; credit: the run over ``high`` as a share of ``full`` rows, 1 at most."""
    event = F.when(F.col(x) > high, 1).when(F.col(x) < low, 0)
    held = df.withColumn("latch", F.coalesce(F.last(event, ignorenulls=True).over(w.upto()), F.lit(0)).cast("long"))
    return w.runs(held, F.col(x) > high, "_r").withColumn("credit", F.least(F.lit(1.0), F.col("_r") / float(full))).drop("_r")


def paired_bootstrap(rows: DataFrame, draws: DataFrame, a: str, b: str) -> DataFrame:
    """Both scores under the same draws of series, and their difference."""
    one = {c: weighted_bootstrap(rows.withColumn("score", F.col(c)), draws).select(F.col("draw").alias(f"_{c}"), F.col("auc").alias(f"auc_{k}")) for c, k in ((a, "a"), (b, "b"))}
    j = one[a].join(one[b], F.col(f"_{a}") == F.col(f"_{b}"))
    return j.select(F.col(f"_{a}").alias("draw"), "auc_a", "auc_b", (F.col("auc_a") - F.col("auc_b")).alias("gain"))


def state_calibration(rows: DataFrame, leaf: str, parent: str, least: int) -> DataFrame:
    """cal: the share of negatives that score lower, among those of the row's leaf state, of its parent where the leaf has fewer than ``least``
    negatives, of all where the parent has."""
    out = rows.withColumn("_all", F.lit(0))
    for level, by in (("leaf", leaf), ("parent", parent), ("all", "_all")):
        c = cells(out, by)
        sizes = c.groupBy(by).agg(F.sum("neg").alias(f"n_{level}"))
        c = c.join(sizes, by).select(F.col(by).alias("_b"), F.col("score").alias("_s"), (F.col("below") / F.col(f"n_{level}")).alias(f"f_{level}"), f"n_{level}")
        out = out.join(c, (F.col(by) == F.col("_b")) & (F.col("score") == F.col("_s"))).drop("_b", "_s")
    pick = F.when(F.col("n_leaf") >= least, F.col("f_leaf")).when(F.col("n_parent") >= least, F.col("f_parent")).otherwise(F.col("f_all"))
    return out.withColumn("cal", pick).drop("_all", *[f"{x}_{level}" for x in "nf" for level in ("leaf", "parent", "all")])


def failure_map(series: DataFrame, x: str, loss: str, bins: int = 5) -> DataFrame:
    """series: series_id, x, loss. By tile of x: series, mean loss, and eta-squared, the tiles' share of the losses' variance."""
    held = positions(series, [], x, "series_id").withColumn("bin", tile(F.col("pos"), F.col("n"), bins))
    g = held.groupBy("bin").agg(F.count("*").alias("n"), F.avg(loss).alias("loss"), F.sum(loss).alias("_s"), F.sum(F.col(loss) * F.col(loss)).alias("_q"))
    all_ = Window.partitionBy(F.lit(0))  # a row for each bin
    n, s, q = (F.sum(c).over(all_) for c in ("n", "_s", "_q"))
    between = F.sum(F.col("_s") * F.col("_s") / F.col("n")).over(all_) - s * s / n
    return g.select("bin", "n", "loss", F.when(q - s * s / n > 0, between / (q - s * s / n)).alias("eta2"))


def localisation(rows: DataFrame, evidence: str) -> DataFrame:
    """rows: series_id, t, tau, y and a reflected sum. The break is put where the sum last left zero; by age band of the rows after the true one: rows, mean
    distance, and how often it is within a fifth, and half, of the time since the break."""
    zero = F.max(F.when(F.col(evidence) == 0, F.col("t"))).over(w.upto())
    gap = F.abs(F.coalesce(zero, F.lit(-1)) + 1 - F.col("tau"))
    late = rows.withColumn("gap", gap).filter("y = 1").withColumn("age", F.col("t") - F.col("tau"))
    band = F.when(F.col("age") < 5, 0).when(F.col("age") < 15, 5).otherwise(15).cast("long")
    near = lambda k: F.avg(F.when(k * F.col("gap") <= F.col("age") + 1, 1.0).otherwise(0.0))
    return late.groupBy(band.alias("age_from")).agg(F.count("*").alias("rows"), F.avg("gap").alias("mean_gap"), near(5).alias("within_fifth"), near(2).alias("within_half"))


def residualise_crossfit(rows: DataFrame, score: str, x: str, by: str = "t", fold: str = "fold") -> DataFrame:
    """score minus the least-squares line in x of the same step, fitted on the other folds: sums of the step less those of the fold."""
    x_, y = F.col(x), F.col(score)
    g = rows.groupBy(by, fold).agg(*[F.sum(e).alias(n) for n, e in (("n", F.lit(1.0)), ("sy", y), ("sx", x_), ("xx", x_ * x_), ("xy", x_ * y))])
    step = Window.partitionBy(by)  # a row for each fold
    o = g.select(F.col(by).alias("_b"), F.col(fold).alias("_f"), *[(F.sum(c).over(step) - F.col(c)).alias(c) for c in ("n", "sy", "sx", "xx", "xy")])
    det = F.col("n") * F.col("xx") - F.col("sx") * F.col("sx")
    slope = F.when(det > 1e-9, (F.col("n") * F.col("xy") - F.col("sx") * F.col("sy")) / det).otherwise(0.0)
    o = o.filter("n > 0").select("_b", "_f", slope.alias("_m"), ((F.col("sy") - slope * F.col("sx")) / F.col("n")).alias("_a"))
    j = rows.join(o, (F.col(by) == F.col("_b")) & (F.col(fold) == F.col("_f")), "left")
    return j.withColumn("residual", y - F.coalesce("_a", F.lit(0.0)) - F.coalesce("_m", F.lit(0.0)) * x_).drop("_a", "_m", "_b", "_f")


def hard_negatives(rows: DataFrame, alpha: float = 2.0, power: int = 2) -> DataFrame:
    """Weight 1 + alpha * rank^power of the negatives' ranks among their step's negatives; ``again``: the top tenth, to be repeated."""
    r = midranks(rows.filter("y = 0"))
    share = F.when(F.col("n_step") > 1, (F.col("midrank") - 1) / (F.col("n_step") - 1)).otherwise(0.5)
    return r.withColumns({"weight": 1 + alpha * F.pow(share, F.lit(power)), "again": (share >= 0.9).cast("long")}).drop("midrank", "n_step")


def targets(rows: DataFrame, ramp: int = 10, decay: float = 8.0, horizon: int = 40) -> DataFrame:
    """Graded targets and weights: ramp and log-time of the age since the break, hazard (1 at the break alone), and a weight that fades
    with the age."""
    age = F.col("t") - F.col("tau")
    on = F.col("y") == 1
    return rows.withColumns({
        "ramp": F.when(on, F.least(F.lit(1.0), (age + 1) / float(ramp))).otherwise(0.0), "log_time": F.when(on, F.ln(age + 2.0) / F.ln(F.lit(horizon + 1.0))).otherwise(0.0),
        "hazard": (on & (age == 0)).cast("long"), "near": F.when(on, F.exp(-age / decay)).otherwise(1.0),
    })


def mixture(rows: DataFrame, a: str, b: str, parts: int = 4) -> DataFrame:
    """(lam, t, score, y): lam / parts of a's rank within the step and the rest of b's, in whole numbers."""
    r = midranks(midranks(rows, a, "rank_a").drop("n_step"), b, "rank_b").drop("n_step")
    lam = F.explode(F.array(*[F.lit(k).cast("long") for k in range(parts + 1)])).alias("lam")
    return r.select(lam, "t", "y", (F.col("rank_a") * 2).cast("long").alias("ra"), (F.col("rank_b") * 2).cast("long").alias("rb")).select("lam", "t", "y", (F.col("lam") * F.col("ra") + (parts - F.col("lam")) * F.col("rb")).alias("score"))


def segment_statistics(obs: DataFrame, by: list[str], x: str = "x", order: str = "i") -> DataFrame:
    """Location, scale, shape, dependence and trend of each segment: n, mean, sd, skew, kurt, acf1, slope."""
    s = Window.partitionBy(*by)
    d = F.col(x) - F.avg(x).over(s)
    held = obs.withColumn("_d", d).withColumn("_i", F.row_number().over(s.orderBy(order)) - (F.count("*").over(s) + 1) / 2.0).withColumn("_l", F.lag("_d").over(s.orderBy(order)))
    p = lambda k: F.avg(F.pow("_d", F.lit(k)))
    g = held.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), p(2).alias("m2"), p(3).alias("m3"), p(4).alias("m4"), F.sum(F.col("_d") * F.col("_l")).alias("c1"), F.sum(F.col("_d") * F.col("_i")).alias("c"), F.sum(F.col("_i") * F.col("_i")).alias("ii"))
    safe = F.greatest("m2", F.lit(1e-12))
    return g.select(*by, "n", "mean", F.sqrt("m2").alias("sd"), (F.col("m3") / F.pow(safe, F.lit(1.5))).alias("skew"), (F.col("m4") / (safe * safe)).alias("kurt"), (F.col("c1") / (F.col("n") * safe)).alias("acf1"), (F.col("c") / F.greatest("ii", F.lit(1e-12))).alias("slope"))


def transients(df: DataFrame, z: str, cut: float) -> DataFrame:
    """isolated: a value beyond ``cut`` between two that are not; burst: the run beyond it that ends here, if of two rows or more."""
    beyond = F.abs(F.coalesce(F.col(z), F.lit(0.0))) > cut
    held = w.runs(df, beyond, "_run")
    ends = (F.col("_run") > 0) & (F.coalesce(F.lead("_run").over(w.by()), F.lit(0)) == 0)
    return held.withColumns({"isolated": F.when(ends & (F.col("_run") == 1), 1).otherwise(0).cast("long"), "burst": F.when(ends & (F.col("_run") > 1), F.col("_run")).otherwise(0).cast("long")}).drop("_run")


def ecdf_knots(hist: DataFrame, knots: int = 256, x: str = "x") -> DataFrame:
    """(series_id, k, q): the values at shares (k + 1/2) / knots of the history, interpolated."""
    shares = F.array(*[F.lit((k + 0.5) / knots) for k in range(knots)])
    # a history has a bounded length, so its values are one aggregate's state
    q = hist.groupBy("series_id").agg(F.percentile(F.col(x).cast("double"), shares).alias("q"))
    return q.select("series_id", F.posexplode("q").alias("k", "q"))


def longest_run_law(df: DataFrame, size: str, cut: str, p: float = 0.10) -> DataFrame:
    """longest run over the cut so far, and over what chance makes of it: ln(m) / ln(1 / p) for m rows of which a share p lies over."""
    held = w.runs(df, F.col(size) > F.col(cut), "_r").withColumn("longest", F.max("_r").over(w.upto()))
    m = F.greatest(F.count("*").over(w.upto()).cast("double"), F.lit(2.0))
    return held.withColumn("ratio", F.col("longest") * F.ln(F.lit(1 / p)) / F.ln(m)).drop("_r")


def pooled_ar2(hist: DataFrame, z: str = "z", order: str = "i") -> DataFrame:
    """One row: the coefficients of an AR(2) from autocovariances summed over all series (each its own mean of products)."""
    by = Window.partitionBy("series_id").orderBy(order)
    held = hist.select("series_id", z, F.lag(z, 1).over(by).alias("a"), F.lag(z, 2).over(by).alias("b"))
    g = held.groupBy("series_id").agg(*[(F.sum(F.col(z) * c) / F.count("*")).alias(n) for n, c in (("r0", F.col(z)), ("r1", F.col("a")), ("r2", F.col("b")))])
    s = g.agg(*[F.sum(c).alias(c) for c in ("r0", "r1", "r2")])
    det = F.col("r0") * F.col("r0") - F.col("r1") * F.col("r1")
    return s.select(((F.col("r1") * F.col("r0") - F.col("r1") * F.col("r2")) / det).alias("phi1"), ((F.col("r0") * F.col("r2") - F.col("r1") * F.col("r1")) / det).alias("phi2"))
