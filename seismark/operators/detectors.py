"""Whole-series change detectors and the scoring of their marks."""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.series import spread_evenly


def baseline_features(df: DataFrame, x: str = "x", order: str = "i") -> DataFrame:
    """Means and deviations of three, two lags and differences, gaps at the start filled from the next row (which looks ahead)."""
    w = Window.partitionBy("series_id").orderBy(order)
    three = w.rowsBetween(-2, 0)
    full = F.count(x).over(three) == 3
    made = {
        "rolling_mean_3": F.when(full, F.avg(x).over(three)), "rolling_std_3": F.when(full, F.stddev_samp(x).over(three)),
        "lag_1": F.lag(x, 1).over(w), "lag_2": F.lag(x, 2).over(w), "diff_1": F.col(x) - F.lag(x, 1).over(w), "diff_2": F.col(x) - F.lag(x, 2).over(w),
    }
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    held = df.withColumns(made)
    return held.withColumns({c: F.first(c, ignorenulls=True).over(ahead) for c in made})


def cusum(df: DataFrame, threshold: float = 1.1) -> DataFrame:
    """|cumulative sum of x - mean| / (population sd * sqrt n); the first largest is flagged if it reaches the threshold. Exact integers: n^2 times
    the squared score is (n C - i S)^2 / (n Q - S^2) / n."""
    w = Window.partitionBy("series_id")
    run = w.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    s = df.withColumn("n", F.count("*").over(w)).withColumn("s1", F.sum("cents").over(w)).withColumn("s2", F.sum(F.col("cents") * F.col("cents")).over(w)).withColumn("c", F.sum("cents").over(run)).withColumn("k", F.count("*").over(run))
    num = F.abs(F.col("n") * F.col("c") - F.col("k") * F.col("s1")).cast("double")
    var = F.col("n").cast("double") * F.col("s2").cast("double") - F.col("s1").cast("double") * F.col("s1").cast("double")
    s = s.withColumn("num", num).withColumn("score", F.when(var > 0, num / (F.sqrt(var) * F.sqrt(F.col("n").cast("double")))).otherwise(0.0))
    top = s.withColumn("top", F.max("num").over(w))
    return top.withColumn("at", F.min(F.when(F.col("num") == F.col("top"), F.col("i"))).over(w)).select("series_id", "i", "score", F.when((F.col("i") == F.col("at")) & (F.col("score") >= threshold), 1).otherwise(0).cast("long").alias("flag"))


def rolling_z(df: DataFrame, window: int = 20, threshold: float = 3.0) -> DataFrame:
    """|x - mean| / population sd over a trailing window with the row itself; 0 under two rows or without spread."""
    w = Window.partitionBy("series_id").orderBy("i").rowsBetween(-(window - 1), 0)
    s = df.withColumn("n", F.count("*").over(w)).withColumn("s1", F.sum("cents").over(w)).withColumn("s2", F.sum(F.col("cents") * F.col("cents")).over(w))
    var = (F.col("n") * F.col("s2") - F.col("s1") * F.col("s1")).cast("double")
    score = F.when((F.col("n") >= 2) & (var > 0), F.abs(F.col("n") * F.col("cents") - F.col("s1")).cast("double") / F.sqrt(var)).otherwise(0.0)
    return s.withColumn("score", score).select("series_id", "i", "score", F.when(F.col("score") > threshold, 1).otherwise(0).cast("long").alias("flag"))


def rising_edges(df: DataFrame, flag: str = "flag", order: str = "i") -> DataFrame:
    before = F.coalesce(F.lag(flag).over(Window.partitionBy("series_id").orderBy(order)), F.lit(0))
    return df.withColumn("_b", before).filter((F.col(flag) == 1) & (F.col("_b") == 0)).drop("_b")


#: Ends between two prunings of the open starts.
PRUNE = 16


def pelt_breaks(x: np.ndarray, penalty: float | None = None, least: int = 2) -> list[int]:
    """Starts of all segments but the first under squared-error cost, by pruned exact partitioning."""
    n = len(x)
    if n < 2 * least:
        return []
    var = float(x.var())
    beta = 2 * np.log(n) * var if penalty is None else penalty
    c1, c2 = np.concatenate(([0.0], np.cumsum(x))), np.concatenate(([0.0], np.cumsum(x * x)))
    cost = np.full(n + 1, np.inf)
    cost[0] = -beta
    last = np.zeros(n + 1, np.int64)
    # the open starts, the first ``m`` places of each array; they are gone through once in ``PRUNE`` ends, as a start kept too long costs time alone
    live, base, s1, s2 = np.zeros(n + 1), np.empty(n + 1), np.empty(n + 1), np.empty(n + 1)
    base[0], s1[0], s2[0], m = cost[0], c1[0], c2[0], 1
    room, spare = np.empty(n + 1), np.empty(n + 1)
    for end, e1, e2 in zip(range(least, n + 1), c1[least:].tolist(), c2[least:].tolist(), strict=True):
        total, gain = room[:m], spare[:m]
        np.subtract(e1, s1[:m], out=gain)
        np.multiply(gain, gain, out=gain)
        np.subtract(end, live[:m], out=total)
        np.divide(gain, total, out=gain)
        np.subtract(e2, s2[:m], out=total)
        np.add(total, base[:m], out=total)
        np.subtract(total, gain, out=total)
        k = total.argmin()
        cost[end], last[end] = total[k] + beta, live[k]
        if not end % PRUNE:
            keep = np.flatnonzero(total <= cost[end])
            m = len(keep)
            for held in (live, base, s1, s2):
                held[:m] = held[keep]
        new = end - least + 1
        live[m], base[m], s1[m], s2[m] = new, cost[new], c1[new], c2[new]
        m += 1
    out, at = [], n
    while at > 0:
        at = int(last[at])
        if at:
            out.append(at)
    return out[::-1]


def pelt(df: DataFrame) -> DataFrame:
    """Score |segment mean - overall mean|, flags at segment starts. One task for each series; a series is a bounded unit."""

    def run(group: pa.Table) -> pa.Table:  # Arrow alone: a frame costs time for every column of every series
        i = group["i"].to_numpy()
        order = np.argsort(i, kind="stable")
        x = group["x"].to_numpy().astype(float)[order]
        cuts = pelt_breaks(x)
        score, flag, whole = np.zeros(len(x)), np.zeros(len(x), np.int64), x.mean()
        for a, z in zip([0, *cuts], [*cuts, len(x)], strict=True):
            score[a:z] = abs(x[a:z].mean() - whole)
        flag[cuts] = 1
        return pa.Table.from_arrays([group["series_id"], pa.array(i[order]), pa.array(np.round(score, 6)), pa.array(flag)], ["series_id", "i", "score", "flag"])

    return spread_evenly(df.select("series_id", "i", "x")).groupBy("series_id").applyInArrow(run, "series_id long, i long, score double, flag long")


def point_metrics(truth: DataFrame, found: DataFrame, tolerance: int = 5) -> DataFrame:
    """Each true point takes its nearest unused found point within the tolerance, in order; precision, recall and F1 for each series."""

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        left = sorted(b["i"].tolist())
        hits = 0
        for p in sorted(a["i"].tolist()):
            near = [q for q in left if abs(q - p) <= tolerance]
            if near:
                left.remove(min(near, key=lambda q: (abs(q - p), q)))
                hits += 1
        n, m = len(a), len(b)
        prec, rec = hits / m if m else 0.0, hits / n if n else 0.0
        return pd.DataFrame([(key[0], n, m, hits, prec, rec, 2 * prec * rec / (prec + rec) if hits else 0.0)], columns=["series_id", "n_true", "n_found", "hits", "precision", "recall", "f1"])

    return truth.select("series_id", "i").groupBy("series_id").cogroup(found.select("series_id", "i").groupBy("series_id")).applyInPandas(run, "series_id long, n_true long, n_found long, hits long, precision double, recall double, f1 double")


def f1_counts(df: DataFrame, truth: str, flag: str) -> DataFrame:
    n = lambda a, b: F.sum(F.when((F.col(truth) == a) & (F.col(flag) == b), 1).otherwise(0)).cast("long")
    c = df.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    return c.withColumn("f1", F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0))


def t_statistic(df: DataFrame, boundary: int) -> DataFrame:
    """Welch's t of the mean after the boundary against the mean before it."""
    after = F.col("i") >= boundary
    g = df.groupBy("series_id").agg(*[f(F.when(c, F.col("x"))).alias(n + s) for s, c in (("a", after), ("b", ~after)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    return g.select("series_id", ((F.col("ma") - F.col("mb")) / F.sqrt(F.col("va") / F.col("na") + F.col("vb") / F.col("nb"))).alias("t_stat"))


def in_groups(df: DataFrame, fn, schema: str) -> DataFrame:
    """fn(pandas frame of one series, sorted) -> pandas frame, for every series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf.sort_values("i", kind="stable").reset_index(drop=True))

    return df.groupBy("series_id").applyInPandas(run, schema)


