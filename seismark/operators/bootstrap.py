"""Null paths by an autoregressive bootstrap of the history's residuals, and breaks and transients planted in them.

A path z_t = phi . (z_{t-1} .. z_{t-p}) + e_t goes on from the history's end; e_t is the history's residual at a place drawn by counter from
(series, step, replicate), so the same paths come from any partitioning, and from any subset of the replicates. A task holds one series' residuals and a block of
its replicates; series and blocks are spread.

``plans`` says what is planted, a row for each (series_id, rep): kind, tau (its first step), dur (its steps), value. Persistent kinds go on to the end: location (by
value * mad), scale (by exp(value) about the median), dependence (value is added to phi1, the recursion runs on with the same draws). Transients
last dur steps: outlier (single points by the residuals' 99.5 % size), shock (the same, fading), burst (scale by exp |value|), displacement (value * mad)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import history as h
from .draws import mixed, mixed_arrays

ORDER, CLIP, MOST_PHI, SIZE = 5, 12.0, 0.95, 0.995
KINDS = ("none", "location", "scale", "dependence", "outlier", "shock", "burst", "displacement")


def fit(hist: DataFrame, p: int = ORDER) -> DataFrame:
    """One row for each series: mu, sd, med, mad, phi, ``resid`` (in order), ``tail`` (the last p values, latest first) and ``size``, of the history."""
    par = h.parameters(hist)
    z = h.standardise(hist, par).select("series_id", "i", "z")
    held = z.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("i", "z"))).alias("s"))  # a history is the bounded unit of a series
    j = held.join(h.arp(z, p), "series_id").withColumn("zs", F.col("s.z"))
    at = lambda k, i: F.element_at("zs", (F.lit(p + 1) + k - i).cast("int"))
    predicted = lambda k: sum((F.col(f"phi{i}") * at(k, i) for i in range(1, p + 1)), F.lit(0.0))
    resid = F.transform(F.sequence(F.lit(0), F.size("zs") - p - 1), lambda k: at(k, 0) - predicted(k))
    j = j.withColumn("resid", F.when(F.size("zs") > p, resid).otherwise(F.array(F.lit(0.0)))).withColumn("tail", F.slice(F.concat(F.reverse("zs"), F.array_repeat(F.lit(0.0), p)), 1, p))
    size = F.array_sort(F.transform("resid", F.abs))
    spot = (F.size("resid") - 1) * F.lit(SIZE)
    low, part = F.floor(spot).cast("int"), spot - F.floor(spot)
    j = j.withColumn("_o", size).withColumn("size", F.greatest(F.element_at("_o", low + 1) + part * (F.element_at("_o", F.least(low + 2, F.size("_o"))) - F.element_at("_o", low + 1)), F.lit(1e-6)))
    return j.join(par.select("series_id", "mu", "sd", F.col("q50").alias("med"), "mad"), "series_id").select("series_id", "mu", "sd", "med", "mad", F.array(*[f"phi{i}" for i in range(1, p + 1)]).alias("phi"), "resid", "tail", "size")


def run(phi: np.ndarray, resid: np.ndarray, tail: np.ndarray, key: int, reps: np.ndarray, n: int, tau: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """(replicates, n) paths; from step tau on, phi1 is moved by ``shift`` within +-MOST_PHI."""
    held = np.tile(tail, (len(reps), 1))
    out = np.empty((len(reps), n))
    moved = np.where(shift != 0, np.clip(phi[0] + shift, -MOST_PHI, MOST_PHI), phi[0])
    for t in range(n):
        first = np.where(t >= tau, moved, phi[0])
        z = first * held[:, 0]
        for i in range(1, len(phi)):
            z = z + phi[i] * held[:, i]
        z = np.clip(z + resid[mixed_arrays(key, t, reps) % len(resid)], -CLIP, CLIP)
        out[:, t] = z
        held = np.concatenate((z[:, None], held[:, :-1]), axis=1)
    return out


def paths(fits: DataFrame, plans: DataFrame, n: int, block: int = 64) -> DataFrame:
    """(series_id, rep, t, z) of every planned path, n steps each."""
    kind = dict(plans.dtypes)["series_id"]
    blocks = plans.withColumn("_block", F.floor(F.col("rep") / block)).groupBy("series_id", "_block").agg(F.array_sort(F.collect_list(F.struct("rep", "kind", "tau", "value"))).alias("todo"))  # at most ``block`` entries

    def steps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                reps = np.array([p["rep"] for p in r.todo], np.int64)
                tau = np.array([p["tau"] for p in r.todo], np.int64)
                shift = np.array([p["value"] if p["kind"] == "dependence" else 0.0 for p in r.todo])
                z = run(np.asarray(r.phi, float), np.asarray(r.resid, float), np.asarray(r.tail, float), int(r.series_id), reps, n, tau, shift)
                yield pd.DataFrame({"series_id": r.series_id, "rep": np.repeat(reps, n), "t": np.tile(np.arange(n), len(reps)), "z": z.ravel()})

    # only as many partitions as there is work: a block is a task's smallest unit
    return blocks.join(fits.select("series_id", "phi", "resid", "tail"), "series_id").repartition("series_id", "_block").mapInPandas(steps, f"series_id {kind}, rep long, t long, z double")


def planted(walks: DataFrame, fits: DataFrame, plans: DataFrame) -> DataFrame:
    """(series_id, rep, t, kind, x): the paths in the series' own units, with what is planned in them."""
    j = walks.join(plans, ["series_id", "rep"]).join(fits.select("series_id", "mu", "sd", "med", "mad", "size"), "series_id")
    x, t, tau, value = F.col("mu") + F.col("sd") * F.col("z"), F.col("t"), F.col("tau"), F.col("value")
    on, during = t >= tau, (t >= tau) & (t < tau + F.col("dur"))
    sign = F.when(value < 0, -1.0).otherwise(1.0)
    scaled = lambda v: F.col("med") + F.exp(F.least(F.lit(2.0), F.greatest(F.lit(-2.0), v))) * (x - F.col("med"))
    spike = mixed(F.col("series_id"), t, F.col("rep") + 1_000_003) % F.col("dur") == 0
    made = (
        F.when((F.col("kind") == "location") & on, x + value * F.col("mad"))
        .when((F.col("kind") == "scale") & on, scaled(value))
        .when((F.col("kind") == "outlier") & during & ((t == tau) | spike), x + sign * F.col("size") * F.col("sd"))
        .when((F.col("kind") == "shock") & during, x + sign * F.col("size") * F.col("sd") * F.exp(-(t - tau) / F.greatest(F.col("dur") / 3.0, F.lit(1.0))))
        .when((F.col("kind") == "burst") & during, scaled(F.abs(value)))
        .when((F.col("kind") == "displacement") & during, x + value * F.col("mad"))
        .otherwise(x)
    )
    return j.select("series_id", "rep", "t", "kind", made.alias("x"))


def every_kind(fits: DataFrame, n: int) -> DataFrame:
    """A plan of one path of each kind for every series, with hashed places, lengths and values."""
    kinds = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("rep"), F.lit(k).alias("kind")) for i, k in enumerate(KINDS)])).alias("k")
    rows = fits.select("series_id", kinds).select("series_id", "k.*")
    h_ = lambda salt: mixed(F.col("series_id"), F.lit(salt).cast("long"), F.col("rep"))
    return rows.select("series_id", "rep", "kind", (F.lit(n // 4) + h_(n + 1) % (n // 2)).alias("tau"), (3 + h_(n + 2) % 12).alias("dur"), ((h_(n + 3) % 4001 - 2000) / 1000.0).alias("value"))
