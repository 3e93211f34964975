"""Detector-path nulls: how far a recursion's path gets on the break-free history, and how surprising its online path is against that.

Paths are tables (series_id, part, t, a column for each detector): ``part`` is 'h' for the history's path and 'o' for the online one, which starts anew; t counts from 0 in
each. The null table holds, for each series and detector, the history's path after its burn-in (window 0) and its trailing maxima over
``PEAKS`` rows, so that a running peak is judged against peaks over the nearest length. Ranks of online values among null
samples come from one window over both together: no pairs are made, and no null is gathered in one row."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import BURN, CAP, HALF_LIFE, LAG, LEAST, PEAKS, SURPRISE_CAP, TINY

PATH = ("series_id", "part")


def nearest_window(t: Column) -> Column:
    """The peak window whose log is nearest to that of the rows seen, t + 1; the shorter one of two equally near."""
    out = F.lit(PEAKS[-1])
    for a, b in reversed(list(zip(PEAKS, PEAKS[1:], strict=False))):
        out = F.when(F.pow(t + 1, F.lit(2)) <= a * b, F.lit(a)).otherwise(out)
    return out.cast("int")


def settled(d: Column) -> Column:
    """A path's value to nine decimals: values that differ only in the last bits of their sums tie, in whatever order they were added."""
    return F.round(d, 9)


def maxima(paths: DataFrame, peaked: Sequence[str]) -> DataFrame:
    """Wide paths with what the nulls and lookups need: ``<det>_m<w>``, trailing maxima of complete windows (history), and for online rows the running ``<det>_peak`` of every
    path and ``<det>_faded``, the peak that loses half of its height in HALF_LIFE rows; ``n`` rows of the part."""
    over = Window.partitionBy(*PATH).orderBy("t")
    upto = over.rowsBetween(Window.unboundedPreceding, 0)
    dets = [c for c in paths.columns if c not in (*PATH, "t")]
    fade = math.log(2) / HALF_LIFE
    made = {"n": F.count("*").over(Window.partitionBy(*PATH))} | {f"{d}_peak": F.max(d).over(upto) for d in dets}
    made |= {f"{d}_faded": F.exp(F.max(F.ln(F.greatest(F.col(d), F.lit(0.0)) + TINY) + F.col("t") * fade).over(upto) - F.col("t") * fade) for d in peaked}
    held, width = paths.withColumns(made).withColumns({f"_{d}": F.col(d) for d in peaked}), 1
    while width < PEAKS[-1]:  # a window of twice the width is two windows of the width: a lag for each doubling, whatever the width
        held = held.withColumns({f"_{d}": F.greatest(f"_{d}", F.lag(f"_{d}", width).over(over)) for d in peaked})
        width *= 2
        if width in PEAKS:
            held = held.withColumns({f"{d}_m{width}": F.when(F.col("t") >= width - 1, F.col(f"_{d}")) for d in peaked})
    return held.drop(*[f"_{d}" for d in peaked])


def _exploded(df: DataFrame, cells: list[Column], *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(F.array(*cells)).alias("c")).select(*keep, "c.*").filter("x is not null")


def samples(wide: DataFrame, dets: Sequence[str], peaked: Sequence[str]) -> DataFrame:
    """(series_id, det, w, x): null samples, det as its place in ``dets``. Window 0 for every detector, PEAKS for the ``peaked`` ones. A null of under LEAST samples takes the
    window-0 samples instead, and those the whole path."""
    burn = F.least(F.lit(BURN), F.floor(F.col("n") / 4))
    kept = F.col("t") >= F.when(F.col("n") - burn < LEAST, F.lit(0)).otherwise(burn)
    cell = lambda i, w, x: F.struct(F.lit(i).alias("det"), F.lit(w).alias("w"), x.alias("x"))
    cells = [cell(i, 0, F.when(kept, F.col(d))) for i, d in enumerate(dets)]
    cells += [cell(i, w, F.when(F.col("n") - w + 1 >= LEAST, F.col(f"{d}_m{w}")).when(kept, F.col(d))) for i, d in enumerate(dets) if d in peaked for w in PEAKS]
    return _exploded(wide.filter("part = 'h'"), cells, "series_id")


def laws(null: DataFrame, dets: Sequence[str]) -> DataFrame:
    """One row for each series: ``law``, for each detector in order the order statistics (q25, q50, q75, q99, top) of its window-0 null and ``scale``, the null's spread, floored so that
    a null that hardly moves does not make every excess huge."""
    of = Window.partitionBy("series_id", "det")
    ranked = null.filter("w = 0").withColumn("k", F.row_number().over(of.orderBy("x")) - 1).withColumn("n", F.count("*").over(of))
    at = lambda place: F.max(F.when(F.col("k") == F.least(place.cast("long"), F.col("n") - 1), F.col("x")))
    n = F.col("n")
    g = ranked.groupBy("series_id", "det").agg(at(F.floor(0.25 * n)).alias("q25"), at(F.floor(n / 2)).alias("q50"), at(F.floor(0.75 * n)).alias("q75"), at(F.floor(0.99 * n)).alias("q99"), F.max("x").alias("top"))
    scale = F.greatest(F.col("q99") - F.col("q50"), 0.1 * (F.col("top") - F.col("q50")), 1e-3 * F.greatest(F.abs("q50"), F.lit(1.0)))
    one = F.struct("det", "q25", "q50", "q75", "q99", "top", scale.alias("scale"))
    return g.groupBy("series_id").agg(F.array_sort(F.collect_list(one)).alias("law"))  # as many entries as detectors


#: What is looked up: the level against window 0, the peak against the nearest window, the faded peak against the middle one.
LOOKUPS = ("cur", "pk", "dpk")


def lookups(dets: Sequence[str], peaked: Sequence[str]) -> list[tuple[str, str]]:
    """(detector, kind) of everything that is judged; its place is its code."""
    return [(d, k) for d in dets for k in (LOOKUPS if d in peaked else LOOKUPS[:1])]


def upper_surprise(wide: DataFrame, null: DataFrame, dets: Sequence[str], judged: Sequence[tuple[str, str]]) -> DataFrame:
    """(series_id, t, found): for each judged (detector, kind), in order, ``base`` = -log10 of the mid-rank share of the null above the value, at most SURPRISE_CAP, and ``over``, how far the
    value exceeds the null's largest sample. Values and samples are ranked in one window over both."""
    x = {"cur": "", "pk": "_peak", "dpk": "_faded"}
    w = {"cur": F.lit(0), "pk": nearest_window(F.col("t")), "dpk": F.lit(PEAKS[1])}
    cells = [F.struct(F.lit(dets.index(d)).alias("det"), w[k].alias("w"), F.lit(code).alias("code"), F.col(d + x[k]).alias("x")) for code, (d, k) in enumerate(judged)]
    asked = _exploded(wide.filter("part = 'o'"), cells, "series_id", "t")
    both = null.select("series_id", "det", "w", "x", F.lit(None).cast("long").alias("t"), F.lit(None).cast("int").alias("code")).unionByName(asked.withColumn("t", F.col("t").cast("long")))
    one = F.when(F.col("t").isNull(), 1).otherwise(0)
    of = Window.partitionBy("series_id", "det", "w")
    ordered = of.orderBy("x")
    ranked = both.repartition("series_id").withColumns({
        "_below": F.sum(one).over(ordered.rangeBetween(Window.unboundedPreceding, 0)), "_same": F.sum(one).over(ordered.rangeBetween(0, 0)),
        "_n": F.sum(one).over(of), "_top": F.max(F.when(one == 1, F.col("x"))).over(of),
    }).filter("t is not null")
    tail = 1 - 0.5 * (2 * F.col("_below") - F.col("_same")) / F.col("_n")
    base = F.least(-F.log10(F.greatest(tail, 1 / (2 * F.col("_n")))), F.lit(SURPRISE_CAP))
    cell = F.struct("code", base.alias("base"), F.greatest(F.col("x") - F.col("_top"), F.lit(0.0)).alias("over"))
    return ranked.groupBy("series_id", "t").agg(F.array_sort(F.collect_list(cell)).alias("found"))  # as many entries as are judged


def surprise(found: Column, law: Column) -> Column:
    """The base, and the log of the excess in units of the law's scale: beyond the samples the order of values is kept."""
    return F.least(found["base"] + F.log1p(found["over"] / law["scale"]), F.lit(CAP))


def clip(c: Column) -> Column:
    return F.greatest(F.lit(-CAP), F.least(F.lit(CAP), c))


def shapes(d: str, law: Column) -> dict[str, Column]:
    """Of an online path, what needs no null samples: tsp (share of its time since the last peak), per (share over the history's q99), slp, rel, pkr (peak over q99), rz (robust score)."""
    over = Window.partitionBy("series_id").orderBy("t")
    upto = over.rowsBetween(Window.unboundedPreceding, 0)
    x, peak, seen = F.col(d), F.col(f"{d}_peak"), F.col("t") + 1
    return {
        "tsp": (F.col("t") - F.max(F.when(x >= peak, F.col("t"))).over(upto)) / seen,
        "per": F.sum(F.when(x > law["q99"], 1.0).otherwise(0.0)).over(upto) / seen,
        "slp": clip((x - F.lag(d, LAG).over(over)) / (LAG * law["scale"])),
        "rel": x / (peak + TINY),
        "pkr": F.least(F.log1p(F.greatest(peak - law["q99"], F.lit(0.0)) / law["scale"]), F.lit(CAP)),
        "rz": clip((x - law["q50"]) / F.greatest((law["q75"] - law["q25"]) / 1.349, F.lit(1e-9))),
    }
