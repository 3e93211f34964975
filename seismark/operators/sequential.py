"""Sequential evidence: cumulative sums, Page-Hinkley, Shiryaev-Roberts, likelihood ratios and exponential means of standardised values, AR(2)
residuals and squares, each judged against its own path over the series' break-free history."""

from __future__ import annotations

from collections.abc import Collection, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import modules as m
from ..functions import sequence
from ..sources.scratch import materialize
from ..sources.series import spread_evenly
from . import history as h
from . import pathnull as pn
from . import scan

KEYS = ("series_id", "part")
#: Detectors by what is given of them: the whole pack, level and peak, the level alone, and the sign with a robust score.
FULL, SMALL, ROBUST = sequence.FULL, sequence.SMALL, sequence.ROBUST
LEVEL = {d: d for d in sequence.LEVEL}
SHAPE = ("cur", "pk", "dpk", "tsp", "per", "slp", "rel")
HOT, MIX_CAP, DYADIC, SLACK_PH, SHIFT, EPS = sequence.HOT, sequence.MIX_CAP, sequence.DYADIC, sequence.SUMS["ph"], sequence.SHIFT, sequence.EPS


def inputs(obs: DataFrame, n_hist: int) -> DataFrame:
    """(series_id, part, t, z, e, sq, v): standardised value, AR(2) residual (history's first two are 0), square, and the square standardised by the history's."""
    hist = obs.filter(F.col("i") < n_hist)
    z = h.standardise(obs, h.moments(hist)).select("series_id", "i", "z")
    over = Window.partitionBy("series_id").orderBy("i")
    lagged = z.withColumn("_l1", F.lag("z", 1).over(over)).withColumn("_l2", F.lag("z", 2).over(over)).join(h.ar2(z.filter(F.col("i") < n_hist)), "series_id")
    e = F.when(F.col("_l2").isNull(), 0.0).otherwise(F.col("z") - F.col("phi1") * F.col("_l1") - F.col("phi2") * F.col("_l2"))
    rows = lagged.select("series_id", F.when(F.col("i") < n_hist, "h").otherwise("o").alias("part"), F.when(F.col("i") < n_hist, F.col("i")).otherwise(F.col("i") - n_hist).alias("t"), "z", e.alias("e"), (F.col("z") * F.col("z")).alias("sq"))
    squares = rows.filter("part = 'h'").groupBy("series_id").agg(F.avg("sq").alias("m_sq"), F.greatest(F.stddev_pop("sq"), F.lit(1e-9)).alias("s_sq"))
    return rows.join(squares, "series_id").withColumn("v", (F.col("sq") - F.col("m_sq")) / F.col("s_sq")).drop("s_sq")


def wide_paths(rows: DataFrame) -> DataFrame:
    """A column for each detector's path, history and online apart."""
    over = Window.partitionBy(*KEYS).orderBy("t")
    upto = over.rowsBetween(Window.unboundedPreceding, 0)
    seen = F.col("t") + 1
    held = rows.withColumn("_gap", F.col("z") - F.sum("z").over(upto) / seen).withColumn("_cz", F.sum("z").over(upto)).withColumn("_ce", F.sum("e").over(upto))
    sums: dict[str, Column] = {}
    for name, x, k in (("cz50", "z", 0.5), ("cz25", "z", 0.25), ("cz100", "z", 1.0), ("ce50", "e", 0.5), ("ce25", "e", 0.25), ("sq50", "v", 0.5), ("sq25", "v", 0.25), ("ph", "_gap", SLACK_PH)):
        sums |= {f"{name}_up": F.sum(F.col(x) - k).over(upto), f"{name}_dn": F.sum(-F.col(x) - k).over(upto)}
    held = held.withColumns(sums)
    held = held.withColumns({n: F.col(n) - F.least(F.lit(0.0), F.min(n).over(upto)) for n in sums})
    for name, c in (("glz", "_cz"), ("gle", "_ce")):  # mixtures at the cap tie, whatever the last bits of their sums
        held = held.withColumns({f"_g{j}": F.pow(F.col(c) - F.coalesce(F.lag(c, 1 << j).over(over), F.lit(0.0)), F.lit(2)) / (2.0 * (1 << j)) for j in range(DYADIC + 1)})
        some = [F.when(seen >= 1 << j, F.col(f"_g{j}")) for j in range(DYADIC + 1)]
        total = sum((F.coalesce(F.exp(F.least(g, F.lit(MIX_CAP))), F.lit(0.0)) for g in some), F.lit(0.0))
        count = sum((F.when(seen >= 1 << j, 1.0).otherwise(0.0) for j in range(DYADIC + 1)), F.lit(0.0))
        held = held.withColumns({name: F.greatest(*some), f"{name}_mix": F.round(F.ln(total / count + pn.TINY), 9)}).drop(*[f"_g{j}" for j in range(DYADIC + 1)])
    both = {n: F.greatest(f"{n}_up", f"{n}_dn") for n in ("cz50", "cz25", "cz100", "ce50", "ce25", "sq50", "sq25")}
    held = held.withColumns(both | {"phu": F.col("ph_up"), "phd": F.col("ph_dn")})
    names = [*FULL, *SMALL[:-2], "gle", *LEVEL]
    return held.select(*KEYS, "t", "z", "sq", "m_sq", *names)


def scanned_paths(rows: DataFrame) -> DataFrame:
    """Shiryaev-Roberts in logs and the exponential means, in one scan."""
    half = {"ew8": ("z", 8), "ew32": ("z", 32), "ew128": ("z", 128), "ewv": ("sq", 32)}
    rate = {n: 1 - 2 ** (-1 / hl) for n, (_, hl) in half.items()}
    step = {"srz_a": SHIFT * F.col("z") - SHIFT * SHIFT / 2, "srz_b": SHIFT * F.col("z") - SHIFT * SHIFT / 2}
    step |= {f"{n}_{f}": c for n, (x, _) in half.items() for f, c in (("a", F.lit(1 - rate[n])), ("b", F.lit(rate[n]) * F.col(x)))}
    out = scan.scan(rows.select(*KEYS, "t", "z", "sq", "m_sq"), step, scan.several(("srz_", scan.log_affine), *[(f"{n}_", scan.affine) for n in half]), keys=KEYS)
    mean = {n: F.col(f"_{n}_b") / (1 - F.pow(F.lit(1 - r), F.col("t") + 1)) for n, r in rate.items()}
    mean["ewv"] = F.ln((mean["ewv"] + EPS) / (F.col("m_sq") + EPS))
    return out.select(*KEYS, "t", F.col("_srz_b").alias("srz"), *[c.alias(n) for n, c in mean.items()])


def columns() -> list[str]:
    packs = [f"{d}_{s}" for d in FULL for s in SHAPE] + [f"{d}_{s}" for d in SMALL for s in ("cur", "pkr")]
    return [*packs, *LEVEL, *ROBUST, "ew32_pkrel", "ew32_slp", "xc_max_cur", "xc_n_hot", "xc_max_pk"]


#: Online rows of the series whose columns go out in one batch.
BATCH_ROWS = 8192


def sequential(obs: DataFrame, n_hist: int, digits: int | None = None, exact: Collection[str] = (), spread: bool = True) -> DataFrame:
    """(series_id, t, 60 columns) of every online row, to ``digits`` decimals but for those ending in ``exact``. A series is the bounded unit: its values are shuffled once, and its paths, nulls
    and ranks come from one pass over them, so what is written is the input and the result (the former not without ``spread``, for rows that are spread by series already). ``by_windows`` gives the same for series of any length."""
    names = columns()

    def batch(held: list[tuple[pa.Scalar, dict[str, np.ndarray]]]) -> pa.RecordBatch:
        n = [len(got[names[0]]) for _, got in held]
        key = pa.array([k.as_py() for k, _ in held], held[0][0].type).take(pa.array(np.repeat(np.arange(len(n)), n)))
        cells = {c: np.concatenate([got[c] for _, got in held]) for c in names}
        cells = {c: v if digits is None or c.endswith(tuple(exact)) else np.round(v, digits) + 0.0 for c, v in cells.items()}
        return pa.RecordBatch.from_arrays([key, pa.array(np.concatenate([np.arange(k) for k in n])), *[pa.array(cells[c], from_pandas=True) for c in names]], ["series_id", "t", *names])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for key, cents in m.values_of(batches, "cents"):
            if len(cents) <= n_hist:
                continue
            held.append((key, sequence.columns(cents, n_hist)))
            waiting += len(cents) - n_hist
            if waiting >= BATCH_ROWS:
                yield batch(held)
                held, waiting = [], 0
        if held:
            yield batch(held)

    schema = T.StructType([T.StructField("series_id", obs.schema["series_id"].dataType), T.StructField("t", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in names]])
    rows = obs.select("series_id", "i", "cents")
    return (spread_evenly(rows) if spread else rows).sortWithinPartitions("series_id", "i").select("series_id", "cents").mapInArrow(run, schema)


def by_windows(obs: DataFrame, n_hist: int) -> DataFrame:
    """``sequential`` as a composition of window functions, scans and joins, for series that do not fit a task: every null sample and every value that is ranked among them is a row, so it
    writes many times what the input takes."""
    rows = materialize(inputs(obs, n_hist), "rows").repartition("series_id")
    signed = list(ROBUST.values())
    means = scanned_paths(rows).withColumns({f"{n}_signed": F.col(n) for n in signed} | {n: F.abs(n) for n in signed})
    dets, usual = [*FULL, *SMALL, *LEVEL, *signed], [*FULL, *SMALL, *LEVEL]
    paths = wide_paths(rows).join(means, [*KEYS, "t"]).select(*KEYS, "t", *[pn.settled(F.col(d)).alias(d) for d in dets], *[f"{n}_signed" for n in signed])
    wide = materialize(pn.maxima(paths, FULL), "paths").repartition("series_id")  # written once: nulls, lookups and shapes read it
    null = pn.samples(wide, dets, FULL)
    judged = pn.lookups(usual, FULL)
    found = pn.upper_surprise(wide, null, dets, judged)
    online = wide.filter("part = 'o'").withColumn("t", F.col("t").cast("long")).join(pn.laws(null, dets), "series_id").join(found, ["series_id", "t"])
    law = {d: F.col("law")[i] for i, d in enumerate(dets)}
    score = {f"{d}_{k}": pn.surprise(F.col("found")[code], law[d]) for code, (d, k) in enumerate(judged)}
    shape = {d: pn.shapes(d, law[d]) for d in (*FULL, *SMALL, *signed)}
    over = Window.partitionBy("series_id").orderBy("t")
    size, ew32 = F.abs("ew32_signed"), F.col("ew32_signed")
    made = score | {f"{d}_{k}": shape[d][k] for d in FULL for k in ("tsp", "per", "slp", "rel")} | {f"{d}_pkr": shape[d]["pkr"] for d in SMALL}
    made |= {name: shape[d]["rz"] * F.signum(f"{d}_signed") for name, d in ROBUST.items()}
    made |= {"ew32_pkrel": size / (F.max(size).over(over.rowsBetween(Window.unboundedPreceding, 0)) + pn.TINY), "ew32_slp": (ew32 - F.lag(ew32, pn.LAG).over(over)) / pn.LAG}
    made |= {d: made.pop(f"{d}_cur") for d in LEVEL}
    pools = [f"{d}_cur" for d in (*FULL, *SMALL)]
    out = online.select("series_id", "t", *[c.alias(n) for n, c in made.items()])
    return out.withColumns({
        "xc_max_cur": F.greatest(*pools),
        "xc_n_hot": sum((F.when(F.col(p) > HOT, 1.0).otherwise(0.0) for p in pools), F.lit(0.0)),
        "xc_max_pk": F.greatest(*[f"{d}_pk" for d in FULL]),
    }).select("series_id", "t", *columns())


def path_surprise(obs: DataFrame, n_hist: int, slack: float = 0.5) -> DataFrame:
    """(series_id, t, d, cur, pk) of the larger of two reflected sums of standardised values alone."""
    hist = obs.filter(F.col("i") < n_hist)
    z = h.standardise(obs, h.moments(hist)).select("series_id", F.when(F.col("i") < n_hist, "h").otherwise("o").alias("part"), F.when(F.col("i") < n_hist, F.col("i")).otherwise(F.col("i") - n_hist).alias("t"), "z")
    upto = Window.partitionBy(*KEYS).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    sums = z.repartition("series_id").withColumns({"up": F.sum(F.col("z") - slack).over(upto), "dn": F.sum(-F.col("z") - slack).over(upto)})
    d = F.greatest(*[F.col(n) - F.least(F.lit(0.0), F.min(n).over(upto)) for n in ("up", "dn")])
    wide = pn.maxima(sums.select(*KEYS, "t", pn.settled(d).alias("d"), d.alias("raw")), ["d"])
    null, judged = pn.samples(wide, ["d"], ["d"]), [("d", "cur"), ("d", "pk")]
    found = pn.upper_surprise(wide, null, ["d"], judged)
    online = wide.filter("part = 'o'").select("series_id", F.col("t").cast("long").alias("t"), F.col("raw").alias("d")).join(pn.laws(null, ["d"]), "series_id").join(found, ["series_id", "t"])
    return online.select("series_id", "t", "d", *[pn.surprise(F.col("found")[i], F.col("law")[0]).alias(k) for i, (_, k) in enumerate(judged)])
