"""Nearest subsequences: for every window of m online values, the history's window of the same shape that is nearest, and the nearest earlier online window that
does not overlap it. Windows are compared after their own mean and spread are taken out.

A blocked similarity join: a series is cut into chunks of ``BLOCK`` windows, and pairs of chunks are the unit of work, spread over tasks. Each chunk has a box around the
piecewise means of its windows. The chunk of queries first meets the chunk whose box is nearest, which gives each query an upper bound; of the other
chunks only those go on whose box is nearer than the worst of these bounds, and within a pair of chunks only those pairs of windows are measured
whose piecewise means leave the bound open: sqrt(m / s) times the distance of s piecewise means is never more than the distance of the windows. The result is exact;
``measured`` says how many distances it took."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize

BLOCK, PIECES = 256, 8
#: Windows of a pair of chunks that are measured first for each query, distances taken at once, and pairs of chunks in one frame of results.
FIRST, AT_ONCE, TOGETHER = 8, 1 << 14, 64


def chunks(rows: DataFrame, m: int, block: int = BLOCK) -> DataFrame:
    """rows (series_id, part, t, x), t from 0 in each part -> (series_id, part, chunk, x): the values that the windows beginning at chunk * block .. (chunk + 1) * block - 1 cover."""
    first = F.greatest(F.floor((F.col("t") - m + 1) / block), F.lit(0)).cast("long")
    member = F.explode(F.sequence(first, F.floor(F.col("t") / block).cast("long"))).alias("chunk")
    g = rows.select("series_id", "part", "t", "x", member).groupBy("series_id", "part", "chunk").agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("s"))  # block + m - 1 values at most
    return g.select("series_id", "part", "chunk", F.col("s.x").alias("x")).filter(F.size("x") >= m)


def shapes(x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows without their mean and spread, and their piecewise means times sqrt(m / pieces)."""
    w = np.lib.stride_tricks.sliding_window_view(np.asarray(x, float), m)
    w = w - w.mean(axis=1, keepdims=True)
    sd = w.std(axis=1, keepdims=True)
    w = w / np.where(sd > 1e-12, sd, 1.0)
    s = next(k for k in range(min(PIECES, m), 0, -1) if m % k == 0)
    return w, w.reshape(len(w), s, m // s).mean(axis=2) * np.sqrt(m / s)


def nearest(q: np.ndarray, r: np.ndarray, m: int, bound: np.ndarray, gap: int | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(squared distance, place) of the nearest of r's windows for each of q's, where it is at most ``bound``, else (inf, -1); and the distances measured. ``gap``: only windows of r that
    begin ``gap`` or more before a query's, both counted from r's first."""
    (qw, qp), (rw, rp) = shapes(q, m), shapes(r, m)
    low = np.maximum((qp * qp).sum(1)[:, None] + (rp * rp).sum(1)[None] - 2 * qp @ rp.T, 0.0)
    if gap is not None:  # windows that are not clear of the query's are never open
        low[np.arange(len(rw)) >= np.arange(len(qw))[:, None] + gap] = np.inf
    best, place, measured = np.full(len(qw), np.inf), np.full(len(qw), -1), 0
    limit = np.asarray(bound, float) + 1e-9
    first = min(FIRST, len(rw))
    for last in (False, True):  # the most promising of every query tighten its limit; then all that are still open
        if last:
            i, j = np.nonzero((low <= limit[:, None]) & np.isfinite(low))
        else:
            j = np.argpartition(low, first - 1, axis=1)[:, :first].ravel()
            i = np.repeat(np.arange(len(qw)), first)
            held = (low[i, j] <= limit[i]) & np.isfinite(low[i, j])
            i, j = i[held], j[held]
            low[i, j] = np.inf  # measured
        if not len(i):
            continue
        d = np.concatenate([((rw[j[a : a + AT_ONCE]] - qw[i[a : a + AT_ONCE]]) ** 2).sum(axis=1) for a in range(0, len(i), AT_ONCE)])
        measured += len(i)
        order = np.lexsort((j, d, i))
        top = order[np.flatnonzero(np.diff(i[order], prepend=-1))]  # of equal distances the first place
        q, dq, jq = i[top], d[top], j[top]
        less = (place[q] < 0) | (dq < best[q]) | ((dq == best[q]) & (jq < place[q]))
        best[q[less]], place[q[less]] = dq[less], jq[less]
        limit = np.minimum(limit, best + 1e-9)
    return best, place, measured


def neighbours(rows: DataFrame, m: int, block: int = BLOCK) -> DataFrame:
    """(series_id, t, d_hist, nearest, d_online, measured) of every online window, t its last row; d_online is null where no earlier window is clear of it. measured: distances taken for it."""
    kind = dict(rows.dtypes)["series_id"]
    held = chunks(rows, m, block)

    def boxed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            boxes = [shapes(x, m)[1] for x in f["x"]]
            yield f.assign(lo=[b.min(axis=0).tolist() for b in boxes], hi=[b.max(axis=0).tolist() for b in boxes])

    held = materialize(held.mapInPandas(boxed, f"series_id {kind}, part string, chunk long, x array<double>, lo array<double>, hi array<double>"), "chunks")
    q = held.filter("part = 'o'").select("series_id", F.col("chunk").alias("qc"), F.col("x").alias("qx"), F.col("lo").alias("ql"), F.col("hi").alias("qh"))
    r = held.select("series_id", "part", F.col("chunk").alias("rc"), F.col("x").alias("rx"), "lo", "hi")
    apart = F.aggregate(F.zip_with(F.arrays_zip(F.col("ql").alias("a"), F.col("qh").alias("b")), F.arrays_zip(F.col("lo").alias("c"), F.col("hi").alias("d")), lambda x, y: F.greatest(F.lit(0.0), x["a"] - y["d"], y["c"] - x["b"])), F.lit(0.0), lambda acc, v: acc + v * v)
    # boxes alone are paired here; values follow for the pairs that stay
    may = (F.col("part") == "h") | (F.col("rc") * block + m <= (F.col("qc") + 1) * block - 1)
    pairs = q.drop("qx").join(r.drop("rx"), "series_id").filter(may).select("series_id", "part", "qc", "rc", apart.alias("apart"))
    first = F.row_number().over(Window.partitionBy("series_id", "part", "qc").orderBy("apart", "rc"))
    pairs = materialize(pairs.withColumn("seed", first == 1), "chunk-pairs")

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = []
            for p in f.itertuples(index=False):
                n = len(p.qx) - m + 1
                bound = np.full(n, np.inf) if p.bounds is None else np.asarray(p.bounds, float)
                gap = None if p.part == "h" else (p.qc - p.rc) * block - m + 1
                d, place, measured = nearest(p.qx, p.rx, m, bound, gap)
                made.append((p.series_id, p.part, p.qc, np.arange(n), d, np.where(place >= 0, place + p.rc * block, -1), np.full(n, measured / n)))
                if len(made) == TOGETHER:
                    yield together(made)
                    made = []
            if made:
                yield together(made)

    def together(made: list[tuple]) -> pd.DataFrame:
        sizes = [len(x[3]) for x in made]
        once = {c: pd.Series([x[k] for x in made]).repeat(sizes).reset_index(drop=True) for k, c in enumerate(("series_id", "part", "qc"))}
        return pd.DataFrame(once | {c: np.concatenate([x[k] for x in made]) for k, c in enumerate(("i", "d", "place", "measured"), 3)})

    schema = f"series_id {kind}, part string, qc long, i long, d double, place long, measured double"
    with_values = lambda p: p.join(q.select("series_id", "qc", "qx"), ["series_id", "qc"]).join(r.select("series_id", "part", "rc", "rx"), ["series_id", "part", "rc"])
    order = ["series_id", "part", "qc", "rc", "qx", "rx", "bounds"]
    seeds = materialize(with_values(pairs.filter("seed")).withColumn("bounds", F.lit(None).cast("array<double>")).select(order).mapInPandas(measure, schema), "seeds")
    bounds = seeds.groupBy("series_id", "part", "qc").agg(F.array_sort(F.collect_list(F.struct("i", "d"))).alias("b"), F.max("d").alias("worst"))  # block entries at most
    rest = pairs.filter("not seed").join(bounds, ["series_id", "part", "qc"]).filter("apart <= worst + 1e-9").select("series_id", "part", "qc", "rc", F.col("b.d").alias("bounds"))
    found = seeds.unionByName(with_values(rest).select(order).mapInPandas(measure, schema))
    best = found.groupBy("series_id", "part", "qc", "i").agg(F.min(F.when(F.col("place") >= 0, F.struct("d", "place"))).alias("best"), F.sum("measured").alias("measured"))
    of = lambda part, c: F.max(F.when(F.col("part") == part, c))
    out = best.groupBy("series_id", (F.col("qc") * block + F.col("i") + m - 1).alias("t")).agg(of("h", F.sqrt("best.d")).alias("d_hist"), of("h", F.col("best.place")).alias("nearest"), of("o", F.sqrt("best.d")).alias("d_online"), F.sum("measured").alias("measured"))
    return out.filter("d_hist is not null")


def geometry(found: DataFrame, windows: int) -> DataFrame:
    """``provenance``: log1p distance to the history less that to the online past; ``arc``: share so far of nearest windows in the last quarter of the history's ``windows``."""
    over = Window.partitionBy("series_id").orderBy("t")
    late = F.when(F.col("nearest") >= -(-3 * windows // 4), 1.0).otherwise(0.0)
    return found.withColumns({"provenance": F.log1p("d_hist") - F.log1p("d_online"), "arc": F.sum(late).over(over.rowsBetween(Window.unboundedPreceding, 0)) / F.row_number().over(over)})
