"""Which members to blend: greedy forward selection over within-step ranks, chosen on all folds but one and judged on that one.

Members' ranks are taken once and kept as whole numbers (twice the mean rank), so a blend is a sum of integers and every trial of a round, for every held-out fold,
is one grouping of the same table. The driver sees one number for each trial."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import panel as p
from ..operators.ranks import prefixes
from ..sources.scratch import materialize

LEAST_GAIN = 1e-6


def ranked(rows: DataFrame, members: Sequence[str]) -> DataFrame:
    """(series_id, t, y, fold, a column for each member): twice the member's mean rank within the step, counted from 0."""
    out = rows.select("series_id", "t", "y", "fold", *members)
    for m in members:
        c = rows.groupBy("t", F.col(m).alias("_v")).agg(F.count("*").alias("_n"))
        c = prefixes(c, ["t"], "_v", ["_n"]).select(F.col("t").alias("_t"), "_v", (2 * F.col("_n_below") + F.col("_n")).alias(f"_r_{m}"))
        out = out.join(c, (F.col("t") == F.col("_t")) & (F.col(m) == F.col("_v"))).drop("_t", "_v")
    return materialize(out.select("series_id", "t", "y", "fold", *[F.col(f"_r_{m}").alias(m) for m in members]), "ranks")


def scores(ranks: DataFrame, trials: Sequence[tuple[int, Sequence[str]]], inside: bool = False) -> list[float]:
    """The time-stratified score of each trial (held-out fold, members) over the other folds' rows, or over the fold's own (``inside``)."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("trial"), F.lit(f).alias("held"), sum((F.col(m) for m in ms), F.lit(0)).alias("score")) for i, (f, ms) in enumerate(trials)])).alias("x")
    rows = ranks.select("t", "y", "fold", each).select("x.trial", "t", "y", "x.score", (F.col("fold") == F.col("x.held")).alias("own"))
    got = {r["trial"]: r["auc"] for r in p.pooled(p.per_step(rows.filter(F.col("own") if inside else ~F.col("own")), "trial", "t"), "trial").collect()}
    return [got.get(i, 0.5) for i in range(len(trials))]


def select(ranks: DataFrame, members: Sequence[str], folds: Sequence[int], least_gain: float = LEAST_GAIN) -> dict[int, tuple[list[str], float]]:
    """For each held-out fold the members chosen on the others, in order, and their score there. A round adds the member that helps most (the later one of equals) while it helps by more
    than ``least_gain``."""
    chosen: dict[int, list[str]] = {f: [] for f in folds}
    best = dict.fromkeys(folds, -1.0)
    open_ = list(folds)
    while open_:
        trials = [(f, [*chosen[f], m]) for f in open_ for m in members if m not in chosen[f]]
        if not trials:
            break
        found: dict[int, tuple[float, int, list[str]]] = {}
        for (f, ms), auc in zip(trials, scores(ranks, trials), strict=True):
            found[f] = max(found.get(f, (-2.0, -1, [])), (auc, members.index(ms[-1]), ms))
        open_ = [f for f in open_ if f in found and found[f][0] > best[f] + least_gain]
        for f in open_:
            best[f], _, chosen[f] = found[f]
    return {f: (chosen[f], best[f]) for f in folds}


def portfolio(rows: DataFrame, members: Sequence[str], folds: Sequence[int] = range(5), least_gain: float = LEAST_GAIN) -> tuple[DataFrame, DataFrame]:
    """(fold, chosen, train_auc, test_auc), and the rows with ``blend``: the mean within-step percentile of the members chosen without the row's fold."""
    folds = list(folds)
    ranks = ranked(rows, members)
    picked = select(ranks, members, folds, least_gain)
    tests = scores(ranks, [(f, picked[f][0]) for f in folds], inside=True)
    report = rows.sparkSession.createDataFrame([(f, "+".join(picked[f][0]), picked[f][1], a) for f, a in zip(folds, tests, strict=True)], "fold long, chosen string, train_auc double, test_auc double")
    sizes = ranks.groupBy("t").agg((2 * F.count("*")).alias("_all"))
    blend = F.coalesce(*[F.when(F.col("fold") == f, sum((F.col(m) for m in ms), F.lit(0)) / (F.col("_all") * len(ms))) for f, (ms, _) in picked.items()])
    return report, ranks.join(sizes, "t").withColumn("blend", blend).select("series_id", "t", "y", "fold", "blend")
