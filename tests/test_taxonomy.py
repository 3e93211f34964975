"""Break families: planted kinds lead, placebo cuts do not."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seismark.operators import taxonomy as tx

H, N = 120, 160


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(12)
    rows, meta = [], []
    for s in range(160):
        kind = ("location", "scale", "trend", "none")[s % 4] if s < 80 else "none"
        tau = int(rng.integers(30, 110)) if kind != "none" else -1
        x = rng.standard_normal(H + N)
        after = np.arange(H + N) - H - tau
        if kind == "location":
            x = x + 1.5 * (after >= 0) * (tau >= 0)
        elif kind == "scale":
            x = np.where(after >= 0, 2.2 * x, x)
        elif kind == "trend":
            x = x + np.where(after >= 0, 0.06 * after, 0)
        meta.append((s, tau, N, kind))
        rows += [(s, "h" if i < H else "o", i if i < H else i - H, float(v), float(v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "series_id long, part string, t long, z double, e double").cache(), spark.createDataFrame(meta, "series_id long, tau long, n_online long, kind string")


def test_planted_kinds_lead(made):
    rows, meta = made
    cut = tx.cuts(meta)
    assert cut.count() == 160 and cut.filter("not has_break and (cut < 6 or cut > 154)").count() == 0
    found = tx.leaders(tx.surprises(tx.effects(rows, cut), least=50, buckets=())).join(meta, "series_id").collect()
    share = lambda k, f: np.mean([r.family in f for r in found if r.kind == k])
    # a level that moved is a trend as well, and larger values are more tails and another level
    assert share("location", ("location", "trend", "tails")) > 0.9 and share("scale", ("scale", "tails")) > 0.9 and share("trend", ("location", "trend", "scale", "tails")) > 0.9
    assert share("none", ("none",)) > 0.5
    assert np.mean([r.lead for r in found if r.kind != "none"]) > np.mean([r.lead for r in found if r.kind == "none"]) + 0.5


def test_surprise_is_the_placebo_share(made):
    rows, meta = made
    sizes = tx.effects(rows, tx.cuts(meta)).cache()
    got = {(r.series_id, r.family): r.surprise for r in tx.surprises(sizes, least=50, buckets=()).collect()}
    held = sizes.collect()
    for f in tx.FAMILIES:
        null = np.array([round(r[f], 9) for r in held if not r.has_break])
        for r in held:
            p = max(1 - (null <= round(r[f], 9)).sum() / (len(null) + 1), 1 / (len(null) + 1))
            assert got[r.series_id, f] == pytest.approx(min(-np.log10(p), tx.CAP), abs=1e-9)
    assert {v for v in (r.surprise for r in tx.surprises(sizes, least=1000).collect())} == {None}  # too few placebo cuts: no surprise


def test_no_breaks_no_placebo(made):
    rows, meta = made
    assert tx.cuts(meta.filter("tau < 0")).count() == 0 and tx.cuts(meta.limit(0)).count() == 0
    short = meta.withColumn("n_online", F.lit(10).cast("long"))
    assert tx.cuts(short).count() == 0
