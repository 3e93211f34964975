"""Steps that tables of many series made slow: they are computed once, and give what they gave before."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seismark.functions import kernels as k
from seismark.functions import modules as m
from seismark.functions.lengthnull import LengthNull
from seismark.operators import audit
from seismark.operators import neighbours as nb
from seismark.operators import sequential as sq
from seismark.plans import learn
from seismark.queries import QUERIES


def test_router_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf(T.DoubleType())
    def counted(x):
        seen.add(1)
        return float(x * x % 17)

    rows = spark.range(40).select(F.col("id").alias("series_id"), (F.col("id") % 5).alias("fold"), counted("id").alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    assert learn.router(rows, ["a", "b"], k=2).count() == 40
    assert seen.value == 40


def test_run_lengths_of_a_path_are_those_of_its_steps():
    x = np.random.default_rng(3).normal(size=200)
    x[120:] += 2
    for n in (0, 1, 2, 79, 80, 81, 200):
        held = k.RunLength(0.0, 25.0)
        steps = [held.step(v).copy() for v in x[:n]]
        path = k.run_length_path(x[:n], 0.0, 25.0)
        for t, log_p in enumerate(steps):
            np.testing.assert_allclose(path[t, : len(log_p)], log_p, rtol=1e-9, atol=1e-9)
            assert np.isneginf(path[t, len(log_p) :]).all()
        want = np.array([k.run_length_features(log_p, t) for t, log_p in enumerate(steps)]).reshape(-1, 8)
        np.testing.assert_allclose(k.run_length_columns(path), want, rtol=1e-8, atol=1e-10)


def test_nulls_of_several_streams_are_those_of_each():
    rows = np.random.default_rng(4).normal(size=(3, 301))
    lengths = np.array([5, 32, 128])
    for most in (None, 50):
        for x, got in zip(rows, LengthNull.many(m.running(rows), lengths, most), strict=True):
            want = LengthNull.of(lambda w, x=x: m.Context.rolled(x, w), lengths, most=most)
            assert (got.middle == want.middle).all() and (got.scale == want.scale).all()
            assert all((a == b).all() for a, b in zip(got.samples, want.samples, strict=True))


def test_module_columns_come_through_arrow_as_nulls(spark):
    x = np.random.default_rng(5).normal(size=70)
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("short", i, 1.0) for i in range(9)], "series_id string, i long, x double").orderBy(F.rand(1))
    found = m.features(rows, 40, ["m00_core", "m13_scale_indiv"])
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().toString()
    got = {r["t"]: r for r in found.collect()}
    want = m.compute(x[:40], x[40:], ["m00_core", "m13_scale_indiv"])
    assert sorted(got) == list(range(30)) and all(r["series_id"] == "a" for r in got.values())
    for name, column in want.items():
        for t, v in enumerate(column):
            assert got[t][name] is None if np.isnan(v) else got[t][name] == v


def test_a_pair_of_chunks_is_measured_at_once():
    rng = np.random.default_rng(6)
    q, r = np.round(rng.normal(size=271), 1), np.round(rng.normal(size=300), 1)
    took = []
    for _ in range(5):
        begin = time.perf_counter()
        d, place, measured = nb.nearest(q, r, 16, np.full(256, np.inf), None)
        took.append(time.perf_counter() - begin)
    qw, rw = nb.shapes(q, 16)[0], nb.shapes(r, 16)[0]
    whole = np.stack([((rw - v) ** 2).sum(axis=1) for v in qw])
    assert (d == whole.min(axis=1)).all() and (place == whole.argmin(axis=1)).all() and measured < 0.6 * whole.size
    assert min(took) < 0.03  # 256 queries in a loop took 0.045 s where this takes 0.005 s


def test_knots_are_one_aggregate(spark):
    x = np.random.default_rng(7).integers(0, 1000, (3, 300))
    rows = spark.createDataFrame([(s, int(v)) for s, row in enumerate(x) for v in row] + [(9, None)], "series_id long, x long")
    found = audit.ecdf_knots(rows)
    assert "_below" not in found._jdf.queryExecution().toString()  # no running sums of 256 places beside every value
    got = {(r["series_id"], r["k"]): r["q"] for r in found.collect()}
    assert len(got) == 3 * 256
    for (s, k_), q in got.items():
        assert q == np.quantile(x[s], (k_ + 0.5) / 256)


def test_path_values_that_differ_in_their_last_bits_tie(spark):
    rng = np.random.default_rng(8)
    cents = rng.integers(-2, 3, 400) * 100 + 37  # few values: a path meets its own past again and again
    rows = spark.createDataFrame([(1, i, int(c), c / 100.0) for i, c in enumerate(cents.tolist())], "series_id long, i long, cents long, x double")
    got = {r["t"]: r["cur"] for r in sq.path_surprise(rows, 300).collect()}
    x = cents / 100.0
    z = (x - x[:300].mean()) / x[:300].std(ddof=1)

    def path(v):
        up = dn = 0.0
        for s in v:
            up, dn = max(0.0, up + s - 0.5), max(0.0, dn - s - 0.5)
            yield round(max(up, dn), 9)

    null, d = np.sort(np.array(list(path(z[:300])))[64:]), np.array(list(path(z[300:])))
    share = 1 - 0.5 * (np.searchsorted(null, d, "left") + np.searchsorted(null, d, "right")) / len(null)
    inside = d <= null[-1]
    want = -np.log10(np.maximum(share, 0.5 / len(null)))
    assert inside.sum() > 50
    np.testing.assert_allclose(np.array([got[t] for t in range(100)])[inside], want[inside], atol=1e-6)


def test_forests_read_written_rows(spark):
    found = QUERIES["q_rf_baseline"](spark, "/root/testdata/sf0.001")
    assert all("/baseline-" in f for f in found.inputFiles()) and found.inputFiles()
