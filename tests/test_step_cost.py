"""Steps whose cost for each series made long tables slow: they do less, and give what they gave before."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from seismark.functions import kernels as k
from seismark.functions import modules, packs
from seismark.functions.lengthnull import LengthNull, restarts, spread
from seismark.operators import calibrate
from seismark.operators import detectors as det
from seismark.operators import panel, scan
from seismark.plans import battery, learn
from seismark.queries import QUERIES
from seismark.sources import series
from seismark.streaming import engine


class Value:
    def __init__(self):
        self.held, self.reads, self.writes = None, 0, 0

    def get(self):
        self.reads += 1
        return self.held

    def update(self, value: tuple) -> None:
        self.held, self.writes = value, self.writes + 1


class Handle:
    def __init__(self):
        self.made: list[Value] = []

    def getValueState(self, *_, **__) -> Value:  # noqa: N802
        self.made.append(Value())
        return self.made[-1]

    getListState = getValueState  # noqa: N815


def test_engine_reads_and_writes_one_state_value_a_batch():
    cents = np.round(np.random.default_rng(1).normal(size=700) * 100).astype(int)
    one, handle, got = engine.Engine(40, None), Handle(), []
    one.init(handle)
    for begin, end in ((0, 30), (30, 70), (70, 600), (600, 700)):
        at = np.arange(begin, end)[::-1]  # rows of a batch come in any order
        frame = pd.DataFrame({"ts_us": at, "row_id": at, "cents": cents[at]})
        got += list(one.handleInputRows((7,), iter([frame[:20], frame[20:]]), None))
        assert len(handle.made) == 1 and handle.made[0].reads == handle.made[0].writes
        assert len(handle.made[0].held[-1]) == min(max(end - 39, 0), engine.RING)  # no more of the ring than is in use
    assert handle.made[0].reads == 4
    rows = pd.concat(got, ignore_index=True)
    assert rows["t"].tolist() == list(range(660)) and set(rows["series_id"]) == {7}
    np.testing.assert_array_equal(rows[engine.COLUMNS].to_numpy(), engine.arrays(cents / 100, 40))


def test_pelt_breaks_are_those_of_all_starts_and_come_without_frames(spark):
    rng = np.random.default_rng(2)
    series = [np.round(np.repeat(rng.normal(size=n) * 3, 17) + rng.normal(size=17 * n), 2) for n in (1, 3, 9)]
    for x in series:  # every start is tried at every end
        n, beta = len(x), 2 * np.log(len(x)) * x.var()
        cost, last = [-beta] + [np.inf] * n, [0] * (n + 1)
        for end in range(2, n + 1):
            of = [cost[a] + float(((x[a:end] - x[a:end].mean()) ** 2).sum()) + beta for a in range(end - 1)]
            cost[end], last[end] = min(of), int(np.argmin(of))
        cuts, at = [], last[n]
        while at:
            cuts, at = [at, *cuts], last[at]
        assert det.pelt_breaks(x) == cuts
    rows = [(k, i, float(v)) for k, x in enumerate(series) for i, v in enumerate(x)]
    found = det.pelt(spark.createDataFrame(rows, "series_id long, i long, x double").orderBy("x"))
    got = {k: f.sort_values("i") for k, f in found.toPandas().groupby("series_id")}
    for k, x in enumerate(series):
        cuts = det.pelt_breaks(x)
        assert np.flatnonzero(got[k]["flag"]).tolist() == cuts and got[k]["i"].tolist() == list(range(len(x)))
        want = np.concatenate([np.full(z - a, abs(x[a:z].mean() - x.mean())) for a, z in zip([0, *cuts], [*cuts, len(x)], strict=True)])
        np.testing.assert_allclose(got[k]["score"], want, atol=1e-6)
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_garch_nodes_are_folded_over_a_history_in_one_pass(spark):
    rng = np.random.default_rng(3)
    nodes = [(a, b) for a in k.GARCH_A for b in k.GARCH_B if a + b <= k.GARCH_MOST]
    past = {s: rng.normal(size=120) ** 2 * (1 + s * (np.arange(120) > 60)) for s in range(4)}
    df = spark.createDataFrame([(s, v.tolist()) for s, v in past.items()], "series_id long, past array<double>")
    burn = k.burn_in(120)
    for r in scan.garch_best(df, "past", nodes, burn).collect():
        q = past[r.series_id]
        assert (r.arch, r.garch) == k.garch_fit(q)
        assert abs(r.after - k.garch_before(np.append(q, 0.0), r.arch, r.garch)[-1]) < 1e-9
    plan = QUERIES["q_garch"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan.lower()  # the history is not multiplied by the nodes


def test_nulls_of_restarts_take_all_places_in_one_call():
    hist, seen = np.random.default_rng(4).normal(size=300), []

    def path(segments, anchors):
        seen.append(segments.shape)
        c = np.cumsum(segments, axis=-1)
        return [c[..., anchors - 1], np.maximum.accumulate(c, axis=-1)[..., anchors - 1]]

    anchors = np.array([8, 32, 128, 512])
    nulls = restarts(path, hist, anchors, 128, 16)
    assert seen == [(16, 128)]
    for a in (8, 32, 128):
        sums = np.array([hist[p : p + 128].cumsum() for p in np.linspace(0, 172, 16).astype(int)])
        for null, of in zip(nulls, (sums[:, a - 1], sums[:, :a].max(axis=1)), strict=True):
            i = null.lengths.tolist().index(a)
            assert (null.samples[i] == np.sort(of)).all() and (null.middle[i], null.scale[i]) == spread(of)


def test_a_scan_is_judged_by_many_restarts_of_a_short_history():
    """A history shorter than the scan's span gave one restart, without spread: every z lay at the clip."""
    rng = np.random.default_rng(12)
    for n in (40, 300, 1024):
        c = modules.Context(rng.normal(size=n), rng.normal(size=200))
        got = modules.compute(c.hist, c.online, ["m11_focus"])
        z = np.stack([got[f"m11_focus__{tag}_z"] for tag in modules.FOCUS])
        assert (np.abs(z) < modules.FOCUS_CLIP).mean() > 0.9 and len(np.unique(got["m11_focus__mean_pct"])) > 5
        x = np.stack([c.h["mean"], c.h["sq"]])
        both = restarts(modules._focus_at, x, modules.FOCUS_ANCHORS, modules.FOCUS_SPAN, modules.FOCUS_RESTARTS)
        for r, one in enumerate(x):
            alone = restarts(modules._focus_at, one, modules.FOCUS_ANCHORS, modules.FOCUS_SPAN, modules.FOCUS_RESTARTS)
            for null, several in zip(alone, both, strict=True):
                assert (several[r].middle == null.middle).all() and (several[r].scale == null.scale).all()
                assert [len(v) for v in null.samples] == [min(24, n - int(a) + 1) for a in null.lengths] and min(map(len, null.samples)) >= 8
                assert null.lengths.tolist() == [a for a in modules.FOCUS_ANCHORS if a <= n - 7] and null.scale.min() > 1e-6
            i = alone[0].lengths.tolist().index(16)
            places = np.unique(np.linspace(0, n - 16, 24).astype(int))  # over the whole history
            assert np.allclose(alone[0].samples[i], np.sort([k.focus_path(one[p : p + 16])[0][-1] for p in places]))


def test_costly_functions_of_series_are_spread_by_rows(spark, monkeypatch):
    """Spark left the repartition out, as the numbering had grouped the rows already, and joined its own partitions into one or a few."""
    monkeypatch.setattr(series, "SPREAD_ROWS", 500)
    for name in ("q_feat_all", "q_feat_m18_wctm", "q_feat_m17_hankel_dmd", "q_feat_m01_seq"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
        assert re.findall(r"hashpartitioning\(series_id#\d+L, (\d+)\), (\w+)", plan) == [(str(-(-rows // 500)), "REPARTITION_BY_NUM")], name
    got = QUERIES["q_feat_m18_wctm"](spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(series, "SPREAD_ROWS", 1 << 14)
    assert got.exceptAll(QUERIES["q_feat_m18_wctm"](spark, "/root/testdata/sf0.001")).count() == 0


def test_scans_of_several_series_are_those_of_each():
    rng = np.random.default_rng(13)
    for n in (0, 1, 9, 33, 70, 300):
        x = np.concatenate((rng.normal(size=(3, n)), np.zeros((1, n)), rng.integers(-1, 2, (2, n))))
        got = k.focus_paths(x)
        for r, one in enumerate(x):
            assert all(np.array_equal(a[r], b) for a, b in zip(got, k.focus_path(one), strict=True))
            s = np.concatenate(([0.0], np.cumsum(one)))
            for t in range(1, n + 1, 7):
                d = t - np.arange(t)
                gain = (s[t] - s[:t]) ** 2 / (2 * d)
                far = gain[np.abs(np.log(d) - np.log(got[1][r, t - 1])) > 2.0]
                assert got[0][r, t - 1] == gain.max() and got[1][r, t - 1] == d[gain.argmax()] and got[2][r, t - 1] == max(far, default=0.0)


def test_modules_take_several_series_at_once_as_they_take_each():
    rng = np.random.default_rng(14)
    some = [modules.Context(rng.normal(size=90), rng.standard_t(3, n)) for n in (40, 7, 33, 200, 1)]
    for name in ("m07_bocpd", "m17_kalman_nis"):
        alone = [modules.table(c.hist, c.online, [name]) for c in some]
        modules.TOGETHER[name](some)
        assert all(any(key[0] == "once" for key in c.cache) for c in some)
        for c, want in zip(some, alone, strict=True):
            np.testing.assert_allclose(modules._table(c, [name]), want, rtol=1e-6)
    seen, fits = [], k.kalman_fits(np.stack([c.h["mean"] for c in some]), np.stack([c.phi for c in some]))
    for c, fit in zip(some, fits, strict=True):
        want = k.kalman_fit(c.h["mean"], tuple(c.phi))
        seen.append((fit.q, fit.r) == (want.q, want.r) and np.allclose((*fit.x, *fit.p), (*want.x, *want.p), rtol=1e-9))
    assert all(seen)


def test_rows_of_z_are_those_of_each_null():
    rng = np.random.default_rng(15)
    for lengths in (np.array([5, 8, 32, 96]), np.array([12])):
        for beyond in (False, True):
            nulls = [LengthNull.of(lambda w, j=j: rng.normal(j, w**-0.5, 40), lengths, beyond=beyond) for j in range(3)]
            at = np.array([1.0, 5, 6.5, 32, 90, 96, 97, 400])
            v = rng.normal(size=(3, len(at)))
            v[1, 2] = np.nan
            for clip in (None, 2.0):
                got = LengthNull.z_rows(nulls, at, v, clip)
                assert all(np.array_equal(g, null.z(at, x, clip), equal_nan=True) for g, null, x in zip(got, nulls, v, strict=True))


def test_nulls_of_several_statistics_are_those_of_each():
    rows = {16: np.random.default_rng(5).normal(size=(4, 90)), 64: np.random.default_rng(6).normal(size=(4, 7)), 256: np.zeros((4, 0))}
    lengths = np.array(list(rows))
    for hole in (False, True):
        if hole:
            rows[16][2, 5] = np.nan
        for tails in (False, True):
            for r, got in enumerate(LengthNull.stacked(lambda w: rows[w], lengths, tails, True)):
                want = LengthNull.of(lambda w, r=r: rows[w][r], lengths, tails, None, True)
                assert (got.middle == want.middle).all() and (got.scale == want.scale).all()
                at = np.array([1.0, 16, 40, 900])
                assert (got.z(at, at, 9.0) == want.z(at, at, 9.0)).all() and (got.z(at, at, 9.0, want._place(at)) == want.z(at, at, 9.0)).all()


def test_dynamics_take_the_bands_of_a_window_once(monkeypatch):
    seen = []
    monkeypatch.setattr(packs, "band_shares", lambda m, f=packs.band_shares: seen.append(1) or f(m))
    x = np.random.default_rng(7).normal(size=600)
    modules.table(x[:300], x[300:], ["m03_dyn"])
    assert len(seen) <= 6  # three windows of the history, one or two of the online rows; 13 before


def test_time_cdf_finds_order_statistics_by_their_place_and_keeps_them(spark):
    rng = np.random.default_rng(8)
    t, s = rng.integers(0, 30, 700), np.round(rng.random(700), 2)
    rows = spark.createDataFrame([(int(a), float(b)) for a, b in zip(t, s, strict=True)], "t long, score double")
    for at, quantiles, least in (([0, 3, 29], 16, 40), ([0, 3, 29], 256, 500), ([0, 29], 2, 1)):
        made = calibrate.fit_time_cdf(rows, at, quantiles, least)
        assert all("/grid-" in f for f in made.inputFiles())  # scores are ranked once, whatever reads the grid
        half = (np.log1p(at[-1]) - np.log1p(at[0])) / (len(at) - 1)
        want = []
        for a in at:
            near = np.sort(s[(t >= np.round(np.expm1(np.log1p(a) - half), 9)) & (t <= np.round(np.expm1(np.log1p(a) + half), 9))])
            near = near if len(near) >= least else np.sort(s)
            want += [(a, k_, float(near[k_ * (len(near) - 1) // (quantiles - 1)])) for k_ in range(quantiles)]
        assert sorted(map(tuple, made.collect())) == want
    one = calibrate.fit_time_cdf(rows.limit(1), [0, 3, 29], 4, 1).collect()
    assert len({r.q for r in one}) == 1 and len(one) % 4 == 0


def test_arms_that_differ_in_persistence_share_their_fits(spark, tmp_path, monkeypatch):
    fits = []
    monkeypatch.setattr(learn, "logistic", lambda f=learn.logistic: fits.append(1) or f())
    rows = spark.range(240).selectExpr("id % 12 as series_id", "id div 12 as t", "(id % 12) % 3 as fold", "cast(id % 2 as long) as y", "cast((id * 7) % 11 as double) as b")
    arms = [battery.Arm("level", ("b",)), battery.Arm("held", ("b",), persistence="runmax")]
    keys = battery.run(rows, arms, f"file://{tmp_path}/book", range(3))
    assert len(fits) == 3 and len(set(keys)) == 2
    got = {r["key"]: r["pooled"] for r in battery.ledger(spark, f"file://{tmp_path}/book").collect()}
    for key, arm in zip(keys, arms, strict=True):
        scored = battery.scores(rows, arm, [0, 1, 2]).withColumn("score", F.round("score", 9))
        assert abs(got[key] - panel.pooled(panel.per_step(scored, "t")).first()["auc"]) < 1e-12
