"""Series engine: SQL twins, prefix invariance, brute force, batch and stream parity."""

from __future__ import annotations

import math
import os
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from seismark.functions import kernels as k
from seismark.functions import modules as m
from seismark.functions import packs
from seismark.operators import audit, ranks
from seismark.operators import detectors as det
from seismark.operators import panel as p
from seismark.operators import windows as w
from seismark.queries import ORACLE, QUERIES
from seismark.sources import files, generate
from seismark.streaming import features, scores

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, (bool, int, str)):
        return v
    return None if math.isnan(v) else round(float(v), 9)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_twin(spark, duck, name):
    df = QUERIES[name](spark, SF)
    ours = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    got = duck.execute(ORACLE[name])
    cols = [d[0] for d in got.description]
    theirs = sorted(repr([plain(r[cols.index(c)]) for c in sorted(cols)]) for r in got.fetchall())
    assert sorted(cols) == sorted(df.columns)
    assert ours == theirs


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["t", "n_pos", "n_neg", "num2", "w", "auc"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_not_import_llm():
    root = Path(entry.__file__).parent / "seismark"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"import .*\bllm\b|from .*\bllm\b", f.read_text()), f


@pytest.mark.parametrize("name", sorted(m.REGISTRY))
@pytest.mark.parametrize("kind", ["noise", "constant", "outlier", "heavy"])
def test_modules_look_at_no_future(name, kind):
    rng = np.random.default_rng(3)
    h, o = rng.normal(size=700), rng.normal(size=120)
    if kind == "constant":
        h = np.full(700, 2.0)
    if kind == "heavy":
        h, o = rng.standard_t(3, 700), rng.standard_t(3, 120)
    if kind == "outlier":
        o[40] = 1e6
    whole = m.compute(h, o, [name])
    assert list(whole) == m.columns([name])
    cut = m.compute(h, o[:70], [name])
    other = m.compute(h, np.concatenate((o[:70], rng.normal(size=300) * 1e6)), [name])
    for c in whole:
        np.testing.assert_array_equal(whole[c][:70], cut[c])
        np.testing.assert_array_equal(other[c][:70], cut[c])


@pytest.mark.parametrize("name", sorted(m.REGISTRY))
def test_modules_run_on_executors(spark, name):
    """In a process that imports what a worker imports, and nothing else."""
    rng = np.random.default_rng(4)
    x = {s: rng.normal(size=360) for s in (1, 2)}
    rows = spark.createDataFrame([(s, i, float(v)) for s, v in x.items() for i, v in enumerate(x[s])], "series_id long, i long, x double")
    got = m.features(rows, 300, [name]).orderBy("series_id", "t").toPandas()
    assert len(got) == 120
    for s in x:
        want = m.compute(x[s][:300], x[s][300:], [name])
        for c, v in want.items():
            np.testing.assert_allclose(got[got.series_id == s][c].to_numpy(float), v, rtol=1e-6)


@pytest.fixture(scope="module")
def one_series():
    rng = np.random.default_rng(11)
    h = rng.normal(size=420).cumsum() * 0.05 + rng.normal(size=420)
    return m.Context(h, np.concatenate((rng.normal(size=60), rng.normal(0.5, 2.0, size=60)))), h


def interpolated(lengths, values, length, logs=False):
    v = [math.log(x) for x in values] if logs else values
    y = float(np.interp(math.log(length), [math.log(w) for w in lengths], v))
    return math.exp(y) if logs else y


def test_suffix_contrasts_by_definition(one_series):
    c, _ = one_series
    got = m.compute(c.hist, c.online, ["m09_back"])
    grid = [w for w in (5, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024) if 2 * w <= len(c.hist)]
    for tag, name in (("lv", "mean"), ("rs", "res_abs"), ("dp", "lag1")):
        hist, x = c.h[name], c.o[name]
        middle, spread = [], []
        for w in grid:
            r = [hist[i : i + w].mean() for i in range(len(hist) - w + 1)]
            q1, q3 = np.quantile(r, (0.25, 0.75))
            middle.append(float(np.median(r)))
            spread.append(max((q3 - q1) / 1.349, float(np.std(r)), 1e-12))
        for t in (11, 12, 40, 80, 119):
            d = {}
            for k_ in (4, 8, 16, 32, 64, 128, 256):
                if t + 1 - k_ >= 8:
                    gap = x[t + 1 - k_ : t + 1].mean() - x[: t + 1 - k_].mean()
                    d[k_] = float(np.clip(gap / math.hypot(interpolated(grid, spread, k_, True), interpolated(grid, spread, t + 1 - k_, True)), -40, 40))
            if not d:
                assert np.isnan(got[f"m09_back__{tag}_dmax"][t])
                continue
            best = max(d, key=lambda w: abs(d[w]))
            rest = t + 1 - best
            want = {"dmax": d[best], "dkf": best / (t + 1), "d8": d.get(8, math.nan), "d32": d.get(32, math.nan), "dsh": max(abs(v) for w, v in d.items() if w <= 16), "dlg": max((abs(v) for w, v in d.items() if w >= 64), default=math.nan)}
            want["pre"] = float(np.clip((x[:rest].mean() - interpolated(grid, middle, rest)) / interpolated(grid, spread, rest, True), -40, 40))
            for key, v in want.items():
                assert got[f"m09_back__{tag}_{key}"][t] == pytest.approx(v, rel=1e-4, abs=1e-5, nan_ok=True), (tag, t, key)
    assert (got["m09_back__lv_dmax"][30:] < 0).any() or (m.compute(c.hist, c.online - 3, ["m09_back"])["m09_back__lv_dmax"][70:] < 0).any()


def test_observers_by_definition(one_series):
    c, _ = one_series
    z, q, r, phi = c.h["mean"], 0.05, 0.20, (0.4, 0.1)
    f, e1 = np.array([[phi[0], phi[1]], [1, 0]]), np.array([1.0, 0.0])
    seen, x, p = k.Kalman(phi, q, r, z[:2]), np.array([z[1], z[0]]), np.eye(2)
    for v in z[2:60]:
        x, p = f @ x, f @ p @ f.T + np.diag([q, 0.0])
        s = p[0, 0] + r
        assert seen.step(v) == pytest.approx((v - x[0], s))
        x, p = x + p[:, 0] / s * (v - x[0]), (np.eye(2) - np.outer(p[:, 0] / s, e1)) @ p
    assert k.KALMAN_Q == (0.01, 0.05, 0.20) and k.KALMAN_R == (0.05, 0.20, 1.00)
    o, v = k.DelayObserver(z), k.delays(z)
    u, s, w = np.linalg.svd(v[:-1].T, full_matrices=False)
    a = (v[1:].T @ (w[:4].T / s[:4])) @ u[:, :4].T
    np.testing.assert_allclose(o.operator, a, atol=1e-8)
    np.testing.assert_allclose(o.gap(z, 5)[5:], np.linalg.norm(v[:-5] @ np.linalg.matrix_power(a, 5).T - v[5:], axis=1) / 4, atol=1e-8)
    np.testing.assert_allclose(o.outside(z), [np.linalg.norm(y - u[:, :4] @ (u[:, :4].T @ y)) / np.linalg.norm(y) for y in v], atol=1e-6)
    rank = k.effective_rank(v, 32)
    for t in (31, 90):
        sv = np.linalg.svd(v[t - 31 : t + 1], compute_uv=False)
        assert rank[t] == pytest.approx(math.exp(-sum(x * math.log(x) for x in sv / sv.sum() if x > 0)), rel=1e-6)


def test_scales_bets_and_excursions_by_definition(one_series):
    c, _ = one_series
    got = m.compute(c.hist, c.online, ["m13_scale_indiv", "m13_scale_surv", "m16_joint_rarity", "m16_dwell_rarity", "m18_uctm", "m18_wctm", "m15_ordinal_irrev"])
    hist, live = c.res
    for w in (1, 4, 32):
        null = [hist[i : i + w].mean() for i in range(len(hist) - w + 1)]
        for t in (31, 77, 119):
            p = (sum(v <= live[t - w + 1 : t + 1].mean() + 1e-12 for v in null) + 0.5) / (len(null) + 1)
            assert got[f"m13_scale_indiv__surprise_b{w}"][t] == pytest.approx(-math.log10(max(2 * min(p, 1 - p), 1 / (len(null) + 1))), abs=0.02)
    past = np.array([hist[i : i + 32].mean() for i in range(len(hist) - 31)])
    middle = np.median(past)
    band = np.quantile(np.abs(past - middle), 0.9)

    def live_states(x):
        run, peak, out = 0, 0.0, []
        for v in x:
            run, peak = (run + 1, max(peak, abs(v - middle) - band)) if abs(v - middle) > band else (0, 0.0)
            out.append((run, peak))
        return out

    before = live_states(past)
    for t, (run, peak) in enumerate(live_states([live[i : i + 32].mean() for i in range(len(live) - 31)]), 31):
        for kind, n in (("dwell", sum(a >= run for a, _ in before)), ("joint", sum(a >= run and b >= peak for a, b in before))):
            want = -math.log10(max(n / len(past), 1 / (2 * len(past)))) if run else 0.0
            assert got[f"m16_{kind}_rarity__{kind}_live_w32"][t] == pytest.approx(want, abs=1e-3)
    u = c.o["u"] - 0.5
    usual = float((np.abs(c.h["u"] - 0.5) > 0.4).mean())
    capital = [1.0] * 6
    for t, v in enumerate(u):
        for i, b in enumerate((-0.9, -0.6, -0.3, 0.3, 0.6, 0.9)):
            capital[i] *= 1 + (b / usual if b > 0 else b / (1 - usual)) * ((abs(v) > 0.4) - usual)
        assert got["m18_uctm__uctm_tail_log"][t] == pytest.approx(math.log(sum(capital) / 6), abs=1e-3)
    weights = m.tail_weight(c.h["u"] - 0.5, u)
    np.testing.assert_array_equal(weights[:50], m.tail_weight(c.h["u"] - 0.5, np.concatenate((u[:49], [0.5]))))
    code = lambda a, b, d: [0, 1, 3, 4, 6, 7].index(4 * (a > b) + 2 * (a > d) + (b > d))
    z = c.h["mean"]
    seq = [code(*z[i : i + 3]) for i in range(len(z) - 2)]
    both = np.concatenate((z[-2:], c.o["mean"]))
    new = [seq[-1]] + [code(*both[i : i + 3]) for i in range(len(c.online))]
    ref = np.full((6, 6), 0.5)
    np.add.at(ref, (seq[:-1], seq[1:]), 1)
    ref /= ref.sum()
    for t in (15, 60, 119):
        p = np.full((6, 6), 0.5)
        np.add.at(p, (new[: t + 1], new[1 : t + 2]), 1)
        p /= p.sum()
        assert got["m15_ordinal_irrev__trans_kl_exp"][t] == pytest.approx(float((p * np.log(p / ref)).sum()), rel=1e-4)


def test_column_guards():
    names = ["m00_core__exp_z_mean", "m07_bocpd__bo_p10", "m09_back__lv_d8", "m05_ctx__tail4"]
    assert audit.select_columns(names, "m0[09]", ("exp",)) == ["m09_back__lv_d8"]
    audit.guard_columns(names)
    for bad in ("tau", "m01__tau_hat", "x_has_break", "n_online"):
        with pytest.raises(ValueError, match=bad):
            audit.guard_columns([*names, bad])


def test_quantiles_positions_and_tiles_of_any_group(spark):
    rng = np.random.default_rng(5)
    rows = [(g, int(i), float(v)) for g, n in (("a", 3000), ("b", 7), ("c", 1)) for i, v in enumerate(rng.integers(0, 40, n) / 4)]
    df = spark.createDataFrame(rows, "g string, id long, v double")
    got = {(r.g, r.k): r.q for r in ranks.order_statistics(df, "v", (0.0, 0.1, 0.5, 0.77, 1.0), ("g",)).collect()}
    for g in "abc":
        v = [x for h, _, x in rows if h == g]
        for k_, s in enumerate((0.0, 0.1, 0.5, 0.77, 1.0)):
            assert got[g, k_] == pytest.approx(float(np.quantile(v, s)))
    from pyspark.sql import functions as F

    at = ranks.positions(df, ["g"], "v", "id").withColumn("tile", ranks.tile(F.col("pos"), F.col("n"), 4)).collect()
    for g in "abc":
        order = sorted((x, i) for h, i, x in rows if h == g)
        seen = {r.id: r for r in at if r.g == g}
        assert [seen[i].pos for _, i in order] == list(range(len(order)))
        size, rest = divmod(len(order), 4)
        assert [seen[i].tile for _, i in order] == [k_ + 1 for k_ in range(4) for _ in range(size + (k_ < rest))]


def test_occupancy_by_definition():
    rng = np.random.default_rng(13)
    c = m.Context(rng.normal(size=700), rng.normal(0, 1.5, size=150))
    got = m.compute(c.hist, c.online, ["m02_dist"])
    uh, u = c.h["u"], c.o["u"]

    def chi2(x, bins=20):
        n = np.bincount(np.minimum((x * bins).astype(int), bins - 1), minlength=bins)
        return ((n - len(x) / bins) ** 2 / (len(x) / bins)).sum()

    t = 140
    null = np.array([chi2(uh[i : i + 128]) for i in range(len(uh) - 127)])
    null = np.sort(null[np.linspace(0, len(null) - 1, 500).astype(int)])
    v = chi2(u[t - 127 : t + 1])
    p = 0.5 * ((null < v - 1e-9).sum() + (null <= v + 1e-9).sum()) / 500
    assert got["m02_dist__dv_u_w128_chi2"][t] == pytest.approx(min(6, -math.log10(max(1 - p, 1 / 1000))), abs=1e-3)
    share = np.bincount((u[: t + 1] * 20).astype(int), minlength=20) / (t + 1)
    assert got["m02_dist__dv_u_exp_js_raw"][t] == pytest.approx(0.5 * sum((a * math.log(a / ((a + 0.05) / 2)) if a else 0) + 0.05 * math.log(0.05 / ((a + 0.05) / 2)) for a in share), abs=1e-6)
    f = np.cumsum(share)
    k_ = int((f < 0.5).sum())
    assert got["m02_dist__qd_exp_q50_raw"][t] == pytest.approx((k_ + (0.5 - (f[k_ - 1] if k_ else 0)) / (f[k_] - (f[k_ - 1] if k_ else 0))) / 20 - 0.5, abs=1e-6)
    drift = max(abs((u[: i + 1] - 0.5).sum()) for i in range(t + 1)) / math.sqrt((t + 1) / 12)
    assert got["m02_dist__rk_cusum_u_raw"][t] == pytest.approx(drift, rel=1e-5)
    d = uh[:128] - 0.5
    assert packs.window_drifts(uh, 128)[0] == pytest.approx(np.abs(np.cumsum(d)).max() / math.sqrt(128 / 12))


def test_dynamics_by_definition():
    rng = np.random.default_rng(12)
    c = m.Context(rng.normal(size=800), np.concatenate((rng.normal(size=60), rng.normal(size=80).cumsum() * 0.3)))
    got = m.compute(c.hist, c.online, ["m03_dyn"])
    z, e = np.concatenate((c.h["mean"][-40:], c.o["mean"])), np.concatenate((c.h["res_mean"][-40:], c.o["res_mean"]))
    for t in (69, 100, 139):
        w = (t + 1) // 2
        at = range(40 + t + 1 - w, 40 + t + 1)
        x = z[at.start : at.stop]
        assert got["m03_dyn__drift_h"][t] == pytest.approx(np.polyfit(np.arange(w), x, 1)[0] * w, rel=1e-4, abs=1e-5)
        assert got["m03_dyn__mk8"][t] == pytest.approx(np.mean([np.sign(z[i] - z[i - 8]) for i in at]), abs=1e-6)
        assert got["m03_dyn__vr_he"][t] == pytest.approx(math.log((e[at.start : at.stop] ** 2).mean() / (e[40 + t + 1 - 2 * w : at.stop] ** 2).mean()), abs=1e-5)
        d1, d2 = [z[i] - z[i - 1] for i in at], [z[i] - 2 * z[i - 1] + z[i - 2] for i in at]
        assert got["m03_dyn__hj_mob"][t] == pytest.approx(0.5 * math.log(np.var(d1) / np.var(x)), abs=1e-5)
        assert got["m03_dyn__hj_comp"][t] == pytest.approx(0.5 * (math.log(np.var(d2) / np.var(d1)) - math.log(np.var(d1) / np.var(x))), abs=1e-5)
        energy = {s: np.mean([(z[i - s + 1 : i + 1].sum() - z[i - 2 * s + 1 : i - s + 1].sum()) ** 2 / (2 * s) for i in at]) for s in (1, 2, 4, 8)}
        assert got["m03_dyn__hw_r24"][t] == pytest.approx(math.log(energy[2] / energy[4]), abs=1e-5)
        power = [abs(sum(z[i] * np.exp(-2j * np.pi * f * i) for i in at)) ** 2 for f in (0.5, 0.25, 0.125, 0.0625, 0.03125, 0.015625)]
        assert got["m03_dyn__sp_low"][t] == pytest.approx(sum(power[4:]) / sum(power), abs=1e-5)
        code = [4 * (z[i - 2] > z[i - 1]) + 2 * (z[i - 2] > z[i]) + (z[i - 1] > z[i]) for i in at]
        share = [code.count(v) / w for v in set(code)]
        assert got["m03_dyn__pe_half"][t] == pytest.approx(-sum(p * math.log(p) for p in share) / math.log(6), abs=1e-5)
    x, back = z[40 : 40 + 100], z[38 : 38 + 100]
    acf = ((x * back).mean() - x.mean() ** 2) / x.var()
    past, zh = [], c.h["mean"][40:]
    ends = np.arange(128, len(zh) + 1)
    for i in ends[:: max(1, len(ends) // 700)]:
        v, b = zh[i - 64 : i], c.h["mean"][38 + i - 64 : 38 + i]
        past.append(((v * b).mean() - v.mean() ** 2) / v.var())
    q = np.quantile(past, (0.05, 0.25, 0.5, 0.75, 0.95))
    assert got["m03_dyn__az_x_exp_l2_z"][63] == pytest.approx((((z[40:104] * z[38:102]).mean() - z[40:104].mean() ** 2) / z[40:104].var() - q[2]) / max((q[3] - q[1]) / 1.349, (q[4] - q[0]) / 3.29), rel=1e-3)
    assert abs(acf) <= 1


def test_fingerprint_by_definition():
    rng = np.random.default_rng(8)
    h = rng.standard_t(4, size=900)
    c = m.Context(h, rng.normal(size=20))
    f, z, n = packs.fingerprint(c), (h - h.mean()) / h.std(ddof=1), 900
    r = [sum((z[t] - z.mean()) * (z[t - j] - z.mean()) for t in range(j, n)) / sum((z - z.mean()) ** 2) for j in (1, 2)]
    assert f["h_acf1"] == pytest.approx(r[0]) and f["h_pacf2"] == pytest.approx((r[1] - r[0] ** 2) / (1 - r[0] ** 2)) and f["h_adf_nrho"] == pytest.approx(n * (r[0] - 1))
    up = np.sort(np.maximum(h - np.median(h), 0))[::-1]
    assert f["h_hill_hi"] == pytest.approx(1 / np.log(up[:45] / up[45]).mean())
    s = [z[i : i + 10].sum() for i in range(n - 9)]
    assert f["h_vr10"] == pytest.approx(np.var(s) / (10 * z.var()))
    x = z[-512:] - z[-512:].mean()
    power = [abs(sum(x[t] * np.hanning(512)[t] * np.exp(-2j * np.pi * k_ * t / 512) for t in range(512))) ** 2 for k_ in (1, 5)]
    whole = np.abs(np.fft.rfft(x * np.hanning(512)))[1:] ** 2
    np.testing.assert_allclose(whole[[0, 4]], power)
    assert sum(math.exp(f[f"h_logband{i}"]) for i in range(4)) == pytest.approx(1, abs=1e-4) and f["h_spec_dom"] == (whole.argmax() + 1) / 512
    path, logs = np.cumsum(z - z.mean()), []
    for b in (16, 32, 64, 128):
        gaps = [(seg - np.polyval(np.polyfit(np.arange(b), seg, 1), np.arange(b))) ** 2 for seg in path[: n // b * b].reshape(-1, b)]
        logs.append((math.log(b), 0.5 * math.log(np.mean(gaps))))
    assert f["h_dfa"] == pytest.approx(np.polyfit(*zip(*logs, strict=True), 1)[0])
    d = [(z - z.mean())[i] - (z - z.mean())[i + 1] for i in range(0, n, 2)]
    assert f["h_wav_l1"] == pytest.approx(sum(v * v for v in d) / 2 / sum((z - z.mean()) ** 2), rel=1e-2)
    assert f["h_r500_trend"] == pytest.approx(np.polyfit(np.arange(500), z[-500:], 1)[0] * 500)


def test_localiser_and_restarts_by_definition():
    rng = np.random.default_rng(6)
    h, o = rng.normal(size=1500), np.concatenate((rng.normal(size=70), rng.normal(0, 3, size=60)))
    c = m.Context(h, o)
    got = m.compute(h, o, ["m06_loc", "m10_persist", "m12_rdep"])
    z = c.h["mean"]
    phi = k.ar_fit(z, 6)
    e = np.array([z[t] - sum(phi[j] * z[t - 1 - j] for j in range(6)) for t in range(6, len(z))])
    both = np.concatenate((z, c.o["mean"]))
    live = np.array([both[t] - sum(phi[j] * both[t - 1 - j] for j in range(6)) for t in range(len(z), len(both))]) / e.std(ddof=1)
    e = e / e.std(ddof=1)
    lengths = [8, 12, 16, 24, 32, 48, 64, 96, 128]
    ends = np.arange(511, len(e))[:: max(1, (len(e) - 511) // 1000)]
    for t in (9, 40, 100, 129):
        best, tops = {}, np.zeros(len(ends))
        for n in lengths:
            if n > t + 1:
                continue
            null = np.array([(e[i + 1 - n : i + 1] ** 2).mean() for i in ends])
            s = np.sort(null)
            mid, sd = s[len(s) // 2], (s[int(0.75 * len(s))] - s[int(0.25 * len(s))]) / 1.349
            v = ((live[t + 1 - n : t + 1] ** 2).mean() - mid) / sd
            size = np.abs(null - mid) / sd
            best[n] = (((size < abs(v) - 1e-12).sum() + 0.5) / len(s), v)
            rank = np.empty(len(s))
            rank[np.argsort(size, kind="stable")] = (np.arange(len(s)) + 0.5) / len(s)
            tops = np.maximum(tops, rank)
        length = max(best, key=lambda n: best[n][0])
        assert got["m06_loc__loc_h_rsq_lm"][t] == pytest.approx(math.log2(length))
        assert got["m06_loc__loc_h_rsq_sz"][t] == pytest.approx(np.clip(best[length][1], -12, 12), rel=1e-4)
        assert got["m06_loc__loc_h_rsq_q"][t] == pytest.approx(-math.log10(max(1 - (tops < best[length][0]).mean(), 1e-3)), abs=1e-3)
    # a reflected sum against itself restarted at sixteen places
    x, past = c.o["res_mean"], c.h["res_mean"]
    places = np.unique(np.linspace(0, len(past) - 512, 16).astype(int))

    def run(v):
        total, low, out = 0.0, 0.0, []
        for a in v:
            total += a - 0.5
            out.append(total - low)
            low = min(low, total)
        return out

    null = np.array([run(past[a : a + 512])[31] for a in places])
    q1, q3 = np.quantile(null, (0.25, 0.75))
    assert got["m12_rdep__rcup_cur"][31] == pytest.approx((run(x)[31] - np.median(null)) / max((q3 - q1) / 1.349, null.std()), rel=1e-4)
    w = x[88:120] ** 2
    ref = np.array([np.sort(past[i : i + 32] ** 2)[:-2].mean() for i in range(len(past) - 31)])
    q1, q3 = np.quantile(ref, (0.25, 0.75))
    assert got["m10_persist__e_w32_trim"][119] == pytest.approx(np.clip((np.sort(w)[:-2].mean() - np.median(ref)) / max((q3 - q1) / 1.349, ref.std()), -12, 12), rel=1e-4)
    w = x[28:60] ** 2
    assert got["m10_persist__e_w32_trim"][59] == pytest.approx((np.sort(w)[:-2].mean() - np.median(ref)) / max((q3 - q1) / 1.349, ref.std()), rel=1e-4)


def test_recursions_are_loops():
    rng = np.random.default_rng(2)
    x = rng.normal(size=333)
    y = held = 0.3
    want, before, garch = [], [], []
    v, last = 1.0, 1.0
    for a in x:
        before.append(held)
        held += 0.2 * (a - held)
        y = 0.9 * y + a
        want.append(y)
        v = 0.06 + 0.1 * last + 0.84 * v
        garch.append(v)
        last = a * a
    np.testing.assert_allclose(k.decayed(x, 0.9, 0.3), want)
    np.testing.assert_allclose(k.ewma_before(x, 0.2, 0.3), before)
    np.testing.assert_allclose(k.garch_before(x * x, 0.1, 0.84), garch)
    s = np.abs(np.tanh(x))
    on, operate, heat, dwell, cycles, rows = False, 0.0, 0.0, 0, 0, []
    for a in s:
        was, on = on, (a > 0.3 if on else a >= 0.7)
        operate = operate + max(a - 0.7, 0) / 0.3 if on else max(0.0, operate - k.RESET)
        heat = heat + (a - heat) / k.CHARGE if on else heat * math.exp(-1 / k.COOL)
        dwell = dwell + 1 if on else 0
        cycles = min(5, cycles + (was and not on))
        rows.append((operate, heat, dwell, cycles))
    np.testing.assert_allclose(k.relay(s, 0.7, 0.3), rows, atol=1e-9)
    for n in (60, 5000):
        stat, age, second, anchored = k.focus_path(x[:n] if n < 100 else np.resize(x, n))
        z = np.concatenate(([0.0], np.cumsum(x[:n] if n < 100 else np.resize(x, n))))
        for t in (1, 17, n):
            g = {d: (z[t] - z[t - d]) ** 2 / (2 * d) for d in range(1, t + 1)}
            assert stat[t - 1] == pytest.approx(max(g.values())) and g[int(age[t - 1])] == pytest.approx(stat[t - 1]) and anchored[t - 1] == pytest.approx(g[t])
            if n < 100:
                assert second[t - 1] == pytest.approx(max((v for d, v in g.items() if abs(math.log(d / age[t - 1])) > 2), default=0.0))
    z = rng.normal(size=400)
    lag = lambda p: np.array([[z[t - j] for j in range(1, p + 1)] for t in range(p, 400)])
    np.testing.assert_allclose(k.lagged(z, 3), lag(3))
    np.testing.assert_allclose(k.ar_fit(z, 3), np.linalg.lstsq(lag(3), z[3:], rcond=None)[0], atol=1e-4)
    r = k.autocovariances(z, 2)
    np.testing.assert_allclose(np.array([[r[0], r[1]], [r[1], r[0]]]) @ k.ar_yule_walker(r), r[1:], atol=1e-6)
    assert np.abs(k.ar_huber(np.append(z, [50.0]), 1) - k.ar_fit(z, 1)).max() < 0.1


def test_module_columns():
    n = {"m00_core": 151, "m02_dist": 59, "m03_dyn": 60, "m04_resid": 60, "m05_ctx": 50, "m06_loc": 60, "m10_persist": 42, "m12_rdep": 57, "m09_back": 51, "m11_focus": 76, "m13_scale_surv": 5, "m13_scale_indiv": 6, "m14_spectral_impulse": 8, "m14_spectral_energy": 4, "m15_ordinal_irrev": 8, "m15_ordinal_entropy": 4, "m16_joint_rarity": 6, "m16_dwell_rarity": 6, "m17_kalman_nis": 6, "m17_hankel_dmd": 6, "m18_wctm": 8, "m18_uctm": 8}
    assert {k_: len(m.columns([k_])) for k_ in n} == n
    assert len(m.columns(["m00_core"])) == 151 and len(m.columns(["m09_back"])) == 51
    assert all(np.isnan(v).all() for n, v in m.compute(np.arange(12.0), np.arange(5.0), ["m00_core"]).items() if n.startswith("m00_core__w8"))


@given(st.lists(st.integers(-20, 20), min_size=1, max_size=40))
@settings(max_examples=150, deadline=None)
def test_focus_is_exact(xs):
    f, s = k.Focus(), [0.0]
    for x in xs:
        s.append(s[-1] + x)
        want = max((s[-1] - b) ** 2 / (2 * (len(s) - 1 - i)) for i, b in enumerate(s[:-1]))
        assert f.step(x)[0] == pytest.approx(want)


@given(st.lists(st.integers(-9, 9).map(float), min_size=4, max_size=24))
@settings(max_examples=80, deadline=None)
def test_pelt_is_optimal(xs):
    x = np.array(xs)
    beta = 2 * np.log(len(x)) * x.var()
    cost = lambda a, z: float(((x[a:z] - x[a:z].mean()) ** 2).sum())
    best = [0.0] + [math.inf] * len(x)
    for z in range(2, len(x) + 1):
        best[z] = min((best[a] + cost(a, z) + beta for a in range(z - 1) if best[a] < math.inf), default=math.inf)
    cuts = [0, *det.pelt_breaks(x), len(x)]
    got = sum(cost(a, z) + beta for a, z in zip(cuts, cuts[1:], strict=False))
    assert got == pytest.approx(best[-1], abs=1e-6)


def test_run_length_posterior_is_brute_force():
    x = np.random.default_rng(1).normal(size=25)
    r = k.RunLength(0.0, 25.0, most=200)
    h = 1 / 250

    def student(v, run):
        n = len(run)
        kap, al, mu, be = 25.0, 25.0, 0.0, 25.0
        for y in run:
            be, mu, kap, al = be + kap * (y - mu) ** 2 / (2 * (kap + 1)), (kap * mu + y) / (kap + 1), kap + 1, al + 0.5
        s2, nu = be * (kap + 1) / (al * kap), 2 * al
        del n
        return math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi * s2) * (1 + (v - mu) ** 2 / (nu * s2)) ** (-(nu + 1) / 2)

    post = {0: 1.0}
    for t, v in enumerate(x):
        joint = {n: q * student(v, x[t - n : t]) for n, q in post.items()}
        post = {0: h * sum(joint.values())} | {n + 1: (1 - h) * q for n, q in joint.items()}
        total = sum(post.values())
        post = {n: q / total for n, q in post.items()}
        np.testing.assert_allclose(np.exp(r.step(v)), [post[n] for n in sorted(post)], rtol=1e-8)


def test_time_only_score_is_one_half(spark):
    assert QUERIES["q_negative_control"](spark, SF).first().auc == 0.5


def test_ties_count_half(spark):
    rows = spark.createDataFrame([(0, 1, 1), (0, 1, 0), (0, 2, 0), (0, 0, 0), (1, 5, 1)], "t long, score long, y long")
    s = p.per_step(rows).collect()
    assert len(s) == 1 and (s[0].num2, s[0].w) == (3, 3)
    assert p.pooled(p.per_step(rows.filter("t = 1"))).first().auc == 0.5


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "events"
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.repartitionByRange(3, "ts").sortWithinPartitions("ts", "event_id").write.parquet(str(src))
    stamps = sorted(src.glob("part-*"))
    for i, f in enumerate(stamps):  # files arrive in event-time order
        os.utime(f, (1_000_000 + i, 1_000_000 + i))
    streamed = scores.run_available(spark, str(src), f"file://{tmp_path}/out", 40, files_per_batch=1)
    key = lambda r: (r.series_id, r.t)
    batch = scores.batch_scores(scores.keyed(e), 40)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect())) and batch.count() > 0
    assert len({key(r) for r in batch.collect()}) == batch.count()


@pytest.mark.parametrize("names", [["m00_core"], ["m04_resid", "m09_back", "m11_focus"]])
def test_feature_stream_equals_batch(spark, tmp_path, names):
    src = tmp_path / "events"
    e = spark.read.parquet(f"{SF}/events.parquet").filter("user_id < 3")
    e.repartitionByRange(3, "ts").sortWithinPartitions("ts", "event_id").write.parquet(str(src))
    for i, f in enumerate(sorted(src.glob("part-*"))):  # files arrive in event-time order
        os.utime(f, (1_000_000 + i, 1_000_000 + i))
    streamed = scores.run_available(spark, str(src), f"file://{tmp_path}/out", 40, files_per_batch=1, of=lambda rows: features.stream_features(rows, 40, names))
    batch = features.batch_features(scores.keyed(e), 40, names)
    key = ["series_id", "t"]
    a, b = (d.toPandas().sort_values(key).reset_index(drop=True) for d in (streamed, batch))
    assert len(a) == len(b) > 0
    np.testing.assert_allclose(a.to_numpy(float), b.to_numpy(float), rtol=1e-5, atol=1e-6)


def test_reflected_sums(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate([-3, 2, 5, -9, 4])], "series_id long, t long, x long")
    from pyspark.sql import functions as F

    got = [r.r for r in w.reflected(rows, F.col("x"), "r").orderBy("t").collect()]
    late = [r.r for r in w.reflected_late(rows, F.col("x"), "r").orderBy("t").collect()]
    assert got == [0, 2, 7, 0, 4] and late == [-3, 2, 7, -2, 4]


def test_files(spark, tmp_path):
    df = generate.mean_shift(spark, n=20)
    assert df.count() == 40 and df.agg({"has_structural_break": "sum"}).first()[0] == 1
    files.write_submission(df, str(tmp_path / "s"))
    back = files.load_csv(spark, str(tmp_path / "s"), ["timestamp"])
    assert back.count() == 40
    with pytest.raises(ValueError, match="value"):
        files.require_columns(back, ["value"])
    with pytest.raises(FileNotFoundError):
        files.load_csv(spark, str(tmp_path / "none.csv"))
    obs = spark.createDataFrame([(1, 0, 1.0, 1), (1, 1, 2.0, 2), (2, 0, 3.0, 1)], "id long, time long, value double, period int")
    obs.write.parquet(str(tmp_path / "obs"))
    long = files.load_observations(spark, str(tmp_path / "obs"))
    files.write_store(long, spark.createDataFrame([(1, 0)], "series_id long, tau long"), str(tmp_path / "store"))
    o, meta = files.load_store(spark, str(tmp_path / "store"))
    assert o.count() == 3 and {(r.series_id, r.n_hist, r.n_online, r.has_break) for r in meta.collect()} == {(1, 1, 1, True), (2, 1, 0, False)}
    with pytest.raises(ValueError):
        files.check_manifest(["b", "a"], files.manifest_digest(["a", "b"]))
