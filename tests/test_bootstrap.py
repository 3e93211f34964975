"""Higher-order fits and bootstrap paths against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seismark.operators import bootstrap as b
from seismark.operators import history as h
from seismark.operators.draws import mixed, mixed_arrays


@pytest.fixture(scope="module")
def hist(spark):
    rng = np.random.default_rng(1)
    made = {}
    for s, n in ((1, 300), (2, 90), (3, 40)):
        x = np.zeros(n)
        for t in range(2, n):
            x[t] = 0.5 * x[t - 1] - 0.3 * x[t - 2] + rng.standard_normal()
        made[s] = np.round(100 * x, 2)
    return spark.createDataFrame([(s, i, int(round(v * 100)), float(v)) for s, x in made.items() for i, v in enumerate(x)], "series_id long, i long, cents long, x double").cache(), made


@pytest.mark.parametrize("p", [1, 3, 5])
def test_fit_is_the_normal_equations(hist, p):
    df, made = hist
    got = {r.series_id: [r[f"phi{i + 1}"] for i in range(p)] for r in h.arp(h.standardise(df, h.moments(df)), p).collect()}
    for s, x in made.items():
        z = (x - x.mean()) / x.std(ddof=1)
        lags = np.stack([z[p - 1 - j : len(z) - 1 - j] for j in range(p)], axis=1)
        want = np.linalg.solve(lags.T @ lags + 1e-6 * len(lags) * np.eye(p), lags.T @ z[p:]) if len(z) >= 10 * p + 10 else np.zeros(p)
        np.testing.assert_allclose(got[s], want, atol=1e-9)


def test_paths_go_on_from_the_history_and_do_not_depend_on_partitions(hist):
    df, made = hist
    fits = b.fit(df)
    plans = b.every_kind(fits, 24)
    got = b.planted(b.paths(fits, plans, 24), fits, plans)
    again = b.planted(b.paths(fits.repartition(5), plans.repartition(7, "kind"), 24, block=3), fits, plans)
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert [r[:4] for r in rows] == [r[:4] for r in sorted(map(tuple, again.collect()), key=repr)] and len(rows) == 3 * len(b.KINDS) * 24
    np.testing.assert_allclose([r[4] for r in rows], [r[4] for r in sorted(map(tuple, again.collect()), key=repr)], rtol=1e-12)
    plan = {(r.series_id, r.rep): r for r in plans.collect()}
    held = {(r.series_id, r.rep, r.t): r.x for r in got.collect()}
    for s, x in made.items():
        mu, sd, med = x.mean(), x.std(ddof=1), np.median(x)
        mad = 1.4826 * np.median(np.abs(x - med))
        z = (x - mu) / sd
        lags = np.stack([z[4 - j : len(z) - 1 - j] for j in range(5)], axis=1)
        phi = np.linalg.solve(lags.T @ lags + 1e-6 * len(lags) * np.eye(5), lags.T @ z[5:]) if len(z) >= 60 else np.zeros(5)
        resid = z[5:] - lags @ phi
        for rep, kind in enumerate(b.KINDS):
            r, last, path = plan[s, rep], list(z[::-1][:5]), []
            for t in range(24):
                first = np.clip(phi[0] + r.value, -0.95, 0.95) if kind == "dependence" and t >= r.tau else phi[0]
                v = np.clip(first * last[0] + phi[1:] @ last[1:] + resid[mixed_arrays(s, t, rep) % len(resid)], -12, 12)
                path.append(v)
                last = [v, *last[:4]]
            for t, v in enumerate(mu + sd * np.array(path)):
                at, inside = t >= r.tau, r.tau <= t < r.tau + r.dur
                want = v + r.value * mad if (kind == "location" and at) or (kind == "displacement" and inside) else med + np.exp(np.clip(r.value, -2, 2)) * (v - med) if kind == "scale" and at else med + np.exp(min(abs(r.value), 2)) * (v - med) if kind == "burst" and inside else v
                if kind in ("outlier", "shock") and inside:
                    assert kind == "outlier" or abs(held[s, rep, t] - v) > 0
                    continue
                assert held[s, rep, t] == pytest.approx(want, rel=1e-9, abs=1e-7), (s, kind, t)


def test_draws_agree(spark):
    rows = spark.range(50).select("id", mixed(F.col("id") * 7919, F.col("id") + 3, 5).alias("h")).collect()
    assert [r.h for r in rows] == [int(mixed_arrays(r.id * 7919, r.id + 3, 5)) for r in rows] and len({r.h for r in rows}) == 50
