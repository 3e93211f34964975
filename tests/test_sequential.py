"""Sequential evidence and its nulls against their definitions in numpy, and prefix invariance."""

from __future__ import annotations

import math

import numpy as np
import pytest

from seismark.operators import pathnull as pn
from seismark.operators import sequential as sq


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    made = {1: rng.standard_normal(560), 2: np.concatenate((rng.standard_normal(400), 1.5 + 2 * rng.standard_normal(120))), 3: np.round(rng.standard_normal(430)), 4: np.full(410, 2.0)}
    return {s: np.round(1000 * x, 2) for s, x in made.items()}  # few sums agree by chance


@pytest.fixture(scope="module")
def obs(spark, data):
    return spark.createDataFrame([(s, i, int(round(v * 100)), float(v)) for s, x in data.items() for i, v in enumerate(x)], "series_id long, i long, cents long, x double").cache()


N = 400


def surprise(null, x, scale):
    null = np.sort(null)
    p = (np.searchsorted(null, x, "left") + np.searchsorted(null, x, "right")) / 2 / len(null)
    base = min(-math.log10(max(1 - p, 1 / (2 * len(null)))), 6.0)
    return min(base + math.log1p(max(x - null[-1], 0) / scale), 12.0)


def reflect(y):
    out, s = [], 0.0
    for v in y:
        s = max(0.0, s + v)
        out.append(s)
    return np.array(out)


def test_path_surprise_is_its_definition(obs, data):
    got = {(r.series_id, r.t): r for r in sq.path_surprise(obs, N).collect()}
    assert len(got) == sum(len(x) - N for x in data.values())
    for s, x in data.items():
        mu, sd = x[:N].mean(), max(x[:N].std(ddof=1), 1e-9)
        z = (x - mu) / sd
        path = lambda v: np.maximum(reflect(v - 0.5), reflect(-v - 0.5))
        hist, live = path(z[:N]), path(z[N:])
        raw = np.sort(hist[64:])
        n = len(raw)
        q50, q99, top = raw[n // 2], raw[min(n - 1, int(0.99 * n))], raw[-1]
        scale = max(q99 - q50, 0.1 * (top - q50), 1e-3 * max(abs(q50), 1))
        nulls = {w: np.array([hist[i - w + 1 : i + 1].max() for i in range(w - 1, N)]) if N - w + 1 >= 8 else raw for w in pn.PEAKS}
        peak = np.maximum.accumulate(live)
        for t, d in enumerate(live):
            w = 32 if t + 1 <= 64 else 128 if t + 1 <= 256 else 512
            r = got[s, t]
            if s != 4:  # a constant series: its values are rounding
                near = 1e-6 if s != 3 else 0.1  # whole numbers: sums agree but for their last bits, which decide ties
                assert r.d == pytest.approx(d, abs=1e-9) and r.cur == pytest.approx(surprise(raw, d, scale), abs=near) and r.pk == pytest.approx(surprise(nulls[w], peak[t], scale), abs=near), (s, t)
            assert 0 <= r.cur <= 12 and 0 <= r.pk <= 12


def test_columns_do_not_depend_on_what_follows(obs):
    whole = {(r.series_id, r.t): r for r in sq.sequential(obs, N).collect()}
    short = sq.sequential(obs.filter("i < 430"), N).collect()
    assert len(short) == 30 * 3 + 10 and len(sq.columns()) == 60 and list(short[0].asDict())[2:] == sq.columns()
    for r in short:
        for c in sq.columns():
            a, b = r[c], whole[r.series_id, r.t][c]
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-9)), c


def test_a_break_is_surprising_and_calm_is_not(obs):
    got = {s: np.mean([r.xc_max_pk for r in rows]) for s, rows in ((k, [r for r in sq.sequential(obs, N).filter(f"series_id = {k}").collect() if r.t >= 60]) for k in (1, 2))}
    assert got[2] > 4 > 2.5 > got[1]


def test_without_online_rows(obs):
    assert sq.sequential(obs.filter("i < 400"), N).count() == 0 and sq.path_surprise(obs.limit(0), N).count() == 0


def test_one_pass_writes_no_null_samples_and_gives_what_windows_give(obs):
    """Every null sample and every value ranked among them was a row that was shuffled, and the paths were written twice."""
    made = sq.sequential(obs, N)
    plan = made._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "explode" not in plan and "generate" not in plan and not made.inputFiles()
    for n, rows in ((N, obs.filter("series_id <> 4")), (33, obs.filter("series_id < 3 and i < 70")), (9, obs.filter("series_id = 1 and i < 40"))):
        got = {(r.series_id, r.t): r for r in sq.sequential(rows, n).collect()}
        want = sq.by_windows(rows, n).collect()
        assert len(got) == len(want) > 20
        for r in want:
            for c in sq.columns():
                a, b = r[c], got[r.series_id, r.t][c]
                assert (a is None) == (b is None) and (a is None or b == pytest.approx(a, abs=1e-6)), (n, r.series_id, r.t, c)
    rounded = sq.sequential(obs, N, 3, ("_tsp",)).filter("series_id = 1").collect()
    assert all(r.cz50_cur == round(r.cz50_cur, 3) for r in rounded) and any(r.cz50_tsp != round(r.cz50_tsp, 3) for r in rounded)
