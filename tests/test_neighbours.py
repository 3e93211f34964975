"""Nearest subsequences against brute force, with many chunks."""

from __future__ import annotations

import numpy as np
import pytest

from seismark.operators import neighbours as nb


def shaped(x, m):
    w = np.lib.stride_tricks.sliding_window_view(x, m)
    w = w - w.mean(axis=1, keepdims=True)
    sd = w.std(axis=1, keepdims=True)
    return w / np.where(sd > 1e-12, sd, 1.0)


@pytest.mark.parametrize("m, block", [(8, 16), (12, 500), (7, 20)])
def test_neighbours_are_brute_force(spark, m, block):
    rng = np.random.default_rng(m)
    wave = np.sin(np.arange(260) / 5)
    made = {1: (wave + 0.1 * rng.standard_normal(260), np.concatenate((wave[:60], np.cumsum(rng.standard_normal(40))))), 2: (rng.standard_normal(90), rng.standard_normal(m)), 3: (np.full(60, 3.0), rng.standard_normal(50)), 4: (rng.standard_normal(m - 1), rng.standard_normal(40))}
    rows = spark.createDataFrame([(s, part, t, float(v)) for s, both in made.items() for part, x in zip("ho", both, strict=True) for t, v in enumerate(x)], "series_id long, part string, t long, x double")
    found = nb.neighbours(rows, m, block)
    got = {(r.series_id, r.t): r for r in found.collect()}
    pairs = 0
    for s, (h, o) in made.items():
        if len(h) < m:
            assert not [k for k in got if k[0] == s]
            continue
        hw, ow = shaped(h, m), shaped(o, m)
        for i, q in enumerate(ow):
            r = got.pop((s, i + m - 1))
            d = np.sqrt(((hw - q) ** 2).sum(axis=1))
            assert r.d_hist == pytest.approx(d.min(), abs=1e-6) and d[r.nearest] == pytest.approx(d.min(), abs=1e-6)
            prior = np.sqrt(((ow[: max(i - m + 1, 0)] - q) ** 2).sum(axis=1))
            assert (r.d_online is None) == (not len(prior)) and (not len(prior) or r.d_online == pytest.approx(prior.min(), abs=1e-6))
            pairs += len(d) + len(prior)
    assert not got and found.agg({"measured": "sum"}).first()[0] < 0.6 * pairs
    assert nb.neighbours(rows.limit(0), m, block).count() == 0


def test_piecewise_means_bound_distances():
    rng = np.random.default_rng(0)
    for m in (5, 8, 16, 64):
        w, p = nb.shapes(rng.standard_normal(200), m)
        i, j = rng.integers(0, len(w), (2, 500))
        assert (((p[i] - p[j]) ** 2).sum(axis=1) <= ((w[i] - w[j]) ** 2).sum(axis=1) + 1e-9).all()
