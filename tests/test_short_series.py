"""Steps of the feature modules that cost a short series time: they do less, and give what they gave before."""

from __future__ import annotations

import numpy as np

from seismark.functions import kernels as k
from seismark.functions import packs


def test_quantiles_and_medians_are_numpys():
    rng = np.random.default_rng(11)
    for n in (1, 2, 3, 7, 38, 40, 301):
        for x in (rng.normal(size=n), np.round(rng.normal(size=n), 1), np.where(np.arange(n) == n // 2, np.nan, 1.0)):
            np.testing.assert_array_equal(k.median(x), np.median(x))
            for p in (0.0, 0.25, 0.9, 0.95, 0.99, 1.0):
                np.testing.assert_array_equal(k.quantile(x, p), np.quantile(x, p))


def test_windows_longer_than_a_series_take_no_work(monkeypatch):
    u = np.random.default_rng(12).random(27)
    want = packs.occupancy(u, None, 20)["chi2"]
    monkeypatch.setattr(packs, "trailing", None)
    for w in (32, 128):
        shares = packs.occupancy(u, w, 20)
        assert all(np.isnan(shares[key]).all() and len(shares[key]) == 27 for key in ("chi2", "ks", "ent", "amax", "ene", "q50"))
    assert len(want) == 27 and np.isfinite(want).all()


def test_a_decay_builds_its_block_once():
    k._powers.cache_clear()
    x = np.random.default_rng(13).normal(size=150)
    for _ in range(3):
        got = k.decayed(x, 0.9, 0.5)
    y, want = 0.5, []
    for v in x:
        y = 0.9 * y + v
        want.append(y)
    np.testing.assert_allclose(got, want, rtol=1e-12, atol=1e-12)
    assert k._powers.cache_info().misses == 1
