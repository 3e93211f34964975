"""Prefix sums in buckets: groups below and above the size of one window give the same."""

from __future__ import annotations

import numpy as np
import pytest

from seismark.operators import ranks


@pytest.mark.parametrize("rows", [10, 37, 1_000_000])
@pytest.mark.parametrize("by", [["g"], ["g", "k"], []])
def test_prefixes(spark, rows, by):
    rng = np.random.default_rng(rows)
    data = {(int(g), int(k), float(v)): int(n) for g, k, v, n in zip(rng.choice([0, 1, 2], 600, p=[0.8, 0.15, 0.05]), rng.integers(0, 2, 600), np.round(rng.standard_normal(600) * 50 + 1000 * rng.integers(0, 2, 600)), rng.integers(1, 9, 600), strict=True)}
    if not by:
        data = {(0, 0, v): n for (_, _, v), n in data.items()}
    if by == ["g"]:
        data = {(g, 0, v): n for (g, _, v), n in data.items()}
    df = spark.createDataFrame([(*c, n) for c, n in data.items()], "g long, k long, v double, n long").repartition(5)
    got = {(r.g, r.k, r.v): (r.n_below, r.n_all) for r in ranks.prefixes(df, by, "v", ["n"], rows).collect()}
    assert got == {(g, k, v): (sum(n for (a, b, w), n in data.items() if (a, b) == (g, k) and w < v), sum(n for (a, b, _), n in data.items() if (a, b) == (g, k))) for g, k, v in data}
    assert ranks.prefixes(df.limit(0), by, "v", ["n"], rows).count() == 0
