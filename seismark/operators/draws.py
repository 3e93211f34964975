"""Draws by counter: whole-number hashes of (key, step, draw), the same in any engine and for any partitioning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A prime, and multipliers below it; products stay below 2^63 for keys up to some 10^9.
PRIME, LEHMER, BY_KEY, BY_STEP, BY_DRAW, OFFSET, ROUNDS = 2_147_483_647, 48_271, 69_621, 39_373, 16_807, 12_345, 3


def mixed(key: Column, t: Column, k: Column | int = 0) -> Column:
    """A hash below PRIME of (key, t, k)."""
    k = F.lit(k) if isinstance(k, int) else k
    h = F.pmod(key, F.lit(PRIME)) * BY_KEY + F.pmod(t, F.lit(PRIME)) * BY_STEP + k * BY_DRAW + OFFSET
    for _ in range(ROUNDS):
        h = F.pmod(h, F.lit(PRIME)) * LEHMER
    return F.pmod(h, F.lit(PRIME))


def mixed_arrays(key: int, t: np.ndarray | int, k: np.ndarray | int) -> np.ndarray:
    h = np.asarray(key % PRIME * BY_KEY + np.asarray(t, np.int64) % PRIME * BY_STEP + np.asarray(k, np.int64) * BY_DRAW + OFFSET, np.int64)
    for _ in range(ROUNDS):
        h = h % PRIME * LEHMER
    return h % PRIME


def mixed_sql(key: str, t: str, k: str) -> str:
    h = f"({key} % {PRIME} * {BY_KEY} + {t} % {PRIME} * {BY_STEP} + {k} * {BY_DRAW} + {OFFSET})"
    for _ in range(ROUNDS):
        h = f"({h} % {PRIME} * {LEHMER})"
    return f"({h} % {PRIME})"
