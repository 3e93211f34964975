"""A stateful feature engine with bounded state, as a ``transformWithState`` operator.

A series' state is a fixed number of values, however long it lives: the history's sums (integer cents, exact in any order), the sums and extremes of the
online recursions, and a ring of the last ``RING`` running sums, from which every trailing window up to that length is a difference. A row costs one
step of each recursion and one difference for each window: nothing is read again. The state of a micro-batch's series is one value, loaded once and stored once, with as much of the
ring as is in use. Rows that are not later than a series' last one are dropped; with ``idle_ms`` the state of a series that gets
no rows for so long goes, and it begins anew.

``batch`` gives the same columns from windows over a table; both are tested against each other."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import history as h
from ..operators import windows as w

#: Windows of the rolling means; lengths of the likelihood ratios; longest window; slack of the reflected sums.
WINDOWS, DYADIC, RING, SLACK, DRIFT = (8, 16, 32, 64, 128, 256), tuple(1 << j for j in range(10)), 512, 0.5, 0.1
COLUMNS = [*[f"roll{n}" for n in WINDOWS], "expand", "spread", "up", "down", "peak", "ph_up", "ph_down", "glr", "glr_mix"]
OUT = "series_id long, t long, " + ", ".join(f"{c} double" for c in COLUMNS)
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_HEAD = ["n", "s1", "s2", "ts", "row", "sum", "squares", "c_up", "lo_up", "c_down", "lo_down", "peak", "p_up", "q_up", "p_down", "q_down"]
HEAD = ", ".join(f"{c} {'long' if i < 7 else 'double'}" for i, c in enumerate(_HEAD))


@dataclass
class Series:
    """One series. ``ring[k % RING]`` is the sum of the first k online values, in cents."""

    n_hist: int
    n: int = 0
    s1: int = 0
    s2: int = 0
    ts: int = -(1 << 62)
    row: int = -(1 << 62)
    sum: int = 0
    squares: int = 0
    c_up: float = 0.0
    lo_up: float = 0.0
    c_down: float = 0.0
    lo_down: float = 0.0
    peak: float = 0.0
    p_up: float = 0.0
    q_up: float = 0.0
    p_down: float = 0.0
    q_down: float = 0.0
    ring: list[int] = field(default_factory=lambda: [0] * RING)

    def head(self) -> tuple:
        return tuple(getattr(self, c) for c in _HEAD)

    def state(self) -> tuple:
        """The head's values, and as much of the ring as is in use."""
        return (*self.head(), self.ring[: max(self.n - self.n_hist, -1) + 1])

    @classmethod
    def resumed(cls, n_hist: int, state: tuple) -> Series:
        *head, ring = state
        return cls(n_hist, *head, ring=list(ring) + [0] * (RING - len(ring)))

    def push(self, ts: int, row: int, cents: int) -> tuple | None:
        """The row's t and columns; None within the history, and for a row that is late."""
        if (ts, row) <= (self.ts, self.row):
            return None
        self.ts, self.row, self.n = ts, row, self.n + 1
        if self.n <= self.n_hist:
            self.s1, self.s2 = self.s1 + cents, self.s2 + cents * cents
            return None
        m = self.n_hist
        mu = self.s1 / m / 100.0
        sd = max(math.sqrt(max((self.s2 - self.s1 * self.s1 / m) / (m - 1), 0.0)) / 100.0, h.FLOOR)
        k = self.n - m  # online values, this one included
        before = self.sum
        self.sum, self.squares = before + cents, self.squares + cents * cents
        z_sum = lambda size, cents_sum: (cents_sum / 100.0 - size * mu) / sd  # noqa: E731  the sum of z over that many values
        past = lambda size: self.sum - (self.ring[(k - size) % RING] if size < k else 0)
        rolls = [z_sum(size, past(size)) / size if size <= k else None for size in WINDOWS]
        gains = [z_sum(size, past(size)) ** 2 / (2.0 * size) for size in DYADIC if size <= k]
        self.ring[k % RING] = self.sum
        z = (cents / 100.0 - mu) / sd
        mean = z_sum(k, self.sum) / k
        second = (self.squares / 1e4 - 2 * mu * self.sum / 100.0 + k * mu * mu) / (sd * sd) / k
        self.c_up, self.c_down = self.c_up + z - SLACK, self.c_down - z - SLACK
        self.lo_up, self.lo_down = min(self.lo_up, self.c_up), min(self.lo_down, self.c_down)
        up, down = self.c_up - self.lo_up, self.c_down - self.lo_down
        self.peak = max(self.peak, up, down)
        self.p_up, self.p_down = self.p_up + z - mean - DRIFT, self.p_down - z + mean - DRIFT
        self.q_up, self.q_down = min(self.q_up, self.p_up), min(self.q_down, self.p_down)
        best = max(gains)
        mix = best + math.log(sum(math.exp(g - best) for g in gains) / len(gains))
        return (k - 1, *rolls, mean, second, up, down, self.peak, self.p_up - self.q_up, self.p_down - self.q_down, best, mix)


class Engine(StatefulProcessor):
    def __init__(self, n_hist: int, idle_ms: int | None):
        self.n_hist, self.idle_ms = n_hist, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("series", f"{HEAD}, ring array<long>", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, ANN001
        held = self.held.get()
        one = Series.resumed(self.n_hist, tuple(held)) if held else Series(self.n_hist)
        ts, row, cents = (np.concatenate(parts) for parts in zip(*[[p[c].to_numpy() for c in ("ts_us", "row_id", "cents")] for p in rows], strict=True))
        order = np.lexsort((row, ts))
        made = [got for v in zip(ts[order].tolist(), row[order].tolist(), cents[order].tolist(), strict=True) if (got := one.push(*v))]
        self.held.update(one.state())  # one value: each state variable read or written is a round trip
        made = np.array(made, dtype=float).reshape(-1, 1 + len(COLUMNS))
        out = pd.DataFrame(made[:, 1:], columns=COLUMNS)
        out.insert(0, "t", made[:, 0].astype(np.int64))
        out.insert(0, "series_id", key[0])
        yield out

    def close(self) -> None:
        return


def stream(rows: DataFrame, n_hist: int, idle_ms: int | None = None) -> DataFrame:
    """rows (series_id, ts_us, row_id, cents): a stream. The session's state store must be PROVIDER (see ``with_state_store``)."""
    made = rows.groupBy("series_id").transformWithStateInPandas(statefulProcessor=Engine(n_hist, idle_ms), outputStructType=OUT, outputMode="append", timeMode="ProcessingTime" if idle_ms else "None")
    return made.select("series_id", "t", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in COLUMNS])


class with_state_store:  # noqa: N801
    """Within it, streams keep their state in the store that ``transformWithState`` needs."""

    KEY = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.held = self.spark.conf.get(self.KEY, None)
        self.spark.conf.set(self.KEY, PROVIDER)

    def __exit__(self, *_: object) -> None:
        self.spark.conf.set(self.KEY, self.held) if self.held else self.spark.conf.unset(self.KEY)


def batch(rows: DataFrame, n_hist: int) -> DataFrame:
    """The same columns of the same rows from a table, by windows."""
    order = Window.partitionBy("series_id").orderBy("ts_us", "row_id")
    obs = rows.select("series_id", (F.row_number().over(order) - 1).cast("long").alias("i"), "cents", (F.col("cents") / 100.0).alias("x"))
    z = h.standardise(obs.filter(F.col("i") >= n_hist).withColumn("t", F.col("i") - n_hist), h.moments(obs.filter(F.col("i") < n_hist))).select("series_id", "t", "z")
    upto = w.upto()
    held = w.cusum_pair(z, F.col("z"), F.lit(SLACK))
    held = w.page_hinkley(w.glr_dyadic(held, "z", len(DYADIC) - 1), "z", DRIFT, "ph_up", "ph_down")
    made = {f"roll{n}": w.roll(F.col("z"), n) for n in WINDOWS} | {"expand": w.expand(F.col("z")), "spread": w.expand(F.col("z") * F.col("z")), "peak": F.greatest(F.max("up").over(upto), F.max("down").over(upto)), "glr": F.col("best"), "glr_mix": F.col("mix")}
    return held.withColumns(made).select("series_id", "t", *COLUMNS)


def arrays(x: np.ndarray, n_hist: int) -> np.ndarray:
    """The engine's columns of one series of values, as a check on small data."""
    one = Series(n_hist)
    got = [one.push(i, i, int(round(v * 100))) for i, v in enumerate(x)]
    return np.array([r[1:] for r in got if r], dtype=float)
