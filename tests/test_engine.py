"""The bounded-state engine and the production step: stream against batch, state size, refusals."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seismark.operators import calibrate as c
from seismark.streaming import engine, production, scores

N = 30


def test_state_is_of_fixed_size_over_ten_thousand_points():
    rng = np.random.default_rng(3)
    one, sizes = engine.Series(N), set()
    for i, v in enumerate((rng.standard_normal(10_000) * 1e4).astype(int).tolist()):
        one.push(i, i, v)
        if i > N:
            sizes.add((len(one.head()), len(one.ring)))
    assert sizes == {(16, engine.RING)}


def test_columns_by_definition():
    rng = np.random.default_rng(4)
    x = np.round(rng.standard_normal(N + 700) * 10, 2)
    got = engine.arrays(x, N)
    mu, sd = x[:N].mean(), x[:N].std(ddof=1)
    z = (x[N:] - mu) / sd
    at = {n: i for i, n in enumerate(engine.COLUMNS)}
    for t in (0, 1, 7, 8, 100, 255, 256, 511, 512, 513, 699):
        seen = z[: t + 1]
        for w in engine.WINDOWS:
            v = got[t, at[f"roll{w}"]]
            assert math.isnan(v) if w > t + 1 else v == pytest.approx(seen[-w:].mean(), abs=1e-9)
        gains = [seen[-w:].sum() ** 2 / (2 * w) for w in engine.DYADIC if w <= t + 1]
        assert got[t, at["glr"]] == pytest.approx(max(gains)) and got[t, at["glr_mix"]] == pytest.approx(np.logaddexp.reduce(gains) - math.log(len(gains)))
        assert got[t, at["expand"]] == pytest.approx(seen.mean(), abs=1e-9) and got[t, at["spread"]] == pytest.approx((seen**2).mean())
        up = 0.0
        for v in seen:
            up = max(up + v - engine.SLACK, 0.0)
        assert got[t, at["up"]] == pytest.approx(up, abs=1e-8)


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """Files of ascending time, the last one with rows that are late."""
    rng, folder = np.random.default_rng(5), tmp_path_factory.mktemp("events")
    rows = [(i, int(rng.integers(0, 6)), 1_700_000_000 + 60 * i, round(float(rng.standard_normal() * 30), 2)) for i in range(1800)]
    late = [(9000 + k, s, 1_700_000_000, 1.0) for k, s in enumerate(range(6))]
    for k in range(3):
        part = rows[600 * k : 600 * (k + 1)] + (late if k == 2 else [])
        df = spark.createDataFrame(part, "event_id long, user_id long, s long, value double").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "value")
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    kept = spark.createDataFrame(rows, "event_id long, user_id long, s long, value double").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "value")
    return folder, scores.keyed(kept)


def rows_of(df):
    return {(r.series_id, r.t): r for r in df.collect()}


def same(a, b, cols):
    assert a.keys() == b.keys() and len(a) > 1000
    for key, r in a.items():
        for col in cols:
            assert (r[col] is None) == (b[key][col] is None) and (r[col] is None or r[col] == pytest.approx(b[key][col], abs=1e-8)), (key, col)


def test_stream_is_batch_over_micro_batches(spark, source):
    folder, kept = source
    with engine.with_state_store(spark):
        got = scores.run_available(spark, f"{folder}/in", f"file://{folder}/out", N, files_per_batch=1, of=lambda rows: engine.stream(rows, N))
    same(rows_of(got), rows_of(engine.batch(kept, N)), engine.COLUMNS)


def test_stored_state_does_not_grow(spark, source):
    """Rows of the state store after each micro-batch: a head for each series, and its ring once the history is over."""
    folder, _ = source
    totals = []
    with engine.with_state_store(spark):
        schema = spark.read.parquet(f"{folder}/in").schema
        made = engine.stream(scores.keyed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")), N)
        query = made.writeStream.format("noop").option("checkpointLocation", f"file://{folder}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        totals = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]]
    assert len(totals) == 3 and len(set(totals)) == 1 and totals[0] <= 6 * (engine.RING + 1)


MEMBERS = {"level": ["roll8", "expand"], "sums": ["up", "down", "peak"]}


@pytest.fixture(scope="module")
def model(spark, source):
    _, kept = source
    rows = engine.batch(kept, N).withColumn("y", ((F.col("series_id") % 2 == 0) & (F.col("t") > 40)).cast("int")).withColumn("fold", F.col("series_id") % 3)
    return production.fit(rows, MEMBERS, N, {"partition": "development", "n_series": 6}, folds=3, quantiles=32, least=50)


def test_production_stream_is_batch_and_survives_a_store(spark, source, model, tmp_path):
    folder, kept = source
    production.save(model, spark, f"file://{tmp_path}/model")
    held = production.load(spark, f"file://{tmp_path}/model", {"n_series": 6, "n_members": 2, "blend": "scdf", "coordinate": "log_n_seen"})
    with engine.with_state_store(spark):
        got = scores.run_available(spark, f"{folder}/in", f"file://{tmp_path}/out", N, files_per_batch=1, of=lambda rows: production.stream(rows, held))
    want = rows_of(production.batch(kept, model))
    same(rows_of(got), want, ["level", "sums", "score"])
    assert all(0 <= r.score <= 1 for r in want.values()) and len({round(r.score, 6) for r in want.values()}) > 20


def test_another_model_is_refused(spark, model, tmp_path):
    for change, words in [({"columns": engine.COLUMNS[::-1]}, "other columns"), ({"digest": "0"}, "not those"), ({"members": {"level": ["unheard_of"]}}, "no columns unheard_of"), ({"provenance": {"n_series": 5}}, "n_series is 5")]:
        folder = f"file://{tmp_path}/{next(iter(change))}"
        production.save(production.Model(model.manifest | change, {}), spark, folder)
        with pytest.raises(ValueError, match=words):
            production.load(spark, folder, {"n_series": 6})
    with pytest.raises(ValueError, match="blend"):
        production.fit(None, MEMBERS, N, {}, blend="median")


def test_calibration_payload_and_coordinates(spark):
    rows = spark.createDataFrame([(t, float((t * 7 + s * 13) % 101)) for t in range(60) for s in range(20)], "t long, score double")
    grid = c.fit_time_cdf(rows, c.anchors(59), quantiles=8, least=100)
    payload = c.grid_payload(grid, "log_t_clamped")
    back, coordinate = c.grid_of_payload(spark, payload)
    assert coordinate == "log_t_clamped" and sorted(map(tuple, back.collect())) == sorted((r.a, r.k, r.q) for r in grid.collect())
    old = json.loads(payload)
    del old["time_coord"]
    assert c.grid_of_payload(spark, json.dumps(old))[1] == "log_t_clamped"  # payloads from before the field
    with pytest.raises(ValueError):
        c.grid_of_payload(spark, json.dumps(old | {"time_coord": "t"}))
    with pytest.raises(ValueError):
        c.apply_time_cdf(rows, grid, coordinate="t")
    anchors, grids = old["anchors"], old["grids"]
    for name, u in (("log_n_seen", lambda t: math.log(t + 1)), ("log_t_clamped", lambda t: math.log(max(t, 1)))):
        got = {(r.t, r.score): r.cal for r in c.apply_time_cdf(rows, grid, coordinate=name).collect()}
        for (t, s), cal in got.items():
            i = max(k for k, a in enumerate(anchors) if a <= t)
            j = min((k for k, a in enumerate(anchors) if a >= t), default=i)
            lo, hi = (sum(q < s for q in grids[k]) / len(grids[k]) for k in (i, j))
            f = 0.0 if u(anchors[i]) == u(anchors[j]) else (u(t) - u(anchors[i])) / (u(anchors[j]) - u(anchors[i]))
            assert cal == pytest.approx(lo + f * (hi - lo)), (name, t)
