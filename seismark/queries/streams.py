"""The bounded-state engine and the production step, streamed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibrate as c
from ..sources.scratch import scratch_path, shared_dir
from ..sources.series import USER, absorbing_label, planted_tau
from ..streaming import engine, production, scores
from ._base import obs_sql, rounded

QUERIES, ORACLE = {}, {}
W = "partition by series_id order by t"


def _engine_sql() -> str:
    rolls = ", ".join(f"case when t + 1 >= {n} then sum(z) over (partition by series_id order by t rows {n - 1} preceding) / {n} end as roll{n}" for n in engine.WINDOWS)
    gains = ", ".join(f"case when t + 1 >= {n} then pow(c - coalesce(lag(c, {n}) over w, 0.0), 2) / {2 * n} end as g{j}" for j, n in enumerate(engine.DYADIC))
    each = [f"g{j}" for j in range(len(engine.DYADIC))]
    cols = ", ".join(f"round({x}, 6) + 0.0 as {x}" for x in engine.COLUMNS)
    return (
        "with " + obs_sql(USER) + f""", a as (select series_id, t, z, sum(z) over w as c, avg(z) over w as expand, avg(z * z) over w as spread, sum(z - 0.5) over w as u, sum(-z - 0.5) over w as d, {rolls} from zon window w as ({W})),
b as (select *, sum(z - expand - 0.1) over w as pu, sum(-(z - expand) - 0.1) over w as pd, u - least(0.0, min(u) over w) as up, d - least(0.0, min(d) over w) as down, {gains} from a window w as ({W})),
g as (select *, greatest({', '.join(each)}) as glr from b),
r as (select *, greatest(max(up) over w, max(down) over w) as peak, pu - least(0.0, min(pu) over w) as ph_up, pd - least(0.0, min(pd) over w) as ph_down,
  glr + ln(({' + '.join(f'coalesce(exp({x} - glr), 0.0)' for x in each)}) / ({' + '.join(f'({x} is not null)::int' for x in each)})) as glr_mix from g window w as ({W}))
select series_id, t, {cols} from r"""
    )


def _run(spark, sf, of):
    with engine.with_state_store(spark):
        return scores.run_available(spark, f"{sf}/events.parquet", f"{shared_dir(spark)}/seismark", USER.n_hist, of=of)


def stream_engine(spark, sf):
    """Windows, recursions and likelihood ratios from a state of fixed size."""
    return rounded(_run(spark, sf, lambda rows: engine.stream(rows, USER.n_hist)))


MEMBERS = {"level": ["roll8", "roll16", "expand"], "spread": ["spread", "glr"], "sums": ["up", "down", "peak", "ph_up", "ph_down"]}


def training(spark, sf):
    """The engine's columns of every series, with planted labels and folds."""
    rows = engine.batch(scores.keyed(spark.read.parquet(f"{sf}/events.parquet")), USER.n_hist)
    return rows.withColumn("y", absorbing_label(F.col("t"), planted_tau(F.col("series_id")))).withColumn("fold", c.fold_of(F.col("series_id")))


def production_stream(spark, sf):
    """A model is fitted, saved, loaded by its manifest, and applied to the stream of all events."""
    folder = scratch_path(spark, "model")
    production.save(production.fit(training(spark, sf), MEMBERS, USER.n_hist, {"partition": "development"}), spark, folder)
    model = production.load(spark, folder, {"partition": "development", "n_members": len(MEMBERS), "blend": "scdf", "n_hist": USER.n_hist})
    return rounded(_run(spark, sf, lambda rows: production.stream(rows, model)))


QUERIES |= {"q_stream_engine": stream_engine, "q_stream_production": production_stream}
ORACLE |= {"q_stream_engine": _engine_sql()}
