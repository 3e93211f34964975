"""Autoregressive fits of higher order and bootstrap paths with planted breaks, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bootstrap as b
from ..operators import history as h
from ..operators.draws import mixed_sql
from ..sources.scratch import materialize
from ..sources.series import SUPPLIER, split
from ._base import obs, obs_sql, rounded

QUERIES, ORACLE = {}, {}
N, P, STEPS = SUPPLIER.n_hist, b.ORDER, 60


def _ar_sql() -> str:
    """hz, then phi1 .. phi5 of each series in ``ph``, by elimination in as many steps as unknowns."""
    r = range(P)
    out = f""", hz as materialized (select o.series_id, o.i, (o.x - p.mu) / p.sd as z from obs o join par p using (series_id) where o.i < {N}),
lg as (select *, {', '.join(f'lag(z, {j + 1}) over (partition by series_id order by i) as l{j}' for j in r)} from hz),
n0 as (select series_id, count(*) as m, {', '.join(f'sum(l{i} * l{j}) + {"1e-6 * count(*)" if i == j else "0"} as a{i}{j}' for i in r for j in r if j >= i)}, {', '.join(f'sum(l{i} * z) as b{i}' for i in r)} from lg where l{P - 1} is not null group by series_id)"""
    for k in range(P - 1):
        keep = [f"a{i}{j}" for i in range(k + 1) for j in r if j >= i] + [f"b{i}" for i in range(k + 1)]
        made = [f"a{i}{j} - a{k}{i} / a{k}{k} * a{k}{j} as a{i}{j}" for i in range(k + 1, P) for j in range(i, P)] + [f"b{i} - a{k}{i} / a{k}{k} * b{k} as b{i}" for i in range(k + 1, P)]
        out += f", n{k + 1} as (select series_id, m, {', '.join(keep + made)} from n{k})"
    last = f"n{P - 1}"
    for i in reversed(r):
        rest = " - ".join([f"b{i}", *[f"a{i}{j} * phi{j + 1}" for j in range(i + 1, P)]])
        out += f", s{i} as (select *, ({rest}) / a{i}{i} as phi{i + 1} from {last})"
        last = f"s{i}"
    return out + f", ph as (select series_id, {', '.join(f'phi{i + 1}' for i in r)} from {last})"


AR_SQL = "with " + obs_sql(SUPPLIER) + _ar_sql() + " select series_id, " + ", ".join(f"round(phi{i}, 6) + 0.0 as phi{i}" for i in range(1, P + 1)) + " from ph"


def ar5(spark, sf):
    hist, _ = split(obs(spark, sf, SUPPLIER), N)
    return rounded(h.arp(h.standardise(hist, h.moments(hist)), P))


def _boot_sql() -> str:
    salt = lambda k: mixed_sql("series_id", str(STEPS + k), "rep")
    dot = " + ".join(["(case when r.kind = 'dependence' and r.t + 1 >= r.tau then greatest(-0.95, least(0.95, r.phi1 + r.value)) else r.phi1 end) * r.l1", *[f"r.phi{i} * r.l{i}" for i in range(2, P + 1)]])
    lags = ", ".join(f"r.l{i} as l{i + 1}" for i in range(1, P))
    phis, rphis = ", ".join(f"phi{i}" for i in range(1, P + 1)), ", ".join(f"r.phi{i}" for i in range(1, P + 1))
    on, during, x = "t >= tau", "(t >= tau and t < tau + dur)", "(mu + sd * l1)"
    scaled = lambda v: f"med + exp(least(2.0, greatest(-2.0, {v}))) * ({x} - med)"
    return (
        "with recursive " + obs_sql(SUPPLIER) + _ar_sql() + f""", rs as materialized (select lg.series_id, i - {P} as k, z - ({' + '.join(f'phi{j + 1} * l{j}' for j in range(P))}) as e, count(*) over (partition by lg.series_id) as n from lg join ph using (series_id) where l{P - 1} is not null),
sz as (select series_id, greatest(quantile_cont(abs(e), {b.SIZE}), 1e-6) as size from rs group by series_id),
md as (select series_id, median(x) as med from hist group by series_id), ma as (select series_id, any_value(med) as med, greatest(median(abs(x - med)) * 1.4826, 1e-9) as mad from hist join md using (series_id) group by series_id),
pl as (select *, {STEPS // 4} + {salt(1)} % {STEPS // 2} as tau, 3 + {salt(2)} % 12 as dur, ({salt(3)} % 4001 - 2000) / 1000.0 as value from (select series_id, unnest(range({len(b.KINDS)})) as rep, unnest({list(b.KINDS)}) as kind from ph)),
tl as (select series_id, {', '.join(f'max(case when i = {N - j} then z end) as l{j}' for j in range(1, P + 1))} from hz group by series_id),
r as (select pl.series_id, rep, kind, tau, dur, value, -1::bigint as t, {phis}, {', '.join(f'l{i}' for i in range(1, P + 1))} from pl join ph using (series_id) join tl using (series_id)
  union all select r.series_id, r.rep, r.kind, r.tau, r.dur, r.value, r.t + 1, {rphis}, greatest(-12.0, least(12.0, {dot} + e.e)), {lags} from r join rs e on e.series_id = r.series_id and e.k = {mixed_sql('r.series_id', '(r.t + 1)', 'r.rep')} % e.n where r.t + 1 < {STEPS})
select series_id, rep, t, kind, round(case when kind = 'location' and {on} then {x} + value * mad when kind = 'scale' and {on} then {scaled('value')}
  when kind = 'outlier' and {during} and (t = tau or {mixed_sql('series_id', 't', '(rep + 1000003)')} % dur = 0) then {x} + (case when value < 0 then -1.0 else 1.0 end) * size * sd
  when kind = 'shock' and {during} then {x} + (case when value < 0 then -1.0 else 1.0 end) * size * sd * exp(-(t - tau) / greatest(dur / 3.0, 1.0))
  when kind = 'burst' and {during} then {scaled('abs(value)')} when kind = 'displacement' and {during} then {x} + value * mad else {x} end, 4) + 0.0 as x
from r join par using (series_id) join ma using (series_id) join sz using (series_id) where t >= 0"""
    )


def bootstrap_paths(spark, sf):
    """A null path and one with each planted kind, for every series."""
    hist, _ = split(obs(spark, sf, SUPPLIER), N)
    fits = materialize(b.fit(hist), "fits")
    plans = b.every_kind(fits, STEPS)
    return rounded(b.planted(b.paths(fits, plans, STEPS), fits, plans).withColumn("rep", F.col("rep").cast("long")), 4)


QUERIES |= {"q_ar5_fit": ar5, "q_bootstrap_paths": bootstrap_paths}
ORACLE |= {"q_ar5_fit": AR_SQL, "q_bootstrap_paths": _boot_sql()}
