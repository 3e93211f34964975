"""Break families with placebo cuts, and its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequential as sq
from ..operators import taxonomy as tx
from ..operators.draws import PRIME, mixed_sql
from ..sources.scratch import materialize
from ..sources.series import SUPPLIER, planted_tau
from ._base import obs, obs_sql, rounded
from .sequences import _ROWS

QUERIES, ORACLE = {}, {}
N, HORIZON, LEAST = SUPPLIER.n_hist, 200, 5
_F = tx.FAMILIES


def _sql() -> str:
    tau = f"(case when series_id % 2 = 0 then (series_id * 37) % {HORIZON} else -1 end)::bigint"
    gap = lambda n: f"abs(p.{n} - r.{n})"
    size = {
        "location": f"{gap('mean')} / greatest(se * r.sd, 1e-9)", "scale": "abs(ln(greatest(p.e_sd, 1e-9) / greatest(r.e_sd, 1e-9))) / greatest(se, 1e-9)", "tails": f"abs(p.far - {1 - tx.TAIL!r}) / greatest(se, 1e-9)",
        "dependence": f"{gap('acf')} / greatest(se, 1e-9)", "trend": f"{gap('slope')} / greatest(se * greatest(r.sd, 1e-9) * p.n, 1e-9)", "spectral": f"{gap('rough')} / greatest(se, 1e-9)",
    }
    bucket = " + ".join(f"(n_post >= {b})::int" for b in tx.BUCKETS)
    return (
        "with " + obs_sql(SUPPLIER) + _ROWS + f""", me as (select series_id, {tau} as tau, count(*) as n_online from onl group by series_id),
rl as (select *, row_number() over (order by rel, series_id) - 1 as pos, count(*) over () as m from (select series_id, tau / n_online::double as rel from me where tau > 0 and tau < n_online)),
cu as (select series_id, true as has_break, tau as cut, n_online from me where tau >= 0 union all
  select me.series_id, false, greatest({tx.PLACEBO_SIDE}, least(n_online - {tx.PLACEBO_SIDE}, floor(rel * n_online)))::bigint, n_online from me join rl on rl.pos = floor({mixed_sql('me.series_id', '17', '0')} * rl.m / {PRIME}::double) where tau < 0),
ct as (select * from cu where n_online >= {tx.SHORTEST} and cut >= {tx.SIDE} and n_online - cut >= {tx.SIDE}),
sd as (select * from (select rw.series_id, part, t, z, case when part = 'h' and t < 2 then null else e end as e, has_break, case when part = 'o' and t >= cut then 'post' when part = (case when cut >= {tx.OWN} then 'o' else 'h' end) then 'ref' end as side from rw join ct using (series_id)) where side is not null),
s1 as (select *, z - avg(z) over g as c, avg(z) over g as m, count(*) over g as n, row_number() over o - 1 as k, z - lag(z) over o as d from sd window g as (partition by series_id, side), o as (partition by series_id, side order by t)),
s2 as (select *, lag(c) over (partition by series_id, side order by t) as l, k - (n - 1) / 2.0 as x from s1),
q as (select series_id, quantile_cont(abs(z), {tx.TAIL}) as q from sd where side = 'ref' group by series_id),
ag as (select series_id, has_break, side, count(*) as n, any_value(m) as mean, stddev_pop(z) as sd, stddev_pop(e) as e_sd, avg((abs(z) > q)::int) as far, coalesce(sum(c * l), 0.0) / sum(c * c) as acf, sum(x * z) / greatest(sum(x * x), 1e-9) * count(*) as slope, case when count(*) > 2 then var_pop(d) / greatest(var_pop(z), 1e-12) else 0.0 end as rough from s2 join q using (series_id) group by all),
ef as (select series_id, has_break, n_post, {', '.join(f'round({size[f]}, 9) as {f}' for f in _F)} from (select r.series_id, r.has_break, p.n as n_post, r, p, sqrt(1.0 / r.n + 1.0 / p.n) as se from ag r join ag p on r.series_id = p.series_id and r.side = 'ref' and p.side = 'post')),
lo as (select series_id, has_break, {bucket} as bucket, unnest([{', '.join(f"{{'family': '{f}', 'k': {i}, 'size': {f}}}" for i, f in enumerate(_F))}]) as c from ef),
rk as (select series_id, has_break, c.family as family, c.k as k, sum((not has_break)::int) over (partition by c.family, bucket order by c.size) as le, sum((not has_break)::int) over (partition by c.family, bucket) as n0 from lo),
su as (select *, least(-log10(greatest(1 - le / (n0 + 1.0), 1 / (n0 + 1.0))), {tx.CAP}) as s from rk where n0 >= {LEAST}),
ld as (select *, row_number() over (partition by series_id order by s desc, k) as place, lead(s) over (partition by series_id order by s desc, k) as second from su)
select series_id, has_break, case when s >= {tx.LEADS} then family else 'none' end as family, round(s, 6) + 0.0 as lead, s >= {tx.LEADS} and second >= {tx.MIXED} * s as mixed from ld where place = 1"""
    )


def break_families(spark, sf):
    """The leading family of every series' break, or of its placebo cut."""
    rows = materialize(sq.inputs(obs(spark, sf, SUPPLIER), N).select("series_id", "part", "t", "z", F.when((F.col("part") == "h") & (F.col("t") < 2), None).otherwise(F.col("e")).alias("e")), "rows")
    meta = rows.filter("part = 'o'").groupBy("series_id").agg(F.count("*").alias("n_online")).withColumn("tau", planted_tau(F.col("series_id"), HORIZON))
    return rounded(tx.leaders(tx.surprises(tx.effects(rows, tx.cuts(meta)), LEAST)))


QUERIES |= {"q_break_families": break_families}
ORACLE |= {"q_break_families": _sql()}
