"""Sequential evidence judged by detector-path nulls, and its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import neighbours as nb
from ..operators import pathnull as pn
from ..operators import sequential as sq
from ..sources.series import SUPPLIER
from ._base import obs, obs_sql, rounded

QUERIES, ORACLE = {}, {}

N = SUPPLIER.n_hist
#: Ratios of whole numbers, which are given as they are: rounding would meet ties.
SHARES = ("_tsp", "_per")
_ROWS = f""", zz as materialized (select o.series_id, o.i, (o.x - p.mu) / p.sd as z, lag((o.x - p.mu) / p.sd, 1) over o as a, lag((o.x - p.mu) / p.sd, 2) over o as b from obs o join par p using (series_id) window o as (partition by o.series_id order by o.i)),
g2 as (select series_id, count(*) + 2 as n, sum(a * a) as aa, sum(a * b) as ab, sum(b * b) as bb, sum(z * a) as xa, sum(z * b) as xb from zz where i < {N} and b is not null group by series_id),
f2 as (select series_id, (xa * (bb + 1e-6 * n) - xb * ab) / ((aa + 1e-6 * n) * (bb + 1e-6 * n) - ab * ab) as phi1, (xb * (aa + 1e-6 * n) - xa * ab) / ((aa + 1e-6 * n) * (bb + 1e-6 * n) - ab * ab) as phi2 from g2),
r0 as (select series_id, case when i < {N} then 'h' else 'o' end as part, case when i < {N} then i else i - {N} end as t, z, case when b is null then 0.0 else z - phi1 * a - phi2 * b end as e, z * z as sq from zz join f2 using (series_id)),
ms as (select series_id, avg(sq) as m_sq, greatest(stddev_pop(sq), 1e-9) as s_sq from r0 where part = 'h' group by series_id),
rw as materialized (select r0.*, m_sq, (sq - m_sq) / s_sq as v from r0 join ms using (series_id))"""
_W = "partition by series_id, part order by t"
_SUMS = [("cz50", "z", 0.5), ("cz25", "z", 0.25), ("cz100", "z", 1.0), ("ce50", "e", 0.5), ("ce25", "e", 0.25), ("sq50", "v", 0.5), ("sq25", "v", 0.25), ("ph", "gap", 0.5)]


def _dyadic(name: str, c: str) -> str:
    some = [f"case when t + 1 >= {1 << j} then pow({c} - coalesce(lag({c}, {1 << j}) over w, 0.0), 2) / {2 << j} end as g{j}" for j in range(10)]
    each = ", ".join(f"g{j}" for j in range(10))
    return f"(select series_id, part, t, greatest({each}) as {name}, round(ln(({' + '.join(f'coalesce(exp(least(g{j}, 40.0)), 0.0)' for j in range(10))}) / ({' + '.join(f'(g{j} is not null)::int' for j in range(10))}) + 1e-12), 9) as {name}_mix from (select series_id, part, t, {', '.join(some)} from c0 window w as ({_W})))"


def _paths() -> str:
    c1 = ", ".join(f"sum({x} - {k}) over w as {n}_up, sum(-{x} - {k}) over w as {n}_dn" for n, x, k in _SUMS)
    c2 = ", ".join(f"{n}_{d} - least(0.0, min({n}_{d}) over w) as {n}_{d}" for n, _, _ in _SUMS for d in ("up", "dn"))
    both = ", ".join(f"greatest({n}_up, {n}_dn) as {n}" for n, _, _ in _SUMS[:-1])
    rates = {"ew8": ("z", 8), "ew32": ("z", 32), "ew128": ("z", 128), "ewv": ("sq", 32)}
    a = {n: 1 - 2 ** (-1 / h) for n, (_, h) in rates.items()}
    first = "0.5 * z - 0.125 as srz, " + ", ".join(f"{a[n]!r} * {x} as {n}" for n, (x, _) in rates.items())
    after = "0.5 * o.z - 0.125 + ln(1 + exp(r.srz)) as srz, " + ", ".join(f"r.{n} + {a[n]!r} * (o.{x} - r.{n}) as {n}" for n, (x, _) in rates.items())
    unbiased = lambda n: f"{n} / (1 - power({1 - a[n]!r}, t + 1))"
    means = ", ".join(f"{unbiased(n)} as {n}" for n in ("ew8", "ew32", "ew128")) + f", ln(({unbiased('ewv')} + 1e-6) / (m_sq + 1e-6)) as ewv"
    names = [n for n in (*sq.FULL, *sq.SMALL, *sq.LEVEL) if n != "srz"]
    cells = ", ".join(f"{{'det': '{n}', 'd': {n}, 's': {n}}}" for n in names)
    more = "{'det': 'srz', 'd': srz, 's': srz}, " + ", ".join(f"{{'det': '{n}', 'd': abs({n}), 's': {n}}}" for n in rates)
    return f""", c0 as materialized (select *, z - sum(z) over w / (t + 1) as gap, sum(z) over w as cz, sum(e) over w as ce from rw window w as ({_W})),
c1 as (select series_id, part, t, {c1} from c0 window w as ({_W})), c2 as (select series_id, part, t, {c2} from c1 window w as ({_W})),
wide as (select c2.*, {both}, ph_up as phu, ph_dn as phd, glz, glz_mix, gle from c2 join {_dyadic('glz', 'cz')} using (series_id, part, t) join {_dyadic('gle', 'ce')} using (series_id, part, t)),
r as (select series_id, part, t, m_sq, {first} from rw where t = 0 union all select o.series_id, o.part, o.t, o.m_sq, {after} from r join rw o on o.series_id = r.series_id and o.part = r.part and o.t = r.t + 1),
mn as (select series_id, part, t, srz, {means} from r),
pt as materialized (select series_id, part, t, c.det as det, round(c.d, 9) as d, c.s as s from (select series_id, part, t, unnest([{cells}]) as c from wide union all select series_id, part, t, unnest([{more}]) as c from mn))"""


def _judged(peaked: str, asked: str) -> str:
    tops = ", ".join(f"max(d) over (partition by series_id, det order by t rows {w - 1} preceding) as m{w}" for w in pn.PEAKS)
    cases = ", ".join(f"{{'w': {w}, 'v': case when not ({peaked}) then null when n - {w} + 1 < 8 then m0 when t >= {w - 1} then m{w} end}}" for w in pn.PEAKS)
    return f""", hp as (select *, case when t >= case when n - least(64, n // 4) < 8 then 0 else least(64, n // 4) end then d end as m0 from (select *, count(*) over (partition by series_id, det) as n, {tops} from pt where part = 'h')),
nul as materialized (select series_id, det, c.w as w, c.v as v from (select series_id, det, unnest([{{'w': 0, 'v': m0}}, {cases}]) as c from hp) where c.v is not null),
lw as (select series_id, det, max(case when k = floor(0.25 * n) then v end) as q25, max(case when k = n // 2 then v end) as q50, max(case when k = floor(0.75 * n) then v end) as q75, max(case when k = least(n - 1, floor(0.99 * n)) then v end) as q99, max(v) as top
  from (select *, row_number() over (partition by series_id, det order by v) - 1 as k, count(*) over (partition by series_id, det) as n from nul where w = 0) group by all),
law as (select *, greatest(q99 - q50, 0.1 * (top - q50), 1e-3 * greatest(abs(q50), 1.0)) as scale from lw),
sh as materialized (select *, (t - max(case when d >= peak then t end) over w) / (t + 1)::double as tsp, sum(case when d > q99 then 1.0 else 0.0 end) over w / (t + 1)::double as per,
    greatest(-12.0, least(12.0, (d - lag(d, 16) over w) / (16 * scale))) as slp, d / (peak + 1e-12) as rel, least(ln(1 + greatest(peak - q99, 0.0) / scale), 12.0) as pkr, greatest(-12.0, least(12.0, (d - q50) / greatest((q75 - q25) / 1.349, 1e-9))) as rz
  from (select p.*, l.* exclude (series_id, det), max(d) over w as peak, exp(max(ln(greatest(d, 0.0) + 1e-12) + t * ln(2) / 64) over w - t * ln(2) / 64) as decayed from pt p join law l using (series_id, det) where part = 'o' window w as (partition by series_id, det order by t)) window w as (partition by series_id, det order by t)),
ask as (select series_id, det, t, a.kind as kind, a.w as w, a.x as x from (select series_id, det, t, unnest([{asked}]) as a from sh) where a.x is not null),
bo as (select series_id, det, w, null::bigint as t, null::varchar as kind, v as x from nul union all select series_id, det, w, t, kind, x from ask),
rk as (select *, sum((t is null)::int) over (partition by series_id, det, w order by x) as below, sum((t is null)::int) over (partition by series_id, det, w, x) as same, sum((t is null)::int) over (partition by series_id, det, w) as n, max(case when t is null then x end) over (partition by series_id, det, w) as top from bo),
sc as (select rk.series_id, rk.det, rk.t, kind, x, least(least(-log10(greatest(1 - 0.5 * (2 * below - same) / n, 1 / (2.0 * n))), 6.0) + ln(1 + greatest(x - rk.top, 0.0) / scale), 12.0) as s from rk join law using (series_id, det) where rk.t is not null)"""


_NEAR = "case when (t + 1) * (t + 1) <= 4096 then 32 when (t + 1) * (t + 1) <= 65536 then 128 else 512 end"
PATH_SQL = (
    "with " + obs_sql(SUPPLIER) + f""", hz as (select o.series_id, case when i < {N} then 'h' else 'o' end as part, case when i < {N} then i else i - {N} end as t, (x - mu) / sd as z from obs o join par using (series_id)),
su as (select *, sum(z - 0.5) over w as u, sum(-z - 0.5) over w as dn from hz window w as ({_W})),
pt as materialized (select series_id, part, 'cusum' as det, t, greatest(u - least(0.0, min(u) over w), dn - least(0.0, min(dn) over w)) as s, round(s, 9) as d from su window w as ({_W}))"""
    + _judged("true", f"{{'kind': 'cur', 'w': 0, 'x': d}}, {{'kind': 'pk', 'w': {_NEAR}, 'x': peak}}")
    + " select series_id, t, round(max(pt.s), 6) + 0.0 as d, round(max(case when kind = 'cur' then sc.s end), 6) + 0.0 as cur, round(max(case when kind = 'pk' then sc.s end), 6) + 0.0 as pk from sc join pt using (series_id, t) where pt.part = 'o' group by series_id, t"
)


def _sequential_sql() -> str:
    listed = lambda xs: "det in (" + ", ".join(f"'{x}'" for x in xs) + ")"
    full, usual = listed(sq.FULL), listed([*sq.FULL, *sq.SMALL, *sq.LEVEL])
    asked = f"{{'kind': 'cur', 'w': 0, 'x': case when {usual} then d end}}, {{'kind': 'pk', 'w': {_NEAR}, 'x': case when {full} then peak end}}, {{'kind': 'dpk', 'w': 128, 'x': case when {full} then decayed end}}"
    pick = lambda src, det, cond, c: f"max(case when det = '{det}'{cond} then {src}.{c} end)"
    scored = ", ".join(f"{pick('sc', d, f' and kind = {chr(39)}{k}{chr(39)}', 's')} as {d}_{k}" for d in (*sq.FULL, *sq.SMALL) for k in (("cur", "pk", "dpk") if d in sq.FULL else ("cur",)))
    scored += ", " + ", ".join(f"{pick('sc', d, '', 's')} as {d}" for d in sq.LEVEL)
    plain = ", ".join(f"{pick('sh', d, '', k)} as {d}_{k}" for d in sq.FULL for k in ("tsp", "per", "slp", "rel")) + ", " + ", ".join(f"{pick('sh', d, '', 'pkr')} as {d}_pkr" for d in sq.SMALL)
    plain += ", " + ", ".join(f"{pick('sh', d, '', 'rz')} * sign({pick('sh', d, '', 's')}) as {n}" for n, d in sq.ROBUST.items()) + f", {pick('sh', 'ew32', '', 's')} as e32"
    pools = [f"{d}_cur" for d in (*sq.FULL, *sq.SMALL)]
    cols = [c for c in sq.columns() if not c.startswith("xc_") and c not in ("ew32_pkrel", "ew32_slp")]
    return (
        "with recursive " + obs_sql(SUPPLIER) + _ROWS + _paths() + _judged(full, asked)
        + f", ta as (select series_id, t, {scored} from sc group by series_id, t), tb as (select series_id, t, {plain} from sh group by series_id, t) select series_id, t, {', '.join(c if c.endswith(SHARES) else f'round({c}, 5) + 0.0 as {c}' for c in cols)}, "
        "round(abs(e32) / (max(abs(e32)) over w + 1e-12), 5) + 0.0 as ew32_pkrel, round((e32 - lag(e32, 16) over w) / 16, 5) + 0.0 as ew32_slp, "
        f"round(greatest({', '.join(pools)}), 5) + 0.0 as xc_max_cur, ({' + '.join(f'({p} > 2)::int' for p in pools)})::double as xc_n_hot, round(greatest({', '.join(f'{d}_pk' for d in sq.FULL)}), 5) + 0.0 as xc_max_pk "
        "from ta join tb using (series_id, t) window w as (partition by series_id order by t)"
    )


def path_null(spark, sf):
    """Reflected sums against their own path: the level and the running peak."""
    return rounded(sq.path_surprise(obs(spark, sf, SUPPLIER), N))


def sequential(spark, sf):
    return sq.sequential(obs(spark, sf, SUPPLIER, spread=True), N, 5, SHARES, spread=False)


QUERIES |= {"q_path_null": path_null, "q_feat_m01_seq": sequential}
ORACLE |= {"q_path_null": PATH_SQL, "q_feat_m01_seq": _sequential_sql()}


M = 16
NEAR_SQL = (
    "with " + obs_sql(SUPPLIER) + f""", xs as (select series_id, i, x from obs),
wn as (select series_id, part, t, list(x) over (partition by series_id, part order by t rows {M - 1} preceding) as w from (select series_id, case when i < {N} then 'h' else 'o' end as part, case when i < {N} then i else i - {N} end as t, x from xs)),
nm as materialized (select series_id, part, t - {M - 1} as s, list_transform(w, lambda v: (v - list_avg(w)) / case when list_stddev_pop(w) > 1e-12 then list_stddev_pop(w) else 1.0 end) as w from wn where len(w) = {M}),
hd as (select q.series_id, q.s, min(list_distance(q.w, r.w)) as d, arg_min(r.s, list_distance(q.w, r.w)) as near from nm q join nm r on q.series_id = r.series_id and q.part = 'o' and r.part = 'h' group by all),
od as (select q.series_id, q.s, min(list_distance(q.w, r.w)) as d from nm q join nm r on q.series_id = r.series_id and q.part = 'o' and r.part = 'o' and r.s <= q.s - {M} group by all)
select hd.series_id, hd.s + {M - 1} as t, round(hd.d, 6) + 0.0 as d_hist, near as nearest, round(od.d, 6) + 0.0 as d_online, round(ln(1 + hd.d) - ln(1 + od.d), 6) + 0.0 as provenance,
  sum(case when near >= {-(-3 * (N - M + 1) // 4)} then 1.0 else 0.0 end) over w / row_number() over w as arc from hd left join od using (series_id, s) window w as (partition by hd.series_id order by hd.s)"""
)


def nearest_subsequence(spark, sf):
    """Nearest windows of 16 values in the history and in the online past."""
    o = obs(spark, sf, SUPPLIER)
    rows = o.select("series_id", F.when(F.col("i") < N, "h").otherwise("o").alias("part"), F.when(F.col("i") < N, F.col("i")).otherwise(F.col("i") - N).alias("t"), "x")
    got = nb.geometry(nb.neighbours(rows, M), N - M + 1).drop("measured")
    return got.select("series_id", "t", "nearest", "arc", *[F.round(c, 6).alias(c) for c in ("d_hist", "d_online", "provenance")])


QUERIES |= {"q_nearest_subsequence": nearest_subsequence}
ORACLE |= {"q_nearest_subsequence": NEAR_SQL}
