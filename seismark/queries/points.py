"""Sources, labels, history fits, per-point transforms, windows and null calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detectors as det
from ..operators import history as h
from ..operators import nulls
from ..operators import windows as w
from ..sources.series import SUPPLIER, USER, absorbing_label, planted_tau, split
from ._base import obs, obs_sql, panel, panel_sql, rounded, unsigned, z_online

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return put


U, S = "with " + obs_sql(USER), "with " + obs_sql(SUPPLIER)
P = "with " + panel_sql()
TAU = "(case when series_id % 2 = 0 then (series_id * 37) % 40 else -1 end)::bigint"


@query("q_series_meta", U + f" select series_id, count(*) filter (where i < 40) as n_hist, count(*) filter (where i >= 40) as n_online, {TAU} as tau, {TAU} >= 0 as has_break from obs group by series_id")
def series_meta(spark, sf):
    c = lambda x: F.sum(F.when(x, 1).otherwise(0)).cast("long")
    m = obs(spark, sf, USER).groupBy("series_id").agg(c(F.col("i") < 40).alias("n_hist"), c(F.col("i") >= 40).alias("n_online"))
    return m.withColumn("tau", planted_tau(F.col("series_id"))).withColumn("has_break", F.col("tau") >= 0)


@query("q_labels", U + f" select series_id, t::bigint as t, (case when {TAU} >= 0 and t >= {TAU} then 1 else 0 end)::bigint as y from onl")
def labels(spark, sf):
    _, online = split(obs(spark, sf, USER), 40)
    return online.select("series_id", "t", absorbing_label(F.col("t"), planted_tau(F.col("series_id"))).alias("y"))


@query("q_age", P + " select series_id, t, case when y = 1 then t - tau else -1 end as age from panel")
def age(spark, sf):
    return panel(spark, sf).select("series_id", "t", F.when(F.col("y") == 1, F.col("t") - F.col("tau")).otherwise(F.lit(-1)).cast("long").alias("age"))


@query("q_last_row", P + " select series_id, max(t) as t, arg_max(score, t) as score from panel group by series_id")
def last_row(spark, sf):
    return panel(spark, sf).groupBy("series_id").agg(F.max("t").alias("t"), F.max_by("score", "t").alias("score"))


@query("q_future_eligibility", P + " select t, count(*) as n, count(f) as eligible, coalesce(sum(case when f is not null then f - score end), 0)::bigint as gap from (select *, lead(score, 5) over (partition by series_id order by t) as f from panel) group by t")
def future(spark, sf):
    p = panel(spark, sf).withColumn("f", F.lead("score", 5).over(w.by()))
    return p.groupBy("t").agg(F.count("*").alias("n"), F.count("f").alias("eligible"), F.coalesce(F.sum(F.col("f") - F.col("score")), F.lit(0)).cast("long").alias("gap"))


@query("q_dominant_masks", P + " select count(*) filter (where t >= 10 and y = 1 and t - tau between 0 and 9) as dominant, count(*) filter (where t >= 20 and tau < 0) as mature_never, count(*) filter (where t >= 20 and tau >= 0 and y = 0) as mature_prebreak from panel")
def masks(spark, sf):
    c = lambda e: F.count(F.when(F.expr(e), 1))
    return panel(spark, sf).agg(c("t >= 10 and y = 1 and t - tau between 0 and 9").alias("dominant"), c("t >= 20 and tau < 0").alias("mature_never"), c("t >= 20 and tau >= 0 and y = 0").alias("mature_prebreak"))


@query("q_sample_per_series", P + " select series_id, t, score from (select *, row_number() over (partition by series_id order by (t * 7919 + series_id * 104729) % 10007, t) as k from panel) where k <= 5")
def sample(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("series_id").orderBy((F.col("t") * 7919 + F.col("series_id") * 104729) % 10007, "t")
    return panel(spark, sf).withColumn("k", F.row_number().over(order)).filter("k <= 5").select("series_id", "t", "score")


@query(
    "q_baseline_features",
    U + """, f as (select series_id, i, x, case when count(*) over w3 = 3 then avg(x) over w3 end as m3, case when count(*) over w3 = 3 then stddev_samp(x) over w3 end as s3, lag(x, 1) over o as l1, lag(x, 2) over o as l2, x - lag(x, 1) over o as d1, x - lag(x, 2) over o as d2
  from obs window o as (partition by series_id order by i), w3 as (partition by series_id order by i rows 2 preceding))
select series_id, i, round(first_value(m3 ignore nulls) over a, 6) as rolling_mean_3, round(first_value(s3 ignore nulls) over a, 6) as rolling_std_3, round(first_value(l1 ignore nulls) over a, 6) as lag_1, round(first_value(l2 ignore nulls) over a, 6) as lag_2, round(first_value(d1 ignore nulls) over a, 6) as diff_1, round(first_value(d2 ignore nulls) over a, 6) as diff_2
from f window a as (partition by series_id order by i rows between current row and unbounded following)""",
)
def baseline(spark, sf):
    return rounded(det.baseline_features(obs(spark, sf, USER)).drop("cents", "x"))


CUSUM_SQL = """, s as (select series_id, i, count(*) over p as n, sum(cents) over p as s1, sum(cents * cents) over p as s2, sum(cents) over o as c, row_number() over o as k from obs window p as (partition by series_id), o as (partition by series_id order by i)),
v as (select series_id, i, abs(n * c - k * s1)::double as num, n::double * s2::double - s1::double * s1::double as var, n from s),
g as (select *, case when var > 0 then num / (sqrt(var) * sqrt(n::double)) else 0.0 end as score, max(num) over (partition by series_id) as top from v),
cus as (select series_id, i, score, case when i = min(case when num = top then i end) over (partition by series_id) and score >= 1.1 then 1 else 0 end as flag from g)"""


@query("q_detect_cusum", U + CUSUM_SQL + " select series_id, i, round(score, 6) as score, flag::bigint as flag from cus")
def detect_cusum(spark, sf):
    return rounded(det.cusum(obs(spark, sf, USER)))


RZ_SQL = """, s as (select series_id, i, cents, count(*) over w as n, sum(cents) over w as s1, sum(cents * cents) over w as s2 from obs window w as (partition by series_id order by i rows 19 preceding)),
rz as (select series_id, i, case when n >= 2 and n * s2 - s1 * s1 > 0 then abs(n * cents - s1)::double / sqrt((n * s2 - s1 * s1)::double) else 0.0 end as score from s)"""


@query("q_detect_rolling_z", U + RZ_SQL + " select series_id, i, round(score, 6) as score, (case when score > 3.0 then 1 else 0 end)::bigint as flag from rz")
def detect_rolling(spark, sf):
    return rounded(det.rolling_z(obs(spark, sf, USER)))


@query("q_break_edges", U + RZ_SQL + " select series_id, i from (select *, coalesce(lag(score > 2.0) over (partition by series_id order by i), false) as b from rz) where score > 2.0 and not b")
def edges(spark, sf):
    return det.rising_edges(det.rolling_z(obs(spark, sf, USER), threshold=2.0)).select("series_id", "i")


@query("q_f1_counts", P + ", j as (select y, case when score_b > 400000 then 1 else 0 end as flag from panel), c as (select count(*) filter (where y = 1 and flag = 1) as tp, count(*) filter (where y = 0 and flag = 1) as fp, count(*) filter (where y = 1 and flag = 0) as fn, count(*) filter (where y = 0 and flag = 0) as tn from j) select *, round(case when tp > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0.0 end, 6) as f1 from c")
def f1(spark, sf):
    return rounded(det.f1_counts(panel(spark, sf).withColumn("flag", F.when(F.col("score_b") > 400000, 1).otherwise(0)), "y", "flag"))


@query("q_t_statistic", S + ", g as (select series_id, avg(x) filter (where i >= 300) as ma, avg(x) filter (where i < 300) as mb, var_samp(x) filter (where i >= 300) as va, var_samp(x) filter (where i < 300) as vb, count(*) filter (where i >= 300) as na, count(*) filter (where i < 300) as nb from obs group by series_id) select series_id, round((ma - mb) / sqrt(va / na + vb / nb), 6) as t_stat from g")
def t_stat(spark, sf):
    return rounded(det.t_statistic(obs(spark, sf), 300))


@query("q_detect_pelt")
def pelt(spark, sf):
    return det.pelt(obs(spark, sf))


@query("q_point_metrics")
def points(spark, sf):
    o = obs(spark, sf, USER)
    found = det.rising_edges(det.rolling_z(o, threshold=2.0))
    truth = o.select("series_id").distinct().withColumn("i", planted_tau(F.col("series_id")) + 40).filter("i >= 40")
    return rounded(det.point_metrics(truth, found))


PAR_SQL = """, qs as (select series_id, quantile_cont(x, [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) as q from hist group by series_id),
md as (select h.series_id, quantile_cont(abs(h.x - q.q[5]), 0.5) as m from hist h join qs q using (series_id) group by h.series_id),
params as (select p.series_id, p.n, p.mu, p.sd, q[1] as q01, q[2] as q05, q[3] as q10, q[4] as q25, q[5] as q50, q[6] as q75, q[7] as q90, q[8] as q95, q[9] as q99, greatest(m * 1.4826, 1e-9) as mad, greatest(q[6] - q[4], 1e-9) as iqr from par p join qs using (series_id) join md using (series_id))"""


def _round_sql(cols: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) as {c}" for c in cols.split())


@query("q_hist_params", S + PAR_SQL + " select series_id, n, " + _round_sql("mu sd q01 q05 q10 q25 q50 q75 q90 q95 q99 iqr", 6) + ", round(mad, 8) as mad from params")
def hist_params(spark, sf):
    return rounded(h.parameters(split(obs(spark, sf), 300)[0]).withColumn("mad", F.round("mad", 8).cast("decimal(20,8)")), 6).withColumn("mad", F.col("mad").cast("double"))


@query("q_pit", S + " select o.series_id, o.t, round((0.5 * (count(*) filter (where h.cents < o.cents) + count(*) filter (where h.cents <= o.cents)) + 0.5) / 301, 9) as u from onl o join hist h using (series_id) group by o.series_id, o.t")
def pit(spark, sf):
    hist, online = split(obs(spark, sf), 300)
    return rounded(h.pit(online, hist), 9)


AR_SQL = """, zh as (select o.series_id, o.i, (o.x - p.mu) / p.sd as z from obs o join par p using (series_id)), lg as (select *, lag(z) over (partition by series_id order by i) as l from zh),
fit as (select series_id, case when count(*) < 20 then 0.0 else sum(z * l) / (sum(l * l) + 1e-6 * count(*)) end as phi from lg where i < 300 group by series_id)"""


def _ar(spark, sf):
    o = obs(spark, sf)
    hist, _ = split(o, 300)
    z = h.standardise(o, h.moments(hist))
    return z, h.ar1(z.filter("i < 300"))


@query("q_ar1_fit", S + AR_SQL + " select series_id, round(phi, 6) as phi from fit")
def ar1_fit(spark, sf):
    return rounded(_ar(spark, sf)[1])


@query("q_ar2_fit", S + AR_SQL + """, l2 as (select *, lag(z, 1) over o as a, lag(z, 2) over o as b from zh where i < 300 window o as (partition by series_id order by i)),
g as (select series_id, count(*) + 2 as n, sum(a * a) as aa, sum(a * b) as ab, sum(b * b) as bb, sum(z * a) as xa, sum(z * b) as xb from l2 where b is not null group by series_id)
select series_id, round((xa * (bb + 1e-6 * n) - xb * ab) / ((aa + 1e-6 * n) * (bb + 1e-6 * n) - ab * ab), 6) as phi1, round((xb * (aa + 1e-6 * n) - xa * ab) / ((aa + 1e-6 * n) * (bb + 1e-6 * n) - ab * ab), 6) as phi2 from g""")
def ar2_fit(spark, sf):
    return rounded(h.ar2(_ar(spark, sf)[0].filter("i < 300")))


@query("q_ar_residual", S + AR_SQL + " select l.series_id, l.i, round(z - phi * coalesce(l, 0.0), 6) as e from lg l join fit using (series_id) where l.i >= 300")
def ar_residual(spark, sf):
    z, fit = _ar(spark, sf)
    return rounded(h.residuals(z, fit).filter("i >= 300").select("series_id", "i", "e"))


def _transformed(spark, sf, names):
    hist, online = split(obs(spark, sf), 300)
    par = h.parameters(hist)
    rows = h.standardise(online, par).join(par.drop("mu", "sd", "n"), "series_id")
    made = h.transforms(rows, par)
    return rounded(rows.select("series_id", "t", *[made[n].alias(n) for n in names]))


TR = S + PAR_SQL + ", r as (select o.series_id, o.t, o.x, (o.x - mu) / sd as z, p.* exclude (series_id) from onl o join params p using (series_id)) "


@query("q_transforms_moment", unsigned(TR + "select series_id, t, round(z, 6) as mean, round(z * z, 6) as sq, round(abs(z), 6) as abs, round((x - q50) / mad, 6) as rmean, round(abs((x - q50) / mad), 6) as rabs, round(c * c * c, 6) as cube, round(c * c * c * c, 6) as quart, round(ln(abs(z) + 1e-3), 6) as logabs, sign(z)::double as sign from (select *, greatest(-8.0, least(8.0, z)) as c from r)", "mean", "rmean", "cube", "sq", "quart", "sign"))
def transforms_moment(spark, sf):
    return _transformed(spark, sf, ["mean", "sq", "abs", "rmean", "rabs", "cube", "quart", "logabs", "sign"])


@query("q_transforms_tail", TR + "select series_id, t, (case when x > q95 then 1.0 else 0.0 end)::double as tail_hi, (case when x < q05 then 1.0 else 0.0 end)::double as tail_lo, (case when x > q99 or x < q01 then 1.0 else 0.0 end)::double as tail_x, (case when x > q25 and x < q75 then 1.0 else 0.0 end)::double as center from r")
def transforms_tail(spark, sf):
    return _transformed(spark, sf, ["tail_hi", "tail_lo", "tail_x", "center"])


@query("q_transforms_lag", unsigned(TR + "select series_id, t, round(coalesce(z * lag(z) over o, 0.0), 6) as lag1, round(coalesce(z * lag(z, 2) over o, 0.0), 6) as lag2, round(coalesce(abs(z) * lag(abs(z)) over o, 0.0), 6) as abslag1 from r window o as (partition by series_id order by t)", "lag1", "lag2"))
def transforms_lag(spark, sf):
    return _transformed(spark, sf, ["lag1", "lag2", "abslag1"])


def _online(spark, sf):
    return split(obs(spark, sf), 300)[1]


@query("q_roll", S + " select series_id, t, " + ", ".join(f"case when count(*) over (partition by series_id order by t rows {k - 1} preceding) = {k} then round(sum(cents) over (partition by series_id order by t rows {k - 1} preceding) / {k}.0, 6) end as r{k}" for k in (8, 32, 128)) + " from onl")
def roll(spark, sf):
    return rounded(_online(spark, sf).select("series_id", "t", *[w.roll(F.col("cents"), k).alias(f"r{k}") for k in (8, 32, 128)]))


@query("q_expand", S + " select series_id, t, round((sum(cents) over o)::double / count(*) over o, 6) as mean from onl window o as (partition by series_id order by t)")
def expand(spark, sf):
    return rounded(_online(spark, sf).select("series_id", "t", w.expand(F.col("cents")).alias("mean")))


@query("q_adaptive_half", S + ", c as (select *, sum(cents) over (partition by series_id order by t) as c, greatest((t + 1) // 2, 1) as w from onl) select a.series_id, a.t, round((a.c - coalesce(b.c, 0))::double / a.w, 6) as half from c a left join c b on a.series_id = b.series_id and b.t = a.t - a.w")
def adaptive(spark, sf):
    return rounded(w.adaptive(_online(spark, sf).select("series_id", "t", "cents"), "cents", "half").select("series_id", "t", "half"))


@query("q_suffix_prefix", S + """, c as (select *, sum(cents) over (partition by series_id order by t) as c from onl), e as (select a.series_id, a.t, """ + ", ".join(f"case when a.t + 1 - {k} >= 8 then (a.c - b{k}.c)::double / {k} - b{k}.c::double / (a.t + 1 - {k}) end as d{k}" for k in (8, 32, 128)) + " from c a " + " ".join(f"left join c b{k} on b{k}.series_id = a.series_id and b{k}.t = a.t - {k}" for k in (8, 32, 128)) + ") select series_id, t, round(d8, 3) as d8, round(d32, 3) as d32, round(d128, 3) as d128 from e")
def suffix_prefix(spark, sf):
    o = _online(spark, sf).withColumn("c", w.prefix(F.col("cents")))
    cols = []
    for k in (8, 32, 128):
        before = F.lag("c", k).over(w.by())
        rest = F.col("t") + 1 - k
        cols.append(F.when(rest >= 8, (F.col("c") - before) / F.lit(k) - before / rest).alias(f"d{k}"))
    return rounded(o.select("series_id", "t", *cols), 3)


GRID = (5, 8, 12, 16, 24, 32, 48, 64, 96, 128)
NULL_SQL = ", nv as (" + " union all ".join(f"select series_id, {k}::bigint as w, s / {k}.0 as v, s from (select series_id, count(*) over o as k, sum(cents) over o as s from hist window o as (partition by series_id order by i rows {k - 1} preceding)) where k = {k}" for k in GRID) + """),
nq as (select series_id, w, count(*) as n, quantile_cont(v, [0.25, 0.5, 0.75]) as q, stddev_pop(v) as s from nv group by series_id, w),
nt as (select series_id, w, n, q[2] as mu, greatest((q[3] - q[1]) / 1.349, s, 1e-12) as sd from nq)"""


def _nulls(spark, sf, grid=GRID):
    hist, online = split(obs(spark, sf), 300)
    return nulls.rolled(hist, "cents", grid), online


@query("q_null_table", S + NULL_SQL + " select series_id, w, n, round(mu, 4) as mu, round(sd, 4) as sd from nt")
def null_table(spark, sf):
    return rounded(nulls.table(_nulls(spark, sf)[0]), 4)


PCT_SQL = NULL_SQL + """, ov as (""" + " union all ".join(f"select series_id, t, {k}::bigint as w, s / {k}.0 as v from (select series_id, t, count(*) over o as k, sum(cents) over o as s from onl window o as (partition by series_id order by t rows {k - 1} preceding)) where k = {k}" for k in (8, 32)) + """),
pc as (select o.series_id, o.w, o.t, count(*) as n, 0.5 * (count(*) filter (where nv.v < o.v) + count(*) filter (where nv.v <= o.v)) / count(*) as pct from ov o join nv using (series_id, w) group by o.series_id, o.w, o.t)"""


def _pct(spark, sf):
    null, online = _nulls(spark, sf, (8, 32))
    wide = online.select("series_id", "t", *[w.roll(F.col("cents"), k).alias(f"w{k}") for k in (8, 32)])
    values = wide.select("series_id", "t", F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("w"), F.col(f"w{k}").alias("v")) for k in (8, 32)])).alias("c")).select("series_id", "c.w", "t", "c.v").filter("v is not null")
    return nulls.percentiles(values, null)


@query("q_null_pct", S + PCT_SQL + " select series_id, w, t, round(pct, 9) as pct from pc")
def null_pct(spark, sf):
    return rounded(_pct(spark, sf).select("series_id", "w", "t", "pct"), 9)


@query("q_null_surprise", S + PCT_SQL + " select series_id, w, t, round(-log10(greatest(2 * least(pct, 1 - pct), 1.0 / (2 * n))), 6) as surprise from pc")
def null_surprise(spark, sf):
    p = _pct(spark, sf)
    return rounded(p.select("series_id", "w", "t", nulls.surprise(F.col("pct"), F.col("n")).alias("surprise")))


@query("q_null_z", S + NULL_SQL + """, ex as (select series_id, t, (sum(cents) over o)::double / (t + 1) as v, greatest(5.0, least(128.0, (t + 1)::double)) as l from onl window o as (partition by series_id order by t)),
br as (select e.series_id, e.t, e.v, e.l, (select max(w) from (select unnest([5, 8, 12, 16, 24, 32, 48, 64, 96, 128]) as w) where w <= e.l) as wa, (select min(w) from (select unnest([5, 8, 12, 16, 24, 32, 48, 64, 96, 128]) as w) where w >= e.l) as wb from ex e),
j as (select br.*, a.mu as ma, a.sd as sa, b.mu as mb, b.sd as sb, case when wa = wb then 0.0 else (ln(l) - ln(wa::double)) / (ln(wb::double) - ln(wa::double)) end as f from br join nt a on a.series_id = br.series_id and a.w = wa join nt b on b.series_id = br.series_id and b.w = wb)
select series_id, t, round((v - (ma + f * (mb - ma))) / exp(ln(sa) + f * (ln(sb) - ln(sa))), 5) as z from j""")
def null_z(spark, sf):
    null, online = _nulls(spark, sf)
    v = online.select("series_id", "t", w.expand(F.col("cents")).alias("v"), (F.col("t") + 1).alias("len"))
    return rounded(nulls.interpolated_z(v, nulls.table(null), "len", "v").select("series_id", "t", "z"), 5)


@query("q_zscore_online", S + " select series_id, t, round(z, 6) as z from zon")
def zscore(spark, sf):
    return rounded(z_online(spark, sf).select("series_id", "t", "z"))
