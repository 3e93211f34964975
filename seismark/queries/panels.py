"""Ranking metrics, loss attribution, calibration, blends, folds and controls over the S_user panel."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import calibrate as c
from ..operators import panel as p
from ..operators import windows as w
from ._base import panel, panel_sql, rounded, unsigned

QUERIES, ORACLE = {}, {}
P = "with " + panel_sql()
#: Independent form: average ranks of all rows, then the rank-sum identity.
RANK = ", rk as (select *, rank() over (partition by t order by score) + (count(*) over (partition by t, score) - 1) / 2.0 as r from panel), st as (select t, count(*) filter (where y = 1) as n_pos, count(*) filter (where y = 0) as n_neg, (2 * (sum(r) filter (where y = 1)) - count(*) filter (where y = 1) * (count(*) filter (where y = 1) + 1))::bigint as num2 from rk group by t having count(*) filter (where y = 1) > 0 and count(*) filter (where y = 0) > 0)"


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return put


@query("q_ts_auc", P + RANK + " select round(coalesce(sum(num2) / (2.0 * sum(n_pos * n_neg)), 0.5), 9) as auc, coalesce(sum(n_pos * n_neg), 0)::bigint as pairs, count(*) as steps from st")
def ts_auc(spark, sf):
    return rounded(p.pooled(p.per_step(panel(spark, sf))), 9)


@query("q_ts_auc_per_step", P + RANK + " select t, n_pos, n_neg, num2, (n_pos * n_neg)::bigint as w, round(num2 / (2.0 * n_pos * n_neg), 9) as auc from st")
def per_step(spark, sf):
    return rounded(p.per_step(panel(spark, sf)), 9)


@query("q_ts_auc_weightings", P + RANK + ", a as (select *, num2 / (2.0 * n_pos * n_neg) as auc from st) select round(sum(num2) / (2.0 * sum(n_pos * n_neg)), 9) as pairs, round(avg(auc), 9) as equal, round(sum(auc * (n_pos + n_neg)) / sum(n_pos + n_neg), 9) as alive from a")
def weightings(spark, sf):
    return rounded(p.weightings(p.per_step(panel(spark, sf))), 9)


BUCKETS = ((0, 4), (5, 9), (10, 19), (20, 39))


@query("q_ts_auc_by_age", P + ", b as (select unnest([0, 5, 10, 20]) as lo, unnest([4, 9, 19, 39]) as hi), pr as (select lo, p.t, count(*) as pairs, sum(case when p.score > q.score then 2 when p.score = q.score then 1 else 0 end) as num2 from panel p join panel q on p.t = q.t and p.y = 1 and q.y = 0 join b on p.t - p.tau between lo and hi group by lo, p.t) select lo::bigint as age_from, round(sum(num2) / (2.0 * sum(pairs)), 9) as auc, sum(pairs)::bigint as pairs, count(*) as steps from pr group by lo")
def by_age(spark, sf):
    rows = panel(spark, sf)
    b = F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("lo"), F.lit(z).cast("long").alias("hi")) for a, z in BUCKETS]))
    age = F.col("t") - F.col("tau")
    each = rows.select("t", "score", "y", "tau", b.alias("b")).filter((F.col("y") == 0) | ((age >= F.col("b.lo")) & (age <= F.col("b.hi")))).select(F.col("b.lo").alias("age_from"), "t", "score", "y")
    return rounded(p.pooled(p.per_step(each, "age_from", "t"), "age_from"), 9)


FOLD = "(((series_id * 2654435 + 97) % 10007) % 5)::bigint"


@query("q_ts_auc_by_fold", P + f", pr as (select {FOLD.replace('series_id', 'p.series_id')} as fold, p.t, count(*) as pairs, sum(case when p.score > q.score then 2 when p.score = q.score then 1 else 0 end) as num2 from panel p join panel q on p.t = q.t and p.y = 1 and q.y = 0 and {FOLD.replace('series_id', 'p.series_id')} = {FOLD.replace('series_id', 'q.series_id')} group by 1, p.t) select fold, round(sum(num2) / (2.0 * sum(pairs)), 9) as auc, sum(pairs)::bigint as pairs, count(*) as steps from pr group by fold")
def by_fold(spark, sf):
    rows = panel(spark, sf).withColumn("fold", c.fold_of(F.col("series_id")))
    return rounded(p.pooled(p.per_step(rows, "fold", "t"), "fold"), 9)


@query("q_loss_cube", P + ", pr as (select p.t, p.t - p.tau as age, case when q.tau < 0 then 'never' else 'prebreak' end as kind, case when q.score > p.score then 2 when p.score = q.score then 1 else 0 end as l from panel p join panel q on p.t = q.t and p.y = 1 and q.y = 0) select case when t < 5 then 0 when t < 20 then 5 else 20 end::bigint as t_band, case when age < 5 then 0 when age < 15 then 5 else 15 end::bigint as age_band, kind, sum(l)::bigint as lost2, (2 * count(*))::bigint as pairs2 from pr group by 1, 2, 3")
def cube(spark, sf):
    band = lambda x, a, b: F.when(x < a, 0).when(x < b, a).otherwise(b).cast("long")
    out = p.loss_cube(panel(spark, sf), band(F.col("t"), 5, 20), band(F.col("age"), 5, 15))
    return out.filter("pairs2 > 0").select("t_band", "age_band", "kind", "lost2", "pairs2")


@query("q_series_loss", P + ", pr as (select p.series_id as a, q.series_id as b, case when q.score > p.score then 2 when p.score = q.score then 1 else 0 end as l from panel p join panel q on p.t = q.t and p.y = 1 and q.y = 0), u as (select a as series_id, l from pr union all select b, l from pr) select s.series_id, coalesce(sum(l), 0)::bigint as loss2 from (select distinct series_id from panel) s left join u using (series_id) group by s.series_id")
def series_loss(spark, sf):
    return p.row_losses(panel(spark, sf)).groupBy("series_id").agg(F.sum("loss2").alias("loss2"))


@query("q_pair_geometry", P + RANK + ", w as (select t, n_pos * n_neg as w, sum(n_pos * n_neg) over (order by t) as c, sum(n_pos * n_neg) over () as a from st) select t, w::bigint as w, round(w::double / a, 9) as share, round(c::double / a, 9) as cumulative from w")
def geometry(spark, sf):
    s = p.per_step(panel(spark, sf)).select("t", "w")  # a row for each step
    one = Window.partitionBy(F.lit(0))
    return rounded(s.withColumn("a", F.sum("w").over(one)).withColumn("c", F.sum("w").over(one.orderBy("t"))).select("t", "w", (F.col("w") / F.col("a")).alias("share"), (F.col("c") / F.col("a")).alias("cumulative")), 9)


@query("q_pair_flow", P + " select p.t, count(*) as pairs, count(*) filter (where p.score_b <= q.score_b and p.score > q.score) as repaired, count(*) filter (where p.score_b > q.score_b and p.score <= q.score) as damaged from panel p join panel q on p.t = q.t and p.y = 1 and q.y = 0 group by p.t")
def flow(spark, sf):
    return p.pair_flow(panel(spark, sf), "score_b", "score")


@query("q_rank_corr", P + ", r as (select t, rank() over (partition by t order by score) + (count(*) over (partition by t, score) - 1) / 2.0 as a, rank() over (partition by t order by score_b) + (count(*) over (partition by t, score_b) - 1) / 2.0 as b from panel) select t, count(*) as n, round(case when n * saa - sa * sa > 0 and n * sbb - sb * sb > 0 then (n * sab - sa * sb) / sqrt((n * saa - sa * sa) * (n * sbb - sb * sb)) end, 9) as rho from (select t, count(*) as n, sum(a) as sa, sum(b) as sb, sum(a * a) as saa, sum(b * b) as sbb, sum(a * b) as sab from r group by t) group by t, n, saa, sa, sbb, sb, sab".replace("select t, count(*) as n, round", "select t, n, round").replace(" group by t, n, saa, sa, sbb, sb, sab", ""))
def rank_corr(spark, sf):
    r = p.midranks(p.midranks(panel(spark, sf), "score", "a").drop("n_step"), "score_b", "b")
    g = r.groupBy("t").agg(F.count("*").alias("n"), *[F.sum(e).alias(k) for k, e in (("sa", F.col("a")), ("sb", F.col("b")), ("saa", F.col("a") * F.col("a")), ("sbb", F.col("b") * F.col("b")), ("sab", F.col("a") * F.col("b")))])
    x, y = F.expr("n * saa - sa * sa"), F.expr("n * sbb - sb * sb")
    return rounded(g.select("t", "n", F.when((x > 0) & (y > 0), F.expr("n * sab - sa * sb") / F.sqrt(x * y)).alias("rho")), 9)


@query("q_within_t_rank", P + " select series_id, t, round(case when n > 1 then (r - 1) / (n - 1) else 0.5 end, 9) as pct, round(r / (n + 1), 9) as pct_open from (select *, rank() over (partition by t order by score) + (count(*) over (partition by t, score) - 1) / 2.0 as r, count(*) over (partition by t) as n from panel)")
def within(spark, sf):
    r = p.midranks(panel(spark, sf))
    return rounded(r.select("series_id", "t", F.when(F.col("n_step") > 1, (F.col("midrank") - 1) / (F.col("n_step") - 1)).otherwise(0.5).alias("pct"), (F.col("midrank") / (F.col("n_step") + 1)).alias("pct_open")), 9)


DRAWS = 4


@query("q_bootstrap_weighted", P + f", dr as (select d, series_id, ((series_id * 31 + d * 17) % 3)::bigint as k from (select unnest(range({DRAWS})) as d), (select distinct series_id from panel)), pr as (select a.d, p.t, sum(a.k * b.k) as pairs, sum(a.k * b.k * case when p.score > q.score then 2 when p.score = q.score then 1 else 0 end) as num2 from panel p join panel q on p.t = q.t and p.y = 1 and q.y = 0 join dr a on a.series_id = p.series_id join dr b on b.series_id = q.series_id and b.d = a.d group by a.d, p.t having sum(a.k * b.k) > 0) select d::bigint as draw, round(sum(num2) / (2.0 * sum(pairs)), 9) as auc, sum(pairs)::bigint as pairs, count(*) as steps from pr group by d")
def bootstrap(spark, sf):
    rows = panel(spark, sf)
    draws = rows.select("series_id").distinct().select(F.explode(F.array(*[F.lit(d).cast("long") for d in range(DRAWS)])).alias("draw"), "series_id").withColumn("k", (F.col("series_id") * 31 + F.col("draw") * 17) % 3)
    return rounded(p.weighted_bootstrap(rows, draws), 9)


META = ", meta as (select series_id, any_value(tau) as tau, any_value(tau) >= 0 as has_break, count(*) as n_online from panel group by series_id), sm as (select *, (case when has_break then 1 else 0 end)::varchar || '-' || (case when has_break then ntile(4) over (partition by has_break order by tau, series_id) else 0 end)::varchar || '-' || (ntile(3) over (partition by has_break order by n_online, series_id))::varchar as stratum from meta), fo as (select *, row_number() over (partition by stratum order by (series_id * 7919 + 13) % 10007, series_id) - 1 as k from sm), folds as (select series_id, stratum, (case when k % 10 = 9 then -1 else k % 5 end)::bigint as fold from fo)"


def _folds(spark, sf):
    m = panel(spark, sf).groupBy("series_id").agg(F.any_value("tau").alias("tau"), F.count("*").alias("n_online")).withColumn("has_break", F.col("tau") >= 0)
    return c.stratified_folds(m)


@query("q_folds", P + META + " select * from folds")
def folds(spark, sf):
    return _folds(spark, sf).select("series_id", "stratum", "fold")


@query("q_derange", P + META + " select series_id, fold, coalesce(lead(series_id) over w, first_value(series_id) over (partition by fold order by (series_id * 7919 + 13) % 10007, series_id)) as other from folds window w as (partition by fold order by (series_id * 7919 + 13) % 10007, series_id)")
def derange(spark, sf):
    return c.derange(_folds(spark, sf).select("series_id", "fold"), "fold", "series_id", "series_id", "other")


AT = c.anchors(40, 6)


def _cal_sql(rows: str = "panel", score: str = "score", tag: str = "") -> str:
    import math

    logs = [math.log1p(a) for a in AT]
    half = (logs[-1] - logs[0]) / (len(AT) - 1)
    win = " union all ".join(f"select {a}::bigint as a, {score} as s from {rows} where t between {round(math.expm1(x - half), 9)} and {round(math.expm1(x + half), 9)}" for a, x in zip(AT, logs, strict=True))
    return f", w{tag} as ({win}), o{tag} as (select a, s, row_number() over (partition by a order by s) - 1 as r, count(*) over (partition by a) as m from w{tag}), gr{tag} as (select o.a, k::bigint as k, o.s as q from o{tag} o, (select unnest(range(16)) as k) where o.r = floor(k * (o.m - 1) / 15.0))"


def _grid(spark, sf, score="score"):
    return c.fit_time_cdf(panel(spark, sf), AT, 16, 1, score)


@query("q_calib_fit", P + _cal_sql() + " select a, k, q from gr")
def calib_fit(spark, sf):
    return _grid(spark, sf)


def _apply_sql(tag: str, score: str) -> str:
    alist = ", ".join(map(str, AT))
    return f", ap{tag} as (select series_id, t, y, {score} as s, least(t, {AT[-1]}) as tt, list_max(list_filter([{alist}], lambda q: q <= least(t, {AT[-1]}))) as la, list_min(list_filter([{alist}], lambda q: q >= least(t, {AT[-1]}))) as ha from panel), cal{tag} as (select p.series_id, p.t, p.y, ra + case when la = ha then 0.0 else (ln(tt + 1.0) - ln(la + 1.0)) / (ln(ha + 1.0) - ln(la + 1.0)) end * (rb - ra) as cal from (select p.*, (select count(*) from gr{tag} g where g.a = p.la and g.q < p.s) / 16.0 as ra, (select count(*) from gr{tag} g where g.a = p.ha and g.q < p.s) / 16.0 as rb from ap{tag} p) p)"


@query("q_calib_apply", P + _cal_sql() + _apply_sql("", "score") + " select series_id, t, round(cal, 9) as cal from cal")
def calib_apply(spark, sf):
    return rounded(c.apply_time_cdf(panel(spark, sf), _grid(spark, sf)).select("series_id", "t", "cal"), 9)


CDF = ", cd as (select series_id, t, y, " + ", ".join(f"(rank() over (order by {s}) - 1)::double / count(*) over () as {m}" for s, m in (("score", "a"), ("score_b", "b"), ("score_c", "c"))) + " from panel)"


def _cdf(spark, sf):
    rows = plain = panel(spark, sf)
    for s, m in (("score", "a"), ("score_b", "b"), ("score_c", "c")):
        rows = c.rank_cdf(rows, s, m, counted=plain)
    return rows


@query("q_blend_mean", P + CDF + " select series_id, t, round(greatest(0.0, least(1.0, (a + b + c) / 3.0)), 9) as blend from cd")
def blend_mean(spark, sf):
    return rounded(_cdf(spark, sf).select("series_id", "t", c.blend_mean(["a", "b", "c"]).alias("blend")), 9)


def _lg(x: str) -> str:
    q = f"greatest(1e-6, least(1 - 1e-6, {x}))"
    return f"ln({q} / (1 - {q}))"


@query("q_blend_logit", P + CDF + f" select series_id, t, round(1 / (1 + exp(-(({_lg('a')} + {_lg('b')} + {_lg('c')}) / 3.0))), 9) as blend from cd")
def blend_logit(spark, sf):
    return rounded(_cdf(spark, sf).select("series_id", "t", c.blend_logit(["a", "b", "c"]).alias("blend")), 9)


@query("q_blend_scdf", P + _cal_sql() + _apply_sql("", "score") + _cal_sql(score="score_b", tag="b").replace(", o.s as q from ob o", ", o.s as q from ob o") + _apply_sql("b", "score_b") + " select a.series_id, a.t, round((a.cal + b.cal) / 2.0, 9) as blend from cal a join calb b using (series_id, t)")
def blend_scdf(spark, sf):
    rows = panel(spark, sf)
    one = c.apply_time_cdf(rows, _grid(spark, sf), "score", "a")
    two = c.apply_time_cdf(one, _grid(spark, sf, "score_b"), "score_b", "b")
    return rounded(two.select("series_id", "t", c.blend_mean(["a", "b"]).alias("blend")), 9)


@query("q_crossfit_blend", P + f", f as (select *, {FOLD} as fold from panel) select p.series_id, p.t, round(((select count(*) from f q where q.fold <> p.fold and q.score < p.score)::double / (select count(*) from f q where q.fold <> p.fold) + (select count(*) from f q where q.fold <> p.fold and q.score_b < p.score_b)::double / (select count(*) from f q where q.fold <> p.fold)) / 2.0, 9) as blend from f p")
def crossfit(spark, sf):
    """The rank map for a fold comes from the other folds: ranks over all rows less those over the fold itself."""
    rows = plain = panel(spark, sf).withColumn("fold", c.fold_of(F.col("series_id")))
    n = Window.partitionBy(F.lit(0))
    sizes = rows.groupBy("fold").agg(F.count("*").alias("inside")).withColumn("outside", F.sum("inside").over(n) - F.col("inside"))
    for s, m in (("score", "a"), ("score_b", "b")):
        rows = c.rank_cdf(c.rank_cdf(rows, s, f"{m}_all", counted=plain), s, f"{m}_own", ("fold",), counted=plain)
    j = rows.join(F.broadcast(sizes), "fold")  # a row for each of five folds
    all_n = F.col("inside") + F.col("outside")
    part = lambda m: (F.round(F.col(f"{m}_all") * all_n) - F.round(F.col(f"{m}_own") * F.col("inside"))) / F.col("outside")
    return rounded(j.select("series_id", "t", ((part("a") + part("b")) / 2.0).alias("blend")), 9)


@query("q_negative_control", P + RANK.replace("order by score)", "order by t)").replace("partition by t, score)", "partition by t)") + " select round(coalesce(sum(num2) / (2.0 * sum(n_pos * n_neg)), 0.5), 9) as auc, coalesce(sum(n_pos * n_neg), 0)::bigint as pairs, count(*) as steps from st")
def control(spark, sf):
    """A score of elapsed time alone ranks nothing within a step: exactly one half."""
    return rounded(p.pooled(p.per_step(panel(spark, sf).withColumn("score", F.col("t")))), 9)


@query("q_residualise", unsigned(P + ", g as (select t, count(*) as n, sum(score::double / 1e6) as sy, sum(score_b::double / 1e6) as sx, sum((score_b::double / 1e6) * (score_b::double / 1e6)) as xx, sum((score_b::double / 1e6) * (score::double / 1e6)) as xy from panel group by t), f as (select t, n, sy, sx, case when n * xx - sx * sx > 0 then (n * xy - sx * sy) / (n * xx - sx * sx) else 0.0 end as b from g) select p.series_id, p.t, round(p.score::double / 1e6 - (f.sy - f.b * f.sx) / f.n - f.b * (p.score_b::double / 1e6), 5) as residual from panel p join f using (t)", "residual"))
def residualise(spark, sf):
    rows = panel(spark, sf).withColumn("s", F.col("score") / 1e6).withColumn("x", F.col("score_b") / 1e6)
    return rounded(c.residualise(rows, "s", "x").select("series_id", "t", "residual"), 5)


@query("q_standardise", P + ", q as (select quantile_cont(score_b::double, [0.25, 0.5, 0.75]) as q from panel) select series_id, t, round(greatest(-20.0, least(20.0, (score_b - q[2]) / greatest(q[3] - q[1], 1e-9))), 6) as x from panel, q")
def standardise(spark, sf):
    rows = panel(spark, sf).select("series_id", "t", F.col("score_b").cast("double").alias("x"))
    return rounded(c.standardise(rows, c.standardiser(rows, ["x"]), ["x"]).select("series_id", "t", "x"))


@query("q_persistence", P + " select series_id, t, max(score_b) over o as runmax, round(avg(case when score_b > 300000 then 1.0 else 0.0 end) over o, 9) as fraction_over from panel window o as (partition by series_id order by t)")
def persistence(spark, sf):
    return rounded(panel(spark, sf).select("series_id", "t", F.max("score_b").over(w.upto()).alias("runmax"), F.avg(F.when(F.col("score_b") > 300_000, 1.0).otherwise(0.0)).over(w.upto()).alias("fraction_over")), 9)
