"""Samples, resampling, attribution, training weights and segment statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as a
from ..operators import calibrate as c
from ..operators import history as h
from ..operators import panel as p
from ..operators import windows as w
from ..sources.series import SUPPLIER, split
from ._base import obs, obs_sql, panel, panel_sql, rounded, unsigned, z_online
from .panels import DRAWS, FOLD, META, _folds

QUERIES, ORACLE = {}, {}
P = "with " + panel_sql()
S = "with " + obs_sql(SUPPLIER)
O = "window o as (partition by series_id order by t)"  # noqa: E741


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return put


@query("q_screen_store", P + META + " select series_id, fold from (select *, row_number() over (partition by fold order by (series_id * 7919 + 13) % 10007, series_id) as k from folds) where k <= 500")
def screen_store(spark, sf):
    return a.screen(_folds(spark, sf).select("series_id", "fold"), "fold")


@query("q_uniform_sample", P + " select series_id, t, score from panel order by (series_id * 7919 + t * 104729 + 13) % 1000003, series_id, t limit 1000")
def uniform_sample(spark, sf):
    return a.uniform_sample(panel(spark, sf), 1000).select("series_id", "t", "score")


@query("q_roll_std", S + " select series_id, t, case when count(*) over w = 16 then round(sqrt((16 * sum(cents * cents) over w - (sum(cents) over w) * (sum(cents) over w))::double) / 16, 6) end as sd16 from onl window w as (partition by series_id order by t rows 15 preceding)")
def roll_std(spark, sf):
    return rounded(split(obs(spark, sf), 300)[1].select("series_id", "t", a.rolling_sd("cents", 16).alias("sd16")))


@query("q_excursion_bank", P + ", f as (select *, greatest(score_b - 100000, 0) as x, score_b > 100000 as hot from panel), g as (select *, t - coalesce(max(case when not hot then t end) over o, -1) as r0, sum(x) over o as m from f " + O + ") , k as (select *, case when hot then r0 else 0 end as run from g) select series_id, t, run::bigint as run, (m - coalesce(max(case when run = 0 then m end) over o, 0))::bigint as mass, (max(run) over o)::bigint as longest from k " + O)
def excursion_bank(spark, sf):
    return a.excursions(panel(spark, sf), F.col("score_b"), F.lit(100_000).cast("long")).select("series_id", "t", "run", "mass", "longest")


@query("q_hysteresis", P + ", e as (select *, case when score_b > 200000 then 1 when score_b < 50000 then 0 end as ev from panel), g as (select *, max(case when ev is not null then t end) over o as last, t - coalesce(max(case when score_b <= 200000 then t end) over o, -1) as r0 from e " + O + ") select g.series_id, g.t, coalesce(e.ev, 0)::bigint as latch, round(least(1.0, (case when g.score_b > 200000 then r0 else 0 end) / 8.0), 9) as credit from g left join e on e.series_id = g.series_id and e.t = g.last")
def hysteresis(spark, sf):
    return rounded(a.latched(panel(spark, sf), "score_b", 200_000, 50_000).select("series_id", "t", "latch", "credit"), 9)


_PAIRS = "sum(a.k * b.k * case when p.{0} > q.{0} then 2 when p.{0} = q.{0} then 1 else 0 end)"


@query("q_bootstrap_paired", P + f", dr as (select d, series_id, ((series_id * 31 + d * 17) % 3)::bigint as k from (select unnest(range({DRAWS})) as d), (select distinct series_id from panel)), pr as (select a.d, sum(a.k * b.k) as pairs, {_PAIRS.format('score')} as na, {_PAIRS.format('score_b')} as nb from panel p join panel q on p.t = q.t and p.y = 1 and q.y = 0 join dr a on a.series_id = p.series_id join dr b on b.series_id = q.series_id and b.d = a.d group by a.d) select d::bigint as draw, round(na / (2.0 * pairs), 9) as auc_a, round(nb / (2.0 * pairs), 9) as auc_b, round(na / (2.0 * pairs) - nb / (2.0 * pairs), 9) + 0.0 as gain from pr")
def bootstrap_paired(spark, sf):
    rows = panel(spark, sf)
    draws = rows.select("series_id").distinct().select(F.explode(F.array(*[F.lit(d).cast("long") for d in range(DRAWS)])).alias("draw"), "series_id").withColumn("k", (F.col("series_id") * 31 + F.col("draw") * 17) % 3)
    return rounded(a.paired_bootstrap(rows, draws, "score", "score_b"), 9)


def _share(by: str) -> str:
    return f"(sum(case when y = 0 then 1 else 0 end) over (partition by {by} order by score) - sum(case when y = 0 then 1 else 0 end) over (partition by {by}, score))::double / sum(case when y = 0 then 1 else 0 end) over (partition by {by})"


@query("q_state_calibration", P + f", st as (select *, (case when t < 5 then 0 when t < 20 then 1 else 2 end)::int as band, (case when t < 5 then 0 when t < 20 then 1 else 2 end * 3 + case when score_c < 100000 then 0 when score_c < 400000 then 1 else 2 end)::int as state from panel), f as (select *, {_share('state')} as fl, {_share('band')} as fp, {_share('1')} as fa, sum(case when y = 0 then 1 else 0 end) over (partition by state) as nl, sum(case when y = 0 then 1 else 0 end) over (partition by band) as np from st) select series_id, t, round(case when nl >= 200 then fl when np >= 200 then fp else fa end, 9) as cal from f")
def state_calibration(spark, sf):
    rows = panel(spark, sf)
    band = F.when(F.col("t") < 5, 0).when(F.col("t") < 20, 1).otherwise(2)
    level = F.when(F.col("score_c") < 100_000, 0).when(F.col("score_c") < 400_000, 1).otherwise(2)
    return rounded(a.state_calibration(rows.withColumn("band", band).withColumn("state", band * 3 + level), "state", "band", 200).select("series_id", "t", "cal"), 9)


@query("q_series_auc", P + ", pr as (select p.series_id, count(*) as pairs, sum(case when p.score > q.score then 2 when p.score = q.score then 1 else 0 end) as n2 from panel p join panel q on p.series_id = q.series_id and p.y = 1 and q.y = 0 group by p.series_id) select series_id, round(n2 / (2.0 * pairs), 9) as auc, pairs::bigint as pairs from pr")
def series_auc(spark, sf):
    """How well the score tells the rows after a series' own break from those before it."""
    return rounded(p.per_step(panel(spark, sf), "series_id").select("series_id", "auc", F.col("w").alias("pairs")), 9)


@query("q_boundary_oracle", P + ", l as (select series_id, arg_max(score, t) as score, arg_max(y, t) as y from panel group by series_id) select round(coalesce(sum(case when a.score > b.score then 2 when a.score = b.score then 1 else 0 end) / (2.0 * count(*)), 0.5), 9) as auc, count(*) as pairs from l a join l b on a.y = 1 and b.y = 0")
def boundary_oracle(spark, sf):
    """The last row of each series alone: series with a break against those without."""
    last = panel(spark, sf).groupBy("series_id").agg(F.max_by("score", "t").alias("score"), F.max_by("y", "t").alias("y"))
    return rounded(p.pooled(p.per_step(last.withColumn("t", F.lit(0)))).select("auc", "pairs"), 9)


@query("q_failure_map", P + ", s as (select series_id, avg(score_b)::double as x, avg(case when (y = 1) = (score_b > 150000) then 0.0 else 1.0 end) as loss from panel group by series_id), b as (select *, ntile(5) over (order by x, series_id) as bin from s), g as (select bin, count(*) as n, avg(loss) as m, sum(loss) as s1, sum(loss * loss) as s2 from b group by bin), z as (select sum(s1 * s1 / n) - sum(s1) * sum(s1) / sum(n) as between_, sum(s2) - sum(s1) * sum(s1) / sum(n) as all_ from g) select bin::int as bin, n, round(m, 6) as loss, round(between_ / all_, 6) as eta2 from g, z")
def failure_map(spark, sf):
    wrong = F.when((F.col("y") == 1) == (F.col("score_b") > 150_000), 0.0).otherwise(1.0)
    s = panel(spark, sf).groupBy("series_id").agg(F.avg("score_b").alias("x"), F.avg(wrong).alias("loss"))
    return rounded(a.failure_map(s, "x", "loss"))


@query("q_localisation", P + ", g as (select *, abs(coalesce(max(case when score = 0 then t end) over o, -1) + 1 - tau) as gap from panel " + O + ") select (case when t - tau < 5 then 0 when t - tau < 15 then 5 else 15 end)::bigint as age_from, count(*) as rows, round(avg(gap), 6) as mean_gap, round(avg(case when 5 * gap <= t - tau + 1 then 1.0 else 0.0 end), 6) as within_fifth, round(avg(case when 2 * gap <= t - tau + 1 then 1.0 else 0.0 end), 6) as within_half from g where y = 1 group by 1")
def localisation(spark, sf):
    return rounded(a.localisation(panel(spark, sf), "score"))


@query("q_residualise_crossfit", unsigned(P + f", r as (select *, {FOLD} as fold, score::double / 1e6 as s, score_b::double / 1e6 as x from panel), g as (select t, fold, count(*)::double as n, sum(s) as sy, sum(x) as sx, sum(x * x) as xx, sum(x * s) as xy from r group by t, fold), o as (select g.t, g.fold, sum(h.n) as n, sum(h.sy) as sy, sum(h.sx) as sx, sum(h.xx) as xx, sum(h.xy) as xy from g join g h on g.t = h.t and g.fold <> h.fold group by g.t, g.fold), f as (select *, case when n * xx - sx * sx > 1e-9 then (n * xy - sx * sy) / (n * xx - sx * sx) else 0.0 end as b from o) select r.series_id, r.t, round(r.s - coalesce((f.sy - f.b * f.sx) / f.n, 0.0) - coalesce(f.b, 0.0) * r.x, 5) as residual from r left join f on r.t = f.t and r.fold = f.fold", "residual"))
def residualise_crossfit(spark, sf):
    rows = panel(spark, sf).withColumn("fold", c.fold_of(F.col("series_id"))).withColumn("s", F.col("score") / 1e6).withColumn("x", F.col("score_b") / 1e6)
    return rounded(a.residualise_crossfit(rows, "s", "x").select("series_id", "t", "residual"), 5)


@query("q_derange_within_t", P + " select series_id, t, coalesce(lead(score) over w, first_value(score) over w) as other from panel window w as (partition by t order by (series_id * 7919 + 13) % 10007, series_id)")
def derange_within_t(spark, sf):
    return c.derange(panel(spark, sf).select("series_id", "t", "score"), "t", "series_id", "score", "other").select("series_id", "t", "other")


@query("q_hard_negatives", P + ", n as (select *, rank() over (partition by t order by score) + (count(*) over (partition by t, score) - 1) / 2.0 as r, count(*) over (partition by t) as m from panel where y = 0), s as (select *, case when m > 1 then (r - 1) / (m - 1) else 0.5 end as p from n) select series_id, t, round(1 + 2 * p * p, 9) as weight, (case when p >= 0.9 then 1 else 0 end)::bigint as again from s")
def hard_negatives(spark, sf):
    return rounded(a.hard_negatives(panel(spark, sf)).select("series_id", "t", "weight", "again"), 9)


@query("q_targets", P + " select series_id, t, round(case when y = 1 then least(1.0, (t - tau + 1) / 10.0) else 0.0 end, 9) as ramp, round(case when y = 1 then ln(t - tau + 2.0) / ln(41.0) else 0.0 end, 9) as log_time, (case when y = 1 and t = tau then 1 else 0 end)::bigint as hazard, round(case when y = 1 then exp(-(t - tau) / 8.0) else 1.0 end, 9) as near from panel")
def targets(spark, sf):
    return rounded(a.targets(panel(spark, sf)).select("series_id", "t", "ramp", "log_time", "hazard", "near"), 9)


def _mid(s: str) -> str:
    return f"(2 * rank() over (partition by t order by {s}) + count(*) over (partition by t, {s}) - 1)"


@query("q_mixture_grid", P + f", r as (select t, y, {_mid('score')} as ra, {_mid('score_b')} as rb from panel), m as (select l as lam, t, y, l * ra + (4 - l) * rb as s from r, (select unnest(range(5)) as l)), pr as (select p.lam, count(*) as pairs, sum(case when p.s > q.s then 2 when p.s = q.s then 1 else 0 end) as n2 from m p join m q on p.lam = q.lam and p.t = q.t and p.y = 1 and q.y = 0 group by p.lam) select lam::bigint as lam, round(n2 / (2.0 * pairs), 9) as auc, pairs::bigint as pairs from pr")
def mixture_grid(spark, sf):
    """The score of each blend of two members' ranks."""
    return rounded(p.pooled(p.per_step(a.mixture(panel(spark, sf), "score", "score_b"), "lam", "t"), "lam").select("lam", "auc", "pairs"), 9)


_SEG = "select *, (i >= 300)::int as online, x - avg(x) over s as d, row_number() over (partition by series_id, i >= 300 order by i) - (count(*) over s + 1) / 2.0 as k from obs window s as (partition by series_id, i >= 300)"


@query("q_segment_stats", unsigned(S + f", d as ({_SEG}), e as (select *, lag(d) over (partition by series_id, online order by i) as l from d), g as (select series_id, online, count(*) as n, avg(x) as mean, avg(d * d) as m2, avg(d * d * d) as m3, avg(d * d * d * d) as m4, sum(d * l) as c1, sum(d * k) as c, sum(k * k) as ii from e group by series_id, online) select series_id, online, n, round(mean, 4) as mean, round(sqrt(m2), 4) as sd, round(m3 / power(m2, 1.5), 4) as skew, round(m4 / (m2 * m2), 4) as kurt, round(c1 / (n * m2), 4) as acf1, round(c / ii, 4) as slope from g", "skew", "acf1", "slope"))
def segment_stats(spark, sf):
    rows = obs(spark, sf).withColumn("online", (F.col("i") >= 300).cast("int"))
    return rounded(a.segment_statistics(rows, ["series_id", "online"]), 4)


@query("q_transients", S + ", f as (select series_id, t, abs(z) > 1.2 as hot from zon), g as (select *, case when hot then t - coalesce(max(case when not hot then t end) over o, -1) else 0 end as run from f " + O + "), e as (select *, coalesce(lead(run) over o, 0) as nxt from g " + O + ") select series_id, t, (case when run = 1 and nxt = 0 then 1 else 0 end)::bigint as isolated, (case when run > 1 and nxt = 0 then run else 0 end)::bigint as burst from e")
def transients(spark, sf):
    return a.transients(z_online(spark, sf), "z", 1.2).select("series_id", "t", "isolated", "burst")


@query("q_ecdf_knots", S + ", q as (select series_id, quantile_cont(cents::double, [" + ", ".join(repr((k + 0.5) / 256) for k in range(256)) + "]) as q from hist group by series_id) select series_id, (k - 1)::int as k, round(q[k], 4) as q from q, (select unnest(range(1, 257)) as k)")
def ecdf_knots(spark, sf):
    return rounded(a.ecdf_knots(split(obs(spark, sf), 300)[0], x="cents"), 4)


@query("q_longest_run_law", S + ", f as (select series_id, t, abs(z) > 1.5 as hot from zon), g as (select *, case when hot then t - coalesce(max(case when not hot then t end) over o, -1) else 0 end as run from f " + O + "), l as (select series_id, t, max(run) over o as longest from g " + O + ") select series_id, t, longest::bigint as longest, round(longest * ln(10.0) / ln(greatest(t + 1, 2)), 6) as ratio from l")
def longest_run_law(spark, sf):
    rows = z_online(spark, sf).withColumn("size", F.abs("z")).withColumn("cut", F.lit(1.5))
    return rounded(a.longest_run_law(rows, "size", "cut").select("series_id", "t", "longest", "ratio"))


@query("q_pooled_ar", S + ", z as (select h.series_id, h.i, (h.x - p.mu) / p.sd as z from hist h join par p using (series_id)), l as (select *, lag(z) over (partition by series_id order by i) as a, lag(z, 2) over (partition by series_id order by i) as b from z), g as (select series_id, sum(z * z) / count(*) as r0, sum(z * a) / count(*) as r1, sum(z * b) / count(*) as r2 from l group by series_id), s as (select sum(r0) as r0, sum(r1) as r1, sum(r2) as r2 from g) select round((r1 * r0 - r1 * r2) / (r0 * r0 - r1 * r1), 8) + 0.0 as phi1, round((r0 * r2 - r1 * r1) / (r0 * r0 - r1 * r1), 8) + 0.0 as phi2 from s")
def pooled_ar(spark, sf):
    hist, _ = split(obs(spark, sf), 300)
    return rounded(a.pooled_ar2(h.standardise(hist, h.moments(hist))), 8)
