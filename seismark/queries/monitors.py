"""Sequential detectors and windowed evidence."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import evidence as e
from ..operators import history as h
from ..operators import windows as w
from ..sources.series import SUPPLIER, USER, split
from ._base import obs, obs_sql, rounded, unsigned, z_online

QUERIES, ORACLE = {}, {}
S, U = "with " + obs_sql(SUPPLIER), "with " + obs_sql(USER)
D = S + ", dd as (select o.series_id, o.t::bigint as t, (m.n * o.cents - m.s)::bigint as d from onl o join (select series_id, count(*) as n, sum(cents)::bigint as s from hist group by series_id) m using (series_id)) "
O = "window o as (partition by series_id order by t)"  # noqa: E741


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return put


def dev(spark, sf, family=SUPPLIER):
    """(series_id, t, d): n x - sum of the history, in integer cents."""
    hist, online = split(obs(spark, sf, family), family.n_hist)
    m = hist.groupBy("series_id").agg(F.count("*").alias("n"), F.sum("cents").alias("s"))
    return online.join(m, "series_id").select("series_id", "t", (F.col("n") * F.col("cents") - F.col("s")).alias("d"))


K = 300 * 500_000
REFL = f", c as (select *, sum(d - {K}) over o as cu, sum(-d - {K}) over o as cd from dd {O}) "


@query("q_cusum_pair", D + REFL + f"select series_id, t, (cu - least(0, min(cu) over o))::bigint as up, (cd - least(0, min(cd) over o))::bigint as down from c {O}")
def cusum_pair(spark, sf):
    return w.cusum_pair(dev(spark, sf), F.col("d"), F.lit(K).cast("long")).select("series_id", "t", "up", "down")


@query("q_cusum_m12", D + REFL + "select series_id, t, (cu - least(0, coalesce(min(cu) over p, 0)))::bigint as up from c window p as (partition by series_id order by t rows between unbounded preceding and 1 preceding)")
def cusum_late(spark, sf):
    return w.reflected_late(dev(spark, sf), F.col("d") - K, "up").select("series_id", "t", "up")


@query("q_page_hinkley", unsigned(D + f", a as (select *, d - (sum(d) over o)::double / (t + 1) as e from dd {O}), c as (select *, sum(e - {K}.0) over o as cu, sum(-e - {K}.0) over o as cd from a {O}) select series_id, t, round((cu - least(0.0, min(cu) over o)) / 1e6, 3) as up, round((cd - least(0.0, min(cd) over o)) / 1e6, 3) as down from c {O}", "up", "down"))
def page_hinkley(spark, sf):
    d = w.page_hinkley(dev(spark, sf), "d", float(K))
    return rounded(d.select("series_id", "t", (F.col("up") / 1e6).alias("up"), (F.col("down") / 1e6).alias("down")), 3)


GLR = ", ".join(f"case when count(*) over (partition by series_id order by t rows {(1 << j) - 1} preceding) = {1 << j} then pow(sum(z) over (partition by series_id order by t rows {(1 << j) - 1} preceding), 2) / {2.0 * (1 << j)} end as g{j}" for j in range(8))
GS = ", ".join(f"g{j}" for j in range(8))


@query("q_glr_dyadic", S + f", g as (select series_id, t, {GLR} from zon), m as (select *, greatest({GS}) as best from g) select series_id, t, round(best, 5) as best, round(best + ln(({' + '.join(f'coalesce(exp(g{j} - best), 0.0)' for j in range(8))}) / ({' + '.join(f'(case when g{j} is not null then 1 else 0 end)' for j in range(8))})), 5) as mix from m")
def glr(spark, sf):
    return rounded(w.glr_dyadic(z_online(spark, sf), "z", 7).select("series_id", "t", "best", "mix"), 5)


@query("q_peak_shape", unsigned(D + f", c as (select *, sum(d - {K}) over o as cu from dd {O}), r as (select series_id, t, (cu - least(0, min(cu) over o))::bigint as x from c {O}), p as (select *, max(x) over o as peak from r {O}) select series_id, t, peak, (t - max(case when x = peak then t end) over o)::bigint as since_peak, round(avg(case when x >= 0.5 * peak then 1.0 else 0.0 end) over o, 6) as persistence, round((x - lag(x, 16) over o) / 16.0, 6) as slope16, round(case when peak > 0 then x::double / peak end, 6) as rel_peak from p {O}", "slope16", "rel_peak", "persistence"))
def peak_shape(spark, sf):
    r = w.reflected(dev(spark, sf), F.col("d") - K, "x").drop("d")
    return rounded(w.peak_shape(r, "x").drop("x"))


@query("q_rolling_max", D + f"select series_id, t, max(abs(d)) over (partition by series_id order by t rows 31 preceding) as m32, max(abs(d)) over (partition by series_id order by t rows 127 preceding) as m128, round(exp(t * {-math.log(2) / 64} + max(ln(abs(d) + 1.0) - t * {-math.log(2) / 64}) over (partition by series_id order by t)) / 1e6, 3) as decayed from dd")
def rolling_max(spark, sf):
    d = dev(spark, sf).withColumn("a", F.abs("d"))
    return rounded(d.select("series_id", "t", F.max("a").over(w.trailing(32)).alias("m32"), F.max("a").over(w.trailing(128)).alias("m128"), (w.decayed_peak(F.col("a") + 1.0) / 1e6).alias("decayed")), 3)


@query("q_focus_brute", U + ", c as (select series_id, t + 1 as n, (sum(cents) over (partition by series_id order by t))::double as c from onl), s as (select series_id, n as m, c as b from c union all select distinct series_id, 0, 0.0 from c) select c.series_id, (n - 1)::bigint as t, round(max((c - b) * (c - b) / (2.0 * (n - m))), 3) as focus from c join s on s.series_id = c.series_id and m < n group by c.series_id, n")
def focus(spark, sf):
    _, online = split(obs(spark, sf, USER), 40)
    return rounded(e.focus_exact(online), 3)


BINS, WIN = 8, 32
OCC = f", ed as (select series_id, quantile_disc(cents, [{', '.join(str(k / BINS) for k in range(1, BINS))}]) as e from hist group by series_id), bn as (select o.series_id, o.t, list_sum(list_transform(e, lambda q: case when o.cents > q then 1 else 0 end)) as bin from onl o join ed using (series_id)), oc as (select series_id, t, count(*) over w as n, " + ", ".join(f"sum(case when bin = {k} then 1 else 0 end) over w as b{k}" for k in range(BINS)) + f" from bn window w as (partition by series_id order by t rows {WIN - 1} preceding)), pp as (select *, " + ", ".join(f"b{k}::double / n as p{k}" for k in range(BINS)) + " from oc), ff as (select *, " + ", ".join(f"{' + '.join(f'p{j}' for j in range(k + 1))} - {(k + 1) / BINS} as c{k}" for k in range(BINS)) + " from pp) "
_sum = lambda f: " + ".join(f(k) for k in range(BINS))
u_ = 1 / BINS
CVM = f"({_sum(lambda k: f'c{k} * c{k}')}) * n / {BINS}"
KS = f"greatest({', '.join(f'abs(c{k})' for k in range(BINS))})"


def _occ(spark, sf):
    hist, online = split(obs(spark, sf), 300)
    q = hist.groupBy("series_id").agg(F.array(*[F.expr(f"percentile_disc({k / BINS}) within group (order by cents)") for k in range(1, BINS)]).alias("edges"))
    return e.occupancy(online, q, BINS, WIN)


@query("q_occupancy_divergence", S + OCC + f"select series_id, t, round(({_sum(lambda k: f'(p{k} - {u_}) * (p{k} - {u_}) / {u_}')}) * n, 9) as chi2, round({KS} * sqrt(n::double), 9) as ks, round({CVM}, 9) as cvm, round(({_sum(lambda k: f'abs(c{k})')}) / {BINS}, 9) as w1, round({_sum(lambda k: f'0.5 * (case when p{k} > 0 then p{k} * ln(p{k} / ((p{k} + {u_}) / 2)) else 0.0 end) + 0.5 * {u_} * ln({u_} / ((p{k} + {u_}) / 2))')}, 9) as js, round(sqrt(greatest(1 - ({_sum(lambda k: f'sqrt(p{k} * {u_})')}), 0.0)), 7) as hellinger, round(0.5 * ({_sum(lambda k: f'abs(p{k} - {u_})')}), 9) as tv, round(-({_sum(lambda k: f'(case when p{k} > 0 then p{k} * ln(p{k}) else 0.0 end)')}) / {math.log(BINS)}, 9) as entropy, round(greatest({', '.join(f'abs(p{k} - {u_})' for k in range(BINS))}), 9) as maxdev from ff where t >= 8")
def occupancy(spark, sf):
    d = e.divergences(BINS)
    o = _occ(spark, sf).filter("t >= 8")
    return o.select("series_id", "t", *[F.round(c, 7 if k == "hellinger" else 9).alias(k) for k, c in d.items()])


@query("q_rd_distances", S + OCC + f"select series_id, t, round({KS} * sqrt(n::double) / sqrt(n::double), 9) as rd_ks, round(2 * {CVM} / n, 9) as rd_ene, round(0.5 * ({_sum(lambda k: f'abs(p{k} - {u_})')}), 9) as rd_tv, round(({_sum(lambda k: f'abs(c{k})')}) / {BINS}, 9) as rd_w1 from ff where t >= 8")
def rd(spark, sf):
    o = _occ(spark, sf).filter("t >= 8")
    return rounded(o.select("series_id", "t", *[c.alias(k) for k, c in e.relative_distances(BINS).items()]), 9)


@query("q_dep_lr", unsigned(S + f", l as (select *, lag(z) over (partition by series_id order by t) as y from zon), s as (select series_id, t, count(y) over w as m, sum(case when y is not null then z * z end) over w as xx, sum(y * y) over w as yy, sum(z * y) over w as xy from l window w as (partition by series_id order by t rows 31 preceding)) select series_id, t, round(case when m = 32 and yy > 0 then m * ln(xx / greatest(xx - xy * xy / yy, xx * 1e-9)) end, 5) as dep_lr from s", "dep_lr"))
def dep_lr(spark, sf):
    return rounded(e.dependence_lr(z_online(spark, sf), "z", 32).select("series_id", "t", "dep_lr"), 5)


@query("q_tail_rates", S + ", q as (select series_id, quantile_disc(cents, [0.05, 0.95]) as q from hist group by series_id) select o.series_id, o.t, round(avg(case when o.cents > q[2] then 1.0 else 0.0 end) over w, 6) as hi, round(avg(case when o.cents < q[1] then 1.0 else 0.0 end) over w, 6) as lo from onl o join q using (series_id) window w as (partition by o.series_id order by o.t rows 63 preceding)")
def tails(spark, sf):
    hist, online = split(obs(spark, sf), 300)
    q = hist.groupBy("series_id").agg(F.expr("percentile_disc(0.05) within group (order by cents)").alias("a"), F.expr("percentile_disc(0.95) within group (order by cents)").alias("b"))
    rate = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0)).over(w.trailing(64))
    return rounded(online.join(q, "series_id").select("series_id", "t", rate(F.col("cents") > F.col("b")).alias("hi"), rate(F.col("cents") < F.col("a")).alias("lo")))


@query("q_rank_cusum", S + ", u as (select o.series_id, o.t, (count(*) filter (where h.cents < o.cents) + count(*) filter (where h.cents <= o.cents) - 300)::bigint as r from onl o join hist h using (series_id) group by o.series_id, o.t), c as (select *, sum(r) over (partition by series_id order by t) as c from u) select series_id, t, (c - least(0, min(c) over (partition by series_id order by t)))::bigint as up from c")
def rank_cusum(spark, sf):
    hist, online = split(obs(spark, sf), 300)
    u = h.pit(online, hist).select("series_id", "t", F.round((F.col("u") * 301 - 0.5) * 2 - 300).cast("long").alias("r"))
    return w.reflected(u, F.col("r"), "up").select("series_id", "t", "up")


W64 = "window w as (partition by series_id order by t rows 63 preceding)"


@query("q_acf_window", unsigned(D + ", l as (select series_id, t, d::double as x, " + ", ".join(f"d::double * lag(d::double, {k}) over (partition by series_id order by t) as p{k}" for k in (1, 2, 5)) + " from dd) select series_id, t, " + ", ".join(f"round(case when count(*) over w = 64 and sum(x * x) over w > 0 then sum(p{k}) over w / sum(x * x) over w end, 5) as acf{k}" for k in (1, 2, 5)) + f" from l {W64}", "acf1", "acf2", "acf5"))
def acf(spark, sf):
    d = dev(spark, sf).select("series_id", "t", F.col("d").cast("double").alias("x"))
    return rounded(e.autocorrelation(d, "x", (1, 2, 5), 64).drop("x"), 5)


@query("q_variance_ratio", S + f", q as (select series_id, t, z, case when count(*) over o = 4 then sum(z) over o end as q from zon window o as (partition by series_id order by t rows 3 preceding)) select series_id, t, round(case when count(q) over w = 64 then sum(q * q) over w / (4.0 * sum(z * z) over w) end, 5) as vr from q {W64}")
def vr(spark, sf):
    return rounded(e.variance_ratio(z_online(spark, sf), "z", 4, 64).select("series_id", "t", "vr"), 5)


@query("q_drift", unsigned(D + f"select series_id, t, round(case when count(*) over w = 64 then ((sum(t * d) over w)::double - (t - 31.5) * (sum(d) over w)::double) / {64 * (64 * 64 - 1) / 12} end, 2) as slope from dd {W64}", "slope"))
def drift(spark, sf):
    return rounded(e.drift(dev(spark, sf), "d", 64).select("series_id", "t", "slope"), 2)


@query("q_mann_kendall", unsigned(D + f", s as (select series_id, t, sign(d - lag(d, 8) over (partition by series_id order by t))::double as s from dd) select series_id, t, round(case when count(s) over w = 64 then sum(s) over w / 64.0 end, 6) as mk from s {W64}", "mk"))
def mk(spark, sf):
    return rounded(e.mann_kendall(dev(spark, sf), "d", 8, 64).select("series_id", "t", "mk"))


FREQ = (1 / 64, 1 / 16, 1 / 4)


@query("q_dft_bands", S + " select series_id, t, " + ", ".join(f"round(case when count(*) over w = 64 then (pow(sum(z * cos({2 * math.pi * f} * t)) over w, 2) + pow(sum(z * sin({2 * math.pi * f} * t)) over w, 2)) / 64.0 end, 4) as pw{k}" for k, f in enumerate(FREQ)) + f" from zon {W64}")
def dft(spark, sf):
    return rounded(e.band_power(z_online(spark, sf), "z", 64, FREQ).select("series_id", "t", "pw0", "pw1", "pw2"), 4)


@query("q_haar", S + ", d as (select series_id, t, case when count(*) over b = 8 then pow(2 * sum(z) over a - sum(z) over b, 2) / 8.0 end as d from zon window a as (partition by series_id order by t rows 3 preceding), b as (partition by series_id order by t rows 7 preceding))" + f" select series_id, t, round(case when count(d) over w = 64 then sum(d) over w / 64.0 end, 5) as haar4 from d {W64}")
def haar(spark, sf):
    return rounded(e.haar(z_online(spark, sf), "z", 4, 64).select("series_id", "t", "haar4"), 5)


ORD = ", ab as (select series_id, t, cents as c, lag(cents, 2) over o as a, lag(cents, 1) over o as b from onl window o as (partition by series_id order by t)), oc as (select series_id, t, case when a is not null then (case when a > b then 4 else 0 end) + (case when a > c then 2 else 0 end) + (case when b > c then 1 else 0 end) end as o from ab)"


@query("q_ordinal_entropy", S + ORD + ", n as (select series_id, t, count(o) over w as m, " + ", ".join(f"sum(case when o = {c} then 1 else 0 end) over w as n{c}" for c in e.CODES) + f" from oc {W64}) select series_id, t, round(case when m = 64 then (" + " + ".join(f"(case when n{c} > 0 then -(n{c} / 64.0) * ln(n{c} / 64.0) else 0.0 end)" for c in e.CODES) + f") / {math.log(6)} end, 6) as entropy from n")
def ordinal(spark, sf):
    _, online = split(obs(spark, sf), 300)
    return rounded(e.ordinal_entropy(online.select("series_id", "t", "cents"), "cents", 64).select("series_id", "t", "entropy"))


@query("q_ordinal_transition_kl", unsigned(S + ORD + ", p as (select series_id, lag(o) over (partition by series_id order by t) as a, o as b from oc), g as (select s.series_id, x.a, y.b from (select distinct series_id from onl) s, (select unnest([0, 1, 3, 4, 6, 7]) as a) x, (select unnest([0, 1, 3, 4, 6, 7]) as b) y), n as (select g.series_id, g.a, g.b, count(p.a) + 0.5::double as n from g left join p on p.series_id = g.series_id and p.a = g.a and p.b = g.b group by g.series_id, g.a, g.b) select n.series_id, round(sum(n.n / s.s * ln(n.n / r.n)), 6) as kl from n join n r on r.series_id = n.series_id and r.a = n.b and r.b = n.a join (select series_id, sum(n) as s from n group by series_id) s on s.series_id = n.series_id group by n.series_id", "kl"))
def kl(spark, sf):
    _, online = split(obs(spark, sf), 300)
    return rounded(e.transition_kl(online.select("series_id", "t", "cents"), "cents"))


@query("q_third_moment_asym", unsigned(D + f", l as (select series_id, t, (d - lag(d) over (partition by series_id order by t))::double as x from dd) select series_id, t, round(case when count(x) over w = 64 and sum(x * x) over w > 0 then sum(x * x * x) over w / pow(sum(x * x) over w, 1.5) end, 5) as asym from l {W64}", "asym"))
def asym(spark, sf):
    return rounded(e.third_moment_asymmetry(dev(spark, sf), "d", 64).select("series_id", "t", "asym"), 5)


@query("q_hjorth", S + f", d as (select *, z - lag(z) over o as a, z - 2 * lag(z) over o + lag(z, 2) over o as b from zon {O}) select series_id, t, round(case when count(b) over w = 64 then sqrt(sum(a * a) over w / sum(z * z) over w) end, 5) as mobility, round(case when count(b) over w = 64 then sqrt(sum(b * b) over w / sum(a * a) over w) / sqrt(sum(a * a) over w / sum(z * z) over w) end, 5) as complexity from d {W64}")
def hjorth(spark, sf):
    o, over = w.by(), w.trailing(64)
    z = z_online(spark, sf).withColumn("a", F.col("z") - F.lag("z").over(o)).withColumn("b", F.col("z") - 2 * F.lag("z").over(o) + F.lag("z", 2).over(o))
    q = lambda c: F.sum(F.col(c) * F.col(c)).over(over)
    full = F.count("b").over(over) == 64
    mob = F.sqrt(q("a") / q("z"))
    return rounded(z.select("series_id", "t", F.when(full, mob).alias("mobility"), F.when(full, F.sqrt(q("b") / q("a")) / mob).alias("complexity")), 5)


@query("q_llr_monitor", unsigned(S + " select series_id, t, round(case when n >= 8 then q - ln(greatest(q - m * m, 1e-6)) - 1 end, 5) as llr from (select series_id, t, count(*) over w as n, sum(z) over w / count(*) over w as m, sum(z * z) over w / count(*) over w as q from zon window w as (partition by series_id order by t rows 31 preceding))", "llr"))
def llr(spark, sf):
    return rounded(e.llr_monitor(z_online(spark, sf), "z", 32).select("series_id", "t", "llr"), 5)


@query("q_exceedance_runs", D + f", f as (select *, d > 300 * 3000000 as f from dd), r as (select series_id, t, (case when f then t - coalesce(max(case when not f then t end) over o, -1) else 0 end)::bigint as run from f {O}) select series_id, t, run, max(run) over o as longest from r {O}")
def exceed(spark, sf):
    r = w.runs(dev(spark, sf), F.col("d") > 300 * 3_000_000)
    return r.select("series_id", "t", "run", F.max("run").over(w.upto()).alias("longest"))


@query("q_dwell_runs", D + f", f as (select *, abs(d) > 300 * 2500000 as f from dd), r as (select series_id, t, f, t - row_number() over (partition by series_id, f order by t) as g from f) select series_id, count(*) as episodes, max(n) as longest, sum(n)::bigint as total from (select series_id, g, count(*) as n from r where f group by series_id, g) group by series_id")
def dwell(spark, sf):
    r = w.runs(dev(spark, sf), F.abs("d") > 300 * 2_500_000)
    ends = r.withColumn("next", F.coalesce(F.lead("run").over(w.by()), F.lit(0))).filter("run > 0 and next = 0")
    return ends.groupBy("series_id").agg(F.count("*").alias("episodes"), F.max("run").alias("longest"), F.sum("run").alias("total"))


@query("q_trimmed_scale", D + ", a as (select series_id, t, list(abs(d)) over (partition by series_id order by t rows 31 preceding) as l from dd) select series_id, t, round(list_sum(l[1:len(l)])::double / len(l), 2) as full, round((list_sum(l) - list_sum(list_reverse_sort(l)[1:2]))::double / greatest(len(l) - 2, 1), 2) as trim, round(list_max(l)::double / nullif(list_sum(l), 0), 6) as conc from a")
def trimmed(spark, sf):
    over = w.trailing(32)
    a = dev(spark, sf).withColumn("a", F.abs("d")).withColumn("l", F.sort_array(F.collect_list("a").over(over), False)).withColumn("s", F.sum("a").over(over))
    n = F.size("l")
    two = F.aggregate(F.slice("l", 1, 2), F.lit(0).cast("long"), lambda acc, v: acc + v)
    return a.select("series_id", "t", F.round(F.col("s") / n, 2).alias("full"), F.round((F.col("s") - two) / F.greatest(n - 2, F.lit(1)), 2).alias("trim"), F.round(F.when(F.col("s") > 0, F.col("l")[0] / F.col("s")), 6).alias("conc"))


SCALES = (1, 2, 4, 8, 16, 32)
SURV = ", ".join(f"case when count(*) over (partition by series_id order by t rows {s - 1} preceding) = {s} then sum(q) over (partition by series_id order by t rows {s - 1} preceding) / {s}.0 end as m{s}" for s in SCALES)


@query("q_scale_survival", S + f", z2 as (select series_id, t, z * z as q from zon), m as (select series_id, t, {SURV} from z2) select series_id, t, " + ", ".join(f"({' + '.join(f'(case when m{s} > {lim} then 1 else 0 end)' for s in SCALES)})::bigint as survive{k}, greatest({', '.join(f'case when m{s} > {lim} then {s} else 0 end' for s in SCALES)})::bigint as largest{k}" for k, lim in enumerate((1.301, 2.0))) + " from m")
def survival(spark, sf):
    z = z_online(spark, sf).select("series_id", "t", (F.col("z") * F.col("z")).alias("q"))
    return e.scale_survival(z, "q", SCALES, (1.301, 2.0)).drop("q")


UU = S + ", u as (select o.series_id, o.t, (0.5 * (count(*) filter (where h.cents < o.cents) + count(*) filter (where h.cents <= o.cents)) + 0.5) / 301 as u from onl o join hist h using (series_id) group by o.series_id, o.t)"
BETS, EPS = (-1.5, -0.75, 0.75, 1.5), (0.3, 0.5, 0.7, 0.9)


def _logmean(n: int) -> str:
    return f"greatest({', '.join(f'l{k}' for k in range(n))}) + ln(({' + '.join(f'exp(l{k} - greatest(' + ', '.join(f'l{j}' for j in range(n)) + '))' for k in range(n))}) / {n}.0)"


def _u(spark, sf):
    hist, online = split(obs(spark, sf), 300)
    return h.pit(online, hist)


@query("q_eprocess_mix", unsigned(UU + ", l as (select series_id, t, " + ", ".join(f"sum(ln(1 + {b} * (u - 0.5))) over (partition by series_id order by t) as l{k}" for k, b in enumerate(BETS)) + f" from u) select series_id, t, round({_logmean(4)}, 5) as log_wealth from l", "log_wealth"))
def eprocess(spark, sf):
    return rounded(e.mixture_bet(_u(spark, sf), "u", BETS).select("series_id", "t", "log_wealth"), 5)


@query("q_power_martingale", unsigned(UU + ", l as (select series_id, t, " + ", ".join(f"sum({math.log(b)} + {b - 1} * ln(u)) over (partition by series_id order by t) as l{k}" for k, b in enumerate(EPS)) + f" from u) select series_id, t, round({_logmean(4)}, 5) as log_martingale from l", "log_martingale"))
def martingale(spark, sf):
    return rounded(e.power_martingale(_u(spark, sf), "u", EPS).select("series_id", "t", "log_martingale"), 5)
