"""Feature modules, kernels, learning and streaming queries: not stated in SQL, so tested by parity, prefix invariance and brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..functions import modules as m
from ..operators import calibrate as c
from ..operators import detectors as det
from ..operators import history as h
from ..operators import panel as p
from ..operators import scan
from ..plans import learn
from ..sources.scratch import materialize, shared_dir
from ..sources.series import SUPPLIER, USER, split
from ..streaming import features, scores
from ._base import obs, obs_sql, panel, rounded, z_online

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return put


def _module(name: str):
    return lambda spark, sf: m.features(obs(spark, sf, SUPPLIER, spread=True), SUPPLIER.n_hist, [name], spread=False)


for _name in m.REGISTRY:
    QUERIES[f"q_feat_{_name}"] = _module(_name)


@query("q_feat_all")
def feat_all(spark, sf):
    """All modules in one grouped pass; a supplier's series is bounded, so that a group fits a task."""
    return m.features(obs(spark, sf, SUPPLIER, spread=True), SUPPLIER.n_hist, list(m.REGISTRY), spread=False)


def _kernel(spark, sf, fn, cols: list[str]):
    """fn(z history, z online) -> columns, for every series."""
    kind = dict(obs(spark, sf, SUPPLIER).dtypes)["series_id"]
    schema = f"series_id {kind}, t long, " + ", ".join(f"{n} double" for n in cols)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["x"].to_numpy(float)
        hist, online = x[: SUPPLIER.n_hist], x[SUPPLIER.n_hist :]
        if len(hist) < SUPPLIER.n_hist:
            return pd.DataFrame(columns=["series_id", "t", *cols])
        mu, sd = hist.mean(), max(hist.std(ddof=1), 1e-9)
        out = pd.DataFrame(fn((hist - mu) / sd, (online - mu) / sd), columns=cols)
        out.insert(0, "t", np.arange(len(online)))
        out.insert(0, "series_id", pdf["series_id"].iloc[0])
        return out

    return rounded(det.in_groups(obs(spark, sf, SUPPLIER), run, schema))


#: z of the online rows, as a table that recursions over t read.
Z = "with recursive " + obs_sql(SUPPLIER) + ", z as materialized (select series_id, t, z from zon)"


def _recursion(cols: dict[str, tuple[str, str]], z: str = "z") -> str:
    """, r as (...): column -> (its first value, its next from ``r`` and ``o``, the row)."""
    first = ", ".join(f"({a})::double as {c}" for c, (a, _) in cols.items())
    after = ", ".join(f"({b})::double as {c}" for c, (_, b) in cols.items())
    return f", r as (select o.series_id, o.t, {first} from {z} o where o.t = 0 union all select o.series_id, o.t, {after} from r join {z} o on o.series_id = r.series_id and o.t = r.t + 1)"


def _given(cols: list[str]) -> str:
    return " select series_id, t, " + ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in cols) + " from r"


def _z(spark, sf):
    return z_online(spark, sf, SUPPLIER).select("series_id", "t", "z")


def _share(spark, sf):
    """A score in [0, 1) from z."""
    return _z(spark, sf).select("series_id", "t", (F.abs("z") / (1 + F.abs("z"))).alias("p"))


def _scanned(df):
    return rounded(df.drop("z"))


SR_SQL = Z + _recursion({"sr_up": ("0.5 * o.z - 0.125", "0.5 * o.z - 0.125 + ln(1 + exp(r.sr_up))"), "sr_down": ("-0.5 * o.z - 0.125", "-0.5 * o.z - 0.125 + ln(1 + exp(r.sr_down))")}) + _given(["sr_up", "sr_down"])


@query("q_shiryaev_roberts", SR_SQL)
def sr(spark, sf):
    z = _z(spark, sf)
    return _scanned(scan.shiryaev_roberts(z, {"sr_up": 0.5 * F.col("z") - 0.125, "sr_down": -0.5 * F.col("z") - 0.125}))


def _alpha(h: int) -> float:
    return 1 - 2 ** (-1 / h)


EWMA_SQL = Z + _recursion({f"y{h}": (f"{_alpha(h)!r} * o.z", f"r.y{h} + {_alpha(h)!r} * (o.z - r.y{h})") for h in (8, 32, 128)}) + " select series_id, t, " + ", ".join(f"round(y{h} / (1 - power({1 - _alpha(h)!r}, t + 1)), 6) + 0.0 as ew{h}" for h in (8, 32, 128)) + " from r"


@query("q_ewma_bank", EWMA_SQL)
def ewma(spark, sf):
    return _scanned(scan.ewma(_z(spark, sf), "z", (8, 32, 128)))


@query("q_decay_max", Z + _recursion({"peak": ("o.z", "greatest(o.z, 0.98 * r.peak)")}) + _given(["peak"]))
def decay_max(spark, sf):
    return _scanned(scan.decayed_max(_z(spark, sf), "z", 0.98, "peak"))


@query("q_ar_robust")
def ar_robust(spark, sf):
    """Ridge, reweighted and Yule-Walker coefficients of each history, the same at every online row's first place."""
    def run(a, z):
        rows = [("ridge", k.ar_fit(a, 3, 0.05)), ("huber", k.ar_huber(a, 2)), ("yw", k.ar_yule_walker(k.autocovariances(a, 5)))]
        return {f"{n}{i + 1}": np.full(len(z), v) for n, phi in rows for i, v in enumerate(phi)}

    return _kernel(spark, sf, run, [f"{n}{i}" for n, p_ in (("ridge", 3), ("huber", 2), ("yw", 5)) for i in range(1, p_ + 1)]).filter("t = 0").drop("t")


GARCH_SQL = (
    "with recursive " + obs_sql(SUPPLIER) + f""", sq as materialized (select o.series_id, o.i, ((o.x - p.mu) / p.sd) * ((o.x - p.mu) / p.sd) as q from obs o join par p using (series_id)),
nodes as (select a, b, row_number() over (order by a, b) as k from (select unnest({list(k.GARCH_A)}) as a) x, (select unnest({list(k.GARCH_B)}) as b) y where a + b <= {k.GARCH_MOST}),
v as (select s.series_id, s.i, a, b, n.k, 1.0::double as v, s.q from sq s, nodes n where s.i = 0 union all select s.series_id, s.i, v.a, v.b, v.k, (1 - v.a - v.b) + v.a * v.q + v.b * v.v, s.q from v join sq s on s.series_id = v.series_id and s.i = v.i + 1),
loss as (select series_id, k, sum(ln(greatest(v, 1e-9)) + q / greatest(v, 1e-9)) as l from v where i >= {k.burn_in(SUPPLIER.n_hist)} and i < {SUPPLIER.n_hist} group by series_id, k),
best as (select series_id, arg_min(k, l) as k from loss group by series_id)
select v.series_id, v.i - {SUPPLIER.n_hist} as t, round(v.v, 6) + 0.0 as variance from v join best b on b.series_id = v.series_id and b.k = v.k where v.i >= {SUPPLIER.n_hist}"""
)


@query("q_garch", GARCH_SQL)
def garch(spark, sf):
    """The grid's nodes over a history as one fold of its squares, in order; the best node's recursion goes on over the online rows from where the fold left it."""
    o = obs(spark, sf, SUPPLIER)
    hist, _ = split(o, SUPPLIER.n_hist)
    sq = h.standardise(o, h.moments(hist)).select("series_id", "i", (F.col("z") * F.col("z")).alias("q"))
    past = F.transform(F.array_sort(F.collect_list(F.when(F.col("i") < SUPPLIER.n_hist, F.struct("i", "q")))), lambda r: r["q"])
    best = scan.garch_best(sq.groupBy("series_id").agg(past.alias("past")), "past", [(a, b) for a in k.GARCH_A for b in k.GARCH_B if a + b <= k.GARCH_MOST], k.burn_in(SUPPLIER.n_hist))
    t = F.col("i") - SUPPLIER.n_hist
    online = sq.filter(t >= 0).join(best, "series_id").select("series_id", t.alias("t"), "q", "arch", "garch", "after")
    fitted = scan.garch_variance(online, "q", F.col("arch"), F.col("garch"), "variance", "t", first=F.col("after"))
    return rounded(fitted.select("series_id", "t", "variance"))


@query("q_kalman")
def kalman(spark, sf):
    def run(a, z):
        phi = k.ar_fit(a, 2)
        f = k.kalman_fit(a, (float(phi[0]), float(phi[1])))
        return np.array([f.step(v) for v in z]).reshape(-1, 2)

    return _kernel(spark, sf, run, ["innovation", "variance"])


@query("q_dmd")
def dmd(spark, sf):
    def run(a, z):
        seen = k.DelayObserver(a)
        return {"gap": seen.gap(np.concatenate((a[-seen.d :], z)))[1:]}

    return _kernel(spark, sf, run, ["gap"])


@query("q_bocpd")
def bocpd(spark, sf):
    def run(a, z):
        return k.run_length_columns(k.run_length_path(z, 0.0, 25.0))

    return _kernel(spark, sf, run, m.BO)


_STEP = "ln(1 / 250.0 + exp(r.{c})) - ln(1 - 1 / 250.0)"
ABSORB_SQL = Z + _recursion({c: (f"{m_} * o.z - {m_ * m_ / 2!r} + ln(1 / 250.0) - ln(1 - 1 / 250.0)", f"{m_} * o.z - {m_ * m_ / 2!r} + " + _STEP.format(c=c)) for c, m_ in (("m8", -0.8), ("m4", -0.4), ("p4", 0.4), ("p8", 0.8))}) + _given(["m8", "m4", "p4", "p8"])


@query("q_absorb", ABSORB_SQL)
def absorb(spark, sf):
    shifts = {"m8": -0.8, "m4": -0.4, "p4": 0.4, "p8": 0.8}
    return _scanned(scan.absorbing(_z(spark, sf), {n: s * F.col("z") - s * s / 2 for n, s in shifts.items()}, 1 / 250))


_ON = "(case when r.state > 0 then o.s > 0.5 else o.s >= 0.6 end)"
RELAY_SQL = (
    Z + ", s as materialized (select series_id, t, abs(z) / (1 + abs(z)) as s from z)"
    + _recursion({
        "state": ("case when o.s >= 0.6 then 1 else 0 end", f"case when {_ON} then 1 else 0 end"),
        "operate": ("case when o.s >= 0.6 then (o.s - 0.6) / 0.4 else 0 end", f"case when {_ON} then r.operate + greatest(o.s - 0.6, 0) / 0.4 else greatest(0, r.operate - {k.RESET}) end"),
        "thermal": (f"case when o.s >= 0.6 then o.s / {k.CHARGE} else 0 end", f"case when {_ON} then r.thermal + (o.s - r.thermal) / {k.CHARGE} else r.thermal * exp(-1 / {k.COOL}) end"),
        "dwell": ("case when o.s >= 0.6 then 1 else 0 end", f"case when {_ON} then r.dwell + 1 else 0 end"),
        "cycles": ("0", f"least({k.MOST_CYCLES}, r.cycles + case when r.state > 0 and not {_ON} then 1 else 0 end)"),
    }, "s")
    + _given(["operate", "thermal", "dwell", "cycles"])
)


@query("q_relay", RELAY_SQL)
def relay(spark, sf):
    return _scanned(scan.relay(_share(spark, sf), "p", 0.6, 0.5, k.CHARGE, k.COOL, k.RESET, k.MOST_CYCLES).drop("p"))


HMM_SHARE = ", s as materialized (select series_id, t, abs(z) / (1 + abs(z)) as p from z), l as materialized (select series_id, t, exp({0} * (ln(greatest(least(p, 1 - 1e-6), 1e-6) / (1 - greatest(least(p, 1 - 1e-6), 1e-6))) + ln(4.0))) as lr from s)"


def _hmm_sql(enter: float, leave: float, temper: float) -> str:
    """The forward filter as its own recursion, the posterior normalised at every row."""
    ahead = f"(r.posterior * (1 - {leave!r}) + (1 - r.posterior) * {enter!r})"
    return Z + HMM_SHARE.format(temper) + _recursion({"posterior": (f"{enter!r} * o.lr / ({enter!r} * o.lr + 1 - {enter!r})", f"{ahead} * o.lr / ({ahead} * o.lr + 1 - {ahead})")}, "l") + _given(["posterior"])


@query("q_hmm_filter", _hmm_sql(1 / 200, 0.0, 0.25))
def hmm(spark, sf):
    """Absorbing two-state forward filter of scores, by matrices in logs."""
    return _scanned(scan.hmm_filter(_share(spark, sf), scan.score_log_ratio(F.col("p"), 0.25), 1 / 200).drop("p"))


@query("q_hmm_return", _hmm_sql(1 / 100, 1 / 40, 0.5))
def hmm_return(spark, sf):
    """The same with a way back to the first state."""
    return _scanned(scan.hmm_filter(_share(spark, sf), scan.score_log_ratio(F.col("p"), 0.5), 1 / 100, 1 / 40).drop("p"))


PERSIST = {"decaymax": (0.999, 0.995, 0.99, 0.98, 0.95, 0.90), "ewma": (0.05, 0.1, 0.2, 0.3, 0.5, 0.7)}
PERSIST_SQL = (
    Z + ", s as materialized (select series_id, t, abs(z) / (1 + abs(z)) as p from z)"
    + _recursion({f"decaymax{i}": ("o.p", f"greatest(o.p, {g!r} * r.decaymax{i})") for i, g in enumerate(PERSIST["decaymax"])} | {f"ewma{i}": ("o.p", f"r.ewma{i} + {a!r} * (o.p - r.ewma{i})") for i, a in enumerate(PERSIST["ewma"])}, "s")
    + _given([f"{n}{i}" for n, v in PERSIST.items() for i in range(len(v))])
)


@query("q_persist_scores", PERSIST_SQL)
def persist_scores(spark, sf):
    """Decayed maxima and exponential means of a score at every rate, in one scan."""
    p, first = F.col("p"), F.col("t") == 0
    step, kinds = {}, []
    for i, g in enumerate(PERSIST["decaymax"]):
        step |= {f"decaymax{i}_a": F.lit(g), f"decaymax{i}_b": p}
        kinds.append((f"decaymax{i}_", scan.max_scaled))
    for i, a in enumerate(PERSIST["ewma"]):
        step |= {f"ewma{i}_a": F.when(first, 0.0).otherwise(1 - a), f"ewma{i}_b": F.when(first, p).otherwise(a * p)}
        kinds.append((f"ewma{i}_", scan.affine))
    out = scan.scan(_share(spark, sf), step, scan.several(*kinds))
    return rounded(out.select("series_id", "t", *[F.col(f"_{n}{i}_b").alias(f"{n}{i}") for n, v in PERSIST.items() for i in range(len(v))]))


FOCUS_SQL = Z + ", c as (select series_id, t, sum(z) over (partition by series_id order by t) as c from z union all select distinct series_id, -1, 0.0 from z), g as (select a.series_id, a.t, a.t - b.t as age, (a.c - b.c) * (a.c - b.c) / (2 * (a.t - b.t)) as g from c a join c b on a.series_id = b.series_id and b.t < a.t where a.t >= 0) select series_id, t, round(max(g), 6) + 0.0 as statistic, arg_max(age, g)::double as age from g group by series_id, t"


@query("q_focus_hull", FOCUS_SQL)
def focus(spark, sf):
    def run(a, z):
        f = k.Focus()
        return np.array([f.step(v) for v in z]).reshape(-1, 2)

    return _kernel(spark, sf, run, ["statistic", "age"])


FEATS = ["a", "b", "cc"]


def _learning(spark, sf):
    rows = panel(spark, sf, USER).withColumn("fold", c.fold_of(F.col("series_id")))
    return rows.select("series_id", "t", "fold", "y", (F.col("score") / 1e6).alias("a"), (F.col("score_b") / 1e6).alias("b"), (F.col("score_c") / 1e6).alias("cc"))


@query("q_oof_gbt")
def oof(spark, sf):
    got = learn.out_of_fold(learn.pair_weights(_learning(spark, sf)), FEATS, lambda: learn.gbt(rounds=5, depth=3), weight="weight")
    scored = got.withColumn("score", F.round("oof", 9))
    return rounded(p.pooled(p.per_step(scored, "fold", "t"), "fold"))


@query("q_stack_lofo")
def stack(spark, sf):
    return rounded(learn.out_of_fold(_learning(spark, sf), FEATS, learn.logistic, "stacked").select("series_id", "t", "stacked"), 4)


@query("q_rf_baseline")
def forest(spark, sf):
    o = det.baseline_features(obs(spark, sf, USER)).join(panel(spark, sf, USER).select("series_id", (F.col("t") + 40).alias("i"), "y"), ["series_id", "i"])
    cols = ["rolling_mean_3", "rolling_std_3", "lag_1", "lag_2", "diff_1", "diff_2"]
    # every series is predicted by the forest of the other two thirds; each of the fits passes over the rows several times
    o = materialize(o.select("series_id", "i", "y", *cols), "baseline")
    third = F.pmod(F.col("series_id"), F.lit(3))
    parts = [learn.forest_baseline(o.filter(third != k_), cols).transform(o.filter(third == k_).dropna(subset=cols)) for k_ in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("series_id", "i", F.col("prediction").cast("long").alias("has_structural_break"))


@query("q_kmeans_router")
def kmeans(spark, sf):
    hist, _ = split(obs(spark, sf, SUPPLIER), SUPPLIER.n_hist)
    par = h.parameters(hist).select("series_id", "mu", "sd", "iqr", "mad", (F.col("q95") - F.col("q05")).alias("span"))
    par = par.withColumn("fold", c.fold_of(F.col("series_id")))
    return learn.router(par, ["mu", "sd", "iqr", "mad", "span"]).select("fold", "series_id", F.col("cluster").cast("long").alias("cluster"))


#: The detector's recursions over the S_user series.
_TANH = "(1 - 2 / (exp(2 * ({0})) + 1))"
_PARTS = {"level": "abs(mean - mu) / (greatest(sd / sqrt(greatest(n, 1.0)), 1e-8) * 3.0)", "drift": "greatest(up, down) / 6.0", "spread": "abs(ln(greatest(var / (sd * sd), 1e-8))) / 1.5"}
NOISY_SQL = (
    "with recursive " + obs_sql(USER) + ", z as materialized (select series_id, t, x, mu, sd, z from zon)"
    + _recursion({
        "mu": ("o.mu", "o.mu"), "sd": ("o.sd", "o.sd"), "mean": ("o.mu + 0.05 * (o.x - o.mu)", "r.mean + 0.05 * (o.x - r.mean)"), "n": ("1", "r.n + 1 - 0.05 * r.n"),
        "up": ("greatest(0.0, o.z - 0.5)", "greatest(0.0, r.up + o.z - 0.5)"), "down": ("greatest(0.0, -o.z - 0.5)", "greatest(0.0, r.down - o.z - 0.5)"),
        "var": ("o.sd * o.sd + 0.05 * ((o.x - o.mu) * (o.x - o.mu) - o.sd * o.sd)", "r.var + 0.05 * ((o.x - o.mu) * (o.x - o.mu) - r.var)"),
    })
    + f" select series_id, t, round(up, 6) + 0.0 as up, round(down, 6) + 0.0 as down, round(1 - (1 - greatest({_TANH.format(_PARTS['level'])}, {_TANH.format(_PARTS['drift'])})) * (1 - {_TANH.format(_PARTS['spread'])}), 6) + 0.0 as noisy_or from r"
)
CUSUM_SQL = "with " + obs_sql(USER) + ", c as (select series_id, t, sum(z - 0.5) over o as u, sum(-z - 0.5) over o as d from zon window o as (partition by series_id order by t)) select series_id, t, round(u - least(0.0, min(u) over o), 6) + 0.0 as up, round(d - least(0.0, min(d) over o), 6) + 0.0 as down from c window o as (partition by series_id order by t)"


def _streamed(spark, sf, of=None):
    return scores.run_available(spark, f"{sf}/events.parquet", f"{shared_dir(spark)}/seismark", USER.n_hist, of=of)


@query("q_stream_cusum", CUSUM_SQL)
def stream_cusum(spark, sf):
    """The stream's reflected sums against those of windows."""
    return rounded(_streamed(spark, sf).select("series_id", "t", "up", "down"))


@query("q_stream_m00")
def stream_m00(spark, sf):
    return _streamed(spark, sf, lambda rows: features.stream_features(rows, USER.n_hist, ["m00_core"]))


@query("q_stream_features")
def stream_features(spark, sf):
    """All modules as a stream."""
    return _streamed(spark, sf, lambda rows: features.stream_features(rows, USER.n_hist, list(m.REGISTRY)))


@query("q_stream_noisy_or", NOISY_SQL)
def stream(spark, sf):
    return rounded(_streamed(spark, sf))


@query("q_batch_noisy_or", NOISY_SQL)
def batch(spark, sf):
    return rounded(scores.batch_scores(scores.keyed(spark.read.parquet(f"{sf}/events.parquet")), USER.n_hist))
