"""Feature modules over one series: a registry of (columns, function). All requested modules run in one grouped pass, so a panel is shuffled
once whatever their number. Columns are ``module__name``, floats, null where a window is not full or a history too short."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..sources.series import spread_evenly
from . import kernels as k
from .lengthnull import LengthNull, restarts

#: Order of the autoregression whose residuals are monitored.
AR = 2
GRID = np.array([5, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024])


def running(x: np.ndarray) -> np.ndarray:
    """0 and the running sums along the last axis."""
    out = np.zeros((*x.shape[:-1], x.shape[-1] + 1))
    np.cumsum(x, axis=-1, out=out[..., 1:])
    return out


def means_of(sums: np.ndarray, w: int) -> np.ndarray:
    """Means of all windows of w values, from their running sums."""
    return (sums[..., w:] - sums[..., :-w]) / w if sums.shape[-1] > w else np.zeros((*sums.shape[:-1], 0))


@dataclass
class Context:
    """One series: history and online values with what the history says, each taken when a module first asks for it; nothing here depends on the online length."""

    hist: np.ndarray
    online: np.ndarray
    cache: dict = field(default_factory=dict)

    def __post_init__(self):
        h = self.hist
        self.mu, self.sd = float(h.mean()), max(float(h.std(ddof=1)), 1e-9)
        self.grid = GRID[GRID * 2 <= len(h)]

    @cached_property
    def standard(self) -> tuple[np.ndarray, np.ndarray]:
        """z of the history and online."""
        return (self.hist - self.mu) / self.sd, (self.online - self.mu) / self.sd

    @cached_property
    def q(self) -> dict[int, float]:
        held = (1, 5, 25, 50, 75, 95, 99)
        return dict(zip(held, np.quantile(self.hist, np.array(held) / 100).tolist(), strict=True))

    @cached_property
    def mad(self) -> float:
        return max(1.4826 * k.median(np.abs(self.hist - self.q[50])), 1e-9)

    @cached_property
    def sorted(self) -> np.ndarray:
        return np.sort(self.hist)

    @cached_property
    def phi(self) -> np.ndarray:
        return k.ar_fit(self.standard[0], AR)

    @cached_property
    def _both(self) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        z, live = self.standard
        res = k.ar_residuals(z, self.phi)
        res[: min(AR, len(z))] = 0.0
        e_sd = max(float(res[AR:].std(ddof=1)), 1e-9) if len(z) > AR + 1 else 1.0
        return self._transforms(self.hist, res / e_sd), self._transforms(self.online, k.ar_residuals(live, self.phi, z) / e_sd)

    @property
    def h(self) -> dict[str, np.ndarray]:
        return self._both[0]

    @property
    def o(self) -> dict[str, np.ndarray]:
        return self._both[1]

    def pit(self, x: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.sorted, x, "left"), np.searchsorted(self.sorted, x, "right")
        return (0.5 * (lo + hi) + 0.5) / (len(self.sorted) + 1)

    def _transforms(self, x: np.ndarray, e: np.ndarray) -> dict[str, np.ndarray]:
        z, u, q = (x - self.mu) / self.sd, self.pit(x), self.q
        r, c = (x - q[50]) / self.mad, np.clip((x - self.mu) / self.sd, -8, 8)
        lag = lambda v, j: np.concatenate((np.zeros(min(j, len(v))), v[j:] * v[:-j])) if len(v) > j else np.zeros(len(v))
        return {
            "mean": z, "sq": z * z, "abs": np.abs(z), "rmean": r, "rabs": np.abs(r), "tail_hi": (x > q[95]) * 1.0, "tail_lo": (x < q[5]) * 1.0,
            "tail_x": ((x > q[99]) | (x < q[1])) * 1.0, "center": ((x > q[25]) & (x < q[75])) * 1.0, "sign": np.sign(z), "u": u, "u2": (u - 0.5) ** 2, "cube": c**3, "quart": c**4,
            "logabs": np.log(np.abs(z) + 1e-3), "res_mean": e, "res_sq": e * e, "res_abs": np.abs(e), "res_lag1": lag(e, 1), "res_sq_lag1": lag(e * e, 1),
            "lag1": lag(z, 1), "lag2": lag(z, 2), "abslag1": lag(np.abs(z), 1),
        }

    @staticmethod
    def rolled(x: np.ndarray, w: int) -> np.ndarray:
        return means_of(running(x), w)

    def roll(self, name: str, w: int) -> np.ndarray:
        out = np.full(len(self.online), np.nan)
        if ("online", name) not in self.cache:
            self.cache["online", name] = running(self.o[name])
        out[w - 1 :] = means_of(self.cache["online", name], w)
        return out

    def expand(self, name: str) -> np.ndarray:
        return np.cumsum(self.o[name]) / np.arange(1, len(self.online) + 1)

    def null(self, name: str) -> LengthNull:
        """Rolling means of the history by grid window."""
        if name not in self.cache:
            whole = np.stack(list(self.h.values()))
            if np.isfinite(whole).all():
                self.cache |= dict(zip(self.h, LengthNull.many(running(whole), self.grid), strict=True))
            else:
                sums = running(self.h[name])
                self.cache[name] = LengthNull.of(lambda w: means_of(sums, w), self.grid)
        return self.cache[name]

    def z(self, name: str, length: np.ndarray | float, v: np.ndarray) -> np.ndarray:
        return self.null(name).z(length, v)

    def pct(self, name: str, w: int, v: np.ndarray) -> np.ndarray:
        s = self.null(name).samples[int(np.flatnonzero(self.grid == w)[0])]
        return 0.5 * (np.searchsorted(s, v, "left") + np.searchsorted(s, v, "right")) / len(s)

    def once(self, key: str, f: Callable[[Context], object]):
        """f of this series, which several modules ask for."""
        if ("once", key) not in self.cache:
            self.cache["once", key] = f(self)
        return self.cache["once", key]

    @cached_property
    def res(self) -> tuple[np.ndarray, np.ndarray]:
        """Squared residuals of the history and online."""
        return self.h["res_sq"], self.o["res_sq"]


def mean_so_far(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, axis=-1) / np.arange(1, x.shape[-1] + 1)


def trailing(x: np.ndarray, w: int) -> np.ndarray:
    """Trailing means of exactly w values, else NaN."""
    out = np.full(x.shape, np.nan)
    if x.shape[-1] >= w:
        out[..., w - 1 :] = Context.rolled(x, w)
    return out


def columnwise(f: Callable, a: np.ndarray) -> np.ndarray:
    """A nan-aware reduction of the rows of ``a``; NaN for columns without a number."""
    out, some = np.full(a.shape[1], np.nan), ~np.isnan(a).all(axis=0)
    out[some] = f(a[:, some], axis=0)
    return out


Module = Callable[[Context], dict[str, np.ndarray]]
REGISTRY: dict[str, tuple[list[str], Module]] = {}


def register(name: str, columns: list[str]):
    def put(fn: Module) -> Module:
        REGISTRY[name] = (columns, fn)
        return fn

    return put


MULTI = ["mean", "sq", "abs", "u", "u2", "tail_x", "lag1"]
EXPAND = ["mean", "sq", "abs", "rmean", "rabs", "u", "u2", "tail_hi", "tail_lo", "tail_x", "center", "sign", "cube", "quart", "logabs", "lag1", "lag2", "abslag1"]
WINDOWS = [8, 16, 32, 64, 128, 256]
SLOPES = ["mean", "sq", "abs", "u2"]
M00 = (
    [f"exp_{k_}_{n}" for n in EXPAND for k_ in ("z", "absz")] + [f"w{w}_{k_}_{n}" for w in WINDOWS for n in MULTI for k_ in ("sur", "z")]
    + [f"xs_{k_}_{n}" for n in MULTI for k_ in ("max", "mean", "min")] + [f"{k_}_{n}" for n in ("mean", "sq", "abs", "u2") for k_ in ("sl", "se")] + ["t_online", "log_t_online"]
)


@register("m00_core", M00)
def m00(c: Context) -> dict[str, np.ndarray]:
    """Rolling and expanding means of the transforms against the history's own: one table of z by (transform, window), and what follows from it."""
    n = len(c.online)
    length = np.arange(1, n + 1, dtype=float)
    far = mean_so_far(np.stack([c.o[x] for x in EXPAND]))
    sums = running(np.stack([c.o[x] for x in MULTI]))
    rolled = {w: np.full((len(MULTI), n), np.nan) for w in WINDOWS}
    for w, v in rolled.items():
        v[:, w - 1 :] = means_of(sums, w)
    out = {"t_online": length, "log_t_online": np.log1p(length)}
    for x in SLOPES:
        short = rolled[16][MULTI.index(x)]
        out |= {f"sl_{x}": short - rolled[128][MULTI.index(x)], f"se_{x}": short - far[EXPAND.index(x)]}
    if not len(c.grid):
        return out
    z = np.clip(LengthNull.z_rows([c.null(x) for x in EXPAND], length, far), -12, 12)
    out |= {f"exp_z_{x}": z[i] for i, x in enumerate(EXPAND)} | {f"exp_absz_{x}": v for x, v in zip(EXPAND, np.abs(z), strict=True)}
    windows = [w for w in WINDOWS if w in c.grid]
    if not windows:
        return out
    at, nulls = [int(np.flatnonzero(c.grid == w)[0]) for w in windows], [c.null(x) for x in MULTI]
    v = np.stack([rolled[w] for w in windows])  # windows x transforms x t
    none = np.isnan(v)
    known = np.nan_to_num(v)
    middle, scale = (np.stack([getattr(null, part)[at] for null in nulls], axis=1)[..., None] for part in ("middle", "scale"))
    z = np.clip((v - middle) / np.exp(np.log(scale)), -12, 12)
    below = np.array([[np.searchsorted(nulls[j].samples[at[i]], known[i, j], side) for j in range(len(MULTI))] for i in range(len(windows)) for side in ("left", "right")])
    held = np.array([[len(null.samples[k_]) for null in nulls] for k_ in at])[..., None]
    above = 0.5 * (below[::2] + below[1::2]) / held - 0.5
    rare = -np.log10(np.maximum(1 - 2 * np.abs(above), 1e-6))
    surprise = np.where(none, np.nan, np.clip(np.sign(above) * rare, -6, 6))
    out |= {f"w{w}_sur_{x}": surprise[i, j] for i, w in enumerate(windows) for j, x in enumerate(MULTI)} | {f"w{w}_z_{x}": z[i, j] for i, w in enumerate(windows) for j, x in enumerate(MULTI)}
    if len(windows) >= 2:
        size = np.abs(z).reshape(len(windows), -1)
        out |= {f"xs_{key}_{x}": got for key, f in (("max", np.nanmax), ("mean", np.nanmean), ("min", np.nanmin)) for x, got in zip(MULTI, columnwise(f, size).reshape(len(MULTI), n), strict=True)}
    return out


#: Fixed values of the suffix contrasts: suffix lengths, least prefix, clip, and the channels by tag.
SUFFIXES, LEAST_PREFIX, CLIP = np.array([4, 8, 16, 32, 64, 128, 256]), 8, 40.0
BACK = {"lv": "mean", "sc": "abs", "pit": "u", "rl": "res_mean", "rs": "res_abs", "dp": "lag1"}


@register("m09_back", [f"{tag}_{s}" for tag in BACK for s in ("d8", "d32", "d128", "dmax", "dkf", "dsh", "dlg", "pre")] + ["xb_max", "xb_mean", "xb_rng"])
def m09(c: Context) -> dict[str, np.ndarray]:
    """The last k points against all online points before them, in units of both null spreads: one array over (k, t) for each channel."""
    n = len(c.online)
    if not len(c.grid) or not n:
        return {}
    k_ = SUFFIXES[:, None]
    t = np.arange(1, n + 1)
    head = t - k_  # points before the suffix
    full = head >= LEAST_PREFIX
    out, tops = {}, []
    for tag, name in BACK.items():
        sums, null = np.concatenate(([0.0], np.cumsum(c.o[name]))), c.null(name)
        scale = lambda m, null=null: np.exp(null._at(m, np.log(null.scale)))
        at = np.maximum(head, 0)
        suffix, prefix = (sums[t] - sums[at]) / k_, sums[at] / np.maximum(at, 1)
        floor = max(1e-4 * float(c.h[name].std()), 1e-9)
        d = np.where(full, np.clip((suffix - prefix) / np.maximum(np.hypot(scale(k_), scale(np.maximum(head, 1))), floor), -CLIP, CLIP), np.nan)
        some, size = full.any(axis=0), np.abs(d)
        best = np.where(full, size, -1.0).argmax(axis=0)
        pick = lambda v, best=best, some=some: np.where(some, np.take_along_axis(np.broadcast_to(v, d.shape), best[None], 0)[0], np.nan)  # noqa: B023, E731
        rest = np.maximum(t - SUFFIXES[best], 1)
        out |= {f"{tag}_d{w}": d[np.flatnonzero(SUFFIXES == w)[0]] for w in (8, 32, 128)}
        out |= {f"{tag}_dmax": pick(d), f"{tag}_dkf": pick(k_ / t), f"{tag}_dsh": columnwise(np.nanmax, size[SUFFIXES <= 16]), f"{tag}_dlg": columnwise(np.nanmax, size[SUFFIXES >= 64])}
        out[f"{tag}_pre"] = np.where(some, np.clip(null.z(rest, np.nan_to_num(pick(prefix))), -CLIP, CLIP), np.nan)
        tops.append(np.abs(out[f"{tag}_dmax"]))
    a = np.stack(tops)
    high, low = columnwise(np.nanmax, a), columnwise(np.nanmin, a)
    return out | {"xb_max": high, "xb_mean": columnwise(np.nanmean, a), "xb_rng": high - low}


#: Fixed values of the change-point scan: anchors and restarts of its null, window of its steadiness, clip.
FOCUS_ANCHORS, FOCUS_RESTARTS, FOCUS_SPAN, STEADY, FOCUS_CLIP = np.array([2, 4, 8, 16, 32, 64, 128, 256, 512, 999]), 24, 1024, 16, 12.0
FOCUS = {"mean": "mean", "sq": "sq", "rabs": "rabs", "res": "res_mean", "ressq": "res_sq", "lag1": "lag1"}


def _focus_at(seg: np.ndarray, anchors: np.ndarray) -> list[np.ndarray]:
    """The scan's statistic, and that of the start at zero, at some lengths only, for a row for each segment."""
    s = running(seg)
    return [np.stack([((s[..., a, None] - s[..., :a]) ** 2 / (2 * (a - np.arange(a)))).max(axis=-1) for a in anchors], axis=-1), s[..., anchors] ** 2 / (2 * anchors)]


def relative_spread(v: np.ndarray, w: int = STEADY) -> np.ndarray:
    """Standard deviation of the last w values (of all while there are fewer) over one more than their mean size."""
    t = np.arange(1, v.shape[-1] + 1)
    m = np.minimum(t, w)
    mean = lambda x: (lambda c: (c[..., 1:] - c[..., t - m]) / m)(running(x))
    return np.sqrt(np.maximum(mean(v * v) - mean(v) ** 2, 0)) / np.maximum(mean(np.abs(v)) + 1, 1)


@register("m11_focus", [f"{tag}_{s}" for tag in FOCUS for s in ("z", "pct", "anc_z", "gain", "age", "agefrac", "secz", "gap", "pk", "dpk", "tsp", "stab")] + ["xf_max", "xf_mean", "xf_n_hot", "xf_age_agree"])
def m11(c: Context) -> dict[str, np.ndarray]:
    """Exact scan over all starts of a change, with the geometry of the best one, against the same scan restarted in the history."""
    n = len(c.online)
    t = np.arange(1, n + 1, dtype=float)
    out: dict[str, np.ndarray] = {}
    laws = {name: (float(c.h[name].mean()), s if (s := float(c.h[name].std())) > k.EPS else 1.0) for name in FOCUS.values()}
    nulls = restarts(_focus_at, np.stack([(c.h[name] - m) / s for name, (m, s) in laws.items()]), FOCUS_ANCHORS, FOCUS_SPAN, FOCUS_RESTARTS) if n else None
    if nulls:
        stat, age, second, anchored = k.focus_paths(np.stack([(c.o[name] - m) / s for name, (m, s) in laws.items()]))
        z, runner, first = LengthNull.z_rows([*nulls[0], *nulls[0], *nulls[1]], t, np.concatenate((stat, second, anchored)), FOCUS_CLIP).reshape(3, len(FOCUS), n)
        peak = np.maximum.accumulate(z, axis=1)
        since = t - np.maximum.accumulate(np.where(z >= peak - 1e-12, t, 0.0), axis=1)
        near = nulls[0][0].nearest(t)
        held = {"z": z, "pct": np.stack([null.share_below(t, v, near) for null, v in zip(nulls[0], stat, strict=True)]), "anc_z": first, "gain": z - first, "age": np.log1p(age), "agefrac": age / t}
        held |= {"secz": runner, "gap": z - runner, "pk": peak, "dpk": np.stack([k.decayed_max(v, 0.98) for v in z]), "tsp": np.log1p(since), "stab": relative_spread(t - age)}
        out |= {f"{tag}_{name}": v[i] for name, v in held.items() for i, tag in enumerate(FOCUS)}
    none = np.full(n, np.nan)
    z, age = (np.stack([out.get(f"{tag}_{s}", none) for tag in FOCUS]) for s in ("z", "age"))
    hot = z > 2.0
    agree = np.where(hot.sum(axis=0) >= 2, columnwise(np.nanstd, np.where(hot, age, np.nan)), np.nan)
    return out | {"xf_max": columnwise(np.nanmax, z), "xf_mean": columnwise(np.nanmean, z), "xf_n_hot": (z > 3.0).sum(axis=0).astype(float), "xf_age_agree": agree}


BO = ["p10", "p25", "p50", "mode", "mean", "ent", "none", "odds"]


#: Log-likelihood ratios of the absorbing changes, from the normal score and the one before it, and the parts' weights in their sum.
ABSORBING = {
    "ab_var": (0.45, [lambda g, b, v=v: 0.5 * g * g * (1 - 1 / v) - 0.5 * np.log(v) for v in (0.50, 0.63, 0.79, 1.26, 1.58, 2.00)]),
    "ab_loc": (0.20, [lambda g, b, m=m: m * g - m * m / 2 for m in (-0.8, -0.4, -0.2, 0.2, 0.4, 0.8)]),
    "ab_dep": (0.20, [lambda g, b, p=p: p * g * b - 0.5 * p * p * b * b for p in (-0.4, -0.2, 0.2, 0.4)]),
}


def normal_scores(c: Context) -> np.ndarray:
    """Of the online residuals among the history's."""
    from statistics import NormalDist

    inv = NormalDist().inv_cdf
    hist = np.sort(c.h["res_mean"][5:]) if len(c.hist) > 10 else np.sort(c.h["res_mean"])
    e = c.o["res_mean"]
    u = (0.5 * (np.searchsorted(hist, e, "left") + np.searchsorted(hist, e, "right")) + 0.5) / (len(hist) + 1)
    return np.clip(np.array([inv(v) for v in u.tolist()]), -6, 6)


def posteriors(g: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run-length posteriors and absorbing odds, times first, of normal scores and those before them (a row for each of several series)."""
    ratios = np.stack([f(g, before) for _, part in ABSORBING.values() for f in part], axis=-1)
    return k.run_length_path(g, 0.0, 25.0), k.absorbing(np.clip(np.moveaxis(ratios, -2, 0), -40, 40))


def before_them(c: Context, g: np.ndarray) -> np.ndarray:
    return np.concatenate(([c.h["res_mean"][-1]], g[:-1])) if len(g) else g


def posteriors_of(series: list[Context]) -> None:
    """The posteriors of several series at once: of those whose lengths differ by less than twice, filled up behind their end."""
    waiting = sorted(((len(c.online), i) for i, c in enumerate(series)), reverse=True)
    while waiting:
        n = waiting[0][0]
        some = [i for length, i in waiting if 2 * length >= n]
        waiting = waiting[len(some) :]
        g, before = np.zeros((2, len(some), n))
        for row, i in enumerate(some):
            v = normal_scores(series[i])
            g[row, : len(v)], before[row, : len(v)] = v, before_them(series[i], v)
        runs, taken = posteriors(g, before)
        for row, i in enumerate(some):
            m = len(series[i].online)
            series[i].cache["once", "posteriors"] = runs[row, :m], np.ascontiguousarray(taken[:m, row])


@register("m07_bocpd", [f"bo_{n}" for n in BO] + ["ab_var", "ab_loc", "ab_dep", "ab_all"])
def m07(c: Context) -> dict[str, np.ndarray]:
    """Run-length posterior and absorbing-change odds on normal scores of residuals."""
    runs, taken = c.once("posteriors", lambda c: posteriors(g := normal_scores(c), before_them(c, g)))
    out = {f"bo_{n}": col for n, col in zip(BO, k.run_length_columns(runs).T, strict=True)}
    total, begin = [], 0
    for name, (weight, part) in ABSORBING.items():
        odds = taken[:, begin : begin + len(part)]
        begin += len(part)
        out[name] = np.logaddexp.reduce(odds, axis=1) - np.log(odds.shape[1])
        total.append(out[name] + np.log(weight / 0.85))
    out["ab_all"] = np.logaddexp.reduce(np.stack(total), axis=0)
    return out


#: Fixed values of the residual monitors: lengths and cap of their nulls, clips, trailing window, and monitors of the two tiers.
RESID_GRID, RESID_MOST, RESID_CLIP, POINT_CLIP, RESID_W = np.array([6, 16, 32, 80, 200, 512]), 600, 12.0, 8.0, 32
TIERS = {"A": (("raw", "ar1", "ar2", "ar5", "vol", "cmb"), ("mean", "var", "abs", "tail", "acf1", "acf1sq")), "B": (("arR", "arH", "volG", "volM"), ("var", "acf1sq"))}
HALF_22, HALF_63 = 1 - 2 ** (-1 / 22), 1 - 2 ** (-1 / 63)


def residual_streams(c: Context) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """History and online values of ten ways to take out what the history predicts, each with unit spread on the history."""
    h, o = c.h["mean"], c.o["mean"]
    n = len(h)
    both, burn = np.concatenate((h, o)), k.burn_in(n)

    def scaled(e: np.ndarray, start: int, end: int = n) -> tuple[np.ndarray, np.ndarray]:
        s = max(float(e[start:end].std(ddof=1)), 1e-9) if end - start > 1 else 1.0
        return e[start:end] / s, e[end:] / s

    coefs = {"ar1": k.ar_fit(h, 1), "ar2": c.phi, "ar5": k.ar_fit(h, 5), "arR": k.ar_fit(h, 3, 0.05), "arH": k.ar_huber(h, 2)}
    out = {"raw": (h, o)} | {tag: scaled(k.ar_residuals(both, phi), len(phi)) for tag, phi in coefs.items()}
    size = np.minimum(np.abs(both), 4.0)
    vol = lambda x, v: x / np.sqrt(np.maximum(v, 1e-9))
    out["vol"] = scaled(vol(both, k.ewma_before(both**2, HALF_22, 1.0)), burn)
    out["volM"] = scaled(both / np.maximum(k.ewma_before(size, HALF_63, float(size[:n].mean())), 1e-9), burn)
    out["volG"] = scaled(vol(both, k.garch_before(both**2, *k.garch_fit(h * h))), burn)
    res = np.concatenate(out["ar2"])
    m = len(out["ar2"][0])
    out["cmb"] = scaled(vol(res, k.ewma_before(res**2, HALF_22, 1.0)), k.burn_in(m), m)
    return out


def change_of_law(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Twice the mean log-likelihood ratio of a normal law with mean m and mean square q to the standard one."""
    return q - np.log(np.maximum(q - m * m, 1e-6)) - 1


@register("m04_resid", [f"{r}_{s}" for tier, (reps, mons) in TIERS.items() for r in reps for s in [f"e_{m}" for m in mons] + ["e_llr"] + [f"w{RESID_W}_llr"] * (tier == "A")])
def m04(c: Context) -> dict[str, np.ndarray]:
    """Monitors of standardised residual streams, against their own history."""
    n = len(c.online)
    t = np.arange(1, n + 1, dtype=float)
    grid = RESID_GRID[RESID_GRID <= max(len(c.hist) // 2, 5)]
    if not len(grid) or not n:
        return {}
    streams, out, place = residual_streams(c), {}, None  # all nulls have the same lengths
    names, lives, nulls, laws, tier_a = [], [], [], [], []
    for tier, (reps, mons) in TIERS.items():
        for r in reps:
            clipped = [np.clip(x, -POINT_CLIP, POINT_CLIP) for x in streams[r]]
            cut = k.quantile(np.abs(clipped[0]), 0.95) if len(clipped[0]) else 3.0
            points = []
            for raw, x, last in ((streams[r][0], clipped[0], None), (streams[r][1], clipped[1], clipped[0][-1:])):
                before = np.concatenate((x[:1] if last is None else last, x[:-1]))
                size, square = np.abs(x), x * x
                points.append({"mean": raw, "var": square, "abs": size, "tail": (size > cut) * 1.0, "acf1": x * before, "acf1sq": (square - 1) * (before * before - 1)})
            hist, live = points
            for kind in (True, False):
                some = [mon for mon in mons if mon.startswith("acf") == kind]
                pasts = np.stack([hist[mon][1:] if kind else hist[mon] for mon in some])
                if np.isfinite(pasts).all() and pasts.shape[1] > grid[-1]:
                    nulls += LengthNull.many(running(pasts), grid, RESID_MOST)
                else:
                    nulls += [LengthNull.of(lambda w, past=past, sums=running(past): means_of(sums, w) if w < len(past) else past.mean()[None], grid, most=RESID_MOST) for past in pasts]
                names += [f"{r}_e_{mon}" for mon in some]
                lives += [live[mon] for mon in some]
            sums = running(np.stack((hist["mean"], hist["var"])))
            laws.append(LengthNull.of(lambda w, sums=sums: change_of_law(*means_of(sums, w)), grid, most=RESID_MOST))
            tier_a.append(tier == "A")
            names.append(f"{r}_e_llr")
            lives.append((live["mean"], live["var"]))
    moved = [v for v in lives if not isinstance(v, tuple)]
    pairs = np.array([v for v in lives if isinstance(v, tuple)])
    place = nulls[0]._place(t)
    got = LengthNull.z_rows(nulls, t, np.cumsum(moved, axis=1) / t, RESID_CLIP, place)
    out |= dict(zip([x for x in names if not x.endswith("_llr")], got, strict=True))
    far = np.cumsum(pairs, axis=2) / t
    z = LengthNull.z_rows(laws, t, change_of_law(far[:, 0], far[:, 1]), RESID_CLIP, place)
    z[:, t < 8] = np.nan
    tags = [x for x in names if x.endswith("_llr")]
    out |= dict(zip(tags, z, strict=True))
    near = trailing(pairs[tier_a], RESID_W)
    w = LengthNull.z_rows([law for law, a in zip(laws, tier_a, strict=True) if a], np.array([float(RESID_W)]), change_of_law(near[:, 0], near[:, 1]), RESID_CLIP)
    return out | {x.replace("_e_llr", f"_w{RESID_W}_llr"): v for x, v in zip([x for x, a in zip(tags, tier_a, strict=True) if a], w, strict=True)}


def scaled_autocorrelation(x: np.ndarray, w: int) -> np.ndarray:
    """sqrt(w) times the lag-one correlation within each trailing window of w values, both sides about the window's mean of their own."""
    out = np.full(len(x), np.nan)
    if len(x) >= w:
        v = np.lib.stride_tricks.sliding_window_view(x, w)
        a, b = (y - y.mean(axis=1, keepdims=True) for y in (v[:, :-1], v[:, 1:]))
        size = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
        out[w - 1 :] = np.where(size > k.EPS, np.sqrt(w) * (a * b).sum(axis=1) / np.maximum(size, k.EPS), 0.0)
    return out


@register("m17_kalman_nis", ["nis_log", "nis_cum_z", "nis_w32_z", "nis_w64_z", "innov_acf_w32_z", "innov_acf_w64_z"])
def m17a(c: Context) -> dict[str, np.ndarray]:
    """Normalised innovations of the observer that the history chose."""
    seen = c.once("observer", lambda c: k.kalman_fit(c.h["mean"], (float(c.phi[0]), float(c.phi[1]))))
    got = np.array([seen.step(v) for v in c.o["mean"].tolist()]).reshape(-1, 2)
    e = got[:, 0] / np.sqrt(got[:, 1])
    q, t = e * e, np.arange(1, len(e) + 1)
    out = {"nis_log": np.log1p(q), "nis_cum_z": (np.cumsum(q) - t) / np.sqrt(2 * t)}
    for w in (32, 64):
        out |= {f"nis_w{w}_z": (trailing(q, w) - 1) * np.sqrt(w / 2), f"innov_acf_w{w}_z": scaled_autocorrelation(e, w)}
    return out


#: Fixed values of the delay observer: coordinates of a delay vector, and windows of its rank.
DELAYS, RANK_WINDOWS = 16, (32, 64)


def ranks_of(series: list[Context]) -> None:
    """The effective ranks of several series at once."""
    some = [c for c in series if len(c.hist) >= DELAYS and len(c.online)]
    for c, ranks in zip(some, k.effective_ranks([np.concatenate(c.standard) for c in some], DELAYS, RANK_WINDOWS), strict=True):
        c.cache["once", "ranks"] = ranks


def observers_of(series: list[Context]) -> None:
    """The observers of several series at once."""
    for n in {len(c.hist) for c in series}:
        some = [c for c in series if len(c.hist) == n]
        for c, seen in zip(some, k.kalman_fits(np.stack([c.h["mean"] for c in some]), np.stack([c.phi[:2] for c in some])), strict=True):
            c.cache["once", "observer"] = seen


#: What modules take for several series at once, ahead of their functions.
TOGETHER: dict[str, Callable[[list[Context]], None]] = {"m17_hankel_dmd": ranks_of, "m07_bocpd": posteriors_of, "m17_kalman_nis": observers_of}


@register("m17_hankel_dmd", ["dmd_resid_h1_z", "dmd_resid_h5_z", "dmd_subspace_resid_z", "dmd_effrank_w32_z", "dmd_effrank_w64_z", "dmd_resid_ratio_h5_h1"])
def m17b(c: Context) -> dict[str, np.ndarray]:
    """Prediction gaps of the delay observer at one and five steps, what leaves its subspace, and the rank of recent delay vectors."""
    h, n = c.standard[0], len(c.online)
    if len(h) < DELAYS or not n:
        return {}
    seen, whole = k.DelayObserver(h, DELAYS), np.concatenate(c.standard)
    ranks = c.once("ranks", lambda c: [k.effective_rank(k.delays(whole, DELAYS), w) for w in RANK_WINDOWS])
    found = {"dmd_resid_h1_z": seen.gap(whole), "dmd_resid_h5_z": seen.gap(whole, 5), "dmd_subspace_resid_z": seen.outside(whole)} | {f"dmd_effrank_w{w}_z": v for w, v in zip(RANK_WINDOWS, ranks, strict=True)}
    raw, out = {}, {}
    for name, all_ in found.items():
        raw[name], past = all_[-n:], all_[: len(h) - seen.d + 1]
        past = past[np.isfinite(past)]
        m, s = k.robust(past)
        s = s if s > 1e-9 else float(past.std(ddof=1)) if len(past) > 1 and past.std() > k.EPS else 1.0
        out[name] = (raw[name] - m) / s
    return out | {"dmd_resid_ratio_h5_h1": raw["dmd_resid_h5_z"] / np.maximum(raw["dmd_resid_h1_z"], k.EPS)}


SCALES = np.array([1, 2, 4, 8, 16, 32])


def scale_surprise(c: Context) -> np.ndarray:
    """Two-sided rarity (-log10) of the residual squares' trailing means at dyadic scales, scales x t."""
    return c.once("scales", _scale_surprise)


def _scale_surprise(c: Context) -> np.ndarray:
    hist, live = c.res
    out = np.full((len(SCALES), len(live)), np.nan)
    for i, w in enumerate(SCALES):
        null, v = np.sort(Context.rolled(hist, w)), trailing(live, w)
        if len(null):
            p = (np.searchsorted(null, np.nan_to_num(v), "right") + 0.5) / (len(null) + 1)
            out[i] = np.where(np.isnan(v), np.nan, -np.log10(np.maximum(2 * np.minimum(p, 1 - p), 1 / (len(null) + 1))))
    return out


@register("m13_scale_surv", ["survival_count_q05", "survival_count_q01", "largest_surviving_scale_q05", "largest_surviving_scale_q01", "slope_logscale"])
def m13(c: Context) -> dict[str, np.ndarray]:
    """At how many scales the rarity survives, the (number of the) largest such scale, and the rarity's slope over the log of the scale."""
    s = scale_surprise(c)
    seen = ~np.isnan(s)
    out = {}
    for tag, limit in (("q05", 1.301029995664), ("q01", 2.0)):  # fixed values: rarities of 5 % and 1 %
        hit = seen & (np.nan_to_num(s) > limit)
        out |= {f"survival_count_{tag}": hit.sum(axis=0), f"largest_surviving_scale_{tag}": (hit * np.arange(1, 7)[:, None]).max(axis=0)}
    x, n = np.where(seen, np.log2(SCALES)[:, None], 0.0), np.maximum(seen.sum(axis=0), 1)
    dx = np.where(seen, x - x.sum(axis=0) / n, 0.0)
    y = np.nan_to_num(s)
    out["slope_logscale"] = np.where(seen.sum(axis=0) >= 2, (dx * y).sum(axis=0) / np.maximum((dx * dx).sum(axis=0), k.EPS), np.nan)
    return out


@register("m13_scale_indiv", [f"surprise_b{w}" for w in SCALES])
def m13_indiv(c: Context) -> dict[str, np.ndarray]:
    return {f"surprise_b{w}": v for w, v in zip(SCALES, scale_surprise(c), strict=True)}


#: Fixed values of the bets: fractions, powers, thresholds of the payoffs, and the tail's weight.
BETS, POWERS = np.array([-0.9, -0.6, -0.3, 0.3, 0.6, 0.9]), np.array([0.15, 0.3, 0.5, 0.7, 0.9])
TAIL, FAR_TAIL, APART, LEAST_WEIGHT, RATES = 0.4, 0.45, 0.3, 0.25, (0.02, 0.30)
CTM = ["tail_log", "tail_pk", "disp_log", "disp_pk", "dep_log", "vc_log", "pow_log", "pow_pk"]


def share_before(flag: np.ndarray, w: int) -> np.ndarray:
    """Share of true among the w rows before each row, or among all before it where they are fewer; nothing for the first."""
    v = flag * 1.0
    last, ever = trailing(v, w)[:-1], mean_so_far(v)[:-1]
    return np.concatenate(([np.nan][: len(v)], np.where(np.isfinite(last), last, ever)))


def tail_weight(past: np.ndarray, live: np.ndarray) -> np.ndarray:
    """The history's share of tails over the recent one, where tails came up more often of late; row t looks at rows before t alone."""
    usual = np.clip(np.mean(np.abs(past) > FAR_TAIL), *RATES) if len(past) else RATES[0]
    tails = np.abs(live) > FAR_TAIL
    recent = 0.7 * share_before(tails, 32) + 0.3 * share_before(tails, 128)
    return np.maximum(usual / np.fmax(recent, usual), LEAST_WEIGHT)


def mixed_capital(gains: np.ndarray) -> np.ndarray:
    """Log of the mean capital of bets (rows) whose gains at each step are given."""
    return np.logaddexp.reduce(np.cumsum(np.log(np.maximum(gains, k.EPS)), axis=1), axis=0) - np.log(len(gains))


def conformal_bets(c: Context, weighted: bool) -> dict[str, np.ndarray]:
    """Log capitals of bets on the history ranks: tails, dispersion, same side as the last, both far out, and powers of the two-sided rank."""
    past, live = c.h["u"] - 0.5, c.o["u"] - 0.5
    if not len(live):
        return {}
    w = tail_weight(past, live) if weighted else np.ones(len(live))
    payoffs = {
        "tail": (lambda x, y: (np.abs(x) > TAIL) * 1.0, 1.0), "disp": (lambda x, y: x * x, 0.25), "dep": (lambda x, y: (x * y > 0) * 1.0, 1.0),
        "vc": (lambda x, y: ((np.abs(x) > APART) & (np.abs(y) > APART)) * 1.0, 1.0),
    }
    out = {}
    for name, (f, most) in payoffs.items():
        usual = f(past, np.concatenate(([0.0], past[:-1])))
        m = float(np.clip(usual.mean() if len(usual) else most / 2, 1e-3, most - 1e-3))
        stake = np.where(BETS > 0, BETS / m, BETS / (most - m))[:, None]
        out[f"{name}_log"] = mixed_capital(1 + stake * w * (f(live, np.concatenate((past[-1:], live[:-1]))) - m))
    p = np.clip(1 - 2 * np.abs(live), 1e-6, 1.0)
    sides = np.concatenate([POWERS[:, None] * v ** (POWERS[:, None] - 1) for v in (p, np.clip(1 - p, 1e-6, 1.0))])
    out["pow_log"] = mixed_capital(1 + w * (sides - 1))
    return out | {f"{name}_pk": np.maximum.accumulate(out[f"{name}_log"]) for name in ("tail", "disp", "pow")}


@register("m18_wctm", [f"wctm_{n}" for n in CTM])
def m18(c: Context) -> dict[str, np.ndarray]:
    return {f"wctm_{n}": v for n, v in conformal_bets(c, True).items()}


@register("m18_uctm", [f"uctm_{n}" for n in CTM])
def m18_unweighted(c: Context) -> dict[str, np.ndarray]:
    return {f"uctm_{n}": v for n, v in conformal_bets(c, False).items()}


def columns(modules: list[str]) -> list[str]:
    return [f"{m}__{c}" for m in modules for c in REGISTRY[m][0]]


def table(hist: np.ndarray, online: np.ndarray, modules: list[str]) -> np.ndarray:
    """All columns of the modules, a row for each; NaN where a value is missing or not finite."""
    return _table(Context(np.asarray(hist, float), np.asarray(online, float)), modules)


def _table(c: Context, modules: list[str]) -> np.ndarray:
    out = np.full((sum(len(REGISTRY[m][0]) for m in modules), len(c.online)), np.nan, np.float32)
    at = 0
    with np.errstate(all="ignore"):
        for m in modules:
            got = REGISTRY[m][1](c)
            for name in REGISTRY[m][0]:
                if name in got:
                    out[at] = got[name]
                at += 1
    out[np.isinf(out)] = np.nan
    return out


def compute(hist: np.ndarray, online: np.ndarray, modules: list[str]) -> dict[str, np.ndarray]:
    return dict(zip(columns(modules), table(hist, online, modules), strict=True))


#: Online rows of the series that are taken together, if they are more than one.
TOGETHER_ROWS = 8192


def values_of(batches: Iterable[pa.RecordBatch], column: str = "x") -> Iterator[tuple[pa.Scalar, np.ndarray]]:
    """(series_id, values) from batches sorted by series and place; a series may go on in the next batch."""
    held, parts = None, []
    for b in batches:
        if not b.num_rows:
            continue
        runs, x, begin = pc.run_end_encode(b.column("series_id")), b.column(column).to_numpy(zero_copy_only=False), 0
        for key, end in zip(runs.values, runs.run_ends.to_pylist(), strict=True):
            if parts and not key.equals(held):
                yield held, np.concatenate(parts)
                parts = []
            held, begin = key, parts.append(x[begin:end]) or end
    if parts:
        yield held, np.concatenate(parts)


def tables(batches: Iterable[pa.RecordBatch], n_hist: int, modules: list[str], rows: int = TOGETHER_ROWS) -> Iterator[pa.RecordBatch]:
    """The columns of all online rows, from batches sorted by series and place, a batch for about ``rows`` rows."""
    keys: list[pa.Scalar] = []
    series: list[Context] = []

    def batch() -> pa.RecordBatch:
        for name in modules:
            if name in TOGETHER:
                TOGETHER[name](series)
        n = [len(c.online) for c in series]
        whole = np.concatenate([_table(series.pop(0), modules) for _ in n], axis=1)
        key = pa.array([v.as_py() for v in keys], keys[0].type).take(pa.array(np.repeat(np.arange(len(n)), n)))
        keys.clear()
        return pa.RecordBatch.from_arrays([key, pa.array(np.concatenate([np.arange(m) for m in n])), *[pa.array(v, from_pandas=True) for v in whole]], ["series_id", "t", *columns(modules)])

    waiting = 0
    for key, x in values_of(batches):
        if len(x) <= n_hist or n_hist < 10:
            continue
        keys.append(key)
        series.append(Context(*np.split(x.astype(float), [n_hist])))
        waiting += len(x) - n_hist
        if waiting >= rows:
            yield batch()
            waiting = 0
    if series:
        yield batch()


def features(obs: DataFrame, n_hist: int, modules: list[str], spread: bool = True) -> DataFrame:
    """(series_id, t, module columns) for every online row of ``obs`` (series_id, i, x): one shuffle (none without ``spread``, for rows that are spread by series already), one pass a series;
    several series to a batch where a module takes them together."""
    names = columns(modules)
    schema = T.StructType([T.StructField("series_id", obs.schema["series_id"].dataType), T.StructField("t", T.LongType()), *[T.StructField(n, T.FloatType()) for n in names]])
    rows = obs.select("series_id", "i", "x")
    rows = spread_evenly(rows) if spread else rows
    if any(name in TOGETHER for name in modules):
        return rows.sortWithinPartitions("series_id", "i").select("series_id", "x").mapInArrow(lambda batches: tables(batches, n_hist, modules), schema)

    def run(group: pa.Table) -> pa.Table:  # Arrow alone: a frame costs time for every column of every series
        place = group["i"].to_numpy()
        x = group["x"].to_numpy().astype(float)[np.argsort(place, kind="stable")]
        n = len(x) - n_hist if len(x) > n_hist and n_hist >= 10 else 0
        got = table(x[:n_hist], x[n_hist:], modules) if n else np.zeros((len(names), 0), np.float32)
        return pa.Table.from_arrays([group["series_id"].slice(0, n), pa.array(np.arange(n, dtype=np.int64)), *[pa.array(v, from_pandas=True) for v in got]], ["series_id", "t", *names])

    return rows.groupBy("series_id").applyInArrow(run, schema)
