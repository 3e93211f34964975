"""Sequential evidence of one series, in numpy: the detectors' paths over its history and its online values, and what the online paths are worth against the history's. Every
value is a recursion, a running sum or a rank of the series alone, so a series' columns come from one pass over it; ``operators.sequential`` spreads the series."""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np

#: Fixed values of the detector-path nulls: windows of the peak nulls, fewest samples of a null, burn-in, caps of the empirical surprise and of all, half-life of decayed peaks, lag of slopes.
PEAKS, LEAST, BURN, SURPRISE_CAP, CAP, HALF_LIFE, LAG = (32, 128, 512), 8, 64, 6.0, 12.0, 64, 16
TINY = 1e-12
#: Detectors by what is given of them: the whole pack, level and peak, the level alone, and the sign with a robust score.
FULL = ("cz50", "ce50", "sq50", "glz")
SMALL = ("cz25", "cz100", "ce25", "sq25", "phu", "phd", "srz", "gle")
LEVEL = ("cz50_up", "cz50_dn", "ce50_up", "ce50_dn", "sq50_up", "sq50_dn", "glz_mix")
ROBUST = {"ew8_z": "ew8", "ew32_z": "ew32", "ew128_z": "ew128", "ewv32_z": "ewv"}
DETS = (*FULL, *SMALL, *LEVEL, *ROBUST.values())
#: Reflected sums: allowance of each, over the rows z, z, z, e, e, v, v and z's distance from its running mean.
SUMS = {"cz50": 0.5, "cz25": 0.25, "cz100": 1.0, "ce50": 0.5, "ce25": 0.25, "sq50": 0.5, "sq25": 0.25, "ph": 0.5}
HALF_LIVES, HOT, MIX_CAP, DYADIC, SHIFT, EPS, FEWEST_AR = {"ew8": 8, "ew32": 32, "ew128": 128, "ewv": 32}, 2.0, 40.0, 9, 0.5, 1e-6, 30


def inputs(cents: np.ndarray, n_hist: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """z, AR(2) residual (the first two are 0), square, the square standardised by the history's, and the history's mean square; moments are exact sums of cents."""
    past = cents[:n_hist].tolist()
    n, s1, s2 = len(past), float(sum(past)), float(sum(c * c for c in past))
    z = (cents / 100.0 - s1 / n / 100.0) / max(math.sqrt(max((s2 - s1 * s1 / n) / max(n - 1, 1), 0.0)) / 100.0, 1e-9)
    x, a, b = z[2:n], z[1 : n - 1], z[: n - 2]
    aa, bb, ab, xa, xb = float(a @ a) + EPS * n, float(b @ b) + EPS * n, float(a @ b), float(x @ a), float(x @ b)
    det = aa * bb - ab * ab
    phi1, phi2 = (0.0, 0.0) if n < FEWEST_AR else ((xa * bb - xb * ab) / det, (xb * aa - xa * ab) / det)
    e = np.zeros(len(z))
    e[2:] = z[2:] - phi1 * z[1:-1] - phi2 * z[:-2]
    sq = z * z
    m_sq, s_sq = float(sq[:n].mean()), max(float(sq[:n].std()), 1e-9)
    return z, e, sq, (sq - m_sq) / s_sq, m_sq


def dyadic(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of running sums: the largest squared sum of the last 1, 2, 4 .. 512 values over twice their number, and the log of the mean of their exponentials."""
    n = c.shape[1]
    g = np.full((DYADIC + 1, *c.shape), -np.inf)
    for j in range(DYADIC + 1):
        w = 1 << j
        if w <= n:
            g[j, :, w - 1 :] = c[:, w - 1 :]
            g[j, :, w:] -= c[:, :-w]
            g[j, :, w - 1 :] = g[j, :, w - 1 :] ** 2 / (2.0 * w)
    count = np.minimum(np.floor(np.log2(np.arange(1, n + 1))) + 1, DYADIC + 1)
    capped = np.where(np.isneginf(g), MIX_CAP, np.minimum(g, MIX_CAP))  # a window that is not full yet counts at the cap, as in the SQL, whose least() passes over nulls
    return g.max(axis=0), np.log(np.exp(capped).sum(axis=0) / count + TINY)


def shiryaev_roberts(llr: list[float]) -> list[float]:
    """log R_t = l_t + log(1 + R_{t-1}), from R = 0."""
    grown = lambda r: r + math.log1p(math.exp(-r)) if r > 0 else math.log1p(math.exp(r))
    return list(accumulate(llr, lambda r, v: v + grown(r)))


def paths(z: np.ndarray, e: np.ndarray, sq: np.ndarray, v: np.ndarray, m_sq: float) -> tuple[np.ndarray, np.ndarray]:
    """A row for each of DETS, to nine decimals (values that differ only in the last bits of their sums tie), and the exponential means with their signs."""
    n = len(z)
    t1 = np.arange(1, n + 1)
    cz, ce = np.cumsum(z), np.cumsum(e)
    x, slack = np.stack((z, z, z, e, e, v, v, z - cz / t1)), np.array(list(SUMS.values()))[:, None]
    s = np.cumsum(np.concatenate((x - slack, -x - slack)), axis=1)
    s -= np.minimum(np.minimum.accumulate(s, axis=1), 0.0)
    made = {f"{name}_{d}": s[i + k * len(SUMS)] for k, d in enumerate(("up", "dn")) for i, name in enumerate(SUMS)}
    made |= {name: np.maximum(s[i], s[i + len(SUMS)]) for i, name in enumerate(SUMS)} | {"phu": made["ph_up"], "phd": made["ph_dn"]}
    (made["glz"], made["gle"]), (made["glz_mix"], _) = dyadic(np.stack((cz, ce)))
    made["srz"] = np.array(shiryaev_roberts((SHIFT * z - SHIFT * SHIFT / 2).tolist()))
    for name, half in HALF_LIVES.items():
        keep = 2 ** (-1 / half)
        took = ((1 - keep) * (sq if name == "ewv" else z)).tolist()
        made[name] = np.array(list(accumulate(took, lambda y, u, keep=keep: keep * y + u))) / (1 - keep**t1)
    made["ewv"] = np.log((made["ewv"] + EPS) / (m_sq + EPS))
    signed = np.stack([made[d] for d in ROBUST.values()])
    made |= {d: np.abs(made[d]) for d in ROBUST.values()}
    return np.round(np.stack([made[d] for d in DETS]), 9), signed


def samples(past: np.ndarray) -> list[dict[int, np.ndarray]]:
    """For each detector the sorted null samples by window: 0, the history's path after its burn-in, and for FULL its maxima over PEAKS rows. A null of under LEAST samples takes the
    window-0 samples instead, and those the whole path."""
    n = past.shape[1]
    burn = min(BURN, n // 4)
    level = np.sort(past[:, burn if n - burn >= LEAST else 0 :], axis=1)
    out, top, width, held = [{0: v} for v in level], past[: len(FULL)], 1, {}
    while width < PEAKS[-1] and 2 * width <= n:  # maxima of complete windows, by doubling
        top, width = np.maximum(top[:, width:], top[:, :-width]), 2 * width
        if width in PEAKS and n - width + 1 >= LEAST:
            held[width] = np.sort(top, axis=1)
    for i in range(len(FULL)):
        out[i] |= {w: held[w][i] if w in held else level[i] for w in PEAKS}
    return out


def rarity(null: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """-log10 of the mid-rank share of the null above x, at most SURPRISE_CAP, and how far x exceeds the null's largest sample."""
    n = len(null)
    tail = 1 - 0.5 * (np.searchsorted(null, x, "left") + np.searchsorted(null, x, "right")) / n
    return np.minimum(-np.log10(np.maximum(tail, 1 / (2 * n))), SURPRISE_CAP), np.maximum(x - null[-1], 0.0)


def lagged_change(x: np.ndarray) -> np.ndarray:
    out = np.full(x.shape, np.nan)
    out[..., LAG:] = x[..., LAG:] - x[..., :-LAG]
    return out


def columns(cents: np.ndarray, n_hist: int) -> dict[str, np.ndarray]:
    """The 60 columns of every online row, NaN where there is none; ``cents`` are a series' values in order, more than ``n_hist`` of them."""
    z, e, sq, v, m_sq = inputs(cents, n_hist)
    past, _ = paths(z[:n_hist], e[:n_hist], sq[:n_hist], v[:n_hist], m_sq)
    live, signed = paths(z[n_hist:], e[n_hist:], sq[n_hist:], v[n_hist:], m_sq)
    nulls = samples(past)
    n, m, full, row = live.shape[1], len(nulls[0][0]), len(FULL), {d: i for i, d in enumerate(DETS)}
    t = np.arange(n)
    level = np.stack([null[0] for null in nulls])
    q25, q50, q75, q99 = (level[:, min(int(at), m - 1), None] for at in (0.25 * m, m // 2, 0.75 * m, 0.99 * m))
    top = level[:, -1:]
    scale = np.maximum(np.maximum(q99 - q50, 0.1 * (top - q50)), 1e-3 * np.maximum(np.abs(q50), 1.0))
    peak = np.maximum.accumulate(live, axis=1)
    fade = math.log(2) / HALF_LIFE
    faded = np.exp(np.maximum.accumulate(np.log(np.maximum(live[:full], 0.0) + TINY) + t * fade, axis=1) - t * fade)
    ends = [0, *[min(n, math.isqrt(a * b)) for a, b in zip(PEAKS, PEAKS[1:], strict=False)], n]  # the window nearest to the rows seen by ratio

    def judged(i: int, asked: list[tuple[int, np.ndarray]]) -> np.ndarray:
        base, over = (np.concatenate(x) for x in zip(*[rarity(nulls[i][w], x) for w, x in asked], strict=True))
        return np.minimum(base + np.log1p(over / scale[i]), CAP)

    out = {f"{d}_cur": judged(row[d], [(0, live[row[d]])]) for d in (*FULL, *SMALL)} | {d: judged(row[d], [(0, live[row[d]])]) for d in LEVEL}
    for i, d in enumerate(FULL):
        out[f"{d}_pk"] = judged(i, [(w, peak[i, a:b]) for w, a, b in zip(PEAKS, ends, ends[1:], strict=False)])
        out[f"{d}_dpk"] = judged(i, [(PEAKS[1], faded[i])])
    x, full_scale = live[:full], scale[:full]
    since = (t - np.maximum.accumulate(np.where(x >= peak[:full], t, -1), axis=1)) / (t + 1)
    often = np.cumsum(x > q99[:full], axis=1) / (t + 1)
    slope = lagged_change(x) / (LAG * full_scale)
    slope = np.where(np.isnan(slope), CAP, np.clip(slope, -CAP, CAP))  # the cap where no row lies so far back, as in the SQL
    for name, got in (("tsp", since), ("per", often), ("slp", slope), ("rel", x / (peak[:full] + TINY))):
        out |= {f"{d}_{name}": got[i] for i, d in enumerate(FULL)}
    excess = np.minimum(np.log1p(np.maximum(peak - q99, 0.0) / scale), CAP)
    out |= {f"{d}_pkr": excess[row[d]] for d in SMALL}
    robust = np.clip((live - q50) / np.maximum((q75 - q25) / 1.349, 1e-9), -CAP, CAP)
    out |= {name: robust[row[d]] * np.sign(signed[k]) for k, (name, d) in enumerate(ROBUST.items())}
    ew32 = signed[1]
    size = np.abs(ew32)
    out |= {"ew32_pkrel": size / (np.maximum.accumulate(size) + TINY), "ew32_slp": lagged_change(ew32) / LAG}
    pools = np.stack([out[f"{d}_cur"] for d in (*FULL, *SMALL)])
    return out | {"xc_max_cur": pools.max(axis=0), "xc_n_hot": (pools > HOT).sum(axis=0) * 1.0, "xc_max_pk": np.stack([out[f"{d}_pk"] for d in FULL]).max(axis=0)}
