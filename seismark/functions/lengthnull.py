"""Empirical nulls of a statistic by length: what break-free history gives for windows, or restarts, of some lengths, read at any length."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


def _quantile(v: np.ndarray, p: float) -> float:
    """Of sorted values, linearly interpolated."""
    at = p * (len(v) - 1)
    i = int(at)
    return float(v[i] + (at - i) * (v[min(i + 1, len(v) - 1)] - v[i]))


def deviation(v: np.ndarray) -> float:
    """The standard deviation, in the steps of ``v.std()`` without its checks."""
    d = v - np.add.reduce(v) / len(v)
    return math.sqrt(np.add.reduce(d * d) / len(v))


def finite(v: np.ndarray) -> np.ndarray:
    ok = np.isfinite(v)
    return v if ok.all() else v[ok]


def spread(v: np.ndarray, tails: bool = False, ordered: bool = False) -> tuple[float, float]:
    """(median, spread): the larger of the interquartile range over 1.349 and the standard deviation, or with ``tails`` the 5 to 95 % range over
    3.29 in its place; (0, 1) for fewer than 8 finite values where ``tails``, else from what there is."""
    if not ordered:
        v = np.sort(finite(v))
    if not len(v) or tails and len(v) < 8:
        return 0.0, 1.0
    other = (_quantile(v, 0.95) - _quantile(v, 0.05)) / 3.29 if tails else deviation(v)
    return _quantile(v, 0.5), max((_quantile(v, 0.75) - _quantile(v, 0.25)) / 1.349, other, 1e-12)


def spreads(v: np.ndarray, tails: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """``spread`` of sorted finite values along the last axis, for all rows at once."""
    n = v.shape[-1]
    if not n or tails and n < 8:
        return np.zeros(v.shape[:-1]), np.ones(v.shape[:-1])
    v = np.ascontiguousarray(v)

    def q(p: float) -> np.ndarray:
        i = int(p * (n - 1))
        return v[..., i] + (p * (n - 1) - i) * (v[..., min(i + 1, n - 1)] - v[..., i])

    if tails:
        other = (q(0.95) - q(0.05)) / 3.29
    else:
        d = v - (np.add.reduce(v, axis=-1) / n)[..., None]
        other = np.sqrt(np.add.reduce(d * d, axis=-1) / n)
    return q(0.5), np.maximum(np.maximum((q(0.75) - q(0.25)) / 1.349, other), 1e-12)


def strided(v: np.ndarray, most: int) -> np.ndarray:
    """Evenly spaced values, about ``most`` of them, always the same ones."""
    return v[:: max(1, len(v) // most)] if len(v) > most else v


@dataclass
class LengthNull:
    """Medians and spreads at some lengths, interpolated linearly over the log of the length (spreads as logs); with ``beyond`` the end
    segments go on past the first and the last length. ``samples``: the sorted null values at each length."""

    lengths: np.ndarray
    middle: np.ndarray
    scale: np.ndarray
    samples: list[np.ndarray]
    beyond: bool = False

    @classmethod
    def of(cls, values: Callable[[int], np.ndarray], lengths: np.ndarray, tails: bool = False, most: int | None = None, beyond: bool = False) -> LengthNull:
        """``values(w)``: the statistic over the history's windows of length w."""
        held = [finite(np.asarray(values(int(w)), float)) for w in lengths]
        held = [np.sort(strided(v, most) if most else v) for v in held]
        pairs = [spread(v, tails, ordered=True) for v in held]
        return cls(np.asarray(lengths, float), np.array([m for m, _ in pairs]), np.array([s for _, s in pairs]), held, beyond)

    @classmethod
    def many(cls, sums: np.ndarray, lengths: np.ndarray, most: int | None = None) -> list[LengthNull]:
        """Nulls of trailing means for several streams of one length at once, from their running sums (a row each; longer than any of ``lengths``): as ``of`` gives them one by one."""
        held, middle, scale = [], [], []
        for w in lengths.tolist():
            v = (sums[:, w:] - sums[:, :-w]) / w
            n = v.shape[1]
            v = np.sort(np.ascontiguousarray(v[:, :: max(1, n // most)] if most and n > most else v), axis=1)
            n = v.shape[1]
            d = v - (np.add.reduce(v, axis=1) / n)[:, None]
            sd = np.sqrt(np.add.reduce(d * d, axis=1) / n)

            def q(p: float, v=v, n=n) -> np.ndarray:
                i = int(p * (n - 1))
                return v[:, i] + (p * (n - 1) - i) * (v[:, min(i + 1, n - 1)] - v[:, i])

            held.append(v)
            middle.append(q(0.5))
            scale.append(np.maximum(np.maximum((q(0.75) - q(0.25)) / 1.349, sd), 1e-12))
        return [cls(np.asarray(lengths, float), np.array([m[r] for m in middle]), np.array([s[r] for s in scale]), [v[r] for v in held]) for r in range(len(sums))]

    @classmethod
    def stacked(cls, values: Callable[[int], np.ndarray], lengths: np.ndarray, tails: bool = False, beyond: bool = False) -> list[LengthNull]:
        """Nulls of several statistics at once: ``values(w)`` has a row for each, as ``of`` would get them one by one."""
        made = [np.asarray(values(int(w)), float) for w in lengths]
        if not all(np.isfinite(v).all() for v in made):
            return [cls.of(lambda w, r=r, made=dict(zip((int(w) for w in lengths), made, strict=True)): made[w][r], lengths, tails, None, beyond) for r in range(len(made[0]))]
        made = [np.sort(v, axis=1) for v in made]
        middle, scale = (np.stack(x, axis=1) for x in zip(*[spreads(v, tails) for v in made], strict=True))
        return [cls(np.asarray(lengths, float), middle[r], scale[r], [v[r] for v in made], beyond) for r in range(len(middle))]

    def _place(self, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """Logs of the null's lengths and of these, and the ends that some of these lie beyond."""
        x, at = np.log(self.lengths), np.log(np.maximum(np.asarray(length, float), 1.0))
        ends = ((0, (0, 1), at < x[0]), (-1, (-2, -1), at > x[-1])) if self.beyond and len(x) > 1 else ()
        return x, at, [e for e in ends if e[2].any()]

    @staticmethod
    def _read(place: tuple[np.ndarray, np.ndarray, list], y: np.ndarray) -> np.ndarray:
        x, at, ends = place
        out = np.interp(at, x, y)
        for end, (i, j), past in ends:
            out = np.where(past, y[end] + (y[j] - y[i]) / (x[j] - x[i]) * (at - x[end]), out)
        return out

    def _at(self, length: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self._read(self._place(length), y)

    def z(self, length: np.ndarray | float, v: np.ndarray, clip: float | None = None, place: tuple | None = None) -> np.ndarray:
        """``place``: what ``_place`` gave for these lengths, of a null of the same lengths."""
        place = self._place(length) if place is None else place
        out = (v - self._read(place, self.middle)) / np.exp(self._read(place, np.log(self.scale)))
        return np.minimum(np.maximum(out, -clip), clip) if clip else out

    @staticmethod
    def z_rows(nulls: list[LengthNull], length: np.ndarray, v: np.ndarray, clip: float | None = None, place: tuple | None = None) -> np.ndarray:
        """``z`` of a row for each of several nulls of the same lengths, in the same steps."""
        x, at, ends = nulls[0]._place(length) if place is None else place
        y = np.concatenate((np.array([null.middle for null in nulls]), np.log([null.scale for null in nulls])))
        if len(x) > 1:
            i = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
            read = ((y[:, 1:] - y[:, :-1]) / (x[1:] - x[:-1]))[:, i]
            read *= at - x[i]
            read += y[:, i]
            low, high = at < x[0], at >= x[-1]
            if low.any():
                read[:, low] = y[:, :1]
            if high.any():
                read[:, high] = y[:, -1:]
            for end, (a, b), past in ends:
                read = np.where(past, y[:, end, None] + ((y[:, b] - y[:, a]) / (x[b] - x[a]))[:, None] * (at - x[end]), read)
        else:
            read = np.repeat(y, len(at), axis=1)
        out = (v - read[: len(nulls)]) / np.exp(read[len(nulls) :])
        return np.minimum(np.maximum(out, -clip), clip) if clip else out

    def nearest(self, length: np.ndarray) -> np.ndarray:
        """The place of the nearest length, by ratio."""
        return np.abs(np.log(np.maximum(np.asarray(length, float), 1.0))[:, None] - np.log(self.lengths)).argmin(axis=1)

    def share_below(self, length: np.ndarray, v: np.ndarray, near: np.ndarray | None = None) -> np.ndarray:
        """Share of the null at the nearest length (by ratio) that lies below v; 1/2 where the null is empty. ``near``: what ``nearest`` gave for these lengths."""
        near = self.nearest(length) if near is None else near
        out = np.full(len(v), 0.5)
        for i in np.flatnonzero(np.bincount(near)):
            held, at = self.samples[i], near == i
            if len(held):
                out[at] = np.searchsorted(held, v[at], "left") / len(held)
        return out


#: Fewest restarts that make a null.
FEWEST = 8


def _paths(path: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], hist: np.ndarray, span: int, many: int, anchors: np.ndarray) -> list[np.ndarray]:
    """The statistics (sorted over the restarts; ... x anchors x restarts) of paths of ``span`` rows that begin at evenly spaced places."""
    places = np.unique(np.linspace(0, hist.shape[-1] - span, many).astype(int))
    return [np.sort(np.swapaxes(np.asarray(v), -1, -2), axis=-1) for v in path(hist[..., places[:, None] + np.arange(span)], anchors)]


def restarts(path: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], hist: np.ndarray, anchors: np.ndarray, span: int, many: int, least: int = 32) -> list | None:
    """The same recursion begun at ``many`` evenly spaced places of the history: ``path(segments, anchors)`` gives, for a row for each place, its statistics
    at the anchors, and each becomes a null by elapsed length. A history without room for ``many`` paths of ``span`` rows has places of its own for each anchor,
    over all of it: every anchor that FEWEST restarts reach has as many as there is room for. None for a history of fewer than ``least`` values.
    Several histories of one length (rows) give a list of nulls, one for each, for each statistic."""
    n = hist.shape[-1]
    if n < least:
        return None
    if n - span >= many - 1:
        anchors = anchors[anchors <= span] if (anchors <= span).any() else anchors[:1]
        got = _paths(path, hist, span, many, anchors)
        held, laws = [list(np.moveaxis(v, -2, 0)) for v in got], [spreads(v) for v in got]
    else:
        reached = anchors <= n - FEWEST + 1
        anchors = anchors[reached] if reached.any() else np.minimum(anchors[:1], n)
        held = [[v[..., 0, :] for v in of] for of in zip(*[_paths(path, hist, int(a), many, np.array([a])) for a in anchors], strict=True)]
        laws = [tuple(np.stack(x, axis=-1) for x in zip(*[spreads(v) for v in of], strict=True)) for of in held]
    null = lambda of, law, row: LengthNull(anchors.astype(float), law[0][row], law[1][row], [v[row] for v in of])
    return [null(of, law, ...) if hist.ndim == 1 else [null(of, law, r) for r in range(len(hist))] for of, law in zip(held, laws, strict=True)]
