"""Kernels for truly sequential steps: plain numpy over one series, run by grouped functions of Spark."""

from __future__ import annotations

import numpy as np


class Mama:
    """Ehlers' adaptive average and the one that follows it, of a series that comes in parts; NaN for its first 32 values, in which the
    cycle settles.

    Prices are smoothed, detrended and turned into an in-phase and a quadrature part by Hilbert transforms whose gain follows the
    last period; the share of a new value is ``fast`` over the phase's change, in degrees, and ``slow`` at least."""

    def __init__(self, fast: float, slow: float):
        self.fast, self.slow, self.seen = fast, slow, 0
        self.before = [[0.0] * 7 for _ in range(5)]  # the last values, smooth, flat, i1 and q1; what was before the first counts as 0
        self.state = (0.0,) * 8  # period, re, im, phase, i2, q2, m, f

    def run(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both averages of the next part."""
        n = len(part)
        out, following = np.full(n, np.nan), np.full(n, np.nan)
        x, smooth, flat, i1, q1 = (v + more for v, more in zip(self.before, [part.tolist(), *([0.0] * n for _ in range(4))]))
        period, re, im, phase, i2, q2, m, f = self.state
        turned = lambda v, k: 0.0962 * v[k] + 0.5769 * v[k - 2] + -0.5769 * v[k - 4] + -0.0962 * v[k - 6]
        for k in range(7, n + 7):
            t = self.seen + k - 7
            if t < 3:
                m = f = x[k]
                continue
            smooth[k] = (4 * x[k] + 3 * x[k - 1] + 2 * x[k - 2] + x[k - 3]) / 10
            gain = 0.075 * period + 0.54
            flat[k] = gain * turned(smooth, k)
            q1[k] = gain * turned(flat, k)
            i1[k] = flat[k - 3]
            ji, jq = gain * turned(i1, k), gain * turned(q1, k)
            a, b = 0.2 * (i1[k] - jq) + 0.8 * i2, 0.2 * (q1[k] + ji) + 0.8 * q2
            re, im = 0.2 * (a * i2 + b * q2) + 0.8 * re, 0.2 * (a * q2 - b * i2) + 0.8 * im
            i2, q2, last = a, b, period
            if im and re:
                angle = float(np.degrees(np.arctan(im / re)))
                period = 360 / angle if angle else period
            period = min(max(min(max(period, 0.67 * last), 1.5 * last), 6.0), 50.0)
            period = 0.2 * period + 0.8 * last
            before, phase = phase, float(np.degrees(np.arctan(q1[k] / i1[k]))) if i1[k] else 0.0
            share = max(self.fast / max(before - phase, 1.0), self.slow)
            m += share * (x[k] - m)
            f += 0.5 * share * (m - f)
            if t >= 32:
                out[k - 7], following[k - 7] = m, f
        self.state, self.seen, self.before = (period, re, im, phase, i2, q2, m, f), self.seen + n, [v[-7:] for v in (x, smooth, flat, i1, q1)]
        return out, following


def mama(x: np.ndarray, fast: float, slow: float) -> tuple[np.ndarray, np.ndarray]:
    """As Mama, for a whole series."""
    return Mama(fast, slow).run(np.asarray(x, dtype=float))


def cusum_from(x: np.ndarray, h: float, valid: np.ndarray | None, up: float, down: float) -> tuple[np.ndarray, float, float]:
    """Symmetric CUSUM filter over the differences of x: 1 or -1 where a sum passes h, else 0, and the sums at the end; the first
    sample only serves the first difference. A missing difference emits 0 and resets nothing; a sample outside ``valid``, or after
    one, resets both sums."""
    out = np.zeros(max(0, len(x) - 1), dtype=np.int64)
    apart = np.zeros(len(out), bool) if valid is None else ~(valid[1:] & valid[:-1])
    values = x.tolist()
    for i, (before, value, reset) in enumerate(zip(values, values[1:], apart.tolist())):
        if reset:
            up = down = 0.0
            continue
        if value != value or before != before:
            continue
        up, down = max(0.0, up + value - before), min(0.0, down + value - before)  # in this order, which settles sums that are about h
        if up > h:
            out[i], up = 1, 0.0
        elif down < -h:
            out[i], down = -1, 0.0
    return out, up, down


def cusum(x: np.ndarray, h: float, valid: np.ndarray | None = None) -> np.ndarray:
    """As cusum_from(), for a whole series; its first sample emits 0."""
    return np.concatenate([np.zeros(min(1, len(x)), np.int64), cusum_from(x, h, valid, 0.0, 0.0)[0]])


def fracdiff_weights(d: float, n: int) -> np.ndarray:
    w = np.ones(n)
    for k in range(1, n):
        w[k] = -w[k - 1] * (d - k + 1) / k
    return w


def fracdiff(x: np.ndarray, d: float, n: int) -> np.ndarray:
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1 :] = np.convolve(x, fracdiff_weights(d, n), mode="valid")
    return out


def adf_windows(x: np.ndarray, w: int, order: int, trend: bool) -> np.ndarray:
    """t statistics of the lagged level in augmented Dickey-Fuller regressions with constant (and trend) over every window of w
    values, by its first place, all at once; NaN where the regression is singular or has no degree of freedom."""
    windows = np.lib.stride_tricks.sliding_window_view(x, w)
    d = np.diff(windows, axis=1)
    n = d.shape[1] - order
    p = 2 + trend + order
    out = np.full(len(windows), np.nan)
    if n <= p:
        return out
    for at in range(0, len(windows), 2_000):
        y, step = windows[at : at + 2_000], d[at : at + 2_000]
        y = y - y.mean(axis=1, keepdims=True)  # the statistic does not depend on it, its rounding does
        design = np.empty((len(y), n, p))
        design[:, :, 0], design[:, :, 1] = y[:, order:-1], 1
        if trend:
            design[:, :, 2] = np.arange(n) - (n - 1) / 2
        for k in range(1, order + 1):
            design[:, :, 1 + trend + k] = step[:, order - k : step.shape[1] - k]
        t = step[:, order:]
        g = design.transpose(0, 2, 1) @ design
        try:
            inverse = np.linalg.inv(g)
        except np.linalg.LinAlgError:
            inverse = np.stack([_inverse(m) for m in g])
        b = inverse @ (design.transpose(0, 2, 1) @ t[:, :, None])
        rest = t - (design @ b)[:, :, 0]
        s = inverse[:, 0, 0] * (rest**2).sum(1) / (n - p)
        with np.errstate(invalid="ignore", divide="ignore"):
            out[at : at + 2_000] = np.where(s > 0, b[:, 0, 0] / np.sqrt(s), np.nan)
    return out


def _inverse(m: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.inv(m)
    except np.linalg.LinAlgError:
        return np.full_like(m, np.nan)


def adf(y: np.ndarray, order: int, trend: bool) -> float:
    return float(adf_windows(np.asarray(y, dtype=float), len(y), order, trend)[0])


class Moments:
    """Regressions over many windows of one series from running sums of products: a window's Gram matrix is the difference of two
    rows. Levels are taken from their mean and scaled, and time runs from -1 to 1, which the statistics don't depend on."""

    def __init__(self, x: np.ndarray, order: int, trend: bool):
        self.x, self.order, self.trend = x, order, trend
        x = (x - x.mean()) / (x.std() or 1.0)
        d = np.diff(x)
        n = len(d) - order  # equations, the first for x[order + 1]
        self.p = 2 + trend + order
        z = np.empty((max(0, n), self.p + 1))
        z[:, 0], z[:, 1] = x[order:-1], 1
        if trend:
            z[:, 2] = np.linspace(-1, 1, n)
        for k in range(1, order + 1):
            z[:, 1 + trend + k] = d[order - k : len(d) - k]
        z[:, self.p] = d[order:]
        self.sums = np.concatenate([np.zeros((1, self.p + 1, self.p + 1)), np.cumsum(z[:, :, None] * z[:, None, :], axis=0)])

    def statistics(self, w: int) -> np.ndarray:
        """As adf_windows(); where levels hardly differ within a window or its columns depend on each other, from the window itself."""
        n = w - 1 - self.order
        out = np.full(max(0, len(self.x) - w + 1), np.nan)
        if n <= self.p or not len(out):
            return out
        g = self.sums[n:] - self.sums[:-n]
        size = np.sqrt(np.maximum(np.diagonal(g, axis1=1, axis2=2), 0))
        with np.errstate(invalid="ignore", divide="ignore"):
            g = np.nan_to_num(g / size[:, :, None] / size[:, None, :])
            a, c, whole = g[:, : self.p, : self.p], g[:, : self.p, self.p], g[:, self.p, self.p]
            sure = np.abs(np.linalg.det(a)) > 1e-9
            inverse = np.linalg.inv(np.where(sure[:, None, None], a, np.eye(self.p)))
            b = (inverse @ c[:, :, None])[:, :, 0]
            rest = whole - (b * c).sum(1)
            out[:] = b[:, 0] / np.sqrt(inverse[:, 0, 0] * rest / (n - self.p))
        for i in np.flatnonzero(~sure | ~(rest > 1e-6)):
            out[i] = adf(self.x[i : i + w], self.order, self.trend)
        return out


def rank_of(share: float, n: int) -> int:
    """Place, from 0, of an order statistic among n sorted values."""
    return int(max(np.floor(share * n + 1), 2)) - 2


def sadf(x: np.ndarray, maxw: int, minw: int, order: int, trend: bool, mode: str = "quantile") -> tuple[np.ndarray, np.ndarray]:
    """Supremum ADF over windows of maxw to minw + 1 samples that end at each sample. quantile: the 0.92 order statistic and the
    spread between 0.99 and 0.85. max: the maximum, and its window's place from 0 (longest) to 1."""
    value, other = np.full(len(x), np.nan), np.full(len(x), np.nan)
    if len(x) < maxw:
        return value, other
    ends, moments = len(x) - maxw + 1, Moments(x, order, trend)
    s = np.column_stack([moments.statistics(w)[maxw - w :] for w in range(maxw, minw, -1)])
    s = np.where(np.isfinite(s), s, -np.inf)
    if mode == "max":
        best = s.argmax(1)
        value[maxw - 1 :] = s[np.arange(ends), best]
        other[maxw - 1 :] = np.where(np.isfinite(value[maxw - 1 :]), best / max(1, s.shape[1] - 1), np.nan)
    else:
        s = np.sort(s, axis=1)
        low, mid, high = (s[:, rank_of(p, s.shape[1])] for p in (0.85, 0.92, 0.99))
        with np.errstate(invalid="ignore"):
            value[maxw - 1 :], other[maxw - 1 :] = mid, high - low
    return np.where(np.isfinite(value), value, np.nan), np.where(np.isfinite(other), other, np.nan)


def since_start(x: np.ndarray, limit: float) -> np.ndarray:
    out, begun, i = np.zeros(len(x), dtype=np.int64), 0.0, 0
    while i < len(x):  # a session at a time
        begun = x[i]
        over = np.flatnonzero(x[i:] - begun > limit)
        end = i + int(over[0]) if len(over) else len(x)
        out[i:end] = (x[i:end] - begun).astype(np.int64)
        i = end
    return out
