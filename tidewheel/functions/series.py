"""Numpy helpers for one series at a time: what is sequential or spectral. All are called inside Spark tasks."""

from __future__ import annotations

import math

import numpy as np

_STAT = {"max": np.max, "min": np.min, "mean": np.mean, "median": np.median}


def cascading_fill(x: np.ndarray, method: str, window: int, least: int = 1) -> np.ndarray:
    """NaNs get the statistic of the ``window`` values that end there, earlier fills included; only gaps are visited."""
    x = x.copy()
    for i in np.isnan(x).nonzero()[0]:
        seen = x[max(0, i - window + 1) : i + 1]
        seen = seen[~np.isnan(seen)]
        if len(seen) >= max(1, least):
            x[i] = _STAT[method](seen)
    return x


def normal_quantile(p: float) -> float:
    """Inverse of the normal distribution, by bisection on erf."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * (1 + math.erf(mid / math.sqrt(2))) < p else (lo, mid)
    return (lo + hi) / 2


def acf(x: np.ndarray, nlags: int) -> np.ndarray:
    """Biased autocorrelation of lags 0 … nlags, NaNs dropped."""
    x = x[~np.isnan(x)]
    d = x - x.mean() if len(x) else x
    total = float(d @ d)
    if not total:
        return np.full(nlags + 1, np.nan)
    return np.array([d[: len(d) - k] @ d[k:] / total if k < len(d) else np.nan for k in range(nlags + 1)])


def acf_widths(r: np.ndarray, n: int, alpha: float) -> np.ndarray:
    """Half-widths for lags 1 … by Bartlett's formula; n counts all rows."""
    var = np.r_[1.0, 1 + 2 * np.cumsum(r[1:-1] ** 2)] / n
    return normal_quantile(1 - alpha / 2) * np.sqrt(var)


def find_period(x: np.ndarray, nlags: int, alpha: float, order: int = 1) -> int | None:
    """First strict local maximum of the autocorrelation above the width listed for it."""
    n = len(x)
    nlags = min(nlags, n - 1)
    r = acf(x, nlags)
    width = acf_widths(r, n, alpha)
    for p in range(order, nlags + 1 - order):
        if p < len(width) and all(r[p] > r[p + i] and r[p] > r[p - i] for i in range(1, order + 1)) and r[p] > width[p]:
            return p
    return None


def seasonal(x: np.ndarray, period: int, mode: str = "additive") -> np.ndarray | None:
    """One period of the seasonal part of a classical decomposition with an extrapolated trend."""
    n = len(x)
    if period < 1 or 2 * period >= n:
        return None
    kernel = np.r_[0.5, np.ones(period - 1), 0.5] / period if period % 2 == 0 else np.ones(period) / period
    half = len(kernel) // 2
    trend = np.full(n, np.nan)
    trend[half : n - half] = np.convolve(x, kernel, "valid")
    known = (~np.isnan(trend)).nonzero()[0]
    near = min(period, len(known))
    for ends, fit in ((range(half), known[:near]), (range(n - half, n), known[-near:])):
        if len(fit) > 1:
            slope, base = np.polyfit(fit, trend[fit], 1)
            trend[list(ends)] = slope * np.array(list(ends)) + base
        else:
            trend[list(ends)] = trend[fit[0]]
    rest = x / trend if mode == "multiplicative" else x - trend
    phase = np.array([np.nanmean(rest[i::period]) for i in range(period)])
    return phase / phase.mean() if mode == "multiplicative" else phase - phase.mean()


def fft(x: np.ndarray, fs: float = 0, norm: bool = True, half: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions (or frequencies), amplitudes and phases; ``norm`` divides both by n."""
    n = len(x)
    z = np.fft.fft(x)
    at = np.fft.fftfreq(n, 1 / fs) if fs else np.arange(n, dtype=float)
    amplitude, phase = np.abs(z), np.angle(z)
    if norm:
        amplitude, phase = amplitude / n, phase / n
    keep = n // 2 if half else n
    return at[:keep], amplitude[:keep], phase[:keep]


def taper(name: str, n: int) -> np.ndarray:
    """Periodic window of length n."""
    k = 2 * np.pi * np.arange(n) / n
    return {"hann": 0.5 - 0.5 * np.cos(k), "hamming": 0.54 - 0.46 * np.cos(k), "boxcar": np.ones(n)}[name]


def stft(x: np.ndarray, fs: float = 1, window: str = "hann", nperseg: int = 256, noverlap: int | None = None, nfft: int | None = None, detrend: bool = False, onesided: bool = True, boundary: bool = True, padded: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies, times and the complex matrix (frequency x time) of a short-time transform."""
    nperseg = min(nperseg, len(x))
    noverlap = nperseg // 2 if noverlap is None else noverlap
    nfft, step = nfft or nperseg, nperseg - noverlap
    if boundary:
        x = np.r_[np.zeros(nperseg // 2), x, np.zeros(nperseg // 2)]
    if padded and (extra := (len(x) - nperseg) % step):
        x = np.r_[x, np.zeros(step - extra)]
    frames = np.lib.stride_tricks.sliding_window_view(x, nperseg)[::step]
    if detrend:
        frames = frames - frames.mean(1, keepdims=True)
    w = taper(window, nperseg)
    z = (np.fft.rfft if onesided else np.fft.fft)(frames * w, nfft, axis=1) / w.sum()
    f = np.fft.rfftfreq(nfft, 1 / fs) if onesided else np.fft.fftfreq(nfft, 1 / fs)
    t = (np.arange(len(frames)) * step + (0 if boundary else nperseg / 2)) / fs
    return f, t, z.T


def wavelet(name: str, points: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Sampled mother wavelet: ``morl``, ``mexh``, ``gausN`` or ``cgauN`` (N-th derivative of a complex Gaussian)."""
    lo, hi = (-8.0, 8.0) if name in ("morl", "mexh") else (-5.0, 5.0)
    t = np.linspace(lo, hi, points)
    if name == "morl":
        return t, np.cos(5 * t) * np.exp(-(t**2) / 2)
    if name == "mexh":
        return t, (1 - t**2) * np.exp(-(t**2) / 2) * 2 / (math.sqrt(3) * math.pi**0.25)
    order, linear = int(name.lstrip("cgaus")), 1j if name.startswith("cgau") else 0
    poly = np.array([1.0 + 0j])  # the N-th derivative is a polynomial times exp(-t^2 - i t)
    for _ in range(order):
        grown = np.zeros(len(poly) + 1, complex)
        grown[: len(poly)] += -linear * poly
        grown[1:] += -2 * poly
        grown[: len(poly) - 1] += poly[1:] * np.arange(1, len(poly))
        poly = grown
    psi = np.polyval(poly[::-1], t) * np.exp(-(t**2) - linear * t)
    psi = psi / math.sqrt(np.trapezoid(np.abs(psi) ** 2, t))
    return t, psi if linear else psi.real


def cwt(x: np.ndarray, scales: np.ndarray, name: str, dt: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (scale x time) and frequencies, by differences of convolutions with the integrated wavelet."""
    t, psi = wavelet(name)
    step = t[1] - t[0]
    integral = np.conj(np.cumsum(psi) * step)
    out = []
    for s in scales:
        j = (np.arange(s * (t[-1] - t[0]) + 1) / (s * step)).astype(int)
        part = integral[j[j < len(integral)]][::-1]
        c = -np.sqrt(s) * np.diff(np.convolve(x, part))
        cut = (len(c) - len(x)) / 2
        out.append(c[math.floor(cut) : len(c) - math.ceil(cut)] if cut > 0 else c[: len(x)])
    spectrum = np.abs(np.fft.fft(psi))[: len(psi) // 2]
    centre = np.argmax(spectrum[1:]) + 1
    return np.array(out), centre / (t[-1] - t[0]) / (np.asarray(scales) * dt)


def _ties(*columns: np.ndarray) -> int:
    """Pairs of rows that are equal in all columns."""
    n = np.unique(np.stack(columns), axis=1, return_counts=True)[1]
    return int((n * (n - 1) // 2).sum())


def inversions(rank: np.ndarray, weight: np.ndarray | None = None) -> int:
    """Pairs in which a greater whole number comes first, each as often as the product of its weights: bit by bit, in n log n."""
    total, order = 0, np.asarray(rank, np.int64)
    w = np.ones(len(order), np.int64) if weight is None else np.asarray(weight, np.int64)
    if w.astype(float).sum() > 3e9:  # products beyond 64 bits: Python's whole numbers
        w = w.astype(object)
    for b in range(int(order.max(initial=0)).bit_length() - 1, -1, -1):
        one, group = (order >> b & 1) * w, order >> (b + 1)  # within a group all higher bits are equal
        zero = order >> b & 1 == 0
        seen = np.cumsum(one)
        first = np.r_[True, group[1:] != group[:-1]]
        before = np.where(first, seen - one, 0)
        total += int(((seen - np.maximum.accumulate(before)) * w)[zero].sum())
        at = np.argsort(order >> b, kind="stable")
        order, w = order[at], w[at]
    return total


def kendall(x: np.ndarray, y: np.ndarray) -> float:
    """Tau-b in n log n: discordant pairs are the inversions of y in the order of x."""
    ok = ~(np.isnan(x) | np.isnan(y))
    x, y = x[ok], y[ok]
    n = len(x)
    pairs = n * (n - 1) // 2
    tx, ty = pairs - _ties(x) if n else 0, pairs - _ties(y) if n else 0
    if not tx or not ty:
        return math.nan
    rank = np.unique(y, return_inverse=True)[1]
    agree = tx + ty - pairs + _ties(x, y) - 2 * inversions(rank[np.lexsort((y, x))])
    return float(agree / math.sqrt(tx * ty))
