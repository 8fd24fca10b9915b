"""Numpy helpers against direct formulas and known signals."""

import math

import numpy as np

from tidewheel.functions import series as S


def test_acf_is_the_direct_sum():
    x = np.random.default_rng(1).normal(size=80)
    d = x - x.mean()
    want = [sum(d[t] * d[t + k] for t in range(80 - k)) / sum(d * d) for k in range(6)]
    assert np.allclose(S.acf(x, 5), want)
    width = S.acf_widths(S.acf(x, 5), 80, 0.05)
    assert abs(width[0] - 1.959964 / math.sqrt(80)) < 1e-6 and len(width) == 5


def test_periods_of_sines():
    t = np.arange(1000)
    assert S.find_period(np.sin(2 * np.pi * t / 100), 300, 0.05) == 100
    assert S.find_period(np.sin(2 * np.pi * t / 10), 300, 0.05) == 10
    s = S.seasonal(np.sin(2 * np.pi * t / 10) + 0.01 * t, 10)
    assert len(s) == 10 and np.allclose(s, np.sin(2 * np.pi * np.arange(10) / 10), atol=0.05)
    assert S.seasonal(np.arange(5.0), 3) is None


def test_fft_and_stft():
    t = np.arange(64)
    at, a, _ = S.fft(np.cos(2 * np.pi * 4 * t / 64))
    assert len(at) == 32 and a.argmax() == 4 and abs(a[4] - 0.5) < 1e-9
    f, times, z = S.stft(np.cos(2 * np.pi * 4 * t / 64), nperseg=32)
    assert z.shape == (len(f), len(times)) and f[np.abs(z[:, 2]).argmax()] == 1 / 16


def test_cwt_finds_the_scale():
    t = np.arange(512)
    c, f = S.cwt(np.cos(2 * np.pi * t / 16), np.arange(1, 40), "morl", 1.0)
    best = np.abs(c[:, 100:400]).mean(1).argmax()
    assert c.shape == (39, 512) and abs(f[best] - 1 / 16) < 0.01
    z, _ = S.cwt(np.cos(2 * np.pi * t / 16), np.arange(1, 8), "cgau8", 1.0)
    assert np.iscomplexobj(z)


def test_kendall_by_pairs():
    r = np.random.default_rng(3)
    x, y = r.integers(0, 6, 40).astype(float), r.integers(0, 6, 40).astype(float)
    pairs = [(np.sign(x[i] - x[j]), np.sign(y[i] - y[j])) for i in range(40) for j in range(i)]
    want = sum(a * b for a, b in pairs) / math.sqrt(sum(a != 0 for a, _ in pairs) * sum(b != 0 for _, b in pairs))
    assert abs(S.kendall(x, y) - want) < 1e-12


def test_cascading_fill_needs_enough_values():
    x = np.array([np.nan, 1, np.nan, np.nan])
    assert np.isnan(S.cascading_fill(x, "mean", 2, 2)[2]) and S.cascading_fill(x, "mean", 2)[3] == 1


def test_kendall_by_pairs():
    r = np.random.default_rng(3)
    for n, values in ((0, 3), (1, 3), (2, 2), (60, 5), (300, 1000)):
        x, y = r.integers(0, values, n).astype(float), r.integers(0, values, n).astype(float)
        if n > 10:
            y[3] = np.nan
        ok = ~np.isnan(y)
        a, b = np.sign(x[ok][:, None] - x[ok]), np.sign(y[ok][:, None] - y[ok])
        total = np.sqrt((a != 0).sum() * (b != 0).sum())
        got = S.kendall(x, y)
        assert np.isnan(got) if not total else np.isclose(got, (a * b).sum() / total)
    big = r.normal(size=100_000)
    assert abs(S.kendall(big, big) - 1) < 1e-12 and abs(S.kendall(big, -big) + 1) < 1e-12
