"""Numeric kernels on whole series, numpy inside Arrow batches: spectra, autocorrelation, resampling, filters.

``per_series`` applies a kernel to the ``samples`` of every row and returns ``values`` instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, floor, gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Kernel = Callable[[np.ndarray], np.ndarray]


def per_series(series: DataFrame, kernel: Kernel) -> DataFrame:
    """The columns of ``series`` with ``samples`` replaced by ``values``, the kernel's result as an array of doubles."""
    keys = [f for f in series.schema.fields if f.name != "samples"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[[f.name for f in keys]].copy()
            out["values"] = [np.asarray(kernel(np.asarray(x, np.float64)), np.float64) for x in batch["samples"]]
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys) + ", `values` array<double>"
    return series.mapInPandas(run, schema)


def cosine_window(n: int, a: float, *, periodic: bool) -> np.ndarray:
    """a - (1 - a) cos: Hann for a = 0.5, Hamming for a = 0.54."""
    if n == 1:
        return np.ones(1)
    return a - (1 - a) * np.cos(2 * np.pi * np.arange(n) / (n if periodic else n - 1))


def overlapping(x: np.ndarray, size: int, step: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, size)[::step]


def welch(x: np.ndarray, fs: float, nperseg: int) -> np.ndarray:
    """One-sided power density: periodic Hann windows with half overlap, each segment's mean removed."""
    size = min(nperseg, len(x))
    w = cosine_window(size, 0.5, periodic=True)
    parts = overlapping(x, size, size - size // 2)
    spectrum = np.abs(np.fft.rfft((parts - parts.mean(1, keepdims=True)) * w, axis=1)) ** 2 / (fs * (w**2).sum())
    spectrum[:, 1 : None if size % 2 else -1] *= 2
    return spectrum.mean(0)


def welch_kernel(fs: float, nperseg: int, *, normalize: bool = False) -> Kernel:
    def run(x: np.ndarray) -> np.ndarray:
        p = welch(x, fs, nperseg)
        return p / p.sum() if normalize and p.sum() > 0 else p

    return run


def half_starts(n: int, size: int) -> np.ndarray:
    """Starts of segments of ``size`` samples, half a segment apart, in the whole segments of ``n`` samples."""
    count = 2 * (n // size) - 1
    return np.ceil(np.arange(count) * size / 2).astype(int)


def median_psd(x: np.ndarray, fs: float) -> np.ndarray:
    """Decibel power at 1 to 100 Hz or up to half the rate: Hamming segments of a second, the median over them."""
    size = min(len(x), int(fs))
    nyquist = floor(fs / 2)
    bins = min(nyquist, 100)
    w = cosine_window(size, 0.54, periodic=False)
    parts = np.stack([x[s : s + size] * w for s in half_starts(len(x), size)])
    power = np.abs(np.fft.fft(parts, int(fs), axis=1)[:, 1 : bins + 1]) ** 2 * 2 / (fs * (w**2).sum())
    if bins == nyquist:
        power[:, -1] /= 2
    middle = np.median(power, 0)
    return 20 * np.log10(np.where(middle > 0, middle, np.nan))


def formatted_psd(p: np.ndarray, *, logscale: bool = True, normalize: bool = True) -> np.ndarray:
    """100 bins: the last one repeated, notches at 50 and 60 Hz filled from their neighbours, scaled to +-0.99.

    Bins without power take the least value there is.
    """
    p = np.where(np.isnan(p), np.nanmin(p) if not np.isnan(p).all() else 0.0, p)
    p = np.concatenate([p, np.full(max(0, 100 - len(p)), p[-1])])[:100]
    for b in (49, 59):
        gaps = (p[b - 1] - p[b], p[b + 1] - p[b]) if logscale else (p[b - 1] / max(p[b], 1e-300), p[b + 1] / max(p[b], 1e-300))
        if min(gaps) > (5 if logscale else 10 ** (5 / 20)):
            p[b] = (p[b - 1] + p[b + 1]) / 2
    if normalize:
        spread = np.ptp(p)
        p = ((p - p.min()) / spread * 2 - 1 if spread > 0 else np.zeros_like(p)) * 0.99
    return p.astype(np.float32)


def next_power_of_2(n: int) -> int:
    return 1 if n < 1 else 1 << (n - 1).bit_length()


def autocorrelation(x: np.ndarray, fs: float) -> np.ndarray:
    """100 values of the autocorrelation up to a second, lag 0 left out, times 0.99.

    Over five seconds of data it is the mean over half-overlapping segments of three seconds, each lag
    divided by the share of products it has; below, that of the whole, padded with zeros to a second.
    """
    rate = int(fs)
    if len(x) / fs > 5:
        size = min(len(x), 3 * rate)
        parts = np.stack([x[s : s + size] for s in half_starts(len(x), size)])
        n_fft = next_power_of_2(2 * size - 1)
        ac = np.fft.irfft((np.abs(np.fft.rfft(parts, n_fft, axis=1)) ** 2).mean(0), n_fft)
        share = np.append(np.arange(size, size - rate, -1), max(1, size - rate)) / size
        ac = ac[: rate + 1] / (ac[0] if ac[0] else 1.0) / share
    else:
        n_fft = next_power_of_2(2 * len(x) - 1)
        ac = np.fft.irfft(np.abs(np.fft.rfft(x, n_fft)) ** 2, n_fft)[: min(len(x), rate + 1)]
        ac = np.concatenate([ac, np.zeros(rate + 1 - len(ac))]) / (ac[0] if ac[0] else 1.0)
    out = resampled(ac, 100, rate)
    if len(out) < 101:
        out = np.concatenate([out, np.full(101 - len(out), out[-1])])
    return (out[1:101] * 0.99).astype(np.float32)


def features(x: np.ndarray, fs: float, *, use_autocorr: bool = True) -> np.ndarray:
    """100 values of the formatted spectrum and 100 of the autocorrelation."""
    p = formatted_psd(median_psd(x, fs))
    return np.concatenate([p, autocorrelation(x, fs)]) if use_autocorr else p


def feature_kernel(fs: float, *, use_autocorr: bool = True) -> Kernel:
    return lambda x: features(x, fs, use_autocorr=use_autocorr)


def lowpass(up: int, down: int) -> np.ndarray:
    """A Kaiser-windowed (beta 5) low-pass filter of 20 max(up, down) + 1 taps, with a gain of ``up``."""
    most = max(up, down)
    at = np.arange(-10 * most, 10 * most + 1)
    h = np.sinc(at / most) / most * np.kaiser(len(at), 5.0)
    return h / h.sum() * up


def resampled(x: np.ndarray, up: int, down: int, *, smooth_ends: bool = False) -> np.ndarray:
    """Polyphase resampling by up / down in lowest terms to ceil(n up / down) samples.

    With ``smooth_ends`` the line through the first and last two samples goes on beyond the ends, else zeros.
    """
    common = gcd(up, down)
    up, down = up // common, down // common
    n_out = ceil(len(x) * up / down)
    if up == down:
        return x.copy()
    h = lowpass(up, down)
    half = len(h) // 2
    pad = ceil(half / up) + 1
    left = right = np.zeros(pad)
    if smooth_ends and len(x) > 1:
        left = x[0] - (x[1] - x[0]) * np.arange(pad, 0, -1)
        right = x[-1] + (x[-1] - x[-2]) * np.arange(1, pad + 1)
    wide = np.concatenate([left, x, right])
    # output m sits at m * down of the up-sampled grid; only every up-th tap meets a sample
    place = np.arange(n_out) * down + pad * up
    first = -(-(place - half) // up)
    reach = np.arange(2 * half // up + 1)
    source = first[:, None] + reach
    tap = place[:, None] - source * up + half
    valid = (tap >= 0) & (tap < len(h)) & (source >= 0) & (source < len(wide))
    return (np.where(valid, wide[np.clip(source, 0, len(wide) - 1)], 0.0) * np.where(valid, h[np.clip(tap, 0, len(h) - 1)], 0.0)).sum(1)


def causal(x: np.ndarray, taps: list[float] | np.ndarray) -> np.ndarray:
    return np.convolve(x, taps)[: len(x)]


def centered(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Convolution of the length of the longer one, centred: the older variant of filtering."""
    return np.convolve(x, taps, mode="same")


def impulse_response(frequency: np.ndarray) -> np.ndarray:
    """2 (m - 1) taps of a real one-sided response of m values."""
    return np.fft.irfft(frequency)


def spectral_filtering(x: np.ndarray, magnitude: list[float] | np.ndarray, *, kind: str = "causal", pad_frac: float = 0.5) -> np.ndarray:
    """Filtering by a magnitude response: causal once, or zero-phase forward and back with its root; zeros in front."""
    magnitude = np.asarray(magnitude, float)
    front = int(len(x) * pad_frac)
    padded = np.concatenate([np.zeros(front), x])
    if kind == "causal":
        return causal(padded, impulse_response(magnitude))[front:]
    if kind == "zero-phase":
        taps = impulse_response(np.sqrt(magnitude))
        return causal(causal(padded, taps)[::-1], taps)[::-1][front:]
    raise ValueError(f"no filter {kind!r}")
