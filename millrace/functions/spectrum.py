"""Spectra of sample arrays, in NumPy, for whole Arrow batches at a time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Default bands in hertz, lower edge inclusive.
BANDS = ((0.0, 500.0), (500.0, 2000.0), (2000.0, 8000.0), (8000.0, 16000.0))
#: Bands from this edge on count as high frequency.
HIGH_HZ = 2000.0
#: A centred window whose samples are all this small has no spectrum.
SILENT = 1e-8


def spectral_names(bands: tuple[tuple[float, float], ...] = BANDS) -> list[str]:
    return [*[f"band_energy_{int(a)}_{int(b)}_hz" for a, b in bands], "spectral_centroid_hz", "spectral_bandwidth_hz", "high_frequency_energy_ratio"]


def spectral_block(x: np.ndarray, rates: np.ndarray, bands: tuple[tuple[float, float], ...] = BANDS) -> np.ndarray:
    """Features of windows of one length (rows of x); silent or rateless ones are all 0."""
    out = np.zeros((len(x), len(bands) + 3))
    n = x.shape[1]
    if n < 2 or not len(x):
        return out
    centred = x - x.mean(axis=1, keepdims=True)
    live = (rates > 0) & ~(np.abs(centred) <= SILENT).all(axis=1)
    power = np.abs(np.fft.rfft(centred * np.hanning(n), axis=1)) ** 2
    total = power.sum(axis=1)
    live &= ~(total <= 0)
    power, total, rates = power[live], total[live], rates[live]
    # Bin k lies at k / (n * step), with the step as 1 / rate.
    hz = np.arange(power.shape[1])[None, :] / (n * (1.0 / rates))[:, None]
    found = np.zeros((len(power), out.shape[1]))
    high = np.zeros(len(power))
    for k, (low, top) in enumerate(bands):
        band = np.where((hz >= low) & (hz < top), power, 0.0).sum(axis=1)
        found[:, k] = band / total
        if low >= HIGH_HZ:
            high += band
    centre = (hz * power).sum(axis=1) / total
    found[:, -3] = centre
    found[:, -2] = np.sqrt((np.square(hz - centre[:, None]) * power).sum(axis=1) / total)
    found[:, -1] = high / total
    out[live] = found
    return out


def spectral_table(flat: np.ndarray, sizes: np.ndarray, rates: np.ndarray, bands: tuple[tuple[float, float], ...] = BANDS) -> np.ndarray:
    """Features of windows of any lengths, given end to end; equal lengths go through one transform."""
    flat, rates = np.asarray(flat, dtype=float), np.asarray(rates, dtype=float)
    ends = np.cumsum(sizes)
    out = np.zeros((len(sizes), len(bands) + 3))
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        if n:
            out[at] = spectral_block(flat[(ends[at] - n)[:, None] + np.arange(n)], rates[at], bands)
    return out


@dataclass(frozen=True)
class SpectrogramConfig:
    frame_size: int = 128
    hop_size: int = 32
    eps: float = 1e-8
    normalize: bool = True


def padded(audio: np.ndarray, size: int) -> np.ndarray:
    """audio, with zeros at its end up to `size` samples."""
    return audio if len(audio) >= size else np.pad(audio, (0, size - len(audio)))


def frames(audio: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Whole frames only; what is left at the end is dropped."""
    if size <= 0 or hop <= 0:
        raise ValueError("frame and hop sizes must be positive.")
    if len(audio) < size:
        return np.zeros((0, size))
    return np.lib.stride_tricks.sliding_window_view(audio, size)[::hop]


def standardized(values: np.ndarray) -> np.ndarray:
    """Zero mean and unit population deviation over all values; zeros where they are all equal."""
    spread = float(np.std(values)) if values.size else 0.0
    return np.zeros_like(values) if spread == 0.0 else (values - np.mean(values)) / spread


def log_spectrogram(audio: np.ndarray, config: SpectrogramConfig = SpectrogramConfig()) -> np.ndarray:  # noqa: B008
    """ln(power + eps) by frequency (rows) and frame (columns); no mean is taken off."""
    audio = np.asarray(audio, dtype=float)
    if audio.ndim != 1:
        raise ValueError("Samples come as one row of numbers.")
    if not len(audio):
        return np.zeros((config.frame_size // 2 + 1, 0))
    cut = frames(padded(audio, config.frame_size), config.frame_size, config.hop_size)
    power = np.abs(np.fft.rfft(cut * np.hanning(config.frame_size), axis=1)) ** 2
    out = np.log(power + config.eps).T
    return standardized(out) if config.normalize else out


def spectrogram_table(flat: np.ndarray, sizes: np.ndarray, config: SpectrogramConfig = SpectrogramConfig()) -> list[np.ndarray]:  # noqa: B008
    """log_spectrogram of many arrays that lie one after the other in `flat`, each flattened by rows; equal lengths are transformed together."""
    ends = np.cumsum(sizes)
    out: list[np.ndarray] = [np.zeros(0)] * len(sizes)
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        block = flat[(ends[at] - size)[:, None] + np.arange(size)]
        if size < config.frame_size:
            block = np.pad(block, ((0, 0), (0, config.frame_size - size)))
        cut = np.lib.stride_tricks.sliding_window_view(block, config.frame_size, axis=1)[:, :: config.hop_size]
        power = np.abs(np.fft.rfft(cut * np.hanning(config.frame_size), axis=2)) ** 2
        logs = np.log(power + config.eps).transpose(0, 2, 1)
        for i, values in zip(at.tolist(), logs, strict=True):
            out[i] = (standardized(values) if config.normalize else values).reshape(-1)
    return out
