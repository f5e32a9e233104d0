"""Arithmetic of sampled sound on numpy arrays, for use inside tasks: resampling, spectra, pitch, onsets, tempo."""

from __future__ import annotations

from math import ceil, gcd

import numpy as np

ZEROS = 32  # zero crossings of the resampling kernel on each side
NOTES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def half_width(rate: int, target: int) -> int:
    """Source samples on each side that one output sample of ``resampled`` needs."""
    return ceil(ZEROS * max(1.0, rate / target)) + 1


def resampled(x: np.ndarray, rate: int, target: int, first: int = 0, start: int | None = None, end: int | None = None) -> np.ndarray:
    """Output samples of times in [start, end) (source sample numbers; default: all of x), x[0] being source sample ``first``.

    A windowed sinc in polyphase form: output k stands at source time k * rate / target; what lies outside of x is
    silence. An output hangs on the source samples within ``half_width`` alone, so chunks with so much overlap give
    the same samples as the whole.
    """
    start, end = first if start is None else start, first + len(x) if end is None else end
    up, down = target // gcd(rate, target), rate // gcd(rate, target)
    if up == down:
        return np.asarray(x, float)[start - first : end - first]
    k = np.arange(-(-start * up // down), -(-end * up // down))
    whole, phase = np.divmod(k * down, up)
    cut, half = min(1.0, up / down), half_width(rate, target)
    taps = np.arange(-half, half + 1)
    t = taps[None, :] - np.arange(up)[:, None] / up  # of each phase, the distance of the taps
    window = np.where(np.abs(t) < half, 0.42 + 0.5 * np.cos(np.pi * t / half) + 0.08 * np.cos(2 * np.pi * t / half), 0.0)
    kernel = cut * np.sinc(cut * t) * window
    padded = np.concatenate([np.zeros(half), np.asarray(x, float), np.zeros(half + 1)])
    at = whole - first + half
    out = np.empty(len(k))
    for low in range(0, len(k), 1 << 14):
        some = slice(low, low + (1 << 14))
        places = at[some, None] + taps[None, :]
        inside = (places >= 0) & (places < len(padded))
        out[some] = (np.where(inside, padded[np.clip(places, 0, len(padded) - 1)], 0.0) * kernel[phase[some]]).sum(1)
    return out


def frames_of(x: np.ndarray, size: int, hop: int, centred: bool = True) -> np.ndarray:
    """Frames every ``hop``; centred: around their places, with silence before and after. One frame at least."""
    x = np.concatenate([np.zeros(size // 2), x, np.zeros(size // 2)]) if centred else x
    if len(x) < size:
        x = np.concatenate([x, np.zeros(size - len(x))])
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def power_spectra(x: np.ndarray, size: int = 2048, hop: int = 512) -> np.ndarray:
    """Power of the frequencies of each frame, under a periodic Hann window."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    return np.abs(np.fft.rfft(frames_of(x, size, hop) * window, axis=1)) ** 2


def flatness(x: np.ndarray) -> float:
    """Geometric over arithmetic mean of the power spectrum, averaged over frames: 1 for silence, small for tones."""
    p = np.maximum(power_spectra(x), 1e-10)
    return float((np.exp(np.log(p).mean(1)) / p.mean(1)).mean())


def frame_levels(x: np.ndarray, size: int = 2048, hop: int = 512) -> np.ndarray:
    return np.sqrt((frames_of(x, size, hop) ** 2).mean(1))


def mean_chroma(x: np.ndarray, rate: int) -> np.ndarray:
    """How strong the twelve pitch classes are, C first: frames are scaled by their strongest, then averaged."""
    p = power_spectra(x)
    f = np.fft.rfftfreq(2048, 1 / rate)
    known = (f > 60) & (f < min(5000, rate / 2))
    pitch = 69 + 12 * np.log2(f[known] / 440)
    near = np.rint(pitch).astype(int)
    weight = np.exp(-0.5 * ((pitch - near) / 0.25) ** 2)  # between two notes counts little
    chroma = np.zeros((len(p), 12))
    np.add.at(chroma.T, near % 12, (p[:, known] * weight).T)
    top = chroma.max(1, keepdims=True)
    return (chroma / np.where(top > 0, top, 1)).mean(0)


def key_centre(x: np.ndarray, rate: int) -> str:
    return NOTES[int(mean_chroma(x, rate).argmax())]


def onset_strength(x: np.ndarray, hop: int = 512) -> np.ndarray:
    """Rise of the logarithmic spectrum from frame to frame."""
    p = 10 * np.log10(np.maximum(power_spectra(x, 2048, hop), 1e-10))
    p = np.maximum(p, p.max() - 80)
    return np.concatenate([[0.0], np.maximum(np.diff(p, axis=0), 0.0).mean(1)])


def onsets(x: np.ndarray, rate: int, hop: int = 512) -> list[int]:
    """Frames that are the highest around them and stand out over the moving mean, 30 ms apart at least."""
    s = onset_strength(x, hop)
    s = s / s.max() if s.max() > 0 else s
    wide, near, last, out = max(1, round(0.1 * rate / hop)), max(1, round(0.03 * rate / hop)), -(10**9), []
    for k in range(len(s)):
        around, mean = s[max(0, k - near) : k + near + 1], s[max(0, k - wide) : k + wide + 1].mean()
        if s[k] > 0 and s[k] == around.max() and s[k] >= mean + 0.07 and k - last > near:
            out.append(k)
            last = k
    return out


def tempo(x: np.ndarray, rate: int, hop: int = 512) -> float:
    """Beats a minute: the lag of the strongest self-similarity of onsets, with a preference around 120; 0 without onsets."""
    s = onset_strength(x, hop)
    s = s - s.mean()
    if not np.abs(s).max() > 1e-9:
        return 0.0
    n = len(s)
    auto = np.fft.irfft(np.abs(np.fft.rfft(s, 2 * n)) ** 2)[:n]
    lag = np.arange(1, n)
    bpm = 60 * rate / hop / lag
    score = np.maximum(auto[1:], 0) * np.exp(-0.5 * np.log2(bpm / 120) ** 2)
    score[(bpm < 30) | (bpm > 320)] = 0
    if not score.any():
        return 0.0
    k = int(score.argmax())
    shift = 0.0
    if 0 < k < len(score) - 1:
        a, b, c = auto[k], auto[k + 1], auto[k + 2]
        shift = 0.5 * (a - c) / (a - 2 * b + c) if a - 2 * b + c < 0 else 0.0
    return float(60 * rate / hop / (lag[k] + np.clip(shift, -0.5, 0.5)))


def centroid(x: np.ndarray, rate: int) -> float:
    """The mean frequency by magnitude, averaged over frames."""
    m = np.sqrt(power_spectra(x))
    f = np.fft.rfftfreq(2048, 1 / rate)
    total = m.sum(1)
    return float(((m @ f) / np.where(total > 0, total, 1)).mean())


def pitch_track(x: np.ndarray, rate: int, low: float = 65.41, high: float = 2093.0, size: int = 2048, hop: int = 512, bar: float = 0.15) -> np.ndarray:
    """The fundamental of each frame in Hz, nan where it has none: the first dip of the normalised difference function under ``bar``, refined by a parabola."""
    frames = frames_of(x, size, hop)
    half = size // 2
    top = min(half - 1, int(rate / low) + 1)
    least = max(2, int(rate / high))
    spectrum = np.fft.rfft(frames, 2 * size, axis=1)
    head = np.fft.rfft(frames[:, :half], 2 * size, axis=1)
    cross = np.fft.irfft(spectrum * np.conj(head), axis=1)[:, : top + 1]
    squares = np.cumsum(np.concatenate([np.zeros((len(frames), 1)), frames**2], axis=1), axis=1)
    lags = np.arange(top + 1)
    energy = squares[:, lags + half] - squares[:, lags]
    d = np.maximum(energy[:, :1] + energy - 2 * cross, 0.0)
    total = np.cumsum(d[:, 1:], axis=1)
    normal = np.ones_like(d)
    normal[:, 1:] = d[:, 1:] * lags[1:] / np.where(total > 0, total, 1)
    out = np.full(len(frames), np.nan)
    for k in range(len(frames)):
        if energy[k, 0] < 1e-8:
            continue
        under = np.flatnonzero(normal[k, least:top] < bar)
        if not len(under):
            continue
        t = least + int(under[0])
        while t + 1 < top and normal[k, t + 1] < normal[k, t]:
            t += 1
        a, b, c = normal[k, t - 1], normal[k, t], normal[k, t + 1]
        shift = 0.5 * (a - c) / (a - 2 * b + c) if a - 2 * b + c > 0 else 0.0
        out[k] = rate / (t + np.clip(shift, -0.5, 0.5))
    return out
