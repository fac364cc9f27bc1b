"""Signal helpers in plain NumPy; each works on one array inside a task that Spark schedules."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

SR = 16_000


class BadAudio(ValueError):
    """A recording that cannot be decoded."""


def decode_wav(data: bytes, expected_sr: int = SR) -> np.ndarray:
    """First channel of a 16-bit PCM WAV as float32 in -1..1.

    Chunks are walked with odd sizes padded; a data chunk that claims more than there is is cut to what there is.
    """
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise BadAudio("not a RIFF/WAVE file")
    at, fmt = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            if len(body) < 16:
                raise BadAudio("short format chunk")
            fmt = struct.unpack_from("<HHIIHH", body)
            tag = struct.unpack_from("<H", body, 24)[0] if fmt[0] == 0xFFFE and len(body) >= 26 else fmt[0]
            if tag != 1 or fmt[5] != 16 or not fmt[1]:
                raise BadAudio("not 16-bit PCM")
            if fmt[2] != expected_sr:
                raise BadAudio(f"sample rate {fmt[2]}, expected {expected_sr}")
        elif name == b"data":
            if fmt is None:
                raise BadAudio("data before format")
            frame = 2 * fmt[1]
            return np.frombuffer(body[: len(body) // frame * frame], "<i2").reshape(-1, fmt[1])[:, 0].astype(np.float32) / 32768
        at += 8 + size + size % 2
    raise BadAudio("no data chunk")


def decode_pcm(pcm: bytes) -> np.ndarray:
    """16-bit little-endian samples as float32; an odd last byte is dropped."""
    return np.frombuffer(pcm[: len(pcm) // 2 * 2], "<i2").astype(np.float32) / 32768


def hz_to_mel(f):
    """Slaney's scale: linear below 1 kHz, logarithmic above."""
    f = np.asarray(f, float)
    return np.where(f < 1000, f * 3 / 200, 15 + 27 * np.log(np.maximum(f, 1e-9) / 1000) / np.log(6.4))


def mel_to_hz(m):
    m = np.asarray(m, float)
    return np.where(m < 15, m * 200 / 3, 1000 * np.exp(np.log(6.4) / 27 * (m - 15)))


def mel_edges(n_mels: int = 64, lo: float = 0.0, hi: float = SR / 2) -> np.ndarray:
    return mel_to_hz(np.linspace(hz_to_mel(lo), hz_to_mel(hi), n_mels + 2))


@lru_cache(4)
def mel_bank(sr: int = SR, n_fft: int = 1024, n_mels: int = 64) -> np.ndarray:
    """Triangular filters of equal area over the bins of an rFFT."""
    edges, bins = mel_edges(n_mels, 0, sr / 2), np.fft.rfftfreq(n_fft, 1 / sr)
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((bins - lo) / (mid - lo), (hi - bins) / (hi - mid))) * (2 / (hi - lo))


def logmel(x: np.ndarray, n_fft: int = 1024, hop: int = 512, n_mels: int = 64) -> np.ndarray:
    """(n_mels, frames) power in dB, frames centred on multiples of the hop (the edges padded with zeros)."""
    x = np.pad(np.asarray(x, float), n_fft // 2)
    frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
    return (10 * np.log10(np.maximum(mel_bank(n_fft=n_fft, n_mels=n_mels) @ power.T, 1e-10))).astype(np.float32)


def band_envelope(x: np.ndarray, sr: int = SR, lo: float = 500.0, hi: float = 5000.0, order: int = 4) -> np.ndarray:
    """Magnitude of the analytic signal of the band, filtered without phase shift.

    The squared magnitude of Butterworth filters of the order is applied to the spectrum, as filtering forth and
    back does; negative frequencies are set to zero.
    """
    n = len(x)
    spectrum, f = np.fft.fft(x), np.abs(np.fft.fftfreq(n, 1 / sr))
    with np.errstate(divide="ignore", over="ignore"):
        gain = 1 / (1 + (f / hi) ** (2 * order)) / (1 + (lo / np.maximum(f, 1e-12)) ** (2 * order))
    half = np.zeros(n)
    half[0] = 1
    half[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        half[n // 2] = 1
    return np.abs(np.fft.ifft(spectrum * gain * half))


def prominences(y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How far each peak stands above the higher of the lowest points between it and higher ground on either side."""
    out = []
    for p in at:
        left = np.flatnonzero(y[:p] > y[p])
        right = np.flatnonzero(y[p + 1 :] > y[p])
        a = left[-1] + 1 if len(left) else 0
        b = p + 1 + right[0] if len(right) else len(y)
        out.append(y[p] - max(y[a : p + 1].min(), y[p:b].min()))
    return np.array(out)


def envelope_peaks(x: np.ndarray, sr: int = SR, lo: float = 5.0, hi: float = 300.0, share: float = 0.1, top: int = 3) -> list[tuple[float, float]]:
    """(Hz, prominence) of the strongest peaks of the envelope's spectrum, most prominent first."""
    e = band_envelope(x, sr)
    e = (e - e.mean()) * np.hanning(len(e))
    y, f = np.abs(np.fft.rfft(e)), np.fft.rfftfreq(len(e), 1 / sr)
    keep = (f >= lo) & (f <= hi)
    y, f = y[keep], f[keep]
    if len(y) < 3 or y.max() <= 0:
        return []
    at = np.flatnonzero((y[1:-1] > y[:-2]) & (y[1:-1] >= y[2:])) + 1
    prom = prominences(y, at) if len(at) else np.zeros(0)
    best = [i for i in np.lexsort((at, -prom)) if prom[i] >= share * y.max()][:top]
    return [(float(f[at[i]]), float(prom[i])) for i in best]


def log_sweep(seconds: float, f0: float, f1: float, sr: int = SR, fade_s: float = 0.01) -> np.ndarray:
    """A sine that rises exponentially, faded in and out."""
    t = np.arange(int(round(seconds * sr))) / sr
    k = np.log(f1 / f0)
    x = np.sin(2 * np.pi * f0 * seconds / k * (np.exp(t / seconds * k) - 1))
    n = int(fade_s * sr)
    x[:n] *= np.linspace(0, 1, n)
    x[-n:] *= np.linspace(1, 0, n)
    return x


def align(recording: np.ndarray, reference: np.ndarray) -> tuple[int, float]:
    """(lag, peak): where the reference fits best, and its normalized correlation there (0..1)."""
    n = len(recording) + len(reference) - 1
    size = 1 << (n - 1).bit_length()
    c = np.fft.irfft(np.fft.rfft(recording, size) * np.conj(np.fft.rfft(reference, size)), size)
    usable = max(1, len(recording) - len(reference) + 1)
    energy = np.append(0, np.cumsum(np.asarray(recording, float) ** 2))
    m = min(len(reference), len(recording))
    local = energy[m : m + usable] - energy[:usable]
    norm = np.sqrt(np.maximum(local * (np.asarray(reference, float) ** 2).sum(), 1e-24))
    score = np.abs(c[:usable]) / norm
    score[local < 1e-6 * energy[-1]] = 0
    lag = int(np.argmax(score))
    return lag, float(min(1.0, score[lag]))


def mix_at_snr(clean: np.ndarray, noise: np.ndarray, snr_db: float, seed: int) -> np.ndarray:
    """Clean plus a seeded crop (or repetition) of noise at a level; a whole above 1 is brought to 0.99."""
    rng = np.random.default_rng(seed)
    if len(noise) < len(clean):
        noise = np.tile(noise, -(-len(clean) // len(noise)))
    at = int(rng.integers(0, len(noise) - len(clean) + 1))
    noise = noise[at : at + len(clean)].astype(float)
    pc, pn = float(np.mean(np.square(clean, dtype=float))), float(np.mean(noise**2))
    if pc == 0 or pn == 0:
        raise ValueError("no power to scale by")
    out = clean + noise * np.sqrt(pc / (10 ** (snr_db / 10) * pn))
    top = np.abs(out).max()
    return out * (0.99 / top) if top > 1 else out


def transfer(recording: np.ndarray, sweep: np.ndarray, sr: int = SR, seg: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(Hz, dB): cross spectrum over the sweep's own spectrum, averaged over half-overlapping segments."""
    n = min(len(recording), len(sweep))
    window = np.hanning(seg)
    cut = lambda x: np.lib.stride_tricks.sliding_window_view(np.asarray(x[:n], float), seg)[:: seg // 2] * window
    a, b = np.fft.rfft(cut(sweep), axis=1), np.fft.rfft(cut(recording), axis=1)
    h = np.abs((np.conj(a) * b).mean(axis=0)) / np.maximum((np.abs(a) ** 2).mean(axis=0), 1e-12)
    return np.fft.rfftfreq(seg, 1 / sr), 20 * np.log10(np.maximum(h, 1e-12))


def slice_windows(x: np.ndarray, size: int, hop: int) -> list[np.ndarray]:
    """Full windows only."""
    return [x[a : a + size] for a in range(0, len(x) - size + 1, hop)]
