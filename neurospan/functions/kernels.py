"""Numerical kernels on channel-by-time arrays, in numpy: filters, spectra, phase and directed measures."""

from __future__ import annotations

import numpy as np


def butter_bandpass(order: int, lo: float, hi: float, sfreq: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a digital Butterworth band-pass, by the bilinear transform."""
    if not 0 < lo < hi < sfreq / 2:
        raise ValueError(f"band {lo}-{hi} doesn't fit a sampling rate of {sfreq}")
    w1, w2 = 2 * sfreq * np.tan(np.pi * np.array([lo, hi]) / sfreq)
    width, centre = w2 - w1, np.sqrt(w1 * w2)
    proto = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)) * width / 2
    root = np.sqrt(proto * proto - centre * centre)
    poles = np.concatenate([proto + root, proto - root])
    fs2 = 2 * sfreq
    z_poles = (fs2 + poles) / (fs2 - poles)
    gain = np.real(width**order * fs2**order / np.prod(fs2 - poles))
    return gain * np.poly(np.concatenate([np.ones(order), -np.ones(order)])), np.real(np.poly(z_poles))


def lfilter(b: np.ndarray, a: np.ndarray, x: np.ndarray, zi: np.ndarray) -> np.ndarray:
    """Direct form II transposed over the last axis of a (channels, samples) array."""
    out, z = np.empty_like(x), zi.copy()
    for t in range(x.shape[1]):
        v = x[:, t]
        y = b[0] * v + z[:, 0]
        z[:, :-1] = z[:, 1:]
        z[:, -1] = 0
        z += np.outer(v, b[1:]) - np.outer(y, a[1:])
        out[:, t] = y
    return out


def steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Filter state that answers a constant input of 1 with a constant output."""
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[0] = -a[1:]
    companion[1:, :-1] += np.eye(n - 1)
    return np.linalg.solve(np.eye(n) - companion.T, b[1:] - a[1:] * b[0])


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward filtering with odd extension at both ends; too short a signal is an error."""
    pad = 3 * max(len(a), len(b))
    if x.shape[1] <= pad:
        raise ValueError(f"{x.shape[1]} samples are too few for padding of {pad}")
    ext = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], 1)
    zi = steady_state(b, a)
    y = lfilter(b, a, ext, np.outer(ext[:, 0], zi))[:, ::-1]
    y = lfilter(b, a, y, np.outer(y[:, 0], zi))[:, ::-1]
    return y[:, pad:-pad]


def analytic(x: np.ndarray) -> np.ndarray:
    """Analytic signal: negative frequencies removed."""
    n = x.shape[1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=1) * gain, axis=1)


def band_analytic(x: np.ndarray, lo: float, hi: float, sfreq: float) -> np.ndarray:
    return analytic(zero_phase(*butter_bandpass(4, lo, hi, sfreq), x))


def phase_metrics(z: np.ndarray) -> dict[str, np.ndarray]:
    """PLV, PLI, wPLI and debiased wPLI of all pairs, from one cross product a sample."""
    u = z / np.where(np.abs(z) > 0, np.abs(z), 1)
    n, t = z.shape
    plv = np.abs(u @ u.conj().T) / t
    out = {"plv": plv, **{k: np.zeros((n, n)) for k in ("pli", "wpli", "dwpli")}}
    for i in range(n):
        im = np.imag(z[i] * z[i + 1 :].conj())
        size, total, square = np.abs(im).sum(1), im.sum(1), (im * im).sum(1)
        out["pli"][i, i + 1 :] = np.abs(np.sign(im).mean(1))
        out["wpli"][i, i + 1 :] = np.divide(np.abs(total), size, out=np.zeros(n - i - 1), where=size > 0)
        rest = size * size - square
        out["dwpli"][i, i + 1 :] = np.divide(total * total - square, rest, out=np.zeros(n - i - 1), where=rest > 0)
    for k in ("pli", "wpli", "dwpli"):
        out[k] += out[k].T
    np.fill_diagonal(plv, 1)
    return out


def cross_spectra(x: np.ndarray, sfreq: float, segment: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and Welch cross spectra (freq, i, j): Hann windows, half overlap, segment means removed."""
    size = min(segment, x.shape[1])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    starts = range(0, x.shape[1] - size + 1, max(size - size // 2, 1))
    spectra = []
    for s in starts:
        part = x[:, s : s + size]
        spectra.append(np.fft.rfft((part - part.mean(1, keepdims=True)) * window, axis=1))
    f = np.stack(spectra)
    scale = 1 / (sfreq * (window * window).sum() * len(f))
    csd = np.einsum("sif,sjf->fij", f.conj(), f) * scale
    csd[1 : None if size % 2 else -1] *= 2
    return np.fft.rfftfreq(size, 1 / sfreq), csd


def coherence_metrics(x: np.ndarray, lo: float, hi: float, sfreq: float, segment: int = 256) -> dict[str, np.ndarray]:
    """Magnitude-squared and imaginary coherence, means over the closed band."""
    freqs, csd = cross_spectra(x, sfreq, segment)
    csd = csd[(freqs >= lo) & (freqs <= hi)]
    auto = np.real(np.einsum("fii->fi", csd))
    norm = auto[:, :, None] * auto[:, None, :]
    safe = np.where(norm > 0, norm, 1)
    coh, icoh = (np.abs(csd) ** 2 / safe).mean(0), np.abs(np.imag(csd / np.sqrt(safe))).mean(0)
    np.fill_diagonal(coh, 1), np.fill_diagonal(icoh, 0)
    return {"coherence": coh, "icoh": icoh}


def correlate(x: np.ndarray) -> np.ndarray:
    d = x - x.mean(1, keepdims=True)
    sd = np.sqrt((d * d).sum(1))
    safe = np.where(sd > 0, sd, 1)
    return (d / safe[:, None]) @ (d / safe[:, None]).T


def envelope_metrics(z: np.ndarray) -> dict[str, np.ndarray]:
    """Envelope correlation, and that of both mutually orthogonalised signals."""
    n = len(z)
    aec, orth = correlate(np.abs(z)), np.zeros((n, n))
    np.fill_diagonal(aec, 1)
    x = np.real(z)
    power = (x * x).sum(1)
    for i in range(n):
        for j in range(i + 1, n):
            shared = x[i] @ x[j]
            a = x[i] - (shared / power[j] if power[j] else 0) * x[j]
            b = x[j] - (shared / power[i] if power[i] else 0) * x[i]
            orth[i, j] = orth[j, i] = correlate(np.abs(analytic(np.stack([a, b]))))[0, 1]
    return {"aec": aec, "aec_orth": orth}


def partial_correlation(x: np.ndarray) -> np.ndarray:
    """From the inverse correlation matrix, diagonal 1; the plain correlation where that is singular."""
    r = correlate(x)
    np.fill_diagonal(r, 1)
    if np.linalg.matrix_rank(r) < len(r):
        return r
    p = np.linalg.inv(r)
    d = np.sqrt(np.diag(p))
    out = -p / np.outer(d, d)
    np.fill_diagonal(out, 1)
    return out


def fit_mvar(x: np.ndarray, order: int = 10) -> np.ndarray:
    """Coefficients (order, channel, channel) of a vector autoregression, by least squares."""
    n, t = x.shape
    if t <= order * (n + 1):
        return np.repeat(np.eye(n)[None] / order, order, 0)
    x = x - x.mean(1, keepdims=True)
    lags = np.concatenate([x[:, order - k - 1 : t - k - 1] for k in range(order)])
    coef, *_ = np.linalg.lstsq(lags.T, x[:, order:].T, rcond=None)
    return coef.T.reshape(n, order, n).transpose(1, 0, 2)


def directed_metrics(a: np.ndarray, lo: float, hi: float, sfreq: float, n_freqs: int = 256) -> dict[str, np.ndarray]:
    """PDC and DTF from row i to column j, means over the closed band; singular frequencies count as 0."""
    order, n, _ = a.shape
    freqs = np.linspace(0, sfreq / 2, n_freqs)
    freqs = freqs[(freqs >= lo) & (freqs <= hi)]
    pdc, dtf = np.zeros((n, n)), np.zeros((n, n))
    for f in freqs:
        m = np.eye(n) - np.einsum("k,kij->ij", np.exp(-2j * np.pi * f / sfreq * np.arange(1, order + 1)), a)
        size = np.sqrt((np.abs(m) ** 2).sum(0))
        pdc += (np.abs(m) / np.where(size > 0, size, 1)).T
        if np.linalg.cond(m) < 1e12:
            h = np.abs(np.linalg.inv(m)) ** 2
            dtf += (h / h.sum(1, keepdims=True)).T
    out = {"pdc": pdc / max(len(freqs), 1), "dtf": dtf / max(len(freqs), 1)}
    for v in out.values():
        np.fill_diagonal(v, 0)
    return out


def wavelet(f: float, sfreq: float, cycles: float = 7.0) -> np.ndarray:
    """The complex Morlet wavelet of a frequency, of unit energy."""
    sigma = cycles / (2 * np.pi * f)
    t = np.arange(0, 5 * sigma, 1 / sfreq)
    t = np.concatenate([-t[:0:-1], t])
    w = np.exp(2j * np.pi * f * t) * np.exp(-(t**2) / (2 * sigma**2))
    return w / (np.sqrt(0.5) * np.linalg.norm(w))


def morlet_power(x: np.ndarray, freqs: np.ndarray, sfreq: float, cycles: float = 7.0) -> np.ndarray:
    """(channel, freq, time) power of complex Morlet wavelets of unit energy."""
    out = np.empty((len(x), len(freqs), x.shape[1]))
    for k, f in enumerate(freqs):
        w = wavelet(f, sfreq, cycles)
        size = x.shape[1] + len(w) - 1
        full = np.fft.ifft(np.fft.fft(x, size, axis=1) * np.fft.fft(w, size), axis=1)
        start = (len(w) - 1) // 2
        out[:, k] = np.abs(full[:, start : start + x.shape[1]]) ** 2
    return out


def fir(lo: float | None, hi: float | None, sfreq: float, taps: int) -> np.ndarray:
    """Hamming-windowed linear-phase filter: high-pass, low-pass or band-pass by the edges given."""
    if max(lo or 0, hi or 0) >= sfreq / 2:
        raise ValueError("an edge lies at or above the Nyquist frequency")
    taps += 1 - taps % 2
    k = np.arange(taps) - taps // 2
    low = lambda f: 2 * f / sfreq * np.sinc(2 * f / sfreq * k) * np.hamming(taps)
    unit = lambda h: h / h.sum()
    delta = (k == 0).astype(float)
    if lo and hi:
        return unit(low(hi)) - unit(low(lo))
    return unit(low(hi)) if hi else delta - unit(low(lo)) if lo else delta


def quadrature(lo: float, hi: float, sfreq: float, taps: int) -> tuple[np.ndarray, np.ndarray]:
    """A band-pass filter and its partner a quarter of a period behind: together they give the band's analytic signal."""
    low = fir(None, (hi - lo) / 2, sfreq, taps)
    turn = np.exp(2j * np.pi * (lo + hi) / 2 / sfreq * (np.arange(len(low)) - len(low) // 2))
    return 2 * low * turn.real, 2 * low * turn.imag


def apply_fir(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero-phase convolution by FFT with edges reflected."""
    half = len(h) // 2
    ext = np.pad(x, ((0, 0), (half, half)), mode="reflect")
    size = ext.shape[1] + len(h) - 1
    y = np.fft.irfft(np.fft.rfft(ext, size, axis=1) * np.fft.rfft(h, size), size, axis=1)
    return y[:, 2 * half : 2 * half + x.shape[1]]


def resample(x: np.ndarray, old: float, new: float) -> np.ndarray:
    """To round(n * new / old) samples through the spectrum; unchanged where the rates agree."""
    n, m = x.shape[1], int(round(x.shape[1] * new / old))
    if n == m:
        return x
    f = np.fft.rfft(x, axis=1)
    keep = min(n, m) // 2 + 1
    g = np.zeros((len(x), m // 2 + 1), complex)
    g[:, :keep] = f[:, :keep]
    if min(n, m) % 2 == 0:
        g[:, keep - 1] *= 0.5 if m > n else 1
    return np.fft.irfft(g, m, axis=1) * m / n


def line_noise_ratio(x: np.ndarray, sfreq: float, line: float = 50.0) -> np.ndarray:
    """Mean power within 2 Hz of the line over that in the flanks of 2 to 10 Hz; 0 where they are empty."""
    freqs, csd = cross_spectra(x, sfreq)
    psd = np.real(np.einsum("fii->if", csd))
    away = np.abs(freqs - line)
    peak, flank = psd[:, away <= 2], psd[:, (away > 2) & (away <= 10)]
    if not peak.shape[1] or not flank.shape[1]:
        return np.zeros(len(x))
    base = flank.mean(1)
    return np.divide(peak.mean(1), base, out=np.zeros(len(x)), where=base > 0)


def rank_and_components(x: np.ndarray, least: int = 10, most: int = 20) -> tuple[int, bool, int]:
    """Numerical rank, whether a decomposition is feasible, and its number of components."""
    rank = int(np.linalg.matrix_rank(x - x.mean(1, keepdims=True)))
    return rank, rank >= least, min(rank - 1, most) if rank >= least else 0


def fast_ica(x: np.ndarray, n: int, seed: int = 42, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Unmixing matrix and sources by symmetric fixed-point iteration with tanh."""
    d = x - x.mean(1, keepdims=True)
    u, s, _ = np.linalg.svd(d, full_matrices=False)
    white = (u[:, :n] / s[:n]).T * np.sqrt(d.shape[1])
    z = white @ d
    decorrelate = lambda w: (lambda e, v: v / np.sqrt(e) @ v.T @ w)(*np.linalg.eigh(w @ w.T))
    w = decorrelate(np.random.default_rng(seed).normal(size=(n, n)))
    for _ in range(rounds):
        g = np.tanh(w @ z)
        new = decorrelate(g @ z.T / z.shape[1] - (1 - g * g).mean(1)[:, None] * w)
        if np.abs(np.abs((new * w).sum(1)) - 1).max() < 1e-6:
            w = new
            break
        w = new
    return w @ white, w @ z


def bridged(r: np.ndarray, limit: float = 0.98, keep: int = 10) -> list[int]:
    """Channels to drop: of all pairs above the limit the one with most, lowest first, while more than keep remain."""
    link = (np.abs(r) > limit) & ~np.eye(len(r), dtype=bool)
    gone: list[int] = []
    while link.any() and len(r) - len(gone) > keep:
        k = int(link.sum(1).argmax())
        gone.append(k)
        link[k] = link[:, k] = False
    return sorted(gone)


def path_length(adjacency: np.ndarray) -> float | None:
    """Mean shortest path of a connected graph, None otherwise."""
    n = len(adjacency)
    seen, reach = np.eye(n, dtype=bool), np.eye(n, dtype=bool)
    total, step = 0, 0
    while not seen.all():
        step += 1
        reach = (reach @ adjacency) & ~seen
        if not reach.any():
            return None
        total += step * int(reach.sum())
        seen |= reach
    return total / (n * (n - 1)) if n > 1 else 0.0
