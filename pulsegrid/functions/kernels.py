"""Small numpy kernels for one clip's signals and frames."""

from __future__ import annotations

import numpy as np


def hann(n: int) -> np.ndarray:
    """Periodic, as spectra need it."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def welch(x: np.ndarray, fps: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power density: Hann windows with half overlap, each without its mean, averaged."""
    size = min(size, len(x))
    if size < 2:
        return np.zeros(0), np.zeros(0)
    parts = np.lib.stride_tricks.sliding_window_view(x, size)[:: size - size // 2].astype(float)
    w = hann(size)
    power = np.abs(np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * w, axis=1)) ** 2 / (fps * (w * w).sum())
    power[:, 1 : -1 if size % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(size, 1 / fps), power.mean(axis=0)


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Places above both neighbours; of a plateau its middle. The ends are none."""
    change = np.flatnonzero(np.diff(x) != 0) + 1
    first, last = np.append(0, change), np.append(change, len(x)) - 1
    v = x[first]
    top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1 if len(v) > 2 else np.zeros(0, int)
    return (first[top] + last[top]) // 2


def spaced(places: np.ndarray, heights: np.ndarray, distance: int) -> np.ndarray:
    """Of places nearer than `distance` to each other the higher stays, the highest first (of equals the later)."""
    gone = np.zeros(len(places), bool)
    for k in np.argsort(heights, kind="stable")[::-1]:
        if not gone[k]:
            near = np.abs(places - places[k]) < distance
            near[k] = False
            gone |= near
    return places[~gone]


def prominence(x: np.ndarray, place: int) -> float:
    """How far a peak stands above the higher of the lowest points that part it from higher ground on either side."""
    higher = np.flatnonzero(x > x[place])
    left, right = higher[higher < place], higher[higher > place]
    a, b = (left[-1] + 1 if len(left) else 0), (right[0] if len(right) else len(x))
    return float(x[place] - max(x[a : place + 1].min(), x[place:b].min()))


def peaks(x: np.ndarray, distance: int, least_prominence: float | None = None) -> np.ndarray:
    found = local_maxima(x)
    found = spaced(found, x[found], distance)
    if least_prominence is not None:
        found = np.array([p for p in found if prominence(x, p) >= least_prominence], int)
    return found


def envelope(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal."""
    n = len(x)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * gain))


def gray(bgr: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(bgr.astype(np.float64) @ np.array([0.114, 0.587, 0.299])), 0, 255).astype(np.uint8)


def blur(frames: np.ndarray) -> np.ndarray:
    """5 x 5 Gaussian of deviation 1.1 on uint8 frames [.., h, w], mirrored at the border without repeating it."""
    k = np.exp(-(np.arange(-2, 3) ** 2) / (2 * 1.1**2))
    k /= k.sum()
    pad = [(0, 0)] * (frames.ndim - 2) + [(2, 2), (2, 2)]
    x = np.pad(frames.astype(np.float64), pad, mode="reflect")
    h, w = frames.shape[-2:]
    x = sum(k[j] * x[..., j : j + h, :] for j in range(5))
    x = sum(k[j] * x[..., j : j + w] for j in range(5))
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def majority(masks: np.ndarray) -> np.ndarray:
    """5 x 5 median of boolean masks [.., h, w], borders repeated."""
    pad = [(0, 0)] * (masks.ndim - 2) + [(2, 2), (2, 2)]
    x = np.pad(masks.astype(np.int16), pad, mode="edge")
    h, w = masks.shape[-2:]
    x = sum(x[..., j : j + h, :] for j in range(5))
    return sum(x[..., j : j + w] for j in range(5)) >= 13


def sharpness(frame: np.ndarray) -> float:
    """Variance of the Laplacian, mirrored at the border."""
    x = np.pad(frame.astype(np.float64), 1, mode="reflect")
    return float((x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * x[1:-1, 1:-1]).var())


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """0 where one of them is constant or too short."""
    if len(a) < 2:
        return 0.0
    a, b = a - a.mean(), b - b.mean()
    size = np.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / size) if size > 0 else 0.0
