"""Numeric features of gray or BGR images: numpy on one image's bytes, batched by Arrow.

Images are rows of Spark's image source: STRUCT<height, width, nChannels, data BINARY>, BGR.  A family that
fails leaves its own error and does not touch the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def to_gray(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    a = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels).astype(np.float64)
    return a[:, :, 0] if channels == 1 else a[:, :, 0] * 0.114 + a[:, :, 1] * 0.587 + a[:, :, 2] * 0.299


def block_mean(gray: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Means over a rows x cols grid of nearly equal cells."""
    r, c = (np.linspace(0, n, k + 1).astype(int) for n, k in zip(gray.shape, (rows, cols), strict=True))
    cells = np.add.reduceat(np.add.reduceat(gray, r[:-1], axis=0), c[:-1], axis=1)
    return cells / np.outer(np.maximum(1, np.diff(r)), np.maximum(1, np.diff(c)))


def dct_matrix(n: int) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    m = np.sqrt(2 / n) * np.cos(np.pi * (2 * i + 1) * k / (2 * n))
    m[0] /= np.sqrt(2)
    return m


def perceptual_hash(gray: np.ndarray) -> str:
    """64 bits: low frequencies of a 32 x 32 cosine transform against their median, the mean left out of it."""
    d = dct_matrix(32)
    low = (d @ block_mean(gray, 32, 32) @ d.T)[:8, :8].ravel()
    bits = low > np.median(low[1:])
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def residual(gray: np.ndarray) -> np.ndarray:
    """Eight times the pixel less its eight neighbours."""
    if min(gray.shape) < 3:
        return np.zeros((0, 0))
    around = sum(gray[1 + y : gray.shape[0] - 1 + y, 1 + x : gray.shape[1] - 1 + x] for y in (-1, 0, 1) for x in (-1, 0, 1))
    return 9 * gray[1:-1, 1:-1] - around


def noise(gray: np.ndarray) -> dict:
    r = residual(gray)
    if not r.size:
        return {}
    d = r - r.mean()
    var = (d**2).mean()
    return {"std": float(np.sqrt(var)), "kurtosis": float((d**4).mean() / var**2 - 3) if var > 0 else 0.0}


def spectrum(gray: np.ndarray, bands: int = 16) -> dict:
    """Mean log magnitude in rings of the spectrum, and how far the highest peak stands above the rest."""
    m = np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(gray - gray.mean()))))
    y, x = np.indices(m.shape)
    radius = np.hypot(y - m.shape[0] // 2, x - m.shape[1] // 2)
    ring = np.minimum((radius / (radius.max() + 1e-9) * bands).astype(int), bands - 1).ravel()
    sums, counts = np.bincount(ring, m.ravel(), bands), np.bincount(ring, minlength=bands)
    spread = m.std()
    return {"bands": (sums / np.maximum(counts, 1)).tolist(), "peak": float((m.max() - m.mean()) / spread) if spread > 0 else 0.0}


def dct_benford(gray: np.ndarray) -> dict:
    h, w = gray.shape[0] // 8 * 8, gray.shape[1] // 8 * 8
    if h < 8 or w < 8:
        return {}
    d = dct_matrix(8)
    blocks = gray[:h, :w].reshape(h // 8, 8, w // 8, 8).swapaxes(1, 2)
    c = np.abs((d @ blocks @ d.T).reshape(-1, 64)[:, 1:].ravel())
    c = c[c >= 1]
    if c.size <= 100:
        return {}
    first = (c / 10 ** np.floor(np.log10(c))).astype(int).clip(1, 9)
    share = np.bincount(first, minlength=10)[1:10] / first.size
    return {"deviation": float(np.abs(share - np.log10(1 + 1 / np.arange(1, 10))).mean())}


def gradients(gray: np.ndarray) -> dict:
    if min(gray.shape) < 3:
        return {}
    gx, gy = np.diff(gray, axis=1)[:-1], np.diff(gray, axis=0)[:, :-1]
    lap = gray[:-2, 1:-1] + gray[2:, 1:-1] + gray[1:-1, :-2] + gray[1:-1, 2:] - 4 * gray[1:-1, 1:-1]
    return {"median": float(np.median(np.hypot(gx, gy))), "laplacian_variance": float(lap.var())}


def colors(data: bytes, height: int, width: int, channels: int) -> dict:
    """Shares of a 4 x 4 x 4 colour cube, mean saturation and mean value."""
    if channels < 3:
        return {}
    a = np.frombuffer(data, dtype=np.uint8).reshape(-1, channels)[:, :3]
    cell = (a // 64).astype(int) @ np.array([16, 4, 1])
    top, low = a.max(axis=1).astype(float), a.min(axis=1).astype(float)
    return {"cube": (np.bincount(cell, minlength=64) / len(a)).tolist(), "saturation": float(np.where(top > 0, (top - low) / np.maximum(top, 1), 0).mean()), "value": float(top.mean() / 255)}


def haar_bits(plane: np.ndarray, scale: float = 36.0) -> np.ndarray:
    """One bit per 4 x 4 block of the plane's first Haar approximation, in row order.

    The bit tells whether the block's largest magnitude, its first element left out, lies in the upper half of
    its quantisation step.
    """
    h, w = plane.shape[0] // 8, plane.shape[1] // 8
    if not h or not w:
        return np.zeros(0, dtype=int)
    pairs = plane[: 8 * h : 2, : 8 * w] + plane[1 : 8 * h : 2, : 8 * w]
    low = np.abs(pairs[:, ::2] + pairs[:, 1::2]) * 0.5
    low[::4, ::4] = 0
    rows = low.reshape(h, 4, 4 * w).max(axis=1)
    peak = np.maximum(np.maximum(rows[:, ::4], rows[:, 1::4]), np.maximum(rows[:, 2::4], rows[:, 3::4])).ravel()
    return (peak % scale > scale / 2).astype(int)


def vote(bits: np.ndarray, n: int) -> np.ndarray:
    """Buckets of bit index mod n; a bucket is 1 where 255 times its sum exceeds 127 times its size."""
    at = np.arange(len(bits)) % n
    return np.bincount(at, bits, n) * 255 > np.bincount(at, minlength=n) * 127


_FEATURES = "path string, status string, phash string, noise_std double, noise_kurtosis double, spectrum_bands array<double>, spectrum_peak double, benford double, gradient_median double, laplacian_variance double, color_cube array<double>, saturation double, value double, errors array<string>"


def pixel_evidence(images: DataFrame) -> DataFrame:
    """(path, features) of rows (path, height, width, channels, data); errors name the families that failed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, h, w, c, data in zip(f.path, f.height, f.width, f.channels, f["data"], strict=True):
                row: dict = {"path": path, "errors": []}
                try:
                    gray = to_gray(data, h, w, c)
                except Exception as e:
                    out.append(row | {"status": "error", "errors": [f"decode: {type(e).__name__}"]})
                    continue
                for family, names, make in (
                    ("hash", {"phash": None}, lambda g=gray: {"phash": perceptual_hash(g)}), ("noise", {"noise_std": "std", "noise_kurtosis": "kurtosis"}, lambda g=gray: noise(g)),
                    ("fft", {"spectrum_bands": "bands", "spectrum_peak": "peak"}, lambda g=gray: spectrum(g)), ("dct", {"benford": "deviation"}, lambda g=gray: dct_benford(g)),
                    ("gradient", {"gradient_median": "median", "laplacian_variance": "laplacian_variance"}, lambda g=gray: gradients(g)),
                    ("color", {"color_cube": "cube", "saturation": "saturation", "value": "value"}, lambda d=data, a=(h, w, c): colors(d, *a)),
                ):
                    try:
                        got = make()
                        row |= {k: got.get(v or k) for k, v in names.items()}
                    except Exception as e:
                        row["errors"].append(f"{family}: {type(e).__name__}")
                out.append(row | {"status": "partial" if row["errors"] else "complete"})
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in _FEATURES.split(", ")])

    return images.select("path", "height", "width", "channels", "data").mapInPandas(run, _FEATURES)


def ssim(a: np.ndarray, b: np.ndarray, window: int = 7, peak: float = 255.0) -> float:
    """Mean structural similarity of two gray rasters over all full windows (uniform weights, sample variances)."""
    if a.shape != b.shape or min(a.shape) < window:
        raise ValueError("rasters of one shape, no smaller than the window")

    def mean(x: np.ndarray) -> np.ndarray:
        total = np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
        return (total[window:, window:] - total[:-window, window:] - total[window:, :-window] + total[:-window, :-window]) / window**2

    a, b = a.astype(float), b.astype(float)
    ma, mb, scale = mean(a), mean(b), window**2 / (window**2 - 1)
    va, vb, cov = (scale * (mean(x * y) - mean(x) * mean(y)) for x, y in ((a, a), (b, b), (a, b)))
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean())


def coarse_map(gray: np.ndarray, side: int = 8) -> list[float]:
    """Mean of each cell of a side x side grid, row by row; cells differ by one row or column at most."""
    rows, columns = (np.linspace(0, n, side + 1).astype(int) for n in gray.shape)
    return [float(gray[r0 : max(r1, r0 + 1), c0 : max(c1, c0 + 1)].mean()) for r0, r1 in zip(rows[:-1], rows[1:], strict=True) for c0, c1 in zip(columns[:-1], columns[1:], strict=True)]
