"""Frame features in numpy, for whole images inside Arrow-batched tasks."""

from __future__ import annotations

import numpy as np

from cinesieve.functions.grids import COLOR_SCALE, CONTRAST_SCALE, MIDDLE, SHARP_SCALE, WEIGHTS

#: Edge thresholds, and the similarity index's window and constants for 8-bit pixels.
EDGE_LOW, EDGE_HIGH = 80, 180
WINDOW, C1, C2 = 7, (0.01 * 255) ** 2, (0.03 * 255) ** 2
#: Cells a side of the coarse grid that bounds the index; parts of an image that are compared one after another.
CELLS, BANDS = 16, 10


def decode(height: int, width: int, channels: int, data: bytes) -> np.ndarray | None:
    """The pixels of Spark's image struct, height x width x channels (blue, green, red); None where it couldn't be read."""
    if height is None or height <= 0 or width <= 0 or not data:
        return None
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def to_gray(bgr: np.ndarray) -> np.ndarray:
    if bgr.shape[2] == 1:
        return bgr[:, :, 0]
    b, g, r = (bgr[:, :, c].astype(np.float64) for c in range(3))
    return np.floor(0.114 * b + 0.587 * g + 0.299 * r + 0.5).astype(np.uint8)


def hsv(bgr: np.ndarray) -> np.ndarray:
    """Hue in 0..179 (halves of degrees), saturation and brightness in 0..255, rounded."""
    b, g, r = (bgr[..., c].astype(np.float64) for c in range(3))
    top = bgr.max(axis=-1).astype(np.float64)
    spread = top - bgr.min(axis=-1)
    apart = np.where(spread == 0, 1, spread)
    hue = np.where(top == r, (g - b) / apart, np.where(top == g, 2 + (b - r) / apart, 4 + (r - g) / apart)) * 30
    hue = np.where(spread == 0, 0, np.floor(hue + 0.5) % 180)
    return np.stack([hue, np.floor(255 * spread / np.where(top == 0, 1, top) + 0.5), top], axis=-1).astype(np.uint8)


def laplacian_variance(gray: np.ndarray) -> float:
    p = np.pad(gray.astype(np.float64), 1, mode="reflect") if min(gray.shape) > 1 else np.pad(gray.astype(np.float64), 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def edges(gray: np.ndarray, low: int = EDGE_LOW, high: int = EDGE_HIGH) -> np.ndarray:
    """Canny edges of one image or of n (n x height x width): Sobel gradients, suppression along the gradient, and weak edges
    kept where strong ones reach them."""
    around = [(0, 0)] * (gray.ndim - 2) + [(1, 1), (1, 1)]
    g = np.pad(gray.astype(np.int64), around, mode="edge")
    column, row = g[..., :-2, :] + 2 * g[..., 1:-1, :] + g[..., 2:, :], g[..., :-2] + 2 * g[..., 1:-1] + g[..., 2:]
    dx, dy = column[..., 2:] - column[..., :-2], row[..., 2:, :] - row[..., :-2, :]
    size = np.abs(dx) + np.abs(dy)
    shifted = lambda p, y, x: p[..., 1 + y : p.shape[-2] - 1 + y, 1 + x : p.shape[-1] - 1 + x]
    m = np.pad(size, around)
    at = lambda y, x: shifted(m, y, x)
    steep, flat = np.abs(dy) > np.tan(np.pi * 3 / 8) * np.abs(dx), np.abs(dy) < np.tan(np.pi / 8) * np.abs(dx)
    falling = (dx >= 0) == (dy >= 0)
    before = np.where(flat, at(0, -1), np.where(steep, at(-1, 0), np.where(falling, at(-1, -1), at(-1, 1))))
    after = np.where(flat, at(0, 1), np.where(steep, at(1, 0), np.where(falling, at(1, 1), at(1, -1))))
    peak = (size > before) & np.where(flat | steep, size >= after, size > after)
    weak, found = peak & (size > low), peak & (size > high)
    while True:
        p = np.pad(found, around)
        grown = weak & np.any([shifted(p, y, x) for y in (-1, 0, 1) for x in (-1, 0, 1)], axis=0)
        if (grown == found).all():
            return found.astype(np.uint8) * 255
        found = grown


def composition(gray: np.ndarray) -> np.ndarray | float:
    """The share of edges in the middle half, half as much again, at most 1; of one image or of each of n."""
    e = edges(gray).astype(np.float64)
    h, w = gray.shape[-2:]
    middle = e[..., h // 4 : 3 * h // 4, w // 4 : 3 * w // 4].sum(axis=(-2, -1))
    share = np.minimum(middle / (e.sum(axis=(-2, -1)) + 1e-6) * 1.5, 1.0)
    return float(share) if gray.ndim == 2 else share


def scores(bgr: np.ndarray | None) -> dict:
    """The scores to three decimals and their weighted total, all zero with an error for an unreadable frame."""
    if bgr is None:
        return {**dict.fromkeys([*WEIGHTS, "total"], 0.0), "error": "unreadable"}
    gray = to_gray(bgr)
    b, g, r = (bgr[:, :, c].astype(np.float64) for c in (range(3) if bgr.shape[2] >= 3 else (0, 0, 0)))
    raw = {
        "sharpness": min(laplacian_variance(gray) / SHARP_SCALE, 1.0),
        "colorfulness": min((np.abs(r - g).mean() + np.abs(0.5 * (r + g) - b).mean()) / COLOR_SCALE, 1.0),
        "brightness": 1 - abs(gray.mean() - MIDDLE) / MIDDLE,
        "contrast": min(gray.std() / CONTRAST_SCALE, 1.0),
        "composition": composition(gray),
    }
    total = 0.0
    for name, weight in WEIGHTS.items():
        total += raw[name] * weight
    return {**{k: round(float(v), 3) for k, v in raw.items()}, "total": round(float(total), 3), "error": None}


def _cosines(n: int) -> np.ndarray:
    u, x = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.cos((2 * x + 1) * u * np.pi / (2 * n))


def resized(gray: np.ndarray, height: int, width: int, reach: int, kernel) -> np.ndarray:
    """Separable resampling; a kernel is stretched where the image shrinks."""

    def weights(old: int, new: int) -> np.ndarray:
        scale = max(old / new, 1.0)
        centre = (np.arange(new)[:, None] + 0.5) * old / new
        w = kernel((np.arange(old)[None, :] + 0.5 - centre) / scale)
        w = np.where(np.abs(np.arange(old)[None, :] + 0.5 - centre) <= reach * scale, w, 0.0)
        return w / w.sum(axis=1, keepdims=True)

    return weights(gray.shape[0], height) @ gray.astype(np.float64) @ weights(gray.shape[1], width).T


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.sinc(x) * np.sinc(x / 3)


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1 - np.abs(x))


def phash(gray: np.ndarray, size: int = 16) -> bytes:
    """Signs of the low cosine coefficients against their median, size**2 bits, big-endian."""
    side = 4 * size
    small = np.clip(np.floor(resized(gray, side, side, 3, _lanczos) + 0.5), 0, 255)
    c = _cosines(side)[:size]
    low = c @ small @ c.T
    return np.packbits((low > np.median(low)).ravel()).tobytes()


def grid_hash(px: np.ndarray) -> np.ndarray:
    """For n grids of 8 x 8 integers: 64 sign bits each, of cosine sums in integers (a table scaled by 4096)."""
    c = np.floor(_cosines(8) * 4096 + 0.5).astype(np.int64)
    low = (c @ px.reshape(-1, 8, 8).astype(np.int64) @ c.T).reshape(-1, 64)
    middle = np.sort(low, axis=1)[:, 31:33].sum(axis=1, keepdims=True)
    return np.packbits(2 * low > middle, axis=1)


def comparable(gray: np.ndarray, side: int = 256) -> bytes:
    """The image at the size in which frames are compared by structure."""
    return np.clip(np.floor(resized(gray, side, side, 1, _triangle) + 0.5), 0, 255).astype(np.uint8).tobytes()


def _sums(x: np.ndarray, window: int) -> np.ndarray:
    s = np.pad(x.cumsum(axis=-2).cumsum(axis=-1), [(0, 0)] * (x.ndim - 2) + [(1, 0), (1, 0)])
    return s[..., window:, window:] - s[..., :-window, window:] - s[..., window:, :-window] + s[..., :-window, :-window]


class Windows:
    """An image's sums over its windows, in whole numbers, with what bounds its similarity to others from above.

    A window's similarity is its luminance term times its structure term, neither over 1; they are at most 1 - (a - b)**2 /
    (a**2 + b**2 + C) of the two means, and of the two deviations. `cells` has means and maxima of both over a coarse grid, so
    that the same bound holds for a cell's windows together.
    """

    def __init__(self, image: np.ndarray, window: int = WINDOW):
        self.image, self.window = image, window
        x = image.astype(np.int64)
        self.sums, self.squares = _sums(x, window).astype(np.uint16 if window * window <= 256 else np.int64), _sums(x * x, window).astype(np.int64 if window > 250 else np.uint32)
        mean, variance = self.moments()
        self.cells = self._cells(mean, np.sqrt(np.maximum(variance, 0)))

    def moments(self) -> tuple[np.ndarray, np.ndarray]:
        """Means and sample variances of the windows."""
        n = self.window * self.window
        mean = self.sums.astype(np.int64) / n
        return mean, n / (n - 1) * (self.squares.astype(np.int64) / n - mean * mean)

    def _cells(self, *kinds: np.ndarray) -> np.ndarray:
        """Means and maxima of each kind by cells: 2 * kinds x cells."""
        places = [np.unique(np.linspace(0, n, min(n, CELLS) + 1).astype(int)[:-1]) for n in kinds[0].shape]
        by_cell = lambda f, x: f.reduceat(f.reduceat(x, places[0], axis=0), places[1], axis=1).ravel()
        self.weights = by_cell(np.add, np.ones_like(kinds[0]))
        return np.stack([y for x in kinds for y in (by_cell(np.add, x) / self.weights, by_cell(np.maximum, x))])

    def coarse_bound(self, cells: np.ndarray) -> np.ndarray:
        """The most that the similarity to each of n images can be; cells: theirs, n x kinds x cells."""
        own = self.cells
        lost = [(cells[:, k] - own[k]) ** 2 / (cells[:, k + 1] ** 2 + own[k + 1] ** 2 + c) for k, c in ((0, C1), (2, C2))]
        return (1 - np.maximum(*lost)) @ self.weights / self.weights.sum()

    def similarity(self, other: Windows, least: float = -np.inf) -> float | None:
        """ssim(other, self), or None where it is under `least`, mostly after a part of the windows.

        What is known of the mean from above is the sum of the windows compared so far and of the others' bounds.
        """
        (ma, va), (mb, vb) = other.moments(), self.moments()
        luminance = (2 * ma * mb + C1) / (ma * ma + mb * mb + C1)
        bounds = luminance * (2 * np.sqrt(np.maximum(va * vb, 0)) + C2) / (va + vb + C2)
        most, done = bounds.sum(), []
        for rows in np.array_split(np.arange(len(ma)), min(len(ma), BANDS)):
            if most < least * ma.size:
                return None
            a, b = rows[0], rows[-1] + 1
            pixels = slice(a, b + self.window - 1)
            done.append(_similarity(ma[a:b], va[a:b], mb[a:b], vb[a:b], _sums(other.image[pixels].astype(np.int64) * self.image[pixels], self.window), self.window))
            most += done[-1].sum() - bounds[a:b].sum()
        return float(np.concatenate(done).mean())

    def similarities(self, kept: np.ndarray, means: np.ndarray, variances: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """`similarity` to n images at a time, with their windows' moments: the places of those that no bound ruled out, and their values."""
        mb, vb = self.moments()
        luminance = (2 * means * mb + C1) / (means * means + mb * mb + C1)
        bounds = luminance * (2 * np.sqrt(np.maximum(variances * vb, 0)) + C2) / (variances + vb + C2)
        most, left, done = bounds.sum(axis=(1, 2)), np.arange(len(kept)), np.zeros(len(kept))
        for rows in np.array_split(np.arange(len(mb)), min(len(mb), BANDS)):
            left = left[most[left] >= least * mb.size]
            if not len(left):
                break
            a, b = rows[0], rows[-1] + 1
            pixels = slice(a, b + self.window - 1)
            part = _similarity(means[left, a:b], variances[left, a:b], mb[a:b], vb[a:b], _sums(kept[left, pixels].astype(np.int64) * self.image[pixels], self.window), self.window).sum(axis=(1, 2))
            done[left] += part
            most[left] += part - bounds[left, a:b].sum(axis=(1, 2))
        return left, done[left] / mb.size


def _similarity(ma, va, mb, vb, products: np.ndarray, window: int) -> np.ndarray:
    n = window * window
    both = n / (n - 1) * (products / n - ma * mb)
    return ((2 * ma * mb + C1) * (2 * both + C2)) / ((ma * ma + mb * mb + C1) * (va + vb + C2))


def ssim(kept: np.ndarray, frame: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Structural similarity of n images (n x height x width) to one frame or to n others, over uniform windows inside the image."""
    n = window * window
    a, b = kept.astype(np.int64), frame.astype(np.int64).reshape(-1, *kept.shape[1:])
    ma, mb = _sums(a, window) / n, _sums(b, window) / n
    sample = n / (n - 1)
    va, vb = sample * (_sums(a * a, window) / n - ma * ma), sample * (_sums(b * b, window) / n - mb * mb)
    return _similarity(ma, va, mb, vb, _sums(a * b, window), window).mean(axis=(1, 2))
