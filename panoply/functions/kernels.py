"""Image and geometry kernels in numpy, and the pandas UDF that measures decoded images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gray(bgr: np.ndarray) -> np.ndarray:
    """Luma of blue, green, red bytes, rounded."""
    return ((bgr.astype(np.int64) @ np.array([114, 587, 299]) + 500) // 1000).astype(np.uint8)


def shrink(image: np.ndarray, width: int) -> np.ndarray:
    """Area averages down to ``width``; narrower images stay."""
    h, w = image.shape
    if w <= width:
        return image
    height = max(1, round(h * width / w))

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.linspace(0, n, m + 1)
        cells = np.arange(n)
        return np.maximum(0, np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells)) * (m / n)

    return np.floor(weights(h, height) @ image @ weights(w, width).T + 0.5).astype(np.uint8)


def laplacian_variance(image: np.ndarray) -> float:
    """Population variance of the 4-neighbour Laplacian, borders mirrored without the edge pixel."""
    p = np.pad(image.astype(np.float64), 1, mode="reflect")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def _box(a: np.ndarray, n: int) -> np.ndarray:
    p = np.pad(a, ((n // 2 + 1, n // 2), (n // 2 + 1, n // 2)), mode="edge").cumsum(0).cumsum(1)
    return p[n:, n:] - p[:-n, n:] - p[n:, :-n] + p[:-n, :-n]


def gradients(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.pad(image.astype(np.float64), 1, mode="reflect")
    return (p[1:-1, 2:] - p[1:-1, :-2]) / 2, (p[2:, 1:-1] - p[:-2, 1:-1]) / 2


def corners(image: np.ndarray, most: int = 600, quality: float = 0.01, apart: int = 7, block: int = 7) -> np.ndarray:
    """(x, y) of the strongest minimum-eigenvalue corners, at least ``apart`` pixels from each other."""
    gx, gy = gradients(image)
    a, b, c = (_box(v, block) for v in (gx * gx, gx * gy, gy * gy))
    strength = (a + c) / 2 - np.sqrt(((a - c) / 2) ** 2 + b * b)
    if not strength.size or strength.max() <= 1e-9:
        return np.zeros((0, 2))
    p = np.pad(strength, 1, constant_values=-np.inf)
    peak = np.max([p[i : i + strength.shape[0], j : j + strength.shape[1]] for i in range(3) for j in range(3)], axis=0)
    ys, xs = np.nonzero((strength >= peak) & (strength >= quality * strength.max()))
    order = np.argsort(-strength[ys, xs], kind="stable")
    taken, free = [], np.ones(strength.shape, bool)
    for k in order:
        y, x = ys[k], xs[k]
        if free[y, x]:
            taken.append((x, y))
            free[max(0, y - apart + 1) : y + apart, max(0, x - apart + 1) : x + apart] = False
            if len(taken) == most:
                break
    return np.array(taken, float).reshape(-1, 2)


def _windows(image: np.ndarray, x: np.ndarray, y: np.ndarray, half: int) -> np.ndarray:
    """The square windows around places between pixels; outside the image its border goes on. A window's pixels share their weights, so each is read once."""
    h, w = image.shape
    x, y = np.minimum(np.maximum(x, -w), 2 * w), np.minimum(np.maximum(y, -h), 2 * h)
    i, j = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - i)[:, None, None], (x - j)[:, None, None]
    span = np.arange(-half, half + 2)
    rows, columns = np.minimum(np.maximum(i[:, None] + span, 0), h - 1), np.minimum(np.maximum(j[:, None] + span, 0), w - 1)
    p = image.ravel().take(rows[:, :, None] * w + columns[:, None, :])
    p = p[:, :, :-1] + fx * (p[:, :, 1:] - p[:, :, :-1])
    return p[:, :-1] + fy * (p[:, 1:] - p[:, :-1])


def flow(first: np.ndarray, second: np.ndarray, points: np.ndarray, window: int = 21, levels: int = 3, rounds: int = 30, enough: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Pyramidal Lucas-Kanade: the points' places in the second image, and which were tracked. A point rests once its step is short enough."""
    pyramid = [(first.astype(np.float64), second.astype(np.float64))]
    for _ in range(levels):
        if min(pyramid[-1][0].shape) < 2 * window:
            break
        pyramid.append(tuple(_box(np.pad(i, 0), 3)[::2, ::2] / 9 for i in pyramid[-1]))
    half = window // 2
    move, ok = np.zeros_like(points), np.ones(len(points), bool)
    for level in range(len(pyramid) - 1, -1, -1):
        a, b = pyramid[level]
        x, y = (points / 2**level).T
        ia, ix, iy = (_windows(i, x, y, half) for i in (a, *gradients(a)))
        xx, xy, yy = (np.einsum("nij,nij->n", p, q) for p, q in ((ix, ix), (ix, iy), (iy, iy)))
        det = xx * yy - xy * xy
        fine = det > 1e-6 * window**4
        ok &= fine | (level > 0)
        move = move * 2 if level < len(pyramid) - 1 else move
        at = np.flatnonzero(fine)
        rest = [g[at] for g in (ia, ix, iy, xx, xy, yy, det, x, y)]  # of the points that still move
        for _ in range(rounds):
            if not len(at):
                break
            wa, wx, wy, sxx, sxy, syy, area, px, py = rest
            d = wa - _windows(b, px + move[at, 0], py + move[at, 1], half)
            u, v = np.einsum("nij,nij->n", d, wx), np.einsum("nij,nij->n", d, wy)
            du, dv = (syy * u - sxy * v) / area, (sxx * v - sxy * u) / area
            move[at, 0] += du
            move[at, 1] += dv
            moves = (np.abs(du) >= enough) | (np.abs(dv) >= enough)
            if not moves.all():
                at, rest = at[moves], [g[moves] for g in rest]
    to = points + move
    h, w = first.shape
    return to, ok & (to[:, 0] >= 0) & (to[:, 1] >= 0) & (to[:, 0] < w) & (to[:, 1] < h)


def pair_metrics(first: np.ndarray, second: np.ndarray, most: int = 600) -> tuple[int, int, float, float]:
    """Initial and tracked corners, their ratio, and the median displacement over the diagonal; zeros if nothing is tracked."""
    p = corners(first, most)
    if not len(p):
        return 0, 0, 0.0, 0.0
    to, ok = flow(first, second, p)
    if not ok.any():
        return len(p), 0, 0.0, 0.0
    d = np.linalg.norm(to[ok] - p[ok], axis=1)
    return len(p), int(ok.sum()), float(ok.sum() / len(p)), float(np.median(d) / np.hypot(*first.shape))


def frame_quality(images: DataFrame, width: int = 640, most: int = 600, pixels: bool = False) -> DataFrame:
    """path, sharpness, brightness_mean, feature_count of rows of Spark's image source, and with ``pixels`` the gray
    analysis image (height, width, gray): one Arrow hop for all."""
    names = ["path", "sharpness", "brightness_mean", "feature_count"] + ["height", "width", "gray"] * pixels

    def run(batches):
        for pdf in batches:
            rows = []
            for path, h, w, n, data in zip(pdf["path"], pdf["height"], pdf["width"], pdf["n"], pdf["data"], strict=True):
                px = np.frombuffer(data, np.uint8).reshape(h, w, n)
                g = shrink(gray(px[..., :3]) if n >= 3 else px[..., 0], width)
                rows.append((path, laplacian_variance(g), float(g.mean()), len(corners(g, most)), *((*g.shape, g.tobytes()) if pixels else ())))
            yield pd.DataFrame(rows, columns=names)

    flat = images.select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("n"), "image.data")
    return flat.mapInPandas(run, "path string, sharpness double, brightness_mean double, feature_count long" + ", height int, width int, gray binary" * pixels)
