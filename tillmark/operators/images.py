"""Receipt photographs as arrays: corner search, perspective warp, local contrast. Pixels are numpy on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Clip limit and tiles of the local contrast.
CLIP, TILES = 2.0, 8
#: Pixels of the copy that corners are searched on, gradient bounds of edges, outlines that are tried, their least share of the picture, and how much of its quadrilateral an outline must fill.
DETECT, EDGE_LOW, EDGE_HIGH, CANDIDATES, LEAST_AREA, FILL = 1000, 75, 200, 5, 0.10, 0.80


def order_corners(points: np.ndarray) -> np.ndarray:
    """Four corners as top left, top right, bottom right, bottom left: by the sum and the difference of x and y."""
    s, d = points.sum(1), points[:, 1] - points[:, 0]
    return points[[s.argmin(), d.argmin(), s.argmax(), d.argmax()]].astype(np.float32)


def output_size(corners: np.ndarray) -> tuple[int, int]:
    """Width and height of the straightened page: the longer of each two opposite sides."""
    tl, tr, br, bl = order_corners(corners)
    side = lambda a, b: float(np.hypot(*(a - b)))
    return int(max(side(br, bl), side(tr, tl))), int(max(side(tr, br), side(tl, bl)))


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The projective map that takes four points to four points."""
    a, b = [], []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        a += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        b += [u, v]
    return np.append(np.linalg.solve(np.array(a, float), np.array(b, float)), 1).reshape(3, 3)


def warp(image: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """The page between four corners, straightened; pixels between others are interpolated."""
    w, h = output_size(corners)
    goal = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float)
    back = homography(goal, order_corners(corners).astype(float))
    x, y = np.meshgrid(np.arange(w), np.arange(h))
    p = back @ np.stack([x.ravel(), y.ravel(), np.ones(w * h)])
    u, v = np.clip(p[0] / p[2], 0, image.shape[1] - 1), np.clip(p[1] / p[2], 0, image.shape[0] - 1)
    i, j = np.floor(v).astype(int), np.floor(u).astype(int)
    i2, j2 = np.minimum(i + 1, image.shape[0] - 1), np.minimum(j + 1, image.shape[1] - 1)
    fv, fu = (v - i)[:, None], (u - j)[:, None]
    flat = image.reshape(image.shape[0], image.shape[1], -1).astype(float)
    out = flat[i, j] * (1 - fv) * (1 - fu) + flat[i, j2] * (1 - fv) * fu + flat[i2, j] * fv * (1 - fu) + flat[i2, j2] * fv * fu
    return np.rint(out).astype(np.uint8).reshape((h, w) + image.shape[2:])


def local_contrast(gray: np.ndarray, clip: float = CLIP, tiles: int = TILES) -> np.ndarray:
    """Histogram equalisation by tiles with clipped counts, blended between tile centres."""
    h, w = gray.shape
    th, tw = max(1, -(-h // tiles)), max(1, -(-w // tiles))
    ny, nx = -(-h // th), -(-w // tw)
    maps = np.empty((ny, nx, 256))
    for a in range(ny):
        for b in range(nx):
            t = gray[a * th : (a + 1) * th, b * tw : (b + 1) * tw]
            n = np.bincount(t.ravel(), minlength=256).astype(float)
            top = max(1.0, clip * t.size / 256)
            over = np.maximum(n - top, 0).sum()
            maps[a, b] = np.cumsum(np.minimum(n, top) + over / 256) * 255 / t.size
    y = np.clip((np.arange(h) + 0.5) / th - 0.5, 0, ny - 1)
    x = np.clip((np.arange(w) + 0.5) / tw - 0.5, 0, nx - 1)
    a, b = np.floor(y).astype(int), np.floor(x).astype(int)
    a2, b2 = np.minimum(a + 1, ny - 1), np.minimum(b + 1, nx - 1)
    fy, fx = (y - a)[:, None], (x - b)[None, :]
    at = lambda p, q: maps[p[:, None], q[None, :], gray]
    out = at(a, b) * (1 - fy) * (1 - fx) + at(a, b2) * (1 - fy) * fx + at(a2, b) * fy * (1 - fx) + at(a2, b2) * fy * fx
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def _blur(x: np.ndarray) -> np.ndarray:
    """A 5 x 5 Gaussian, edges repeated."""
    k = np.array([1, 4, 6, 4, 1]) / 16
    for axis in (0, 1):
        p = np.pad(x, [(2, 2) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        x = sum(k[i] * np.take(p, range(i, i + x.shape[axis]), axis) for i in range(5))
    return x


def _grow(mask: np.ndarray) -> np.ndarray:
    """A mask and its eight neighbours."""
    p = np.pad(mask, 1)
    h, w = mask.shape
    return np.logical_or.reduce([p[i : i + h, j : j + w] for i in range(3) for j in range(3)])


def edges(gray: np.ndarray, low: float = EDGE_LOW, high: float = EDGE_HIGH) -> np.ndarray:
    """Thin edges: gradient maxima over ``high``, and those over ``low`` that touch them."""
    g = _blur(gray.astype(float))
    p = np.pad(g, 1, mode="edge")
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    m = np.abs(gx) + np.abs(gy)
    q = np.pad(m, 1)
    h, w = m.shape
    at = lambda i, j: q[1 + i : 1 + i + h, 1 + j : 1 + j + w]
    flat, steep = np.abs(gy) <= 0.4142 * np.abs(gx), np.abs(gy) >= 2.4142 * np.abs(gx)
    same = gx * gy > 0
    a = np.where(flat, at(0, -1), np.where(steep, at(-1, 0), np.where(same, at(-1, -1), at(-1, 1))))
    b = np.where(flat, at(0, 1), np.where(steep, at(1, 0), np.where(same, at(1, 1), at(1, -1))))
    weak = (m >= low) & (m >= a) & (m > b)
    kept = weak & (m >= high)
    while True:
        more = _grow(kept) & weak
        if (more == kept).all():
            return kept
        kept = more


def _pieces(mask: np.ndarray) -> list[np.ndarray]:
    """Points (x, y) of each connected piece of a mask."""
    at = np.argwhere(mask)
    number = np.full(mask.shape, -1)
    number[mask] = np.arange(len(at))
    label = np.arange(len(at))
    p = np.pad(number, 1, constant_values=-1)
    near = np.stack([p[1 + i : 1 + i + mask.shape[0], 1 + j : 1 + j + mask.shape[1]][mask] for i in (-1, 0, 1) for j in (-1, 0, 1)], 1)
    while True:
        best = np.where(near >= 0, label[near], len(at)).min(1, initial=len(at))
        best = np.minimum(best, label)
        best = best[best]
        if (best == label).all():
            break
        label = best
    order = np.argsort(label, kind="stable")
    cut = np.flatnonzero(np.diff(label[order])) + 1
    return [part[:, ::-1] for part in np.split(at[order], cut)] if len(at) else []


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull, counter-clockwise by the plane's axes."""
    p = points[np.lexsort((points[:, 1], points[:, 0]))].astype(float)
    half = []
    for run in (p, p[::-1]):
        h: list[np.ndarray] = []
        for x in run:
            while len(h) > 1 and (h[-1][0] - h[-2][0]) * (x[1] - h[-2][1]) <= (h[-1][1] - h[-2][1]) * (x[0] - h[-2][0]):
                h.pop()
            h.append(x)
        half += h[:-1]
    return np.array(half)


def _area(poly: np.ndarray) -> float:
    x, y = poly[:, 0], poly[:, 1]
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def four_sides(hull: np.ndarray) -> np.ndarray | None:
    """A hull as four corners: those points go whose loss costs the least area."""
    poly = hull
    while len(poly) > 4:
        before, after = np.roll(poly, 1, 0), np.roll(poly, -1, 0)
        cost = np.abs((before[:, 0] - poly[:, 0]) * (after[:, 1] - poly[:, 1]) - (before[:, 1] - poly[:, 1]) * (after[:, 0] - poly[:, 0]))
        poly = np.delete(poly, int(cost.argmin()), 0)
    return poly if len(poly) == 4 else None


def find_corners(gray: np.ndarray) -> np.ndarray | None:
    """The page's corners in a photograph, or None: the largest closed outline that is nearly a quadrilateral.

    The search is on a copy of ``DETECT`` pixels at most; an outline must cover a tenth of it, and the
    outline's hull fill four fifths of the quadrilateral's area.
    """
    step = max(1, -(-max(gray.shape) // DETECT))
    h, w = gray.shape[0] // step, gray.shape[1] // step
    small = gray[: h * step, : w * step].reshape(h, step, w, step).mean((1, 3))
    found = []
    for p in _pieces(_grow(edges(small))):
        if len(p) >= 8:
            hull = convex_hull(p)
            if len(hull) >= 4:
                found.append((_area(hull), hull))
    for area, hull in sorted(found, key=lambda x: -x[0])[:CANDIDATES]:
        quad = four_sides(hull)
        if area < LEAST_AREA * h * w:
            break
        if quad is not None and _area(quad) >= FILL * area:
            return order_corners(quad * step)
    return None


def preprocess(images: DataFrame) -> DataFrame:
    """Images straightened where the page is found (``deskewed``), and with local contrast raised."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, h, w, c, d in zip(f["path"], f["height"], f["width"], f["n_channels"], f["data"], strict=True):
                x = np.frombuffer(d, np.uint8).reshape(h, w, c)
                corners = find_corners(x[..., :3].mean(2))
                if corners is not None and min(output_size(corners)) > 1:
                    x = warp(x, corners)
                light = np.rint(x[..., :3].mean(2)).astype(np.uint8)
                y = x.astype(np.int16)
                y[..., :3] += (local_contrast(light).astype(np.int16) - light)[..., None]
                rows.append((path, x.shape[0], x.shape[1], c, np.clip(y, 0, 255).astype(np.uint8).tobytes(), corners is not None))
            yield pd.DataFrame(rows, columns=["path", "height", "width", "n_channels", "data", "deskewed"])

    return images.mapInPandas(run, "path string, height int, width int, n_channels int, data binary, deskewed boolean")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images by Spark's own source: ``path, height, width, n_channels, data`` (blue, green, red)."""
    return spark.read.format("image").load(path).select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("n_channels"), F.col("image.data").alias("data"))


def enhance(images: DataFrame) -> DataFrame:
    """Images with the local contrast of each channel's mean raised; the shape stays."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for h, w, c, d in zip(f["height"], f["width"], f["n_channels"], f["data"], strict=True):
                x = np.frombuffer(d, np.uint8).reshape(h, w, c).astype(np.int16)
                light = np.rint(x[..., :3].mean(2)).astype(np.uint8)
                x[..., :3] += (local_contrast(light).astype(np.int16) - light)[..., None]
                out.append(np.clip(x, 0, 255).astype(np.uint8).tobytes())
            yield f.assign(data=out)

    return images.mapInPandas(run, images.schema)
