"""Stencil operators over packed rasters, one Arrow batch at a time: labelling, spline rotation, resizing, contours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat indices of the mask's pixels and the first flat index of each one's 4-connected component."""
    h, w = mask.shape
    padded = np.zeros((h, w + 1), np.int8)
    padded[:, :w] = mask
    flat = np.diff(padded.ravel(), prepend=0)
    starts, ends = np.flatnonzero(flat == 1), np.flatnonzero(flat == -1)  # runs within rows, in a grid of width w + 1
    parent = np.arange(len(starts))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(ends, starts - (w + 1), "right")  # runs of the row above that touch, by order
    last = np.searchsorted(starts, ends - (w + 1), "left")
    for i in np.flatnonzero(last > first):
        for j in range(first[i], last[i]):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    roots = np.array([root(i) for i in range(len(parent))], int)
    origin = starts // (w + 1) * w + starts % (w + 1)
    lengths = ends - starts
    pixels = np.repeat(origin, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return pixels, np.repeat(origin[roots], lengths) if len(roots) else pixels


def label_components(rasters: DataFrame, level: float, key: str = "raster_id") -> DataFrame:
    """(key, x, y, island_id) of the pixels at or over `level`; an island's id is its first pixel, y * w + x, in scan order."""

    def label(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for data, h, w in zip(f["data"], f["h"], f["w"], strict=True):
                with np.errstate(invalid="ignore"):
                    out.append(label_runs(np.asarray(data, float).reshape(h, w) >= level))
            yield pd.DataFrame({key: f[key], "w": f["w"], "i": [o[0].tolist() for o in out], "island": [o[1].tolist() for o in out]})

    kind = rasters.schema[key].dataType.simpleString()
    found = rasters.select(key, "h", "w", "data").mapInPandas(label, f"{key} {kind}, w int, i array<long>, island array<long>")
    one = F.explode(F.arrays_zip("i", "island")).alias("p")
    return found.select(key, "w", one).select(key, (F.col("p.i") % F.col("w")).cast("int").alias("x"), F.floor(F.col("p.i") / F.col("w")).cast("int").alias("y"), F.col("p.island").alias("island_id"))


def spline_coefficients(a: np.ndarray) -> np.ndarray:
    """Cubic B-spline coefficients along both axes, mirrored at the edges."""
    pole = np.sqrt(3.0) - 2.0
    for axis in (0, 1):
        c = np.moveaxis(a.astype(float).copy(), axis, 0) * 6.0
        n = len(c)
        if n > 1:
            mirror = np.concatenate([c, c[-2:0:-1]])
            full = pole ** np.arange(len(mirror))
            c[0] = np.tensordot(full, mirror, (0, 0)) / (1 - pole ** len(mirror))
            for i in range(1, n):
                c[i] += pole * c[i - 1]
            c[n - 1] = (pole / (pole * pole - 1)) * (c[n - 1] + pole * c[n - 2])
            for i in range(n - 2, -1, -1):
                c[i] = pole * (c[i + 1] - c[i])
        a = np.moveaxis(c, 0, axis)
    return a


def _mirrored(i: np.ndarray, n: int) -> np.ndarray:
    if n == 1:
        return np.zeros_like(i)
    i = np.abs(i) % (2 * n - 2)
    return np.where(i >= n, 2 * n - 2 - i, i)


def rotate(a: np.ndarray, degrees: float) -> np.ndarray:
    """Cubic-spline rotation about the centre in the same shape, 0 outside; quarter turns of squares are exact."""
    h, w = a.shape
    if degrees % 360 == 0:
        return a.astype(float)
    if h == w and degrees % 90 == 0:
        return np.rot90(a, int(degrees // 90) % 4).astype(float)
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    y, x = np.mgrid[:h, :w].astype(float)
    cy, cx = (h - 1) / 2, (w - 1) / 2
    sy, sx = c * (y - cy) + s * (x - cx) + cy, -s * (y - cy) + c * (x - cx) + cx
    inside = (sy >= 0) & (sy <= h - 1) & (sx >= 0) & (sx <= w - 1)
    k = spline_coefficients(a)
    iy, ix = np.floor(sy).astype(int), np.floor(sx).astype(int)

    def weights(t: np.ndarray) -> list[np.ndarray]:
        return [(1 - t) ** 3 / 6, (4 - 6 * t**2 + 3 * t**3) / 6, (1 + 3 * t + 3 * t**2 - 3 * t**3) / 6, t**3 / 6]

    out = np.zeros((h, w))
    for dy, wy in enumerate(weights(sy - iy)):
        for dx, wx in enumerate(weights(sx - ix)):
            out += wy * wx * k[_mirrored(iy + dy - 1, h), _mirrored(ix + dx - 1, w)]
    return np.where(inside, out, 0.0)


def resize(a: np.ndarray, oh: int, ow: int, anti_aliasing: bool = True) -> np.ndarray:
    """Bilinear resize, after a Gaussian of deviation (factor - 1) / 2 along axes that shrink."""
    a = a.astype(float)
    for axis, out in ((0, oh), (1, ow)):
        n = a.shape[axis]
        factor = n / out
        a = np.moveaxis(a, axis, 0)
        sigma = max(0.0, (factor - 1) / 2)
        if anti_aliasing and sigma > 0:
            r = int(4 * sigma + 0.5)
            kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
            kernel /= kernel.sum()
            at = np.clip(np.arange(n)[:, None] + np.arange(-r, r + 1), 0, n - 1)
            a = np.einsum("nk...,k->n...", a[at], kernel)
        at = np.clip((np.arange(out) + 0.5) * factor - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        t = (at - low).reshape(-1, *[1] * (a.ndim - 1))
        a = np.moveaxis((1 - t) * a[low] + t * a[np.minimum(low + 1, n - 1)], 0, axis)
    return a


def crop(a: np.ndarray, cw: int, ch: int) -> np.ndarray:
    h, w = a.shape
    y, x = h // 2 - ch // 2, w // 2 - cw // 2
    return a[y : y + ch, x : x + cw]


def rotated_rasters(rasters: DataFrame, angles: list[float], crop_size: tuple[int, int] | None = None, dynamic: bool = False, key: str = "raster_id") -> DataFrame:
    """A row for each raster and angle: (key, angle_index, angle, h, w, data). Either crop size or the least inscribed rectangle, or none."""
    if crop_size and dynamic:
        raise ValueError("give a crop size or dynamic cropping, not both")
    from .geometry import inscribed_rectangle

    def turn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k, data, h, w in zip(f[key], f["data"], f["h"], f["w"], strict=True):
                a = np.asarray(data, float).reshape(h, w)
                size = crop_size or (tuple(np.min([inscribed_rectangle(w, h, t) for t in angles], axis=0)) if dynamic else (w, h))
                turned = [crop(rotate(a, t), *map(int, size)) for t in angles]
                yield pd.DataFrame({key: k, "angle_index": range(len(angles)), "angle": angles, "h": [t.shape[0] for t in turned], "w": [t.shape[1] for t in turned], "data": [t.ravel() for t in turned]})

    kind = rasters.schema[key].dataType.simpleString()
    return rasters.select(key, "h", "w", "data").mapInPandas(turn, f"{key} {kind}, angle_index int, angle double, h int, w int, data array<double>")


def resized_rasters(rasters: DataFrame, scale: str, key: str = "raster_id") -> DataFrame:
    """Rasters resized to int(shape * scale) by a scale column; `error` says why a raster has none."""

    def scaled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, data, h, w, s in zip(f[key], f["data"], f["h"], f["w"], f[scale], strict=True):
                good = s is not None and np.isfinite(s) and int(h * s) > 0 and int(w * s) > 0
                a = resize(np.asarray(data, float).reshape(h, w), int(h * s), int(w * s)) if good else None
                rows.append((k, a.shape[0] if good else None, a.shape[1] if good else None, a.ravel() if good else None, None if good else f"no image at scale {s}"))
            yield pd.DataFrame(rows, columns=[key, "h", "w", "data", "error"])

    kind = rasters.schema[key].dataType.simpleString()
    return rasters.select(key, "h", "w", "data", scale).mapInPandas(scaled, f"{key} {kind}, h int, w int, data array<double>, error string")


def contours(mask: np.ndarray) -> list[np.ndarray]:
    """External borders of 8-connected regions as (x, y) points where the direction changes; regions under three points have none."""
    h, w = mask.shape
    held = np.zeros((h + 2, w + 2), bool)
    held[1:-1, 1:-1] = mask
    seen = np.zeros_like(held)
    around = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    out = []
    for y0, x0 in zip(*np.nonzero(held), strict=True):
        if seen[y0, x0]:
            continue
        stack = [(y0, x0)]  # marks the whole region, so its inner borders start nothing
        seen[y0, x0] = True
        while stack:
            y, x = stack.pop()
            for dy, dx in around:
                if held[y + dy, x + dx] and not seen[y + dy, x + dx]:
                    seen[y + dy, x + dx] = True
                    stack.append((y + dy, x + dx))
        points, steps, y, x, back, first = [(x0 - 1, y0 - 1)], [], y0, x0, 4, None
        while True:
            for k in range(1, 9):
                d = (back + k) % 8
                if held[y + around[d][0], x + around[d][1]]:
                    break
            else:
                break
            if (y, x) == (y0, x0) and d == first:
                break
            first = d if first is None else first
            steps.append(d)
            y, x, back = y + around[d][0], x + around[d][1], (d + 4) % 8
            points.append((x - 1, y - 1))
        corners = [p for i, p in enumerate(points[:-1]) if steps[i] != steps[i - 1]] if steps else points
        if len(corners) >= 3:
            out.append(np.array(corners))
    return out


def polygons(masks: DataFrame, key: str = "raster_id") -> DataFrame:
    """(key, polygons) of packed masks, each polygon flat: x, y, x, y, ..."""

    def traced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "polygons": [[c.ravel().tolist() for c in contours(np.asarray(d, float).reshape(h, w) > 0)] for d, h, w in zip(f["data"], f["h"], f["w"], strict=True)]})

    kind = masks.schema[key].dataType.simpleString()
    return masks.select(key, "h", "w", "data").mapInPandas(traced, f"{key} {kind}, polygons array<array<int>>")
