"""Pixel operators on stacked images: separable resampling, signatures, hashes, edges and the figures of pairs.

Pixels are bytes, row by row, with one or more channels a pixel. The images of a batch that have one size are one array, so that
every operator is a few array operations for all of them; a stack holds at most ``STACK`` pixels, or one image.
Resampling is two matrix products, first along rows, then along columns, each rounded to whole grey levels. Shares are whole
multiples of 1 / ``ONE``, so that sums are exact and equal images have equal results whatever they are stacked with.

Defined results: an image is void if its bytes or a size are null, a size is not positive or the bytes are not width x height x channels.
Figures of a void image are null. Two images of no variation correlate fully if they are equal, else not at all. Repeated rows have equal results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE, BLOCK = 64, 8
#: Pixels of a stack that are worked on at once.
STACK = 1 << 22
ONE = 1 << 22


def triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(1 - np.abs(x), 0)


def lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)


KERNELS: dict[str, tuple[Callable[[np.ndarray], np.ndarray], float]] = {"triangle": (triangle, 1.0), "lanczos": (lanczos, 3.0)}


@lru_cache(maxsize=512)
def weights(before: int, after: int, kernel: str) -> np.ndarray:
    """(before, after): shares of the old pixels in each new one, times ``ONE``. The kernel widens with the scale where an image shrinks, and is cut at the edges."""
    shape, support = KERNELS[kernel]
    scale = before / after
    wide = max(scale, 1.0)
    centre = (np.arange(after) + 0.5) * scale
    first, last = (np.floor(centre + s * support * wide + 0.5) for s in (-1, 1))
    at = np.arange(before)[:, None]
    found = np.where((at >= first) & (at < last), shape((at + 0.5 - centre) / wide), 0.0)
    return np.floor(found / found.sum(axis=0) * ONE + 0.5)


def _levels(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((x + ONE // 2) / ONE), 0, 255)


def resample(stack: np.ndarray, height: int, width: int, kernel: str = "triangle") -> np.ndarray:
    """(n, h, w) grey levels to (n, height, width) as uint8; a side that keeps its size is left alone."""
    out = stack.astype(float)
    if out.shape[2] != width:
        out = _levels(out @ weights(out.shape[2], width, kernel))
    if out.shape[1] != height:
        out = _levels(np.einsum("nhw,hk->nkw", out, weights(out.shape[1], height, kernel), optimize=True))
    return out.astype(np.uint8)


def grey(stack: np.ndarray) -> np.ndarray:
    """Luminance (ITU-R 601 in 16-bit fixed point) of (n, h, w, channels); one channel is luminance already."""
    if stack.shape[3] == 1:
        return stack[..., 0]
    rgb = stack[..., :3].astype(np.int64)
    return ((rgb @ np.array([19595, 38470, 7471]) + 0x8000) >> 16).astype(np.uint8)


def edges(stack: np.ndarray) -> np.ndarray:
    """Eight times a pixel less its eight neighbours; pixels at the border stay as they are."""
    x = stack.astype(np.int64)
    out = x.copy()
    if min(x.shape[1:]) > 2:
        across = x[:, :, :-2] + x[:, :, 1:-1] + x[:, :, 2:]
        around = across[:, :-2] + across[:, 1:-1] + across[:, 2:]
        out[:, 1:-1, 1:-1] = np.clip(9 * x[:, 1:-1, 1:-1] - around, 0, 255)
    return out.astype(np.uint8)


def correlations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows of two (n, pixels) arrays, from whole sums."""
    x, y = a.astype(np.int64), b.astype(np.int64)
    n = x.shape[1]
    sx, sy = x.sum(1), y.sum(1)
    vx, vy = n * (x * x).sum(1) - sx * sx, n * (y * y).sum(1) - sy * sy
    flat = (vx == 0) | (vy == 0)
    varied = (n * (x * y).sum(1) - sx * sy) / np.where(flat, 1.0, np.sqrt(vx.astype(float)) * np.sqrt(vy.astype(float)))
    return np.where(flat, (x == y).all(1).astype(float), varied)


def similarities(a: np.ndarray, b: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Mean structural similarity over the blocks of (n, side, side) pairs; ``block`` divides the side."""
    n, side = a.shape[0], a.shape[1] // block
    x, y = (v.astype(float).reshape(n, side, block, side, block).swapaxes(2, 3).reshape(n, side * side, block * block) for v in (a, b))
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    mx, my = x.mean(2), y.mean(2)
    both = ((x - mx[..., None]) * (y - my[..., None])).mean(2)
    return ((2 * mx * my + c1) * (2 * both + c2) / ((mx**2 + my**2 + c1) * (x.var(2) + y.var(2) + c2))).mean(1)


def affinities(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bhattacharyya affinity of the grey-level histograms of (n, pixels) pairs."""
    n, size = a.shape
    row = np.arange(n)[:, None] * 256
    x, y = (np.bincount((row + v).ravel(), minlength=n * 256).reshape(n, 256) for v in (a, b))
    return np.sqrt(x * y).sum(1) / size


def hashes(stack: np.ndarray) -> np.ndarray:
    """(n, 4) signed 64-bit integers of (n, 64, 64): whether each pixel of a 16 x 16 grid is brighter than the one four on, row by row."""
    flat = stack.reshape(len(stack), SIDE * SIDE)
    at = (np.arange(16)[:, None] * 4 * SIDE + np.arange(16) * 4).ravel()
    return np.ascontiguousarray(np.packbits(flat[:, at] > flat[:, at + 4], axis=1)).view(">i8").astype(np.int64)


def _stacks(images: list[tuple[pd.Series, pd.Series, pd.Series]], channels: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Row numbers and one (n, h, w, channels) array for each of ``images``; rows with a void image are in none."""
    sizes = [pd.DataFrame({"n": data.map(len, na_action="ignore"), "w": w, "h": h}).astype("Float64") for data, w, h in images]
    fit = np.logical_and.reduce([((s.w > 0) & (s.h > 0) & (s.n == s.w * s.h * channels)).fillna(False).to_numpy(bool) for s in sizes])
    keys = pd.concat([s[["w", "h"]][fit].astype("int64").reset_index(drop=True) for s in sizes], axis=1)
    keys.columns = range(keys.shape[1])
    rows = np.flatnonzero(fit)
    for key, at in keys.groupby(list(keys.columns)).indices.items():
        shapes = [(key[2 * k + 1], key[2 * k], channels) for k in range(len(images))]
        step = max(1, STACK // max(int(np.prod(s)) for s in shapes))
        for begin in range(0, len(at), step):
            chosen = rows[at[begin : begin + step]]
            yield chosen, [np.frombuffer(b"".join(data.iloc[chosen]), np.uint8).reshape(-1, *shape) for (data, _, _), shape in zip(images, shapes, strict=True)]


def signature(content: Column, width: Column, height: Column, *, channels: int = 1, side: int = SIDE) -> Column:
    """Luminance of side x side pixels as bytes, by a triangle kernel."""

    @F.pandas_udf(T.BinaryType())
    def run(data: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        out = np.full(len(data), None, object)
        for rows, (stack,) in _stacks([(data, w, h)], channels):
            out[rows] = [x.tobytes() for x in resample(grey(stack), side, side)]
        return pd.Series(out)

    return run(content, width, height)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _hashed(data: pd.Series) -> pd.Series:
    out = np.full(len(data), None, object)
    side = pd.Series(SIDE, index=data.index)
    for rows, (stack,) in _stacks([(data, side, side)], 1):
        for row, value in zip(rows, hashes(stack[..., 0]).tolist(), strict=True):
            out[row] = value
    return pd.Series(out)


def difference_hash(content: Column) -> Column:
    """Four 64-bit integers of a 64 x 64 signature."""
    return _hashed(content)


def _figures(names: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def pair_diagnostics(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column], *, channels: int = 1, side: int = SIDE, block: int = BLOCK) -> Column:
    """Struct of corr, ssim, affinity and edge_corr between the signatures of two images, and of full_corr between all their pixels (null where sizes differ).

    ``a`` and ``b``: columns of bytes, width and height.
    """
    names = ("corr", "full_corr", "ssim", "affinity", "edge_corr")

    @F.pandas_udf(_figures(names))
    def run(ad: pd.Series, aw: pd.Series, ah: pd.Series, bd: pd.Series, bw: pd.Series, bh: pd.Series) -> pd.DataFrame:
        out = np.full((len(ad), len(names)), np.nan)
        for rows, stacks in _stacks([(ad, aw, ah), (bd, bw, bh)], channels):
            whole = [grey(s) for s in stacks]
            x, y = (resample(g, side, side) for g in whole)
            flat = [v.reshape(len(rows), -1) for v in (x, y, edges(x), edges(y))]
            full = correlations(*(g.reshape(len(rows), -1) for g in whole)) if whole[0].shape == whole[1].shape else np.nan
            for k, found in enumerate((correlations(*flat[:2]), full, similarities(x, y, block), affinities(*flat[:2]), correlations(*flat[2:]))):
                out[rows, k] = found
        return pd.DataFrame(out, columns=list(names)).astype(object).where(~np.isnan(out), None)

    return run(*a, *b)


def resize_metrics(original: tuple[Column, Column, Column], resized: tuple[Column, Column, Column], *, channels: int = 3, side: int = SIDE) -> Column:
    """Struct of mae and corr: mean absolute difference, over the channels, between the original brought to the resized image's size by
    a Lanczos kernel and the resized image, and the correlation of both signatures."""
    names = ("mae", "corr")

    @F.pandas_udf(_figures(names))
    def run(ad: pd.Series, aw: pd.Series, ah: pd.Series, bd: pd.Series, bw: pd.Series, bh: pd.Series) -> pd.DataFrame:
        out = np.full((len(ad), len(names)), np.nan)
        for rows, (x, y) in _stacks([(ad, aw, ah), (bd, bw, bh)], channels):
            off = sum(np.abs(resample(x[..., c], *y.shape[1:3], "lanczos").astype(int) - y[..., c]).mean((1, 2)) for c in range(channels)) / channels
            out[rows, 0] = off
            out[rows, 1] = correlations(*(resample(grey(v), side, side).reshape(len(rows), -1) for v in (x, y)))
        return pd.DataFrame(out, columns=list(names)).astype(object).where(~np.isnan(out), None)

    return run(*original, *resized)
