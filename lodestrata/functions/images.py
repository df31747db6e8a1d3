"""Image operators on bytes and raw luminance: header sizes, signatures, difference hash, SSIM, histograms, masks.

No image library is needed: pixels come as arrays. Decoding is left to a function that the caller gives.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE = 64


def _struct(kind: T.DataType, *names: str) -> T.StructType:
    return T.StructType([T.StructField(n, kind) for n in names])


def header_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) from a PNG or JPEG header; None if there is none or it is damaged."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        if len(data) < 24:
            return None
        width, height = struct.unpack(">II", data[16:24])
        return (width, height) if width and height else None
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while (at := data.find(b"\xff", at)) >= 0:
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at >= len(data):
            return None
        marker, at = data[at], at + 1
        if marker in (0x01, 0xD8, 0xD9) or 0xD0 <= marker <= 0xD7:
            continue
        if at + 2 > len(data):
            return None
        (size,) = struct.unpack(">H", data[at : at + 2])
        if size < 2:
            return None
        frame = 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)
        if frame:
            if at + 7 > len(data):
                return None
            height, width = struct.unpack(">HH", data[at + 3 : at + 7])
            return (width, height) if width and height else None
        at += size
    return None


@F.pandas_udf(_struct(T.IntegerType(), "width", "height"))
def image_size(content: pd.Series) -> pd.DataFrame:
    """Sizes from headers; both null where no header can be read."""
    found = [header_size(x) if x is not None else None for x in content]
    return pd.DataFrame({"width": pd.array([f and f[0] for f in found], "Int32"), "height": pd.array([f and f[1] for f in found], "Int32")})


def difference_hash(signature: bytes) -> list[int]:
    """256 bits as four signed 64-bit integers, first bits first.

    On a 64 x 64 luminance a grid of 16 x 16 pixels is compared with the pixel four to the right;
    the last column's neighbour is the next row's first pixel.
    """
    pixels = np.frombuffer(signature, np.uint8)
    at = (np.arange(16)[:, None] * 4 * SIDE + np.arange(16)[None, :] * 4).ravel()
    return np.packbits(pixels[at] > pixels[at + 4]).view(">i8").tolist()


def block_ssim(a: bytes, b: bytes) -> float:
    """Mean structural similarity over the 8 x 8 blocks of two 64 x 64 luminances."""
    x, y = (np.frombuffer(v, np.uint8).astype(float).reshape(8, 8, 8, 8).swapaxes(1, 2).reshape(64, 64) for v in (a, b))
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    mx, my = x.mean(1), y.mean(1)
    cov = (x * y).mean(1) - mx * my
    return float(np.mean((2 * mx * my + c1) * (2 * cov + c2) / ((mx**2 + my**2 + c1) * (x.var(1) + y.var(1) + c2))))


def histogram_affinity(a: bytes, b: bytes) -> float:
    """Bhattacharyya affinity of two luminance histograms."""
    x, y = (np.bincount(np.frombuffer(v, np.uint8), minlength=256) for v in (a, b))
    return float(np.sqrt(x * y).sum() / max(len(a), 1))


def correlation(a: bytes, b: bytes) -> float | None:
    if len(a) != len(b) or not a:
        return None
    x, y = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (a, b))
    n = len(a)
    va, vb = n * int((x * x).sum()) - int(x.sum()) ** 2, n * int((y * y).sum()) - int(y.sum()) ** 2
    if not va or not vb:
        return float(a == b)
    return (n * int((x * y).sum()) - int(x.sum()) * int(y.sum())) / (va * vb) ** 0.5


@F.pandas_udf(T.ArrayType(T.LongType()))
def difference_hashes(signature: pd.Series) -> pd.Series:
    return signature.map(lambda s: difference_hash(bytes(s)) if s is not None and len(s) == SIDE * SIDE else None)


@F.pandas_udf(_struct(T.DoubleType(), "corr64", "ssim", "affinity"))
def pair_diagnostics(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """One pass over candidate pairs of 64 x 64 luminances."""
    rows = [(correlation(bytes(x), bytes(y)), block_ssim(x, y), histogram_affinity(x, y)) for x, y in zip(a, b, strict=True)]
    return pd.DataFrame(rows, columns=["corr64", "ssim", "affinity"])


def raster(polygons: list[list[tuple[float, float]]], width: int, height: int) -> np.ndarray:
    """Mask of pixels whose centre lies in any polygon (even-odd rule)."""
    x, y = np.meshgrid(np.arange(width) + 0.5, np.arange(height) + 0.5)
    mask = np.zeros((height, width), bool)
    for points in polygons:
        inside = np.zeros_like(mask)
        for (x0, y0), (x1, y1) in zip(points, points[1:] + points[:1], strict=True):
            if y0 != y1:
                inside ^= ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
        mask |= inside
    return mask


def mask_iou(a: list, b: list, width: int, height: int) -> float:
    """Of two lists of polygons; 0 if both masks are empty."""
    x, y = raster(a, width, height), raster(b, width, height)
    union = int((x | y).sum())
    return int((x & y).sum()) / union if union else 0.0


@F.pandas_udf(T.DoubleType())
def _mask_overlaps(a: pd.Series, b: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    rows = zip(a, b, width, height, strict=True)
    return pd.Series([mask_iou(json.loads(x), json.loads(y), int(w), int(h)) if isinstance(x, str) and isinstance(y, str) else None for x, y, w, h in rows], dtype="float64")


def mask_overlaps(a: str, b: str, width: Column, height: Column) -> Column:
    """``mask_iou`` of two columns of polygon lists (arrays of arrays of [x, y]); null where a side is null. Lists travel as JSON text."""
    return _mask_overlaps(F.to_json(a), F.to_json(b), width, height)


def decode(files: DataFrame, decoder: Callable[[bytes], np.ndarray], content: str = "content") -> DataFrame:
    """Adds status (decoded or unreadable), width, height and the luminance as bytes. ``decoder``: bytes to a 2-D uint8 array, or an exception."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for data in frame[content]:
                try:
                    pixels = decoder(bytes(data))
                    rows.append(("decoded", pixels.shape[1], pixels.shape[0], pixels.astype(np.uint8).tobytes()))
                except Exception:  # a decoder may raise anything on a damaged file; the status says so
                    rows.append(("unreadable", None, None, None))
            extra = pd.DataFrame(rows, columns=["status", "width", "height", "luminance"], index=frame.index)
            yield frame.drop(columns=[content]).assign(**{c: extra[c] for c in extra})

    kept = [f for f in files.schema.fields if f.name != content]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return files.mapInPandas(run, f"{schema}, status string, width int, height int, luminance binary")


def signature_column(luminance: Column) -> Column:
    return difference_hashes(luminance)
