"""Image operations in numpy over planar arrays, and their use on columns.

An image is (channels, height, width) or (height, width); functions keep integer
types by rounding and saturating.  ``on_column`` runs one over an array column in
Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Luma weights and offsets of limited-range colour, and the inverse matrices: (y, r-v, g-u, g-v, b-u).
TO_RGB = {"bt709": (1.164384, 1.792741, -0.213249, -0.532909, 2.112402), "bt601": (1.164384, 1.596027, -0.391762, -0.812968, 2.017232), "bt2020": (1.164384, 1.678674, -0.187326, -0.650424, 2.141772)}
#: Red and blue weights of luma.
KR_KB = {"bt709": (0.2126, 0.0722), "bt601": (0.299, 0.114), "bt2020": (0.2627, 0.0593)}
#: Planes of pixel formats: (share of the width, share of the height) of each, and bits.
FORMATS = {
    "YUV420P": ([(1, 1), (2, 2), (2, 2)], 8), "YUV422P": ([(1, 1), (2, 1), (2, 1)], 8), "YUV444P": ([(1, 1), (1, 1), (1, 1)], 8), "NV12": ([(1, 1), (1, 2)], 8), "NV21": ([(1, 1), (1, 2)], 8),
    "P010": ([(1, 1), (1, 2)], 16), "YUV420P10": ([(1, 1), (2, 2), (2, 2)], 16), "GRAY8": ([(1, 1)], 8), "GRAY16": ([(1, 1)], 16), "RGB24": ([(1, 1)], 8), "BGR24": ([(1, 1)], 8), "RGBA32": ([(1, 1)], 8),
}


def saturate(x: np.ndarray, dtype: str | np.dtype) -> np.ndarray:
    """Rounded half away from zero and held to an integer type's range."""
    dtype = np.dtype(dtype)
    if dtype.kind == "f":
        return x.astype(dtype)
    info = np.iinfo(dtype)
    return np.clip(np.sign(x) * np.floor(np.abs(x) + 0.5), info.min, info.max).astype(dtype)


def planes(data: bytes, width: int, height: int, fmt: str) -> list[np.ndarray]:
    """A raw frame's planes."""
    shares, bits = FORMATS[fmt]
    values, at, out = np.frombuffer(data, np.uint8 if bits == 8 else np.uint16), 0, []
    per = {"RGB24": 3, "BGR24": 3, "RGBA32": 4}.get(fmt, 1)
    for k, (sw, sh) in enumerate(shares):
        interleaved = 2 if fmt in ("NV12", "NV21", "P010") and k else 1
        w, h = -(-width // (sw * interleaved)), -(-height // sh)
        n = w * h * per * interleaved
        shape = (h, w, per * interleaved) if per * interleaved > 1 else (h, w)
        out.append(values[at : at + n].reshape(shape))
        at += n
    return out


def nv12_to_yuv420p(y: np.ndarray, uv: np.ndarray, swapped: bool = False) -> list[np.ndarray]:
    u, v = uv[..., 0], uv[..., 1]
    return [y, v, u] if swapped else [y, u, v]


def yuv420p_to_nv12(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    return [y, np.stack([u, v], axis=-1)]


def yuv_to_rgb(y: np.ndarray, u: np.ndarray, v: np.ndarray, space: str = "bt709", dtype: str = "uint8") -> np.ndarray:
    """(3, height, width) from planes; chroma of lower resolution is repeated."""
    ky, rv, gu, gv, bu = TO_RGB[space]
    u, v = (np.repeat(np.repeat(p, -(-y.shape[0] // p.shape[0]), 0), -(-y.shape[1] // p.shape[1]), 1)[: y.shape[0], : y.shape[1]].astype(float) - 128 for p in (u, v))
    luma = (y.astype(float) - 16) * ky
    return saturate(np.stack([luma + rv * v, luma + gu * u + gv * v, luma + bu * u]), dtype)


def rgb_to_yuv(rgb: np.ndarray, space: str = "bt709") -> np.ndarray:
    """(3, height, width) of full-resolution limited-range Y, U, V."""
    kr, kb = KR_KB[space]
    r, g, b = rgb.astype(float)
    luma = kr * r + (1 - kr - kb) * g + kb * b
    y = 16 + luma * 219 / 255
    u = 128 + (b - luma) / (2 * (1 - kb)) * 224 / 255
    v = 128 + (r - luma) / (2 * (1 - kr)) * 224 / 255
    return saturate(np.stack([y, u, v]), "uint8")


def to_gray(rgb: np.ndarray) -> np.ndarray:
    return saturate(0.299 * rgb[0] + 0.587 * rgb[1] + 0.114 * rgb[2], rgb.dtype)


def _cubic(t: np.ndarray, a: float = -0.75) -> np.ndarray:
    t = np.abs(t)
    return np.where(t <= 1, ((a + 2) * t - (a + 3)) * t * t + 1, np.where(t < 2, (((t - 5) * t + 8) * t - 4) * a, 0.0))


def _axis(n: int, to: int, mode: str) -> tuple[np.ndarray, np.ndarray]:
    """Source places (to, taps) and weights of each output place."""
    scale = n / to
    if mode == "nearest":
        return np.minimum((np.arange(to) * scale).astype(int), n - 1)[:, None], np.ones((to, 1))
    at = np.arange(to) * scale + 0.5 * scale - 0.5
    low = np.floor(at).astype(int)
    taps = np.arange(2) if mode == "bilinear" else np.arange(-1, 3)
    where = low[:, None] + taps
    away = at[:, None] - where
    weight = np.maximum(0, 1 - np.abs(away)) if mode == "bilinear" else _cubic(away)
    return np.clip(where, 0, n - 1), weight


def resize(x: np.ndarray, width: int, height: int, mode: str = "bilinear") -> np.ndarray:
    """Nearest, bilinear or bicubic over the last two axes."""
    (ry, wy), (rx, wx) = _axis(x.shape[-2], height, mode), _axis(x.shape[-1], width, mode)
    rows = np.einsum("...tkw,tk->...tw", x.astype(float)[..., ry, :], wy)
    return saturate(np.einsum("...htk,tk->...ht", rows[..., rx], wx), x.dtype)


def rotate(x: np.ndarray, degrees: int) -> np.ndarray:
    """Clockwise by a multiple of 90."""
    return np.rot90(x, -(degrees // 90), axes=(-2, -1)).copy()


def mirror(x: np.ndarray, axis: str) -> np.ndarray:
    return {"horizontal": x[..., ::-1], "vertical": x[..., ::-1, :], "both": x[..., ::-1, ::-1]}[axis].copy()


def crop(x: np.ndarray, left: int, top: int, width: int, height: int) -> np.ndarray:
    return x[..., top : top + height, left : left + width].copy()


def pad(x: np.ndarray, left: int, top: int, width: int, height: int, value: float = 0) -> np.ndarray:
    out = np.full((*x.shape[:-2], height, width), value, x.dtype)
    out[..., top : top + x.shape[-2], left : left + x.shape[-1]] = x
    return out


def normalize(x: np.ndarray, mean: list[float], std: list[float]) -> np.ndarray:
    shape = (-1, 1, 1)
    return (x.astype(np.float32) - np.array(mean, np.float32).reshape(shape)) / np.array(std, np.float32).reshape(shape)


def _around(x: np.ndarray, kh: int, kw: int, mode: str = "reflect", value: float = 0) -> np.ndarray:
    """(..., height, width, kh, kw): the neighbourhood of each place."""
    width = [(0, 0)] * (x.ndim - 2) + [(kh // 2, kh - 1 - kh // 2), (kw // 2, kw - 1 - kw // 2)]
    padded = np.pad(x, width, mode="constant", constant_values=value) if mode == "constant" else np.pad(x, width, mode=mode)
    return np.lib.stride_tricks.sliding_window_view(padded, (kh, kw), axis=(-2, -1))


def filter2d(x: np.ndarray, kernel: np.ndarray, delta: float = 0.0) -> np.ndarray:
    """Correlation with a kernel; the border is reflected."""
    kernel = np.asarray(kernel, float)
    return saturate(np.einsum("...ij,ij->...", _around(x.astype(float), *kernel.shape), kernel) + delta, x.dtype)


def gaussian_kernel(size: int, sigma: float) -> np.ndarray:
    sigma = sigma if sigma > 0 else 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - (size - 1) / 2) ** 2) / (2 * sigma * sigma))
    return k / k.sum()


def gaussian_blur(x: np.ndarray, kx: int, ky: int, sigma: float = 0.0) -> np.ndarray:
    return filter2d(x, np.outer(gaussian_kernel(ky, sigma), gaussian_kernel(kx, sigma)))


def box_blur(x: np.ndarray, kx: int, ky: int) -> np.ndarray:
    return filter2d(x, np.full((ky, kx), 1 / (kx * ky)))


def median_blur(x: np.ndarray, size: int) -> np.ndarray:
    return saturate(np.median(_around(x, size, size, "edge"), axis=(-2, -1)), x.dtype)


def bilateral_filter(x: np.ndarray, size: int, sigma_color: float, sigma_space: float) -> np.ndarray:
    near, own = _around(x.astype(float), size, size), x.astype(float)[..., None, None]
    d = np.arange(size) - size // 2
    space = np.exp(-(d[:, None] ** 2 + d[None] ** 2) / (2 * sigma_space**2))
    w = space * np.exp(-((near - own) ** 2) / (2 * sigma_color**2))
    return saturate((w * near).sum((-2, -1)) / w.sum((-2, -1)), x.dtype)


def erode(x: np.ndarray, size: int = 3) -> np.ndarray:
    return _around(x, size, size, "edge").min(axis=(-2, -1))


def dilate(x: np.ndarray, size: int = 3) -> np.ndarray:
    return _around(x, size, size, "edge").max(axis=(-2, -1))


def sobel(x: np.ndarray, dx: int, dy: int, scale: float = 1.0, delta: float = 0.0) -> np.ndarray:
    smooth, first, second = [1, 2, 1], [-1, 0, 1], [1, -2, 1]
    pick = lambda d: [smooth, first, second][d]
    return np.einsum("...ij,ij->...", _around(x.astype(float), 3, 3), np.outer(pick(dy), pick(dx))) * scale + delta


def canny(x: np.ndarray, low: float, high: float, l2: bool = False) -> np.ndarray:
    """Edges (0 or 255): gradients, thinning along their direction, and hysteresis."""
    gx, gy = sobel(x, 1, 0), sobel(x, 0, 1)
    size = np.hypot(gx, gy) if l2 else np.abs(gx) + np.abs(gy)
    sector = np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
    padded, thin = np.pad(size, 1), np.zeros(size.shape, bool)
    h, w = size.shape
    for k, (dy, dx) in enumerate([(0, 1), (1, 1), (1, 0), (1, -1)]):
        a, b = padded[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w], padded[1 - dy : 1 - dy + h, 1 - dx : 1 - dx + w]
        thin |= (sector == k) & (size > b) & (size >= a)
    edges, weak = thin & (size > high), thin & (size > low)
    while True:
        grown = dilate(edges.astype(np.uint8)).astype(bool) & weak
        if (grown == edges).all():
            return np.where(edges, 255, 0).astype(np.uint8)
        edges = grown


def warp_perspective(x: np.ndarray, matrix: np.ndarray, width: int, height: int, mode: str = "bicubic") -> np.ndarray:
    """Each output place takes the source at the inverse matrix's place; outside is 0."""
    inverse = np.linalg.inv(np.asarray(matrix, float))
    gx, gy = np.meshgrid(np.arange(width), np.arange(height))
    sx, sy, sw = inverse @ np.stack([gx.ravel(), gy.ravel(), np.ones(gx.size)])
    sx, sy = (sx / sw).reshape(height, width), (sy / sw).reshape(height, width)
    taps = {"nearest": [0], "bilinear": [0, 1], "bicubic": [-1, 0, 1, 2]}[mode]
    fx, fy = (np.rint(sx), np.rint(sy)) if mode == "nearest" else (np.floor(sx), np.floor(sy))
    weigh = {"nearest": lambda t: np.ones_like(t), "bilinear": lambda t: np.maximum(0, 1 - np.abs(t)), "bicubic": _cubic}[mode]
    out = np.zeros((*x.shape[:-2], height, width))
    for i in taps:
        for j in taps:
            px, py = (fx + j).astype(int), (fy + i).astype(int)
            inside = (px >= 0) & (px < x.shape[-1]) & (py >= 0) & (py < x.shape[-2])
            value = x[..., np.clip(py, 0, x.shape[-2] - 1), np.clip(px, 0, x.shape[-1] - 1)] * inside
            out += value * weigh(sx - px) * weigh(sy - py)
    return saturate(out, x.dtype)


def overlay(below: np.ndarray, above: np.ndarray, alpha: np.ndarray | float) -> np.ndarray:
    return saturate(below * (1 - np.asarray(alpha)) + above * np.asarray(alpha), below.dtype)


def gamma(x: np.ndarray, g: float) -> np.ndarray:
    return saturate((x / 255.0) ** g * 255, x.dtype)


def on_column(df: DataFrame, column: str, shape: tuple[int, ...], operation: Callable[..., np.ndarray], *args, dtype: str = "float64", **named) -> DataFrame:
    """df with the images of an array column (of that shape) changed, in Arrow batches."""

    @F.pandas_udf("array<double>")
    def change(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else operation(np.asarray(v, float).astype(dtype).reshape(shape), *args, **named).astype(float).ravel())

    return df.withColumn(column, change(F.col(column)))
