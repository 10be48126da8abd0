"""Kernels over one page's pixels in numpy: resizing, tensors, quarter turns and rectification."""

from __future__ import annotations

import numpy as np


def weights(size: int, out: int) -> np.ndarray:
    """Rows of a triangle filter that widens with the scale: out x size, each row summing to 1."""
    scale = size / out
    support = max(scale, 1.0)
    centre = (np.arange(out) + 0.5) * scale
    low = np.maximum((centre - support + 0.5).astype(int), 0)
    high = np.minimum((centre + support + 0.5).astype(int), size)
    at = np.arange(size)
    w = np.clip(1 - np.abs((at[None] + 0.5 - centre[:, None]) / support), 0, None)
    w *= (at[None] >= low[:, None]) & (at[None] < high[:, None])
    return (w / w.sum(1, keepdims=True)).astype(np.float32)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """image: h x w x 3. Columns first, then rows; rounded half to even, in 0 to 255."""
    across = np.einsum("ow,hwc->hoc", weights(image.shape[1], width), image.astype(np.float32))
    down = np.einsum("oh,hwc->owc", weights(image.shape[0], height), across)
    return np.clip(np.rint(down), 0, 255).astype(np.uint8)


def prepared(image: np.ndarray, height: int, width: int, symmetric: bool, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """A 3 x height x width tensor with the aspect kept; what is left is filled with black, on both sides if symmetric."""
    h, w = image.shape[:2]
    scale = min(height / h, width / w)
    new_h, new_w = min(max(int(h * scale), 1), height), min(max(int(w * scale), 1), width)
    top, left = (-(-(height - new_h) // 2), -(-(width - new_w) // 2)) if symmetric else (0, 0)
    out = np.zeros((height, width, 3), np.float32)
    out[top : top + new_h, left : left + new_w] = resized(image, new_h, new_w) / np.float32(255)
    return ((out - mean.astype(np.float32)) / std.astype(np.float32)).transpose(2, 0, 1)


def quarter_turned(image: np.ndarray, degrees: int) -> np.ndarray:
    """The page put right, which is turned clockwise by a quarter: no pixel is lost."""
    return np.rot90(image, degrees // 90 % 4)


def rectified(image: np.ndarray, degrees: float) -> np.ndarray:
    """The page turned by a small angle on a canvas that holds it all, bilinear, with a white border."""
    h, w = image.shape[:2]
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    out_w, out_h = int(np.ceil(w * abs(c) + h * abs(s))), int(np.ceil(w * abs(s) + h * abs(c)))
    y, x = np.mgrid[0:out_h, 0:out_w]
    dx, dy = x + 0.5 - out_w / 2, y + 0.5 - out_h / 2
    sx, sy = c * dx - s * dy + w / 2 - 0.5, s * dx + c * dy + h / 2 - 0.5
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = (sx - x0)[..., None], (sy - y0)[..., None]
    padded = np.pad(image.astype(float), ((1, 1), (1, 1), (0, 0)), constant_values=255)

    def at(yy: np.ndarray, xx: np.ndarray) -> np.ndarray:
        return padded[np.clip(yy + 1, 0, h + 1), np.clip(xx + 1, 0, w + 1)]

    top, bottom = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx, at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
    return np.rint(top * (1 - fy) + bottom * fy).astype(np.uint8)
