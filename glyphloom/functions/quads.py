"""Common areas of convex quadrilaterals, as columns of eight numbers: x and y of each corner, one after the other."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _areas(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Signed areas of polygons in rows; corners that are repeated add nothing."""
    return (x * np.roll(y, -1, axis=1) - np.roll(x, -1, axis=1) * y).sum(axis=1) / 2


def _clipped(x: np.ndarray, y: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polygons in rows, cut by the half plane on the left of a to b. Each corner makes way for two: itself, or where its edge
    enters, and where its edge leaves; corners that are cut off fall together with a neighbour."""
    side = (bx - ax)[:, None] * (y - ay[:, None]) - (by - ay)[:, None] * (x - ax[:, None])
    nx, ny, nside = np.roll(x, -1, axis=1), np.roll(y, -1, axis=1), np.roll(side, -1, axis=1)
    crosses = (side >= 0) != (nside >= 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(crosses, side / (side - nside), 0.0)
    cx, cy = x + t * (nx - x), y + t * (ny - y)
    n = x.shape[1]
    ox, oy, kept = np.empty((len(x), 2 * n)), np.empty((len(x), 2 * n)), np.empty((len(x), 2 * n), bool)
    ox[:, 0::2], oy[:, 0::2], kept[:, 0::2] = x, y, side >= 0
    ox[:, 1::2], oy[:, 1::2], kept[:, 1::2] = cx, cy, crosses
    # Kept corners first, in order; the places behind them repeat the last one.
    order = np.argsort(~kept, axis=1, kind="stable")
    count = kept.sum(axis=1)
    at = np.minimum(np.arange(n + 1)[None, :], np.maximum(count - 1, 0)[:, None])
    order = np.take_along_axis(order, at, axis=1)
    ox, oy = np.take_along_axis(ox, order, axis=1), np.take_along_axis(oy, order, axis=1)
    ox[count == 0], oy[count == 0] = 0.0, 0.0
    return ox, oy


def common_areas(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Areas of a, of b and of what they have in common, for rows of four corners (n x 4 x 2), in either direction of turn."""
    sides = []
    for q in (a, b):
        q = np.array(q, float)
        turned = _areas(q[:, :, 0], q[:, :, 1]) < 0
        q[turned] = q[turned][:, ::-1]
        sides.append(q)
    a, b = sides
    x, y = a[:, :, 0], a[:, :, 1]
    for k in range(4):
        p, q = b[:, k], b[:, (k + 1) % 4]
        x, y = _clipped(x, y, p[:, 0], p[:, 1], q[:, 0], q[:, 1])
    areas = [_areas(q[:, :, 0], q[:, :, 1]) for q in (a, b)]
    common = np.where((areas[0] > 0) & (areas[1] > 0), np.maximum(_areas(x, y), 0), 0.0)
    return areas[0], areas[1], common


def quad_iou(a: Column, b: Column) -> Column:
    """The IoU of two convex quadrilaterals (arrays of eight numbers); 0 where one is null, has another size or no area."""

    @F.pandas_udf("double")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        out = np.zeros(len(left))
        whole = np.array([x is not None and y is not None and len(x) == 8 and len(y) == 8 for x, y in zip(left, right, strict=True)], bool)
        if whole.any():
            quads = (np.stack(s[whole].to_numpy()).astype(float).reshape(-1, 4, 2) for s in (left, right))
            first, second, common = common_areas(*quads)
            union = first + second - common
            out[whole] = np.where(union > 0, common / np.where(union > 0, union, 1), 0.0)
        return pd.Series(out)

    return run(a, b)


def boxed(quad: Column) -> dict[str, Column]:
    """The box about a quadrilateral, by which it meets others in the grid join."""
    xs, ys = F.filter(quad, lambda _, i: i % 2 == 0), F.filter(quad, lambda _, i: i % 2 == 1)
    return {"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}
