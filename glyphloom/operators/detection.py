"""From a probability map to word boxes: threshold, opening, components, scores, expansion and un-padding.

Per-pixel steps exist as relations for small maps; whole maps go through one numpy kernel for each page.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.functions.geometry import clamp


@dataclass(frozen=True)
class Params:
    bin_thresh: float = 0.3
    box_thresh: float = 0.1
    unclip_ratio: float = 1.5

    def valid(self) -> bool:
        return all(np.isfinite(v) for v in (self.bin_thresh, self.box_thresh, self.unclip_ratio)) and 0 < self.bin_thresh < 1 and 0 <= self.box_thresh <= 1 and self.unclip_ratio >= 0


def sigmoid(value: Column) -> Column:
    return 1 / (1 + F.exp(-value))


def _spread(pixels: DataFrame, side: str, along: str, fold: Column) -> DataFrame:
    """Folds `on` over a pixel and its two neighbours on a line; at the border there is one less."""
    near = Window.partitionBy("page_id", along).orderBy(side).rangeBetween(-1, 1)
    return pixels.withColumn("on", fold.over(near))


def opened(pixels: DataFrame) -> DataFrame:
    """page_id, y, x, on of full maps after a 3 x 3 opening: the square is passed as rows, then columns."""
    erode, dilate = F.every("on"), F.bool_or("on")
    for fold in (erode, dilate):
        pixels = _spread(_spread(pixels, "x", "y", fold), "y", "x", fold)
    return pixels


def unclip(x0: Column, y0: Column, x1: Column, y1: Column, ratio: float) -> tuple[Column, Column, Column, Column]:
    """Edges of a component (x1 and y1 are its last pixels) moved out by area * ratio / perimeter, rounded half away from zero."""
    w, h = x1 - x0 + 1, y1 - y0 + 1
    far = w * h * ratio / F.greatest(2 * (w + h), F.lit(1e-12))
    return F.round(x0 - far), F.round(y0 - far), F.round(x0 + w + far) + 1, F.round(y0 + h + far) + 1


def unpad(x: Column, y: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Coordinates on a square letterbox as shares of the page: the short axis is stretched about its middle."""
    wide = width > height
    sx = F.when(wide | (width == height), x).otherwise((x - 0.5) * height / F.greatest(width, F.lit(1)) + 0.5)
    sy = F.when(wide, (y - 0.5) * width / F.greatest(height, F.lit(1)) + 0.5).otherwise(y)
    return clamp(sx, 0.0, 1.0), clamp(sy, 0.0, 1.0)


def labelled(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Numbers from 1, in raster order of their first pixels, of components joined over eight neighbours, or over four if not
    `diagonal`: runs of rows are united."""
    flat = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, starts = np.nonzero(flat == 1)
    ends = np.nonzero(flat == -1)[1]
    parent = np.arange(len(rows))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    bounds = np.searchsorted(rows, np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        i, j = bounds[y - 1], bounds[y]
        while i < bounds[y] and j < bounds[y + 1]:
            if starts[i] < ends[j] + diagonal and starts[j] < ends[i] + diagonal:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    root = np.array([find(i) for i in range(len(parent))], int)
    number = np.searchsorted(np.unique(root), root) + 1
    out = np.zeros(mask.shape, int)
    for y, a, b, k in zip(rows, starts, ends, number, strict=True):
        out[y, a:b] = k
    return out


def flooded(mask: np.ndarray) -> np.ndarray:
    """The background that can be reached from the border over four neighbours."""
    open_ = ~np.pad(mask, 1)
    seen = np.zeros_like(open_)
    seen[0, :] = seen[-1, :] = seen[:, 0] = seen[:, -1] = True
    while True:
        grown = seen.copy()
        grown[1:] |= seen[:-1]
        grown[:-1] |= seen[1:]
        grown[:, 1:] |= seen[:, :-1]
        grown[:, :-1] |= seen[:, 1:]
        grown &= open_
        if (grown == seen).all():
            return seen[1:-1, 1:-1]
        seen = grown


def _window(mask: np.ndarray, fold: np.ufunc, outside: bool) -> np.ndarray:
    p = np.pad(mask, 1, constant_values=outside)
    rows = fold(fold(p[:-2], p[1:-1]), p[2:])
    return fold(fold(rows[:, :-2], rows[:, 1:-1]), rows[:, 2:])


def open_mask(mask: np.ndarray) -> np.ndarray:
    return _window(_window(mask, np.logical_and, True), np.logical_or, False)


def extents(labels: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of components 1, 2, ...: x0, y0, x1, y1 (last pixels), pixels; and the places of all pixels, component by component."""
    at = np.flatnonzero(labels)
    at = at[np.argsort(labels.ravel()[at], kind="stable")]
    ys, xs = np.divmod(at, labels.shape[1])
    starts = np.flatnonzero(np.diff(labels.ravel()[at], prepend=0))
    fold = lambda how, v: how.reduceat(v, starts) if len(starts) else v
    return fold(np.minimum, xs), fold(np.minimum, ys), fold(np.maximum, xs), fold(np.maximum, ys), np.diff(np.append(starts, len(at))), at


def boxes_of_mask(p: np.ndarray, mask: np.ndarray, params: Params) -> list[tuple[int, int, int, int, int, int, float]]:
    """boxes_of_map, of an opened mask."""
    labels = labelled(mask)
    outside = _window(flooded(mask), np.logical_or, True).ravel()
    left, top, right, low, pixels, at = extents(labels)
    starts = np.cumsum(pixels) - pixels
    found = []
    for k, (x0, y0, x1, y1, n) in enumerate(zip(left.tolist(), top.tolist(), right.tolist(), low.tolist(), pixels.tolist(), strict=True)):
        if x1 - x0 < 2 or y1 - y0 < 2 or not outside[at[starts[k] : starts[k] + n]].any():
            continue
        score = np.float32(p[y0 : y1 + 2, x0 : x1 + 2].mean())
        if score >= np.float32(params.box_thresh):
            found.append((k + 1, x0, y0, x1, y1, n, float(score)))
    return found[::-1]


def boxes_of_map(p: np.ndarray, params: Params = Params()) -> list[tuple[int, int, int, int, int, int, float]]:
    """(component, x0, y0, x1, y1, area, score) of external components of 3 x 3 pixels or more, in reverse raster order.

    x1 and y1 are the last pixels; the score is the mean over a box that is one pixel larger right and below."""
    return boxes_of_mask(p, open_mask(p >= np.float32(params.bin_thresh)), params)


def thin_of_map(p: np.ndarray, mask: np.ndarray, kept: np.ndarray) -> tuple[list[tuple], list[tuple]]:
    """What the recovery of thin glyphs starts from, as (number, x0, y0, x1, y1, pixels, mean): components of the mask of which the
    opening kept nothing, and components of the opened mask that are three pixels wide, four high and no higher than wide."""
    sides = labelled(mask), labelled(kept)
    lost, anchors = [], []
    for labels, out in zip(sides, (lost, anchors), strict=True):
        left, top, right, low, pixels, at = extents(labels)
        if not len(pixels):
            continue
        starts = np.cumsum(pixels) - pixels
        means = np.add.reduceat(p.ravel()[at].astype(float), starts) / pixels
        survives = np.maximum.reduceat(kept.ravel()[at], starts)
        w, h = right - left + 1, low - top + 1
        fits = ~survives if labels is sides[0] else (w >= 3) & (h >= 4) & (w >= h)
        rows = zip(*(v[fits].tolist() for v in (np.arange(1, len(w) + 1), left, top, right, low, pixels, means)), strict=True)
        out += rows
    return lost, anchors


BOXES = "page_id long, place int, component int, x0 int, y0 int, x1 int, y1 int, area long, score double"


def boxes(maps: DataFrame, params: Params = Params()) -> DataFrame:
    """Boxes of maps (page_id, width, p: an array in rows), one kernel call a page; maps stream through in batches."""
    if not params.valid():
        raise ValueError(f"not valid: {params}")

    def run(batches):
        for b in batches:
            out = []
            for page, width, p in zip(b["page_id"], b["width"], b["p"], strict=True):
                out += [(page, i, *box) for i, box in enumerate(boxes_of_map(np.asarray(p, np.float32).reshape(-1, max(int(width), 1)), params))]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BOXES.split(", ")])

    return maps.select("page_id", "width", "p").mapInPandas(run, BOXES)


FOUND = "page_id long, tile int, side int, kind string, place int, x0 int, y0 int, x1 int, y1 int, pixels long, score double"


def found(maps: DataFrame, full: Params = Params(), tile: Params = Params(), thin: bool = True) -> DataFrame:
    """Boxes of the maps of pages and of their tiles (page_id, tile: -1 for the page's own, width, p), and with `thin` the lost
    components ('lost') and the anchors ('anchor') of their recovery, by one pass over the maps: x1 and y1 are last pixels, place
    is the order of boxes, else the component's number; side is the map's width."""
    if not (full.valid() and tile.valid()):
        raise ValueError(f"not valid: {full}, {tile}")

    def run(batches):
        for b in batches:
            out = []
            for page, k, width, values in zip(b["page_id"], b["tile"], b["width"], b["p"], strict=True):
                side, params = int(width), full if k < 0 else tile
                p = np.asarray(values, np.float32).reshape(-1, max(side, 1))
                mask = p >= np.float32(params.bin_thresh)
                kept = open_mask(mask)
                out += [(page, k, side, "box", i, *box[1:]) for i, box in enumerate(boxes_of_mask(p, kept, params))]
                if thin:
                    for kind, those in zip(("lost", "anchor"), thin_of_map(p, mask, kept), strict=True):
                        out += [(page, k, side, kind, *row) for row in those]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])

    return maps.select("page_id", "tile", "width", "p").mapInPandas(run, FOUND)


def packed(pixels: DataFrame) -> DataFrame:
    """Pixel rows as one array a page."""
    rows = pixels.groupBy("page_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "p"))).alias("row"))
    pages = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("y", "row"))).alias("rows"))
    return pages.select("page_id", F.size(F.col("rows")[0]["row"]).alias("width"), F.flatten(F.transform("rows", lambda r: r["row"]["p"])).alias("p"))
