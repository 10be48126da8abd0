"""Maps of tiles fused to one map of a page, sampled at the middles of its pixels, and boxes of the fused map."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pixels of a tile's map within which its weight falls to its edge, and the least weight.
TAPER, LEAST_WEIGHT = 128.0, 0.001
BAND = 64
FUSED = "page_id long, band int, top int, width int, even array<double>, tapered array<double>, covered boolean"


def sampled(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear values of a square map at places x and y, the outer ones held to its border: rows by y, columns by x."""
    last = len(p) - 1
    x, y = np.clip(x, 0, last), np.clip(y, 0, last)
    a, b = np.floor(x).astype(int), np.floor(y).astype(int)
    c, d = np.minimum(a + 1, last), np.minimum(b + 1, last)
    fx, fy = x - a, (y - b)[:, None]
    upper, lower = p[np.ix_(b, a)] * (1 - fx) + p[np.ix_(b, c)] * fx, p[np.ix_(d, a)] * (1 - fx) + p[np.ix_(d, c)] * fx
    return upper * (1 - fy) + lower * fy


def fused(tiles: DataFrame, map_side: int, tile_side: int, band_rows: int = BAND) -> DataFrame:
    """page_id, band, top, width, even and tapered (values in rows) and covered, a row for each band of `band_rows` rows of a page's map.

    tiles have page_id, x, y (in page pixels; a tile is tile_side wide, also where it passes the page), the page's width and height, and p, its map of
    map_side pixels squared. Each pixel takes the tiles that its middle lies in, evenly, and weighted by how far it is from an edge
    that lies inside the page. A band that some tile leaves a hole in is not covered; `checked` makes that an error. A page
    is dealt over its bands, so that no task holds more than the tiles that meet one."""
    scale = map_side / tile_side
    end_x, end_y = F.col("x") + tile_side, F.col("y") + tile_side
    first = F.floor(F.greatest(F.col("y") * scale, F.lit(0)) / band_rows).cast("int")
    last = F.floor((F.least(F.ceil(end_y * scale), F.ceil(F.col("height") * scale)) - 1) / band_rows).cast("int")
    rows = tiles.withColumns({"x1": end_x, "y1": end_y}).where((F.col("x") < F.col("width")) & (F.col("y") < F.col("height"))).withColumn("band", F.explode(F.sequence(first, F.greatest(first, last))))

    def run(key: tuple, those: pd.DataFrame) -> pd.DataFrame:
        page, band = key
        w, h = int(np.ceil(those["width"].iloc[0] * scale)), int(np.ceil(those["height"].iloc[0] * scale))
        top, end = band * band_rows, min((band + 1) * band_rows, h)
        sums, weights = np.zeros((2, end - top, w)), np.zeros((2, end - top, w))
        middle_x, middle_y = (np.arange(w) + 0.5) / scale, (np.arange(top, end) + 0.5) / scale
        for t in those.sort_values(["y", "x"]).itertuples():
            at_x, at_y = np.flatnonzero((middle_x >= t.x) & (middle_x < t.x1)), np.flatnonzero((middle_y >= t.y) & (middle_y < t.y1))
            if not len(at_x) or not len(at_y):
                continue
            tx, ty = (middle_x[at_x] - t.x) * scale, (middle_y[at_y] - t.y) * scale
            seen = sampled(np.asarray(t.p, float).reshape(map_side, map_side), tx - 0.5, ty - 0.5)
            far = np.full((len(ty), len(tx)), TAPER)
            for inside, value in ((t.x > 0, tx[None, :]), (t.y > 0, ty[:, None]), (t.x1 < t.width, map_side - tx[None, :]), (t.y1 < t.height, map_side - ty[:, None])):
                if inside:
                    far = np.minimum(far, value)
            for mode, weight in enumerate((np.ones_like(far), np.clip(far / TAPER, LEAST_WEIGHT, 1.0))):
                sums[mode][np.ix_(at_y, at_x)] += seen * weight
                weights[mode][np.ix_(at_y, at_x)] += weight
        covered = bool((weights > 0).all())
        even, tapered = (sums[k] / np.where(weights[k] > 0, weights[k], 1) for k in (0, 1))
        return pd.DataFrame([(page, band, top, w, even.ravel().tolist(), tapered.ravel().tolist(), covered)], columns=[c.split()[0] for c in FUSED.split(", ")])

    return rows.select("page_id", "band", "x", "y", "x1", "y1", "width", "height", "p").groupBy("page_id", "band").applyInPandas(run, FUSED)


def checked(bands: DataFrame) -> DataFrame:
    """bands, with an error where a pixel is not covered."""
    return bands.where(F.when(~F.col("covered"), F.raise_error(F.lit("Uncovered heatmap pixel"))).otherwise(True))


def boxes_on_page(words: DataFrame, scale: float) -> DataFrame:
    """Boxes of a fused map, in shares of it, in shares of their page: the map is a little larger where the page's size is no whole
    number of its pixels. words have map_width and map_height, and the page's width and height; boxes that become empty go."""
    on = lambda c, of, page: F.least(F.greatest(F.col(c) * F.col(of) / (scale * F.col(page)), F.lit(0.0)), F.lit(1.0))
    moved = {c: on(c, "map_width", "width") for c in ("x0", "x1")} | {c: on(c, "map_height", "height") for c in ("y0", "y1")}
    return words.withColumns(moved).where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
