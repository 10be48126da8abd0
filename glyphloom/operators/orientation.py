"""Skew of a page from the rows in which its edges lie, and the canvas that puts it right."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COARSE = [round(-3 + 0.1 * k, 10) for k in range(61)]
FINE = [round(0.02 * k, 10) for k in range(-4, 5)]
BANDS = 4
#: Limits of what counts as evidence.
LEAST_POINTS, LEAST_HEIGHT, UPRIGHT, BOUNDARY, BAND_POINTS, NEAR, BAND_GAIN, GAIN = 500, 16, 0.2, 2.9, 200, 0.2, 1.03, 1.05
SKEWS = "page_id long, estimated double, applied double, agreeing int, evidence int, points long, gain double, reason string"


def edge_points(pixels: DataFrame) -> DataFrame:
    """page_id, x, y where darkness changes between a pixel and the one below it; the border is left out. pixels: page_id, y, x, dark."""
    of = Window.partitionBy("page_id")
    below = F.lead("dark").over(of.partitionBy("page_id", "x").orderBy("y"))
    rows = pixels.withColumn("below", below).withColumn("last_x", F.max("x").over(of)).withColumn("last_y", F.max("y").over(of))
    return rows.where((F.col("dark") != F.col("below")) & (F.col("x") > 0) & (F.col("x") < F.col("last_x")) & (F.col("y") > 0) & (F.col("y") < F.col("last_y"))).select("page_id", "x", "y")


def projection_scores(points: DataFrame, angles: list[float]) -> DataFrame:
    """page_id, angle, score: points go to rows y - tan(angle) x, split over two; the score is the sum of their squares.

    Each point meets a fixed list of angles, and rows are summed before the square: two levels of one aggregate."""
    at = F.explode(F.array(*(F.lit(a) for a in angles))).alias("angle")
    rows = points.select("page_id", at, "x", "y").withColumn("row", F.col("y") - F.tan(F.radians("angle")) * F.col("x"))
    low, part = F.floor("row"), F.col("row") - F.floor("row")
    split = F.explode(F.array(F.struct(low.alias("bin"), (1 - part).alias("w")), F.struct((low + 1).alias("bin"), part.alias("w")))).alias("s")
    return rows.select("page_id", "angle", split).groupBy("page_id", "angle", "s.bin").agg(F.sum("s.w").alias("w")).groupBy("page_id", "angle").agg(F.sum(F.col("w") * F.col("w")).alias("score"))


def _band_scores(x: np.ndarray, y: np.ndarray, band: np.ndarray, angles: list[float], height: int) -> np.ndarray:
    """Angles by bands: the sum of squares over rows that the points of a band project to, each split over two rows."""
    size, out = height + 128, []
    for a in angles:
        row = y - np.tan(np.radians(a)) * x + 64
        low = np.maximum(np.floor(row).astype(int), 0)
        within = low + 1 < size
        at, part = low[within] * BANDS + band[within], (row - low)[within]
        bins = np.bincount(at, 1 - part, size * BANDS) + np.bincount(at + BANDS, part, size * BANDS)
        out.append((bins.reshape(size, BANDS) ** 2).sum(axis=0))
    return np.array(out)


def _last_best(scores: np.ndarray) -> int:
    return len(scores) - 1 - int(scores[::-1].argmax())


def estimate(dark: np.ndarray) -> tuple[float, float, int, int, int, float, str]:
    """estimated, applied, agreeing, evidence, points, gain and reason of a page's mask.

    A band agrees if its own best angle, of all that were tried, is NEAR the page's, and its score at the page's angle is
    BAND_GAIN times that at none. A small or empty mask has insufficient evidence."""
    h, w = dark.shape
    ys, xs = np.nonzero(dark[1:-1, 1:-1] != dark[2:, 1:-1]) if h > 2 and w > 2 else (np.zeros(0, int), np.zeros(0, int))
    x, y = xs + 1 - w / 2, ys + 1.0
    if len(x) < LEAST_POINTS or h < LEAST_HEIGHT:
        return 0.0, 0.0, 0, 0, len(x), 1.0, "insufficient_evidence"
    band = np.minimum((ys + 1) * BANDS // h, BANDS - 1)
    angles, scores = COARSE, _band_scores(x, y, band, COARSE, h)
    middle = angles[_last_best(scores.sum(axis=1))]
    fine = [middle + f for f in FINE]
    angles, scores = [*angles, *fine], np.concatenate([scores, _band_scores(x, y, band, fine, h)])
    place = _last_best(scores.sum(axis=1))
    best, at_best, at_zero = angles[place], scores[place], _band_scores(x, y, band, [0.0], h)[0]
    gain = at_best.sum() / max(at_zero.sum(), 1.0)
    full = np.bincount(band, minlength=BANDS) >= BAND_POINTS
    own = np.array([angles[_last_best(scores[:, k])] for k in range(BANDS)])
    evidence, agreeing = int(full.sum()), int((full & (np.abs(own - best) <= NEAR) & (at_best >= BAND_GAIN * at_zero)).sum())
    reason = "near_upright" if abs(best) < UPRIGHT else "search_boundary" if abs(best) >= BOUNDARY else "applied" if agreeing >= 2 and 2 * agreeing > evidence and gain >= GAIN else "weak_consensus"
    return best, best if reason == "applied" else 0.0, agreeing, evidence, len(x), float(gain), reason


def skews(masks: DataFrame) -> DataFrame:
    """Skew of each page of masks (page_id, width, dark: booleans in rows)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *estimate(np.asarray(m, bool).reshape(-1, int(w)))) for p, w, m in zip(b["page_id"], b["width"], b["dark"], strict=True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SKEWS.split(", ")])

    return masks.select("page_id", "width", "dark").mapInPandas(run, SKEWS)


def canvas(width: Column, height: Column, degrees: Column) -> tuple[Column, Column, Column]:
    """Size of the canvas that holds a page turned by an angle, and the matrix from it back to the page, about both middles."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    w = F.ceil(width * F.abs(c) + height * F.abs(s)).cast("int")
    h = F.ceil(width * F.abs(s) + height * F.abs(c)).cast("int")
    matrix = F.array(F.array(c, -s, width / 2 - c * w / 2 + s * h / 2), F.array(s, c, height / 2 - s * w / 2 - c * h / 2))
    return w, h, matrix
