"""Resized, padded and normalised regions against the numpy kernel."""

from __future__ import annotations

import numpy as np
import pytest

from glyphloom.functions import raster
from glyphloom.operators import preparing

PIXELS = "page_id long, y int, x int, r int, g int, b int"
REGIONS = "page_id long, tile int, x0 int, y0 int, x1 int, y1 int"
MEAN, STD = [0.5, 0.4, 0.3], [0.2, 0.25, 0.3]


@pytest.mark.parametrize("symmetric", [True, False])
def test_prepared_regions(spark, symmetric):
    rng = np.random.default_rng(1)
    pages = {1: rng.integers(0, 256, (30, 41, 3)), 2: rng.integers(0, 256, (9, 5, 3)), 3: np.full((1, 1, 3), 255)}
    pixels = [(i, y, x, *map(int, p[y, x])) for i, p in pages.items() for y in range(p.shape[0]) for x in range(p.shape[1])]
    regions = [(1, -1, 0, 0, 41, 30), (1, 0, 3, 5, 20, 9), (1, 1, 10, 0, 12, 30), (2, -1, 0, 0, 5, 9), (3, -1, 0, 0, 1, 1), (2, 4, 2, 2, 2, 8), (9, -1, 0, 0, 5, 5)]
    rows = preparing.packed_rows(spark.createDataFrame(pixels, PIXELS).repartition(5))
    got = {}
    for r in preparing.prepared(rows, spark.createDataFrame(regions, REGIONS), 12, 16, MEAN, STD, symmetric).collect():
        got.setdefault((r.page_id, r.tile), np.full((3, 12, 16), np.nan))[r.channel, r.y, r.x] = r.value
    assert set(got) == {(1, -1), (1, 0), (1, 1), (2, -1), (3, -1)}
    for page, tile, x0, y0, x1, y1 in regions:
        if (page, tile) in got:
            want = raster.prepared(pages[page][y0:y1, x0:x1].astype(np.uint8), 12, 16, symmetric, np.array(MEAN), np.array(STD))
            # Halves may fall either way in single precision: a step of one in 255 at a few pixels.
            away = np.abs(got[page, tile] - want)
            assert (away > 1e-4).mean() < 0.01 and away.max() < 1.01 / 255 / min(STD)


def test_weights_sum_to_one(spark):
    from pyspark.sql import functions as F

    for n, out in ((7, 3), (3, 7), (5, 5), (100, 1), (1, 4)):
        (r,) = spark.range(1).select(preparing.weights(F.lit(n), F.lit(out)).alias("w")).collect()
        assert len(r.w) == out
        for row, o in zip(raster.weights(n, out), r.w, strict=True):
            dense = np.zeros(n)
            dense[o["at"] : o["at"] + len(o["w"])] = o["w"]
            assert np.allclose(dense, row, atol=1e-6) and abs(sum(o["w"]) - 1) < 1e-12
    empty = preparing.packed_rows(spark.createDataFrame([], PIXELS))
    assert preparing.prepared(empty, spark.createDataFrame([(1, 0, 0, 0, 3, 3)], REGIONS), 4, 4, MEAN, STD).count() == 0
