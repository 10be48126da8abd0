"""Boxes of banded maps against those of whole maps and plain loops; components against a plain search."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_composed import detected

from glyphloom.operators import bands, detection, graphs

BANDS = "page_id long, band int, top int, width int, p array<double>"


def cut(maps, rows):
    return [(page, i, top, p.shape[1], p[top : top + rows].ravel().tolist()) for page, p in maps.items() for i, top in enumerate(range(0, len(p), rows))]


def drawing(seed, h, w):
    """Boxes, rings within rings, bars that reach over all bands, and spirals."""
    rng = np.random.default_rng(seed)
    p = np.zeros((h, w))
    for _ in range(h * w // 220):
        y, x, a, b = rng.integers(0, h), rng.integers(0, w), rng.integers(1, 9), rng.integers(1, 9)
        p[y : y + a, x : x + b] = rng.choice([0.25, 0.5, 0.9])
    for k, y in enumerate(range(2, h - 12, 17)):
        x = (7 * k) % max(w - 14, 1)
        p[y : y + 13, x : x + 13] = 0.8
        p[y + 3 : y + 10, x + 3 : x + 10] = 0
        p[y + 5 : y + 8, x + 5 : x + 8] = 0.9  # an inner one, which the border can't be reached from
        if k % 2:
            p[y + 5 : y + 8, x : x + 4] = 0  # but now it can
    p[:, w // 2 : w // 2 + 3] = np.maximum(p[:, w // 2 : w // 2 + 3], 0.6)
    return np.round(p, 3)


@pytest.mark.parametrize("rows", [2, 5, 16, 100])
def test_boxes_of_bands_are_those_of_whole_maps(spark, rows):
    maps = {i: drawing(i, *size) for i, size in enumerate([(50, 40), (33, 64), (5, 9), (41, 30)])}
    maps[7] = np.zeros((20, 20))
    maps[8] = np.ones((11, 12))
    got = bands.boxes(spark.createDataFrame(cut(maps, rows), BANDS)).collect()
    want = []
    for page, p in maps.items():
        found = detection.boxes_of_map(p.astype(np.float32))
        want += [(page, i, *b[1:6], round(b[6], 5), p.shape[1], p.shape[0]) for i, b in enumerate(found)]
    assert sorted((*r[:7], round(r.score, 5), *r[8:]) for r in got) == sorted(want)
    assert len(want) > 12


def test_words_of_bands_against_loops(spark):
    maps = {i: drawing(10 + i, 48, 48) for i in range(2)}
    dims = spark.createDataFrame([(i, 48, 48) for i in maps], "page_id long, width int, height int")
    got = bands.words(spark.createDataFrame(cut(maps, 10), BANDS), dims, 1.0).collect()
    want = [(page, i, *(round(v / 48, 6) for v in box), round(score, 5)) for page, p in maps.items() for i, (box, score) in enumerate(detected(p.astype(np.float32), (0, 0, 48, 48))[0])]
    assert sorted((r.page_id, r.idx, *(round(r[c], 6) for c in ("x0", "y0", "x1", "y1")), round(r.objectness, 5)) for r in got) == sorted(want)
    assert bands.words(spark.createDataFrame([], BANDS), dims, 1.0).count() == 0
    with pytest.raises(ValueError):
        bands.boxes(spark.createDataFrame([], BANDS), detection.Params(bin_thresh=2.0))


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(45)] + [(5, 5), (None, 3), (300, 200), (200, 300), (200, 300)]
    root = {v: v for e in edges for v in e if v is not None}
    for _ in root:
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    got = graphs.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == {v: r for v, r in root.items() if r != v} and got.count() == len({v for v, r in root.items() if r != v})
    named = spark.createDataFrame(edges, "a long, b long").select(F.struct(F.lit("x").alias("k"), "a").alias("a"), F.struct(F.lit("x").alias("k"), F.col("b").alias("a")).alias("b"))
    assert graphs.components(named.where("a.a is not null")).where("root.a = 0").count() == 40
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0
