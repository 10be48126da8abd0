"""Turned pages, groups of slanted letters, crops and owners against plain loops and known places."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphloom.functions import geometry as g
from glyphloom.functions import raster
from glyphloom.operators import preparing, slanted


def test_matrices(spark):
    rng = np.random.default_rng(2)
    for m in [*rng.normal(size=(5, 3, 3)), np.array([[1.0, 2, 3], [2, 4, 6], [0, 0, 1]])]:
        a = g.matrix3(*m.tolist())
        (r,) = spark.range(1).select(g.inverse3(a).alias("i"), g.product3(a, a).alias("p"), F.array(*g.projected(a, F.lit(2.0), F.lit(3.0))).alias("q")).collect()
        assert np.allclose(r.p, m @ m)
        u = m @ [2, 3, 1]
        assert np.allclose(r.q, u[:2] / u[2])
        assert r.i is None if abs(np.linalg.det(m)) < 1e-12 else np.allclose(r.i, np.linalg.inv(m))


def test_a_turned_page_leads_back(spark):
    """A landmark of the page, followed through all steps one by one, comes back."""
    rows = [(w, h, float(a), x, y) for w, h in ((120, 180), (160, 240), (100, 100), (200, 90)) for a in (0, 90, 180, -90, -1, 2, 45) for x, y in ((0, 0), (3, 5))]
    page = spark.createDataFrame(rows, "w int, h int, a double, cx int, cy int")
    matrix, tw, th = g.turned_page(F.col("w"), F.col("h"), F.col("a"))
    straight = g.straightened(F.col("w"), F.col("h"), F.col("a"), F.col("cx"), F.col("cy"))
    for r in page.select("*", matrix.alias("m"), tw.alias("tw"), th.alias("th"), straight.alias("s"), g.inverse3(straight).alias("back")).collect():
        c, s = math.cos(math.radians(r.a)), math.sin(math.radians(r.a))
        x, y = 32.0, 42.0
        u, v = np.array(r.m)[:2] @ [x, y, 1]
        assert (u, v) == pytest.approx((c * (x - r.w / 2) + s * (y - r.h / 2) + r.tw / 2, -s * (x - r.w / 2) + c * (y - r.h / 2) + r.th / 2))
        w, h = r.w, r.h
        if w != h:
            more_w, more_h = max(math.ceil(abs(c) * r.w + abs(s) * r.h - r.w), 0), max(math.ceil(abs(s) * r.w + abs(c) * r.h - r.h), 0)
            x, y, w, h = x + more_w // 2, y + more_h // 2, w + more_w, h + more_h
        x, y = c * (x - w / 2) + s * (y - h / 2) + w / 2, -s * (x - w / 2) + c * (y - h / 2) + h / 2
        if r.w != r.h and h / w > r.h / r.w:
            x += int(h * r.w / r.h - w) // 2
        elif r.w != r.h and h / w < r.h / r.w:
            y += int(w * r.h / r.w - h) // 2
        assert np.allclose(np.array(r.s) @ [32, 42, 1], [x - r.cx, y - r.cy, 1])
        assert np.allclose(np.array(r.back) @ [x - r.cx, y - r.cy, 1], [32, 42, 1])


@pytest.mark.parametrize("quarter", [0, 90, 180, 270])
def test_quarter_turns_and_small_angles(spark, quarter):
    image = np.random.default_rng(quarter).integers(0, 256, (7, 11, 3)).astype(np.uint8)
    pixels = spark.createDataFrame([(1, y, x, *map(int, image[y, x])) for y in range(7) for x in range(11)], "page_id long, y int, x int, r int, g int, b int")
    dims = spark.createDataFrame([(1, 11, 7, quarter, quarter / 60)], "page_id long, width int, height int, quarter int, angle double")
    turned = raster.quarter_turned(image, quarter)
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in preparing.quarter_turned(pixels, dims).collect()}
    assert got == {(y, x): tuple(map(int, turned[y, x])) for y in range(turned.shape[0]) for x in range(turned.shape[1])}
    want = raster.rectified(image, quarter / 60)[:, :, 0]
    flat = preparing.rectified(pixels, dims).collect()
    assert len(flat) == want.size and max(abs(int(want[r.y, r.x]) - r.r) for r in flat) <= 1 and np.mean([want[r.y, r.x] != r.r for r in flat]) < 0.05


def least_by_trying(points):
    best = None
    for k in range(1800):
        a = math.radians(k / 10)
        u, v = points @ [math.cos(a), math.sin(a)], points @ [-math.sin(a), math.cos(a)]
        size = (np.ptp(u) * np.ptp(v), max(np.ptp(u), np.ptp(v)))
        best = min(best or size, size)
    return best


def test_hulls_and_least_rectangles():
    rng = np.random.default_rng(4)
    for k in range(25):
        a = rng.uniform(0, math.pi)
        points = np.round(rng.uniform(-1, 1, (60, 2)) * [rng.uniform(5, 60), rng.uniform(1, 9)] @ np.array([[math.cos(a), math.sin(a)], [-math.sin(a), math.cos(a)]]))
        corners = slanted.hull(points[:, 0], points[:, 1])
        edges = np.roll(corners, -1, axis=0) - corners
        for c, e in zip(corners, edges, strict=True):  # all points on one side of each edge
            assert (e[0] * (points[:, 1] - c[1]) - e[1] * (points[:, 0] - c[0]) >= -1e-9).all()
        long, short, angle = slanted.least_rectangle(points[:, 0], points[:, 1])
        area, _ = least_by_trying(points)
        assert long * short <= area + 1e-6 and -90 <= angle < 90
        u = points @ [math.cos(math.radians(angle)), math.sin(math.radians(angle))]
        assert np.ptp(u) == pytest.approx(long, abs=1e-6)
    assert slanted.least_rectangle(np.array([3]), np.array([4])) == (0.0, 0.0, 0.0)
    assert slanted.least_rectangle(np.arange(5), np.arange(5))[:2] == pytest.approx((math.hypot(4, 4), 0.0))


def page_of(runs, side=200):
    """A page of letters: (x, y, dx, dy, n) each."""
    p = np.full((side, side), 255.0)
    for x, y, dx, dy, n in runs:
        for i in range(n):
            p[y + i * dy : y + i * dy + 6, x + i * dx : x + i * dx + 5] = 0
    return p


def test_groups(spark):
    runs = [(20, 20, 7, 7, 7), (150, 20, 0, 9, 6), (20, 180, 7, -7, 6), (100, 150, 9, 0, 8), (60, 20, 9, 0, 1)]
    pages = {1: page_of(runs), 2: page_of([]), 3: page_of(runs[:1]), 4: page_of([(20, 20, 7, 7, 7), (80, 80, 7, 7, 6)])}
    covering = [(1, [140.0, 10.0, 170.0, 10.0, 170.0, 90.0, 140.0, 90.0]), (1, None), (3, [0.0, 0.0, 199.0, 0.0, 199.0, 199.0, 0.0, 199.0]), (9, None)]
    rows = spark.createDataFrame([(i, 200, p.ravel().tolist()) for i, p in pages.items()], "page_id long, width int, p array<double>")
    got = slanted.groups(rows, spark.createDataFrame(covering, "page_id long, quad array<double>")).collect()
    by = {i: sorted((r.angle, r.components) for r in got if r.page_id == i) for i in pages}
    assert by == {1: [(-45, 6), (45, 7)], 2: [], 3: [], 4: [(45, 13)]}  # level runs, one letter and covered ones are no groups
    (found,) = [r for r in got if r.page_id == 1 and r.angle == 45]
    middle = np.array(found.quad).reshape(4, 2).mean(axis=0)
    assert np.hypot(*(middle - [43.5, 44])) < 6
    sides = np.hypot(*np.diff(np.array(found.quad).reshape(4, 2), axis=0).T)
    assert max(sides) > math.hypot(42, 42) + 24
    assert slanted.groups(rows.limit(0), spark.createDataFrame([], "page_id long, quad array<double>")).count() == 0


def test_homographies_and_crops(spark):
    rng = np.random.default_rng(3)
    source = np.array([[0, 0], [10, 1], [12, 9], [-1, 8]]) + rng.normal(size=(6, 4, 2)) * 0.4
    target = np.array([[0, 0], [20, 0], [20, 15], [0, 15.0]]) + rng.normal(size=(6, 4, 2))
    for m, s, t in zip(slanted.homographies(source, target), source, target, strict=True):
        u = np.c_[s, np.ones(4)] @ m.T
        assert np.allclose(u[:, :2] / u[:, 2:], t)
    assert np.isnan(slanted.homographies(np.zeros((1, 4, 2)), target[:1])).all()
    image = np.arange(30.0 * 40).reshape(30, 40)
    assert np.allclose(slanted.warped(image, np.array([[1.0, 0, -4], [0, 1, -2], [0, 0, 1]]), 10, 8), image[2:10, 4:14])
    assert (slanted.warped(image, np.array([[1.0, 0, -100], [0, 1, 0], [0, 0, 1]]), 5, 5) == 255).all()
    pages = spark.createDataFrame([(1, 40, image.ravel().tolist())], "page_id long, width int, p array<double>")
    level = [4.0, 2.0, 14.0, 2.0, 14.0, 10.0, 4.0, 10.0]
    words = spark.createDataFrame([(1, 0, level, 0.0), (1, 1, level, 90.0), (1, 2, [5.0] * 8, 0.0), (2, 3, level, 0.0)], "page_id long, idx long, quad array<double>, angle double")
    got = {r.idx: r for r in slanted.crops(pages, words).collect()}
    assert set(got) == {0, 1} and (got[0].width, got[0].height, got[1].width, got[1].height) == (10, 8, 8, 10)
    for i, r in got.items():
        p, want = np.array(r.p).reshape(r.height, r.width), np.zeros((r.height, r.width))
        for y in range(r.height):
            for x in range(r.width):
                u, v = x / (r.width - 1), y / (r.height - 1)
                sx, sy = (4 + 10 * u, 2 + 8 * v) if i == 0 else (14 - 10 * v, 2 + 8 * u)
                want[y, x] = sy * 40 + sx  # the image is a plane
        assert np.allclose(p, want)


def test_owners_against_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(160):
        x, y, w, h, a = rng.uniform(0, 900), rng.uniform(0, 300), rng.choice((12, 30, 70, 90)), rng.choice((10, 14, 18)), math.radians(rng.choice((-8, 0, 0, 3, 40)))
        rows.append((i % 2, i, [v for k, j in ((-1, -1), (1, -1), (1, 1), (-1, 1)) for v in (x + k * w / 2 * math.cos(a) - j * h / 2 * math.sin(a), y + k * w / 2 * math.sin(a) + j * h / 2 * math.cos(a))]))
    measured = slanted.measures(spark.createDataFrame(rows, "page_id long, idx long, quad array<double>"))
    words = measured.collect()
    want = {}
    for page in (0, 1):
        own = [r for r in words if r.page_id == page]
        typical = float(np.median([r.short for r in own if r.long > 2 * r.short and abs(r.angle) < 15]))
        anchors = [r for r in own if r.long >= 3 * typical and r.long >= 2.2 * r.short and r.short >= 0.5 * typical]
        for r in own:
            costs = []
            for a in anchors:
                c, s = math.cos(math.radians(a.angle)), math.sin(math.radians(a.angle))
                along, off = abs((r.cx - a.cx) * c + (r.cy - a.cy) * s), abs((r.cy - a.cy) * c - (r.cx - a.cx) * s)
                if off <= 0.9 * a.short and along <= a.long / 2 + 6 * typical:
                    costs.append((round(off + 0.15 * max(along - a.long / 2, 0), 9), a.idx))
            if costs:
                want[r.idx] = min(costs)[1]
    assert {r.idx: r.owner for r in slanted.owners(measured).collect()} == want and len(want) > 40
    assert slanted.owners(measured.limit(0)).count() == 0
