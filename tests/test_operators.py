"""Operators on hand-made fixtures and against brute force."""

from __future__ import annotations

import random
import tempfile
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphloom.functions import config, geometry
from glyphloom.functions import quads as quadrilaterals
from glyphloom.operators import detection, fusion, lines, matching, orientation, pipeline, recognition, recovery, runs, series, tiles
from glyphloom.plans import measures, vision
from glyphloom.streaming import pages as streams

BOX = "page_id long, idx long, text string, x0 double, y0 double, x1 double, y1 double"


def boxes(spark, rows):
    return spark.createDataFrame([(1, i, t, *map(float, b)) for i, (t, *b) in enumerate(rows)], BOX)


def random_boxes(rng, n):
    return [(rng.choice("abc"), x, y, x + rng.randint(0, 400), y + rng.randint(0, 60)) for x, y in ((rng.randint(-200, 900), rng.randint(-50, 300)) for _ in range(n))]


def brute_iou(a, b):
    common = max(min(a[3], b[3]) - max(a[1], b[1]), 0) * max(min(a[4], b[4]) - max(a[2], b[2]), 0)
    size = lambda r: max(r[3] - r[1], 0) * max(r[4] - r[2], 0)
    return common, common / max(size(a) + size(b) - common, 1e-12)


@pytest.mark.parametrize("cell", [(50, 50), (256, 32), (5000, 7)])
def test_overlaps_are_found_once(spark, cell):
    rng = random.Random(cell[0])
    left, right = random_boxes(rng, 40), random_boxes(rng, 40)
    got = matching.with_iou(matching.overlapping(boxes(spark, left), boxes(spark, right), cell)).collect()
    want = {(i, j): brute_iou(a, b)[1] for i, a in enumerate(left) for j, b in enumerate(right) if brute_iou(a, b)[0] > 0}
    assert len(got) == len(want) and all(abs(want[r.l_idx, r.r_idx] - r.iou) < 1e-9 for r in got)


def test_duplicates_count_once_and_touching_boxes_never(spark):
    truth = boxes(spark, [("a", 0, 0, 10, 10), ("b", 10, 0, 20, 10), ("c", 0, 0, 0, 0)])
    seen = boxes(spark, [("a", 0, 0, 10, 10), ("a", 0, 0, 10, 10), ("z", 20, 0, 30, 10)])
    pairs = matching.with_iou(matching.overlapping(truth, seen))
    assert [(r.l_idx, r.r_idx) for r in matching.mutual_best(pairs).collect()] == [(0, 0)]
    pages = spark.createDataFrame([(1,), (2,)], "page_id long")
    counts = {r.page_id: (r.truth, r.predicted, r.matched, r.exact) for r in matching.page_counts(pages, truth, seen, matching.mutual_best(pairs)).collect()}
    assert counts == {1: (3, 3, 1, 1), 2: (0, 0, 0, 0)}


@pytest.mark.parametrize("seed", range(4))
def test_matchings_against_all_choices(spark, seed):
    rng = random.Random(seed)
    rows = [(1, i, j, rng.randint(1, 99) / 100) for i in range(5) for j in range(4) if rng.random() < 0.7]
    pairs = spark.createDataFrame(rows, "page_id long, l_idx long, r_idx long, iou double")
    value = {(i, j): v for _, i, j, v in rows}
    choices = [[(p[j], j) for j in range(4)] for p in permutations(range(5), 4)]
    most = max(sum(value.get(c, 0) >= 0.3 for c in ch) for ch in choices)
    best = max(sum(value.get(c, 0) for c in ch) for ch in choices)
    got = matching.maximum_matching(pairs, 0.3).collect()
    assert len(got) == most == len({r.l_idx for r in got}) == len({r.r_idx for r in got}) and all(r.iou >= 0.3 for r in got)
    assert sum(r.iou for r in matching.optimal_assignment(pairs, 0.0).collect()) == pytest.approx(best)


def test_rectangle_becomes_one_box():
    p = np.zeros((20, 20), np.float32)
    p[7:10, 6:13] = 0.9
    ((_, x0, y0, x1, y1, n, score),) = detection.boxes_of_map(p)
    assert (x0, y0, x1, y1, n) == (6, 7, 12, 9, 21) and score == pytest.approx(0.9 * 21 / 32, abs=1e-6)
    assert detection.boxes_of_map(np.zeros((8, 8), np.float32)) == []
    p[:] = 0
    p[4, 4] = 1
    assert detection.boxes_of_map(p) == []


def test_weak_bridge_and_inner_components():
    p = np.zeros((20, 40), np.float32)
    p[5:12, 3:12] = p[5:12, 20:30] = 0.9
    p[5:12, 12:20] = 0.4
    assert [len(detection.boxes_of_map(p, detection.Params(bin_thresh=t))) for t in (0.3, 0.5)] == [1, 2]
    assert detection.boxes_of_map(p, detection.Params(box_thresh=0.99)) == []
    ring = np.ones((24, 24), np.float32)
    ring[4:20, 4:20] = 0
    ring[9:14, 9:14] = 1
    assert len(detection.boxes_of_map(ring)) == 1


def test_components_against_flood():
    rng = np.random.default_rng(2)
    for _ in range(20):
        mask = rng.random((12, 15)) < 0.45
        labels, seen = detection.labelled(mask), np.zeros(mask.shape, int)
        number = 0
        for y, x in zip(*np.nonzero(mask), strict=True):
            if seen[y, x]:
                continue
            number += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < 12 and 0 <= b < 15 and mask[a, b] and not seen[a, b]:
                    seen[a, b] = number
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        assert (labels == seen).all()


def test_opening_by_windows_equals_the_kernel(spark):
    mask = np.random.default_rng(3).random((16, 16)) < 0.8
    rows = spark.createDataFrame([(1, int(y), int(x), bool(mask[y, x])) for y in range(16) for x in range(16)], "page_id long, y int, x int, on boolean")
    got = np.zeros((16, 16), bool)
    for r in detection.opened(rows).collect():
        got[r.y, r.x] = r.on
    assert (got == detection.open_mask(mask)).all()


def test_wide_crops(spark):
    sizes = spark.createDataFrame([(105, 10), (80, 10), (81, 10), (0, 5)], "w int, h int")
    starts = recognition.split_starts(F.col("w"), F.col("h"))
    got = [(list(r.s), r.o) for r in sizes.select(starts.alias("s"), recognition.last_overlap(starts, F.col("w"), F.col("h")).alias("o")).collect()]
    assert got == [([0, 30, 45], 0.75), ([0], 0.0), ([0, 21], pytest.approx(39 / 60)), ([0], 0.0)]


def test_merging_readings():
    assert recognition.merge("abcd", "efgh", 0.0) == "abcdefgh"
    assert recognition.merge("abcdx", "ycdef", 0.8) == "abcdef"
    assert recognition.merge("a", "", 0.5) == "a" and recognition.merged_parts([], 0.5) == ""
    line = "the quick brown fox jumps over the lazy dog"
    parts = [line[i : i + 16] for i in range(0, len(line) - 8, 8)]
    assert recognition.merged_parts(parts, 1 - (len(parts[-1]) - 8) / len(parts[-1])) == line


def test_decoding_ties_and_ends(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 1.0, 0.0]), (1, 1, [0.0, 0.0, 9.0]), (1, 2, [5.0, 0.0, 0.0]), (2, 0, [0.0, 0.0, 3.0])], "sample long, step int, values array<double>")
    got = {r.sample: (list(r.classes), r.confidence) for r in recognition.decoded(rows, 2).collect()}
    assert got[1][0] == [1] and got[1][1] == pytest.approx(1 / (2 + np.exp(-1))) and got[2] == ([], 0.0)


def test_rotation_gate(spark):
    kind = "o double, c array<struct<rotation:int,text:string,confidence:double>>"
    rows = [(0.2, [(90, "ab", 0.95), (270, "cd", 0.5)]), (0.2, [(90, "ab", 0.95), (270, "cd", 0.9)]), (0.9, [(90, "ab", 0.95)]), (0.2, [(0, "I", 0.95)]), (0.2, [(90, "I", 0.95)]), (0.2, []), (0.2, [(90, "ab", 1.0), (270, "cd", 0.9)]), (0.2, [(90, "ab", 1.0), (270, "cd", 0.89)])]
    got = [r.r for r in spark.createDataFrame(rows, kind).select(recognition.chosen_rotation(F.col("o"), F.col("c"))["rotation"].alias("r")).collect()]
    assert got == [90, None, None, 0, None, None, None, 90]


def test_geometry(spark):
    side = F.lit(10), F.lit(20)
    for quarter, want in ((0, (3, 4)), (90, (4, 17)), (180, (7, 16)), (270, (6, 3))):
        m = geometry.quarter_inverse(F.lit(quarter), *side)
        x, y = geometry.transform(m, F.lit(3), F.lit(4))
        assert tuple(spark.range(1).select(x.alias("x"), y.alias("y")).first()) == want
    assert [r[0] for r in spark.createDataFrame([(190.0,), (-180.0,), (180.0,), (0.0,)], "a double").select(geometry.wrapped(F.col("a"))).collect()] == [-170.0, -180.0, -180.0, 0.0]


def test_skew_is_found():
    assert orientation.estimate(np.zeros((10, 10), bool))[-1] == "insufficient_evidence"
    y, x = np.mgrid[0:400, 0:600]
    lines = lambda a: ((y - np.tan(np.radians(a)) * (x - 300)) % 40) < 14
    for angle in (1.5, -2.0):
        found = orientation.estimate(lines(angle))
        assert abs(found[0] - angle) < 0.06 and found[-1] == "applied" and found[1] == found[0]
    assert orientation.estimate(lines(0.0))[-1] == "near_upright"


def plain_skew(dark):
    """The rule of the skew estimate, point by point."""
    h, w = dark.shape
    points = [(x - w / 2, float(y), min(y * 4 // h, 3)) for y in range(1, h - 1) for x in range(1, w - 1) if dark[y, x] != dark[y + 1, x]]

    def scores(angle):
        rows = np.zeros((h + 128, 4))
        for x, y, b in points:
            v = y - np.tan(np.radians(angle)) * x + 64
            rows[int(v // 1), b] += 1 - v % 1
            rows[int(v // 1) + 1, b] += v % 1
        return (rows**2).sum(axis=0)

    trials = [(i / 10, scores(i / 10)) for i in range(-30, 31)]
    last = lambda key: max(enumerate(trials), key=lambda t: (key(t[1][1]), t[0]))[1]
    middle = last(lambda s: s.sum())[0]
    trials += [(middle + i * 0.02, scores(middle + i * 0.02)) for i in range(-4, 5)]
    angle, at = last(lambda s: s.sum())
    zero, agreeing, evidence = scores(0.0), 0, 0
    for b in range(4):
        if sum(p[2] == b for p in points) >= 200:
            evidence += 1
            agreeing += abs(last(lambda s, b=b: s[b])[0] - angle) <= 0.2 and at[b] >= zero[b] * 1.03
    gain = at.sum() / max(zero.sum(), 1)
    weak = agreeing < 2 or agreeing * 2 <= evidence or gain < 1.05
    return angle, agreeing, evidence, len(points), gain, "near_upright" if abs(angle) < 0.2 else "search_boundary" if abs(angle) >= 2.9 else "weak_consensus" if weak else "applied"


def test_skew_against_the_plain_rule():
    rng, reasons = np.random.default_rng(4), set()
    y, x = np.mgrid[0:120, 0:160]
    for _ in range(12):
        angles = rng.choice((-2.0, -1.0, 0.0, 1.0, 1.4, 3.0), 4) if rng.random() < 0.7 else np.full(4, rng.choice((-1.5, 1.0)))
        at = np.repeat(angles, 30)[:, None]
        dark = ((y - np.tan(np.radians(at)) * (x - 80)) % 15 < 6) ^ (rng.random((120, 160)) < rng.choice((0.0, 0.05)))
        got, want = orientation.estimate(dark), plain_skew(dark)
        assert got[2:5] == want[1:4] and got[-1] == want[-1] and (got[0], got[5]) == pytest.approx((want[0], want[4]))
        reasons.add(got[-1])
    assert {"weak_consensus", "applied"} <= reasons


def test_first_come_and_seams_against_plain_loops(spark):
    rng = random.Random(5)
    kind = "page_id long, idx long, x0 double, y0 double, x1 double, y1 double, objectness double"
    box = lambda: (lambda x, y: (float(x), float(y), float(x + rng.randint(0, 12)), float(y + rng.randint(1, 9))))(rng.randint(0, 60), rng.randint(0, 40))
    words = [(p, i, *box(), rng.random()) for p in range(3) for i in range(40)]
    others = [(p, i, *box(), 0.0) for p in range(3) for i in range(4)]
    meets = lambda a, b: b[4] > b[2] and a[0] == b[0] and a[2] < b[4] and b[2] < a[4] and a[3] < b[5] and b[3] < a[5]
    taken = []
    for w in sorted(words, key=lambda w: (w[0], -w[6], w[1])):
        if w[4] > w[2] and not any(meets(w, o) for o in [*others, *taken]):
            taken.append(w)
    got = tiles.apart(spark.createDataFrame(words, kind), spark.createDataFrame(others, kind), [-F.col("objectness")]).collect()
    assert sorted(map(tuple, got)) == sorted(taken)
    assert tiles.apart(spark.createDataFrame([], kind), spark.createDataFrame(others, kind), [-F.col("objectness")]).count() == 0

    dims = spark.createDataFrame([(1, 100, 100)], "page_id long, width int, height int")
    seen = [  # doubles that both own; a pair that neither owns; a pair that one owns
        (1, 0, 30.0, 0.0, 54.0, 10.0, 0.5, 0), (1, 0, 46.0, 0.0, 66.0, 10.0, 0.9, 1), (1, 1, 44.0, 20.0, 62.0, 30.0, 0.4, 0), (1, 1, 40.0, 20.0, 58.0, 30.0, 0.3, 1),
        (1, 2, 40.0, 40.0, 70.0, 50.0, 0.7, 0), (1, 2, 41.0, 40.0, 70.0, 50.0, 0.6, 1), (1, 3, 44.0, 22.0, 61.0, 32.0, 0.8, 0),
    ]
    base = spark.createDataFrame([(1, 9, 0.0, 60.0, 10.0, 70.0, 0.5)], kind)
    found = tiles.merge_with_seams(base, spark.createDataFrame(seen, kind + ", tile int"), tiles.halves(dims), least=0.2)
    assert sorted((r.idx, r.x0, r.from_tile) for r in found.collect()) == [(0, 46.0, True), (1, 44.0, True), (2, 41.0, True)]


def test_small_parts(spark):
    dims = spark.createDataFrame([(1, 1000, 500)], "page_id long, width int, height int")
    rows = [(1, 0, 0, 5, 3, 3), (1, 0, 0, 5, 2, 9), (1, 0, 0, 5, 3, 2), (1, 0, 0, 40, 20, 9), (1, 0, 0, 41, 20, 9), (1, 0, 0, 40, 21, 9), (1, 0, 0, 1, 12, 9), (1, 0, 0, 1, 13, 9)]
    found = tiles.small_parts(spark.createDataFrame(rows, "page_id long, x0 int, y0 int, x1 int, y1 int, pixels int"), dims)
    assert sorted(map(tuple, found.collect())) == sorted(rows[k] for k in (0, 3, 6))


def test_quadrilaterals(spark):
    rng = np.random.default_rng(6)
    grid = (np.stack(np.meshgrid(np.arange(400), np.arange(400)), axis=-1).reshape(-1, 2) + 0.5) / 20
    inside = lambda q: np.all([(q[(k + 1) % 4, 0] - q[k, 0]) * (grid[:, 1] - q[k, 1]) - (q[(k + 1) % 4, 1] - q[k, 1]) * (grid[:, 0] - q[k, 0]) >= 0 for k in range(4)], axis=0)
    quads = []
    for _ in range(40):
        angle = np.sort(rng.uniform(0, 2 * np.pi, 4))
        quads.append(rng.uniform(7, 13, 2) + rng.uniform(2, 6) * np.stack([np.cos(angle), np.sin(angle)], axis=1))
    a, b = np.array(quads[:20]), np.array(quads[20:])
    areas = quadrilaterals.common_areas(a[:, ::-1], b)
    for i in range(20):
        x, y = inside(a[i]), inside(b[i])
        assert [v[i] * 400 for v in areas] == pytest.approx([x.sum(), y.sum(), (x & y).sum()], abs=120)
    rows = spark.createDataFrame([([0.0, 0.0, 2.0, 0.0, 2.0, 2.0, 0.0, 2.0], [1.0, 0.0, 3.0, 0.0, 3.0, 2.0, 1.0, 2.0]), (None, [1.0] * 8), ([1.0] * 8, [1.0] * 8), ([1.0], [1.0] * 8)], "a array<double>, b array<double>")
    assert [r.iou for r in rows.select(quadrilaterals.quad_iou(F.col("a"), F.col("b")).alias("iou")).collect()] == [pytest.approx(1 / 3), 0.0, 0.0, 0.0]


def test_quadrilaterals_meet_by_their_boxes(spark):
    kind = "page_id long, idx long, quad array<double>"
    left = spark.createDataFrame([(1, 0, [5.0, 0.0, 10.0, 5.0, 5.0, 10.0, 0.0, 5.0]), (2, 1, [0.0, 0.0, 9.0, 0.0, 9.0, 9.0, 0.0, 9.0]), (1, 2, None)], kind)
    right = spark.createDataFrame([(1, 7, [5.0, 0.0, 10.0, 5.0, 5.0, 10.0, 0.0, 5.0]), (1, 8, [0.0, 0.0, 2.0, 0.0, 2.0, 2.0, 0.0, 2.0])], kind)
    assert [(r.page_id, r.l_idx, r.r_idx, r.iou) for r in matching.overlapping_quads(left, right).collect()] == [(1, 0, 7, 1.0)]


def test_recognition_score(spark):
    rows = [("Straße", "STRASSE"), ("élan", "elan"), ("ΟΔΟΣ", "οδος"), ("a", "a"), (None, "x"), ("ab", None), ("Iı", "iı")]

    def edits(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, line[0] = line[0], i
            for j, z in enumerate(b, 1):
                before, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, before + (x != z))
        return line[-1]

    plain = [(a or "", b or "") for a, b in rows]
    got = recognition.recognition_score(spark.createDataFrame(rows, "l_text string, r_text string")).first()
    assert got.words == 7 and got.exact == 1 / 7 and got.case_blind == sum(a.casefold() == b.casefold() for a, b in plain) / 7
    assert got.cer == sum(edits(a, b) for a, b in plain) / sum(len(a) for a, _ in plain)
    assert tuple(recognition.recognition_score(spark.createDataFrame([], "l_text string, r_text string")).first()) == (0, 0.0, 0.0, 0.0)


def test_streams_say_what_is_wrong(spark, tmp_path):
    schema, parts = "run long, sequence long, text string", "run long, sequence long, part int, of int, text string"

    def stream(rows, kind):
        folder = tempfile.mkdtemp(dir=tmp_path)
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        return spark.readStream.schema(kind).parquet(f"{folder}/in"), f"{folder}/out"

    rows, out = stream([(1, 0, "a"), (1, 1, "b"), (1, 1, "b")], schema)
    with pytest.raises(Exception, match=streams.DOUBLE_PAGE):
        streams.run_to_end(streams.in_order(rows), out)
    twice, out = stream([(1, 0, 0, 2, "a"), (1, 0, 1, 2, "b"), (1, 0, 1, 2, "b")], parts)
    with pytest.raises(Exception, match=streams.DOUBLE_PART):
        streams.run_to_end(streams.gathered(twice), out)
    with pytest.raises(Exception, match=streams.DOUBLE_PART):
        streams.gathered(spark.createDataFrame([(1, 0, 1, 2, "b"), (1, 0, 1, 2, "b")], parts)).collect()
    gap, out = stream([(1, 0, "a"), (1, 2, "c")], schema)
    emitted = streams.run_to_end(streams.in_order(gap), out)
    with pytest.raises(ValueError, match=streams.MISSING_PAGE):
        streams.finished(emitted, spark.createDataFrame([(1, 0, "a"), (1, 2, "c")], schema))
    assert streams.finished(emitted, emitted).count() == 1


def test_fused_maps_against_plain_loops(spark):
    rng = np.random.default_rng(9)
    side, width, height = 20, 33, 90
    scale = side / 24
    tiles_ = [(x, y, rng.random((side, side))) for x in (0, 12) for y in (0, 20, 44, 66)]
    w, h = int(np.ceil(width * scale)), int(np.ceil(height * scale))

    def sample(p, x, y):
        x, y = min(max(x, 0), side - 1), min(max(y, 0), side - 1)
        a, b = int(x), int(y)
        c, d = min(a + 1, side - 1), min(b + 1, side - 1)
        return (p[b, a] * (1 - x + a) + p[b, c] * (x - a)) * (1 - y + b) + (p[d, a] * (1 - x + a) + p[d, c] * (x - a)) * (y - b)

    want = np.zeros((2, h, w))
    for gy in range(h):
        for gx in range(w):
            sx, sy, sums, weights = (gx + 0.5) / scale, (gy + 0.5) / scale, [0.0, 0.0], [0.0, 0.0]
            for x, y, p in tiles_:
                x1, y1 = x + 24, y + 24
                if x <= sx < x1 and y <= sy < y1:
                    tx, ty = (sx - x) * scale, (sy - y) * scale
                    edge = min(128.0, *([tx] if x > 0 else []), *([ty] if y > 0 else []), *([side - tx] if x1 < width else []), *([side - ty] if y1 < height else []), 128.0)
                    for mode, weight in enumerate((1.0, min(max(edge / 128, 0.001), 1.0))):
                        sums[mode] += sample(p, tx - 0.5, ty - 0.5) * weight
                        weights[mode] += weight
            want[:, gy, gx] = [s / v for s, v in zip(sums, weights, strict=True)]
    rows = spark.createDataFrame([(1, x, y, width, height, p.ravel().tolist()) for x, y, p in tiles_], "page_id long, x int, y int, width int, height int, p array<double>")
    got = sorted(fusion.checked(fusion.fused(rows, side, 24)).collect(), key=lambda r: r.band)
    assert len(got) == 2
    for mode, name in enumerate(("even", "tapered")):
        assert np.concatenate([np.array(r[name]).reshape(-1, r.width) for r in got]) == pytest.approx(want[mode])
    with pytest.raises(Exception, match="Uncovered"):
        fusion.checked(fusion.fused(rows.where("x = 0"), side, 24)).collect()
    assert fusion.fused(rows.limit(0), side, 24).count() == 0
    words = spark.createDataFrame([(0.0, 0.0, 1.0, 0.5, w, h, width, height), (0.2, 0.2, 0.2, 0.4, w, h, width, height)], "x0 double, y0 double, x1 double, y1 double, map_width int, map_height int, width int, height int")
    (r,) = fusion.boxes_on_page(words, scale).collect()
    assert (r.x1, r.y1) == (1.0, pytest.approx(0.5 * h / (scale * height)))


def test_alternatives_keep_to_their_budget(spark):
    kind = "page_id long, idx long, x0 double, y0 double, x1 double, y1 double, parts int"
    row = [(1, i, 40.0 * i, 10.0, 40.0 * i + 30, 20.0, 1) for i in range(4)]
    narrow = [(1, 10, 32.0, 8.0, 36.0, 19.0, 1), (1, 11, 72.0, 9.0, 75.0, 20.0, 1)]
    high = [(2, i, 10.0, 25.0 * i, 20.0, 25.0 * i + 40, 1) for i in range(3)] + [(2, 9, 200.0, 0.0, 210.0, 40.0, 2)]
    words = spark.createDataFrame(row + narrow + high, kind)
    dims = spark.createDataFrame([(1, 300, 100), (2, 300, 300)], "page_id long, width int, height int")
    found = sorted(map(tuple, lines.alternatives(words, dims).collect()))
    assert [f[:4] for f in found] == [(1, 10, "horizontal_line_context", 0), (1, 11, "horizontal_line_context", 0)] + [(2, i, "vertical_line_neighbours", r) for i in range(3) for r in (90, 270)]
    assert found[0][4:] == (30, 8, 38, 20)
    few = lines.alternatives(words, dims, most=3)
    assert sorted({(r.page_id, r.idx) for r in few.collect()}) == [(1, 10), (1, 11), (2, 0)]
    assert lines.alternatives(words, dims, pixels=60).count() == 0 and lines.alternatives(words.limit(0), dims).count() == 0


def test_first_causes_and_examples(spark):
    errors = [(1, "writer", "disk"), (1, "detector", "Pipeline cancelled"), (1, "recognizer", "bad crop"), (2, "reader", "Downstream disconnected"), (3, "other", "x"), (3, "writer", None)]
    found = runs.first_cause(spark.createDataFrame(errors, "run long, stage string, message string")).collect()
    assert sorted(map(tuple, found)) == [(1, "recognizer", "bad crop"), (3, "writer", None)]
    rows = spark.createDataFrame([("b", 2), ("a", 1), ("a", 0), ("c", None)], "k string, v int")
    assert [tuple(r) for r in runs.examples(rows, ["k"], [F.col("v")], 2).collect()] == [("c", None), ("a", 0)]
    kept = runs.captured(rows, F.col("k") != "b", F.col("v"), F.lit("none")).orderBy("k", "v").collect()
    assert [(r.value, r.error) for r in kept] == [(0, None), (1, None), (None, None), (None, "none")]


def test_series(spark):
    rows = spark.createDataFrame([("a", v) for v in range(1, 101)] + [("b", 7), ("b", None)], "k string, v int")
    got = {r.k: (r.p50, r.p95, r.p99) for r in series.floor_rank(rows, ["k"], "v", (50, 95, 99)).collect()}
    assert got == {"a": (50, 95, 99), "b": (7, 7, 7)}
    spans = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 6, 7), (2, 1, 2)], "k int, a int, b int")
    assert {r.k: r.most for r in series.high_water(spans, ["k"], "a", "b").collect()} == {1: 2, 2: 1}
    rates = spark.createDataFrame([("a", float(t)) for t in (0, 4, 11, 12, 30)] + [("b", 1.0)], "k string, t double")
    assert [(r.at, r.rate) for r in series.adaptive_rates(rates, "k", "t").orderBy("at").collect()] == [(11.0, 2 / 11), (30.0, 2 / 19)]


def test_replay_is_numbered_in_many_tasks(spark, tmp_path):
    ids = random.Random(8).sample(range(-500, 5000), 1001) + [7, 7, 7]
    spark.createDataFrame([(i,) for i in ids], "item_id long").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = measures.cyclic_replay(spark, str(tmp_path))
    plan = found._jdf.queryExecution()
    assert "SinglePartition" not in plan.executedPlan().toString() and "strategy=broadcast" not in plan.optimizedPlan().toString()
    want, n = {}, len(ids)
    for k in range(n * 7 // 2):
        want.setdefault(k % n, []).append(k)
    places = {}
    for place, i in enumerate(sorted(ids)):
        places.setdefault(i, []).extend(want[place])
    assert {(r.item_id, r.times, r["last"]) for r in found.collect()} == {(i, len(k), max(k)) for i, k in places.items()}


def test_tiles(spark):
    dims = spark.createDataFrame([(1, 1000, 400), (2, 0, 0)], "page_id long, width int, height int")
    covered = np.zeros((400, 1000), bool)
    for r in tiles.windows(dims, 2048, 0.25).collect():
        assert r.page_id == 1
        covered[max(r.y, 0) : r.y + r.side, max(r.x, 0) : r.x + r.side] = True
    assert covered.all()
    words = spark.createDataFrame([(1, 0, 10.0, 0.0, 30.0, 10.0, 0.5, 1), (1, 1, 12.0, 0.0, 32.0, 10.0, 0.9, 0), (1, 2, 500.0, 0.0, 520.0, 10.0, 0.1, 0)], "page_id long, idx long, x0 double, y0 double, x1 double, y1 double, objectness double, edge_margin int")
    assert sorted(r.idx for r in tiles.suppressed(words).collect()) == [0, 2]
    costs = spark.createDataFrame([(1, 0, 0.9, 60), (1, 1, 0.8, 60), (1, 2, 0.7, 40), (1, 3, 0.6, 1)], "page_id long, idx long, objectness double, cost int")
    assert sorted(r.idx for r in tiles.budgeted(costs, most=3, pixels=100).collect()) == [0, 2]


def test_empty_tiles_keep_the_page(spark):
    dims = spark.createDataFrame([(1, 100, 100)], "page_id long, width int, height int")
    halves = tiles.halves(dims)
    base = spark.createDataFrame([(1, 0, 10.0, 10.0, 20.0, 20.0), (1, 1, 80.0, 10.0, 90.0, 20.0)], "page_id long, idx long, x0 double, y0 double, x1 double, y1 double")
    own = base.where("idx = 0").withColumns({"idx": F.lit(9).cast("long"), "tile": F.lit(0)})
    got = sorted((r.idx, r.from_tile) for r in tiles.merge_owned(base, own, halves).collect())
    assert got == [(1, False), (9, True)]
    assert tiles.merge_owned(base, own.limit(0), halves).count() == 2


def test_thin_glyph_needs_two_anchors(spark):
    kind = "page_id long, idx long, x0 double, y0 double, x1 double, y1 double, objectness double"
    thing = spark.createDataFrame([(1, 0, 44.0, 41.0, 46.0, 49.0, 0.5)], kind)
    anchors = spark.createDataFrame([(1, 10.0, 40.0, 30.0, 50.0), (1, 60.0, 40.0, 90.0, 50.0)], "page_id long, x0 double, y0 double, x1 double, y1 double")
    (r,) = recovery.proposals(thing, anchors).collect()
    assert (r.x0, r.y0, r.x1, r.y1) == (41.0, 37.0, 49.0, 53.0)
    assert recovery.proposals(thing, anchors.limit(1)).count() == 0
    hop = spark.createDataFrame([(1, 10.0, 40.0, 30.0, 50.0), (1, -40.0, 40.0, -10.0, 50.0)], "page_id long, x0 double, y0 double, x1 double, y1 double")
    assert recovery.proposals(thing, hop).count() == 1


def test_pipeline_keeps_blank_pages(spark):
    p = np.zeros((20, 20), np.float32)
    p[7:10, 6:13] = 0.9
    maps = spark.createDataFrame([(1, 20, p.ravel().tolist(), 200, 100), (2, 20, [0.0] * 400, 100, 100)], "page_id long, width int, p array<float>, page_width int, page_height int")
    named = lambda b: b.assign(text="ok", confidence=1.0)
    found = pipeline.words(maps, named)
    got = {r.page_id: r.words for r in pipeline.pages(maps, found).collect()}
    assert got[2] is None and [w.text for w in got[1]] == ["ok"]


def test_settings():
    assert config.settings() == config.settings() and config.settings("low-vram").inflight == 2
    for wrong in ({"detector_size": 33}, {"deskew": True}, {"nothing": 1}, {"inflight": 0}, {"bin_thresh": 1.0}):
        with pytest.raises(ValueError):
            config.settings(**wrong)
    with pytest.raises(ValueError):
        config.settings("fast")


def test_streams_give_what_batches_give(spark, tmp_path):
    rng = random.Random(1)
    rows = [(r, s, p, 2, f"{r}.{s}.{p} ") for r in range(3) for s in range(20) for p in range(2) if (r, s, p) != (1, 7, 1)]
    rows += rng.sample(rows, 15)
    rng.shuffle(rows)
    schema = "run long, sequence long, part int, of int, text string"
    for i in range(4):
        spark.createDataFrame(rows[i::4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = streams.run_to_end(streams.gathered(streams.watch(spark, str(tmp_path / "in"), schema, config.Settings(inflight=1)), strict=False), str(tmp_path / "a"))
    want = streams.gathered(spark.createDataFrame(rows, schema), strict=False)
    key = lambda df: sorted(map(tuple, df.select("run", "sequence", "text").collect()))
    assert key(got) == key(want) and got.count() == 59
    whole = spark.readStream.schema(got.schema).parquet(str(tmp_path / "a" / "rows"))
    ordered = streams.run_to_end(streams.in_order(whole), str(tmp_path / "b"))
    assert sorted((r.run, r.sequence) for r in ordered.collect()) == [(r, s) for r in range(3) for s in range(7 if r == 1 else 20)]


def test_matchings_of_parts(spark):
    """Long chains, parts over several batches, lone pairs and equal numbers on different pages; a plain search over each page agrees."""
    rng = random.Random(4)
    rows = []
    for page in range(6):
        for k in range(9):
            rows += [(page, k, k, round(rng.uniform(0.3, 0.9), 3)), (page, k, k + 1, round(rng.uniform(0.3, 0.9), 3))]
        rows += [(page, 100 + k, 100 + k, 0.7) for k in range(4)]
    pairs = spark.createDataFrame(rows, "page_id long, l_idx int, r_idx int, iou double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        most = matching.maximum_matching(pairs, 0.5).collect()
        best = matching.optimal_assignment(pairs, 0.0).collect()
        none = matching.maximum_matching(pairs.limit(0)).count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert none == 0
    for page in range(6):
        mine = {(a, b): v for p, a, b, v in rows if p == page}

        def search(k, used, mine, least):
            if k == 9:
                return 0, 0.0
            options = [search(k + 1, used, mine, least)]
            for j in (k, k + 1):
                if j not in used and mine[k, j] >= least:
                    n, total = search(k + 1, used | {j}, mine, least)
                    options.append((n + 1, total + mine[k, j]))
            return max(o[0] for o in options), max(o[1] for o in options)

        got = [(r.l_idx, r.r_idx) for r in most if r.page_id == page]
        assert len({a for a, _ in got}) == len({b for _, b in got}) == len(got) == search(0, frozenset(), mine, 0.5)[0] + 4
        assert sum(r.iou for r in best if r.page_id == page) == pytest.approx(search(0, frozenset(), mine, 0.0)[1] + 4 * 0.7)


def test_peers_of_both_directions(spark):
    rng = random.Random(9)
    boxes = []
    for i in range(140):
        x, y = rng.randint(-40, 500), rng.randint(-20, 260)
        boxes.append((i % 2, i, x, y, x + rng.randint(0, 60), y + rng.randint(0, 45)))
    boxes += [(0, 900, 10, 10, 50, 22), (0, 901, 10, 10, 50, 22), (0, 902, None, 10, 50, 22)]
    df = spark.createDataFrame(boxes, "page_id long, idx long, x0 int, y0 int, x1 int, y1 int")
    found = {(r.page_id, r.idx): (r.beside, r.top, r.bottom, r.above) for r in lines.around(df).collect()}
    want = {}
    solid = [b for b in boxes if b[2] is not None]
    for p, i, *a in solid:
        sides = {False: [], True: []}
        for q, j, *b in solid:
            for turned in sides:
                (u0, v0, u1, v1), (c0, d0, c1, d1) = [(z[1], z[0], z[3], z[2]) if turned else z for z in (a, b)]
                long, near, thin, thick = lines.DOWN if turned else lines.ACROSS
                t = d1 - d0
                if p == q and i != j and t > 0 and c1 - c0 >= long * t and abs(v0 + v1 - d0 - d1) / 2 < near * t and abs(u0 + u1 - c0 - c1) / 2 < 6 * t and thin < (v1 - v0) / t < thick:
                    sides[turned].append(b)
        line, n = sides[False], len(sides[False])
        if n or sides[True]:
            want[p, i] = (n, sorted(b[1] for b in line)[n // 2] if n else None, sorted(b[3] for b in line)[n // 2] if n else None, len(sides[True]))
    assert found == want and any(w[3] for w in want.values()) and any(w[0] > 1 for w in want.values())
    assert lines.around(df.limit(0)).count() == 0
    assert lines.peers(df).count() == sum(w[0] for w in want.values()) and lines.peers(df, vertical=True).count() == sum(w[3] for w in want.values())


def test_box_scores_round_ties_up(spark, tmp_path):
    """45 pixels of 0.9 among 64 make 40.5 / 64 = 0.6328125; added as doubles they fall short of it."""
    spark.range(352, 360).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r[:5]: r[5:] for r in map(tuple, vision.box_scores(spark, str(tmp_path)).collect())}
    assert got[44, 0, 42, 15, 3] == (0.632813, 64)
