"""The composed run against plain loops over pixels and words, page by page."""

from __future__ import annotations

import math
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphloom.functions import config
from glyphloom.operators import composed, recognition
from glyphloom.plans import flows
from glyphloom.sources import derived as d

SF = "/root/testdata/sf0.001"


def around(y, x, h, w, diagonal=True):
    return [(v, u) for v in range(max(y - 1, 0), min(y + 2, h)) for u in range(max(x - 1, 0), min(x + 2, w)) if diagonal or v == y or u == x]


def parts_of(mask):
    """Components over eight neighbours, in raster order of their first pixels."""
    h, w = mask.shape
    seen, out = set(), []
    for y, x in zip(*np.nonzero(mask), strict=True):
        if (y, x) in seen:
            continue
        seen.add((y, x))
        queue, own = deque([(y, x)]), []
        while queue:
            at = queue.popleft()
            own.append(at)
            for n in around(*at, h, w):
                if mask[n] and n not in seen:
                    seen.add(n)
                    queue.append(n)
        out.append(own)
    return out


def opened(mask):
    h, w = mask.shape
    eroded, out = np.zeros_like(mask), np.zeros_like(mask)
    for y in range(h):
        for x in range(w):
            eroded[y, x] = all(mask[n] for n in around(y, x, h, w))
    for y in range(h):
        for x in range(w):
            out[y, x] = any(eroded[n] for n in around(y, x, h, w))
    return out


def outside_of(mask):
    h, w = mask.shape
    seen = {(y, x) for y in range(h) for x in range(w) if (y in (0, h - 1) or x in (0, w - 1)) and not mask[y, x]}
    queue = deque(seen)
    while queue:
        for n in around(*queue.popleft(), h, w, diagonal=False):
            if not mask[n] and n not in seen:
                seen.add(n)
                queue.append(n)
    return seen


def rounded(v):
    return math.copysign(math.floor(abs(v) + 0.5), v)


def on_page(edges, side, region):
    """Edges in map pixels to a box on the page."""
    x, y, w, h = region
    s = [min(max(e / side, 0.0), 1.0) for e in edges]
    stretch = lambda v, a, b: min(max((v - 0.5) * a / b + 0.5, 0.0), 1.0)
    if h > w:
        s[0], s[2] = stretch(s[0], h, w), stretch(s[2], h, w)
    elif w > h:
        s[1], s[3] = stretch(s[1], w, h), stretch(s[3], w, h)
    return x + s[0] * w, y + s[1] * h, x + s[2] * w, y + s[3] * h


def detected(p, region):
    """Words and recovery candidates of a map: (box, objectness) each."""
    side = p.shape[1]
    mask = p >= np.float32(0.3)
    kept = opened(mask)
    outside, words, anchors = outside_of(kept), [], []
    for own in parts_of(kept):
        ys, xs = [y for y, _ in own], [x for _, x in own]
        x0, y0, x1, y1 = min(xs), min(ys), max(xs), max(ys)
        w, h = x1 - x0 + 1, y1 - y0 + 1
        if w >= 3 and h >= 4 and w >= h:
            anchors.append((x0, y0, x1 + 1, y1 + 1))
        external = any(y in (0, side - 1) or x in (0, side - 1) or any(n in outside for n in around(y, x, side, side)) for y, x in own)
        score = np.float32(p[y0 : y1 + 2, x0 : x1 + 2].mean())
        if not external or w < 3 or h < 3 or score < np.float32(0.1):
            continue
        far = w * h * 1.5 / (2 * (w + h))
        box = on_page((rounded(x0 - far), rounded(y0 - far), rounded(x0 + w + far) + 1, rounded(y0 + h + far) + 1), side, region)
        if box[2] > box[0] and box[3] > box[1]:
            words.append((box, float(score)))
    found = []
    for own in parts_of(mask):
        ys, xs = [y for y, _ in own], [x for _, x in own]
        x0, y0, x1, y1 = min(xs), min(ys), max(xs) + 1, max(ys) + 1
        w, h = x1 - x0, y1 - y0
        if any(kept[n] for n in own) or not 3 <= h <= 60 or w > 0.6 * h or len(own) < 3 or len(own) / (w * h) < 0.25:
            continue
        peers = []
        for a in anchors:
            ah, gap = a[3] - a[1], max(a[0] - x1, x0 - a[2], 0)
            if 0.4 <= h / ah <= 2 and abs((y0 + y1 - a[1] - a[3]) / 2) <= 0.35 * max(h, ah) and gap <= 5 * max(h, ah):
                peers.append((gap, a))
        if len(peers) == 1:
            a, more = peers[0][1], []
            for b in anchors:
                ah, bh, gap = a[3] - a[1], b[3] - b[1], max(b[0] - a[2], a[0] - b[2], 0)
                beyond = (b[0] + b[2] - a[0] - a[2]) * (a[0] + a[2] - x0 - x1) > 0 and (b[0] >= a[2] or b[2] <= a[0])
                if beyond and 0.65 <= ah / bh <= 1.6 and abs((a[1] + a[3] - b[1] - b[3]) / 2) <= 0.35 * max(ah, bh) and gap <= 5 * max(ah, bh):
                    more.append((gap, b))
            peers += sorted(more)[:1]
        score = sum(float(p[n]) for n in own) / len(own)
        if len(peers) < 2 or score < 0.3:
            continue
        (_, a), (_, b) = sorted(peers)[:2]
        top, bottom = (a[1] + b[1]) / 2, (a[3] + b[3]) / 2
        pad = 0.3 * max(h, bottom - top)
        found.append((on_page((x0 - pad, min(y0, top) - pad, x1 + pad, max(y1, bottom) + pad), side, region), score))
    found.sort(key=lambda c: -c[1])
    return words[::-1], found[:32]


def common(a, b):
    return max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)


def iou(a, b):
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return common(a, b) / (area(a) + area(b) - common(a, b))


def merged(base, seen):
    """seen: (tile, words) each. Ownership, doubles on seams, fallbacks."""
    base = [(*w, "page") for w in base]
    mid = lambda b: (b[0] + b[2]) / 2
    owns = lambda b, t: t["owner_start"] <= mid(b) < t["owner_end"]
    gone, back = [], []
    for i, (t, words) in enumerate(seen):
        for u, others in seen[i + 1 :]:
            for a in words:
                for b in others:
                    seam = t["owner_end"]
                    if seam != u["owner_start"] or not all(w[0][0] <= seam <= w[0][2] for w in (a, b)) or iou(a[0], b[0]) < 0.5:
                        continue
                    won, lost = (a, b) if a[1] >= b[1] else (b, a)
                    if not owns(a[0], t) and not owns(b[0], u):
                        back.append(won)
                    if owns(a[0], t) and owns(b[0], u):
                        gone.append(lost[0])
    for t, words in seen:
        inside = lambda b, t=t: owns(b, t) and t["y0"] <= (b[1] + b[3]) / 2 <= t["y1"]
        own = [(*w, "tile") for w in words if inside(w[0])]
        if own:
            base = [w for w in base if not inside(w[0])] + own
    base = [w for w in base if w[0] not in gone]
    for w in back:
        if not any(iou(o[0], w[0]) > 0 for o in base):
            base.append((*w, "tile"))
    return base


def crop(box, width, height):
    x0, y0 = round(box[0]), round(box[1])
    w, h = min(round(box[2]) + 1, width) - x0, min(round(box[3]) + 1, height) - y0
    if w <= 8 * h:
        return x0, y0, w, h, [0]
    part = 6 * h
    starts = list(range(0, w - part + 1, part - part // 2))
    return x0, y0, w, h, starts + [w - part] * (starts[-1] + part < w)


def near(boxes, i, upright):
    out, a = [], boxes[i]
    for j, b in enumerate(boxes):
        w, h = b[2] - b[0], b[3] - b[1]
        dx, dy = abs(a[0] + a[2] - b[0] - b[2]) / 2, abs(a[1] + a[3] - b[1] - b[3]) / 2
        if upright:
            fits = h >= 1.6 * w and dx < 0.4 * w and dy < 6 * w and 0.5 < (a[2] - a[0]) / w < 1.8
        else:
            fits = w >= 1.3 * h and dy < 0.45 * h and dx < 6 * h and 0.35 < (a[3] - a[1]) / h < 1.8
        if i != j and fits:
            out.append(b)
    return out


def other_crops(boxes, crops, width, height):
    out, n, pixels = defaultdict(list), 0, 0
    for i, b in enumerate(boxes):
        if len(crops[i][4]) != 1:
            continue
        peers, w, h = near(boxes, i, False), b[2] - b[0], b[3] - b[1]
        if len(peers) >= 2 and w < 0.8 * h:
            tops, ends = sorted(p[1] for p in peers), sorted(p[3] for p in peers)
            x0, x1 = int(max(math.floor(b[0] - 0.15 * h), 0)), int(min(math.ceil(b[2] + 0.15 * h), width))
            y0, y1 = int(max(math.floor(min(tops[len(tops) // 2], b[1])), 0)), int(min(math.ceil(max(ends[len(ends) // 2], b[3])), height))
            if x1 <= x0 or y1 <= y0 or any(j != i and common(p, (x0, y0, x1, y1)) > 0 for j, p in enumerate(boxes)):
                continue
            more = [(x0, y0, x1 - x0, y1 - y0, 0)]
        elif len(peers) < 2 and h > 1.8 * w and len(near(boxes, i, True)) >= 2:
            more = [(*crops[i][:4], 90), (*crops[i][:4], 270)]
        else:
            continue
        size = sum(c[2] * c[3] for c in more)
        if pixels + size > 1_000_000 or n + len(more) > 32:
            continue
        pixels, n = pixels + size, n + len(more)
        out[i] = more
    return out


def read(page, c, others):
    x, y, w, h, starts = c
    seen = [flows._seen(page, x, y, w, h, s, 0) for s in starts]
    last = (starts[-2] + 6 * h - starts[-1]) / (6 * h) if len(starts) > 1 else 0.0
    text, sure, turn = recognition.merged_parts([t for t, _ in seen], last), sum(s for _, s in seen) / len(seen), None
    first, those = sure, [(o[4], *flows._seen(page, *o[:4], 0, o[4])) for o in others]
    for angle, t, s in those:
        rivals = [x[2] for x in those if x[0] != angle]
        if s >= 0.9 and s > first + 0.15 and s > sure and (angle == 0 or all(s > r + 0.1 for r in rivals)) and len(t) >= (1 if angle == 0 else 2):
            text, sure, turn = t, s, angle
    return text, sure, turn


def plain(page, p, width, height, seen):
    """seen: (tile, its map) each."""
    words, late = detected(p, (0, 0, width, height))
    of_tiles, candidates = [], []
    for t, q in seen:
        own, more = detected(q, (t["x0"], t["y0"], t["x1"] - t["x0"], t["y1"] - t["y0"]))
        of_tiles.append((t, own))
        candidates += [c for c in more if t["owner_start"] <= (c[0][0] + c[0][2]) / 2 < t["owner_end"] and t["y0"] <= (c[0][1] + c[0][3]) / 2 <= t["y1"]]
    words = merged(words, of_tiles)
    boxes = [w[0] for w in words]
    crops = [crop(b, width, height) for b in boxes]
    others = other_crops(boxes, crops, width, height)
    apart = []
    for c in candidates + late:
        if c[0][2] > c[0][0] and c[0][3] > c[0][1] and not any(common(c[0], o) > 0 for o in boxes + [a[0] for a in apart]):
            apart.append(c)
    taken, pixels = [], 0
    for c in sorted(apart, key=lambda c: -c[1]):
        size = (math.ceil(c[0][2]) - math.floor(c[0][0]) + 2) * (math.ceil(c[0][3]) - math.floor(c[0][1]) + 2)
        if len(taken) < 32 and pixels + size <= 1_000_000:
            pixels += size
            taken.append(c)
    out = [(page, w[2], w[0], w[1], *read(page, c, others[i])) for i, (w, c) in enumerate(zip(words, crops, strict=True))]
    for c in taken:
        text, sure, turn = read(page, crop(c[0], width, height), [])
        if sure >= 0.9 and 1 <= len(text) <= 2 and text.isalnum():
            out.append((page, "recovered", *c, text, sure, turn))
    return out, len(words), sum(len(x) for x in others.values()), len(taken)


def key(r):
    page, source, box, objectness, text, sure, turn = r
    return page, source, *(round(v, 5) for v in box), round(objectness, 5), text, round(sure, 6), turn if turn is not None else -1


@pytest.fixture(scope="module")
def drawn(spark):
    groups, pages, bands = d.layout(spark, SF), d.layout_pages(spark, SF), d.layout_tiles(spark, SF)
    whole = pages.select("page_id", F.lit(-1).alias("tile"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.col("page_width").alias("x1"), F.col("page_height").alias("y1"))
    maps = d.drawn(groups.where("page_id != 1 or k > 50"), whole).join(pages, "page_id").cache()
    return maps, bands.cache(), d.drawn(groups.where("page_id != 2 or x0 < 200"), bands).cache()


def as_maps(rows):
    return {(r.page_id, r.tile): np.array(r.p, np.float32).reshape(-1, r.width) for r in rows}


def test_run_is_what_loops_give(spark, drawn):
    maps, bands, in_tiles = drawn
    run = composed.run(maps.drop("tile"), bands, in_tiles, flows._reader, config.settings(dense_refinement=True, thin_recovery=True, line_guided=True, recognition_batch=7))
    got = run.words.collect()
    p, q, want, sums = as_maps(maps.collect()), as_maps(in_tiles.collect()), [], np.zeros(3, int)
    for r in maps.collect():
        seen = [(t.asDict(), q[r.page_id, t.tile]) for t in sorted(bands.where(F.col("page_id") == r.page_id).collect(), key=lambda t: t.tile)]
        rows, *counts = plain(r.page_id, p[r.page_id, -1], r.page_width, r.page_height, seen)
        want += rows
        sums += counts
    assert sorted(key((r.page_id, r.source, (r.x0, r.y0, r.x1, r.y1), r.objectness, r.text, r.confidence, r.rotation)) for r in got) == sorted(map(key, want))
    counts = run.counts()
    assert [counts[k] for k in ("words", "other_crops", "recovery_crops")] == sums.tolist() and counts["kept"] == len(want)
    assert min(counts[k] for k in ("tile_boxes", "words_of_tiles", "other_crops", "recovered")) > 0
    assert len({(r.page_id, r.idx) for r in got}) == len(got)


def test_run_without_its_options_is_the_simple_one(spark, drawn):
    maps, bands, in_tiles = drawn
    run = composed.run(maps.drop("tile"), bands, in_tiles, flows._reader)
    assert {r.source for r in run.words.select("source").distinct().collect()} == {"page"}
    assert run.counts()["tile_boxes"] == run.counts()["lost"] == run.counts()["other_crops"] == 0


def test_blank_pages_and_empty_tables(spark, drawn):
    maps, bands, in_tiles = drawn
    blank = maps.drop("tile").where("page_id < 2").withColumn("p", F.array_repeat(F.lit(0.0), 128 * 128))
    options = config.settings(dense_refinement=True, thin_recovery=True, line_guided=True)
    words = composed.run(blank, bands.where("page_id < 0"), in_tiles.where("page_id < 0"), flows._reader, options).words
    assert sorted((r.page_id, r.words) for r in composed.pages(blank, words).collect()) == [(0, None), (1, None)]
    none = composed.run(blank.limit(0), bands.limit(0), in_tiles.limit(0), flows._reader, options)
    assert none.words.count() == 0
