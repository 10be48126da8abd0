"""Boxes of maps that lie in bands of rows in different tasks: each band is opened and labelled by itself, with two rows of its
neighbours, labels are joined across the borders of bands, and what is left are sums.

A component may reach over any number of bands; the background is joined over four neighbours, so that only components that the
border can be reached from are given, as of a whole map. Bands are rows page_id, band, top, width and an array of values in rows; bands of
a page follow each other from 0, of one height but for the last. A page without components has no row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.functions.geometry import CORNERS, clamp
from glyphloom.operators import detection
from glyphloom.operators.detection import Params
from glyphloom.operators.fusion import boxes_on_page
from glyphloom.operators.graphs import components
from glyphloom.sources.shared import written

#: Rows of neighbours that an opening looks at.
HALO = 2
#: kind: a part of a component, a part of the background, two that touch, and the labels of a band's first and last row.
PARTS = "page_id long, band int, kind string, label int, other int, x0 int, y0 int, x1 int, y1 int, pixels long, border boolean, first_row array<int>, last_row array<int>"
#: What names a box: the band and label of its first part, which also give the order of first pixels.
BOX = ["page_id", "first_band", "first_label"]
_NEAR = [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1) if y or x]


def _with_halo(bands: DataFrame) -> DataFrame:
    """Rows of values for each band that needs them: its own, and HALO rows of those before and behind."""
    piece = lambda to, at, n: F.struct(to.alias("to"), (F.col("top") + at).alias("at"), F.slice("p", at * F.col("width") + 1, n * F.col("width")).alias("values"))
    few = F.least("rows", F.lit(HALO))
    pieces = F.array(piece(F.col("band"), F.lit(0), F.col("rows")), piece(F.col("band") - 1, F.lit(0), few), piece(F.col("band") + 1, F.col("rows") - few, few))
    sent = bands.select("page_id", "width", "height", "band_rows", F.explode(pieces).alias("piece"))
    sent = sent.select("page_id", "width", "height", "band_rows", F.col("piece.to").alias("band"), F.col("piece.at").alias("at"), F.col("piece.values").alias("values"))
    return sent.where((F.col("band") >= 0) & (F.col("band") <= F.floor((F.col("height") - 1) / F.col("band_rows"))))


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Different pairs of two arrays, one a row."""
    return np.unique(np.stack([a.ravel(), b.ravel()], axis=1), axis=0)


def _parts(threshold: float):
    def run(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        page, band = key
        pieces = pieces.sort_values("at")
        width, height, each = (int(pieces[c].iloc[0]) for c in ("width", "height", "band_rows"))
        start, top = int(pieces["at"].iloc[0]), int(band) * each
        p = np.concatenate([np.asarray(v, np.float32) for v in pieces["values"]]).reshape(-1, width)
        rows = slice(top - start, min(top + each, height) - start)
        mask = detection.open_mask(p >= np.float32(threshold))[rows]
        end = top + len(mask)
        label = detection.labelled(mask) - detection.labelled(~mask, diagonal=False)
        out = []
        for kind, signed in (("part", np.maximum(label, 0)), ("ground", np.maximum(-label, 0))):
            x0, y0, x1, y1, pixels, _ = detection.extents(signed)
            border = (x0 == 0) | (x1 == width - 1) | (y0 + top == 0) | (y1 + top == height - 1)
            numbers = np.arange(1, len(x0) + 1) * (1 if kind == "part" else -1)
            out += [(page, band, kind, k, None, *box, n, e, None, None) for k, *box, n, e in zip(*(v.tolist() for v in (numbers, x0, y0 + top, x1, y1 + top, pixels, border)), strict=True)]
        touching = [np.zeros((0, 2), int)]
        for dy, dx in _NEAR:
            here, there = (label[max(s * -dy, 0) : len(label) - max(s * dy, 0), max(s * -dx, 0) : width - max(s * dx, 0)] for s in (1, -1))
            meets = (here > 0) & (there < 0)
            touching.append(_pairs(here[meets], there[meets]))
        for k, g in np.unique(np.concatenate(touching), axis=0).tolist():
            out.append((page, band, "near", k, g, *[None] * 8))
        out.append((page, band, "rows", None, None, None, top, None, end, None, None, label[0].tolist(), label[-1].tolist()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in PARTS.split(", ")])

    return run


def _across(batches):
    """Of the last row of a band and the first of the next: which labels are one ('joined'), and which touch ('near')."""
    for b in batches:
        out = []
        for page, band, above, below in zip(b["page_id"], b["band"], b["above"], b["below"], strict=True):
            above, below = np.asarray(above), np.asarray(below)
            n = len(above)
            pairs = np.concatenate([_pairs(above[max(-d, 0) : n - max(d, 0)], below[max(d, 0) : n - max(-d, 0)]) for d in (-1, 0, 1)])
            same = _pairs(above, below)
            same = same[(same < 0).all(axis=1)]  # the background over four neighbours
            joined = np.concatenate([same, pairs[(pairs > 0).all(axis=1)]])
            out += [(page, "joined", band, int(u), band + 1, int(v)) for u, v in np.unique(joined, axis=0)]
            out += [(page, "near", band, int(u), band + 1, int(v)) if u > 0 else (page, "near", band + 1, int(v), band, int(u)) for u, v in np.unique(pairs[(pairs > 0).sum(axis=1) == 1], axis=0)]
        yield pd.DataFrame(out, columns=["page_id", "kind", "a_band", "a", "b_band", "b"])


def _node(band: str, label: str) -> Column:
    return F.struct(F.col("page_id").alias("page"), F.col(band).cast("int").alias("band"), F.col(label).cast("int").alias("label"))


def _sums(key: tuple, boxes: pd.DataFrame, bands: pd.DataFrame) -> pd.DataFrame:
    """The sum of a band's values inside each box that reaches into it."""
    out = []
    for values, top, width in zip(bands["p"], bands["top"], bands["width"], strict=True):
        p = np.asarray(values, float).reshape(-1, int(width))
        for page, band, label, x0, y0, x1, y1 in zip(*(boxes[c] for c in (*BOX, *CORNERS)), strict=True):
            out.append((page, band, label, float(p[max(y0 - top, 0) : max(y1 + 2 - top, 0), x0 : x1 + 2].sum())))
    return pd.DataFrame(out, columns=[*BOX, "sum"])


def boxes(bands: DataFrame, params: Params = Params()) -> DataFrame:
    """page_id, place, x0, y0, x1, y1 (last pixels), area and score of a page's components, as `detection.boxes` gives them of whole
    maps, and the map's width and height. Bands have two rows or more, but for a page's last one."""
    if not params.valid():
        raise ValueError(f"not valid: {params}")
    bands = written(bands.select("page_id", "band", "top", "width", F.floor(F.size("p") / F.col("width")).cast("int").alias("rows"), "p"), "bands")
    shape = bands.groupBy("page_id").agg(F.max("rows").alias("band_rows"), F.max(F.col("top") + F.col("rows")).alias("height"))
    shaped = bands.join(shape, "page_id")
    parts = written(_with_halo(shaped).groupBy("page_id", "band").applyInPandas(_parts(params.bin_thresh), PARTS), "parts")
    rows = parts.where("kind = 'rows'")
    below = rows.select("page_id", (F.col("band") - 1).alias("band"), F.col("first_row").alias("below"))
    borders = rows.select("page_id", "band", F.col("last_row").alias("above")).join(below, ["page_id", "band"])
    across = written(borders.mapInPandas(_across, "page_id long, kind string, a_band int, a int, b_band int, b int"), "borders")

    roots = components(across.where("kind = 'joined'").select(_node("a_band", "a").alias("a"), _node("b_band", "b").alias("b")))
    rooted = lambda df, c: df.join(roots.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
    open_ = rooted(parts.where("kind = 'ground' and border").select(_node("band", "label").alias("ground")), "ground").distinct()
    near = parts.where("kind = 'near'").select(_node("band", "label").alias("part"), _node("band", "other").alias("ground"))
    near = near.unionByName(across.where("kind = 'near'").select(_node("a_band", "a").alias("part"), _node("b_band", "b").alias("ground")))
    outer = rooted(rooted(near, "ground").join(open_, "ground", "left_semi").select("part"), "part").distinct()
    whole = rooted(parts.where("kind = 'part'").select("page_id", _node("band", "label").alias("part"), *CORNERS, "pixels", "border", F.struct("band", "label").alias("first")), "part")
    whole = whole.groupBy("page_id", "part").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("pixels").alias("area"), F.bool_or("border").alias("border"), F.min("first").alias("first"))
    seen = whole.join(outer.withColumn("outer", F.lit(True)), "part", "left").where((F.col("border") | F.coalesce("outer", F.lit(False))) & (F.col("x1") - F.col("x0") >= 2) & (F.col("y1") - F.col("y0") >= 2))
    found = written(seen.select("page_id", F.col("first.band").alias("first_band"), F.col("first.label").alias("first_label"), *CORNERS, "area"), "boxes")

    sized = found.join(bands.where("band = 0").select("page_id", "width").join(shape, "page_id"), "page_id")
    of = lambda row: F.floor(row / F.col("band_rows")).cast("int")
    asked = sized.select(*BOX, *CORNERS, F.explode(F.sequence(of(F.col("y0")), of(F.least(F.col("y1") + 1, F.col("height") - 1)))).alias("band"))
    sums = asked.groupBy("page_id", "band").cogroup(bands.groupBy("page_id", "band")).applyInPandas(_sums, "page_id long, first_band int, first_label int, sum double")
    total = sums.groupBy(*BOX).agg(F.sum("sum").alias("sum"))
    size = (F.least(F.col("x1") + 1, F.col("width") - 1) - F.col("x0") + 1) * (F.least(F.col("y1") + 1, F.col("height") - 1) - F.col("y0") + 1)
    scored = sized.join(total, BOX).withColumn("score", F.col("sum") / size).where(F.col("score").cast("float") >= F.lit(params.box_thresh).cast("float"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("first_band"), F.desc("first_label"))) - 1
    return scored.select("page_id", place.alias("place"), *CORNERS, "area", "score", F.col("width").alias("map_width"), F.col("height").alias("map_height"))


def words(bands: DataFrame, dims: DataFrame, scale: float, params: Params = Params()) -> DataFrame:
    """page_id, idx, a box in shares of the page and objectness of fused maps in bands, `scale` map pixels a page pixel: the map has no
    letterbox, so that nothing is un-padded; dims have the page's width and height. Boxes that become empty go."""
    found = boxes(bands, params)
    ends = detection.unclip(*(F.col(c) for c in CORNERS), params.unclip_ratio)
    share = {c: clamp(e / F.col("map_width" if c[0] == "x" else "map_height"), 0.0, 1.0) for c, e in zip(CORNERS, ends, strict=True)}
    placed = boxes_on_page(found.withColumns(share).join(dims, "page_id"), scale)
    return placed.select("page_id", F.col("place").alias("idx"), *CORNERS, F.col("score").alias("objectness"))
