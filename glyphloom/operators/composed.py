"""The whole run as one plan of several branches over one set of maps.

    maps and tile maps -> boxes, lost components, anchors          one pass, written
    boxes of the page + boxes of tiles -> words                    ownership and seams, written
    words -> crops, in parts where they are wide
    words -> other crops that their line or column gives them      within a budget a page
    lost components + anchors -> proposals -> recovered words      tiles first, apart from words, within a budget a page
    all crops -> readings                                          one pass of the recogniser
    readings -> texts, turned where that is surer; recovered words stay only if they are accepted

Maps and readings come from functions of batches, so that any model can stand behind them. What several branches read is
written once in the shared folder; the number of rows at each stage is observed while it is computed. Everything else is
joins on the page, or on cells of it.

A page without words has no rows, and its row in `pages`; a page without tiles keeps its own words, and so does one whose tiles have
none. Words whose crop is empty are left out. A null in `p` counts as no glyph. All boxes are in pixels of the page.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from glyphloom.functions.config import Settings
from glyphloom.functions.geometry import CORNERS, clamp
from glyphloom.operators import detection, lines, recognition, recovery, tiles
from glyphloom.operators.pipeline import Recogniser
from glyphloom.sources.shared import written

#: idx of words: those of the page from 0, of tile t from (t + 1) * TILE, recovered ones from RECOVERED on.
TILE, RECOVERED = 1_000_000, 1_000_000_000
WHOLE = -1
#: Columns of a crop that a recogniser sees; alt is 1 for other crops of a word, part counts them.
CROP = ("page_id", "idx", "alt", "part", "start", "rotation", "last", "x0", "y0", "width", "height")


@dataclass
class Run:
    """words: page_id, idx, source, a box, objectness, text, confidence, rotation (of the other crop that won, else null). counts are
    filled as stages are computed: those of the last one when `words` is read for the first time."""

    words: DataFrame
    observed: list[Observation] = field(default_factory=list)

    def counts(self) -> dict[str, int]:
        return {k: v for o in self.observed for k, v in o.get.items()}


def _on_page(rows: DataFrame, edges: tuple[Column, ...]) -> DataFrame:
    """Edges in pixels of a map as a box in pixels of the page: rows have side, the map's width, and the region that it shows."""
    share = [clamp(e / F.col("side"), 0.0, 1.0) for e in edges]
    ends = (*detection.unpad(share[0], share[1], F.col("rw"), F.col("rh")), *detection.unpad(share[2], share[3], F.col("rw"), F.col("rh")))
    box = {c: F.col("rx" if c[0] == "x" else "ry") + e * F.col("rw" if c[0] == "x" else "rh") for c, e in zip(CORNERS, ends, strict=True)}
    return rows.withColumns(box).where("x1 > x0 and y1 > y0")


def _words(found: DataFrame, ratio: float, dense_ratio: float) -> DataFrame:
    """page_id, tile, idx, a box on the page and objectness."""
    ends = zip(*(detection.unclip(*(F.col(c) for c in CORNERS), r) for r in (ratio, dense_ratio)), strict=True)
    edges = tuple(F.when(F.col("tile") == WHOLE, a).otherwise(b) for a, b in ends)
    idx = (F.col("tile") + 1).cast("long") * TILE + F.col("place")
    return _on_page(found.where("kind = 'box'"), edges).select("page_id", "tile", idx.alias("idx"), *CORNERS, F.col("score").alias("objectness"))


def _recovered(found: DataFrame, words: DataFrame, owners: DataFrame) -> DataFrame:
    """page_id, idx, a box and objectness of recovered words that are to be read."""
    ends = {"x1": F.col("x1") + 1, "y1": F.col("y1") + 1}
    of_map = found.withColumns({"page_id": F.struct("page_id", "tile"), **ends})
    things = recovery.thin(of_map.where("kind = 'lost'").select("page_id", F.col("place").alias("idx"), *CORNERS, "pixels", F.lit(False).alias("survives"), F.col("score").alias("objectness")))
    proposed = recovery.proposals(things, of_map.where("kind = 'anchor'").select("page_id", *CORNERS))
    regions = found.select("page_id", "tile", "side", "rx", "ry", "rw", "rh").distinct()
    rows = proposed.select("page_id.*", "idx", "objectness", *CORNERS).join(regions, ["page_id", "tile"])
    placed = written(_on_page(rows, tuple(F.col(c) for c in CORNERS)).select("page_id", "tile", "idx", "objectness", *CORNERS), "proposed")
    of_page, of_tiles = placed.where(F.col("tile") == WHOLE), placed.where(F.col("tile") != WHOLE)
    kept = of_page.unionByName(tiles.owned(of_tiles, owners).select(*placed.columns))
    rank = F.when(F.col("tile") == WHOLE, 1 << 30).otherwise(F.col("tile"))
    named = kept.select("page_id", (F.lit(RECOVERED) + (F.col("tile") + 1).cast("long") * TILE + F.col("idx")).alias("idx"), rank.alias("rank"), *CORNERS, "objectness")
    apart = tiles.apart(named, words, [F.col("rank"), -F.col("objectness")])
    size = lambda a, b: F.ceil(b) - F.floor(a) + 2
    costs = apart.withColumn("cost", size(F.col("x0"), F.col("x1")) * size(F.col("y0"), F.col("y1")))
    taken = tiles.budgeted(costs, recovery.MOST, by=F.struct(-F.col("objectness"), "rank"))
    return apart.join(taken, ["page_id", "idx"], "left_semi").select("page_id", "idx", *CORNERS, "objectness")


def _crops(words: DataFrame, dims: DataFrame) -> DataFrame:
    """Words with the rows and columns of their crop; empty ones are left out."""
    rect = recognition.pixel_rect(*(F.col(c) for c in CORNERS), F.col("page_width"), F.col("page_height"))
    sized = words.join(dims, "page_id").select("page_id", "idx", rect[0].alias("x0"), rect[1].alias("y0"), (rect[2] - rect[0]).alias("width"), (rect[3] - rect[1]).alias("height"))
    return sized.where("width > 0 and height > 0").withColumn("starts", recognition.split_starts(F.col("width"), F.col("height")))


def _parts(crops: DataFrame) -> DataFrame:
    last = recognition.last_overlap(F.col("starts"), F.col("width"), F.col("height"))
    rows = crops.select("*", last.alias("last"), F.posexplode("starts").alias("part", "start"))
    return rows.withColumns({"alt": F.lit(0), "rotation": F.lit(0)}).select(*CROP)


def _others(words: DataFrame, crops: DataFrame, dims: DataFrame) -> DataFrame:
    asked = words.select("page_id", "idx", *CORNERS).join(crops.select("page_id", "idx", F.size("starts").alias("parts")), ["page_id", "idx"])
    found = lines.alternatives(asked, dims.select("page_id", F.col("page_width").alias("width"), F.col("page_height").alias("height")))
    named = {"alt": F.lit(1), "part": F.col("rotation"), "start": F.lit(0), "last": F.lit(0.0), "width": F.col("x1") - F.col("x0"), "height": F.col("y1") - F.col("y0")}
    return found.withColumns(named).select(*CROP)


def _read(crops: DataFrame, recogniser: Recogniser, batch: int) -> DataFrame:
    """All readings of a word: page_id, idx, parts and others in order."""
    out = ["page_id", "idx", "alt", "part", "rotation", "last", "text", "confidence"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), batch):
                yield recogniser(b.iloc[i : i + batch])[out]

    read = crops.mapInPandas(run, "page_id long, idx long, alt int, part int, rotation int, last double, text string, confidence double")
    of = lambda alt: F.array_sort(F.collect_list(F.when(F.col("alt") == alt, F.struct("part", "rotation", "text", "confidence"))))
    return read.groupBy("page_id", "idx").agg(of(0).alias("parts"), of(1).alias("others"), F.max("last").alias("last"))


def run(maps: DataFrame, tile_regions: DataFrame, tile_maps: DataFrame, recogniser: Recogniser, settings: Settings = Settings(), dense: detection.Params = detection.Params()) -> Run:
    """maps: page_id, width, p, page_width, page_height. tile_regions: page_id, tile (from 0), x0, y0, x1, y1, owner_start, owner_end.
    tile_maps: page_id, tile, width, p, with thresholds of their own (`dense`). settings say whether tiles are used (dense_refinement),
    thin glyphs recovered (thin_recovery) and lines asked for other crops (line_guided)."""
    checked = settings.checked()
    params = detection.Params(checked.bin_thresh, checked.box_thresh, checked.unclip_ratio)
    dims = maps.select("page_id", "page_width", "page_height")
    whole = maps.select("page_id", F.lit(WHOLE).alias("tile"), "width", "p")
    regions = dims.select("page_id", F.lit(WHOLE).alias("tile"), F.lit(0).alias("rx"), F.lit(0).alias("ry"), F.col("page_width").alias("rw"), F.col("page_height").alias("rh"))
    if checked.dense_refinement:
        whole = whole.unionByName(tile_maps.select("page_id", "tile", "width", "p"))
        regions = regions.unionByName(tile_regions.select("page_id", "tile", F.col("x0").alias("rx"), F.col("y0").alias("ry"), (F.col("x1") - F.col("x0")).alias("rw"), (F.col("y1") - F.col("y0")).alias("rh")))
    seen = [Observation(k) for k in ("found", "placed", "read", "kept")]

    of = lambda kind, where=True: F.count_if((F.col("kind") == kind) & where)
    on_page = F.col("tile") == WHOLE
    found = detection.found(whole, params, dense, checked.thin_recovery).join(regions, ["page_id", "tile"])
    found = written(found.observe(seen[0], of("box", on_page).alias("page_boxes"), of("box", ~on_page).alias("tile_boxes"), of("lost").alias("lost"), of("anchor").alias("anchors")), "found")

    # Written, the long expressions of a box are not worked out again inside of each condition on it.
    each = written(_words(found, checked.unclip_ratio, dense.unclip_ratio), "each")
    base = each.where(on_page).drop("tile")
    if checked.dense_refinement:
        words = tiles.merge_with_seams(base, each.where(~on_page), tile_regions)
    else:
        words = base.withColumn("from_tile", F.lit(False))
    words = written(words.observe(seen[1], F.count("*").alias("words"), F.count_if("from_tile").alias("words_of_tiles")), "words")

    crops = _crops(words, dims)
    rows = _parts(crops)
    if checked.line_guided:
        rows = rows.unionByName(_others(words, crops, dims))
    every = words.select("page_id", "idx", F.when(F.col("from_tile"), "tile").otherwise("page").alias("source"), *CORNERS, "objectness")
    if checked.thin_recovery:
        recovered = written(_recovered(found, words, tile_regions), "recovered")
        rows = rows.unionByName(_parts(_crops(recovered, dims)))
        every = every.unionByName(recovered.withColumn("source", F.lit("recovered")).select(*every.columns))
    counted = rows.observe(seen[2], F.count("*").alias("crops"), F.count_if(F.col("alt") == 1).alias("other_crops"), F.count_if(F.col("idx") >= RECOVERED).alias("recovery_crops"))

    read = _read(counted, recogniser, checked.recognition_batch)
    mean = F.aggregate("parts", F.lit(0.0), lambda a, r: a + r["confidence"]) / F.size("parts")
    told = read.select("page_id", "idx", "others", recognition.merged(F.col("parts.text"), F.col("last")).alias("own"), mean.alias("mean"))
    told = told.withColumn("won", recognition.chosen_rotation(F.col("mean"), F.col("others")))
    other = F.get(F.filter("others", lambda o: o["rotation"] == F.col("won")["rotation"]), 0)["text"]
    told = told.select("page_id", "idx", F.coalesce(other, F.col("own")).alias("text"), F.col("won.confidence").alias("confidence"), F.col("won.rotation").alias("rotation"))
    done = every.join(told, ["page_id", "idx"]).where((F.col("source") != "recovered") | recognition.accepted(F.col("text"), F.col("confidence")))
    done = done.observe(seen[3], F.count("*").alias("kept"), F.count_if(F.col("rotation").isNotNull()).alias("turned_or_widened"), F.count_if(F.col("source") == "recovered").alias("recovered"))
    return Run(done, seen)


def pages(maps: DataFrame, words: DataFrame) -> DataFrame:
    """One row a page: its words in order of idx (tiles' after the page's, recovered ones last), none for blank pages."""
    each = words.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(*(c for c in words.columns if c != "page_id")))).alias("words"))
    return maps.select("page_id").join(each, "page_id", "left")
