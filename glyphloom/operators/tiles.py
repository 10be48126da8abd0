"""Tiles of a page: dense bands, windows, ownership of words, seams, and greedy choices within a page."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.functions.geometry import CORNERS
from glyphloom.operators.matching import overlapping, with_iou
from glyphloom.operators.series import islands

BIN = 64
LEAST_IN_BIN = 20
SMALL_HEIGHT = 9
MARGIN = 24


def dense_bins(words: DataFrame, dims: DataFrame, size: int) -> DataFrame:
    """Bins of 64 rows with 20 small words or more: page_id, bin, n, y0, y1 and the page's height."""
    bins = words.groupBy("page_id", F.floor((F.col("y0") + F.floor((F.col("y1") - F.col("y0")) / 2)) / BIN).alias("bin"))
    found = bins.agg(F.count("*").alias("n"), F.median(F.col("y1") - F.col("y0")).alias("median"), F.min("y0").alias("y0"), F.max("y1").alias("y1")).where(F.col("n") >= LEAST_IN_BIN)
    joined = found.join(dims, "page_id").where(F.col("median") * size / F.greatest("width", "height", F.lit(1)) < SMALL_HEIGHT)
    return joined.select("page_id", "bin", "n", "y0", "y1", "height")


def dense_bands(bins: DataFrame, share: int = 4) -> DataFrame:
    """The heaviest run of consecutive bins of each page (the last of equal ones), MARGIN wider; none if over a share of the page."""
    runs = islands(bins, ["page_id"], "bin").groupBy("page_id", "height", "island").agg(F.sum("n").alias("n"), F.max("bin").alias("last"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    best = runs.groupBy("page_id", "height").agg(F.max(F.struct("n", "last", "y0", "y1")).alias("b"))
    band = best.select("page_id", "height", "b.n", F.greatest(F.col("b.y0") - MARGIN, F.lit(0)).alias("y0"), F.least(F.col("b.y1") + MARGIN, F.col("height")).alias("y1"))
    return band.where(F.col("y1") - F.col("y0") <= F.floor(F.col("height") / share)).drop("height")


def windows(dims: DataFrame, long_side: int, overlap: float, shift: float = 0.0, tile: int = 1024) -> DataFrame:
    """Square windows of a page scaled to `long_side`, in page pixels: page_id, x, y, side."""
    largest = F.greatest("width", "height")
    side = F.greatest(F.rint(largest * tile / long_side), F.lit(1.0))
    stride = F.greatest(F.rint(side * (1 - overlap)), F.lit(1.0))
    offset = F.rint(stride * shift)
    starts = lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil((n + offset) / stride).cast("int") - 1, F.lit(0))), lambda k: (k * stride - offset).cast("int"))
    rows = dims.where((F.col("width") > 0) & (F.col("height") > 0)).select("page_id", side.cast("int").alias("side"), starts(F.col("width")).alias("xs"), F.explode(starts(F.col("height"))).alias("y"))
    return rows.select("page_id", F.explode("xs").alias("x"), "y", "side")


def halves(dims: DataFrame, overlap: int = 4) -> DataFrame:
    """Two tiles of a page side by side that overlap by some per cent of the width; each owns the words of its half."""
    half, more = F.floor(F.col("width") / 2).cast("int"), F.floor(F.col("width") * overlap / 100).cast("int")
    left = F.struct(F.lit(0).alias("tile"), F.lit(0).alias("x0"), F.least(half + more, F.col("width")).alias("x1"), F.lit(0).alias("owner_start"), half.alias("owner_end"))
    right = F.struct(F.lit(1).alias("tile"), F.greatest(half - more, F.lit(0)).alias("x0"), F.col("width").alias("x1"), half.alias("owner_start"), F.col("width").alias("owner_end"))
    return dims.select("page_id", F.explode(F.array(left, right)).alias("t"), F.lit(0).alias("y0"), F.col("height").alias("y1")).select("page_id", "t.*", "y0", "y1")


def owned(words: DataFrame, tiles: DataFrame) -> DataFrame:
    """Words with the tile that owns their centre: half open in x, closed in y. Tiles of a page are few."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    t = tiles.select("page_id", F.col("tile").alias("owner"), "owner_start", "owner_end", F.col("y0").alias("t0"), F.col("y1").alias("t1"))
    return words.join(t, "page_id").where((cx >= F.col("owner_start")) & (cx < F.col("owner_end")) & (cy >= F.col("t0")) & (cy <= F.col("t1")))


def merge_owned(base: DataFrame, tile_words: DataFrame, tiles: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Words of the page, and where a tile has words that it owns, these in place of the page's that it owns. tile_words have a tile;
    `seen` are all words of the tiles, if some were taken out: they still say which tiles have words."""
    mine = owned(tile_words if seen is None else seen, tiles).where(F.col("owner") == F.col("tile"))
    busy = mine.select("page_id", "owner").distinct()
    replaced = owned(base, tiles).join(busy, ["page_id", "owner"], "left_semi").select("page_id", "idx")
    kept = base.join(replaced, ["page_id", "idx"], "left_anti").withColumn("from_tile", F.lit(False))
    own = owned(tile_words, tiles).where(F.col("owner") == F.col("tile")).select(*base.columns).withColumn("from_tile", F.lit(True))
    return kept.unionByName(own)


def seam_pairs(left: DataFrame, right: DataFrame, tiles: DataFrame, least: float = 0.5) -> DataFrame:
    """Words of two neighbouring tiles that both stand on the seam between them and overlap: page_id, l_idx, r_idx, iou and which one wins."""
    seam = tiles.where("tile = 0").select("page_id", F.col("owner_end").alias("seam"))
    pairs = with_iou(overlapping(left, right)).join(seam, "page_id").where(F.col("iou") >= least)
    on = pairs.where((F.col("l_x0") <= F.col("seam")) & (F.col("l_x1") >= F.col("seam")) & (F.col("r_x0") <= F.col("seam")) & (F.col("r_x1") >= F.col("seam")))
    return on.select("page_id", "l_idx", "r_idx", "iou", F.when(F.col("l_objectness") >= F.col("r_objectness"), "left").otherwise("right").alias("winner"))


def edge_flags(words: DataFrame, tiles: DataFrame) -> DataFrame:
    """page_id, idx, crosses (an edge of a tile inside the page runs through the word) and intact (some tile shows all of it)."""
    t = tiles.select("page_id", F.col("x0").alias("t0"), F.col("x1").alias("t1"), F.max("x1").over(Window.partitionBy("page_id")).alias("end"))
    cut = lambda edge: (F.col("x0") < edge) & (F.col("x1") > edge)
    crosses = ((F.col("t0") > 0) & cut(F.col("t0"))) | ((F.col("t1") < F.col("end")) & cut(F.col("t1")))
    return words.join(t, "page_id").groupBy("page_id", "idx").agg(F.bool_or(crosses).alias("crosses"), F.bool_or((F.col("x0") >= F.col("t0")) & (F.col("x1") <= F.col("t1"))).alias("intact"))


def free_of_others(crops: DataFrame, boxes: DataFrame) -> DataFrame:
    """Crops (page_id, idx, a box) into which no box of another idx reaches."""
    met = overlapping(crops, boxes).where("l_idx != r_idx").select("page_id", F.col("l_idx").alias("idx")).distinct()
    return crops.join(met, ["page_id", "idx"], "left_anti")


def budgeted(words: DataFrame, most: int = 32, pixels: int = 1_000_000, by: Column | None = None, crops: str | None = None) -> DataFrame:
    """page_id, idx of words taken in order until `most` crops; one that passes what is left is skipped, and the next one tried.

    The order is that of `by`, of the highest objectness without it, then of idx; a word has a cost in pixels, and as many crops
    as the column `crops` says, one without it. The fold runs over one array a page, of numbers alone. Pages without words
    have no row; a null cost is never taken."""
    order = -F.col("objectness") if by is None else by
    each = F.struct(order.alias("order"), "idx", F.col("cost").cast("long").alias("cost"), (F.col(crops) if crops else F.lit(1)).alias("crops"))
    rows = words.where(F.col("cost").isNotNull()).groupBy("page_id").agg(F.array_sort(F.collect_list(each)).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.array().cast("array<bigint>").alias("taken"))

    def step(s: Column, w: Column) -> Column:
        fits = (s["n"] + w["crops"] <= most) & (s["used"] + w["cost"] <= pixels)
        return F.struct(
            F.when(fits, s["used"] + w["cost"]).otherwise(s["used"]).alias("used"),
            F.when(fits, s["n"] + w["crops"]).otherwise(s["n"]).cast("int").alias("n"),
            F.when(fits, F.array_append(s["taken"], w["idx"].cast("long"))).otherwise(s["taken"]).alias("taken"),
        )

    return rows.select("page_id", F.explode(F.aggregate("rows", start, step)["taken"]).alias("idx"))


def _rivals(boxes: DataFrame, least: float) -> DataFrame:
    """Pairs of boxes (page_id, idx, order, a box) that overlap by an IoU of `least`, or at all if it is 0: page_id, idx and order of
    one, and rival, the idx of another that comes before it in order."""
    met = with_iou(overlapping(boxes, boxes)).where((F.col("iou") >= least) & (F.col("r_order") < F.col("l_order")))
    return met.select("page_id", F.col("l_idx").alias("idx"), F.col("l_order").alias("order"), F.col("r_idx").alias("rival"))


def lost(rivals: DataFrame) -> DataFrame:
    """page_id, idx of words that go when words are taken in order, each unless a rival of it was: rivals(page_id, idx, order, rival).

    Only words with rivals are read in order, a page at a time; one without is always taken. What goes is kept, not what stays."""
    by_word = rivals.groupBy("page_id", "idx", "order").agg(F.collect_list("rival").alias("rivals"))
    rows = by_word.repartition("page_id").sortWithinPartitions("page_id", "order").select("page_id", "idx", "rivals")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, gone = None, set()
        for b in batches:
            goes = []
            for p, idx, those in zip(b["page_id"], b["idx"], b["rivals"], strict=True):
                if p != page:
                    page, gone = p, set()
                goes.append(not gone.issuperset(those))
                if goes[-1]:
                    gone.add(idx)
            yield b.loc[goes, ["page_id", "idx"]]

    return rows.mapInPandas(run, rows.select("page_id", "idx").schema)


def suppressed(words: DataFrame, least: float = 0.5) -> DataFrame:
    """Greedy choice of words by edge margin, then objectness, the highest first, then idx, which tells the words of a page
    apart: one that overlaps a chosen one by IoU of `least` goes. A null margin or objectness comes last."""
    down = lambda c: F.coalesce(-F.col(c).cast("double"), F.lit(float("inf"))).alias(c)
    boxes = words.select("page_id", "idx", F.struct(down("edge_margin"), down("objectness"), "idx").alias("order"), *CORNERS)
    return words.join(lost(_rivals(boxes, least)), ["page_id", "idx"], "left_anti")


def apart(words: DataFrame, others: DataFrame, order: list[Column]) -> DataFrame:
    """words, in order, then by idx, that overlap none of `others` and none of the words taken before them; idx tells the words
    of a page apart. Words without an area are left out, and meet nobody."""
    solid = words.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    met = overlapping(solid.select("page_id", "idx", *CORNERS), others.select("page_id", *CORNERS)).select("page_id", F.col("l_idx").alias("idx")).distinct()
    left = solid.join(met, ["page_id", "idx"], "left_anti")
    boxes = left.select("page_id", "idx", F.struct(*(c.alias(f"by_{i}") for i, c in enumerate(order)), "idx").alias("order"), *CORNERS)
    return left.join(lost(_rivals(boxes, 0.0)), ["page_id", "idx"], "left_anti")


def small_parts(components: DataFrame, dims: DataFrame) -> DataFrame:
    """Components (page_id, a box with ends exclusive, pixels) that small print is made of: three pixels and three rows or more,
    no more than 0.04 of the page either way, no more than twelve times as high as wide."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    fits = (F.col("pixels") >= 3) & (h >= 3) & (h <= F.col("height") * 0.04) & (w <= F.col("width") * 0.04) & (h <= 12 * w)
    return components.join(dims.select("page_id", "width", "height"), "page_id").where(fits).select(*components.columns)


def merge_with_seams(base: DataFrame, tile_words: DataFrame, tiles: DataFrame, least: float = 0.5) -> DataFrame:
    """merge_owned, and where two tiles of a page that share a seam (one ends owning where a later one begins) both see one word on
    it: if both own it, the less sure one goes; if neither does, the surer one is taken in, unless it overlaps what is there already
    or another one taken before it, in order of the pairs.

    base has page_id, idx, a box and objectness; tile_words also their tile. Result: the columns of base and from_tile."""
    owners = tiles.select("page_id", "tile", "owner_start", "owner_end")
    seen = tile_words.select("page_id", "tile", "idx", *CORNERS, "objectness").join(owners, ["page_id", "tile"])
    pairs = with_iou(overlapping(seen, seen)).where((F.col("l_tile") < F.col("r_tile")) & (F.col("l_owner_end") == F.col("r_owner_start")) & (F.col("iou") >= least))
    on = lambda p: (F.col(p + "x0") <= F.col("l_owner_end")) & (F.col(p + "x1") >= F.col("l_owner_end"))
    pairs = pairs.where(on("l_") & on("r_"))
    middle = lambda p: (F.col(p + "x0") + F.col(p + "x1")) / 2
    owns = lambda p: (middle(p) >= F.col(p + "owner_start")) & (middle(p) < F.col(p + "owner_end"))
    left_wins = F.col("l_objectness") >= F.col("r_objectness")
    side = lambda left: [F.when(left, F.col("l_" + c)).otherwise(F.col("r_" + c)).alias(c) for c in ("tile", "idx", *CORNERS, "objectness")]
    lost = pairs.where(owns("l_") & owns("r_")).select("page_id", *side(~left_wins)[:2]).distinct()
    merged = merge_owned(base, tile_words.join(lost, ["page_id", "tile", "idx"], "left_anti"), tiles, tile_words)
    order = F.struct("l_tile", "r_tile", "l_idx", "r_idx")
    spare = pairs.where(~owns("l_") & ~owns("r_")).select("page_id", order.alias("order"), *side(left_wins))
    # A word may win over several others; its first pair counts.
    spare = spare.groupBy("page_id", "idx", *CORNERS, "objectness").agg(F.min("order").alias("order"))
    taken = apart(spare, merged, [F.col("order")]).withColumn("from_tile", F.lit(True))
    return merged.unionByName(taken.select(*merged.columns))


def mapped_words(words: DataFrame, dims: DataFrame) -> DataFrame:
    """Words in the pixels of a window (page_id, idx, x, y, side, a box) on their page: clipped, those with a middle off the page
    left out, with the least distance to an edge of the window inside the page as a share of its side (1 where there is none)."""
    rows = words.join(dims, "page_id").withColumns({"px0": F.col("x0") + F.col("x"), "px1": F.col("x1") + F.col("x"), "py0": F.col("y0") + F.col("y"), "py1": F.col("y1") + F.col("y")})
    cx, cy = (F.col("px0") + F.col("px1")) / 2, (F.col("py0") + F.col("py1")) / 2
    far = F.array(
        F.when(F.col("x") > 0, F.col("x0")), F.when(F.col("y") > 0, F.col("y0")),
        F.when(F.col("x") + F.col("side") < F.col("width"), F.col("side") - F.col("x1")), F.when(F.col("y") + F.col("side") < F.col("height"), F.col("side") - F.col("y1")),
    )
    margin = F.coalesce(F.array_min(F.filter(far, lambda v: v.isNotNull())), F.col("side")) / F.col("side")
    clip = lambda v, most: F.least(F.greatest(v, F.lit(0)), F.col(most))
    inside = (cx >= 0) & (cx < F.col("width")) & (cy >= 0) & (cy < F.col("height"))
    return rows.where(inside).select("page_id", "idx", clip(F.col("px0"), "width").alias("x0"), clip(F.col("py0"), "height").alias("y0"), clip(F.col("px1"), "width").alias("x1"), clip(F.col("py1"), "height").alias("y1"), margin.alias("edge_margin"))


def delegated(words: DataFrame, tiles: DataFrame, close: float = 8 / 1024, enough: float = 16 / 1024) -> DataFrame:
    """Words of tiles (tile, a box, edge_margin) without those near an edge of their tile that another tile shows with enough around them."""
    t = tiles.select("page_id", F.col("tile").alias("other"), F.col("x0").alias("t0"), F.col("x1").alias("t1"))
    need = enough * (F.col("t1") - F.col("t0"))
    better = words.where(F.col("edge_margin") <= close).join(t, "page_id").where((F.col("tile") != F.col("other")) & (F.col("x0") - F.col("t0") >= need) & (F.col("t1") - F.col("x1") >= need))
    return words.join(better.select("page_id", "tile", "idx").distinct(), ["page_id", "tile", "idx"], "left_anti")
