"""Lines of words: peers of a word on its line or column, and other crops of words that their peers give a direction to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.geometry import CORNERS
from glyphloom.operators.tiles import budgeted, free_of_others

#: Along and across a line, in lengths of the peer's short side; how long a peer is; shares of its short side.
REACH = 6
ACROSS, DOWN = (1.3, 0.45, 0.35, 1.8), (1.6, 0.4, 0.5, 1.8)
MOST_CROPS, MOST_PIXELS = 32, 1_000_000


#: Width and height of a cell in which boxes meet the peers of their line; of a column it is turned.
CELL = (128, 32)


def _met(boxes: DataFrame, kinds: tuple[bool, ...]) -> DataFrame:
    """Pairs of a box and a peer, for each kind (False: line, True: column): page_id, idx, peer, vertical and the peer's box.

    A box's middle lies in one cell of each kind, a peer reaches over some, so that a pair meets once; both kinds meet in one join."""
    middle = lambda lo, hi: (F.col(lo) + F.col(hi)) / 2
    points, reaches = [], []
    for vertical in kinds:
        u0, u1, v0, v1 = ("y0", "y1", "x0", "x1") if vertical else ("x0", "x1", "y0", "y1")
        long, near, _, _ = DOWN if vertical else ACROSS
        u, v, t = middle(u0, u1), middle(v0, v1), F.col(v1) - F.col(v0)
        cell = lambda at, k: F.floor(at / CELL[k])
        over = lambda at, far, k: F.explode(F.sequence(cell(at - far, k), cell(at + far, k)))
        own = ["page_id", "idx", F.lit(vertical).alias("vertical"), t.alias("t"), u.alias("u"), v.alias("v")]
        points.append(boxes.select(*own, cell(u, 0).alias("cu"), cell(v, 1).alias("cv")))
        those = boxes.where((F.col(u1) - F.col(u0) >= long * t) & (t > 0)).select(*own, *CORNERS)
        reach = those.select("*", over(F.col("u"), REACH * F.col("t"), 0).alias("cu"))
        reaches.append(reach.select("*", over(F.col("v"), near * F.col("t"), 1).alias("cv")))
    union = lambda rows: rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    named = lambda rows, side: rows.select(F.xxhash64("page_id", "vertical", "cu", "cv").alias("cell"), *(F.col(c).alias(side + c) for c in rows.columns))
    both = named(union(points), "l_").join(named(union(reaches), "r_"), "cell")
    same_cell = F.lit(True)
    for c in ("page_id", "vertical", "cu", "cv"):
        same_cell &= F.col("l_" + c) == F.col("r_" + c)
    limit = lambda k: F.when(F.col("r_vertical"), DOWN[k]).otherwise(ACROSS[k])
    close = (F.abs(F.col("l_v") - F.col("r_v")) < limit(1) * F.col("r_t")) & (F.abs(F.col("l_u") - F.col("r_u")) < REACH * F.col("r_t"))
    ratio = F.col("l_t") / F.col("r_t")
    found = both.where(same_cell & (F.col("l_idx") != F.col("r_idx")) & close & (ratio > limit(2)) & (ratio < limit(3)))
    return found.select(F.col("l_page_id").alias("page_id"), F.col("l_idx").alias("idx"), F.col("r_idx").alias("peer"), F.col("r_vertical").alias("vertical"), *(F.col("r_" + c).alias(c) for c in CORNERS))


def peers(boxes: DataFrame, vertical: bool = False) -> DataFrame:
    """Pairs of a box and a peer of its line, or of its column: page_id, idx, peer, and the peer's box.

    A peer is long along its line, the other box's middle lies close to the peer's middle across it and not far along it, and
    both are about as thick. Equal boxes are peers if they have different idx; boxes without an area are nobody's. A box with a
    null in its corners has no peers; without boxes there are no rows."""
    return _met(boxes, (vertical,)).drop("vertical")


def around(boxes: DataFrame) -> DataFrame:
    """Boxes that have peers: page_id, idx, `beside` and `above`, how many on their line and in their column, and the upper
    medians of the line's tops and bottoms, null without any."""
    line = lambda c: F.when(~F.col("vertical"), F.col(c))
    lists = [F.collect_list(line(c)).alias(c) for c in ("y0", "y1")]
    found = _met(boxes, (False, True)).groupBy("page_id", "idx").agg(F.count_if(~F.col("vertical")).alias("beside"), F.count_if("vertical").alias("above"), *lists)
    upper = lambda c: F.get(F.array_sort(c), F.expr("int(beside div 2)"))
    return found.select("page_id", "idx", "beside", upper("y0").alias("top"), upper("y1").alias("bottom"), "above")


def alternatives(words: DataFrame, dims: DataFrame, most: int = MOST_CROPS, pixels: int = MOST_PIXELS) -> DataFrame:
    """Other crops of words, within a budget a page: page_id, idx, evidence, rotation and a box in pixels.

    words have page_id, idx, a box in pixels and `parts`, in how many crops they are read; only words of one are asked. A
    narrow word with two peers on its line or more gets a crop of its line's height, the upper medians of the peers' tops and bottoms, if
    no other word reaches into it. A high word with fewer, and with two peers in its column or more, is turned both ways. Words are
    taken in order of idx while crops and pixels last; one that passes what is left is skipped. A page without words, or
    without dims, has no row."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    asked = words.where("parts = 1").join(around(words), ["page_id", "idx"], "left").na.fill(0, ["beside", "above"]).join(dims, "page_id")
    margin = 0.15 * h
    context = asked.where((F.col("beside") >= 2) & (w < 0.8 * h)).select(
        "page_id",
        "idx",
        F.greatest(F.floor(F.col("x0") - margin), F.lit(0)).cast("int").alias("x0"),
        F.greatest(F.floor(F.least("top", "y0")), F.lit(0)).cast("int").alias("y0"),
        F.least(F.ceil(F.col("x1") + margin), F.col("width")).cast("int").alias("x1"),
        F.least(F.ceil(F.greatest("bottom", "y1")), F.col("height")).cast("int").alias("y1"),
    )
    context = free_of_others(context.where("x1 > x0 and y1 > y0"), words.select("page_id", "idx", "x0", "y0", "x1", "y1"))
    turned = asked.where((F.col("beside") < 2) & (F.col("above") >= 2) & (h > 1.8 * w))
    rect = lambda c, up, most_: F.least(F.rint(c).cast("int") + (1 if up else 0), F.col(most_).cast("int"))
    turned = turned.select("page_id", "idx", rect("x0", False, "width").alias("x0"), rect("y0", False, "height").alias("y0"), rect("x1", True, "width").alias("x1"), rect("y1", True, "height").alias("y1"))
    kinds = context.withColumns({"evidence": F.lit("horizontal_line_context"), "crops": F.lit(1)}).unionByName(turned.withColumns({"evidence": F.lit("vertical_line_neighbours"), "crops": F.lit(2)}))
    costs = kinds.withColumn("cost", F.col("crops") * (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    taken = budgeted(costs, most, pixels, F.lit(0), "crops")
    rotation = F.when(F.col("crops") == 1, F.array(F.lit(0))).otherwise(F.array(F.lit(90), F.lit(270)))
    return costs.join(taken, ["page_id", "idx"], "left_semi").select("page_id", "idx", "evidence", F.explode(rotation).alias("rotation"), "x0", "y0", "x1", "y1")
