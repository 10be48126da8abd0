"""What a model is shown: regions of pages cut out, resized with their aspect kept, padded and normalised.

Pixels lie in packed rows (page_id, y, and an array for each of r, g and b); a region's row is a slice of them. A resize is two weighted
sums: over the columns of a row, by slices and arrays of weights, then over rows, by a join with the table of weights. Both weights are
those of a triangle that widens with the scale, so that no pixel is skipped when a page shrinks. Rows, weights and grids are exploded, so that
the planner takes them for small: joins are merge joins, none is broadcast.

Regions without pixels, or without an area, have no rows; equal regions of a page need different tiles; a null channel of a pixel counts as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANNELS = ("r", "g", "b")


def packed_rows(pixels: DataFrame) -> DataFrame:
    """Rows of pixels (page_id, y, x, r, g, b) as arrays in order of x, which has no gaps."""
    rows = pixels.groupBy("page_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in CHANNELS)))).alias("row"))
    return rows.select("page_id", "y", *(F.col("row")[c].alias(c) for c in CHANNELS))


def weights(size: Column, out: Column) -> Column:
    """For each of `out` places: at, the first of `size` places that it takes from, and their weights w, which sum to 1."""
    scale = size / out
    support = F.greatest(scale, F.lit(1.0))

    def place(o: Column) -> Column:
        centre = (o + 0.5) * scale
        first = F.greatest((centre - support + 0.5).cast("int"), F.lit(0))
        end = F.least((centre + support + 0.5).cast("int"), size.cast("int"))
        raw = F.transform(F.sequence(first, end - 1), lambda j: F.greatest(1 - F.abs((j + 0.5 - centre) / support), F.lit(0.0)))
        total = F.aggregate(raw, F.lit(0.0), lambda a, w: a + w)
        return F.struct(first.alias("at"), F.transform(raw, lambda w: w / total).alias("w"))

    return F.transform(F.sequence(F.lit(0), out.cast("int") - 1), place)


def fitted(regions: DataFrame, height: int, width: int, symmetric: bool) -> DataFrame:
    """regions (page_id, tile, x0, y0, x1, y1) with w and h, the size rw and rh that they get, and where they begin: left and top."""
    sized = regions.withColumns({"w": F.col("x1") - F.col("x0"), "h": F.col("y1") - F.col("y0")}).where("w > 0 and h > 0")
    ratio = F.col("h") / F.col("w")
    tall = ratio > height / width
    rw = F.when(tall, F.greatest((height / ratio).cast("int"), F.lit(1))).otherwise(width)
    rh = F.when(tall, height).otherwise(F.greatest((width * ratio).cast("int"), F.lit(1)))
    sized = sized.withColumns({"rw": rw, "rh": rh})
    half = lambda n, c: F.ceil((n - F.col(c)) / 2).cast("int") if symmetric else F.lit(0)
    return sized.withColumns({"left": half(width, "rw"), "top": half(height, "rh")})


def resized(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """page_id, tile, y, x and the channels of fitted regions as whole numbers, rounded half to even; sums are held to a millionth,
    so that halves are halves in any order of adding."""
    cut = rows.hint("merge").join(regions, "page_id").where((F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")))
    across = cut.withColumn("wx", weights(F.col("w"), F.col("rw")))
    summed = lambda c: F.transform("wx", lambda o: F.aggregate(F.zip_with(F.slice(c, F.col("x0") + o["at"] + 1, F.size(o["w"])), o["w"], lambda v, w: v * w), F.lit(0.0), lambda a, v: a + v)).alias(c)
    across = across.select("page_id", "tile", (F.col("y") - F.col("y0")).alias("s"), *(summed(c) for c in CHANNELS))
    down = regions.select("page_id", "tile", F.posexplode(weights(F.col("h"), F.col("rh"))).alias("y", "o"))
    down = down.select("page_id", "tile", "y", F.col("o.at").alias("at"), F.posexplode("o.w").alias("k", "weight")).withColumn("s", F.col("at") + F.col("k"))
    met = across.hint("merge").join(down.select("page_id", "tile", "y", "s", "weight"), ["page_id", "tile", "s"])
    each = met.select("page_id", "tile", "y", "weight", F.posexplode(F.arrays_zip(*CHANNELS)).alias("x", "v"))
    byte = lambda c: F.least(F.greatest(F.rint(F.round(F.sum(F.col("v")[c] * F.col("weight")), 6)), F.lit(0.0)), F.lit(255.0)).cast("int").alias(c)
    return each.groupBy("page_id", "tile", "y", "x").agg(*(byte(c) for c in CHANNELS))


def prepared(rows: DataFrame, regions: DataFrame, height: int, width: int, mean: list[float], std: list[float], symmetric: bool = True) -> DataFrame:
    """page_id, tile, channel, y, x, value: tensors of height x width of the regions, normalised, with black where they don't reach."""
    fits = fitted(regions, height, width, symmetric)
    seen = resized(rows, fits).hint("merge").join(fits.select("page_id", "tile", "left", "top"), ["page_id", "tile"])
    seen = seen.select("page_id", "tile", (F.col("y") + F.col("top")).cast("int").alias("y"), (F.col("x") + F.col("left")).cast("int").alias("x"), *CHANNELS)
    side = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grid = fits.hint("merge").join(rows.select("page_id").distinct(), "page_id", "left_semi").select("page_id", "tile", side(height).alias("y")).select("page_id", "tile", "y", side(width).alias("x"))
    full = grid.hint("merge").join(seen, ["page_id", "tile", "y", "x"], "left")
    value = lambda i, c: (F.coalesce(F.col(c), F.lit(0)) / 255.0 - mean[i]) / std[i]
    channels = F.array(*(F.struct(F.lit(i).alias("channel"), value(i, c).alias("value")) for i, c in enumerate(CHANNELS)))
    return full.select("page_id", "tile", "y", "x", F.explode(channels).alias("c")).select("page_id", "tile", "c.channel", "y", "x", "c.value")


def quarter_turned(pixels: DataFrame, dims: DataFrame) -> DataFrame:
    """Pixels (page_id, y, x, ...) of pages put right, which are turned clockwise by `quarter` (0, 90, 180 or 270 degrees, in dims with
    width and height); no pixel is lost. Pages without dims have no rows."""
    rows = pixels.join(dims.select("page_id", "width", "height", "quarter"), "page_id")
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    new_y = F.when(F.col("quarter") == 90, w - 1 - x).when(F.col("quarter") == 180, h - 1 - y).when(F.col("quarter") == 270, x).otherwise(y)
    new_x = F.when(F.col("quarter") == 90, y).when(F.col("quarter") == 180, w - 1 - x).when(F.col("quarter") == 270, h - 1 - y).otherwise(x)
    others = [c for c in pixels.columns if c not in ("page_id", "y", "x")]
    return rows.select("page_id", new_y.alias("y"), new_x.alias("x"), *others)


def rectified(pixels: DataFrame, dims: DataFrame, channel: str = "r", border: int = 255) -> DataFrame:
    """page_id, y, x and a channel of pages turned back by a small `angle` (degrees, in dims with width and height) on a canvas that holds
    them all: each pixel of the canvas is asked where it comes from, between four pixels, with `border` outside of the page. Sums are
    held to a millionth and rounded half to even."""
    c, s = F.cos(F.radians("angle")), F.sin(F.radians("angle"))
    w, h = F.col("width"), F.col("height")
    sized = dims.select("page_id", "width", "height", c.alias("c"), s.alias("s"), F.ceil(F.round(w * F.abs(c) + h * F.abs(s), 9)).cast("int").alias("ow"), F.ceil(F.round(w * F.abs(s) + h * F.abs(c), 9)).cast("int").alias("oh"))
    side = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    grid = sized.select("*", side("oh").alias("y")).select("*", side("ow").alias("x"))
    dx, dy = F.col("x") + 0.5 - F.col("ow") / 2, F.col("y") + 0.5 - F.col("oh") / 2
    at = {"u": F.round(F.col("c") * dx - F.col("s") * dy + w / 2 - 0.5, 9), "v": F.round(F.col("s") * dx + F.col("c") * dy + h / 2 - 0.5, 9)}
    grid = grid.withColumns(at).withColumns({"a": F.floor("u").cast("int"), "b": F.floor("v").cast("int")})
    fx, fy = F.col("u") - F.col("a"), F.col("v") - F.col("b")
    corners = F.array(*(F.struct((F.col("a") + i).alias("x"), (F.col("b") + j).alias("y"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("weight")) for i in (0, 1) for j in (0, 1)))
    near = grid.select("page_id", "y", "x", F.explode(corners).alias("n")).select("page_id", F.col("y").alias("out_y"), F.col("x").alias("out_x"), "n.x", "n.y", "n.weight").where("weight > 0")
    met = near.join(pixels.select("page_id", "y", "x", channel), ["page_id", "y", "x"], "left")
    value = F.rint(F.round(F.sum(F.coalesce(F.col(channel), F.lit(border)) * F.col("weight")), 6)).cast("int")
    return met.groupBy("page_id", F.col("out_y").alias("y"), F.col("out_x").alias("x")).agg(value.alias(channel))
