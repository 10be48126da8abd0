"""Relations of pages, words, maps, logits and telemetry, derived from the driver's tables by integer rules.

The tables hold no images. Each relation has its DataFrame here and the same rule as a SQL view in DERIVED_SQL, for an
independent engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAP_SIDE = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _words() -> Column:
    return F.filter(F.split("text", "[ \n]+"), lambda w: w != "")


def truth_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document on a grid of ten a line: page_id, idx, text and an integer box."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(_words()).alias("idx", "text"))
    x0, y0 = F.col("idx") % 10 * 100, F.floor(F.col("idx") / 10).cast("int") * 20
    return rows.select("page_id", "idx", "text", x0.alias("x0"), y0.alias("y0"), (x0 + 7 * F.least(F.char_length("text"), F.lit(13))).alias("x1"), (y0 + 14).alias("y1"))


def pred_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """truth_words as a recogniser might see them: some lost, moved either way, of another height, misread, doubled, or grown over the next
    word."""
    page, idx, copy = F.col("page_id"), F.col("idx"), F.col("copy")
    moved, lifted, taller = (page * 7 + idx * 3) % 9 - 4, (page * 5 + idx * 7) % 13 - 6, idx * 11 % 7 - 3
    copies = F.when(idx % 29 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    kept = truth_words(spark, sf_dir).where((page * 31 + idx) % 13 != 0).withColumn("copy", F.explode(copies))
    wide = F.when(idx % 37 == 0, F.lit(60)).otherwise(F.lit(0))
    return kept.select(
        "page_id",
        (idx + copy * 1_000_000).cast("long").alias("idx"),
        F.when((page + idx) % 11 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"),
        (F.col("x0") + moved + copy).alias("x0"),
        (F.col("y0") + lifted + copy).cast("int").alias("y0"),
        (F.col("x1") + moved + wide + copy).alias("x1"),
        (F.col("y1") + lifted + taller + copy).cast("int").alias("y1"),
        ((page * 13 + idx * 17) % 100 / 100).alias("objectness"),
    )


def glyph_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected parts of ink of the words, one a letter: page_id, an integer box and how many pixels are ink. Some are specks, hairlines
    or large; every third stretch of four lines is of larger print."""
    letter = F.explode(F.sequence(F.lit(0), F.least(F.char_length("text"), F.lit(13)) - 1))
    rows = truth_words(spark, sf_dir).select("page_id", "idx", letter.alias("i"), F.col("x0").alias("left"), F.col("y0").alias("up"))
    idx, i = F.col("idx"), F.col("i")
    high = F.when((idx * 7 + i) % 61 == 0, 60).otherwise(1 + (idx * 5 + i * 3) % 13 + F.when(F.floor(idx / 40) % 3 == 0, 7).otherwise(0))
    rows = rows.select("page_id", (F.col("left") + 7 * i).alias("x0"), (F.col("up") + (idx * 3 + i) % 4).alias("y0"), (1 + (idx + i) % 6).alias("w"), high.alias("h"))
    size = F.col("w") * F.col("h")
    return rows.select("page_id", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"), (size - F.floor(size / 4)).cast("int").alias("pixels"))


def line_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document in lines of ten, of differing heights, widths and places: page_id, idx, letters and an integer box.

    Every fourth page has columns of narrow words in place of lines."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(_words()).alias("idx", "text"))
    idx, letters, upright = F.col("idx"), F.char_length("text"), F.col("page_id") % 4 == 0
    line = F.floor(idx / 10).cast("int")
    x0 = F.when(upright, idx % 10 * 40).otherwise(idx % 10 * 50) + idx * 3 % 11
    y0 = F.when(upright, line * 40).otherwise(line * 26) + idx * 5 % 9
    width = F.when(upright, 9 + idx * 7 % 5).otherwise(4 + 6 * F.least(letters, F.lit(12)))
    height = F.when(upright, 6 + 4 * F.least(letters, F.lit(8))).otherwise(8 + idx * 7 % 17)
    return rows.select("page_id", "idx", letters.alias("letters"), x0.alias("x0"), y0.alias("y0"), (x0 + width).alias("x1"), (y0 + height).alias("y1"))


def page_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a page, also one without words; its words need not be exploded."""
    ends = F.transform("words", lambda w, i: i % 10 * 100 + 7 * F.least(F.char_length(w), F.lit(13)))
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), _words().alias("words"))
    height = F.when(F.size("words") > 0, F.floor((F.size("words") - 1) / 10).cast("int") * 20 + 14)
    return pages.select("page_id", F.coalesce(F.array_max(ends), F.lit(0)).alias("width"), F.coalesce(height, F.lit(0)).alias("height"))


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle for each supplier, eight on a map, so that maps grow in number with the table: page_id, x0, y0, w, h, p."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.floor(k / 8).alias("page_id"),
        (k * 11 % 44).cast("int").alias("x0"),
        (k * 7 % 50).cast("int").alias("y0"),
        (3 + k * 5 % 17).cast("int").alias("w"),
        (2 + k * 3 % 11).cast("int").alias("h"),
        F.element_at(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.9)), (k % 3 + 1).cast("int")).alias("p"),
    )


def prob_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, y, x, p of 64 x 64 pixels a map; where rectangles overlap the largest p holds, elsewhere 0. Each eleventh map is blank.

    Only rectangles are shuffled, at most eight different ones a map; pixels are made where their map's are, some 64 maps a task, and
    what is partitioned by page_id next needs no shuffle. A join would take exploded pixels for as few as their rectangles, and broadcast them."""
    rows = rectangles(spark, sf_dir)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // 512 + 1)
    each = rows.repartition(tasks, "page_id").groupBy("page_id").agg(F.collect_set(F.struct("x0", "y0", "w", "h", "p")).alias("inked"))
    side = F.sequence(F.lit(0), F.lit(MAP_SIDE - 1))
    covers = lambda at, r, low, size: (at >= r[low]) & (at < r[low] + r[size])
    lines = each.select("page_id", "inked", F.explode(side).alias("y"))
    lines = lines.select("page_id", "y", F.filter("inked", lambda r: (F.col("page_id") % 11 != 5) & covers(F.col("y"), r, "y0", "h")).alias("inked"), F.explode(side).alias("x"))
    most = F.array_max(F.transform("inked", lambda r: F.when(covers(F.col("x"), r, "x0", "w"), r["p"])))
    return lines.select("page_id", "y", "x", F.coalesce(most, F.lit(0.0)).alias("p"))


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glyph group for each part, 54 a page in lines, on every fourth page in columns: page_id, k, a box in pixels of the page, p.

    Among words stand narrow groups, and bars too thin for an opening; some are faint, some cross the middle of the page."""
    page, k = F.floor(F.col("p_partkey") / 54).cast("long"), (F.col("p_partkey") % 54).cast("int")
    rows = table(spark, sf_dir, "part").select(page.alias("page_id"), k.alias("k"))
    page, k = F.col("page_id"), F.col("k")
    upright, wide = page % 4 == 3, page % 2 == 0
    slots = F.when(upright, 7).when(wide, 6).otherwise(4)
    line = F.floor(k / slots).cast("int")
    x0 = k % slots * F.when(upright, 60).otherwise(105) + 8 + k * 7 % 5 * 3 + F.when(~upright & (line % 2 == 1), 25).otherwise(0)
    y0 = line * F.when(upright, 80).when(wide, 50).otherwise(45) + 6 + k * 5 % 3 * 2
    kind = (page * 3 + k * 11) % 10
    w = F.when(upright, 20).when(kind == 0, 8).when(kind == 1, 15).otherwise(60 + k * 13 % 35)
    h = F.when(upright, 62).when(kind == 0, 25).when(kind == 1, 30).otherwise(15 + k % 3 * 2)
    p = F.when(k % 17 == 8, 0.25).when(k % 9 == 4, 0.5).otherwise(F.lit(0.9))
    return rows.select("page_id", "k", x0.cast("int").alias("x0"), y0.cast("int").alias("y0"), (x0 + w).cast("int").alias("x1"), (y0 + h).cast("int").alias("y1"), p.alias("p"))


def layout_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, page_width and page_height of the layout's pages, lying or standing."""
    page = F.floor(F.col("p_partkey") / 54).cast("long").alias("page_id")
    wide = F.col("page_id") % 2 == 0
    return table(spark, sf_dir, "part").select(page).distinct().select("page_id", F.when(wide, 640).otherwise(480).alias("page_width"), F.when(wide, 480).otherwise(640).alias("page_height"))


def layout_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tiles side by side over a band of two pages in three: page_id, tile, a box, owner_start, owner_end."""
    w, h = F.col("page_width"), F.col("page_height")
    half, more = F.floor(w / 2).cast("int"), F.floor(w * 4 / 100).cast("int")
    side = lambda tile, x0, x1, start, end: F.struct(F.lit(tile).alias("tile"), x0.cast("int").alias("x0"), x1.cast("int").alias("x1"), start.cast("int").alias("owner_start"), end.cast("int").alias("owner_end"))
    both = F.array(side(0, F.lit(0), half + more, F.lit(0), half), side(1, half - more, w, half, w))
    top = F.floor(h * 3 / 8).cast("int")
    rows = layout_pages(spark, sf_dir).where("page_id % 3 != 1").select("page_id", F.explode(both).alias("t"), top.alias("y0"), (top + F.floor(h / 4)).cast("int").alias("y1"))
    return rows.select("page_id", "t.tile", "t.x0", "y0", "t.x1", "y1", "t.owner_start", "t.owner_end")


#: Maps that leave a task at once, or lie in one row group: readers hold some thousand rows of a group at once.
MAPS_AT_ONCE = 32


def draw(batches: Iterator[pd.DataFrame], side: int) -> Iterator[pd.DataFrame]:
    """The maps of regions with their groups, a few at once: the rows of a batch are small, their maps are not."""
    for whole in batches:
        for start in range(0, len(whole), MAPS_AT_ONCE):
            b = whole.iloc[start : start + MAPS_AT_ONCE]
            maps = []
            for x0, y0, x1, y1, those in zip(b["x0"], b["y0"], b["x1"], b["y1"], b["groups"], strict=True):
                scale = side / max(x1 - x0, y1 - y0)
                left, top = (side - (x1 - x0) * scale) / 2 - x0 * scale, (side - (y1 - y0) * scale) / 2 - y0 * scale
                p = np.zeros((side, side))
                for g in those if those is not None else ():
                    u0, u1, v0, v1 = max(g["x0"], x0), min(g["x1"], x1), max(g["y0"], y0), min(g["y1"], y1)
                    if u0 < u1 and v0 < v1:
                        at = np.s_[int(v0 * scale + top) : int(np.ceil(v1 * scale + top)), int(u0 * scale + left) : int(np.ceil(u1 * scale + left))]
                        p[at] = np.maximum(p[at], g["p"])
                maps.append(p.ravel())
            yield pd.DataFrame({"page_id": b["page_id"], "tile": b["tile"], "width": side, "p": maps})


def drawn(groups: DataFrame, regions: DataFrame, side: int = 128) -> DataFrame:
    """Maps of `side` pixels squared that show regions (page_id, tile, a box) of pages letterboxed, one a region: page_id, tile, width, p. The
    groups of a page are few."""
    box = F.struct(*(F.col(c) for c in ("x0", "y0", "x1", "y1", "p")))
    each = groups.groupBy("page_id").agg(F.collect_list(box).alias("groups"))
    rows = regions.select("page_id", "tile", "x0", "y0", "x1", "y1").hint("merge").join(each, "page_id", "left")
    return rows.mapInPandas(lambda batches: draw(batches, side), "page_id long, tile int, width int, p array<double>")


def rgb_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps as coloured pages, 64 x 44 pixels if their number is even, else 50 x 64: page_id, y, x, r, g, b."""
    even = F.col("page_id") % 2 == 0
    inside = (F.col("y") < F.when(even, 44).otherwise(64)) & (F.col("x") < F.when(even, 64).otherwise(50))
    r, g = 255 - F.floor(F.col("p") * 200), (F.col("x") * 3 + F.col("y") * 5 + F.col("page_id") * 7) % 256
    return prob_map(spark, sf_dir).where(inside).select("page_id", "y", "x", r.cast("int").alias("r"), g.cast("int").alias("g"), ((r + g * 3) % 256).cast("int").alias("b"))


def slanted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of letters for each supplier, eight on a page of 200 pixels squared, level or aslant: page_id, k, n, dx, dy (the step from letter to
    letter), x, y (of the first letter)."""
    k = F.col("s_suppkey")
    turn = (k % 4).cast("int")
    rows = table(spark, sf_dir, "supplier").select(F.floor(k / 8).cast("long").alias("page_id"), k.alias("k"), (4 + k % 5).cast("int").alias("n"), turn.alias("turn"))
    dx = F.element_at(F.array(F.lit(9), F.lit(0), F.lit(7), F.lit(7)), F.col("turn") + 1)
    dy = F.element_at(F.array(F.lit(0), F.lit(9), F.lit(7), F.lit(-7)), F.col("turn") + 1)
    k = F.col("k")
    x, y = 6 + k % 8 % 4 * 48 + k % 3, F.when(k % 8 < 4, 12).otherwise(112) + k % 5 * 2 + F.when(dy < 0, 60).otherwise(0)
    return rows.select("page_id", "k", "n", dx.alias("dx"), dy.alias("dy"), x.cast("int").alias("x"), y.cast("int").alias("y"))


def slanted_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of the runs as boxes of 5 x 6 pixels of full ink: page_id, x0, y0, x1, y1, p."""
    rows = slanted_runs(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    x, y = F.col("x") + F.col("i") * F.col("dx"), F.col("y") + F.col("i") * F.col("dy")
    return rows.select("page_id", x.alias("x0"), y.alias("y0"), (x + 5).alias("x1"), (y + 6).alias("y1"), F.lit(1.0).alias("p"))


def slanted_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted words turned a little about their middles, each as four corners: page_id, idx, quad."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    a = F.radians((F.col("idx") % 5 - 2) * F.lit(1.5))
    hw, hh = (F.col("x1") - F.col("x0")) / 2, (F.col("y1") - F.col("y0")) / F.when(F.col("idx") % 6 == 0, 6).otherwise(2)
    points = [v for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1)) for v in (cx + hw * i * F.cos(a) - hh * j * F.sin(a), cy + hw * i * F.sin(a) + hh * j * F.cos(a))]
    return pred_words(spark, sf_dir).select("page_id", "idx", F.array(*points).alias("quad"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight vectors in turn are the steps of one sample: sample, step, values (doubles, by class)."""
    vec = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.floor(vec / 8).alias("sample"), (vec % 8).cast("int").alias("step"), F.transform("embedding", lambda v: v.cast("double") * 8).alias("values")
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor samples of runs, one a user, so that runs grow in number with the table: run, time_ns, gpu (some null), vram, rss, cpu."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"),
        e.alias("event_id"),
        "event_type",
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("time_ns"),
        F.when(e % 17 != 0, F.col("value")).alias("gpu"),
        (e * 7919 % 8_000_000).alias("vram"),
        (1_000_000 + e * 104_729 % 500_000).alias("rss"),
        F.when(e % 23 != 0, (e * 31 % 800) / 8).alias("cpu"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of all conversations as a stream of page results: run, sequence, id, text; some are lost, some come twice."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("sequence"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    kept = turns.where((F.col("run") * 5 + F.col("sequence")) % 19 != 7)
    return kept.unionByName(kept.where((F.col("run") + F.col("sequence") * 3) % 23 == 4))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials of configurations, fifty of a family, so that families grow in number with the table: config_id, family, pps, memory, exact, parity."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("config_id"), (k % 12 + 12 * F.floor(k / 600)).alias("family"), (F.lit(1) + k * 37 % 400 / 100).alias("pps"), (1000 + k * 91 % 3000).alias("memory"), (900 + k * 17 % 60).alias("exact"), (k % 7 != 0).alias("parity"))


#: Each relation as SQL over the driver's tables and the views before it.
DERIVED_SQL = {
    "truth_words": r"""
      SELECT page_id, idx, text, (idx % 10) * 100 AS x0, (idx // 10) * 20 AS y0, (idx % 10) * 100 + 7 * least(CAST(length(text) AS INTEGER), 13) AS x1, (idx // 10) * 20 + 14 AS y1
      FROM (SELECT doc_id AS page_id, CAST(unnest(range(len(w))) AS INTEGER) AS idx, unnest(w) AS text
            FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \n]+'), lambda x: x <> '') AS w FROM documents))""",
    "pred_words": r"""
      SELECT page_id, CAST(idx + copy * 1000000 AS BIGINT) AS idx, CASE WHEN (page_id + idx) % 11 = 0 THEN text || 'x' ELSE text END AS text,
             x0 + (page_id * 7 + idx * 3) % 9 - 4 + copy AS x0, CAST(y0 + (page_id * 5 + idx * 7) % 13 - 6 + copy AS INTEGER) AS y0,
             x1 + (page_id * 7 + idx * 3) % 9 - 4 + CASE WHEN idx % 37 = 0 THEN 60 ELSE 0 END + copy AS x1, CAST(y1 + (page_id * 5 + idx * 7) % 13 - 6 + idx * 11 % 7 - 3 + copy AS INTEGER) AS y1,
             ((page_id * 13 + idx * 17) % 100) / 100.0::DOUBLE AS objectness
      FROM (SELECT *, unnest(CASE WHEN idx % 29 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM truth_words WHERE (page_id * 31 + idx) % 13 <> 0)""",
    "glyph_parts": """
      SELECT page_id, x0, y0, x0 + w AS x1, y0 + h AS y1, w * h - w * h // 4 AS pixels FROM (
        SELECT page_id, x0 + 7 * i AS x0, y0 + (idx * 3 + i) % 4 AS y0, 1 + (idx + i) % 6 AS w,
               CASE WHEN (idx * 7 + i) % 61 = 0 THEN 60 ELSE 1 + (idx * 5 + i * 3) % 13 + CASE WHEN idx // 40 % 3 = 0 THEN 7 ELSE 0 END END AS h
        FROM (SELECT page_id, idx, x0, y0, CAST(unnest(range(least(length(text), 13))) AS INTEGER) AS i FROM truth_words))""",
    "line_words": r"""
      SELECT page_id, idx, letters, x0, y0, x0 + CASE WHEN upright THEN 9 + idx * 7 % 5 ELSE 4 + 6 * least(letters, 12) END AS x1,
             y0 + CASE WHEN upright THEN 6 + 4 * least(letters, 8) ELSE 8 + idx * 7 % 17 END AS y1, line
      FROM (SELECT page_id, idx, CAST(length(text) AS INTEGER) AS letters, page_id % 4 = 0 AS upright, idx // 10 AS line,
                   CASE WHEN page_id % 4 = 0 THEN idx % 10 * 40 ELSE idx % 10 * 50 END + idx * 3 % 11 AS x0,
                   CASE WHEN page_id % 4 = 0 THEN idx // 10 * 40 ELSE idx // 10 * 26 END + idx * 5 % 9 AS y0
            FROM (SELECT doc_id AS page_id, CAST(unnest(range(len(w))) AS INTEGER) AS idx, unnest(w) AS text
                  FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \n]+'), lambda x: x <> '') AS w FROM documents)))""",
    "page_dims": """
      SELECT d.doc_id AS page_id, coalesce(w.width, 0) AS width, coalesce(w.height, 0) AS height
      FROM documents d LEFT JOIN (SELECT page_id, max(x1) AS width, max(y1) AS height FROM truth_words GROUP BY page_id) w ON d.doc_id = w.page_id""",
    "rectangles": """
      SELECT CAST(s_suppkey // 8 AS BIGINT) AS page_id, s_suppkey * 11 % 44 AS x0, s_suppkey * 7 % 50 AS y0, 3 + s_suppkey * 5 % 17 AS w, 2 + s_suppkey * 3 % 11 AS h,
             CASE s_suppkey % 3 WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 ELSE 0.9 END::DOUBLE AS p FROM supplier""",
    "prob_map": """
      SELECT g.page_id, g.y, g.x, coalesce(r.p, 0.0::DOUBLE) AS p
      FROM (SELECT page_id, CAST(gy.v AS INTEGER) AS y, CAST(gx.v AS INTEGER) AS x FROM (SELECT DISTINCT page_id FROM rectangles), (SELECT unnest(range(64)) AS v) gy, (SELECT unnest(range(64)) AS v) gx) g
      LEFT JOIN (SELECT page_id, y, x, max(p) AS p FROM (SELECT page_id, p, y, unnest(range(x0, x0 + w)) AS x FROM (SELECT page_id, p, x0, w, unnest(range(y0, y0 + h)) AS y FROM rectangles WHERE page_id % 11 <> 5)) GROUP BY ALL) r
        ON g.page_id = r.page_id AND g.y = r.y AND g.x = r.x""",
    "rgb_pixels": """
      SELECT page_id, y, x, CAST(255 - floor(p * 200) AS INTEGER) AS r, CAST((x * 3 + y * 5 + page_id * 7) % 256 AS INTEGER) AS g,
             CAST((255 - floor(p * 200) + (x * 3 + y * 5 + page_id * 7) % 256 * 3) % 256 AS INTEGER) AS b
      FROM prob_map WHERE y < CASE WHEN page_id % 2 = 0 THEN 44 ELSE 64 END AND x < CASE WHEN page_id % 2 = 0 THEN 64 ELSE 50 END""",
    "logits": """
      SELECT CAST(vec_id // 8 AS BIGINT) AS sample, CAST(vec_id % 8 AS INTEGER) AS step, list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 8) AS "values" FROM embeddings""",
    "telemetry": """
      SELECT user_id AS run, event_id, event_type, epoch_us(ts) * 1000 AS time_ns, CASE WHEN event_id % 17 <> 0 THEN value END AS gpu, event_id * 7919 % 8000000 AS vram,
             1000000 + event_id * 104729 % 500000 AS rss, CASE WHEN event_id % 23 <> 0 THEN (event_id * 31 % 800) / 8.0::DOUBLE END AS cpu FROM events""",
    "results": """
      SELECT run, sequence, id, text FROM (
        SELECT conv_id AS run, turn AS sequence, conv_id || '-' || turn AS id, text, unnest(CASE WHEN (conv_id + turn * 3) % 23 = 4 THEN [1, 2] ELSE [1] END) AS copy
        FROM conversations WHERE (conv_id * 5 + turn) % 19 <> 7)""",
    "trials": """
      SELECT p_partkey AS config_id, p_partkey % 12 + 12 * (p_partkey // 600) AS family, 1 + (p_partkey * 37 % 400) / 100.0::DOUBLE AS pps, 1000 + p_partkey * 91 % 3000 AS memory, 900 + p_partkey * 17 % 60 AS exact,
             p_partkey % 7 <> 0 AS parity FROM part""",
}
_NEEDS = {"pred_words": ["truth_words"], "glyph_parts": ["truth_words"], "page_dims": ["truth_words"], "prob_map": ["rectangles"], "rgb_pixels": ["rectangles", "prob_map"]}


def with_views(*names: str, body: str) -> str:
    """The SQL of a query over derived relations."""
    needed: list[str] = []
    for name in names:
        needed += [n for n in (*_NEEDS.get(name, []), name) if n not in needed]
    return "WITH " + ",\n".join(f"{n} AS ({DERIVED_SQL[n]})" for n in needed) + body
