"""Queries over skew, recovery, the assembled pipeline, streams and sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.functions import config
from glyphloom.operators import composed, detection, orientation, pipeline, preparing, recovery, series
from glyphloom.sources import derived as d
from glyphloom.sources.derived import with_views
from glyphloom.sources.shared import shared_folder, written
from glyphloom.streaming import pages as streams
from glyphloom.streaming import queues

ANGLES = [-2.0, -1.0, 0.0, 0.5, 1.0, 2.0]


def skew_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sharpness of each map's rows at some angles."""
    dark = d.prob_map(spark, sf_dir).select("page_id", "x", "y", (F.col("p") >= 0.3).alias("dark"))
    return orientation.projection_scores(orientation.edge_points(dark), ANGLES).withColumn("score", F.round("score", 3))


SKEW_SCORES = with_views("prob_map", body=f"""
, e AS (SELECT page_id, x, y FROM (SELECT page_id, x, y, p >= 0.3 AS m, lead(p >= 0.3) OVER (PARTITION BY page_id, x ORDER BY y) AS below FROM prob_map) WHERE m <> below AND x BETWEEN 1 AND 62 AND y BETWEEN 1 AND 62),
r AS (SELECT page_id, angle, y - tan(radians(angle)) * x AS row FROM e, (SELECT unnest({ANGLES}::DOUBLE[]) AS angle)),
s AS (SELECT page_id, angle, floor(row) + k AS bin, CASE WHEN k = 0 THEN 1 - (row - floor(row)) ELSE row - floor(row) END AS w FROM r, (SELECT unnest([0, 1]) AS k))
SELECT page_id, angle, round(sum(w * w), 3) AS score FROM (SELECT page_id, angle, bin, sum(w) AS w FROM s GROUP BY ALL) GROUP BY ALL""")


def skew_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each map's skew is held to be, and why."""
    packed = detection.packed(d.prob_map(spark, sf_dir))
    return orientation.skews(packed.select("page_id", "width", F.transform("p", lambda p: p >= 0.3).alias("dark")))


def _things(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    half = F.floor(F.col("x0") / 2).cast("int")  # words stand closer, so that a letter has several beside it
    words = d.truth_words(spark, sf_dir).withColumns({"x0": half, "x1": F.col("x1") - F.col("x0") + half})
    box = ("x0", "y0", "x1", "y1")
    return words.where(F.char_length("text") == 1).select("page_id", "idx", *box, F.lit(0.5).alias("objectness")), words.where(F.char_length("text") > 1).select("page_id", *box)


def thin_anchor_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of one letter and the longer words beside them on their line."""
    pairs = recovery.beside(*_things(spark, sf_dir))
    return pairs.groupBy("page_id", "idx").agg(F.count("*").alias("anchors"), F.min("anchor.gap").alias("gap"))


_BESIDE = """
, near AS (SELECT page_id, idx, text, x0 // 2 AS x0, y0, x1 - x0 + x0 // 2 AS x1, y1 FROM truth_words),
beside AS (SELECT a.page_id, a.idx, greatest(b.x0 - a.x1, a.x0 - b.x1, 0) AS gap, b.x0, b.y0, b.x1, b.y1 FROM near a JOIN near b ON a.page_id = b.page_id AND a.y0 = b.y0
  WHERE length(a.text) = 1 AND length(b.text) > 1 AND greatest(b.x0 - a.x1, a.x0 - b.x1, 0) <= 70)"""
THIN_ANCHOR_PEERS = with_views("truth_words", body=_BESIDE + "\nSELECT page_id, idx, count(*) AS anchors, min(gap) AS gap FROM beside GROUP BY ALL")


def thin_nearest_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two nearest anchors of words of one letter, those with fewer left out."""
    near = recovery.nearest_two(recovery.beside(*_things(spark, sf_dir)))
    return near.select("page_id", "idx", F.col("anchors")[0]["x0"].alias("first"), F.col("anchors")[1]["x0"].alias("second"))


THIN_NEAREST_TWO = with_views("truth_words", body=_BESIDE + """
SELECT page_id, idx, max(x0) FILTER (k = 1) AS first, max(x0) FILTER (k = 2) AS second FROM (SELECT *, row_number() OVER (PARTITION BY page_id, idx ORDER BY gap, x0, y0, x1, y1) AS k FROM beside) WHERE k <= 2
GROUP BY ALL HAVING count(*) = 2""")


def thin_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes proposed for words of one letter, with bridges to a second anchor, that no longer word overlaps."""
    things, anchors = _things(spark, sf_dir)
    words = anchors.withColumn("idx", F.lit(-1))
    return recovery.new_only(recovery.proposals(things, anchors), words).withColumns({c: F.round(c, 6) for c in ("x0", "y0", "x1", "y1")})


def _stub(batch: pd.DataFrame) -> pd.DataFrame:
    """A recogniser that names what it is shown."""
    text = [f"p{p}w{w}h{h}s{s}" for p, w, h, s in zip(batch["page_id"], batch["width"], batch["height"], batch["start"], strict=True)]
    return batch.assign(text=text, confidence=((batch["width"] * 7 + batch["height"]) % 100) / 100)


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.packed(d.prob_map(spark, sf_dir)).withColumn("page_width", F.lit(640)).withColumn("page_height", F.when(F.col("page_id") % 2 == 0, 480).otherwise(640))


def pipeline_stub_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the maps through all stages, with a recogniser that stands in for a model."""
    found = pipeline.words(_maps(spark, sf_dir), _stub)
    return found.select("page_id", "idx", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1", "objectness")), "text", F.round("confidence", 6).alias("confidence"))


def pipeline_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a map, also of those without a word."""
    maps = _maps(spark, sf_dir)
    return pipeline.pages(maps, pipeline.words(maps, _stub)).select("page_id", F.coalesce(F.size("words"), F.lit(0)).alias("words"))


def _seen(page: int, x: int, y: int, width: int, height: int, start: int, turn: int) -> tuple[str, float]:
    """What the stub of a recogniser reads in a crop: small ones are one letter, turned ones are read with differing confidence."""
    n = page * 7 + x * 3 + y * 5 + turn
    text = "ilI1"[n % 4] if width < 40 and turn == 0 and n % 3 else f"{n % 97}w{width}h{height}s{start}r{turn}"
    return text, (n * 37 % 100) / 100 if n % 2 else 0.95


def _reader(batch: pd.DataFrame) -> pd.DataFrame:
    rows = zip(*(batch[c].tolist() for c in ("page_id", "x0", "y0", "width", "height", "start", "rotation")), strict=True)
    text, sure = zip(*(_seen(*r) for r in rows), strict=True)
    return batch.assign(text=text, confidence=sure)


def _composed(spark: SparkSession, sf_dir: str) -> composed.Run:
    groups, pages, bands = d.layout(spark, sf_dir), d.layout_pages(spark, sf_dir), d.layout_tiles(spark, sf_dir)
    whole = pages.select("page_id", F.lit(-1).alias("tile"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.col("page_width").alias("x1"), F.col("page_height").alias("y1"))
    maps = written(d.drawn(groups.where("page_id % 7 != 5"), whole).drop("tile").join(pages, "page_id"), "maps", d.MAPS_AT_ONCE)
    in_tiles = written(d.drawn(groups.where("page_id % 5 != 2 or x0 < 200"), bands), "maps", d.MAPS_AT_ONCE)
    return composed.run(maps, bands, in_tiles, _reader, config.settings(dense_refinement=True, thin_recovery=True, line_guided=True))


def pipeline_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of pages through maps, tiles, seams, crops, lines and recovery, with maps drawn from a layout and a reader that stands in
    for a model."""
    words = _composed(spark, sf_dir).words
    return words.select("page_id", "idx", "source", *(F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1", "objectness")), "text", F.round("confidence", 6).alias("confidence"), "rotation")


def pipeline_stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each stage of that run had, as observed while it ran."""
    run = _composed(spark, sf_dir)
    run.words.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(i, k, n) for i, (k, n) in enumerate(run.counts().items())], "place int, stage string, n long")


#: A detector's mean and deviation by channel.
MEAN, STD = [0.798, 0.785, 0.772], [0.264, 0.2749, 0.287]


def prepared_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page, and two tiles of a band of it, as a detector is shown them: 24 x 24, aspect kept, black on both sides."""
    rows = preparing.packed_rows(d.rgb_pixels(spark, sf_dir))
    w, h = F.when(F.col("page_id") % 2 == 0, 64).otherwise(50), F.when(F.col("page_id") % 2 == 0, 44).otherwise(64)
    half, more, top = F.floor(w / 2).cast("int"), F.floor(w * 4 / 100).cast("int"), F.floor(h / 4).cast("int")
    region = lambda tile, *box: F.struct(F.lit(tile).alias("tile"), *(c.cast("int").alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), box, strict=True)))
    zero = F.lit(0)
    each = F.array(region(-1, zero, zero, w, h), region(0, zero, top, half + more, top * 2), region(1, half - more, top, w, top * 2))
    regions = d.rectangles(spark, sf_dir).select("page_id").distinct().select("page_id", F.explode(each).alias("r")).select("page_id", "r.*")
    return preparing.prepared(rows, regions, 24, 24, MEAN, STD).withColumn("value", F.round("value", 6))


_WEIGHT = "greatest(1 - abs(({j} + 0.5::DOUBLE - ({o} + 0.5::DOUBLE) * {n} / {out}) / greatest({n}::DOUBLE / {out}, 1)), 0.0::DOUBLE)"
PREPARED_TENSORS = with_views("rgb_pixels", body=f"""
, dims AS (SELECT DISTINCT page_id, CASE WHEN page_id % 2 = 0 THEN 64 ELSE 50 END AS w, CASE WHEN page_id % 2 = 0 THEN 44 ELSE 64 END AS h FROM rectangles),
regions AS (SELECT page_id, -1 AS tile, 0 AS x0, 0 AS y0, w AS x1, h AS y1 FROM dims
  UNION ALL SELECT page_id, 0, 0, h // 4, w // 2 + w * 4 // 100, h // 4 * 2 FROM dims UNION ALL SELECT page_id, 1, w // 2 - w * 4 // 100, h // 4, w, h // 4 * 2 FROM dims),
fits AS (SELECT *, CASE WHEN h > w THEN greatest(CAST(floor(24 / (h::DOUBLE / w)) AS INTEGER), 1) ELSE 24 END AS rw, CASE WHEN h > w THEN 24 ELSE greatest(CAST(floor(24 * (h::DOUBLE / w)) AS INTEGER), 1) END AS rh
  FROM (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM regions)),
wx AS (SELECT page_id, tile, o, x0 + j AS x, wt / sum(wt) OVER (PARTITION BY page_id, tile, o) AS wt FROM (
  SELECT *, {_WEIGHT.format(j="j", o="o", n="w", out="rw")} AS wt FROM (SELECT *, unnest(range(w)) AS j FROM (SELECT *, unnest(range(rw)) AS o FROM fits)))),
wy AS (SELECT page_id, tile, o, y0 + j AS y, wt / sum(wt) OVER (PARTITION BY page_id, tile, o) AS wt FROM (
  SELECT *, {_WEIGHT.format(j="j", o="o", n="h", out="rh")} AS wt FROM (SELECT *, unnest(range(h)) AS j FROM (SELECT *, unnest(range(rh)) AS o FROM fits)))),
across AS (SELECT wx.page_id, wx.tile, y, o AS x, sum(r * wt) AS r, sum(g * wt) AS g, sum(b * wt) AS b FROM wx JOIN rgb_pixels p ON p.page_id = wx.page_id AND p.x = wx.x WHERE wt > 0 GROUP BY ALL),
seen AS (SELECT a.page_id, a.tile, wy.o AS y, a.x, least(greatest(round_even(round(sum(r * wt), 6), 0), 0), 255) AS r, least(greatest(round_even(round(sum(g * wt), 6), 0), 0), 255) AS g,
  least(greatest(round_even(round(sum(b * wt), 6), 0), 0), 255) AS b FROM across a JOIN wy ON wy.page_id = a.page_id AND wy.tile = a.tile AND wy.y = a.y WHERE wt > 0 GROUP BY ALL),
placed AS (SELECT s.page_id, s.tile, s.y + (25 - rh) // 2 AS y, s.x + (25 - rw) // 2 AS x, r, g, b FROM seen s JOIN fits f ON f.page_id = s.page_id AND f.tile = s.tile),
grid AS (SELECT page_id, tile, y, unnest(range(24)) AS x FROM (SELECT page_id, tile, unnest(range(24)) AS y FROM regions)),
v AS (SELECT g.page_id, g.tile, g.y, g.x, [coalesce(r, 0), coalesce(p.g, 0), coalesce(b, 0)] AS v FROM grid g LEFT JOIN placed p ON p.page_id = g.page_id AND p.tile = g.tile AND p.y = g.y AND p.x = g.x)
SELECT page_id, CAST(tile AS INTEGER) AS tile, CAST(c - 1 AS INTEGER) AS channel, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round((v[c] / 255.0::DOUBLE - ({MEAN}::DOUBLE[])[c]) / ({STD}::DOUBLE[])[c], 6) AS value
FROM (SELECT *, unnest([1, 2, 3]) AS c FROM v)""")


def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type, counted by a stream."""
    events = spark.readStream.schema(d.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    counts = streams.run_to_end(streams.event_windows(events), shared_folder(spark, "streams"), "complete")
    return counts.select(F.unix_micros("start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


STREAM_WINDOW_COUNTS = """
SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"""


def _result_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.readStream.schema(d.table(spark, sf_dir, "conversations").schema).parquet(f"{sf_dir}/conversations.parquet*")
    return turns.where((F.col("conv_id") * 5 + F.col("turn")) % 19 != 7).select(F.col("conv_id").alias("run"), F.col("turn").alias("sequence"), "text")


def stream_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that a stream lets out in order: all up to the first that is lost."""
    return streams.run_to_end(streams.in_order(_result_stream(spark, sf_dir)), shared_folder(spark, "streams")).select("run", "sequence", F.char_length("text").alias("chars"))


STREAM_ORDERED = """
SELECT run, sequence, CAST(length(text) AS INTEGER) AS chars FROM (SELECT conv_id AS run, turn AS sequence, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations WHERE (conv_id * 5 + turn) % 19 <> 7) WHERE place = sequence"""


def stream_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What that stream still keeps when its input has ended: of each run the first page that is missing, and the pages behind it."""
    folder = shared_folder(spark, "streams")
    streams.run_to_end(streams.in_order(_result_stream(spark, sf_dir)), folder)
    return streams.pending(spark, folder).withColumn("fault", F.lit(streams.MISSING_PAGE))


STREAM_MISSING = f"""
SELECT run, CAST(missing AS BIGINT) AS missing, count(*) AS waiting, '{streams.MISSING_PAGE}' AS fault FROM (
  SELECT run, sequence, min(CASE WHEN place <> sequence THEN place END) OVER (PARTITION BY run) AS missing FROM (
    SELECT conv_id AS run, turn AS sequence, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations WHERE (conv_id * 5 + turn) % 19 <> 7))
WHERE sequence > missing GROUP BY ALL"""


def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers as a corpus, read over and over by a stream that stops after five corpora and a half: how often each page came,
    and its last number."""
    pages = written(series.numbered(d.table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey"), "corpus")
    n, folder = pages.count(), shared_folder(spark, "streams")
    if n:
        feed = queues.replayed(spark, n, pages=n * 11 // 2)
        queues.run_replay(feed.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").start())
    rows = spark.read.schema("sequence long, page long, turn long").parquet(f"{folder}/rows") if n else spark.createDataFrame([], "sequence long, page long, turn long")
    return rows.join(pages, F.col("page") == F.col("place")).groupBy("s_suppkey").agg(F.count("*").alias("times"), F.max("sequence").alias("last"), F.max("turn").alias("turn"))


STREAM_REPLAY = """
WITH p AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS place, count(*) OVER () AS n FROM supplier)
SELECT s_suppkey, count(*) AS times, max(id) AS last, max(id // n) AS turn
FROM p JOIN (SELECT unnest(range((SELECT count(*) * 11 // 2 FROM supplier))) AS id) ON id % n = place GROUP BY s_suppkey"""


def stream_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that come in two parts, put together when both are there; those that lost one never come out."""
    half = F.floor(F.char_length("text") / 2).cast("int")
    parts = F.explode(F.array(F.struct(F.lit(0).alias("part"), F.substr("text", F.lit(1), half).alias("text")), F.struct(F.lit(1).alias("part"), F.substr(F.col("text"), half + 1, F.char_length("text")).alias("text")))).alias("p")
    rows = _result_stream(spark, sf_dir).select("run", "sequence", parts).select("run", "sequence", "p.part", F.lit(2).alias("of"), "p.text").where("part = 0 or (run + sequence) % 5 != 3")
    return streams.run_to_end(streams.gathered(rows), shared_folder(spark, "streams")).select("run", "sequence", F.char_length("text").alias("chars"))


STREAM_FAN_IN = """
SELECT conv_id AS run, turn AS sequence, CAST(length(text) AS INTEGER) AS chars FROM conversations WHERE (conv_id * 5 + turn) % 19 <> 7 AND (conv_id + turn) % 5 <> 3"""


def split_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and characters by language and source."""
    return d.table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("pages"), F.sum("n_chars").alias("chars"))


SPLIT_INVENTORY = "SELECT lang, source, count(*) AS pages, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ALL"


def props_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the JSON that events carry, absent ones null."""
    rows = d.table(spark, sf_dir, "events").select("event_type", F.size(F.json_object_keys("props")).alias("keys"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.coalesce("keys", F.lit(0))).alias("keys"))


PROPS_SCAN = "SELECT event_type, count(*) AS n, CAST(sum(coalesce(len(json_keys(props)), 0)) AS BIGINT) AS keys FROM events GROUP BY event_type"

QUERIES = {
    f.__name__: (f, globals().get(f.__name__.upper()))
    for f in (
        skew_scores, skew_estimates, thin_anchor_peers, thin_nearest_two, thin_proposals, pipeline_stub_words, pipeline_pages, pipeline_composed, pipeline_stage_counts, prepared_tensors, stream_window_counts, stream_ordered, stream_missing, stream_replay, stream_fan_in, split_inventory, props_scan,
    )
}
