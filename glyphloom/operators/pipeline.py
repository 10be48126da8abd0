"""The stages in one plan: maps to boxes, boxes to crops, crops to parts, parts to texts, texts to words of pages.

Detection and recognition are given as functions of batches, so that any model can stand behind them; the plan's one shuffle
brings the parts of a word together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.config import Settings
from glyphloom.functions.geometry import CORNERS, clamp
from glyphloom.operators import detection, recognition

#: Takes a batch with page_id, place, start, width and height, and adds text and confidence.
Recogniser = Callable[[pd.DataFrame], pd.DataFrame]

WORDS = "page_id, idx, x0, y0, x1, y1, objectness, text, confidence"


def words(maps: DataFrame, recogniser: Recogniser, settings: Settings = Settings()) -> DataFrame:
    """Words of maps (page_id, width, p, page_width, page_height): every map has at least its empty list of them in `pages`."""
    checked = settings.checked()
    params = detection.Params(checked.bin_thresh, checked.box_thresh, checked.unclip_ratio)
    found = detection.boxes(maps, params)
    sizes = maps.select("page_id", "page_width", "page_height", "width")
    edges = detection.unclip(*(F.col(c) for c in CORNERS), params.unclip_ratio)
    boxes = found.join(sizes, "page_id").select("page_id", "place", "score", "page_width", "page_height", *(clamp(e / F.col("width"), 0.0, 1.0).alias(c) for e, c in zip(edges, CORNERS, strict=True)))
    a = detection.unpad(F.col("x0"), F.col("y0"), F.col("page_width"), F.col("page_height"))
    b = detection.unpad(F.col("x1"), F.col("y1"), F.col("page_width"), F.col("page_height"))
    boxes = boxes.select("page_id", "place", "score", "page_width", "page_height", *(v.alias(c) for v, c in zip((*a, *b), CORNERS, strict=True))).where("x1 > x0 and y1 > y0")
    rect = recognition.crop_rect(*(F.col(c) for c in CORNERS), F.col("page_width"), F.col("page_height"))
    crops = boxes.select("*", (rect[2] - rect[0]).alias("width"), (rect[3] - rect[1]).alias("height"))
    starts = recognition.split_starts(F.col("width"), F.col("height"))
    parts = crops.select("page_id", "place", "width", "height", starts.alias("starts"), F.posexplode(starts).alias("part", "start"))
    parts = parts.withColumn("last", recognition.last_overlap(F.col("starts"), F.col("width"), F.col("height"))).drop("starts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), checked.recognition_batch):
                yield recogniser(batch.iloc[i : i + checked.recognition_batch])[["page_id", "place", "part", "last", "text", "confidence"]]

    read = parts.select("page_id", "place", "part", "start", "width", "height", "last").mapInPandas(run, "page_id long, place int, part int, last double, text string, confidence double")
    joined = read.groupBy("page_id", "place").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("p"), F.max("last").alias("last"), F.avg("confidence").alias("confidence"))
    texts = joined.select("page_id", "place", "confidence", recognition.merged(F.col("p.text"), F.col("last")).alias("text"))
    return boxes.join(texts, ["page_id", "place"]).select("page_id", F.col("place").alias("idx"), *CORNERS, F.col("score").alias("objectness"), "text", "confidence")


def pages(maps: DataFrame, found: DataFrame) -> DataFrame:
    """One row a page with its words in order; pages without words stay, with none."""
    each = found.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(*(c for c in WORDS.split(", ") if c != "page_id")))).alias("words"))
    return maps.select("page_id").join(each, "page_id", "left")
