"""Pixels of maps are many more than the rectangles that they are drawn from: no join may broadcast them."""

from __future__ import annotations

import glob

import numpy as np
import pandas as pd
import pyarrow.parquet
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from glyphloom.sources import derived, shared

QUERIES: list[str] = ["map_stage_trace", "morph_opening", "skew_scores", "heatmap_fusion", "fused_maps", "prepared_tensors"]


@pytest.mark.parametrize("name", QUERIES)
def test_no_pixels_are_broadcast(spark, name):
    df = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_maps_are_those_of_a_join(spark):
    drawn = {tuple(r) for r in derived.prob_map(spark, "/root/testdata/sf0.01").collect()}
    most = {}
    pages = set()
    for page, x0, y0, w, h, p in derived.rectangles(spark, "/root/testdata/sf0.01").collect():
        pages.add(page)
        if page % 11 != 5:
            for y in range(y0, y0 + h):
                for x in range(x0, x0 + w):
                    most[page, y, x] = max(p, most.get((page, y, x), 0.0))
    assert drawn == {(page, y, x, most.get((page, y, x), 0.0)) for page in pages for y in range(64) for x in range(64)}


def test_few_drawn_maps_leave_a_task_at_once():
    regions = pd.DataFrame({"page_id": np.arange(1000), "tile": -1, "x0": 0, "y0": 0, "x1": 10, "y1": 10, "groups": [[{"x0": 2, "y0": 2, "x1": 5, "y1": 5, "p": 0.9}]] * 1000})
    sizes = [len(b) for b in derived.draw(iter([regions]), 16)]
    assert sum(sizes) == 1000
    assert max(sizes) <= derived.MAPS_AT_ONCE


def test_few_maps_lie_in_a_row_group(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(shared, "shared_folder", lambda spark, kind: f"{tmp_path}/{kind}")
    maps = spark.range(1000).select("id", F.sequence(F.lit(0), F.lit(63)).alias("p"))
    assert shared.written(maps, "maps", 32).count() == 1000
    groups = [m.row_group(i).num_rows for f in glob.glob(f"{tmp_path}/maps/*.parquet") for m in [pyarrow.parquet.ParquetFile(f).metadata] for i in range(m.num_row_groups)]
    assert sum(groups) == 1000
    assert max(groups) <= 32
