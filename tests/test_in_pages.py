"""Queries over words that meet only words of their own page: no shuffle of words, and the same rows as by joins."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
from glyphloom.sources import blocks, derived

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Each with the bytes of tables that it may shuffle, as a share of the documents.
QUERIES: list[tuple[str, float]] = [
    ("set_gain_loss", 0.1),
    ("small_print_bands", 0.5),
    ("tile_ownership_merge", 0.1),
    ("context_crop_antijoin", 0.1),
    ("line_peers", 0.1),
    ("line_alternatives", 0.1),
    ("optimal_assignment", 0.1),
    ("confusion_matrix", 0.1),
    ("conservation_laws", 0.1),
    ("confusion_top_list", 0.1),
    ("coverage_verification", 0.1),
    ("detection_summary", 0.1),
    ("furthest_stage", 0.1),
    ("iou_sensitivity", 0.1),
    ("greedy_nms", 0.1),
    ("max_cardinality_matching", 0.1),
    ("merge_split_candidates", 0.1),
    ("merge_evidence", 0.1),
    ("mode_totals", 0.1),
    ("omission_status", 0.2),
    ("paired_gain_loss", 0.1),
    ("recognition_cer_ascii", 0.1),
    ("recognition_cer", 0.1),
    ("quad_scores", 0.1),
]


def rows(df) -> list[str]:
    return sorted(repr(tuple(round(v, 5) if isinstance(v, float) else v for v in r)) for r in df.collect())


@pytest.mark.parametrize(("name", "share"), QUERIES)
def test_words_are_not_shuffled(spark, name, share):
    store = spark._jsc.sc().statusStore()
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = store.executorSummary("driver").totalShuffleWrite()
    __spark_entry__.queries()[name](spark, LARGER).write.format("noop").mode("overwrite").save()
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert store.executorSummary("driver").totalShuffleWrite() - before < share * os.path.getsize(f"{LARGER}/documents.parquet")


@pytest.mark.parametrize("name", [n for n, _ in QUERIES])
def test_pages_told_apart_give_the_same_rows(spark, name, monkeypatch):
    query = __spark_entry__.queries()[name]
    found = rows(query(spark, SMALL))
    monkeypatch.setattr(blocks, "LONG", 300)
    assert rows(query(spark, SMALL)) == found


def test_blocks_have_the_words_of_the_relations(spark):
    docs = derived.table(spark, SMALL, "documents").select("doc_id", "text").toArrow()
    found = {"truth": [], "seen": []}
    for b in docs.to_batches():
        for block in blocks.blocks(b.column("doc_id"), b.column("text"), 20_000):
            for name, words, texts in (("truth", block.truth, block.truth_text), ("seen", block.seen, block.seen_text)):
                columns = [block.ids[words.page], words.idx, words.x0, words.y0, words.x1, words.y1]
                found[name] += zip(*(c.tolist() for c in columns), block.texts.take(pa.array(texts)).to_pylist(), strict=True)
    for name, relation in (("truth", derived.truth_words), ("seen", derived.pred_words)):
        assert sorted(found[name]) == sorted(map(tuple, relation(spark, SMALL).select("page_id", "idx", "x0", "y0", "x1", "y1", "text").collect()))


def test_blocks_of_odd_texts():
    texts = [None, "", " \n ", "Äö I\n日本  x", "a"]
    for most in (1, 5, 1000):
        found = [(int(b.ids[p]), int(i), int(n)) for b in blocks.blocks(pa.array([1, 2, 3, -4, 5]), pa.array(texts), most) for p, i, n in zip(b.page, b.idx, b.chars, strict=True)]
        assert found == [(-4, 0, 2), (-4, 1, 1), (-4, 2, 2), (-4, 3, 1), (5, 0, 1)]
    assert np.all([len(b.texts) == 0 for b in blocks.blocks(pa.array([1]), pa.array([None], pa.string()))])
