"""Readers, sinks and pixel kernels."""

from __future__ import annotations

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphloom.functions import raster
from glyphloom.sources import readers, sinks
from glyphloom.streaming import session


def test_workload_and_replay(spark, tmp_path):
    path = tmp_path / "w.json"
    path.write_text(json.dumps({"pages": [{"id": "a", "image": "a.png", "words": []}, {"id": "b", "image": "b.png"}]}))
    pages = readers.workload(spark, str(path))
    assert [r.id for r in readers.replayed(pages, 5).orderBy("sequence").collect()] == ["a", "b", "a", "b", "a"]
    path.write_text('{"pages": []}')
    with pytest.raises(ValueError):
        readers.workload(spark, str(path))


def test_annotations(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"form": [{"label": "q", "words": [{"text": "x", "box": [0, 0, 2, 1]}, {"text": " ", "box": [0, 0, 1, 1]}]}, {"label": "a", "words": [{"text": "y", "box": [1, 1, 2, 2]}]}]}))
    rows = readers.form_annotations(spark, str(tmp_path / "f.json")).orderBy("idx").collect()
    assert [(r.page_id, r.text, r.region) for r in rows] == [("f.json", "x", "q"), ("f.json", "y", "a")] and rows[0].polygon[2] == [2, 1]
    scene = {"image_id": "s", "image_width": 10, "image_height": 20, "paragraphs": [{"lines": [{"handwritten": True, "vertical": False, "words": [{"text": "t", "vertices": [[5, 10]], "legible": False}, {"text": "u", "vertices": [], "handwritten": False}]}]}]}
    with gzip.open(tmp_path / "s.json.gz", "wt") as f:
        json.dump(scene, f)
    got = {r.text: r for r in readers.scene_annotations(spark, str(tmp_path / "s.json.gz")).collect()}
    assert got["t"].ignore and got["t"].handwritten and got["t"].polygon == [[0.5, 0.5]] and not got["u"].handwritten and not got["u"].ignore
    truth = {"valid_line": [{"words": [{"text": "z", "quad": {f"{c}{i}": i for c in "xy" for i in range(1, 5)}}]}]}
    (r,) = readers.receipts(spark.createDataFrame([("p", json.dumps(truth)), ("q", None)], "page_id string, ground_truth string")).collect()
    assert r.text == "z" and r.polygon == [[1, 1], [2, 2], [3, 3], [4, 4]]


def test_results_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"p{i}") for i in (3, 0, 2, 2, 5)], "sequence long, id string")
    assert {(r.sequence, r.fault) for r in readers.sequence_faults(rows).collect()} == {(1, "lost"), (4, "lost"), (2, "double")}
    want = spark.createDataFrame([(i, f"p{i}" if i else "other") for i in range(4)], "sequence long, id string")
    assert {(r.sequence, r.fault) for r in readers.sequence_faults(rows, want).collect()} == {(0, "another id"), (1, "lost"), (2, "double"), (5, "unexpected")}
    sinks.ordered_json(rows.dropDuplicates(), str(tmp_path / "out"))
    lines = [json.loads(x)["sequence"] for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == [0, 2, 3, 5]


def test_telemetry(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"time_ns": 1000000000, "rss_bytes": 5, "system_cpu_per_core": [1.0, 2.0]}\n{"time_ns": 3000000000}\n')
    wide = sinks.wide_telemetry(readers.telemetry(spark, str(tmp_path / "t.jsonl")), 2).orderBy("elapsed_seconds").collect()
    assert [(r.elapsed_seconds, r.cpu_0, r.cpu_1) for r in wide] == [(0.0, 1.0, 2.0), (2.0, None, None)]
    sinks.telemetry_csv(readers.telemetry(spark, str(tmp_path / "t.jsonl")), str(tmp_path / "csv"), 2)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


def test_raw_maps_and_bytes(spark, tmp_path):
    np.arange(16, dtype="<f4").tofile(tmp_path / "m.bin")
    (r,) = readers.raw_maps(spark, str(tmp_path / "m.bin"), 4).collect()
    assert r.width == 4 and r.p == list(range(16))
    with pytest.raises(Exception, match="not a map"):
        readers.raw_maps(spark, str(tmp_path / "m.bin"), 5).collect()
    rows = spark.createDataFrame([("a", 1, 2, b"123456"), ("b", 1, 1, b"1")], "id string, width int, height int, rgb binary")
    assert readers.rgb_pages(rows.where("id = 'a'")).count() == 1
    with pytest.raises(Exception, match="bytes: b"):
        readers.rgb_pages(rows).collect()
    assert sinks.provenance(spark.createDataFrame([("x", b"")], "path string, content binary")).first().sha256.startswith("e3b0c442")


def test_summary_only_of_whole_runs(spark, tmp_path):
    def fails() -> None:
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        sinks.summarised(fails, spark.range(1), str(tmp_path / "summary"))
    assert not (tmp_path / "summary").exists()


def test_pixels():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (6, 9, 3), dtype=np.uint8)
    assert (raster.resized(image, 6, 9) == image).all()
    assert np.allclose(raster.weights(100, 7).sum(1), 1)
    assert (raster.quarter_turned(raster.quarter_turned(image, 90), 270) == image).all()
    flat = np.full((4, 2, 3), 128, np.uint8)
    tensor = raster.prepared(flat, 4, 4, True, np.zeros(3), np.ones(3))
    assert tensor.shape == (3, 4, 4) and tensor[0, 0].tolist() == pytest.approx([0, 128 / 255, 128 / 255, 0])
    assert (raster.rectified(image, 0.0) == image).all()
    turned = raster.rectified(np.zeros((40, 60, 3), np.uint8), 10.0)
    assert turned.shape[0] > 40 and turned.shape[1] > 60 and turned[0, 0].tolist() == [255, 255, 255] and turned[turned.shape[0] // 2, turned.shape[1] // 2].max() == 0




def test_image_files(spark, tmp_path):
    for name in ("b.png", "a.png", "c d.png"):
        (tmp_path / name).write_bytes(name.encode())
    found = {r.id: bytes(r.content).decode() for r in readers.image_files(spark, str(tmp_path), 2).collect()}
    assert found == {f"{r}:{i}:{n}": n for r in range(2) for i, n in enumerate(("a.png", "b.png", "c d.png"))}
    assert readers.image_files(spark, str(tmp_path), 0).count() == 0


def test_metadata(spark, tmp_path):
    path, model = tmp_path / "m.json", {"mean": [0.1, 0.2, 0.3], "std": [1, 1, 1]}
    path.write_text(json.dumps({"finder": model, "reader": {**model, "vocab": "ab"}}))
    assert {r.model: (r.vocab, r.mean[0]) for r in readers.model_metadata(spark, str(path), ("finder", "reader")).collect()} == {"finder": ("", 0.1), "reader": ("ab", 0.1)}
    path.write_text(json.dumps({"finder": model}))
    with pytest.raises(Exception, match="reader"):
        readers.model_metadata(spark, str(path), ("finder", "reader")).collect()
    path.write_text(json.dumps({"input_shape": [3, 512, 512], "classes": [0, -90, 180, 90], **model}))
    assert readers.orientation_metadata(spark, str(path)).count() == 1
    path.write_text(json.dumps({"input_shape": [3, 512, 512], "classes": [0, 90, 180, 270], **model}))
    with pytest.raises(Exception, match="Unexpected page orientation"):
        readers.orientation_metadata(spark, str(path)).collect()


def test_tensors_and_asserted_results(spark, tmp_path):
    rows = spark.createDataFrame([("t", [2, 2], [1.0, 2.0, 3.0, 0.1])], "id string, shape array<int>, values array<double>")
    sinks.tensors(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).first()["values"] == [1.0, 2.0, 3.0, float(np.float32(0.1))]
    with pytest.raises(Exception, match="not of its shape"):
        sinks.tensors(rows.withColumn("shape", F.array(F.lit(3))), str(tmp_path / "u"))
    expected = spark.createDataFrame([(0, "a"), (1, "b")], "sequence long, id string")
    assert sinks.asserted(expected, expected).count() == 2
    with pytest.raises(ValueError, match="1 lost"):
        sinks.asserted(expected.where("sequence = 0"), expected)


def test_session(spark, tmp_path):
    rows = [(1, i, f"t{i}") for i in (2, 0, 1)]
    with session.Session(spark, str(tmp_path), lambda pages: pages.withColumn("text", F.upper("text"))) as s:
        for r in rows:
            s.submit(spark.createDataFrame([r], session.PAGES))
        assert [(r.sequence, r.text) for r in s] == [(0, "T0"), (1, "T1"), (2, "T2")] and s.stats == {"pages": 3, "runs": 1, "characters": 6}
        with pytest.raises(ValueError):
            s.submit(spark.createDataFrame(rows, session.PAGES))
    with pytest.raises(ValueError):
        s.finish_input()
    with session.Session(spark, str(tmp_path)) as s:
        assert s.finish_input().count() == 0
    with session.Session(spark, str(tmp_path)) as s, pytest.raises(ValueError, match="Missing page"):
        s.submit(spark.createDataFrame([(1, 1, "x")], session.PAGES))
        s.finish_input()
