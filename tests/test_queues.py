"""Push source, committing sink and replay: nothing is lost or doubled by restarts and failures."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from glyphloom.sources import readers
from glyphloom.streaming import queues

PAGES = "id string, width int, height int, rgb binary"


def page(i, side=2):
    return {"id": f"p{i}", "width": side, "height": side, "rgb": bytes([i % 256] * (side * side * 3))}


def run(spark, tmp_path, work=lambda df: df, bound=64):
    return queues.delivered(work(readers.rgb_pages(queues.pushed(spark, str(tmp_path / "in"), PAGES))).select("id", F.octet_length("rgb").alias("size")), str(tmp_path / "out"), str(tmp_path / "state"), bound, once=True)


def test_pages_are_pushed_through_a_stream_once(spark, tmp_path):
    pusher = queues.Pusher(str(tmp_path / "in"), PAGES)
    for k in range(3):
        pusher.push([page(10 * k + i) for i in range(10)])
    run(spark, tmp_path).awaitTermination()
    out = str(tmp_path / "out")
    first = list(queues.results(out))
    assert sorted(r["id"] for r in first) == sorted(f"p{i}" for i in range(30)) and {r["size"] for r in first} == {12}
    assert list(queues.results(out)) == []
    again = queues.Pusher(str(tmp_path / "in"), PAGES)  # a new pusher goes on by number
    assert again.push([page(99)]) == 3
    again.push([])
    run(spark, tmp_path).awaitTermination()
    assert [r["id"] for r in queues.results(out)] == ["p99"]
    again.finish()
    with pytest.raises(ValueError):
        again.push([page(1)])


def test_a_failed_batch_is_run_again_after_a_restart(spark, tmp_path):
    pusher = queues.Pusher(str(tmp_path / "in"), PAGES)
    pusher.push([page(1), page(2)])
    run(spark, tmp_path).awaitTermination()
    pusher.push([page(3)])
    pusher.push([{**page(4), "width": 3}])
    failed = run(spark, tmp_path)
    with pytest.raises(Exception, match="width \\* height"):
        failed.awaitTermination()
    assert sorted(r["id"] for r in queues.results(str(tmp_path / "out"))) == ["p1", "p2"]  # nothing of the failed batch
    mend = lambda df: df
    source = queues.pushed(spark, str(tmp_path / "in"), PAGES).withColumn("width", F.lit(2))
    queues.delivered(mend(readers.rgb_pages(source)).select("id", F.octet_length("rgb").alias("size")), str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    assert sorted(r["id"] for r in queues.results(str(tmp_path / "out"))) == ["p3", "p4"]
    assert list(queues.results(str(tmp_path / "out"))) == []


def test_a_batch_that_was_taken_is_not_given_again(tmp_path):
    from pyspark.sql import Row
    from pyspark.sql.types import StructType

    writer = queues._ResultWriter(str(tmp_path), StructType.fromDDL("id string"), 2, 0.2)
    part = lambda *ids: writer.write(iter([Row(id=i) for i in ids]))
    writer.commit([part("a"), part(), None], 0)
    writer.commit([part("b")], 1)
    writer.commit([part("b")], 1)  # the same batch again, before it is taken
    with pytest.raises(TimeoutError):  # two batches wait
        writer.commit([part("c")], 2)
    assert [r["id"] for r in queues.results(str(tmp_path))] == ["a", "b"]
    writer.commit([part("b")], 1)  # and after
    writer.commit([part("c")], 2)
    lost = part("d")
    writer.abort([lost], 3)
    assert lost.name not in queues.Folder(str(tmp_path)).names(".part")
    halfway = queues.results(str(tmp_path))
    assert next(halfway)["id"] == "c"
    halfway.close()  # a consumer that fails within a batch gets it again
    assert [r["id"] for r in queues.results(str(tmp_path))] == ["c"]


def test_pushes_are_bounded(tmp_path):
    pusher = queues.Pusher(str(tmp_path), PAGES, bound=2, patience=0.2)
    pusher.push([page(1)])
    pusher.push([page(2)])
    with pytest.raises(TimeoutError):
        pusher.push([page(3)])
    reader = queues._PushReader(str(tmp_path))
    assert reader.initialOffset() == {"segments": 0} and reader.latestOffset() == {"segments": 2}
    reader.commit({"segments": 1})
    assert pusher.push([page(3)]) == 2 and reader.initialOffset() == {"segments": 1} and len(reader.partitions({"segments": 1}, reader.latestOffset())) == 2


def replay(spark, tmp_path, name, **options):
    found = queues.replayed(spark, 5, **options)
    query = found.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
    queues.run_replay(query)
    return sorted(tuple(r) for r in spark.read.schema("sequence long, page long, turn long").parquet(str(tmp_path / name)).collect())


def test_replay_stops_at_whole_corpora_or_at_pages(spark, tmp_path):
    whole = lambda n: [(i, i % 5, i // 5) for i in range(n)]
    assert replay(spark, tmp_path, "once", seconds=0.0) == whole(5)
    assert replay(spark, tmp_path, "pages", pages=12) == whole(12)
    began = time.time()
    rows = replay(spark, tmp_path, "timed", seconds=2.5)
    assert rows == whole(len(rows)) and len(rows) % 5 == 0 and len(rows) >= 10 and time.time() - began > 2.5
    assert replay(spark, tmp_path, "timed", seconds=2.5) == rows  # a restart of what is over adds nothing
    with pytest.raises(ValueError, match="Empty workload"):
        queues.replayed(spark, 0)


def test_replay_by_a_clock(monkeypatch):
    now = [100.0]
    monkeypatch.setattr(queues.time, "time", lambda: now[0])
    reader = queues._ReplayReader(4, 0, 10.0, 3)
    first = reader.latestOffset()
    assert first == {"at": 4, "began": 100.0, "over": False}
    now[0] = 109.9
    assert reader.latestOffset()["at"] == 8
    now[0] = 110.0
    assert reader.latestOffset() == reader.latestOffset() == {"at": 8, "began": 100.0, "over": True}
    restarted = queues._ReplayReader(4, 0, 10.0, 3)
    assert [(p.start, p.end) for p in restarted.partitions({"at": 4, "began": 100.0, "over": False}, {"at": 8, "began": 100.0, "over": False})] == [(4, 5), (5, 6), (6, 8)]
    assert restarted.latestOffset()["over"]
