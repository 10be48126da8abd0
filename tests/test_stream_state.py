"""State of ordered streams: entries of their own, read again after a restart, and what they still hold."""

from __future__ import annotations

from glyphloom.streaming import pages as streams

SCHEMA = "run long, sequence long, text string"


def add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def go(spark, folder):
    rows = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    return sorted(map(tuple, streams.run_to_end(streams.in_order(rows), f"{folder}/out").collect()))


def test_a_gap_that_is_filled_after_a_restart(spark, tmp_path):
    folder = str(tmp_path)
    add(spark, folder, [(1, 0, "a"), (1, 2, "c"), (1, 4, None), (2, 0, "x")])
    assert go(spark, folder) == [(1, 0, "a"), (2, 0, "x")]
    assert [tuple(r) for r in streams.pending(spark, f"{folder}/out").collect()] == [(1, 1, 2)]
    add(spark, folder, [(1, 1, "b")])
    assert go(spark, folder) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "x")]
    assert [tuple(r) for r in streams.pending(spark, f"{folder}/out").collect()] == [(1, 3, 1)]
    add(spark, folder, [(1, 3, "d")])
    assert go(spark, folder)[:5] == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d"), (1, 4, None)]
    assert streams.pending(spark, f"{folder}/out").count() == 0


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    """Two hundred pages wait behind a gap; the next batch touches its own page alone."""
    folder = str(tmp_path)
    add(spark, folder, [(1, n, "text " * 200) for n in range(1, 201)])

    def last(rows):
        query = streams.in_order(rows).writeStream.format("noop").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return query.lastProgress.stateOperators[0]

    rows = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    assert last(rows).numRowsTotal >= 201
    add(spark, folder, [(1, 300, "one more")])
    after = last(rows)
    assert after.numRowsTotal >= 202 and after.numRowsUpdated < 10
