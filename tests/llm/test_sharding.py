"""op13: every row once, counts, slots, and an order that is random but the same again."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from glyphloom.llm import sharding

DOCS = "doc_id long, text string, row string, bucket long, slot int, shard string"


def docs(spark, texts, partitions=3):
    return spark.createDataFrame([(None if i == 1 else i // 2, t, "clash", i % 3, None, "x") for i, t in enumerate(texts)], DOCS).repartition(partitions, "text")


def laid(found, shards):
    """Rows by shard, in the order of their slots, which have no gaps."""
    out = [[] for _ in range(shards)]
    for r in sorted(found.collect(), key=lambda r: (r.shard, r.slot)):
        assert r.slot == len(out[r.shard])
        out[r.shard].append(tuple(r.row))
    sizes = [len(x) for x in out]
    assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
    return out


@pytest.mark.parametrize("n,shards", [(0, 8), (3, 8), (8, 8), (101, 8), (60, 7)])
def test_each_row_once(spark, n, shards):
    texts = [(None, "", "same", f"t{i} é")[i % 4] for i in range(n)]
    given = docs(spark, texts)
    out = laid(sharding.sharded(given, shards, bucket_bytes=50), shards)
    assert Counter(r for some in out for r in some) == Counter(map(tuple, given.collect()))


def test_reruns_agree_and_seeds_differ(spark):
    given = docs(spark, [f"text {i}" for i in range(200)])
    first, again, other = (laid(sharding.sharded(given, 4, seed=s, bucket_bytes=300), 4) for s in (1, 1, 2))
    assert first == again and first != other


def test_one_row_that_most_rows_equal_is_dealt_apart(spark):
    given = spark.createDataFrame([(7, "copy")] * 3000 + [(i, "x") for i in range(100)], "doc_id long, text string")
    found, n = sharding.shuffled(given, bucket_bytes=500)
    assert n == 3100
    position = [r.position for r in found.where("row.text = 'x'").collect()]
    assert len(set(position)) == 100 and 1200 < np.mean(position) < 1900
    out = laid(sharding.sharded(given, bucket_bytes=500), 8)
    assert all(2 <= sum(r[1] == "x" for r in some) <= 30 for some in out)


def test_starts_are_joined_alike_without_broadcast(spark, monkeypatch):
    given = docs(spark, [f"text {i}" for i in range(50)])
    want = laid(sharding.sharded(given, 4, bucket_bytes=40), 4)
    monkeypatch.setattr(sharding, "BROADCAST_ROWS", 0)
    assert laid(sharding.sharded(given, 4, bucket_bytes=40), 4) == want


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(sharding.fisher_yates(4, [5, i]).tolist()) for i in range(24_000))
    assert len(seen) == 24 and min(seen.values()) > 850 and max(seen.values()) < 1150
    assert sharding.fisher_yates(0, [1]).tolist() == [] and sharding.fisher_yates(1, [1]).tolist() == [0]


def test_buckets_over_many_batches():
    rows = pa.table({"row": pa.array([{"v": i} for i in range(50)]), "bucket": pa.array([i // 17 for i in range(50)], pa.int64())})
    got = pa.Table.from_batches(list(sharding._shuffled(3)(iter(rows.to_batches(4))))).to_pylist()
    for k in range(3):
        own = [r for r in got if r["bucket"] == k]
        assert [r["place"] for r in own] == list(range(len(own)))
        assert sorted(r["row"]["v"] for r in own) == list(range(17 * k, min(17 * k + 17, 50))) and [r["row"]["v"] for r in own] != sorted(r["row"]["v"] for r in own)


def test_written_shards(spark, tmp_path):
    given = docs(spark, [f"text {i}" for i in range(40)] + [None])
    sharding.write_shards(given, str(tmp_path / "out"), 4, bucket_bytes=60)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(tuple(r.row) for r in back.collect()) == Counter(map(tuple, given.collect()))
    for k in range(4):
        assert sorted(r.slot for r in back.where(f"shard = {k}").collect()) == list(range(11 if k == 0 else 10))


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    got = sharding.op13_sharding(spark, folder)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = got.collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(rows) == len(texts) and {r.law for r in rows} == {"rows"}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), None)
