"""Shards in random order by an external shuffle of two passes.

1. Every row is scattered to one of the buckets by a seeded hash of its content and of its place in the input, so that rows
   that are equal, however many, go apart. Buckets are as many that each holds BUCKET_BYTES on average.
2. A task reads its buckets one by one, in the order of the hash (with spills), shuffles each by Fisher and Yates with a
   generator seeded by the bucket, and writes it to the shared folder.
Buckets follow each other; prefix sums of their counts place each row among all. The places are cut into shards of counts
at most one apart (law `rows`), whose slots are gapless.

Given the same files, split alike, and seed, reruns agree. Tasks that are run again write the same rows, as long as the input
gives the same rows in the same order again, as files and checkpoints do.

Defined results: a null text has no bytes (size 1) and CRC 0; null ids are kept; repeated rows are dealt one by one; with fewer
rows than shards the last shards are empty; an empty table gives an empty result; rows keep all columns, whatever their names.
A task holds one bucket: a row larger than a bucket makes its bucket as large as itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm._shared import BROADCAST_ROWS, row_key, shared_folder, small, table
from glyphloom.llm.mixing import prefixed

SHARDS = 8
SEED = 42
#: Bytes of a bucket on average: those of texts, and ROW_BYTES a row.
BUCKET_BYTES = 16 << 20
ROW_BYTES = 100


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A permutation of n places: from the last to the second, each changes with one drawn from itself and those before it."""
    drawn = np.random.Generator(np.random.PCG64(seed)).integers(0, np.arange(n, 0, -1), dtype=np.int64).tolist()
    order = list(range(n))
    for i, j in zip(range(n - 1, 0, -1), drawn):  # noqa: B905
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def _shuffled(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by bucket; each bucket, once it is whole, in its new order with the place of each row."""
        held: list[pa.RecordBatch] = []
        current = None

        def written() -> Iterator[pa.RecordBatch]:
            bucket = pa.Table.from_batches(held)
            order = fisher_yates(bucket.num_rows, [seed, current])
            place = 0
            for part in np.array_split(order, -(-len(order) // 1000)):
                rows = bucket.take(pa.array(part)).combine_chunks().to_batches()
                for b in rows:
                    yield pa.RecordBatch.from_arrays([b.column("row"), b.column("bucket"), pa.array(np.arange(place, place + b.num_rows))], names=["row", "bucket", "place"])
                    place += b.num_rows

        for b in batches:
            buckets = b.column("bucket").to_numpy()
            starts = np.flatnonzero(np.diff(buckets, prepend=-1)).tolist()
            for i, j in zip(starts, [*starts[1:], len(buckets)], strict=True):
                if held and buckets[i] != current:
                    yield from written()
                    held = []
                current = int(buckets[i])
                held.append(b.slice(i, j - i))
        if held:
            yield from written()

    return run


def shuffled(documents: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """row (a struct of all columns) and position, from 0 without gaps, in random order; and how many there are."""
    spark = documents.sparkSession
    size = documents.agg(F.sum(F.coalesce(F.octet_length(documents["text"]), F.lit(0)).cast("long") + ROW_BYTES)).first()[0] or 0
    # Sessions size their partitions for their tasks; there are no fewer buckets than these.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))
    key = F.xxhash64(F.lit(seed), row_key(documents), F.monotonically_increasing_id())
    scattered = documents.select(F.struct(*documents.columns).alias("row"), key.alias("key"), F.pmod(key, F.lit(buckets)).alias("bucket"))
    sorted_ = scattered.repartition(buckets, "bucket").sortWithinPartitions("bucket", "key").select("row", "bucket")
    folder = f"{shared_folder(spark)}/shuffle-{uuid.uuid4().hex}"
    kind = sorted_.schema["row"].dataType.simpleString()
    sorted_.mapInArrow(_shuffled(seed), f"row {kind}, bucket long, place long").write.parquet(folder)
    written = spark.read.parquet(folder)
    counts = written.groupBy("bucket").agg(F.count("*").alias("n"))
    starts = prefixed(counts, [F.col("bucket")], start=F.col("n"))
    n = starts.agg(F.sum("n")).first()[0] or 0
    starts = starts.select("bucket", "start")
    starts = F.broadcast(starts) if small(starts, BROADCAST_ROWS) else starts
    return written.join(starts, "bucket").select("row", (F.col("start") + F.col("place")).alias("position")), n


def sharded(documents: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """row, shard and slot: the first shards hold one row more where the rows don't share out evenly."""
    found, n = shuffled(documents, seed, bucket_bytes)
    each, more = divmod(n, shards)
    longer = more * (each + 1)  # the places of shards with one row more
    at = F.col("position")
    shard = F.when(at < longer, F.floor(at / (each + 1))).otherwise(F.lit(more) + F.floor((at - longer) / max(each, 1))).cast("int")
    first = F.when(F.col("shard") <= more, F.col("shard") * F.lit(each + 1).cast("long")).otherwise(F.lit(longer) + (F.col("shard") - more) * F.lit(each).cast("long"))
    return found.withColumn("shard", shard).select("row", "shard", (at - first).cast("long").alias("slot"))


def write_shards(documents: DataFrame, folder: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Writes Parquet below folder/shard=0 and so on; each file holds a run of slots (column slot) in order, a task writes to few shards."""
    sharded(documents, shards, seed, bucket_bytes).write.partitionBy("shard").parquet(folder)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharded(table(spark, sf_dir, "documents"))
    text = F.col("row.text")
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
