"""Cutting lineage in the shared folder, and helpers that several operators use."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of most operators: runs without ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: A key with more than one row in so many is hot.
HOT_SHARE = 1000
#: Keys of documents that go to all tasks; more are joined.
BROADCAST_ROWS = 500_000
#: Bits that go to all tasks for each of many keys, and of all together (32 MB).
KEY_BITS = 8
MOST_BITS = 1 << 28


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; where it names none, a local session (tests) gets one of this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df into the shared folder and reads it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts; 52 bits, so that it is exact in a double."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def row_key(documents: DataFrame) -> Column:
    """A hash of all columns of a row."""
    return F.xxhash64(*(F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else documents[f.name] for f in documents.schema.fields))


def hot_keys(counts: DataFrame, key: str, n: str = "n") -> list:
    """The keys that hold over 1/HOT_SHARE of the rows that counts(key, n) sums up: fewer than HOT_SHARE of them, whatever the table."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counts.where(F.col(n) > max(total // HOT_SHARE, 1)).select(key).collect()]


def join_dealt(left: DataFrame, right: DataFrame, key: str, hot: list) -> DataFrame:
    """left joined with right, which has a row for each key: the rows of hot keys stay where they are and get the few rows of
    right that they need by broadcast; only the others are dealt by key."""
    if not hot:
        return left.join(right, key)
    of = F.col(key).isin(hot)
    some = left.where(of).join(F.broadcast(right.where(of)), key)
    return some.unionByName(left.where(~of).join(right.where(~of), key))


def likely_among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """All rows whose key is in keys, and few others, found where they stand: bitmaps of the keys' hashes go to all tasks, so that only
    these rows need be dealt for a join. Beyond MOST_BITS / KEY_BITS keys more others stay."""
    if rows.schema[key].dataType != keys.schema[key].dataType:
        return rows
    bits = min(MOST_BITS, max(1, KEY_BITS * keys.count()))
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    at = F.bitmap_bucket_number(place).alias("_part"), F.bitmap_bit_position(place).alias("_bit")
    maps = keys.select(*at).repartition("_part").groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    byte = F.conv(F.hex(F.substring(F.col("_map"), (F.floor(F.col("_bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return rows.select("*", *at).join(F.broadcast(maps), "_part").where(F.getbit(byte, F.pmod("_bit", F.lit(8)).cast("int")) == 1).select(*rows.columns)


def small(rows: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether a table of keys may go to all tasks."""
    return rows.limit(most + 1).count() <= most


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows, or all if there are no more; by the hash of a column, so that reruns and machines agree."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < (most << 40) // n)
