"""The folder that the driver and all executors share, and tables that are cut off from their lineage there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the one that spark.checkpoint.dir names; without that setting a local session (tests) gets one of its machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        named = tempfile.mkdtemp(prefix="shared-")
    return f"{named}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str = "table", at_once: int | None = None) -> DataFrame:
    """df as Parquet in a new shared folder, read from there: what follows reads it as often as it likes, and lost executors lose nothing.

    `at_once` is how many rows a row group has at most; without it readers take some thousand rows at once, too many where a row is a map."""
    folder = shared_folder(df.sparkSession, kind)
    writer = df.write if at_once is None else df.write.option("parquet.block.row.count.limit", at_once)
    writer.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
