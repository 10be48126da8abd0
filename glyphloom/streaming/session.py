"""A session of pages: batches are submitted, a stream works on them, results come out in order."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from glyphloom.streaming.pages import finished, in_order, run_to_end

PAGES = "run long, sequence long, text string"


class Session:
    """Pages are submitted as DataFrames (run, sequence, text) into a folder that the cluster shares; `work` makes their results of a
    stream of them. After finish_input the results can be read in order, as a DataFrame or one by one; a double or a
    missing page is an error then. Closed, or left by an error, a session takes no more pages."""

    def __init__(self, spark: SparkSession, folder: str, work: Callable[[DataFrame], DataFrame] = lambda pages: pages, inflight: int = 64) -> None:
        self.spark, self.work, self.inflight = spark, work, inflight
        self.folder = f"{folder}/session-{uuid.uuid4().hex}"
        self.closed, self.done = False, None

    def submit(self, pages: DataFrame) -> None:
        if self.closed or self.done is not None:
            raise ValueError("the session takes no more pages")
        pages.select("run", "sequence", "text").write.mode("append").parquet(f"{self.folder}/in")

    def finish_input(self) -> DataFrame:
        """Runs the stream to the end of what was submitted, once, and gives the results."""
        if self.closed:
            raise ValueError("the session is closed")
        if self.done is None:
            self.spark.createDataFrame([], PAGES).write.mode("append").parquet(f"{self.folder}/in")
            pages = self.spark.readStream.schema(PAGES).option("maxFilesPerTrigger", self.inflight).parquet(f"{self.folder}/in")
            emitted = run_to_end(in_order(self.work(pages)), f"{self.folder}/out")
            self.done = finished(emitted, self.spark.read.schema(PAGES).parquet(f"{self.folder}/in"))
        return self.done

    def __iter__(self) -> Iterator[Row]:
        """Results by run and sequence, a part at a time."""
        return iter(self.finish_input().orderBy("run", "sequence").toLocalIterator())

    @property
    def stats(self) -> dict[str, Any]:
        if self.done is None:
            raise ValueError("stats are there when the input is finished")
        return self.done.agg(F.count("*").alias("pages"), F.countDistinct("run").alias("runs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters")).first().asDict()

    def close(self) -> None:
        self.closed = True

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
