"""Streams of page results: fan-in of parts, ordered emission, windows over events. Each has a batch form that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

from glyphloom.functions.config import Settings

#: What is said of faults.
DOUBLE_PAGE, DOUBLE_PART, MISSING_PAGE = "Duplicate page result", "Duplicate crop result", "Missing page before pending results"


def watch(spark: SparkSession, path: str, schema: str, settings: Settings | None = None) -> DataFrame:
    """Files of a folder as a stream; the number of files in a batch bounds what is in flight."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", (settings or Settings()).inflight).parquet(path)


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by tumbling window and type; rows more than `late` behind are left out of a stream."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("at", late) if events.isStreaming else timed
    counts = timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "n", "total")


class _Gather(StatefulProcessor):
    """Parts of a page by number, each an entry of its own; of a whole page only that it is."""

    def __init__(self, strict: bool) -> None:
        self.strict = strict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getMapState("parts", "part int", "text string")
        self.seen = handle.getValueState("seen", "n int, whole boolean")

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, whole = self.seen.get() if self.seen.exists() else (0, False)
        of = 0
        for b in rows:
            for part, total, text in zip(b["part"], b["of"], b["text"], strict=True):
                of = int(total)
                if whole or self.parts.containsKey((int(part),)):
                    if self.strict:
                        raise ValueError(DOUBLE_PART)
                    continue
                self.parts.updateValue((int(part),), (text or "",))
                n += 1
                if n == of:
                    whole = True
                    texts = sorted((k[0], v[0]) for k, v in self.parts.iterator())
                    self.parts.clear()
                    yield pd.DataFrame([(*key, "".join(t for _, t in texts))], columns=["run", "sequence", "text"])
        self.seen.update((n, whole))


class _Order(StatefulProcessor):
    """The next number of a run, and the pages that came too early, each an entry of its own: a page after a gap is written once
    and read once, however long the gap stays."""

    def __init__(self, strict: bool) -> None:
        self.strict = strict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.upto = handle.getValueState("upto", "sequence long")
        self.waiting = handle.getMapState("waiting", "sequence long", "text string")

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = self.upto.get()[0] if self.upto.exists() else 0
        for b in rows:
            out = []
            for n, text in zip(b["sequence"].tolist(), b["text"], strict=True):
                if n < upto or self.waiting.containsKey((n,)):
                    if self.strict:
                        raise ValueError(DOUBLE_PAGE)
                    continue
                if n > upto:
                    self.waiting.updateValue((n,), (text,))
                    continue
                out.append((key[0], upto, text))
                upto += 1
                while self.waiting.containsKey((upto,)):
                    out.append((key[0], upto, self.waiting.getValue((upto,))[0]))
                    self.waiting.removeKey((upto,))
                    upto += 1
            yield pd.DataFrame(out, columns=["run", "sequence", "text"])
        self.upto.update((upto,))


def _stateful(rows: DataFrame, keys: tuple[str, ...], processor: StatefulProcessor) -> DataFrame:
    """State lies in a store of entries, so that a batch writes what it changes."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows.groupBy(*keys).transformWithStateInPandas(processor, "run long, sequence long, text string", "append", "none")


def gathered(parts: DataFrame, strict: bool = True) -> DataFrame:
    """run, sequence and text of pages whose parts (run, sequence, part, of, text) have all come.

    A part that comes twice is an error if strict, also when its page is whole; else it counts once. Null texts are empty. In
    a stream the state of a page is its parts, an entry each; of a whole page it keeps no more than that it is."""
    if parts.isStreaming:
        return _stateful(parts, ("run", "sequence"), _Gather(strict))
    each = parts.groupBy("run", "sequence", "part").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("of").alias("of"), F.count("*").alias("n"))
    if strict:
        each = each.where(F.when(F.col("n") > 1, F.raise_error(F.lit(DOUBLE_PART))).otherwise(True))
    pages = each.groupBy("run", "sequence").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("p"), F.max("of").alias("of"))
    return pages.where(F.size("p") == F.col("of")).select("run", "sequence", F.array_join("p.text", "").alias("text"))


def in_order(results: DataFrame, strict: bool = True) -> DataFrame:
    """run, sequence, text of a stream let out in order, up to the first number that is missing; what came too early is kept.

    A number that comes twice is an error if strict; else it counts once. State is kept by run, so that runs go on beside
    each other. What is still kept at the end is found by `pending`, and is an error to `finished`."""
    return _stateful(results, ("run",), _Order(strict))


def pending(spark: SparkSession, folder: str) -> DataFrame:
    """Of a stream of `in_order` that run_to_end ran in a folder: run, missing (the first number that did not come) and waiting, how many pages
    behind it are kept. It is read from the stream's own state; runs that keep nothing are left out."""
    state = spark.read.format("statestore").option("path", f"{folder}/state")
    upto = state.option("stateVarName", "upto").load().select(F.col("key.run").alias("run"), F.col("value.sequence").alias("missing"))
    kept = state.option("stateVarName", "waiting").load().select(F.col("key.run").alias("run"))
    return kept.groupBy("run").agg(F.count("*").alias("waiting")).join(upto, "run").select("run", "missing", "waiting")


def finished(emitted: DataFrame, results: DataFrame) -> DataFrame:
    """emitted, once a run has ended: an error if results (a table of all that came) has a page that was never let out."""
    if not results.join(emitted, ["run", "sequence"], "left_anti").isEmpty():
        raise ValueError(MISSING_PAGE)
    return emitted


def run_to_end(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that there is and gives what it wrote as Parquet, beside its checkpoint.

    Append: batches written twice are never read twice. Complete: each batch replaces the table before it."""
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/rows").start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{folder}/rows")).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
