"""Queues of pages in shared folders: a push source with offsets, a sink that commits by batch, and a replay that stops by time.

    push        Pusher.push appends a segment of rows; the stream `pushed` reads segments by number. An offset is a number of segments, so
                that a query that fails or is restarted reads again exactly what it had not committed; then segments are dropped.
    results     the stream writer leaves a batch's parts aside until all tasks are done, and lists them in one file; a batch that fails
                leaves nothing to read, a batch that is run again replaces itself. `results` gives each page once.
    replay      numbers 0, 1, ... of pages of a corpus that is read over and over, a whole corpus a batch; it stops before the next one
                once the time is over, or at a number of pages.

Folders are read and written by Arrow's file systems (a local path, or hdfs://, s3:// and what else they know), by the driver and by the executors.
Both queues are bounded: a push waits while too many segments are not committed, a commit while too many batches are not taken.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

WAIT = 0.05


class Folder:
    """Files of one folder, which appear whole or not at all."""

    def __init__(self, path: str) -> None:
        self.fs, self.path = pafs.FileSystem.from_uri(path)
        self.fs.create_dir(self.path)

    def names(self, suffix: str) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(self.path, allow_not_found=True))
        return sorted(i.base_name for i in found if i.base_name.endswith(suffix))

    def write(self, name: str, data: bytes) -> None:
        aside = f"{self.path}/{uuid.uuid4().hex}.aside"
        with self.fs.open_output_stream(aside) as f:
            f.write(data)
        self.fs.move(aside, f"{self.path}/{name}")

    def read(self, name: str) -> bytes:
        with self.fs.open_input_stream(f"{self.path}/{name}") as f:
            return f.read()

    def drop(self, name: str) -> None:
        try:
            self.fs.delete_file(f"{self.path}/{name}")
        except FileNotFoundError:
            pass


def _packed(batches: list[pa.RecordBatch], schema: pa.Schema) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, schema) as w:
        for b in batches:
            w.write_batch(b)
    return out.getvalue().to_pybytes()


def _await(done: Callable[[], bool], seconds: float, what: str) -> None:
    end = time.monotonic() + seconds
    while not done():
        if time.monotonic() > end:
            raise TimeoutError(what)
        time.sleep(WAIT)


# push


class Pusher:
    """The side that submits: rows as dicts, of a schema in DDL. At most `bound` segments wait for the stream's commits; a push of more
    waits, and fails after `patience` seconds. One pusher writes to a folder; a new one goes on where the last one ended."""

    def __init__(self, folder: str, schema: str, bound: int = 64, patience: float = 60.0) -> None:
        self.files, self.schema = Folder(folder), to_arrow_schema(StructType.fromDDL(schema))
        self.bound, self.patience, self.closed = bound, patience, False
        ends = [int(n.split(".")[0]) + 1 for n in self.files.names(".arrow")]
        self.next = max([*ends, *(int(n.split(".")[0]) for n in self.files.names(".committed"))], default=0)

    def push(self, rows: list[dict]) -> int:
        """Appends a segment and gives its number; rows that don't fit the schema, and pushes after `finish`, are errors."""
        if self.closed:
            raise ValueError("Input already finished")
        data = _packed([pa.RecordBatch.from_pylist(rows, self.schema)], self.schema)
        _await(lambda: len(self.files.names(".arrow")) < self.bound, self.patience, f"{self.bound} segments wait for a commit")
        self.files.write(f"{self.next:012}.arrow", data)
        self.next += 1
        return self.next - 1

    def finish(self) -> None:
        self.closed = True


class _Segment(InputPartition):
    def __init__(self, name: str) -> None:
        self.name = name


class _PushReader(DataSourceStreamReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def _committed(self, files: Folder) -> int:
        return max((int(n.split(".")[0]) for n in files.names(".committed")), default=0)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"segments": self._committed(Folder(self.folder))}

    def latestOffset(self) -> dict:  # noqa: N802
        files = Folder(self.folder)
        return {"segments": max((int(n.split(".")[0]) + 1 for n in files.names(".arrow")), default=self._committed(files))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Segment(f"{i:012}.arrow") for i in range(start["segments"], end["segments"])]

    def read(self, partition: _Segment) -> Iterator[pa.RecordBatch]:
        yield from pa.ipc.open_stream(Folder(self.folder).read(partition.name))

    def commit(self, end: dict) -> None:
        """What is committed is not asked for again: the mark comes before segments go."""
        files = Folder(self.folder)
        files.write(f"{end['segments']:012}.committed", b"")
        for name in files.names(".arrow") + files.names(".committed"):
            if int(name.split(".")[0]) < end["segments"]:
                files.drop(name)


class PushSource(DataSource):
    """Format `push`: options path and schema (DDL)."""

    @classmethod
    def name(cls) -> str:
        return "push"

    def schema(self) -> str:
        return self.options["rowSchema"]

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _PushReader(self.options["path"])


def pushed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The stream of what a Pusher appends to a folder."""
    spark.dataSource.register(PushSource)
    return spark.readStream.format("push").option("path", folder).option("rowSchema", schema).load()


# results


class _Part(WriterCommitMessage):
    def __init__(self, name: str, rows: int) -> None:
        self.name, self.rows = name, rows


class _ResultWriter(DataSourceStreamWriter):
    def __init__(self, folder: str, schema: StructType, bound: int, patience: float) -> None:
        self.folder, self.schema, self.bound, self.patience = folder, schema, bound, patience

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        arrow = to_arrow_schema(self.schema)
        rows = [r.asDict() for r in iterator]
        name = f"{uuid.uuid4().hex}.part"
        if rows:
            Folder(self.folder).write(name, _packed([pa.RecordBatch.from_pylist(rows, arrow)], arrow))
        return _Part(name if rows else "", len(rows))

    def commit(self, messages: list[_Part | None], batchId: int) -> None:  # noqa: N803
        files, name = Folder(self.folder), f"{batchId:012}.batch"
        taken = max((int(n.split(".")[0]) for n in files.names(".taken")), default=-1)
        if batchId <= taken:  # it had been given before it was run again
            return self.abort(messages, batchId)
        _await(lambda: name in files.names(".batch") or len(files.names(".batch")) < self.bound, self.patience, f"{self.bound} batches wait for their consumer")
        files.write(name, json.dumps([m.name for m in messages if m and m.name]).encode())

    def abort(self, messages: list[_Part | None], batchId: int) -> None:  # noqa: N803
        for m in messages:
            if m and m.name:
                Folder(self.folder).drop(m.name)


class ResultSink(DataSource):
    """Format `results`: options path, bound and patience."""

    @classmethod
    def name(cls) -> str:
        return "results"

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return _ResultWriter(self.options["path"], schema, int(self.options.get("bound", "64")), float(self.options.get("patience", "60")))


def delivered(stream: DataFrame, folder: str, state: str, bound: int = 64, patience: float = 60.0, once: bool = False) -> StreamingQuery:
    """Starts a stream that delivers its rows to the consumer of a folder; `state` is its checkpoint."""
    stream.sparkSession.dataSource.register(ResultSink)
    writer = stream.writeStream.format("results").option("path", folder).option("bound", bound).option("patience", patience).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if once else writer).start()


def results(folder: str) -> Iterator[dict]:
    """Rows of committed batches in order, each once over all calls: a batch is marked as taken after its last row was given, and
    goes. What is there now is given; call again for more."""
    files = Folder(folder)
    taken = max((int(n.split(".")[0]) for n in files.names(".taken")), default=-1)
    for name in files.names(".batch"):
        number = int(name.split(".")[0])
        parts = json.loads(files.read(name))
        if number > taken:
            for part in parts:
                for b in pa.ipc.open_stream(files.read(part)):
                    yield from b.to_pylist()
            files.write(f"{number:012}.taken", b"")
            if taken >= 0:
                files.drop(f"{taken:012}.taken")
            taken = number
        files.drop(name)
        for part in parts:
            files.drop(part)


# replay


class _Turn(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


class _ReplayReader(DataSourceStreamReader):
    """An offset has the numbers given so far, when the first was asked for, and whether it is over; so a restart goes on by the same clock."""

    def __init__(self, size: int, pages: int, seconds: float, tasks: int) -> None:
        self.size, self.pages, self.seconds, self.tasks = size, pages, seconds, tasks
        self.last: dict | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0, "began": time.time(), "over": False}

    def latestOffset(self) -> dict:  # noqa: N802
        now = self.last or self.initialOffset()
        if not now["over"]:
            at = now["at"]
            over = at >= self.pages if self.pages else at > 0 and time.time() - now["began"] >= self.seconds
            now = {**now, "over": True} if over else {**now, "at": min(at + self.size, self.pages or at + self.size)}
        self.last = now
        return now

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.last = self.last or end
        n, at = end["at"] - start["at"], start["at"]
        cuts = [at + n * i // self.tasks for i in range(self.tasks + 1)]
        return [_Turn(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b] or [_Turn(at, at)]

    def read(self, partition: _Turn) -> Iterator[tuple]:
        for i in range(partition.start, partition.end):
            yield i, i % self.size, i // self.size


class ReplaySource(DataSource):
    """Format `replay`: options size (pages of the corpus), pages (0: stop by seconds), seconds and tasks."""

    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return "sequence long, page long, turn long"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        o = self.options
        return _ReplayReader(int(o["size"]), int(o.get("pages", "0")), float(o.get("seconds", "0")), int(o.get("tasks", "8")))


def replayed(spark: SparkSession, size: int, pages: int = 0, seconds: float = 0.0) -> DataFrame:
    """sequence, page and turn of a corpus of `size` pages that is read over and over: `pages` in all if given, else as many whole corpora,
    one at least, as begin within `seconds`. Joined with the numbered corpus by page it is the feed of a benchmark run."""
    if size < 1:
        raise ValueError("Empty workload")
    spark.dataSource.register(ReplaySource)
    return spark.readStream.format("replay").option("size", size).option("pages", pages).option("seconds", seconds).option("tasks", spark.sparkContext.defaultParallelism).load()


def run_replay(query: StreamingQuery) -> StreamingQuery:
    """Waits until a query over `replayed` has worked on all of it, and stops it; its errors are raised."""
    while query.isActive:
        told = query.lastProgress
        if told and any((s["endOffset"] or {}).get("over") for s in json.loads(told.json)["sources"]):
            query.stop()
        query.awaitTermination(WAIT)
    if query.exception():
        raise query.exception()
    return query
