"""Readers of workloads, annotations, results, telemetry and raw maps. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = "struct<text: string, polygon: array<array<double>>, region: string, ignore: boolean>"
WORKLOAD = "pages array<struct<id: string, image: string>>"
MANIFEST = f"pages array<struct<id: string, dataset: string, split: string, image: string, width: int, height: int, words: array<{WORD}>>>"
FORM = "form array<struct<label: string, words: array<struct<text: string, box: array<double>>>>>"
SCENE = "image_id string, image_width int, image_height int, paragraphs array<struct<lines: array<struct<handwritten: boolean, vertical: boolean, words: array<struct<text: string, vertices: array<array<double>>, legible: boolean, handwritten: boolean, vertical: boolean>>>>>>"
RESULT = "sequence long, page long, id string, words array<struct<polygon: array<array<float>>, objectness: float, text: string, confidence: float>>"
TELEMETRY = "time_ns long, gpu_util_pct double, device_vram_bytes long, rss_bytes long, process_cpu_pct double, system_cpu_per_core array<double>"


def _counted(rows: DataFrame, message: str) -> DataFrame:
    if rows.isEmpty():
        raise ValueError(message)
    return rows


def workload(spark: SparkSession, path: str) -> DataFrame:
    """place, id and image of the pages of a workload; one without pages is an error."""
    rows = spark.read.schema(WORKLOAD).json(path, multiLine=True)
    return _counted(rows.select(F.posexplode("pages").alias("place", "p")).select("place", "p.id", "p.image"), "a workload without pages")


def replayed(pages: DataFrame, rows: int) -> DataFrame:
    """Pages (place, ...) in turn until there are so many rows, numbered by sequence: a join on place, with no loop."""
    n = pages.count()
    turns = pages.sparkSession.range(rows).select(F.col("id").alias("sequence"), F.pmod("id", F.lit(n)).cast("int").alias("place"))
    return turns.join(pages, "place")


def normalised(polygon: Column, width: Column, height: Column) -> Column:
    """Vertices as shares of the page."""
    return F.transform(polygon, lambda p: F.array(p[0] / F.greatest(width, F.lit(1)), p[1] / F.greatest(height, F.lit(1))))


def quad(box: Column) -> Column:
    """The four corners of x0, y0, x1, y1, from the upper left, clockwise."""
    return F.array(*(F.array(box[i], box[j]) for i, j in ((0, 1), (2, 1), (2, 3), (0, 3))))


def manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Pages, and their labels one row a word; pages without labels stay among the pages."""
    pages = spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.explode("pages").alias("p")).select("p.*")
    words = pages.select(F.col("id").alias("page_id"), F.posexplode("words").alias("idx", "w")).select("page_id", "idx", "w.*")
    return pages.drop("words"), words


def form_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Words of annotated forms, a file a page: page_id, idx, text, polygon, region; empty texts are left out."""
    rows = spark.read.schema(FORM).json(path, multiLine=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("page_id"), F.posexplode("form").alias("block", "f"))
    words = rows.select("page_id", "block", "f.label", F.posexplode("f.words").alias("place", "w")).where(F.trim("w.text") != "")
    order = Window.partitionBy("page_id").orderBy("block", "place")
    return words.select("page_id", (F.row_number().over(order) - 1).alias("idx"), "w.text", quad(F.col("w.box")).alias("polygon"), F.col("label").alias("region"))


def scene_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Words of scene texts, paragraph by line by word, also from gzip; illegible ones are ignored, flags come from the line where the word has none."""
    lines = spark.read.schema(SCENE).json(path, multiLine=True).select("image_id", "image_width", "image_height", F.explode("paragraphs.lines").alias("ls")).select("*", F.explode("ls").alias("l"))
    words = lines.select("image_id", "image_width", "image_height", "l", F.explode("l.words").alias("w"))
    flag = lambda name: F.coalesce(F.col(f"w.{name}"), F.col(f"l.{name}"), F.lit(False)).alias(name)
    return words.select(F.col("image_id").alias("page_id"), "w.text", normalised(F.col("w.vertices"), F.col("image_width"), F.col("image_height")).alias("polygon"), (~F.coalesce("w.legible", F.lit(True))).alias("ignore"), flag("handwritten"), flag("vertical"))


def receipts(rows: DataFrame) -> DataFrame:
    """Words of receipts whose labels are JSON in a column: page_id, ground_truth."""
    kind = "struct<valid_line: array<struct<words: array<struct<text: string, quad: struct<x1: double, y1: double, x2: double, y2: double, x3: double, y3: double, x4: double, y4: double>>>>>>"
    words = rows.select("page_id", F.explode(F.from_json("ground_truth", kind)["valid_line"]).alias("line")).select("page_id", F.explode("line.words").alias("w"))
    return words.select("page_id", "w.text", F.array(*(F.array(F.col(f"w.quad.x{i}"), F.col(f"w.quad.y{i}")) for i in range(1, 5))).alias("polygon"))


def results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT).json(path)


def sequence_faults(rows: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """sequence and fault of results that are lost, double or of another id than expected (sequence, id)."""
    counts = rows.groupBy("sequence").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    if expected is None:
        bound = counts.agg(F.max("sequence")).first()[0]
        expected = rows.sparkSession.range(0 if bound is None else bound + 1).select(F.col("id").alias("sequence"), F.lit(None).cast("string").alias("want"))
    else:
        expected = expected.select("sequence", F.col("id").alias("want"))
    fault = F.when(F.col("n").isNull(), "lost").when(F.col("n") > 1, "double").when(F.col("want").isNull() & F.col("first").isNull(), "unexpected").when(F.col("want") != F.col("id"), "another id")
    joined = counts.join(expected.withColumn("first", F.lit(True)), "sequence", "full_outer")
    return joined.select("sequence", fault.alias("fault")).where("fault is not null")


def telemetry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TELEMETRY).json(path)


def raw_maps(spark: SparkSession, path: str, side: int) -> DataFrame:
    """path, width and p of maps stored as little-endian floats; a file of another length is an error."""
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            wrong = b["path"][b["content"].map(len) != side * side * 4]
            if len(wrong):
                raise ValueError(f"not a map of {side} x {side}: {wrong.iloc[0]}")
            yield pd.DataFrame({"path": b["path"], "width": side, "p": [np.frombuffer(c, "<f4") for c in b["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, width int, p array<float>")


def rgb_pages(rows: DataFrame) -> DataFrame:
    """Pages pushed as bytes (id, width, height, rgb); wrong sizes are an error when rows are read."""
    right = (F.col("width") > 0) & (F.col("height") > 0) & (F.octet_length("rgb") == F.col("width").cast("long") * F.col("height") * 3)
    return rows.withColumn("rgb", F.when(right, F.col("rgb")).otherwise(F.raise_error(F.concat(F.lit("not width * height * 3 bytes: "), F.coalesce("id", F.lit("null"))))))


MODEL = "struct<mean: array<double>, std: array<double>, vocab: string>"
#: What the metadata of a page's orientation must say.
ORIENTATION_SHAPE, ORIENTATION_CLASSES = [3, 512, 512], [0, -90, 180, 90]


def image_files(spark: SparkSession, path: str, repeats: int = 1) -> DataFrame:
    """Files of a folder as pages, each as often as asked: id is repeat:index:name, index the place by path; with path and content.

    An empty folder gives no page. The listing is numbered without the contents, which are not shuffled."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ranged = files.select("path").repartitionByRange("path").withColumn("part", F.spark_partition_id())
    ranged = ranged.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy("path")) - 1)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    before = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    places = ranged.join(before, "part").select("path", (F.col("own") + F.col("before")).alias("place"))
    turns = places.withColumn("repeat", F.explode(F.slice(F.sequence(F.lit(0), F.lit(max(repeats, 1) - 1)), 1, repeats)))
    return files.join(turns, "path").select(F.concat_ws(":", "repeat", "place", name).alias("id"), "path", "content")


def model_metadata(spark: SparkSession, path: str, models: tuple[str, ...]) -> DataFrame:
    """model, mean, std and vocab ("" where it is not given) of the models of a metadata file that are named; one that is not there,
    or whose means and deviations are not three numbers, is an error."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, {MODEL}>").alias("all"))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col("all")[m].alias("m")) for m in models))).alias("e")
    found = rows.select(each).select("e.model", "e.m.mean", "e.m.std", F.coalesce("e.m.vocab", F.lit("")).alias("vocab"))
    right = (F.coalesce(F.size("mean"), F.lit(-1)) == 3) & (F.coalesce(F.size("std"), F.lit(-1)) == 3)
    return found.where(F.when(~right, F.raise_error(F.concat(F.lit("no mean and std of three numbers: "), "model"))).otherwise(True))


def orientation_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row of the metadata of page orientation; another shape or other classes than the known ones are an error."""
    rows = spark.read.json(path, multiLine=True, schema="input_shape array<int>, classes array<int>, mean array<double>, std array<double>")
    known = lambda c, v: F.col(c).eqNullSafe(F.array(*map(F.lit, v)))
    right = known("input_shape", ORIENTATION_SHAPE) & known("classes", ORIENTATION_CLASSES)
    return rows.where(F.when(~right, F.raise_error(F.lit("Unexpected page orientation metadata"))).otherwise(True))
