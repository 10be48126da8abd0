"""Writers: results in order, telemetry as wide CSV, provenance, and a summary that only a whole run has."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.sources.readers import sequence_faults


def ordered_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line, by sequence: files are ranges of numbers, and their names follow the order. Nulls are left out."""
    rows.repartitionByRange("sequence").sortWithinPartitions("sequence").write.mode("overwrite").json(path)


def wide_telemetry(rows: DataFrame, cores: int) -> DataFrame:
    """Samples with seconds since the first and a column for each core."""
    first = rows.agg(F.min("time_ns").alias("first"))
    named = [F.get("system_cpu_per_core", F.lit(i)).alias(f"cpu_{i}") for i in range(cores)]
    return rows.join(F.broadcast(first)).select(((F.col("time_ns") - F.col("first")) / 1e9).alias("elapsed_seconds"), *(c for c in rows.columns if c != "system_cpu_per_core"), *named)


def telemetry_csv(rows: DataFrame, path: str, cores: int) -> None:
    wide_telemetry(rows, cores).repartitionByRange("elapsed_seconds").sortWithinPartitions("elapsed_seconds").write.mode("overwrite").csv(path, header=True)


def provenance(files: DataFrame) -> DataFrame:
    """path and SHA-256 of binary files."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def summarised(write: Callable[[], None], summary: DataFrame, path: str) -> None:
    """Writes the results, then the summary: a run that fails leaves none."""
    write()
    summary.write.mode("overwrite").json(path)


def tensors(maps: DataFrame, path: str) -> None:
    """Tensors (id, shape, values) as Parquet: values are floats of four bytes; a shape that is not the values' number is an error."""
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda n, k: n * k)
    checked = F.when(size == F.size("values"), F.col("values").cast("array<float>")).otherwise(F.raise_error(F.concat(F.lit("not of its shape: "), F.col("id").cast("string"))))
    maps.select("id", F.col("shape").cast("array<int>").alias("shape"), checked.alias("values")).write.mode("overwrite").parquet(path)


def asserted(results: DataFrame, expected: DataFrame) -> DataFrame:
    """results, if they are the pages that are expected (sequence, id), each once; else an error that names some faults."""
    faults = sequence_faults(results, expected).orderBy("sequence").limit(5).collect()
    if faults:
        raise ValueError("Lost or reordered page: " + ", ".join(f"{r['sequence']} {r['fault']}" for r in faults))
    return results
