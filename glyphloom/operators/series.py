"""Measures over ordered samples: percentiles by rank, high water, gaps and islands, weighted medians, adaptive windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def floor_rank(rows: DataFrame, keys: list[str], value: str, percents: tuple[int, ...]) -> DataFrame:
    """For each group the values at place ((n - 1) * p) div 100 of those in order, columns p50 and so on.

    Ranks come from a window and not from a list, so that a group may be of any size."""
    ordered = Window.partitionBy(*keys).orderBy(value)
    ranked = rows.where(F.col(value).isNotNull()).select(*keys, value, (F.row_number().over(ordered) - 1).alias("_at"), F.count("*").over(Window.partitionBy(*keys)).alias("_n"))
    at = lambda p: F.max(F.when(F.col("_at") == F.expr(f"((_n - 1) * {p}) div 100"), F.col(value)))
    return ranked.groupBy(*keys).agg(*(at(p).alias(f"p{p}") for p in percents))


def last_n(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The n latest rows of each group."""
    latest = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_k", F.row_number().over(latest)).where(F.col("_k") <= n).drop("_k")


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """rows with `place`, from 0, by a column of numbers, nulls first: counted within ranges, which follow each other, so that no task reads all."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limits = sorted(set(rows.approxQuantile(by, [k / ranges for k in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    passed = F.filter(F.array(*map(F.lit, limits)).cast("array<double>"), lambda x: x < F.col(by).cast("double"))
    ranged = rows.withColumn("_range", F.size(passed))
    before, starts = 0, []
    for r in sorted(ranged.groupBy("_range").count().collect()):
        starts += [F.lit(r["_range"]), F.lit(before).cast("long")]
        before += r["count"]
    offset = F.create_map(*starts)[F.col("_range")] if starts else F.lit(0).cast("long")
    return ranged.withColumn("place", offset + F.row_number().over(Window.partitionBy("_range").orderBy(by)) - 1).drop("_range")


def high_water(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The most spans open at once in each group; one that ends when another starts has ended."""
    step = F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("by")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("by"))))
    steps = spans.select(*keys, step.alias("s")).groupBy(*keys, "s.at").agg(F.sum("s.by").alias("by"))
    # Spans of no length count while they begin: a start is never lost by summing, as ends come first at equal times.
    running = F.sum("by").over(Window.partitionBy(*keys).orderBy("at"))
    return steps.select(*keys, running.alias("open")).groupBy(*keys).agg(F.max("open").alias("most"))


def islands(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
    """rows with `island`, equal for consecutive places of a group."""
    return rows.withColumn("island", F.col(place) - F.row_number().over(Window.partitionBy(*keys).orderBy(place)))


def weighted_median(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The first value, in order, at which half of the weight is reached."""
    of = Window.partitionBy(*keys)
    running = rows.select(*keys, value, F.sum(weight).over(of.orderBy(value)).alias("so_far"), F.sum(weight).over(of).alias("all"))
    return running.where(F.col("so_far") * 2 >= F.col("all")).groupBy(*keys).agg(F.min(value).alias("median"))


def adaptive_rates(rows: DataFrame, key: str, seconds: str, least: float = 10.0) -> DataFrame:
    """A rate each time that `least` seconds have gone by since the last one: key, at, rate. Each group is read in order once, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, since, count = None, 0.0, 0
        for b in batches:
            out = []
            for k, t in zip(b[key].tolist(), b[seconds].tolist(), strict=True):
                if k != now:
                    now, since, count = k, t, 0
                    continue
                count += 1
                if t - since >= least:
                    out.append((k, t, count / (t - since)))
                    since, count = t, 0
            yield pd.DataFrame(out, columns=[key, "at", "rate"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, seconds).repartition(key).sortWithinPartitions(key, seconds).mapInPandas(run, f"{key} {kind}, at double, rate double")


def first_sample(value: Column, by: str, keys: list[str]) -> Column:
    return F.first(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(by))
