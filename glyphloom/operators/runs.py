"""Comparisons of runs: grids of parameters, guarded winners, parity, and sequences of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.operators.series import islands


def swept(rows: DataFrame, grid: dict[str, list[float]]) -> DataFrame:
    """rows once for each point of a grid, a fixed list in the plan: nothing is joined."""
    for name, values in grid.items():
        rows = rows.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))
    return rows


def guarded_winner(scores: DataFrame, point: list[str], base: Column) -> DataFrame:
    """scores: a page's score at each point. The points that beat the base point's total and lose on no page; best first, one row."""
    based = scores.where(base).select("page_id", F.col("score").alias("base"))
    joined = scores.join(based, "page_id").groupBy(*point).agg(F.sum("score").alias("total"), F.sum("base").alias("base"), F.every(F.col("score") >= F.col("base")).alias("safe"))
    return joined.where("safe and total > base").orderBy(F.desc("total"), *point).limit(1)


def parity(left: DataFrame, right: DataFrame, key: list[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """rows, lost, added and apart: how two runs of the same work differ."""
    a, b = left.select(*key, F.col(value).alias("a")), right.select(*key, F.col(value).alias("b"))
    both = a.withColumn("in_a", F.lit(1)).join(b.withColumn("in_b", F.lit(1)), key, "full_outer")
    return both.agg(F.count("*").alias("rows"), F.count_if(F.col("in_b").isNull()).alias("lost"), F.count_if(F.col("in_a").isNull()).alias("added"), F.count_if(F.abs(F.col("a") - F.col("b")) > tolerance).alias("apart"))


def sequences(words: DataFrame, phrase: list[str]) -> DataFrame:
    """page_id, idx, run: where a sequence of texts begins in the words of a page, and which directly follow each other."""
    order = Window.partitionBy("page_id").orderBy("idx")
    ahead = [F.lead("text", i).over(order) if i else F.col("text") for i in range(len(phrase))]
    met = words.withColumn("found", F.array(*ahead) == F.array(*(F.lit(p) for p in phrase))).where("found").select("page_id", "idx")
    stepped = met.withColumn("step", F.expr(f"idx div {len(phrase)}")).withColumn("phase", F.col("idx") % len(phrase))
    return islands(stepped, ["page_id", "phase"], "step").select("page_id", "idx", F.concat_ws("-", "phase", "island").alias("run"))


#: Stages in the order in which an error of theirs is believed, and what a stage says that was only stopped.
STAGES = ("reader", "detector", "postprocessor", "recognizer", "writer")
INDUCED = ("Pipeline cancelled", "Missing admitted pages", "Downstream disconnected")


def first_cause(errors: DataFrame) -> DataFrame:
    """run, stage, message: of each run's errors (run, stage, message) the one that came first in the order of STAGES and was not
    induced by another. A run with induced errors alone has no row; null messages are errors like others, unknown stages come last."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")), F.lit(0)), F.lit(len(STAGES) + 1))
    own = errors.where(~F.coalesce(F.col("message").isin(*INDUCED), F.lit(False)))
    return own.groupBy("run").agg(F.min(F.struct(place.alias("place"), "message", "stage")).alias("e")).select("run", "e.stage", "e.message")


def captured(rows: DataFrame, wanted: Column, value: Column, error: Column) -> DataFrame:
    """rows with value, null where it failed, and error, what went wrong; a failed row is kept, so that it counts in every
    denominator. `wanted` says which rows are tried; others have neither."""
    failed = wanted & value.isNull()
    return rows.withColumns({"value": F.when(wanted, value), "error": F.when(failed, error)})


def examples(rows: DataFrame, keys: list[str], order: list[Column], most: int = 24) -> DataFrame:
    """The first row of each group of keys, and of these the `most` first in order."""
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
    return first.orderBy(*order).limit(most)
