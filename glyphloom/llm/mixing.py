"""Mixing sources to target weights.

The words of each source are summed; a source's target is its weight's share of what the mix is to hold, stopped at MOST
times the source's own words, where the excess is shared again by weight among those not stopped. A document is taken
floor(target / size of its source) times, and once more with the probability of the fraction, drawn by an MD5 of its
doc_id (of its text where it has none), so that reruns agree.

Defined results: a null text has no words, a null source is a source of its own, after all others; a document without
words is drawn like any other and adds none; rows of one doc_id share their draw; without words in any document all targets
are 0; an empty table has an empty result; extra columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphloom.llm._shared import HOT_SHARE, SPACE_WORD, checkpoint, table, uniform

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Sources whose targets are sent to all tasks; beyond, that is done for the few hot ones, and documents of others are joined.
BROADCAST_SOURCES = 50_000
BROADCAST_BYTES = 8 << 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def draw(documents: DataFrame) -> Column:
    return uniform(F.lit("mix"), F.coalesce(documents["doc_id"].cast("string"), F.md5(documents["text"]), F.lit("")))


def prefixed(rows: DataFrame, order: list[Column], **amounts: Column) -> DataFrame:
    """rows with the sum of each amount over all rows that come before. They are dealt by ranges of the order, which follow
    each other: sums within a range are windows, those of the ranges before it come from one row a range."""
    ranged = checkpoint(rows.withColumns(amounts).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sums = sorted(tuple(r) for r in ranged.groupBy("part").agg(*(F.sum(k) for k in amounts)).collect())
    before, starts = [0] * len(amounts), []
    for part, *own in sums:
        starts.append((part, *before))
        before = [a + b for a, b in zip(before, own, strict=True)]
    of_ranges = rows.sparkSession.createDataFrame(starts, ranged.select("part", *(F.col(k).alias(f"start_{k}") for k in amounts)).schema)
    earlier = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumns({k: F.coalesce(F.sum(k).over(earlier), F.lit(0)) for k in amounts})
    joined = within.join(F.broadcast(of_ranges), "part")
    return joined.withColumns({k: F.col(k) + F.col(f"start_{k}") for k in amounts}).drop("part", *(f"start_{k}" for k in amounts))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes(source, source_size, ...) with the target of each source.

    Words for each unit of weight (the level) rise until none is left to share; a source stops where it has its most. In the
    order in which sources stop, the first that does not stop at the level that the ones before it leave gives the level.
    """
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    placed = prefixed(sizes, [F.col("source").asc_nulls_last()], place=F.lit(1).cast("long"))
    found = placed.withColumn("weight", weight).withColumn("most", F.lit(most) * F.col("source_size"))
    found = checkpoint(prefixed(found, [F.col("most") / F.col("weight"), F.col("place")], stopped=F.col("most"), heavier=F.col("weight")))
    total, weighs = found.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(share * (total or 0)) - F.col("stopped")) / (F.lit(weighs or 0) - F.col("heavier"))
    first = found.withColumn("level", level).where(F.col("level") * F.col("weight") < F.col("most")).agg(F.min_by("level", F.struct(F.col("most") / F.col("weight"), F.col("place")))).first()[0]
    target = F.col("most").cast("double") if first is None else F.least(F.col("most").cast("double"), F.col("weight") * F.lit(float(first)))
    return found.select(*sizes.columns, (target if total else F.lit(0.0)).alias("target"))


def planned(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """row (a struct of all columns), size, source_size, target and copies of each document."""
    rows = documents.select(
        F.struct(*documents.columns).alias("row"), documents["source"].alias("source"), n_words(documents["text"]).alias("size"), draw(documents).alias("draw")
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    found = checkpoint(targets(sizes, weights, share, most).withColumnRenamed("source", "of"))
    sources, names, n = found.agg(F.count("*"), F.sum(F.octet_length("of")), F.sum("n")).first()
    same = F.col("source").eqNullSafe(F.col("of"))
    if sources <= BROADCAST_SOURCES and (names or 0) <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(found), same)
    else:
        hot = F.col("n") > n // HOT_SHARE  # fewer than HOT_SHARE sources
        joined = rows.join(F.broadcast(found.where(hot)), same).unionByName(rows.join(F.broadcast(found.where(hot).select("of")), same, "left_anti").join(found.where(~hot), same))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (F.col("draw") < rate - F.floor(rate)).cast("long")
    return joined.select("row", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all their columns."""
    taken = planned(documents, weights, share, most).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = planned(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM rows GROUP BY source),
weighted AS (
  SELECT *, 2 * source_size AS most, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY most / weight, place) AS k FROM weighted),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
settled AS (
  SELECT level FROM levels WHERE level * weight < most ORDER BY k LIMIT 1),
targets AS (
  SELECT source, source_size, least(CAST(most AS DOUBLE), weight * coalesce((SELECT level FROM settled), 0.0::DOUBLE)) AS target FROM weighted)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM (SELECT r.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate
      FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
"""
