"""Line dedup by winnowing over line hashes, in DataFrame operations alone.

A document is its sequence of lines with a word (spaces at a line's ends aside). At each line starts a gram: the
fewest lines with GRAM_WORDS words or more. Winnowing keeps of the grams that start within WINDOW_WORDS words the one
of the least hash (the last, if equal), so that two places that share a run of GRAM_WORDS + WINDOW_WORDS words share a kept
gram for certain; windows that the end of a text cuts short count too. Each kept gram is joined with its first place in the corpus, by doc_id and line; where that is
another, the match is extended line by line both ways, and the lines of the later place are deleted. Where the first place
differs, another earlier place may go on: each further line gives a key, the hash of the gram and of the lines up to it, and is
deleted where an earlier place has the key too. The keys are aggregated, so no places are paired. The first place of a
line is so never deleted. Beyond a gram a match goes on for less than GRAM_WORDS + WINDOW_WORDS words to the next kept gram or
its end, so each gram carries no more of its surroundings than that, and each line of a run of GRAM_WORDS + WINDOW_WORDS
words that an earlier place has is deleted.

Defined results: a null text stays null and has no line; an empty text stays empty; a null doc_id comes after all others;
rows that are equal in doc_id and text are one document, and their lines have one fate; runs of fewer than GRAM_WORDS words
are never deleted; an empty table has an empty result; extra columns are kept, whatever their names.

Common grams and keys are joined without being dealt to one task. Which lines go is sent to all tasks where that is little;
beyond, texts are joined with it, which shuffles them once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphloom.llm._shared import SPACE_WORD, checkpoint, hot_keys, join_dealt, small, table

GRAM_WORDS = 25
WINDOW_WORDS = 25

#: Bytes of line numbers that go to all tasks.
BROADCAST_BYTES = 16 << 20

_PLACE = ("none", "doc_id", "text_key")


def _words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(SPACE_WORD))


def lines(documents: DataFrame) -> DataFrame:
    """A row for each line with a word of each document: where it is (at: of all lines; pos: of those with words), its hash and words."""
    split = F.filter(
        F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(i.alias("at"), F.xxhash64(F.trim(line)).alias("h"), _words(line).alias("w"))),
        lambda line: line["w"] > 0,
    )
    rows = documents.select(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(split).alias("pos", "line"))
    return rows.select(*_PLACE, "pos", "line.at", "line.h", "line.w")


def kept_grams(rows: DataFrame, gram: int = GRAM_WORDS, window: int = WINDOW_WORDS) -> DataFrame:
    """The grams that winnowing keeps: gram, its place, and the lines of it, before it (backward) and from it."""
    rows = rows.repartition(*_PLACE).dropDuplicates([*_PLACE, "pos"])
    of = Window.partitionBy(*_PLACE)
    by_start, by_end = of.orderBy("start"), of.orderBy("end")
    rows = rows.withColumn("end", F.sum("w").over(of.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("w"))
    line = F.struct("h", "at")
    rows = rows.select(
        "*",
        F.collect_list(line).over(by_start.rangeBetween(0, gram - 1)).alias("own"),
        F.collect_list(line).over(by_start.rangeBetween(1 - window, -1)).alias("back"),
        F.max("end").over(of).alias("total"),
    )
    rows = rows.withColumn("ahead", F.collect_list(line).over(by_end.rangeBetween(0, gram + window - 1)))
    whole = F.col("total") - F.col("start") >= gram
    rows = rows.withColumn("gram", F.when(whole, F.xxhash64("own.h")))
    least = F.min(F.when(whole, F.struct(F.col("gram"), (-F.col("pos")).alias("neg")))).over(by_start.rangeBetween(0, window - 1))
    chosen = rows.withColumn("least", F.when(whole, least)).withColumn("picked", F.collect_set("least.neg").over(by_start.rangeBetween(1 - window, 0)))
    return chosen.where(F.array_contains("picked", -F.col("pos"))).select(*_PLACE, "pos", "gram", "own", F.reverse("back").alias("back"), "ahead")


def _equal(a: Column, b: Column) -> Column:
    """How many elements two arrays have in common at their starts."""
    same = F.zip_with(F.slice(a, 1, F.least(F.size(a), F.size(b))), F.slice(b, 1, F.least(F.size(a), F.size(b))), lambda x, y: (x == y).cast("int"))
    stop = F.array_position(same, 0).cast("int")
    return F.when(stop == 0, F.size(same)).otherwise(stop - 1)


def _further(side: str, known: str) -> Column:
    """The lines of a side after the first `known`: where each is, and the key of the gram with the lines up to it."""
    count = F.greatest(F.size(side) - F.col(known), F.lit(0))
    return F.transform(
        F.slice(side, F.col(known) + 1, count),
        lambda line, i: F.struct(F.xxhash64(F.lit(side), F.col("gram"), F.slice(F.col(side)["h"], F.lit(1), F.col(known) + i + 1)).alias("key"), line["at"].alias("at")),
    )


def repeated_lines(documents: DataFrame, gram: int = GRAM_WORDS, window: int = WINDOW_WORDS) -> DataFrame:
    """doc_id, text_key and `drop`: the lines, by number, that repeat an earlier run."""
    grams = checkpoint(kept_grams(lines(documents), gram, window))
    place = F.struct(*_PLACE, "pos")
    firsts = checkpoint(grams.groupBy("gram").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"))
    hot = hot_keys(firsts, "gram")
    repeated = checkpoint(join_dealt(grams, firsts.select("gram", "first"), "gram", hot))
    sources = repeated.where(place == F.col("first")).select("gram", F.col("back.h").alias("first_back"), F.col("ahead.h").alias("first_ahead"))
    later = join_dealt(repeated.where(place > F.col("first")), sources, "gram", hot)
    later = later.withColumns({"n_back": _equal(F.col("back.h"), F.col("first_back")), "n_ahead": F.greatest(_equal(F.col("ahead.h"), F.col("first_ahead")), F.size("own"))})
    run = F.concat(F.slice("back.at", F.lit(1), F.col("n_back")), F.col("own.at"), F.slice("ahead.at", F.lit(1), F.col("n_ahead")))
    further = F.concat(_further("back", "n_back"), _further("ahead", "n_ahead"))
    later = checkpoint(later.select(*_PLACE, "pos", F.array_distinct(run).alias("run"), further.alias("further")))
    each = later.select(*_PLACE, place.alias("place"), F.explode("further").alias("line")).select(*_PLACE, "place", "line.*")
    earliest = checkpoint(each.groupBy("key").agg(F.min("place").alias("earliest"), F.count("*").alias("n")).where("n > 1"))
    beyond = join_dealt(each, earliest.select("key", "earliest"), "key", hot_keys(earliest, "key")).where(F.col("place") > F.col("earliest")).select(*_PLACE, "at")
    found = later.select(*_PLACE, F.explode("run").alias("at")).unionByName(beyond)
    return found.groupBy(*_PLACE).agg(F.collect_set("at").alias("drop")).drop("none")


def deduplicate(documents: DataFrame, gram: int = GRAM_WORDS, window: int = WINDOW_WORDS) -> DataFrame:
    """row (a struct of all columns of documents), text without the deleted lines, and n_removed, how many they are."""
    found = repeated_lines(documents.select("doc_id", "text"), gram, window)
    drop = checkpoint(found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "drop"))
    rows = documents.select(F.struct(*documents.columns).alias("row"), documents["doc_id"].alias("_doc"), documents["text"].alias("text"))
    if small(drop) and (drop.agg(F.sum(32 + 4 * F.size("drop"))).first()[0] or 0) <= BROADCAST_BYTES:
        drop = F.broadcast(drop)
    joined = rows.join(drop, F.col("_doc").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key")), "left")
    left = F.transform(  # an array of one, so that the text is split once
        F.array(F.split("text", "\n", -1)),
        lambda all_: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col("drop")), lambda i: F.get(all_, i)), "\n"),
    )[0]
    return joined.select("row", F.when(F.col("drop").isNull(), F.col("text")).otherwise(left).alias("text"), F.coalesce(F.size("drop"), F.lit(0)).alias("n_removed"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_removed", "text")
