"""Quality rules: a decision list, learned by sequential covering, over statistics of whole texts.

Defined results: a null text has no words and fails the base rules; a null doc_id is kept and has no label; repeated
rows are judged alike; labels that disagree count as the lower; without labels of both kinds the list is empty and
the base rules decide; an empty table has an empty result; columns of documents with other names are ignored, or kept
by `filter_documents`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphloom.llm._ragged import SPACED, Powers, chunks, mixed, totals
from glyphloom.llm._shared import bounded_sample, checkpoint, table

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_bars", "n_chars_all")
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?"

#: Rows of labels that the list is learned from, about, if there are more; chosen by the hash of doc_id.
TRAINING_ROWS = 40_000


def _table(of: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(of, np.uint8)).astype(np.uint8)


_KINDS = {"n_symbols": _table(SYMBOLS), "n_upper": _table(bytes(range(65, 91))), "n_digits": _table(bytes(range(48, 58))), "n_marks": _table(MARKS), "n_bars": _table(b"|")}


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The COUNTS of each text. Words, lines and windows are compared by 64-bit hashes within their text."""
    powers, found = Powers(), {k: np.zeros(len(texts), np.int64) for k in COUNTS}
    for c in chunks(texts):
        _, starts, ends, bounds = c.words(SPACED)
        of = np.repeat(np.arange(len(c), dtype=np.uint64), np.diff(bounds))
        points = np.zeros(len(c.data) + 1, np.int64)
        np.cumsum((c.data & 0xC0) != 0x80, out=points[1:])
        put = lambda k, v, rows=c.rows: found[k].__setitem__(rows, v)
        put("n_words", np.diff(bounds))
        put("word_chars", totals(points[ends] - points[starts], bounds))
        put("n_chars_all", points[c.offsets[1:]] - points[c.offsets[:-1]] - 1)
        for k, kind in _KINDS.items():
            put(k, totals(kind[c.data], c.offsets))
        hashes = powers.spans(c.data, starts, ends)
        if len(hashes) > 2:
            key = mixed(mixed(mixed(hashes[:-2] + of[:-2]) + hashes[1:-1]) + hashes[2:])
            same = of[:-2] == of[2:]
            twice = np.zeros(len(same), bool)
            twice[same] = _repeats(key[same])
            covered = np.zeros(len(hashes), bool)
            for i in range(3):
                covered[i : len(twice) + i] |= twice
            put("n_repeat_words", totals(covered, bounds))
        line_ends = np.flatnonzero(c.data == 10)
        line_starts = np.concatenate(([0], line_ends[:-1] + 1))
        filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
        line_starts, line_ends = line_starts[filled], line_ends[filled]
        line_of = np.searchsorted(c.offsets, line_starts, "right") - 1
        line_keys = mixed(powers.spans(c.data, line_starts, line_ends) + mixed(line_of.astype(np.uint64)))
        first = np.zeros(len(line_keys), np.int64)
        first[np.unique(line_keys, return_index=True)[1]] = 1
        lines = np.searchsorted(line_starts, c.offsets)
        put("n_lines", np.diff(lines))
        put("n_dup_lines", totals(1 - first, lines))
    return found


def _counts(texts: pa.Array) -> pa.Array:
    found = text_counts(texts)
    return pa.StructArray.from_arrays([pa.array(v) for v in found.values()], names=list(found))


def document_counts(documents: DataFrame, *carried: str) -> DataFrame:
    """The COUNTS of each document beside the carried columns, in one narrow pass; only the texts (of `text`, or of the
    struct `row` if it is carried) go to Python."""
    text = F.col("row")["text"] if "row" in carried else F.col("text")
    counts = F.arrow_udf(_counts, T.StructType([T.StructField(k, T.LongType()) for k in COUNTS])).asNondeterministic()
    return documents.select(*carried, counts(text).alias("counts")).select(*carried, "counts.*")


#: The measures that conditions of the list compare with thresholds, as SQL over the COUNTS.
MEASURES = {
    "words": "double(n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "bars_per_word": "n_bars / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.measure] > self.threshold if self.above else x[self.measure] <= self.threshold

    def column(self) -> Column:
        m = F.expr(MEASURES[self.measure])
        return m > self.threshold if self.above else m <= self.threshold


Rule = tuple[Condition, ...]


def _holds(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(x) for c in rule), np.ones(n, bool))


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Adds the condition of the highest information gain, of all thresholds between two values, until only bad rows are covered."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while (p := bad[inside].sum()) and (n := inside.sum() - p):
        best, gain = None, 1e-9
        for k, v in x.items():
            here, y = v[inside], bad[inside]
            order = np.argsort(here, kind="stable")
            here, y = here[order], np.cumsum(y[order])
            ends = np.flatnonzero(here[1:] > here[:-1])
            for above in (False, True):
                cover = (len(here) - 1 - ends) if above else ends + 1
                hit = (y[-1] - y[ends]) if above else y[ends]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(hit > 0, hit * (np.log2(hit / cover) - np.log2(p / (p + n))), 0)
                if len(gains) and gains.max() > gain:
                    i = ends[gains.argmax()]
                    best, gain = Condition(k, above, float((here[i] + here[i + 1]) / 2)), gains.max()
        if best is None or best.holds(x)[inside].all():
            break
        rule, inside = (*rule, best), inside & best.holds(x)
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, least: int = 5) -> list[Rule]:
    """Sequential covering: grows a rule on two thirds of the rows, prunes it on the others, and takes the rows that it covers
    away, until a rule covers fewer than `least` bad pruning rows, or its precision on them falls under `precision`."""
    n = len(bad)
    third = np.arange(n) % 3 == 2
    left, found = np.ones(n, bool), []
    while True:
        grow, prune = left & ~third, left & third
        if not bad[grow].any() or bad[grow].all():
            break
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow])
        held, y = {k: v[prune] for k, v in x.items()}, bad[prune]
        scored = []
        for k in range(1, len(rule) + 1):
            inside = _holds(rule[:k], held, len(y))
            p, m = int((inside & y).sum()), int((inside & ~y).sum())
            scored.append(((p - m) / max(p + m, 1), p, -k, p / max(p + m, 1)))
        if not scored or (best := max(scored))[1] < least or best[3] < precision:
            break
        found.append(rule[: -best[2]])
        left &= ~_holds(found[-1], x, n)
    return found


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as a Spark conditional expression: true for a document that is kept."""
    if not rules:
        return F.lit(True)
    first, *more = [reduce(Column.__and__, (c.column() for c in rule)) for rule in rules]
    return reduce(lambda w, c: w.when(c, False), more, F.when(first, False)).otherwise(True)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> list[Rule]:
    """Learns from the labelled documents that pass the base rules, of about `rows` labels, no more in expectation, chosen by
    the hash of doc_id. Only the texts of these are read into counts; documents of one id and text count once."""
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = checkpoint(bounded_sample(checkpoint(marked), "doc_id", rows)).withColumn("bad", F.col("quality") == 0).select(F.col("doc_id").alias("id"), "bad")
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).withColumn("key", F.xxhash64("text"))
    counts = checkpoint(document_counts(found, "id", "key", "bad").dropDuplicates(["id", "key"]).where(~base_failed()))
    measured = counts.select("id", "key", *(F.expr(m).alias(k) for k, m in MEASURES.items()), "bad")
    # Ids may repeat with different texts, so that rows are chosen once more.
    sample = bounded_sample(measured, "key", rows).select(F.xxhash64("id").alias("at"), "key", *MEASURES, "bad").toPandas().sort_values(["at", "key"])
    return learn({k: sample[k].to_numpy(float) for k in MEASURES}, sample["bad"].to_numpy(bool))


def _judged(documents: DataFrame, rules: list[Rule], *carried: str) -> DataFrame:
    counts = document_counts(documents, *carried)
    return counts.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def judge(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, the COUNTS, base_failed and kept. The list is learned from a sample; then all texts are read in one pass."""
    return _judged(documents, train(documents, labels, rows), "doc_id")


def filter_documents(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """The documents that are kept, with all their columns: no row is shuffled."""
    rules = train(documents, labels, rows)
    return _judged(documents.select(F.struct(*documents.columns).alias("row")), rules, "row").where("kept").select("row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
