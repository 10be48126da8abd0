"""Crops and their texts: wide crops are split, logits decoded, parts merged again, rotated readings weighed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDEST = 8
PART = 6
#: Limits of the acceptance of alternative readings.
LEAST_CONFIDENCE, OVER_ORIGINAL, OVER_OTHER = 0.9, 0.15, 0.1


def pixel_rect(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """Whole pixels of a box in pixels of a page: rounded half to even, the ends one more, within the page."""
    return F.rint(x0).cast("int"), F.rint(y0).cast("int"), F.least(F.rint(x1).cast("int") + 1, width.cast("int")), F.least(F.rint(y1).cast("int") + 1, height.cast("int"))


def crop_rect(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """pixel_rect of a box in shares of a page."""
    return pixel_rect(x0 * width, y0 * height, x1 * width, y1 * height, width, height)


def split_starts(width: Column, height: Column) -> Column:
    """Where the parts of a crop begin: one part up to WIDEST times its height, else parts of PART heights that overlap by half."""
    part = PART * height
    step = part - F.floor(part / 2).cast("int")
    starts = F.sequence(F.lit(0), F.greatest(width - part, F.lit(0)), F.greatest(step, F.lit(1)))
    tail = F.when(F.element_at(starts, -1) + part < width, F.concat(starts, F.array(width - part))).otherwise(starts)
    return F.when(width > WIDEST * height, tail).otherwise(F.array(F.lit(0)))


def last_overlap(starts: Column, width: Column, height: Column) -> Column:
    """The share of the last part that the one before also shows, 0 for a crop in one part."""
    part = PART * height
    return F.when(F.size(starts) > 1, (F.get(starts, F.size(starts) - 2) + part - F.element_at(starts, -1)) / part).otherwise(F.lit(0.0))


def decoded(logits: DataFrame, end: int) -> DataFrame:
    """sample, classes and confidence from (sample, step, values): the last of equal maxima, up to the first class of `end` or more.

    Confidence is the mean of the peaks' softmax shares, 0 for an empty text."""
    top = F.array_max("values")
    best = F.size("values") - F.array_position(F.reverse("values"), top).cast("int")
    peak = 1 / F.aggregate(F.transform("values", lambda v: F.exp(v - top)), F.lit(0.0), lambda a, v: a + v)
    steps = logits.select("sample", F.struct("step", best.alias("class"), peak.alias("peak")).alias("s"))
    read = steps.groupBy("sample").agg(F.array_sort(F.collect_list("s")).alias("steps"))
    stop = F.coalesce(F.array_min(F.filter(F.transform("steps", lambda s: F.when(s["class"] >= end, s["step"])), lambda s: s.isNotNull())), F.lit(1 << 30))
    kept = F.filter("steps", lambda s: s["step"] < stop)
    confidence = F.aggregate(kept, F.lit(0.0), lambda a, s: a + s["peak"]) / F.greatest(F.size(kept), F.lit(1))
    return read.select("sample", F.transform(kept, lambda s: s["class"]).alias("classes"), confidence.alias("confidence"))


def merge(a: str, b: str, ratio: float) -> str:
    """Two readings of overlapping parts as one text. `ratio` is the share of b that a shows too.

    The character at the cut is left out of each; the overlap is the length, nearest to the expected one, at which both
    agree, else the one of fewest differences and least distance."""
    shorter = min(len(a), len(b))
    if shorter <= 1:
        return a + b
    head, tail = a[:-1], b[1:]
    expected = round(len(b) * ratio) - 3
    overlaps = [(n, sum(x != y for x, y in zip(head[-n:], tail[:n], strict=False))) for n in range(1, shorter)]
    same = [n for n, wrong in overlaps if wrong == 0]
    if same:
        n = min(same, key=lambda n: abs(n - 1 - expected))
    elif expected < -1:
        return a + b
    elif expected < 0:
        return head + tail
    else:
        n = min(overlaps, key=lambda o: o[1] + abs(o[0] - 1 - expected))[0]
    return head + tail[n:]


def merged_parts(parts: list[str], last: float) -> str:
    """Ordered parts as one text: half of each part overlaps with the one before, of the last what last_overlap says."""
    out = parts[0] if parts else ""
    for i, text in enumerate(parts[1:], 1):
        out = merge(out, text, last if i == len(parts) - 1 else 0.5)
    return out


def merged(parts: Column, last: Column) -> Column:
    """merged_parts over columns: an array of texts and the last overlap."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([merged_parts(list(t), float(e)) for t, e in zip(texts, ends, strict=True)], dtype=object)

    return run(parts, last)


def casefolded(text: Column) -> Column:
    """A text for comparing without case, by the full folding of Unicode; only texts beyond ASCII go to Python."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(str.casefold, na_action="ignore")

    return F.when(text.rlike(r"^[\x00-\x7F]*$"), F.lower(text)).otherwise(run(text))


def recognition_score(pairs: DataFrame, truth: str = "l_text", seen: str = "r_text", times: str | None = None) -> DataFrame:
    """One row: words, the shares of exact texts and of texts equal but for case, and edits of code points for each of truth's.

    A null text counts as empty; without pairs all shares are 0. The column `times`, if it is named, says how many pairs a row stands for."""
    rows = pairs.select(F.coalesce(truth, F.lit("")).alias("t"), F.coalesce(seen, F.lit("")).alias("s"), (F.col(times) if times else F.lit(1)).cast("long").alias("times"))
    rows = rows.withColumn("folded", (F.col("t") == F.col("s")) | (casefolded(F.col("t")) == casefolded(F.col("s"))))
    total = lambda value: F.coalesce(F.sum(value), F.lit(0))
    count = lambda which: total(F.when(which, F.col("times")))
    n = F.greatest(total("times"), F.lit(1))
    edits, chars = total(F.levenshtein("t", "s") * F.col("times")), total(F.char_length("t") * F.col("times"))
    return rows.agg(total("times").alias("words"), (count(F.col("t") == F.col("s")) / n).alias("exact"), (count(F.col("folded")) / n).alias("case_blind"), (edits / F.greatest(chars, F.lit(1))).alias("cer"))


def accepted(text: Column, confidence: Column) -> Column:
    """One or two letters or digits, read with confidence."""
    return (confidence >= LEAST_CONFIDENCE) & F.char_length(text).between(1, 2) & text.rlike(r"^[\p{L}\p{N}]+$")


def chosen_rotation(original: Column, candidates: Column) -> Column:
    """The rotation that a word ends with: candidates (rotation, text, confidence) in order replace what was read before if
    they are sure, better by more than OVER_ORIGINAL than the first reading and by more than OVER_OTHER than all others of another angle, and,
    when turned, have two characters or more. `original` is the confidence of the first reading."""

    def step(state: Column, c: Column) -> Column:
        rival = F.coalesce(F.array_max(F.transform(F.filter(candidates, lambda o: o["rotation"] != c["rotation"]), lambda o: o["confidence"])), F.lit(-1.0))
        wins = (
            (c["confidence"] >= LEAST_CONFIDENCE)
            & (c["confidence"] > original + OVER_ORIGINAL)
            & (c["confidence"] > state["confidence"])
            & ((c["rotation"] == 0) | (c["confidence"] > rival + OVER_OTHER))
            & (F.char_length(c["text"]) >= F.when(c["rotation"] == 0, 1).otherwise(2))
        )
        return F.struct(F.when(wins, c["rotation"]).otherwise(state["rotation"]).alias("rotation"), F.when(wins, c["confidence"]).otherwise(state["confidence"]).alias("confidence"))

    start = F.struct(F.lit(None).cast("int").alias("rotation"), original.alias("confidence"))
    return F.aggregate(candidates, start, step)
