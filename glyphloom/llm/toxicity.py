"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of those of three buckets, the hashes modulo BUCKETS of the word and of its first PREFIXES
bytes, so that no word is without one and words of one stem have much in common. Filters of one, two and three words run
over whole texts, the largest answer of each filter is pooled, and a logistic unit scores the pool.
All labelled rows that are not held out are trained on, whatever their number and length: they are dealt to groups by hash, a task
moves the model by the rows of a group, and the groups' steps are averaged after each pass. Words are counted over all of them for
the start. Thresholds by language come from all of them too: a model of each half scores the other. The score itself sees the text alone.

Defined results: a null text is empty; an empty text has the score of an empty pool; a null doc_id is scored, not held
out, and never labelled; labels of one id that disagree count as toxic; rows of one id with different texts are examples of
their own, equal ones one example; repeated rows are scored alike, whatever stands beside them; without labels of both
kinds all scores are the share of toxic labels, 0 if there are none; an empty table has an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphloom.llm._ragged import ALNUM_LOWER, CHUNK, Chunk, Powers, chunks, mixed
from glyphloom.llm._shared import checkpoint, likely_among, small, table

#: Labelled rows, and bytes of their texts, that a task trains on between two averages.
GROUP_ROWS = 4_000
GROUP_BYTES = 32 << 20
#: Passes over the labelled rows; more where they are fewer than MOST_PASSES groups.
PASSES = 3
MOST_PASSES = 6
#: Texts of a step, words that are worked on at once, and places whose answers stay in a core's cache.
BATCH = 24
PIECE = 1 << 16
PLACES = 1 << 10
#: Numbers of a block of sums, and what steps are rounded to.
BLOCK = 1 << 14
UNIT = 1 << 22
#: Labels of either kind that a language's threshold needs.
LEAST = 5
#: A power of two.
BUCKETS = 1 << 17
PREFIXES = (4, 7)
#: Documents that a bucket's share of toxic ones is drawn to the mean by.
PRIOR = 10
DIMENSIONS = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
#: Zero rows after each text: one more than a window needs, so that an empty text has a window too.
PAD = max(WIDTHS) + 1


@dataclass
class Model:
    embedding: np.ndarray  # row of a word is its bucket + 1, row 0 is zero
    filters: list[np.ndarray]  # width x dimensions x filters
    bias: np.ndarray
    weights: np.ndarray
    offset: float

    def score(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The score of each text; texts lie one after the other as rows of the embedding, some for each word."""
        if not len(sizes):
            return np.zeros(0)
        return self.pooled_score(pooled(self, *padded(rows, sizes), sizes))

    def answers(self, ids: np.ndarray) -> np.ndarray:
        """What the filters answer at each place of padded rows where the widest fits."""
        return convolved(sum(self.embedding.take(k, axis=0, mode="clip") for k in ids), self.filters)

    def pooled_score(self, top: np.ndarray) -> np.ndarray:
        pool = np.maximum(top + self.bias, 0)
        # Rounded, so that the order in which products are summed, which is that of a batch, doesn't show.
        return np.round(1 / (1 + np.exp(-np.clip(pool @ self.weights + self.offset, -30, 30))), 9)


def word_rows(mapped: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """For each word the rows of the embedding that make up its own."""
    sums, rows = powers.sums(mapped), np.empty((1 + len(PREFIXES), len(starts)), np.int32)
    for i, stops in enumerate((ends, *(np.minimum(starts + k, ends) for k in PREFIXES))):
        rows[i] = mixed(powers.between(sums, starts, stops) + np.uint64(i)) & np.uint64(BUCKETS - 1)
    rows += 1
    return rows.T


def padded(rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with PAD zero rows after each text, turned so that each word is a column, and where the texts start."""
    out = np.zeros((rows.shape[1], len(rows) + PAD * len(sizes)), np.int32)
    at = np.arange(len(rows)) + PAD * np.repeat(np.arange(len(sizes)), sizes)
    for into, k in zip(out, rows.T, strict=True):
        into[at] = k
    return out, np.cumsum(sizes + PAD) - sizes - PAD


def convolved(vectors: np.ndarray, filters: list[np.ndarray]) -> np.ndarray:
    """The answers of each filter, a row, at each place where the widest fits; filters of a width stand together."""
    n = len(vectors) - max(map(len, filters)) + 1
    parts = np.concatenate([x.T for w in filters for x in w]) @ vectors.T
    out = np.empty((sum(w.shape[2] for w in filters), n))
    done = at = 0
    for w in filters:
        own = out[at : at + w.shape[2]]
        for j in range(len(w)):
            part = parts[done : done + len(own), j : n + j]
            own[:] = own + part if j else part
            done += len(own)
        at += len(own)
    return out


def pooled(m: Model, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The largest answer of each filter at the places of each text's own words; an empty text has one place."""
    wide = max(map(len, m.filters))
    places, ends = ids.shape[1] - wide + 1, starts + np.maximum(sizes, 1)
    cuts = np.unique(np.concatenate([starts, ends, np.arange(0, places, PLACES)]))
    tops = []
    for lo in range(0, places, PLACES):
        first, last = np.searchsorted(cuts, (lo, lo + PLACES))
        tops.append(np.maximum.reduceat(m.answers(ids[:, lo : lo + PLACES + wide - 1]), cuts[first:last] - lo, axis=1))
    owner = np.searchsorted(starts, cuts, "right") - 1
    own = np.flatnonzero(cuts < ends[owner])
    return np.maximum.reduceat(np.concatenate(tops, axis=1)[:, own], np.searchsorted(owner[own], np.arange(len(starts))), axis=1).T


class _Adam:
    def __init__(self, values: list[np.ndarray], rate: float) -> None:
        self.values, self.rate, self.t = values, rate, 0
        self.m, self.v = [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values]

    def step(self, grads: list[np.ndarray], rows: np.ndarray) -> None:
        """One step; the first gradient is that of these rows of the first value, whose others stay."""
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for i, (x, g, m, v) in enumerate(zip(self.values, grads, self.m, self.v, strict=True)):
            at = slice(None) if i else rows
            mean, square = m[at], v[at]
            mean = mean + 0.1 * (g - mean)
            square = square + 0.001 * (g * g - square)
            m[at], v[at] = mean, square
            x[at] -= rate * mean / (np.sqrt(square) + 1e-8)


def strongest(model: Model, texts: list[np.ndarray], most: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """For each text and filter the largest answer, and the rows of the embedding in its window; rows beyond the filter's width are zero.
    Texts are read in pieces of so many words, so that a long one takes no more room."""
    wide, filters = max(WIDTHS), np.arange(len(model.bias))
    cuts = [(i, lo, min(lo + most, len(t))) for i, t in enumerate(texts) for lo in range(0, max(len(t), 1), most)]
    top, windows = np.full((len(texts), len(filters)), -np.inf), np.zeros((len(texts), len(filters), wide, 1 + len(PREFIXES)), np.int64)
    ends = np.cumsum([0, *(hi - lo for _, lo, hi in cuts)])
    for first, last in _runs(ends, most):  # a text has no two pieces in a run
        some = cuts[first:last]
        rows = [texts[i][lo : hi + wide - 1] for i, lo, hi in some]
        ids, starts = padded(np.concatenate(rows), np.array([len(r) for r in rows]))
        answers = np.concatenate([model.answers(ids[:, k : k + PLACES + wide - 1]) for k in range(0, ids.shape[1] - wide + 1, PLACES)], axis=1)
        at = np.stack([s + answers[:, s : s + max(hi - lo, 1)].argmax(axis=1) for (_, lo, hi), s in zip(some, starts, strict=True)])
        value, of = answers[filters, at], np.array([i for i, _, _ in some])
        text, own = np.nonzero(value > top[of])
        top[of[text], own] = value[text, own]
        windows[of[text], own] = np.moveaxis(ids[:, at[text, own][:, None] + np.arange(wide)], 0, 2)
    for k, w in enumerate(WIDTHS):
        windows[:, FILTERS * k : FILTERS * (k + 1), w:] = 0
    return top, windows


def _runs(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring items of no more than `most` together, or single ones."""
    first = 0
    while first < len(ends) - 1:
        last = max(int(np.searchsorted(ends, ends[first] + most, "right")) - 1, first + 1)
        yield first, last
        first = last


def started(odds: np.ndarray, share: float, seed: int = 1) -> Model:
    """The first dimension of the embedding starts from log odds, the others from zero, filters from random values."""
    rng = np.random.default_rng(seed)
    filters = FILTERS * len(WIDTHS)
    m = Model(np.zeros((BUCKETS + 1, DIMENSIONS)), [rng.normal(0, 0.3, (k, DIMENSIONS, FILTERS)) for k in WIDTHS], np.zeros(filters), np.zeros(filters), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    if 0 < share < 1:
        m.embedding[:, 0] = np.clip(odds, -2, 2)
        m.embedding[0] = 0
        for w in m.filters:
            w[:, 0] = np.abs(w[:, 0])
        m.weights[:] = rng.normal(0, 0.1, filters)
    return m


def log_odds(with_word: np.ndarray, toxic: np.ndarray, mean: float) -> np.ndarray:
    """How much more documents with a bucket are toxic than others, in logarithms."""
    if not 0 < mean < 1:
        return np.zeros(len(toxic))
    share = (toxic + PRIOR * mean) / (with_word + PRIOR)
    return np.log(share / (1 - share)) - np.log(mean / (1 - mean))


class Trainer:
    """Moves a copy of a model by batches of texts."""

    def __init__(self, m: Model, seed: list[int]) -> None:
        self.model = Model(m.embedding.copy(), [w.copy() for w in m.filters], m.bias.copy(), m.weights.copy(), m.offset)
        self.offset, self.rng = np.array([m.offset]), np.random.default_rng(seed)
        self.adam = _Adam([self.model.embedding, *self.model.filters, self.model.bias, self.model.weights, self.offset], 0.01)

    def step(self, texts: list[np.ndarray], y: np.ndarray) -> None:
        m = self.model
        top, windows = strongest(m, texts)
        used, at = np.unique(windows, return_inverse=True)
        at = at.reshape(windows.shape)
        known = m.embedding[used]
        vectors = known[at].sum(axis=3)
        pool = np.maximum(top + m.bias, 0)
        kept = self.rng.random(pool.shape) > 0.2
        score = 1 / (1 + np.exp(-np.clip((pool * kept / 0.8) @ m.weights + self.offset[0], -30, 30)))
        wrong = (score - y) / len(y)
        d_pool = np.outer(wrong, m.weights) * kept / 0.8 * (pool > 0)
        d_known, d_vectors, d_filters = 1e-6 * known, np.zeros_like(vectors), []
        for k, w in enumerate(m.filters):
            own = slice(FILTERS * k, FILTERS * (k + 1))
            g = d_pool[:, own]
            d_vectors[:, own, : len(w)] = np.einsum("bf,jdf->bfjd", g, w)
            d_filters.append(np.einsum("bfjd,bf->jdf", vectors[:, own, : len(w)], g) + 1e-4 * w)
        for k in np.moveaxis(at, 3, 0):
            d_known += np.bincount((DIMENSIONS * k[..., None] + np.arange(DIMENSIONS)).ravel(), d_vectors.ravel(), d_known.size).reshape(d_known.shape)
        d_known[used == 0] = 0
        self.adam.step([d_known, *d_filters, d_pool.sum(0), (pool * kept / 0.8).T @ wrong + 1e-4 * m.weights, np.array([wrong.sum()])], used)
        m.offset = float(self.offset[0])


def best_threshold(score: np.ndarray, y: np.ndarray, least: int = LEAST) -> float:
    """The threshold of the highest F1, in the middle between two scores; 0.5 with fewer than `least` labels of either kind."""
    if min(y.sum(), len(y) - y.sum()) < least:
        return 0.5
    order = np.argsort(-score, kind="stable")
    s, hits = score[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(len(y)) + 1 + y.sum())
    f1[:-1][s[1:] == s[:-1]] = -1
    i = int(f1.argmax())
    return float((s[i] + s[i + 1]) / 2) if i + 1 < len(s) else float(s[i])


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5))


def word_ids(c: Chunk, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the words of a chunk's texts, and how many words each has. A long text is read in parts that end between words."""
    if len(c) > 1 or len(c.data) <= 2 * CHUNK:
        mapped, starts, ends, bounds = c.words(ALNUM_LOWER)
        return word_rows(mapped, starts, ends, powers), np.diff(bounds)
    parts, lo = [], 0
    while lo < len(c.data):
        hi = min(lo + CHUNK, len(c.data))
        while hi < len(c.data) and ALNUM_LOWER[c.data[hi - 1]]:
            stops = np.flatnonzero(ALNUM_LOWER[c.data[hi : hi + CHUNK]] == 0)
            hi = hi + int(stops[0]) + 1 if len(stops) else min(hi + CHUNK, len(c.data))
        mapped, starts, ends, _ = c.part(lo, hi).words(ALNUM_LOWER)
        parts.append(word_rows(mapped, starts, ends, powers))
        lo = hi
    rows = np.concatenate(parts)
    return rows, np.array([len(rows)])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int, float, str]]:
    """Words, half, label and language of each row of text, half, toxic, lang."""
    powers = Powers()
    for b in batches:
        half, toxic, lang = b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_pylist()
        for c in chunks(b.column(0)):
            rows, sizes = word_ids(c, powers)
            for i, text in enumerate(np.split(rows, np.cumsum(sizes)[:-1]), c.rows.start):
                yield text, int(half[i]), float(toxic[i]), lang[i]


def _together(examples: Iterator[tuple[np.ndarray, int, float, str]]) -> Iterator[list[tuple[np.ndarray, int, float, str]]]:
    """Examples of about PIECE words, so that a long text stands alone or last."""
    some, words = [], 0
    for r in examples:
        some.append(r)
        words += len(r[0]) + PAD
        if words > PIECE:
            yield some
            some, words = [], 0
    if some:
        yield some


def _blocks(parts: list[np.ndarray]) -> pa.RecordBatch:
    """Whole numbers of each part cut into blocks; those of zeros are left out."""
    kept = [(p, k, v[at : at + BLOCK].astype(np.int32)) for p, v in enumerate(parts) for k, at in enumerate(range(0, len(v), BLOCK)) if v[at : at + BLOCK].any()]
    offsets = np.cumsum([0, *(len(v) for _, _, v in kept)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *(v for _, _, v in kept)])))
    return pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in kept], pa.int32()), pa.array([k for _, k, _ in kept], pa.int32()), lists], names=["part", "block", "values"])


_PARTS = "part int, block int, values array<int>"


def _summed(parts: DataFrame, length: int, each: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each part the sums of its blocks, and of how many rows the values, `each` together, are not all zero. Whole numbers add up alike in any order."""

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(rows["values"].iloc[0]), np.int64)
        count = np.zeros(len(total) // each, np.int64)
        for v in rows["values"]:
            total += v
            count += v.reshape(-1, each).any(axis=1)
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "block": [rows["block"].iloc[0]], "total": [total], "count": [count]})

    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in parts.groupBy("part", "block").applyInPandas(added, "part int, block int, total array<long>, count array<long>").toArrow().to_batches():
        for i, (part, block) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            for into, at, k in zip(out.setdefault(part, (np.zeros(length, np.int64), np.zeros(length // each, np.int64))), (block * BLOCK, block * BLOCK // each), (2, 3), strict=True):
                values = b.column(k)[i].values.to_numpy()
                into[at : at + len(values)] = values
    return out


def _counts(examples: DataFrame) -> np.ndarray:
    """By half: how many texts have a bucket, and how many of those are toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 2, BUCKETS), np.int64)
        for text, half, toxic, _ in _examples(batches):
            found = np.unique(text) - 1
            counts[half, 0, found] += 1
            counts[half, 1, found] += int(toxic > 0)
        yield _blocks(list(counts.reshape(4, BUCKETS)))

    sums = _summed(examples.mapInArrow(run, _PARTS), BUCKETS, 1)
    return np.stack([sums[p][0] if p in sums else np.zeros(BUCKETS, np.int64) for p in range(4)]).reshape(2, 2, BUCKETS)


def _dense(m: Model) -> np.ndarray:
    """All but the embedding as one array."""
    flat = np.concatenate([*(w.ravel() for w in m.filters), m.bias, m.weights, [m.offset]])
    return np.append(flat, np.zeros(-len(flat) % DIMENSIONS))


def _steps(old: Model, new: Model) -> np.ndarray:
    moved = np.concatenate([(new.embedding - old.embedding).ravel(), _dense(new) - _dense(old)])
    return np.rint(np.clip(moved * UNIT, -(1 << 30), 1 << 30)).astype(np.int64)


def _moved(m: Model, total: np.ndarray, count: np.ndarray) -> Model:
    """The model moved by the mean of the groups' steps, for each row of the embedding of those that moved it."""
    rows = BUCKETS + 1
    steps = total.reshape(-1, DIMENSIONS) / (np.maximum(count, 1) * UNIT)[:, None]
    dense = _dense(m) + (total[rows * DIMENSIONS :] / (max(count[rows:].max(), 1) * UNIT))
    shapes, at, parts = [*(w.shape for w in m.filters), m.bias.shape, m.weights.shape], 0, []
    for s in shapes:
        parts.append(dense[at : at + int(np.prod(s))].reshape(s))
        at += int(np.prod(s))
    return Model(m.embedding + steps[:rows], parts[:-2], parts[-2], parts[-1], float(dense[at]))


def _passed(examples: DataFrame, models: list[Model], number: int) -> list[Model]:
    """One pass: each group moves copies of the models by its rows, the first by all, the others by one half each; then their steps are averaged."""
    shared = examples.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old = shared.value
        trainers = [Trainer(m, [number, k]) for k, m in enumerate(old)]
        waiting: list[list[tuple[np.ndarray, float]]] = [[] for _ in old]

        def step(k: int) -> None:
            trainers[k].step([t for t, _ in waiting[k]], np.array([float(y > 0) for _, y in waiting[k]]))
            waiting[k] = []

        for text, half, toxic, _ in _examples(batches):
            for k in (0, 1 + half):
                waiting[k].append((text, toxic))
                if len(waiting[k]) == BATCH or sum(len(t) for t, _ in waiting[k]) > PIECE:
                    step(k)
        for k, rest in enumerate(waiting):
            if rest:
                step(k)
        yield _blocks([_steps(m, trainers[k].model) for k, m in enumerate(old)])

    sums = _summed(examples.mapInArrow(run, _PARTS), len(_steps(models[0], models[0])), DIMENSIONS)
    shared.unpersist()
    return [_moved(m, *sums[k]) if k in sums else m for k, m in enumerate(models)]


def score_bin(score: Column) -> Column:
    """One of some 2,000 bins that rise with the score; by log odds, since most scores are near 0 or 1."""
    return F.floor(50 * F.log(F.greatest(score, F.lit(1e-9)) / F.greatest(1 - score, F.lit(1e-9))))


def thresholds(scores: DataFrame) -> DataFrame:
    """lang and threshold, as best_threshold has it, of each language with `least` labels of either kind; scores has lang, score, hit (0 or 1)."""
    found = scores.groupBy("lang", "score").agg(F.count("*").alias("n"), F.sum("hit").alias("hits")).withColumn("bin", score_bin(F.col("score")))
    found = checkpoint(found)
    above = Window.partitionBy("lang").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("lang")
    bins = found.groupBy("lang", "bin").agg(F.sum("n").alias("all"), F.sum("hits").alias("bad")).select(
        "lang", "bin", F.coalesce(F.sum("all").over(above), F.lit(0)).alias("n_above"), F.coalesce(F.sum("bad").over(above), F.lit(0)).alias("bad_above"), F.sum("all").over(whole).alias("rows"), F.sum("bad").over(whole).alias("toxic")
    )
    inside = Window.partitionBy("lang", "bin").orderBy(F.desc("score"))
    at = found.join(bins, ["lang", "bin"]).where(F.least("toxic", F.col("rows") - F.col("toxic")) >= LEAST)
    at = at.withColumn("f1", 2 * (F.col("bad_above") + F.sum("hits").over(inside)) / (F.col("n_above") + F.sum("n").over(inside) + F.col("toxic")))
    best = checkpoint(at.groupBy("lang").agg(F.max(F.struct("f1", "score")).alias("b")).select("lang", F.col("b.score").alias("best")))
    below = found.join(F.broadcast(best) if small(best) else best, "lang").where("score <= best").groupBy("lang", "best").agg(F.max(F.when(F.col("score") < F.col("best"), F.col("score"))).alias("next"))
    return checkpoint(below.select("lang", ((F.col("best") + F.coalesce("next", "best")) / 2).alias("threshold")))


def labelled(documents: DataFrame, labels: DataFrame, group_rows: int = GROUP_ROWS, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, list]:
    """All labelled texts that are not held out, one group of rows a partition, in an order by hash; and their number, bytes and labels by half."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = checkpoint(marked.where(remainder(F.col("doc_id")) != 0))
    # Hashes and bytes are taken before the join, so that sizes need no texts there.
    texts = documents.where(remainder(F.col("doc_id")) != 0).select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang"), F.xxhash64("text").alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    found = texts.join(F.broadcast(marked), "doc_id") if small(marked) else likely_among(texts, marked, "doc_id").join(marked, "doc_id")
    found = found.withColumn("half", F.pmod(F.xxhash64("key", "doc_id"), F.lit(2)).cast("int"))
    keys = ["doc_id", "key", "lang"]
    sizes = found.select(*keys, "half", "toxic", "bytes").distinct().groupBy("half").agg(F.count("*"), F.count_if(F.col("toxic") > 0), F.sum("bytes")).collect()
    groups = max(1, -(-sum(r[1] for r in sizes) // group_rows), -(-sum(r[3] for r in sizes) // group_bytes))
    dealt = found.repartition(groups, *keys).dropDuplicates(keys).sortWithinPartitions(F.xxhash64("doc_id", "key"), *keys)
    return checkpoint(dealt.select("text", "half", "toxic", "lang")), sizes


def fit(documents: DataFrame, labels: DataFrame, group_rows: int = GROUP_ROWS) -> tuple[Model, DataFrame]:
    """The model, trained on all labelled documents that are not held out, and thresholds by language, from the scores that models
    of one half of these documents give the other half."""
    examples, sizes = labelled(documents, labels, group_rows)
    rows, toxic = np.zeros(2), np.zeros(2)
    for half, n, bad, _ in sizes:
        rows[half], toxic[half] = n, bad
    counts = _counts(examples) if sizes else np.zeros((2, 2, BUCKETS), np.int64)
    models = []
    for of in (slice(0, 2), slice(0, 1), slice(1, 2)):
        mean = float(toxic[of].sum() / max(rows[of].sum(), 1))
        models.append(started(np.append(0, log_odds(*counts[of].sum(axis=0), mean)), mean))
    if 0 < toxic.sum() < rows.sum():
        for number in range(min(MOST_PASSES, max(PASSES, -(-MOST_PASSES * GROUP_ROWS // int(rows.sum()))))):
            models = _passed(examples, models, number)
    shared = examples.sparkSession.sparkContext.broadcast(models[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _together(_examples(batches)):
            scores, half = np.zeros(len(some)), np.array([r[1] for r in some])
            for k, m in enumerate(shared.value):
                others = [some[i][0] for i in np.flatnonzero(half != k)]
                if others:
                    scores[half != k] = m.score(np.concatenate(others), np.array([len(t) for t in others]))
            yield pa.RecordBatch.from_pydict({"lang": [r[3] for r in some], "score": scores, "hit": pa.array([int(r[2] > 0) for r in some], pa.int32())})

    return models[0], thresholds(examples.mapInArrow(run, "lang string, score double, hit int"))


def scored(documents: DataFrame, m: Model) -> DataFrame:
    """doc_id, lang and score of each document."""
    shared = documents.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, powers = shared.value, Powers()
        for b in batches:
            out = np.zeros(b.num_rows)
            for c in chunks(b.column(2)):
                out[c.rows] = model.score(*word_ids(c, powers))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], names=["doc_id", "lang", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "lang", "text").mapInArrow(run, f"doc_id {kind}, lang string, score double")


def judged(documents: DataFrame, labels: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and flagged: whether the score reaches the threshold of the document's language."""
    m, by_language = fit(documents, labels, group_rows)
    rows = scored(documents, m).withColumn("lang", F.coalesce("lang", F.lit(""))).join(F.broadcast(by_language) if small(by_language) else by_language, "lang", "left")
    return rows.select(
        "doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= F.coalesce("threshold", F.lit(0.5))).cast("int").alias("flagged")
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
