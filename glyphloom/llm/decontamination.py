"""Benchmark decontamination with an FM-index for each shard of the training texts.

A shard is up to SHARD_WORDS words of an Arrow batch of documents. Its words become numbers in the benchmark's vocabulary; a
word outside of it breaks the text, since no window can hold it, and so runs of known words shorter than the shortest window
can go without loss. Over what is left a shard builds its suffix array, its Burrows-Wheeler transform in a wavelet matrix,
and samples of suffix positions; windows of which the shard has all words are searched backward together, their occurrences
located by walking to a sampled suffix, and the words they cover merged into spans. A text over CHUNK bytes is read in parts
that share a window's words, so that memory follows the part and not the text.

Words are compared by 64-bit hashes, windows of the benchmark by hashes of these. The benchmark's items are cut into pieces
that share a window's words, and dealt to blocks of about BLOCK_WORDS; tasks build the blocks, and each goes to the executors
as a few arrays of numbers, one at a time. With more than one block the texts are read once for each, and what they hit, by a
hash of the row, is joined with them at the end.

Defined results: a null or empty text has no words and no hit; an item without words has no window; items that repeat an
id share it, an item without an id is listed as the empty string; repeated documents are each reported; an empty table of
documents has an empty result, an empty benchmark no hits; extra columns are ignored by the query and kept by `decontaminate`, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphloom.llm._ragged import ALNUM_LOWER, CHUNK, Chunk, Powers, chunks, mixed
from glyphloom.llm._shared import checkpoint, row_key, small, table

WINDOW = 10
#: Words of the benchmark that are sent to the executors at once, and those of an item that stay in one piece.
BLOCK_WORDS, PIECE_WORDS = 1 << 20, 1 << 16
#: Known words that one index holds, and windows that are searched at once.
SHARD_WORDS, SEARCHED = 1 << 20, 1 << 16
#: Spans and items of all rows that go to all tasks; more are joined.
BROADCAST_FOUND = 2_000_000
#: One suffix position in so many is kept.
SAMPLE = 8

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FOUND = T.StructType([T.StructField("left", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])


@dataclass
class Patterns:
    """vocabulary: sorted word hashes; a word's number is its place + 1. words: the numbers of the words of all pieces. windows: by
    length, where in words each different window starts. of: window to its items, by bounds."""

    vocabulary: np.ndarray
    words: np.ndarray
    windows: dict[int, np.ndarray]
    bounds: np.ndarray
    of: np.ndarray
    items: list[str]

    @property
    def shortest(self) -> int:
        return min(self.windows, default=0)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1 ... of each range, one range after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def patterns(ids: list[str], hashes: np.ndarray, sizes: np.ndarray, window: int = WINDOW) -> Patterns:
    """Of pieces of items: their ids, the hashes of their words one piece after the other, and how many words each has."""
    names = sorted(set(ids))
    number = {k: i for i, k in enumerate(names)}
    item = np.array([number[i] for i in ids], np.int64)
    vocabulary, words = np.unique(hashes, return_inverse=True)
    at, length = np.cumsum(sizes) - sizes, np.minimum(sizes, window)
    windows, keys, total = {}, [np.zeros(0, np.int64)], 0
    for n in np.unique(length[length > 0]).tolist():
        those = np.flatnonzero(length == n)
        many = sizes[those] - n + 1
        starts = ranges(at[those], many)
        key = np.zeros(len(starts), np.uint64)
        for k in range(n):
            key = mixed(key * np.uint64(31) + hashes[starts + k])
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        keys.append(np.unique((which.reshape(-1) + total) * len(names) + np.repeat(item[those], many)))
        windows[n], total = starts[first].astype(np.int32), total + len(first)
    joined = np.concatenate(keys)
    bounds = np.searchsorted(joined // max(len(names), 1), np.arange(total + 1))
    return Patterns(vocabulary, words.astype(np.int32) + 1, windows, bounds.astype(np.int32), (joined % max(len(names), 1)).astype(np.int32), names)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By doubling: suffixes are sorted by their first 1, 2, 4 ... symbols until all differ."""
    n, step = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[: max(n - step, 0)] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank[order] = new
        step *= 2
        if new[-1] == n - 1:
            return order


class WaveletMatrix:
    """Ranks of symbols: how often c stands before place i."""

    def __init__(self, symbols: np.ndarray, top: int) -> None:
        self.levels = []
        for bit in range(max(1, top.bit_length()) - 1, -1, -1):
            ones = (symbols >> bit) & 1
            ranks = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(ones, out=ranks[1:])
            self.levels.append((bit, ranks, len(symbols) - int(ranks[-1])))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo = np.zeros_like(i)
        for bit, ranks, zeros in self.levels:
            one = ((c >> bit) & 1).astype(bool)
            lo = np.where(one, zeros + ranks[lo], lo - ranks[lo])
            i = np.where(one, zeros + ranks[i], i - ranks[i])
        return i - lo


class FmIndex:
    def __init__(self, text: np.ndarray, sample: int = SAMPLE) -> None:
        order = suffix_array(text)
        self.last = text[order - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text))))
        self.matrix = WaveletMatrix(self.last, int(text.max()))
        sampled = order % sample == 0
        self.sampled, self.at, self.positions = sampled, np.cumsum(sampled) - 1, order[sampled]

    def back(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.before[c] + self.matrix.rank(c, i)

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of symbols the range of suffixes that start with it."""
        known = (windows < len(self.before) - 1).all(1)
        lo, hi = np.zeros(len(windows), np.int64), np.where(known, len(self.last), 0)
        for k in range(windows.shape[1] - 1, -1, -1):
            live = np.flatnonzero(hi > lo)
            c = windows[live, k]
            lo[live], hi[live] = self.back(c, lo[live]), self.back(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: each walks back to a sampled one."""
        rows, steps, out = rows.copy(), 0, np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            there = self.sampled[rows[live]]
            done = live[there]
            out[done] = self.positions[self.at[rows[done]]] + steps
            live, steps = live[~there], steps + 1
            rows[live] = self.back(self.last[rows[live]], rows[live])
        return out


def parts(c: Chunk, overlap: int, most: int = CHUNK) -> Iterator[tuple[Chunk, int, int]]:
    """A chunk, or parts of one long text, which end between words and share `overlap` words with the one before: the part, the
    byte and the word that it starts with."""
    if len(c) > 1 or len(c.data) <= 2 * most:
        yield c, 0, 0
        return
    start, word, end = 0, 0, 0
    while end < len(c.data):
        end = min(end + most, len(c.data))
        while end < len(c.data) and ALNUM_LOWER[c.data[end]]:
            rest = np.flatnonzero(ALNUM_LOWER[c.data[end : end + most]] == 0)
            end = min(end + most, len(c.data)) if not len(rest) else end + int(rest[0])
        part = c.part(start, end)
        yield part, start, word
        starts = part.words(ALNUM_LOWER)[1]
        shared = min(overlap, len(starts))
        word += len(starts) - shared
        start = start + int(starts[-shared]) if shared else end


def known_runs(c: Chunk, p: Patterns, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; symbols of the runs of known words, a 0 after each; the text and the word of each symbol."""
    mapped, starts, ends, bounds = c.words(ALNUM_LOWER)
    n_words, none = np.diff(bounds), np.zeros(0, np.int64)
    if not len(starts) or not len(p.vocabulary):
        return n_words, none, none, none
    hashes = powers.spans(mapped, starts, ends)
    at = np.minimum(np.searchsorted(p.vocabulary, hashes), len(p.vocabulary) - 1)
    ids = np.where(p.vocabulary[at] == hashes, at + 1, 0)
    of = np.repeat(np.arange(len(c)), n_words)
    cut = np.flatnonzero(np.diff(ids != 0, prepend=False) | (np.diff(of, prepend=-1) != 0))
    sizes = np.diff(np.append(cut, len(ids)))
    long = (ids[cut] != 0) & (sizes >= p.shortest)
    cut, sizes = cut[long], sizes[long]
    take = ranges(cut, sizes + 1)
    breaks = np.cumsum(sizes + 1) - 1
    take[breaks] = cut
    ids = ids[take]
    ids[breaks] = 0
    return n_words, ids, of[take] + c.rows.start, take - bounds[of[take]]


def occurrences(symbols: np.ndarray, p: Patterns) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Places in symbols where windows stand, the windows' numbers, and their length. Symbols start with a 0."""
    own = np.unique(symbols)
    local = np.zeros(len(p.vocabulary) + 1, np.int64)
    local[own] = np.arange(len(own))
    absent = np.concatenate(([0], np.cumsum(local[p.words] == 0)))
    index, first = FmIndex(local[symbols]), 0
    for n, starts in p.windows.items():
        live = np.flatnonzero(absent[starts + n] == absent[starts])
        for some in np.split(live, range(SEARCHED, len(live), SEARCHED)):
            lo, hi = index.search(local[p.words[starts[some][:, None] + np.arange(n)]])
            yield index.locate(ranges(lo, hi - lo)), np.repeat(some + first, hi - lo), n
        first += len(starts)


def search(texts: pa.Array, p: Patterns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; occurrences as (text, first word, end word), and as pairs (text, item)."""
    powers, n_words = Powers(), np.zeros(len(texts), np.int64)
    spans, pairs = [np.zeros((0, 3), np.int64)], [np.zeros((0, 2), np.int64)]
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def found() -> None:
        if not sum(len(s) for s, _, _ in waiting):
            return
        symbols, rows, places = (np.concatenate(([0], *x)) for x in zip(*waiting, strict=True))
        for at, which, n in occurrences(symbols, p):
            spans.append(np.unique(np.stack([rows[at], places[at], places[at] + n], axis=1), axis=0))
            counts = p.bounds[which + 1] - p.bounds[which]
            pairs.append(np.unique(np.stack([np.repeat(rows[at], counts), p.of[ranges(p.bounds[which], counts)]], axis=1), axis=0))

    for c in chunks(texts):
        for part, _, word in parts(c, max(p.windows, default=1) - 1):
            n, symbols, rows, places = known_runs(part, p, powers)
            n_words[c.rows] = n + word
            waiting.append((symbols, rows, places + word))
            if sum(len(s) for s, _, _ in waiting) > SHARD_WORDS:
                found()
                waiting.clear()
    found()
    return n_words, np.concatenate(spans), np.unique(np.concatenate(pairs), axis=0)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap become one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them. Spans are in order and apart."""
    c, bounds = Chunk(slice(0, 1), [text]), np.array(spans, np.int64)
    first, last = bounds[:, 0], bounds[:, 1] - 1
    cuts = np.zeros_like(bounds)
    for part, at, word in parts(c, 0):
        _, starts, ends, _ = part.words(ALNUM_LOWER)
        for column, words, edges in ((0, first, starts), (1, last, ends)):
            here = (words >= word) & (words < word + len(edges))
            cuts[here, column] = at + edges[words[here] - word]
    raw, kept, done = c.data.tobytes(), [], 0
    for lo, hi in cuts.tolist():
        kept.append(raw[done:lo])
        done = hi
    return b"".join([*kept, raw[done : len(raw) - 1]]).decode()


def _as_found(texts: pa.Array, n_words: np.ndarray, spans: list[list[tuple[int, int]]], items: list[list[str]], clean: bool) -> pa.Array:
    left = [without(texts[i].as_py(), x) if x and clean else None for i, x in enumerate(spans)]
    as_spans = pa.array([[{"start": lo, "end": hi} for lo, hi in x] for x in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
    return pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(n_words), as_spans, pa.array(items, pa.list_(pa.string()))], names=["left", "n_words", "spans", "items"])


def _searched(shared: Broadcast[Patterns], clean: bool) -> Callable[[Column], Column]:
    """A function of a text: its words, spans and items, and if it is to be cleaned and has spans, what is left of it."""

    def run(texts: pa.Array) -> pa.Array:
        n_words, places, pairs = search(texts, shared.value)
        spans: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
        items: list[list[str]] = [[] for _ in range(len(texts))]
        for i, lo, hi in places.tolist():
            spans[i].append((lo, hi))
        for i, k in pairs.tolist():
            items[i].append(shared.value.items[k])
        return _as_found(texts, n_words, [merged(x) for x in spans], [sorted(x) for x in items], clean)

    return F.arrow_udf(run, FOUND).asNondeterministic()


def _joined(clean: bool) -> Callable[[Column, Column, Column], Column]:
    """The same of a text and of what blocks have found in it, spans (start, end) and items, in any order."""

    def run(texts: pa.Array, known: pa.Array, items: pa.Array) -> pa.Array:
        n_words = search(texts, NOTHING)[0]
        spans = [merged([(s["start"], s["end"]) for s in x or ()]) for x in known.to_pylist()]
        return _as_found(texts, n_words, spans, [sorted(set(x or ())) for x in items.to_pylist()], clean)

    return F.arrow_udf(run, FOUND).asNondeterministic()


NOTHING = patterns([], np.zeros(0, np.uint64), np.zeros(0, np.int64))


def pieces(benchmark: DataFrame, window: int = WINDOW, most: int = PIECE_WORDS) -> DataFrame:
    """The benchmark's different pieces: id, and the hashes of up to `most` words; pieces of an item share window - 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            for c in chunks(b.column(1)):
                hashes, bounds = [], [0]
                for part, _, _ in parts(c, 0):
                    mapped, starts, ends, of = part.words(ALNUM_LOWER)
                    hashes.append(powers.spans(mapped, starts, ends).view(np.int64))
                    bounds = of.tolist() if len(c) > 1 else [0, bounds[-1] + len(starts)]
                joined = np.concatenate(hashes)
                cut = [(i, at, min(at + most, hi)) for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if hi > lo for at in range(lo, max(hi - window + 1, lo + 1), most - window + 1)]
                ids = pa.array([b.column(0)[c.rows.start + i].as_py() for i, _, _ in cut], pa.string())
                yield pa.RecordBatch.from_arrays([ids, pa.array([joined[lo:hi] for _, lo, hi in cut], pa.list_(pa.int64()))], names=["id", "words"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return items.mapInArrow(run, "id string, words array<long>").distinct()


def blocks_of(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, int]:
    """block and data, the Patterns of each block, built by tasks; and how many blocks there are at most."""
    cut = checkpoint(pieces(benchmark, window, min(PIECE_WORDS, max(block_words, 2 * window))))
    blocks = -(-(cut.agg(F.sum(F.size("words"))).first()[0] or 0) // block_words)
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("id", "words"), F.lit(max(blocks, 1))).cast("int"))

    def build(of: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        words = rows.column("words").combine_chunks()
        sizes = np.diff(words.offsets.to_numpy()).astype(np.int64)
        found = patterns(rows.column("id").to_pylist(), words.flatten().to_numpy().view(np.uint64), sizes, window)
        return pa.table({"block": pa.array([of[0].as_py()], pa.int32()), "data": pa.array([pickle.dumps(found)], pa.binary())})

    return checkpoint(dealt.groupBy("block").applyInArrow(build, "block int, data binary")), blocks


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, clean: bool = False, block_words: int = BLOCK_WORDS) -> DataFrame:
    """row (a struct of all columns of documents), text, n_words, spans of hit words and the items found, by id as text."""
    context = documents.sparkSession.sparkContext
    built, blocks = blocks_of(benchmark, window, block_words)
    some = (pickle.loads(r["data"]) for k in range(blocks) if (r := built.where(F.col("block") == k).first()))
    if blocks <= 1:
        add = _searched(context.broadcast(next(some, NOTHING)), clean)
        rows = documents.select(F.struct(*documents.columns).alias("row"), add(F.col("text")).alias("found"))
    else:
        hits: DataFrame | None = None
        for p in some:
            shared = context.broadcast(p)
            found = documents.select(row_key(documents).alias("key"), _searched(shared, False)(F.col("text")).alias("found"))
            found = checkpoint(found.where(F.size("found.spans") > 0).select("key", "found.spans", "found.items").dropDuplicates(["key"]))
            hits = found if hits is None else hits.unionByName(found)
            shared.destroy()
        known = checkpoint(hits.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items")))
        keyed = documents.select(F.struct(*documents.columns).alias("row"), row_key(documents).alias("key"))
        size = known.agg(F.sum(F.size("spans") + F.size("items"))).first()[0] or 0
        both = keyed.join(F.broadcast(known) if size <= BROADCAST_FOUND and small(known) else known, "key", "left")
        rows = both.select("row", _joined(clean)(F.col("row")["text"], F.col("spans"), F.col("items")).alias("found"))
    return rows.select("row", F.coalesce(F.col("found")["left"], F.col("row")["text"]).alias("text"), "found.n_words", "found.spans", "found.items")


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """documents without the words that windows of the benchmark cover."""
    found = contamination(documents, benchmark, window, clean=True)
    return found.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in documents.columns))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


_SQL_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_SQL_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT item, w, least({WINDOW}, len(w)) AS n, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, coalesce({_SQL_WORDS}, []) AS w FROM documents),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, places.n, item FROM places JOIN windows ON places.phrase = windows.phrase AND places.n = windows.n),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN named m ON d.doc_id = m.doc_id
"""
