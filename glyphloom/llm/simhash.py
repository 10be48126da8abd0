"""SimHash near-duplicates: an index by positions of equal bytes with count filtering.

Fingerprints of 64 bits that differ in at most 4 have at least 4 of their 8 bytes in common, at the same positions.
Postings are keyed by byte positions with their bytes. Single bytes would make lists of 1/256 of all fingerprints, so a
posting takes `width` positions at once, from a family of position sets of which any 4 positions contain one: no link is
lost, and lists stay short. Within a list the shared positional bytes of each pair are tallied, pairs with 4 or more
retained, and their bits compared. Lists of over BLOCK fingerprints are split into blocks; each pair of blocks is one
group, so that no task holds a whole hot list; of a large group only the links of a spanning forest are emitted. Keys with
many rows (a common fingerprint, the hub of a star) are joined without being dealt to one task.

Defined results: a null text has no words; texts without words have fingerprint zero, linked as any other; a null
doc_id has a fingerprint and takes part in links, but is never the smallest of a component (a component of nulls alone
has none); repeated rows come out as often as they came in; an empty table has an empty result. Of each component
`keep_one` keeps the row of the smallest doc_id (null last), among rows of that id that of the least text hash, then of the
least hash of all columns, and one of rows equal in all; extra columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from glyphloom.llm._ragged import SPACED_LOWER, chunks
from glyphloom.llm._shared import checkpoint, hot_keys, join_dealt, row_key, small, table

SHINGLE_WORDS = 4
SEED = 42
MOST_BITS = 4
BYTES = 8
SHARED = BYTES - MOST_BITS
#: Fingerprints in a block of a long list, and the size up to which a group emits each of its links.
BLOCK = 2048
SMALL = 32
_BYTE = np.uint64(0xFF)
_LOW = np.uint64(0x0101010101010101)


def fingerprints(texts: pa.Array, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    found = np.zeros(len(texts), np.uint64)
    for c in chunks(texts):
        mapped, starts, ends, bounds = c.words(SPACED_LOWER)
        if not len(starts):
            continue
        # Words, each followed by one space, so that a shingle is one slice.
        lengths = ends - starts
        at = np.cumsum(lengths + 1) - lengths - 1
        take = mapped != 0
        take[ends] = True  # a separator follows each word
        joined = mapped[take]
        joined[joined == 0xFF] = 0
        joined[at + lengths] = 32
        raw = joined.tobytes()
        per = np.diff(bounds)
        shingles = np.where(per > 0, np.maximum(per - words + 1, 1), 0)
        first = np.repeat(bounds[:-1] - np.cumsum(shingles) + shingles, shingles) + np.arange(shingles.sum())
        last = np.minimum(first + words, np.repeat(bounds[1:], shingles)) - 1
        lo, hi = at[first].tolist(), (at[last] + lengths[last]).tolist()
        hashes = np.fromiter((xxh64_intdigest(raw[i:j], SEED) for i, j in zip(lo, hi, strict=True)), np.uint64, len(lo))
        found[c.rows] = majority(hashes, shingles)
    return found


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits that are set in over half of each group of hashes; groups lie one after the other."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    # Eight counters of a byte each are added at once, for 255 hashes at most.
    parts = -(-sizes[full] // 255)
    part_first = np.cumsum(parts) - parts
    begins = np.cumsum(sizes[full]) - sizes[full]
    starts = np.repeat(begins, parts) + 255 * (np.arange(parts.sum()) - np.repeat(part_first, parts))
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LOW, starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), part_first)
        bits = (2 * counts > sizes[full][:, None]).astype(np.uint64)
        for j in range(8):
            out[full] |= bits[:, j] << np.uint64(8 * j + k)
    return out


def with_fingerprints(documents: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, text_key (a hash of the text), row_key (of all columns) and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array(fingerprints(b.column(3), words).view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], found], names=["doc_id", "text_key", "row_key", "fp"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.xxhash64("text").alias("text_key"), row_key(documents).alias("row_key"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, row_key long, fp long")


def position_sets(width: int) -> list[tuple[int, ...]]:
    """Sets of `width` byte positions of which any SHARED positions contain one."""
    if width == SHARED:
        return list(combinations(range(BYTES), SHARED))
    chosen: list[tuple[int, ...]] = []
    if width == 2:  # among 4 positions two fall into one of three parts
        parts = ((0, 1, 2), (3, 4, 5), (6, 7))
        return [pair for part in parts for pair in combinations(part, 2)]
    for four in combinations(range(BYTES), SHARED):  # width 3, greedily
        if not any(set(c) <= set(four) for c in chosen):
            open_ = [f for f in combinations(range(BYTES), SHARED) if not any(set(c) <= set(f) for c in chosen)]
            chosen.append(max(combinations(four, width), key=lambda c: sum(set(c) <= set(f) for f in open_)))
    return chosen


def width_for(n: int) -> int:
    """Bytes in a posting's key, so that lists of evenly spread fingerprints keep some hundreds at most."""
    return 2 if n < 1 << 24 else 3 if n < 1 << 33 else SHARED


def postings(nodes: DataFrame, width: int) -> DataFrame:
    """fp and key: a row for each position set. A key holds the set's number above its bytes."""
    keys = []
    for i, positions in enumerate(position_sets(width)):
        key = F.lit(i << 8 * width)
        for k, p in enumerate(positions):
            key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(0xFF)), 8 * k))
        keys.append(key.cast("long"))
    return nodes.select("fp", F.explode(F.array(*keys)).alias("key"))


def groups(posted: DataFrame, block: int = BLOCK) -> DataFrame:
    """key, i, j, fp: the fingerprints of each list, or of each pair of blocks of a long list."""
    long = posted.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = posted.join(long, "key", "left").withColumn("own", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("blocks"))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    return dealt.select("key", "fp", "own", other.alias("other")).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The tally of equal positional bytes of each pair."""
    x = a ^ b
    x |= x >> np.uint64(4)
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return BYTES - np.bitwise_count(x & _LOW)


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The count filter, then the bits of the pairs that it retains."""
    x, enough = a ^ b, shared_bytes(a, b) >= SHARED
    enough[enough] = np.bitwise_count(x[enough]) <= MOST_BITS
    return enough


def _forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a group's links: breadth first, each fingerprint compared with those not reached yet."""
    left, a, b = fp.copy(), [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = _close(left, at)
            if near.any():
                new = left[near]
                a.append(np.full(len(new), at))
                b.append(new)
                front.extend(new)
                left = left[~near]
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def links_of_groups(fp: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the groups that lie one after the other and start at `first`. Groups up to SMALL give each link, compared
    at growing distance for all groups at once; larger ones give a spanning forest."""
    sizes = np.diff(np.append(first, len(fp)))
    a, b = [], []
    for s, n in zip(first[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        x, y = _forest(fp[s : s + n])
        a.append(x)
        b.append(y)
    ends = np.repeat(first + sizes, sizes)
    at = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    for d in range(1, SMALL):
        at = at[at + d < ends[at]]
        if not len(at):
            break
        near = _close(fp[at], fp[at + d])
        a.append(fp[at[near]])
        b.append(fp[at[near] + d])
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by group; a group that goes over the end of a batch waits for its rest."""
    kept: list[np.ndarray] = []

    def linked(rows: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(1)) + 1
        a, b = links_of_groups(rows[:, 3].copy().view(np.uint64), np.concatenate(([0], new)).astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        rows = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)], axis=1)
        if not len(rows):
            continue
        last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(1))
        if len(last):
            done, rows = np.concatenate([*kept, rows[: last[-1] + 1]]), rows[last[-1] + 1 :]
            kept = []
            yield linked(done)
        elif kept and (kept[0][0, :3] != rows[0, :3]).any():
            yield linked(np.concatenate(kept))
            kept = []
        kept.append(rows)
    if kept:
        yield linked(np.concatenate(kept))


def links(nodes: DataFrame, width: int | None = None, block: int = BLOCK) -> DataFrame:
    """a and b: links between different fingerprints of nodes (fp), enough of them to connect all that are linked."""
    posted = postings(nodes, width or width_for(nodes.count()))
    dealt = groups(posted, block).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = dealt.select("key", "i", "j", "fp").mapInArrow(_links, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each component, by large and small stars in turn until nothing changes, which
    takes a number of turns that is logarithmic in the longest chain."""
    edges = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    while True:
        both = edges.union(edges.select("v", "u"))
        least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        large = join_dealt(both, least.select("u", F.least("u", "m").alias("m")), "u", hot_keys(least, "u"))
        large = checkpoint(large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        near = checkpoint(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small_star = join_dealt(large, near.select("u", "m"), "u", hot_keys(near, "u"))
        ends = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = checkpoint(small_star.select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u != v").distinct())
        # Stars are flat when no centre hangs on another and no node on two.
        hung = edges.groupBy("u").agg(F.count("*").alias("n"))
        chained = edges.select(F.col("v").alias("u")).distinct().join(hung, "u", "left_semi")
        if chained.isEmpty() and hung.where("n > 1").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def clustered(documents: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, text_key, row_key, fp, root and component_id of each document."""
    rows = checkpoint(with_fingerprints(documents, words))
    nodes = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(links(nodes.select("fp")))
    named = checkpoint(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "n"))
    least = checkpoint(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    classes = join_dealt(named.select("fp", "root"), least.select("root", "component_id"), "root", hot_keys(least, "root"))
    return join_dealt(rows, classes, "fp", hot_keys(nodes, "fp")).select("doc_id", "text_key", "row_key", "fp", "root", "component_id")


def keep_one(documents: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """One document of each component. The rows that go are sent to all tasks where they are few; else rows are joined with those that stay."""
    found = checkpoint(clustered(documents, words))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "row_key")
    stays = checkpoint(found.groupBy("root").agg(F.min(key).alias("s")).select("s.doc_id", "s.row_key"))
    rows = documents.select(F.struct(*documents.columns).alias("row"), F.col("doc_id").alias("own_id"), row_key(documents).alias("own_key"))
    same = lambda of: F.col("own_id").eqNullSafe(of["doc_id"]) & (F.col("own_key") == of["row_key"])
    goes = checkpoint(found.select("doc_id", "row_key").subtract(stays))
    kept = rows.join(F.broadcast(goes), same(goes), "left_anti") if small(goes) else rows.join(stays, same(stays), "left_semi")
    if found.groupBy("doc_id", "row_key").count().where("count > 1").isEmpty():
        return kept.select("row.*")
    # Of rows equal in all columns that would stay, one does; only theirs are dealt by key.
    twice = found.groupBy("doc_id", "row_key").count().where("count > 1").drop("count")
    twice = checkpoint(twice.join(stays, ["row_key"], "left_semi"))
    again = F.broadcast(twice) if small(twice) else twice
    return kept.join(again, same(twice), "left_anti").select("row.*").unionByName(kept.join(again, same(twice), "left_semi").dropDuplicates(["own_id", "own_key"]).select("row.*"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustered(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
