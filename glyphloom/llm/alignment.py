"""How the tokens of two vocabularies lie on each other, and how usual each of their links is in the corpus.

1. Texts are cut before each space or line end that follows another character; no token of either vocabulary reaches over
   such a place (`Aligner` looks whether that holds, else texts stay whole), so that each different segment is encoded once
   by the two libraries. Where tokens of both end, groups end; a link is a stretch between two neighbouring ends of any.
   Each chunk of documents gives its rows and, for each id of the second vocabulary (the side id), its postings: first id,
   document, multiplicity. Each task gives its sums by pair. All of it is written to the shared folder.
2. Sums by pair are added up and gathered by side id: at most as many as the first vocabulary has ids. They meet the postings
   in a cogroup: both are dealt by side id and salt and sorted (with spills), the sums before the postings, which then pass
   by one batch at a time. A side id has a salt for each SALT_POSTINGS postings.
3. Each posting's count, and whether it is the side id's highest, are summed by document: a task passes on one row for each chunk
   of documents, and chunks' rows meet their documents in a second cogroup.

Defined results: a text that is null, empty or not given back by either vocabulary's bytes has no tokens, zeros and ''; special
strings are plain text; equal rows are documents of their own; a null doc_id is kept; an empty table gives an empty result;
other columns are ignored. A text of any length is aligned whole, CHUNK_CHARS at a time; memory is bounded by that, or by one
stretch without spaces, and by the different pairs of a text.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm._shared import shared_folder, table
from glyphloom.llm.token_counts import byte_characters

#: Characters and documents of a chunk; a document's number in its chunk has 16 bits.
CHUNK_CHARS = 2 << 20
CHUNK_DOCS = 1 << 15
#: Characters of new segments that are encoded as one text.
JOINED_CHARS = 1 << 16
#: Segments that a task remembers between chunks, and links of all of them.
REMEMBERED = 300_000
REMEMBERED_LINKS = 8 << 20
#: Sums by pair and documents' shares that a task holds before it passes them on.
HELD = 2_000_000
#: Postings of a side id that go to one group.
SALT_POSTINGS = 500_000

#: Space of pieces, and pieces that stand for one byte.
_SPACE, _BYTE = "▁", re.compile(r"<0x([0-9A-F]{2})>")
#: A segment ends where another character than white space is followed by a space or a line end.
_SEGMENT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys in order, with the sums of their values."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[starts], *(np.add.reduceat(v[order], starts) for v in values)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Aligner:
    """Encodes segments by both libraries and remembers their links: pairs, numbers of tokens and groups, and the groups' text."""

    def __init__(self, entries: str, model: bytes) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(entries), sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a.encode_special_tokens = True
        byte_of = {c: i for i, c in enumerate(byte_characters())}
        told = json.loads(entries)
        added = {t["id"] for t in told["added_tokens"]}
        self.n_a = max(told["model"]["vocab"].values()) + 1
        self.a_bytes = [b""] * self.n_a
        for entry, i in told["model"]["vocab"].items():
            self.a_bytes[i] = entry.encode() if i in added else bytes(byte_of[c] for c in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace(_SPACE, " ").encode() for p in pieces]
        self.blank = self.b.piece_to_id(_SPACE)
        self.cuts = pieces[self.blank] == _SPACE and not any(_SPACE in p.lstrip(_SPACE) or "\n" in p for p in pieces)
        self.names = np.array([str(i) for i in range(max(self.n_a, len(pieces)))], object)
        self.a_size, self.b_size = (np.array([len(x) for x in some]) for some in (self.a_bytes, self.b_bytes))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.told: list[str] = []
        none = np.zeros(0, np.int64)
        #: By segment: whether both give it back, tokens, groups, links. pairs: of all links, b * n_a + a.
        self.good, self.sizes, self.pairs = np.zeros(0, bool), np.zeros((4, 0), np.int64), none

    def segments(self, text: str) -> list[str]:
        """Of a text with its space before it; none of an empty one."""
        if not text:
            return []
        return _SEGMENT.findall(" " + text) if self.cuts else [" " + text]

    def pieces_of(self, text: str) -> Iterator[list[str]]:
        """The segments of a long text, about CHUNK_CHARS at a time."""
        if not self.cuts:
            yield self.segments(text)
            return
        held, chars = [], 0
        for m in _SEGMENT.finditer(" " + text):
            held.append(m[0])
            chars += len(m[0])
            if chars >= CHUNK_CHARS:
                yield held
                held, chars = [], 0
        yield held

    def places(self, cut: list[list[str]]) -> np.ndarray:
        """The numbers of all segments, one list after the other; new ones are encoded first."""
        if len(self.known) > REMEMBERED or len(self.pairs) > REMEMBERED_LINKS:
            self.forget()
        known = self.known
        if new := list({s for x in cut for s in x if s not in known}):
            self._learn(new)
        return np.fromiter(map(known.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))

    def _encoded(self, new: list[str]) -> np.ndarray:
        """Ids of the first vocabulary of all segments. Those that end in a character other than white space can follow each
        other in one text as they do in documents; the others stand at the ends of their texts."""
        texts, held, size = [], [], 0
        for s in new:
            held.append(s)
            size += len(s)
            if size >= JOINED_CHARS or not self.cuts or s[-1].isspace():
                texts.append("".join(held))
                held, size = [], 0
        if held:
            texts.append("".join(held))
        return np.fromiter(chain.from_iterable(e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)), np.int64)

    def _learn(self, new: list[str]) -> None:
        raw = [s.encode() for s in new]
        a = self._encoded(new)
        # The library puts a space before each but the empty one; a segment that has none of its own gives it back.
        b = self.b.encode([s[1:] if s[0] == " " else s for s in new], num_threads=1)
        b = [[self.blank] if s == " " else ids if s[0] == " " else ids[1:] if ids[:1] == [self.blank] else [] for s, ids in zip(new, b, strict=True)]
        ends = np.cumsum([len(r) for r in raw])
        whole, good = b"".join(raw), np.ones(len(new), bool)
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) == whole:
            a_first = np.append(0, np.searchsorted(np.cumsum(self.a_size[a]), ends, side="right"))
        else:
            each = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]
            good = np.array([b"".join(map(self.a_bytes.__getitem__, x)) == r for x, r in zip(each, raw, strict=True)])
            a, a_first = np.fromiter(chain.from_iterable(each), np.int64), np.append(0, np.cumsum([len(x) for x in each]))
        b_first = np.append(0, np.cumsum([len(x) for x in b]))
        b = np.fromiter(chain.from_iterable(b), np.int64, b_first[-1])
        b_bytes = list(map(self.b_bytes.__getitem__, b.tolist()))
        if b"".join(b_bytes) != whole or (np.append(0, np.cumsum(self.b_size[b]))[b_first[1:]] != ends).any():
            good &= np.array([b"".join(b_bytes[i:j]) == r for i, j, r in zip(b_first.tolist(), b_first[1:].tolist(), raw)])  # noqa: B905
        n_a, n_b = np.diff(a_first), np.diff(b_first)
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        ends = np.cumsum(np.array([len(r) for r in raw])[good])
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        both = np.sort(np.append(ends_a, ends_b), kind="stable")
        twice = np.diff(both, append=both[-1:] + 1) == 0
        stops, joint = both[~twice], both[twice]
        pairs = b[np.searchsorted(ends_b, stops)] * self.n_a + a[np.searchsorted(ends_a, stops)]
        groups, links = (np.diff(np.append(0, np.searchsorted(x, ends, side="right"))) for x in (joint, stops))
        sizes = np.zeros((4, len(new)), np.int64)
        sizes[:, good] = [n_a[good], n_b[good], groups, links]
        told = iter(self._told(a, b, ends_a, ends_b, joint, ends))
        self.told += [next(told) if g else "" for g in good.tolist()]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.good, self.sizes, self.pairs = np.append(self.good, good), np.hstack([self.sizes, sizes]), np.append(self.pairs, pairs)

    def _told(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, joint: np.ndarray, ends: np.ndarray) -> list[str]:
        """The groups' text of each segment: of every group the tokens of both, one after the other, each with the sign that follows it."""
        signs = []
        for token_ends, own, last in ((ends_a, ",", "|"), (ends_b, ",", ";")):
            closes = np.isin(token_ends, joint, assume_unique=True, kind="sort")
            signs.append(np.where(closes, last, own).astype(object))
        signs[1][np.isin(ends_b, ends, assume_unique=True, kind="sort")] = ""
        names = np.concatenate([self.names[a] + signs[0], self.names[b] + signs[1]])
        group = [np.searchsorted(joint, x) * 2 + k for k, x in enumerate((ends_a, ends_b))]
        order = np.argsort(np.concatenate(group), kind="stable")
        flat = names[order].tolist()
        first = np.append(0, np.searchsorted(ends_a, ends, side="right") + np.searchsorted(ends_b, ends, side="right")).tolist()
        return ["".join(flat[i:j]) for i, j in zip(first, first[1:])]  # noqa: B905

    def _multiplicities(self, doc: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys pair << 16 | doc in order, and how often each is linked."""
        n = len(self.known)
        key, times = _sums(doc * n + segment, np.ones(len(doc), np.int64))
        doc, segment = np.divmod(key, n) if n else (key, key)
        sizes = self.sizes[3]
        starts = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(key)), sizes[segment])
        return _sums(self.pairs[_ragged(starts[segment], sizes[segment])] << 16 | doc[of], times[of])

    def chunk(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Of each text: n_a, n_b, n_groups, n_links (rows of the first array) and the digest; and keys and multiplicities."""
        if len(texts) == 1 and len(texts[0]) > CHUNK_CHARS:
            return self._long(texts[0])
        cut = [self.segments(t) for t in texts]
        segment = self.places(cut)
        doc = np.repeat(np.arange(len(texts)), [len(x) for x in cut])
        bad = np.zeros(len(texts), bool)
        bad[doc[~self.good[segment]]] = True
        counts = np.array([np.bincount(doc, s[segment], len(texts)) for s in self.sizes], np.int64) * ~bad
        told, place, digests = self.told, 0, []
        numbers = segment.tolist()
        for x, none in zip(cut, bad, strict=True):
            own = numbers[place : place + len(x)]
            place += len(x)
            digests.append("" if none or not own else hashlib.sha256(";".join([told[i] for i in own]).encode()).hexdigest())
        live = ~bad[doc]
        return counts, digests, *self._multiplicities(doc[live], segment[live])

    def _long(self, text: str) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        counts, digest, keys, times = np.zeros((4, 1), np.int64), hashlib.sha256(), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for k, some in enumerate(self.pieces_of(text)):
            segment = self.places([some])
            if not self.good[segment].all():
                return np.zeros((4, 1), np.int64), [""], keys[:0], times[:0]
            if some:
                digest.update(f"{';' * bool(k)}{';'.join([self.told[i] for i in segment.tolist()])}".encode())
            counts[:, 0] += self.sizes[:, segment].sum(axis=1)
            more, of = self._multiplicities(np.zeros(len(segment), np.int64), segment)
            keys, times = _sums(np.append(keys, more), np.append(times, of))
        return counts, [digest.hexdigest()], keys, times


@lru_cache(maxsize=1)
def _aligner(entries: str, model: bytes) -> Aligner:
    """One for all tasks of a worker."""
    return Aligner(entries, model)


_WRITTEN = pa.schema(
    {"kind": pa.string(), "chunk": pa.int64(), "doc": pa.int32(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string()}
    | {"b": pa.int32(), "n": pa.int64(), "a": pa.binary(), "docs": pa.binary(), "times": pa.binary(), "all_a": pa.list_(pa.int32()), "all_n": pa.list_(pa.int64())}
)
_WRITTEN_DDL = "kind string, chunk long, doc int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, b int, n long, a binary, docs binary, times binary, all_a array<int>, all_n array<long>"


def _batch(rows: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in _WRITTEN], schema=_WRITTEN)


def _packed(values: np.ndarray, kind: str, bounds: np.ndarray) -> pa.Array:
    """Runs of numbers as binary values."""
    data = values.astype(kind)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * data.itemsize).astype(np.int32)), pa.py_buffer(data)])


def _unpacked(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all values, and how many each has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].tobytes()
    return np.frombuffer(data, kind), np.diff(offsets) // np.dtype(kind).itemsize


def _runs(sides: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin, and the end."""
    return np.append(np.flatnonzero(np.diff(sides, prepend=-1)), len(sides))


def _align(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*shared.value)
        chunk = TaskContext.get().partitionId() << 33
        sums, held = [], 0

        def summed() -> Iterator[pa.RecordBatch]:
            """Sums by pair, a row for each side id, with the number of its postings."""
            pair, n, postings = _sums(*(np.concatenate(x) for x in zip(*sums, strict=True)))
            side, a = np.divmod(pair, aligner.n_a)
            bounds = _runs(side)
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, kind)) for x, kind in ((a, pa.int32()), (n, pa.int64()))]
            starts = bounds[:-1]
            yield _batch(len(starts), kind=pa.array(["sum"] * len(starts)), b=pa.array(side[starts], pa.int32()), n=pa.array(np.add.reduceat(postings, starts), pa.int64()), all_a=lists[0], all_n=lists[1])

        def aligned(ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
            nonlocal chunk, held
            chunk += 1
            counts, digests, key, times = aligner.chunk(texts)
            named = {k: pa.array(c, pa.int64()) for k, c in zip(("n_a", "n_b", "n_groups", "n_links"), counts, strict=True)}
            yield _batch(len(ids), kind=pa.array(["doc"] * len(ids)), chunk=pa.array([chunk] * len(ids)), doc=pa.array(range(len(ids)), pa.int32()), doc_id=pa.array(ids, pa.int64()), groups_sha256=pa.array(digests), **named)
            if not len(key):
                return
            pair, doc = key >> 16, key & 0xFFFF
            side, a = np.divmod(pair, aligner.n_a)
            bounds = _runs(side)
            k = len(bounds) - 1
            yield _batch(k, kind=pa.array(["posting"] * k), chunk=pa.array([chunk] * k), b=pa.array(side[bounds[:-1]], pa.int32()), a=_packed(a, "<u4", bounds), docs=_packed(doc, "<u2", bounds), times=_packed(times, "<u4", bounds))
            sums.append(_sums(pair, times, np.ones(len(pair), np.int64)))
            held += len(sums[-1][0])

        def passed() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if sums and held >= HELD:
                sums[:] = [_sums(*(np.concatenate(x) for x in zip(*sums, strict=True)))]
                held = len(sums[0][0])
                if held >= HELD // 2:
                    yield from summed()
                    sums.clear()
                    held = 0

        ids, texts, chars = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = t or ""
                if texts and (chars + len(t) > CHUNK_CHARS or len(texts) >= CHUNK_DOCS):
                    yield from aligned(ids, texts)
                    yield from passed()
                    ids, texts, chars = [], [], 0
                ids.append(i)
                texts.append(t)
                chars += len(t)
        if texts:
            yield from aligned(ids, texts)
        if sums:
            yield from summed()

    return run


def _shares(n_a: int):
    """Of sorted rows, a side id's sums before its postings: each document's counts and links of the highest count."""
    schema = pa.schema({"chunk": pa.int64(), "docs": pa.binary(), "counts": pa.binary(), "highs": pa.binary()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = n = best = np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def added() -> tuple[np.ndarray, ...]:
            return _sums(*(np.concatenate(x) for x in zip(*held, strict=True)))

        def given(at: np.ndarray, count: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
            """A row for each chunk of documents."""
            bounds = _runs(at >> 16)
            packed = [_packed(v, kind, bounds) for v, kind in ((at & 0xFFFF, "<u2"), (count, "<i8"), (high, "<i8"))]
            return pa.RecordBatch.from_arrays([pa.array(at[bounds[:-1]] >> 16), *packed], schema=schema)

        for b in batches:
            side = b.column(0).to_numpy().astype(np.int64)
            told = b.column(5)
            whose = np.flatnonzero(told.is_valid().to_numpy(zero_copy_only=False))
            whose = whose[np.diff(side[whose], prepend=-1) != 0]  # those of other salts are the same
            if len(whose):
                first = told.take(pa.array(whose))
                sizes = first.value_lengths().to_numpy().astype(np.int64)
                new = np.repeat(side[whose], sizes) * n_a + first.flatten().to_numpy()
                new_n = b.column(6).take(pa.array(whose)).flatten().to_numpy().astype(np.int64)
                high = np.repeat(np.maximum.reduceat(new_n, np.cumsum(sizes) - sizes), sizes)
                # Only the last side id's sums can still be asked for.
                keep = (key // n_a == side[0]) & (side[whose[0]] != side[0])
                key, n, best = np.append(key[keep], new), np.append(n[keep], new_n), np.append(best[keep], high)
            rows = np.flatnonzero(b.column(2).is_valid().to_numpy(zero_copy_only=False))
            if not len(rows):
                continue
            post = b.take(pa.array(rows))
            a, sizes = _unpacked(post.column(2), "<u4")
            doc, times = _unpacked(post.column(3), "<u2")[0].astype(np.int64), _unpacked(post.column(4), "<u4")[0].astype(np.int64)
            at = np.searchsorted(key, np.repeat(side[rows], sizes) * n_a + a)
            count = n[at]
            held.append(_sums(np.repeat(post.column(1).to_numpy(), sizes) << 16 | doc, times * count, times * (count == best[at])))
            size += len(held[-1][0])
            if size >= HELD:
                held = [added()]
                size = len(held[0][0])
                if size >= HELD // 2:
                    yield given(*held[0])
                    held, size = [], 0
        if held:
            yield given(*added())

    return run


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows, a chunk's shares before its documents: the documents with their sums."""
    key = count = high = np.zeros(0, np.int64)
    for b in batches:
        chunk = b.column("chunk").to_numpy()
        is_doc = b.column("doc").is_valid().to_numpy(zero_copy_only=False)
        keep = key >> 16 == chunk[0]
        key, count, high = key[keep], count[keep], high[keep]
        if not is_doc.all():
            shares = b.filter(pa.array(~is_doc))
            docs, sizes = _unpacked(shares.column("docs"), "<u2")
            new = np.repeat(shares.column("chunk").to_numpy(), sizes) << 16 | docs.astype(np.int64)
            key, count, high = _sums(np.append(key, new), np.append(count, _unpacked(shares.column("counts"), "<i8")[0]), np.append(high, _unpacked(shares.column("highs"), "<i8")[0]))
        if is_doc.any():
            rows = b.filter(pa.array(is_doc))
            asked = rows.column("chunk").to_numpy() << 16 | rows.column("doc").to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(key, asked), max(len(key) - 1, 0))
            found = key[at] == asked if len(key) else np.zeros(len(asked), bool)
            sums = {k: pa.array(np.where(found, v[at], 0) if len(key) else np.zeros(len(asked), np.int64)) for k, v in (("count_sum", count), ("n_best", high))}
            names = [c.split()[0] for c in _RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([sums[k] if k in sums else rows.column(k) for k in names], names=names)


def alignments(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document. The vocabularies are read where
    the session runs and sent to the tasks once: the files' size bounds them."""
    spark = documents.sparkSession
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        entries, model = f.read(), g.read()
    n_a = max(json.loads(entries)["model"]["vocab"].values()) + 1
    shared = spark.sparkContext.broadcast((entries, model))
    folder = f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    rows = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].alias("text"))
    rows.mapInArrow(_align(shared), _WRITTEN_DDL).write.partitionBy("kind").option("compression", "zstd").parquet(folder)
    written = spark.read.schema(_WRITTEN_DDL).parquet(folder)
    sums = written.where("kind = 'sum'")
    # Side ids are as many as the second vocabulary has.
    salts = sums.groupBy("b").agg((F.floor(F.sum("n") / SALT_POSTINGS) + 1).cast("int").alias("salts"))
    pairs = sums.select("b", F.explode(F.arrays_zip("all_a", "all_n")).alias("at")).groupBy("b", F.col("at.all_a").alias("a")).agg(F.sum("at.all_n").alias("n"))
    of_side = pairs.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("a", "n"))).alias("all"))
    postings = written.where("kind = 'posting'").join(F.broadcast(salts), "b").withColumn("salt", F.pmod(F.xxhash64("chunk"), F.col("salts")).cast("int"))
    none = F.lit(None)
    left = of_side.join(F.broadcast(salts), "b").select(
        "b", none.cast("long").alias("chunk"), *(none.cast("binary").alias(c) for c in ("a", "docs", "times")), F.col("all.a").alias("all_a"), F.col("all.n").alias("all_n"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    )
    right = postings.select("b", "chunk", "a", "docs", "times", none.cast("array<int>").alias("all_a"), none.cast("array<long>").alias("all_n"), "salt")
    streams = left.unionByName(right).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("chunk").asc_nulls_first())
    shares = streams.drop("salt").mapInArrow(_shares(n_a), "chunk long, docs binary, counts binary, highs binary")
    told = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    docs = written.where("kind = 'doc'").select("chunk", "doc", *told)
    every = docs.unionByName(shares, allowMissingColumns=True)
    return every.repartition("chunk").sortWithinPartitions("chunk", F.col("doc").asc_nulls_first()).mapInArrow(_add_up, _RESULT)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignments(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model")))
