"""Token counts of whole texts under a byte-level BPE vocabulary, by rank-synchronous merging of arrays.

Texts are cut into pre-tokens by the vocabulary's pattern. The pre-tokens of a batch that have not been met lately lie in
one ragged array of symbols; in each round the pair of the lowest rank of every sequence is found, all its occurrences
in that sequence are merged at once (of overlapping ones the left), and sequences without a mergeable pair leave. What
survives is counted. Merging at once is the same as one by one, since a pair with a merged symbol always ranks after the
pair that made it. Pre-tokens of over LONG bytes have as many rounds as different ranks; theirs keep the places of each rank
between rounds and look up again only the pairs beside a merge, so that a round costs what it merges.

Defined results: a null or empty text has no token; the special string in a text is one token, as the library counts it;
a text of any length is counted whole; repeated rows are counted alike; a null doc_id is kept; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import batched

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm._shared import table

#: The pattern of the vocabulary's pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LIMIT = 512
#: Pre-tokens whose counts a task keeps, and symbols that it merges at once.
REMEMBERED = 400_000
SYMBOLS = 1 << 20
#: Bytes beyond which a pre-token is merged by places of ranks, and is not remembered.
LONG = 512
#: Characters of texts, and pre-tokens of one longer text, that are counted at once.
BATCH_CHARS = 1 << 21
BATCH_PIECES = 100_000


@dataclass
class Vocabulary:
    """first: symbol of each byte. pairs: sorted keys left * base + right; ranks and made are theirs."""

    first: np.ndarray
    base: int
    pairs: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    special: list[str]


def byte_characters() -> list[str]:
    """The characters that stand for bytes in such vocabularies: printable ones for themselves, others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    ids, merges = told["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in told["model"]["merges"]]
    base = max(ids.values()) + 1
    keys = np.array([ids[a] * base + ids[b] for a, b in merges], np.int64)
    order = np.argsort(keys)
    made = np.array([ids[a + b] for a, b in merges], np.int64)
    return Vocabulary(np.array([ids[c] for c in byte_characters()], np.int64), base, keys[order], order.astype(np.int64), made[order], [t["content"] for t in told["added_tokens"]])


def merged_sizes(pieces: list[bytes], v: Vocabulary) -> np.ndarray:
    """The symbols that survive of each piece."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    out = sizes.copy()
    symbols = v.first[np.frombuffer(b"".join(pieces), np.uint8)]
    of = np.repeat(np.arange(len(pieces)), sizes)
    none = len(v.ranks)
    while len(symbols) > 1:
        key = symbols[:-1] * v.base + symbols[1:]
        at = np.minimum(np.searchsorted(v.pairs, key), len(v.pairs) - 1)
        rank = np.where((v.pairs[at] == key) & (of[:-1] == of[1:]), v.ranks[at], none)
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        least = np.minimum.reduceat(np.append(rank, none), starts)
        live = least < none
        if not live.any():
            break
        lengths = np.diff(np.append(starts, len(of)))
        hit = np.append((rank == np.repeat(least, lengths)[:-1]) & (rank < none), False)
        # Of a run of hits that overlap (a symbol with itself) every other one counts, from the left.
        where = np.flatnonzero(hit)
        begins = np.flatnonzero(np.diff(where, prepend=-2) != 1)
        odd = (np.arange(len(where)) - np.repeat(begins, np.diff(np.append(begins, len(where))))) % 2 == 1
        where = where[~odd]
        symbols[where] = v.made[at[where]]
        keep = np.repeat(live, lengths)
        keep[where + 1] = False
        out[of[starts]] = lengths
        gone = np.bincount(of[where + 1], minlength=len(pieces))
        out -= gone
        symbols, of = symbols[keep], of[keep]
    return out


def long_sizes(pieces: list[bytes], v: Vocabulary) -> np.ndarray:
    """As merged_sizes, in time for the merges alone: symbols are linked lists, and each rank has the places of its pairs."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    symbols = np.append(v.first[np.frombuffer(b"".join(pieces), np.uint8)], 0)
    n = len(symbols) - 1  # the place behind all, which ends each list
    ends = np.cumsum(sizes)
    after, before, live = np.arange(1, n + 2), np.arange(-1, n), np.ones(n, bool)
    after[ends - 1] = n
    before[ends - sizes] = n
    key_of = np.empty(len(v.ranks), np.int64)
    key_of[v.ranks] = v.pairs
    made_of = np.empty(len(v.ranks), np.int64)
    made_of[v.ranks] = v.made
    places: dict[int, list[np.ndarray]] = {}
    waiting: list[int] = []

    def note(left: np.ndarray) -> None:
        """Keeps pairs, by the place of their left symbol, under their rank."""
        key = symbols[left] * v.base + symbols[after[left]]
        at = np.minimum(np.searchsorted(v.pairs, key), len(v.pairs) - 1)
        known = v.pairs[at] == key
        left, rank = left[known], v.ranks[at[known]]
        order = np.argsort(rank, kind="stable")
        left, rank = left[order], rank[order]
        cut = np.flatnonzero(np.diff(rank, prepend=-1))
        for r, part in zip(rank[cut].tolist(), np.split(left, cut[1:]) if len(cut) else (), strict=True):
            if r not in places:
                places[r] = []
                heappush(waiting, r)
            places[r].append(part)

    pairs = np.arange(n)
    note(pairs[after[pairs] < n])
    heapify(waiting)
    while waiting:
        rank = heappop(waiting)
        parts = places.pop(rank)
        at = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
        at = at[live[at] & (after[at] < n)]
        at = at[symbols[at] * v.base + symbols[after[at]] == key_of[rank]]
        if not len(at):
            continue
        if len(at) > 1:  # of pairs that overlap every other one counts, from the left
            begins = np.flatnonzero(np.append(True, after[at[:-1]] != at[1:]))
            at = at[(np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))) % 2 == 0]
        right = after[at]
        symbols[at] = made_of[rank]
        live[right] = False
        after[at] = after[right]
        before[after[at]] = at
        left = before[at]
        near = np.concatenate([left[left < n], at[after[at] < n]])
        note(np.unique(near) if len(near) > 1 else near)
    return np.add.reduceat(live.astype(np.int64), ends - sizes)


class Counter:
    """Counts tokens of texts; remembers short pre-tokens within a bound."""

    def __init__(self, v: Vocabulary) -> None:
        self.v, self.known = v, {}
        self.cut = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, v.special))) if v.special else None

    def sizes(self, pieces: Iterable[str]) -> dict[str, int]:
        """Tokens of each piece that is not known yet."""
        short, long = [], []
        for p in pieces:
            raw = p.encode()
            (long if len(raw) > LONG else short).append((p, raw))
        found: dict[str, int] = {}
        for some, count in ((short, merged_sizes), (long, long_sizes)):
            first, total = 0, 0
            for i, (_, raw) in enumerate(some):
                total += len(raw)
                if total >= SYMBOLS or i == len(some) - 1:
                    part = some[first : i + 1]
                    found.update(zip((p for p, _ in part), count([r for _, r in part], self.v).tolist(), strict=True))
                    first, total = i + 1, 0
        self.known.update((p, found[p]) for p, _ in short)
        return found

    def pieces(self, text: str) -> Iterator[str]:
        for part in self.special.split(text) if self.special else (text,):
            yield from (m[0] for m in self.cut.finditer(part))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; the texts are cut in groups of bounded size, a longer text in parts of its pre-tokens."""
        out, group, chars = [], [], 0
        for t in texts:
            if len(t) > BATCH_CHARS:
                out += self._counted(group)
                group, chars = [], 0
                out.append(self._specials(t) + sum(sum(self._looked_up([list(p)])) for p in batched(self.pieces(t), BATCH_PIECES)))
                continue
            if chars + len(t) > BATCH_CHARS:
                out += self._counted(group)
                group, chars = [], 0
            group.append(t)
            chars += len(t)
        return out + self._counted(group)

    def _specials(self, text: str) -> int:
        return len(self.special.findall(text)) if self.special else 0

    def _counted(self, texts: list[str]) -> list[int]:
        specials = [self._specials(t) for t in texts]
        cut = [list(self.pieces(t)) if n else self.cut.findall(t) for t, n in zip(texts, specials, strict=True)]
        return [n + k for n, k in zip(specials, self._looked_up(cut), strict=True)]

    def _looked_up(self, cut: list[list[str]]) -> list[int]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = self.sizes({p for x in cut for p in x if p not in known})
        if not new:
            return [sum(map(known.__getitem__, x)) for x in cut]
        return [sum(new[p] if p in new else known[p] for p in x) for x in cut]


def token_counts(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit. The vocabulary is read where the session runs and sent to the tasks once: its file's size bounds it."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for b in batches:
            counts = counter.count([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
