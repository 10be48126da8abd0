"""Whole texts of a batch as one byte array with word and line bounds, in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a kernel holds in arrays at once; a longer text makes a chunk of its own.
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


class Powers:
    """Powers of the hash base and of its inverse modulo 2^64, grown when a longer chunk comes."""

    def __init__(self) -> None:
        self.grow(1 << 16)

    def grow(self, n: int) -> None:
        self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)

    def sums(self, data: np.ndarray) -> np.ndarray:
        """What `between` takes hashes of spans of data from."""
        if len(data) >= len(self.up):
            self.grow(2 * len(data) + 2)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        return sums

    def between(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of data[start:end]; equal bytes have equal hashes wherever they stand."""
        return mixed((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.between(self.sums(data), starts, ends)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def letters(separators: Callable[[int], bool], lower: bool = True) -> np.ndarray:
    """For each byte what stands for it in a word, or 0 for a separator; NUL, where it is in words, becomes 0xFF, which UTF-8 never has."""
    return np.array([0 if separators(b) else b + 32 if lower and 65 <= b <= 90 else b or 0xFF for b in range(256)], np.uint8)


#: The word classes of the operators' contracts.
SPACED = letters(lambda b: b == 0x20 or 0x09 <= b <= 0x0D, lower=False)
SPACED_LOWER = letters(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
ALNUM_LOWER = letters(lambda b: b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F)


class Chunk:
    """Some whole texts, each followed by a line feed. offsets: where each starts, and the end."""

    def __init__(self, rows: slice, texts: list[str]) -> None:
        self.rows = rows
        raw = [t.encode() for t in texts]
        self.data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        self.offsets = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(x) + 1 for x in raw], out=self.offsets[1:])

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def part(self, lo: int, hi: int) -> Chunk:
        """Some bytes of a chunk of one text."""
        c = Chunk.__new__(Chunk)
        c.rows, c.data, c.offsets = self.rows, self.data[lo:hi], np.array([0, hi - lo], np.int64)
        return c

    def words(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The mapped bytes; starts and ends of the words; for each text the first word, and the number of all."""
        data = kind[self.data]
        inside = data != 0
        starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        ends = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1
        return data, starts, ends, np.searchsorted(starts, self.offsets)


def chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[Chunk]:
    """Nulls count as empty texts."""
    sizes = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > most:
            yield Chunk(slice(first, i), [t or "" for t in texts.slice(first, i - first).to_pylist()])
            first, total = i, 0
        total += n
    if len(texts) > first:
        yield Chunk(slice(first, len(texts)), [t or "" for t in texts.slice(first).to_pylist()])


def totals(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]
