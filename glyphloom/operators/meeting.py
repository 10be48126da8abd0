"""Meetings of boxes that lie in arrays, and one-to-one choices among them: `matching` within the pages of one task."""

from __future__ import annotations

import numpy as np

from glyphloom.sources.blocks import Words

#: Width and height of a cell; boxes of words are a little smaller.
CELL = (128, 32)
#: Above all idx of a page.
_IDX = 1 << 40


def ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of so many: which run each member belongs to, and its place in it."""
    run = np.repeat(np.arange(len(counts)), counts)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)


def _cells(b: Words, cell: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row for each cell that a box covers: the box, and the cell's column and line."""
    cx, cy = b.x0 // cell[0], b.y0 // cell[1]
    wide, high = np.maximum(b.x1 // cell[0] - cx, 0) + 1, np.maximum(b.y1 // cell[1] - cy, 0) + 1
    box, k = ranges(wide * high)
    down, right = np.divmod(k, wide[box])
    return box, cx[box] + right, cy[box] + down


Cells = tuple[np.ndarray, np.ndarray, np.ndarray]


def _same_cell(left: Cells, right: Cells) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in left and right, each page, column and line of a cell, that have one cell."""
    if not len(left[0]) or not len(right[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low_x, low_y = (min(left[k].min(), right[k].min()) for k in (1, 2))
    columns = max(left[1].max(), right[1].max()) - low_x + 1
    # Lines of cells are numbered from page to page, so that keys stay small.
    lines = np.zeros(max(left[0].max(), right[0].max()) + 1, np.int64)
    for page, _, y in (left, right):
        np.maximum.at(lines, page, y - low_y + 1)
    base = np.cumsum(lines) - lines
    keys = [(base[page] + y - low_y) * columns + x - low_x for page, x, y in (left, right)]
    size = int(lines.sum() * columns)
    if size > 16 * (len(keys[0]) + len(keys[1])):
        both = np.unique(np.concatenate(keys), return_inverse=True)[1]
        keys, size = [both[: len(keys[0])], both[len(keys[0]) :]], int(both.max()) + 1
    counts = np.bincount(keys[1], minlength=size)
    order, begins = np.argsort(keys[1]), np.cumsum(counts) - counts
    each, place = ranges(counts[keys[0]])
    return each, order[begins[keys[0]][each] + place]


def overlaps(left: Words, right: Words, cell: tuple[int, int] = CELL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places in left and right whose boxes have a common area on one page, and that area. As in `matching.overlapping`, a pair is kept in
    the cell of its common part's first corner alone."""
    none = np.zeros(0, np.int64)
    if not len(left) or not len(right):
        return none, none, none
    (l, lx, ly), (r, rx, ry) = _cells(left, cell), _cells(right, cell)
    each, other = _same_cell((left.page[l], lx, ly), (right.page[r], rx, ry))
    a, b = l[each], r[other]
    x = np.maximum(left.x0[a], right.x0[b])
    across = np.minimum(left.x1[a], right.x1[b]) - x
    met = np.flatnonzero((across > 0) & (x // cell[0] == lx[each]))
    a, b, across, line = a[met], b[met], across[met], ly[each[met]]
    y = np.maximum(left.y0[a], right.y0[b])
    down = np.minimum(left.y1[a], right.y1[b]) - y
    met = np.flatnonzero((down > 0) & (y // cell[1] == line))
    return a[met], b[met], (across * down)[met]


def iou(left: Words, right: Words, a: np.ndarray, b: np.ndarray, common: np.ndarray) -> np.ndarray:
    return common / np.maximum(left.area()[a] + right.area()[b] - common, 1e-12)


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal first keys together, by the second within, and where each group begins in it."""
    order = np.argsort(keys[0] * _IDX + keys[1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    ordered = keys[0][order]
    return order, np.flatnonzero(np.diff(ordered, prepend=-1))


def _first(side: np.ndarray, iou: np.ndarray, other_idx: np.ndarray) -> np.ndarray:
    """Which pairs are the best by IoU of their member on one side, ties by the smaller idx of the other."""
    best = np.zeros(len(side), bool)
    if len(side):
        order, begins = groups(side, other_idx)
        sizes = np.diff(np.append(begins, len(order)))
        value = iou[order]
        top = value == np.repeat(np.maximum.reduceat(value, begins), sizes)
        at = np.flatnonzero(top)
        best[order[at[np.diff(side[order][at], prepend=-1) != 0]]] = True
    return best


def mutual_best(left: Words, right: Words, a: np.ndarray, b: np.ndarray, iou: np.ndarray) -> np.ndarray:
    """Which pairs are each other's best, as in `matching.mutual_best`."""
    return _first(a, iou, right.idx[b]) & _first(b, iou, left.idx[a])


def lost(word: np.ndarray, rival: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which words go when words are taken in order of their place, each unless a rival of it was: `tiles.lost`. In each round
    those are taken that have no rival left, and those that have a taken one go."""
    taken, gone = np.zeros(len(place), bool), np.zeros(len(place), bool)
    while len(word):
        waits = np.zeros(len(place), bool)
        waits[word] = True
        taken[rival[~waits[rival]]] = True
        gone[word[taken[rival]]] = True
        open_ = ~gone[word] & ~gone[rival]
        word, rival = word[open_], rival[open_]
    return gone


def peers(w: Words, vertical: bool, reach: float, limits: tuple[float, float, float, float], cell: tuple[int, int] = (128, 32)) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of a box and a peer of its line, or of its column: `lines.peers`."""
    (u0, u1), (v0, v1) = ((w.y0, w.y1), (w.x0, w.x1)) if vertical else ((w.x0, w.x1), (w.y0, w.y1))
    u, v, t = (u0 + u1) / 2, (v0 + v1) / 2, v1 - v0
    long, near, low, high = limits
    at = lambda value, k: np.floor(value / cell[k]).astype(np.int64)
    those = np.flatnonzero((u1 - u0 >= long * t) & (t > 0))
    first_u, first_v = at(u[those] - reach * t[those], 0), at(v[those] - near * t[those], 1)
    wide, high_ = at(u[those] + reach * t[those], 0) - first_u + 1, at(v[those] + near * t[those], 1) - first_v + 1
    box, k = ranges(wide * high_)
    down, right = np.divmod(k, wide[box])
    a, b = _same_cell((w.page, at(u, 0), at(v, 1)), (w.page[those[box]], first_u[box] + right, first_v[box] + down))
    b = those[box[b]]
    ratio = t[a] / t[b]
    met = (w.idx[a] != w.idx[b]) & (np.abs(v[a] - v[b]) < near * t[b]) & (np.abs(u[a] - u[b]) < reach * t[b]) & (ratio > low) & (ratio < high)
    return a[met], b[met]


def upper_median(side: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """Of each of `size` members the upper median of its values, 0 without any; values are whole and no less than -2 ** 20."""
    out = np.zeros(size, np.int64)
    order, begins = groups(side, value + (1 << 20))
    n = np.diff(np.append(begins, len(order)))
    at = order[begins + n // 2]
    out[side[at]] = value[at]
    return out
