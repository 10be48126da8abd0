"""Joins of labels with predictions by their boxes, and one-to-one matches.

Boxes meet over grid cells: each box goes to the cells that it covers, the join is on page and cell, and a pair is kept
in the cell of its common part's first corner alone, so that no pair comes twice and no distinct is needed. A page of any
size is so spread over tasks.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.functions.geometry import CORNERS, area, intersection, iou
from glyphloom.functions.quads import boxed, quad_iou
from glyphloom.operators.graphs import components
from glyphloom.sources.shared import written

#: Width and height of a cell: a line of words is wide and low.
CELL = (256, 32)

#: Picks of the pairs (l_idx, r_idx, iou) of a connected part.
Choice = Callable[[list[tuple[int, int, float]]], set[tuple[int, int]]]


def _cells(boxes: DataFrame, prefix: str, cell: tuple[float, float]) -> DataFrame:
    """A row for each cell that a box covers: page_id, cx, cy and the box with a prefix, and the cell's key.

    The key is a hash of page and cell in one number, which sorts faster than three columns."""
    at = lambda c, size: F.floor(F.col(c) / size).cast("int")
    span = lambda low, high, size: F.sequence(at(low, size), F.greatest(at(low, size), at(high, size)))
    named = boxes.select("page_id", *(F.col(c).alias(prefix + c) for c in boxes.columns if c != "page_id"), F.explode(span("x0", "x1", cell[0])).alias("cx"), span("y0", "y1", cell[1]).alias("cys"))
    return named.withColumn("cy", F.explode("cys")).drop("cys").withColumn("cell", F.xxhash64("page_id", "cx", "cy"))


def overlapping(left: DataFrame, right: DataFrame, cell: tuple[float, float] = CELL) -> DataFrame:
    """Pairs of one page whose boxes have a common area, with prefixes l_ and r_, and that area as common."""
    other = _cells(right, "r_", cell).withColumnsRenamed({"page_id": "r_page", "cx": "r_cx", "cy": "r_cy"})
    joined = _cells(left, "l_", cell).join(other, "cell").where("page_id = r_page and cx = r_cx and cy = r_cy")
    first_x, first_y = (F.floor(F.greatest("l_" + c, "r_" + c) / size) for c, size in zip(("x0", "y0"), cell, strict=True))
    pairs = joined.withColumn("common", intersection("l_", "r_")).where((F.col("common") > 0) & (F.col("cx") == first_x) & (F.col("cy") == first_y))
    return pairs.drop("cell", "cx", "cy", "r_page", "r_cx", "r_cy")


def overlapping_quads(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of one page whose convex quadrilaterals (`quad`, eight numbers) have a common area, with prefixes and iou. They
    meet by the boxes about them; rows without a quad meet nobody."""
    about = lambda df: df.where(F.col("quad").isNotNull()).withColumns(boxed(F.col("quad")))
    return overlapping(about(left), about(right)).withColumn("iou", quad_iou(F.col("l_quad"), F.col("r_quad"))).where("iou > 0").drop("common")


def with_iou(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("iou", iou("l_", "r_"))


def same_texts(pairs: DataFrame) -> DataFrame:
    """Pairs with `same`, whether their texts are equal, in place of the texts; a null equals nothing."""
    return pairs.withColumn("same", F.coalesce(F.col("l_text") == F.col("r_text"), F.lit(False))).drop("l_text", "r_text")


def mutual_best(pairs: DataFrame, least: float = 0.5, also: tuple[str, ...] = ()) -> DataFrame:
    """Pairs that are each other's best by IoU, of those that reach `least`; ties by the smaller idx. `also` names columns
    that keep rows apart like page_id."""
    near = pairs.where(F.col("iou") >= least)
    # A hash of the keys stands first, so that rows are sorted by one number.
    by = lambda side, other: Window.partitionBy(F.xxhash64(*also, "page_id", side), *also, "page_id", side).orderBy(F.desc("iou"), other)
    first = near.withColumn("a", F.row_number().over(by("l_idx", "r_idx"))).withColumn("b", F.row_number().over(by("r_idx", "l_idx")))
    return first.where("a = 1 and b = 1").drop("a", "b")


def covered(pairs: DataFrame, side: str, least: float = 0.5) -> DataFrame:
    """Pairs in which the other box covers `least` of the area of one side's box (l_ or r_), at least."""
    return pairs.where(F.col("common") >= least * F.greatest(area(side), F.lit(1e-12)))


def not_ignored(predictions: DataFrame, ignored: DataFrame, least: float = 0.5) -> DataFrame:
    """Predictions of which less than `least` of their own area lies in any one ignored label."""
    lost = covered(overlapping(predictions, ignored), "l_", least).select("page_id", F.col("l_idx").alias("idx")).distinct()
    return predictions.join(lost, ["page_id", "idx"], "left_anti")


def page_counts(pages: DataFrame, truth: DataFrame, predictions: DataFrame, matches: DataFrame) -> DataFrame:
    """truth, predicted, matched, exact and sum_iou of each page, also of pages without words; matches have `same`, or both texts."""
    count = lambda df, name: df.groupBy("page_id").agg(F.count("*").alias(name))
    same = F.col("same") if "same" in matches.columns else F.col("l_text") == F.col("r_text")
    matched = matches.groupBy("page_id").agg(F.count("*").alias("matched"), F.count_if(same).alias("exact"), F.sum("iou").alias("sum_iou"))
    joined = pages.select("page_id").join(count(truth, "truth"), "page_id", "left").join(count(predictions, "predicted"), "page_id", "left").join(matched, "page_id", "left")
    return joined.na.fill(0).na.fill(0.0)


def ratios(truth: Column, predicted: Column, matched: Column, exact: Column) -> dict[str, Column]:
    """Precision, recall, F1 and exact recall of summed counts, 0 where nothing is to be divided."""
    precision, recall = matched / F.greatest(predicted, F.lit(1)), matched / F.greatest(truth, F.lit(1))
    return {"precision": precision, "recall": recall, "f1": 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12)), "exact_recall": exact / F.greatest(truth, F.lit(1))}


def _maximum(edges: list[list[int]], right: int) -> list[int]:
    """Hopcroft and Karp: for each left node its right partner, or -1; as many pairs as there can be."""
    mine, theirs = [-1] * len(edges), [-1] * right
    while True:
        depth = [0 if m < 0 else -1 for m in mine]
        queue, free = deque(i for i, m in enumerate(mine) if m < 0), False
        while queue:
            i = queue.popleft()
            for j in edges[i]:
                k = theirs[j]
                if k < 0:
                    free = True
                elif depth[k] < 0:
                    depth[k] = depth[i] + 1
                    queue.append(k)
        if not free:
            return mine
        for root in range(len(edges)):
            if mine[root] >= 0:
                continue
            path, at = [(root, iter(edges[root]))], None
            while path:
                i, rest = path[-1]
                for j in rest:
                    k = theirs[j]
                    if k < 0:
                        at = j
                        break
                    if depth[k] == depth[i] + 1:
                        path.append((k, iter(edges[k])))
                        break
                else:
                    depth[i] = -2
                    path.pop()
                    continue
                if at is not None:
                    for i, _ in reversed(path):
                        mine[i], at = at, mine[i]
                        theirs[mine[i]] = i
                    break
                at = None


def _optimal(gain: np.ndarray) -> list[int]:
    """The assignment of rows to columns of the largest total gain, by shortest augmenting paths; rows are no more than columns."""
    n, m = gain.shape
    cost = gain.max(initial=0) - gain
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, before, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[at]:
            used[at] = True
            row = owner[at]
            slack = np.full(m + 1, np.inf)
            slack[1:] = cost[row - 1] - u[row] - v[1:]
            better = ~used & (slack < least)
            least[better], before[better] = slack[better], at
            step_at = int(np.where(used, np.inf, least).argmin())
            step = least[step_at]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            at = step_at
        while at:
            owner[at], at = owner[before[at]], before[at]
    out = [-1] * n
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def _parts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of nodes on two sides: the number of the connected part that each is in."""
    a, b = np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1]
    part = np.arange(a.max(initial=-1) + 1)
    while True:
        other = np.full(b.max(initial=-1) + 1, len(part))
        np.minimum.at(other, b, part[a])
        less = part.copy()
        np.minimum.at(less, a, other[b])
        less = less[less]
        if (less == part).all():
            return part[a]
        part = less


def chosen(a: np.ndarray, b: np.ndarray, iou: np.ndarray, choose: Choice) -> np.ndarray:
    """Places of the pairs that `choose` picks of each connected part, of pairs that lie in arrays: `_per_part` within a task. Pairs that meet no other
    are picked where they are; of parts about one box the best pair is, the first of equal ones."""
    alone = (np.bincount(a)[a] == 1) & (np.bincount(b)[b] == 1) if len(a) else np.zeros(0, bool)
    rest = np.flatnonzero(~alone)
    part = _parts(a[rest], b[rest])
    order = np.argsort(part, kind="stable")
    rest, part = rest[order], part[order]
    begins = np.flatnonzero(np.diff(part, prepend=-1))
    ends = np.append(begins[1:], len(rest))
    one = np.zeros(len(begins), bool)
    if len(begins):
        for side in (a[rest], b[rest]):
            one |= np.minimum.reduceat(side, begins) == np.maximum.reduceat(side, begins)
        top = np.maximum.reduceat(iou[rest], begins)
        at = np.flatnonzero(iou[rest] == np.repeat(top, ends - begins))
        first = rest[at[np.diff(part[at], prepend=-1) != 0]]
    left, right, value, places = a[rest].tolist(), b[rest].tolist(), iou[rest].tolist(), rest.tolist()
    found: list[int] = []
    for i, j in zip(begins[~one].tolist(), ends[~one].tolist(), strict=True):
        taken = choose(list(zip(left[i:j], right[i:j], value[i:j], strict=True)))
        found += [k for k, x, y in zip(places[i:j], left[i:j], right[i:j], strict=True) if (x, y) in taken]
    return np.concatenate([np.flatnonzero(alone), first[one] if len(begins) else rest, np.array(found, np.int64)])


def _per_part(pairs: DataFrame, choose: Choice) -> DataFrame:
    """Pairs that `choose` picks of the pairs (l_idx, r_idx, iou) of each connected part of a page.

    A pair whose boxes meet no other is picked where it is. Of the others parts are found by stars over all pages, and a task
    reads its parts in order, holding one at a time: a page is spread over tasks like any other rows."""
    node = lambda side: F.xxhash64("page_id", F.lit(side), side + "_idx")
    names = ["page_id", "l_idx", "r_idx", "iou"]
    counted = pairs.select(*names, node("l").alias("a"), node("r").alias("b"))
    for side in ("a", "b"):
        counted = counted.withColumn("n_" + side, F.count("*").over(Window.partitionBy(side)))
    rows = written(counted.select(*names, "a", "b", ((F.col("n_a") == 1) & (F.col("n_b") == 1)).alias("lone")), "pairs")
    rest = rows.where("not lone")
    roots = components(rest.select("a", "b")).select(F.col("node").alias("a"), "root")
    parted = rest.join(roots, "a", "left").select(*names, F.coalesce("root", "a").alias("part"))
    parted = parted.repartition("part", "page_id").sortWithinPartitions("part", "page_id", "l_idx", "r_idx")
    schema = rest.select(*names).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: tuple[int, int] | None = None
        held: list[tuple[int, int, float]] = []
        found: list[tuple[int, int, int, float]] = []

        def pick() -> None:
            chosen = choose(held) if held else set()
            found.extend((at[1], i, j, v) for i, j, v in held if (i, j) in chosen)
            held.clear()

        for batch in batches:
            for part, page, i, j, v in zip(*(batch[c].tolist() for c in ("part", *names)), strict=True):
                if (part, page) != at:
                    pick()
                    at = (part, page)
                held.append((i, j, v))
            yield pd.DataFrame(found, columns=names)
            found.clear()
        pick()
        yield pd.DataFrame(found, columns=names)

    return rows.where("lone").select(*names).unionByName(parted.mapInPandas(run, schema))


def most_pairs(part: list[tuple[int, int, float]]) -> set[tuple[int, int]]:
    """As many pairs of a part as there can be; edges are tried by IoU, then idx."""
    part = sorted(part, key=lambda p: (p[0], -p[2], p[1]))
    left, right = list(dict.fromkeys(p[0] for p in part)), sorted({p[1] for p in part})
    rows, at = {v: i for i, v in enumerate(left)}, {v: i for i, v in enumerate(right)}
    edges: list[list[int]] = [[] for _ in left]
    for a, b, _ in part:
        edges[rows[a]].append(at[b])
    return {(left[i], right[j]) for i, j in enumerate(_maximum(edges, len(right))) if j >= 0}


def _best_of_few(part: list[tuple[int, int, float]]) -> set[tuple[int, int]]:
    """best_pairs, by trying all choices: for parts of a few pairs, which most are."""
    best, found = -1.0, []

    def go(i: int, total: float, taken: list[tuple[int, int]]) -> None:
        nonlocal best, found
        if total > best:
            best, found = total, taken
        for k in range(i, len(part)):
            a, b, v = part[k]
            if all(a != x and b != y for x, y in taken):
                go(k + 1, total + v, [*taken, (a, b)])

    go(0, 0.0, [])
    return set(found)


#: Pairs of a part whose choices are all tried.
_FEW = 8


def best_pairs(part: list[tuple[int, int, float]]) -> set[tuple[int, int]]:
    """The one-to-one pairs of a part of the largest total IoU."""
    if len(part) <= _FEW:
        return _best_of_few(part)
    left, right = sorted({p[0] for p in part}), sorted({p[1] for p in part})
    gain = np.zeros((len(left), len(right)))
    for a, b, v in part:
        gain[left.index(a), right.index(b)] = v
    if len(left) > len(right):
        return {(left[i], right[j]) for j, i in enumerate(_optimal(gain.T)) if i >= 0}
    return {(left[i], right[j]) for i, j in enumerate(_optimal(gain)) if j >= 0}


def maximum_matching(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """As many pairs with IoU of `least` as there can be, blind to texts. Of equal choices, edges are tried by IoU, then idx."""
    return _per_part(pairs.where(F.col("iou") >= least), most_pairs)


def optimal_assignment(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """The one-to-one pairs of the largest total IoU on each page, of which those that reach `least` stay."""
    return _per_part(pairs, best_pairs).where(F.col("iou") >= least)
