"""Boosted trees on sparse rows: terms in bins, sums of bins by tasks, best splits by slices of terms."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.readers import discard, written

#: Fixed values, those of Spark's trees: depth, bins of a term, rows that place bins, what a tree but the first counts.
DEPTH, BINS, BIN_ROWS, STEP = 3, 32, 10_000, 0.1
INNER, LEAVES = 2**DEPTH - 1, 2**DEPTH
#: Rows and entries of a block at most, about; entries of a task at least; slices of terms; trees after which rows take up their margins; rows that are scored at once.
BLOCK_ROWS, BLOCK_ENTRIES, TASK_ENTRIES, SLICES, UPDATE, SCORED = 50_000, 4_000_000, 100_000, 8, 20, 2_000
#: Entries up to which one task holds all blocks (ten bytes each, at most) and grows all trees, so that no level is a job; and entries whose sums are taken at once.
ONE_TASK, PIECE = 16_000_000, 1 << 16


@dataclass
class Tree:
    """Inner nodes by level, left to right: term (-1: all rows go left), greatest bin and value that go left; and the leaves' values, times the tree's weight."""

    term: np.ndarray = field(default_factory=lambda: np.full(INNER, -1))
    bin: np.ndarray = field(default_factory=lambda: np.zeros(INNER, int))
    most: np.ndarray = field(default_factory=lambda: np.zeros(INNER))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros(LEAVES))


def margins(trees: list[Tree], places: pa.ListArray, values: pa.ListArray) -> np.ndarray:
    """The trees' sums for sparse rows: the terms that the trees ask for are dense, for SCORED rows at once."""
    asked = np.unique(np.concatenate([t.term for t in trees] or [np.zeros(0, int)]))
    asked, out = asked[asked >= 0], np.zeros(len(places))
    columns = [np.searchsorted(asked, t.term) for t in trees]
    for start in range(0, len(places) if len(asked) else 0, SCORED):
        some, weights = places.slice(start, SCORED), values.slice(start, SCORED)
        i, v = some.flatten().to_numpy(zero_copy_only=False), weights.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(some)), np.diff(some.offsets.to_numpy()))
        kept = np.isin(i, asked)
        dense = np.zeros((len(some), len(asked) + 1))
        dense[row[kept], np.searchsorted(asked, i[kept])] = v[kept]
        every = np.arange(len(some))
        for tree, column in zip(trees, columns):
            node = np.zeros(len(some), int)
            for _ in range(DEPTH):
                right = (tree.term[node] >= 0) & (dense[every, np.minimum(column[node], len(asked))] > tree.most[node])
                node = 2 * node + 1 + right
            out[start : start + len(some)] += tree.leaf[node - INNER]
    return out if len(asked) else out + sum(float(t.leaf[0]) for t in trees)


def thresholds(values: np.ndarray, weights: np.ndarray, total: float, most: int) -> np.ndarray:
    """Where the bins of a term end, by Spark's rule: ``values`` other than zero with their rows' weights, of rows that weigh ``total``, in ``most`` bins at most.

    Values with at most so many gaps are all told apart; else a gap is taken where the weight so far is nearest to the next multiple of an even share.
    """
    known, at = np.unique(values, return_inverse=True)
    sums = np.bincount(at, weights, len(known))
    rest = total - sums.sum()
    if rest > 100 * np.finfo(float).eps * len(values):
        place = int(np.searchsorted(known, 0.0))
        known, sums = np.insert(known, place, 0.0), np.insert(sums, place, rest)
    gaps = (known[1:] + known[:-1]) / 2
    if len(gaps) < most:
        return gaps
    out, so_far, share = [], np.cumsum(sums), total / most
    target = share
    for j, gap in enumerate(gaps):
        if abs(so_far[j] - target) < abs(so_far[j + 1] - target):
            out.append(gap)
            target += share
    return np.array(out)


def places_of_bins(rows: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Each term's ``thresholds``, by as many rows as Spark's trees ask for that (all, if they aren't more); the trees themselves are grown on all rows."""
    some = rows if n <= BIN_ROWS else rows.orderBy(F.xxhash64("_i", "_v"), "_w").limit(BIN_ROWS)
    some = written(some.select("_w", "_i", "_v"), "bins")
    count, total = some.agg(F.count("*"), F.sum("_w")).first()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.repeat(b.column(0).to_numpy(zero_copy_only=False).astype(float), np.diff(b.column(1).offsets.to_numpy())), *(b.column(c).flatten().to_numpy(zero_copy_only=False) for c in (1, 2))) for b in batches]
        if held:
            weight, term, value = (np.concatenate(c) for c in zip(*held))
            order = np.flatnonzero(value != 0)
            order = order[np.argsort(term[order], kind="stable")]
            weight, term, value = weight[order], term[order], value[order]
            first = np.flatnonzero(np.diff(term, prepend=-1))
            ends = [thresholds(value[x:y], weight[x:y], total, min(BINS, count)) for x, y in zip(first, np.append(first[1:], len(term)))]
            yield pa.RecordBatch.from_arrays([pa.array(term[first], pa.int32()), pa.array(ends, pa.list_(pa.float64()))], ["i", "at"])

    # One task: so many rows are few.
    out = {r["i"]: np.array(r["at"]) for r in some.select("_w", "_i", "_v").coalesce(1).mapInArrow(placed, "i int, at array<double>").collect()}  # a row per term
    discard(some)
    return out


class Bins:
    """Cells, which number the bins of all terms: where each term's begin, the cell of zero, and all ends in one array."""

    def __init__(self, ends: dict[int, np.ndarray], width: int):
        each = [ends.get(i, np.zeros(0)) for i in range(width)]
        self.first = np.concatenate([[0], np.cumsum([len(e) + 1 for e in each])]).astype(int)
        self.zero = self.first[:-1] + np.array([np.searchsorted(e, 0.0) for e in each], int)
        self.ends = each
        # Slices of about as many cells, each of whole terms.
        cuts = np.searchsorted(self.first, np.linspace(0, self.first[-1], SLICES + 1))
        self.slices = np.unique(cuts) if width else np.array([0, 0])

    def cells(self, term: np.ndarray, value: np.ndarray) -> np.ndarray:
        order, out = np.argsort(term, kind="stable"), np.zeros(len(term), int)
        bounds = np.flatnonzero(np.diff(term[order], prepend=-1))
        for start, end in zip(bounds, np.append(bounds[1:], len(term))):
            some = order[start:end]
            t = term[some[0]]
            out[some] = self.first[t] + np.searchsorted(self.ends[t], value[some])
        return out


@dataclass
class Block:
    """Rows: weights, signs and margins; and their entries outside the bins of zero, by cell."""

    weight: np.ndarray
    sign: np.ndarray
    margin: np.ndarray
    cell: np.ndarray
    row: np.ndarray

    def begins(self, cells: np.ndarray) -> np.ndarray:
        """Where the entries of these cells begin."""
        return np.searchsorted(self.cell, cells.astype(self.cell.dtype))  # of one type, or all cells would be copied

    def rights(self, tree: Tree, node: int, bins: Bins) -> np.ndarray:
        """Rows that ``node`` would send to the right."""
        t = tree.term[node]
        if t < 0:
            return np.zeros(len(self.weight), bool)
        edge = bins.first[t] + tree.bin[node] + 1
        start, middle, end = self.begins(np.array([bins.first[t], edge, bins.first[t + 1]]))
        out = np.full(len(self.weight), bins.zero[t] >= edge)
        out[self.row[start:middle]] = False
        out[self.row[middle:end]] = True
        return out

    def nodes(self, tree: Tree, depth: int, bins: Bins) -> np.ndarray:
        """Each row's node among those of its level."""
        node = np.zeros(len(self.weight), np.int64)
        for level in range(depth):
            node = self.below(tree, node, level, bins)
        return node

    def below(self, tree: Tree, node: np.ndarray, level: int, bins: Bins) -> np.ndarray:
        """The nodes of the next level, from those of ``level``."""
        right = np.zeros(len(node), bool)
        for at in range(2**level):
            right |= (node == at) & self.rights(tree, 2**level - 1 + at, bins)
        return 2 * node + right

    def later(self, trees: list[Tree], bins: Bins) -> np.ndarray:
        out = self.margin.copy()
        for tree in trees:
            out += tree.leaf[self.nodes(tree, DEPTH, bins)]
        return out

    def residual(self, trees: list[Tree], bins: Bins, first: bool) -> np.ndarray:
        """The first tree is fitted on the signs, the others on the slope of the logistic loss at half logits."""
        return self.sign if first else 4 * self.sign * np.exp(-np.logaddexp(0, 2 * self.sign * self.later(trees, bins)))


class Whole(Block):
    """All blocks as one: ``starts`` has where each cell's entries begin, in place of a cell for each entry. The list of ``parts`` is used up, so that no entry is held twice."""

    def __init__(self, parts: list[Block], bins: Bins):
        super().__init__(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("weight", "sign", "margin")), None, None)
        cells = int(bins.first[-1])
        counts = sum(np.bincount(p.cell, minlength=cells) for p in parts)
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        self.row = np.empty(self.starts[-1], np.int32)
        free, of = self.starts[:-1].copy(), 0
        while parts:
            p = parts.pop(0)
            own = np.bincount(p.cell, minlength=cells)
            self.row[np.arange(len(p.cell)) + np.repeat(free - np.cumsum(own) + own, own)] = p.row.astype(np.int32) + of
            free, of = free + own, of + len(p.weight)
        self.filled = np.flatnonzero(counts)
        first = self.starts[self.filled]
        self.cuts = np.unique(np.append(np.searchsorted(first, np.arange(0, len(self.row), PIECE)), len(first)))

    def begins(self, cells: np.ndarray) -> np.ndarray:
        return self.starts[cells]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The rows' ``values`` by cell, but for the cells of zero."""
        out = np.zeros(len(self.starts) - 1, values.dtype)
        for a, b in zip(self.cuts, self.cuts[1:]):
            some = self.filled[a:b]
            start = self.starts[some[0]]
            out[some] = np.add.reduceat(values.take(self.row[start : self.starts[some[-1] + 1]]), self.starts[some] - start)
        return out


def read(r: tuple) -> Block:
    weight, sign, cell, row = (np.frombuffer(r[i], kind) for i, kind in enumerate((float, float, np.int32, np.uint16)))
    return Block(weight, sign, np.zeros(len(weight)), cell, row)


def blocks(rows: DataFrame, label: str, bins: Bins, tasks: int) -> DataFrame:
    """Rows as the fields of ``Block``, in bytes: some thousands to a row."""
    known = rows.sparkSession.sparkContext.broadcast(bins)
    names = ("weight", "sign", "cell", "row")

    def built(held: list[tuple]) -> pa.RecordBatch:
        y, w, counts, i, v = (np.concatenate(c) for c in zip(*held))
        row, cell = np.repeat(np.arange(len(y)), counts), known.value.cells(i, v)
        kept = np.flatnonzero(cell != known.value.zero[i]) if len(i) else np.zeros(0, int)
        kept = kept[np.argsort(cell[kept], kind="stable")]
        parts = (w, np.where(y > 0, 1.0, -1.0), cell[kept].astype(np.int32), row[kept].astype(np.uint16))
        return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, entries = [], 0, 0
        for whole in batches:
            for start in range(0, len(whole), 1000):
                batch = whole.slice(start, 1000)
                y, w = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (0, 1))
                counts = np.diff(batch.column(2).offsets.to_numpy())
                held.append((y, w, counts, *(batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3))))
                n, entries = n + len(batch), entries + int(counts.sum())
                if n >= BLOCK_ROWS or entries >= BLOCK_ENTRIES:
                    yield built(held)
                    held, n, entries = [], 0, 0
        if held:
            yield built(held)

    dealt = rows.select(F.col(label).cast("int"), "_w", "_i", "_v").repartition(tasks)
    return written(dealt.mapInArrow(run, ", ".join(f"{c} binary" for c in names)), "blocks")


def split(bins: Bins, start: int, end: int, total: np.ndarray, g: np.ndarray, w: np.ndarray) -> tuple:
    """A node's best split by terms ``start`` to ``end``: gain, term, bin, sums at its left and of the node; of equal ones the first.

    ``total`` are the node's sums of residuals and weights, ``g`` and ``w`` those by cell, but for the cells of zero. All are whole numbers, and as such
    they are cumulated over all terms: what a term begins with is taken off again to the last digit.
    """
    if end <= start:
        return -1.0, -1, 0, 0.0, 0.0, *total
    first_cell = bins.first[start:end] - bins.first[start]
    zero = bins.zero[start:end] - bins.first[start]
    lengths = np.diff(bins.first[start : end + 1])
    lefts = []
    for x, whole in zip((g, w), total):
        x = x.astype(np.int64)
        x[zero] += int(whole) - np.add.reduceat(x, first_cell)
        x = np.cumsum(x)
        lefts.append((x - np.repeat(np.append(0, x)[first_cell], lengths)).astype(float))
    gl, wl = lefts
    gr, wr = total[0] - gl, total[1] - wl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where((wl > 0) & (wr > 0), (gl * gl / wl + gr * gr / wr - total[0] ** 2 / total[1]) / total[1], -1.0)
    c = int(np.argmax(gain))
    t = int(np.searchsorted(first_cell, c, "right")) - 1
    return (gain[c], start + t, c - int(first_cell[t]), gl[c], wl[c], *total) if gain[c] > 1e-12 else (-1.0, -1, 0, 0.0, 0.0, *total)


def extend(tree: Tree, depth: int, found: list[tuple], bins: Bins) -> None:
    """Takes up the ``split`` of each of a level's nodes, and the leaves' values so far."""
    n = len(found)
    for at, (_, t, b, gl, wl, g, w) in enumerate(found):
        node, below = n - 1 + at, LEAVES // n
        if t >= 0:
            tree.term[node], tree.bin[node], tree.most[node] = t, b, bins.ends[t][b]
            tree.leaf[at * below : at * below + below // 2] = gl / wl
            tree.leaf[at * below + below // 2 : (at + 1) * below] = (g - gl) / (w - wl)
        elif w > 0:
            tree.leaf[at * below : (at + 1) * below] = g / w


def grow_all(whole: Whole, bins: Bins, rounds: int, scale: float) -> Iterator[Tree]:
    """The trees of ``grow``, from blocks that one task holds.

    Residuals and weights are summed together, as complex numbers. Of two nodes with one parent only the right one's entries are summed: all are whole numbers,
    so the parent's sums less these are the left one's, to the last digit.
    """
    weight = np.rint(whole.weight * scale)
    for r in range(rounds):
        tree, node = Tree(), np.zeros(len(weight), np.int64)
        both = np.rint(whole.residual([], bins, r == 0) * whole.weight * scale) + 1j * weight
        sums = [whole.sums(both)]
        for depth in range(DEPTH):
            n = 2**depth
            if depth:
                parted = tree.term[n // 2 - 1 : n - 1] >= 0
                rights = [whole.sums(np.where(node == 2 * at + 1, both, 0)) if parted[at] else np.zeros_like(sums[at]) for at in range(n // 2)]
                sums = [x for parent, right in zip(sums, rights) for x in (parent - right, right)]
            total = np.stack([np.bincount(node, part, n) for part in (both.real, both.imag)])
            extend(tree, depth, [split(bins, 0, len(bins.zero), total[:, at], x.real, x.imag) for at, x in enumerate(sums)], bins)
            if not (tree.term[n - 1 : 2 * n - 1] >= 0).any():
                break
            node = whole.below(tree, node, depth, bins)
        if r:
            tree.leaf *= STEP
        whole.margin = whole.later([tree], bins)
        yield tree


def grow(held: RDD, bins: Bins, known, later: list[Tree], first: bool, scale: float) -> Tree:
    """One tree, level by level. Each task sums its rows' residuals and weights by node and cell, in slices; a slice's sums meet in one task, which finds its best splits.

    The driver gets one split a slice and node. Sums are of whole numbers, multiples of 1 / ``scale``, so they are the same in any order.
    """
    tree, cuts = Tree(), bins.slices
    for depth in range(DEPTH):
        n = 2**depth

        def summed(parts: Iterator[Block], depth=depth, n=n) -> Iterator[tuple[int, np.ndarray]]:
            own, total, sums = known.value, np.zeros((2, n)), 0.0
            for block in parts:
                node = block.nodes(tree, depth, own)
                both = np.stack([np.rint(block.residual(later, own, first) * block.weight * scale), np.rint(block.weight * scale)])
                total += np.stack([np.bincount(node, b, n) for b in both])
                at = block.cell.astype(np.int64) * n + node[block.row] if n > 1 else block.cell
                sums = sums + np.stack([np.bincount(at, b[block.row], own.first[-1] * n) for b in both])
            if np.ndim(sums):
                for s, (start, end) in enumerate(zip(cuts, cuts[1:])):
                    yield s, np.concatenate([total, sums[:, own.first[start] * n : own.first[end] * n]], axis=1)

        def best(part: tuple[int, np.ndarray], n=n) -> list[tuple]:
            s, sums = part
            g, w = sums[:, n:].reshape(2, -1, n)
            return [(at, split(known.value, cuts[s], cuts[s + 1], sums[:, at], g[:, at], w[:, at])) for at in range(n)]

        found = held.mapPartitions(summed).reduceByKey(np.add, len(cuts) - 1).flatMap(best).collect()
        extend(tree, depth, [max((f for place, f in found if place == at), key=lambda f: (f[0], -f[1])) for at in range(n)], bins)
        if not (tree.term[n - 1 : 2 * n - 1] >= 0).any():
            break
    if not first:
        tree.leaf *= STEP
    return tree


def boosted(rows: DataFrame, label: str, width: int, rounds: int) -> list[Tree]:
    """Trees on ``rows(label, _w, _i, _v)`` with ``width`` terms, as Spark's gradient-boosted trees grow them with logistic loss; rows are read several times.

    Rows are binned once, and kept by blocks. Up to ONE_TASK entries one task holds them and grows all trees; beyond, each level of a tree is a pass over the blocks. The trees are the same.
    """
    n, entries, heaviest = rows.agg(F.count("*"), F.sum(F.size("_i")), F.max("_w")).first()
    if not n:
        return []
    spark = rows.sparkSession.sparkContext
    bins = Bins(places_of_bins(rows, n), width)
    known = spark.broadcast(bins)
    tasks = max(1, min(spark.defaultParallelism, math.ceil(entries / TASK_ENTRIES)), math.ceil(entries / BLOCK_ENTRIES / 4))
    table = blocks(rows, label, bins, tasks)
    scale = 2.0 ** math.floor(51 - math.log2(max(1.0, 4 * n * heaviest)))
    if entries <= ONE_TASK:

        def grown(parts: Iterable[tuple]) -> Iterator[Tree]:
            held = [read(r) for r in parts]
            return grow_all(Whole(held, known.value), known.value, rounds, scale) if held else iter(())

        trees = table.coalesce(1).rdd.mapPartitions(grown).collect()
        known.unpersist()
        discard(table)
        return trees

    def taken(block: Block, later: list[Tree]) -> Block:
        return Block(block.weight, block.sign, block.later(later, known.value), block.cell, block.row)

    held = table.rdd.map(read).coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK)
    trees, later = [], []
    for r in range(rounds):
        if len(later) == UPDATE:
            before, held = held, held.map(lambda block, later=tuple(later): taken(block, later)).persist(StorageLevel.MEMORY_AND_DISK)
            held.count()
            before.unpersist()
            later = []
        later.append(grow(held, bins, known, later, r == 0, scale))
        trees.append(later[-1])
    held.unpersist()
    known.unpersist()
    discard(table)
    return trees
