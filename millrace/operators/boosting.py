"""Boosted trees from histograms of gradients that are summed where the rows are."""

from __future__ import annotations

import hashlib
import heapq
import math
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.blocks import blocks, fewer_parts, summed

#: Bins of a feature, most trees between two writings of the errors, and gains that count as none.
BINS, REFRESH, NO_GAIN = 255, 20, 1e-6
#: Errors are also written where a task would look up more than this many leaves a pass, after a few trees at least.
LOOKED_UP, FEW_TREES = 1 << 21, 4
#: Rows of a block, and rows over which a pass takes less time than a job's start, so that one task makes all passes.
BLOCK, ROWS_HERE = 1 << 16, 1 << 18


@dataclass(frozen=True)
class Growth:
    """How trees grow. ``leaves`` bounds a tree's leaves, which then open by greatest gain; ``rows`` and ``columns`` are the shares that a tree sees."""

    trees: int = 300
    depth: int = 4
    rate: float = 0.05
    leaves: int | None = None
    penalty: float = 1.0
    least_weight: float = 1.0
    rows: float = 0.8
    columns: float = 0.8
    patience: int = 20
    seed: int = 42


@dataclass
class Tree:
    """Splits by place in a full binary tree (children of i: 2 i + 1 and 2 i + 2) and the values of its leaves."""

    feature: dict[int, int] = field(default_factory=dict)
    cut: dict[int, int] = field(default_factory=dict)
    gain: dict[int, float] = field(default_factory=dict)
    value: dict[int, float] = field(default_factory=dict)

    def finder(self) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
        """The places of the leaves, and a function that numbers the leaf of each row of bins.

        A feature's table holds, for each bin, which leaves its nodes leave open;
        only a row's own leaf is open in all tables.
        """
        ends = sorted({c for n in self.feature for c in (2 * n + 1, 2 * n + 2)} - set(self.feature) or {0})
        if len(ends) > 64:
            return np.array(ends), lambda bins: np.searchsorted(ends, self._walked(bins))
        whole, real, bits, offset = (np.uint16, np.float32, 23, 127) if len(ends) <= 16 else (np.uint64, np.float64, 52, 1023)
        under = {e: 1 << i for i, e in enumerate(ends)}
        for node in sorted(self.feature, reverse=True):
            under[node] = under[2 * node + 1] | under[2 * node + 2]
        every = under[0]
        tables: dict[int, np.ndarray] = {}
        for node, f in self.feature.items():
            table = tables.setdefault(f, np.full(256, every, dtype=whole))
            table[: self.cut[node] + 1] &= whole(every & ~under[2 * node + 2])
            table[self.cut[node] + 1 :] &= whole(every & ~under[2 * node + 1])

        def find(bins: np.ndarray) -> np.ndarray:
            left = None
            for f, table in tables.items():
                left = table[bins[:, f]] if left is None else left & table[bins[:, f]]
            if left is None:
                return np.zeros(len(bins), dtype=np.int64)
            return (left.astype(real).view(np.int32 if real is np.float32 else np.int64) >> bits) - offset  # one bit is set: its number is the exponent

        return np.array(ends), find

    def _walked(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), dtype=np.int64)
        for node in sorted(self.feature):
            here = np.flatnonzero(at == node)
            at[here] = 2 * node + 1 + (bins[here, self.feature[node]] > self.cut[node])
        return at

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The place at which each row of ``bins`` ends."""
        ends, find = self.finder()
        return ends[find(bins)]

    def predict(self, bins: np.ndarray) -> np.ndarray:
        ends, find = self.finder()
        return np.array([self.value[e] for e in ends.tolist()])[find(bins)]


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    cut: int
    sides: tuple[tuple[float, float], tuple[float, float]]


def best_split(hist: np.ndarray, columns: Sequence[int], penalty: float, least_weight: float) -> Split | None:
    """The split of greatest gain by ``hist(feature, bin, [gradient, hessian])``; of equal ones the first feature and cut.

    The gain is half the rise of sum(G)^2 / (sum(H) + penalty); a side weighs ``least_weight`` at least.
    """
    best = None
    for f in columns:
        left = np.cumsum(hist[f], axis=0)
        g, h = left[-1]
        right = left[-1] - left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = 0.5 * (left[:, 0] ** 2 / (left[:, 1] + penalty) + right[:, 0] ** 2 / (right[:, 1] + penalty) - g**2 / (h + penalty))
        fits = (left[:, 1] >= least_weight) & (right[:, 1] >= least_weight) & np.isfinite(gain)
        fits[-1] = False
        if fits.any():
            cut = int(np.argmax(np.where(fits, gain, -np.inf)))
            if gain[cut] > max(NO_GAIN * abs(g), best.gain if best else 0.0) and gain[cut] > 0:
                best = Split(float(gain[cut]), f, cut, (tuple(left[cut]), tuple(right[cut])))
    return best


def grown(splits: dict[int, Split], root: tuple[float, float], how: Growth) -> Tree:
    """The tree of the wanted splits: all of them, or leaf by leaf the one of greatest gain."""
    tree, sums = Tree(), {0: root}
    ready = [(-splits[0].gain, 0)] if 0 in splits else []
    while ready and (how.leaves is None or len(sums) < how.leaves):
        _, node = heapq.heappop(ready)
        s = splits[node]
        tree.feature[node], tree.cut[node], tree.gain[node] = s.feature, s.cut, s.gain
        sums.pop(node)
        for child, side in zip((2 * node + 1, 2 * node + 2), s.sides, strict=True):
            sums[child] = side
            if child in splits:
                heapq.heappush(ready, (-splits[child].gain, child))
    tree.value = {node: -how.rate * g / (h + how.penalty) if h + how.penalty > 0 else 0.0 for node, (g, h) in sums.items()}
    return tree


def drawn_columns(k: int, how: Growth, tree: int) -> list[int]:
    """The features that a tree may use: the least digests of (seed, tree, feature), one at least."""
    order = sorted(range(k), key=lambda f: hashlib.sha256(f"{how.seed}:{tree}:{f}".encode()).digest())
    return sorted(order[: max(1, int(how.columns * k))])


def binned_rows(data: DataFrame, k: int, later: object, bins: int = BINS) -> tuple[DataFrame, float]:
    """``(h long, bins binary, y, later boolean, pred)`` of ``data(date, stock_id, features, label)``, and the label's mean where not later.

    Edges are approximate quantiles, a bounded table; a value's bin counts the
    edges under it. ``pred`` begins as the mean.
    """
    from pyspark.ml.functions import vector_to_array

    x = vector_to_array("features")
    wide = data.select(F.xxhash64("date", "stock_id").alias("h"), *[x[i].alias(f"x{i}") for i in range(k)], F.col("label").alias("y"), (F.lit(False) if later is None else F.col("date") > F.lit(later)).alias("later"))
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    seen = wide.agg(F.avg(F.when(~F.col("later"), F.col("y"))).alias("m"), *[F.percentile_approx(f"x{i}", shares, 10000).alias(f"x{i}") for i in range(k)]).first()
    edges = [np.unique(np.array(seen[f"x{i}"] or [], dtype=float)) for i in range(k)]
    mean = seen["m"] or 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.stack([np.searchsorted(edges[i], b.column(1 + i).to_numpy(zero_copy_only=False)) for i in range(k)], axis=1).astype(np.uint8)
            packed = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((np.arange(b.num_rows + 1) * k).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(found))])
            yield pa.RecordBatch.from_arrays([b.column(0), packed, b.column(k + 1), b.column(k + 2), pa.array(np.full(b.num_rows, mean))], names=["h", "bins", "y", "later", "pred"])

    return fewer_parts(wide).mapInArrow(run, "h long, bins binary, y double, later boolean, pred double"), mean


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, k)


def _sampled(h: np.ndarray, how: Growth, tree: int) -> np.ndarray:
    """Whether rows of the hashes ``h`` belong to a tree's share."""
    salt = np.uint64(zlib.crc32(f"{how.seed}:{tree}".encode()) * 2 + 1)
    z = (h.view(np.uint64) ^ salt) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (z >> np.uint64(11)).astype(np.float64) / (1 << 53) < how.rows


#: A block: hashes, bins by columns, weights (none: each row counts once), errors, whether later.
Block = tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]


def _block(b: pa.RecordBatch, k: int) -> Block:
    """The block of a batch of ``binned_rows``, or of ``cells``."""
    off = b.column("pred").to_numpy() - b.column("y").to_numpy()
    weight = b.column("n").to_numpy().astype(float) if "n" in b.schema.names else None
    return (b.column("h").to_numpy(), np.asfortranarray(_matrix(b.column("bins"), k)), weight, off, b.column("later").to_numpy(zero_copy_only=False))


def cells(data: DataFrame) -> DataFrame:
    """``binned_rows`` with rows of equal bins as one, their label's mean as ``y`` and their number as ``n``.

    Trees that see all rows come out the same: gradients are sums, and squared
    errors only lose what is inside of a cell, whatever the trees.
    """
    merged = data.groupBy("bins", "later", "pred").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"))
    return merged.select(F.lit(0).cast("long").alias("h"), "bins", "y", "later", "pred", "n")


def looked(block: Block, trees: Sequence[Tree], partial: Tree, level: int, columns: Sequence[int], how: Growth, number: int) -> np.ndarray:
    """Histograms ``(column, node, bin, [gradient, hessian])`` of a level's nodes over a tree's rows, flat, then squared error and weight of the later rows.

    ``trees`` are those that the block's errors do not hold yet.
    """
    h, bins, weight, off, later = block
    nodes, first = 1 << level, (1 << level) - 1
    size = len(columns) * nodes * BINS * 2
    total = np.zeros(size + 2)
    hist = total[:size].reshape(len(columns), 2, nodes * BINS)
    if trees:
        off = off + sum(t.predict(bins) for t in trees)
    if level == 0:
        w = off[later] if weight is None else off[later] * weight[later]
        total[size:] = off[later] @ w, later.sum() if weight is None else weight[later].sum()
    use = ~later
    if how.rows < 1:
        use &= _sampled(h, how, number)
    at = 0
    if level:
        at = (partial.leaf_of(bins) - first) * BINS
        use &= at >= 0
        at = at[use]
    g, w = off[use], None if weight is None else weight[use]
    if w is not None:
        g = g * w
    for i, f in enumerate(columns):
        key = at + bins[:, f][use].astype(np.int64)
        hist[i, 0] = np.bincount(key, g, nodes * BINS)
        hist[i, 1] = np.bincount(key, w, nodes * BINS)
    return total


class Spread:
    """Blocks on the executors: each look is a job."""

    def __init__(self, rows: RDD, largest: int):
        self.rows, self.largest, self.fresh = rows, largest, []

    def look(self, *args, size: int) -> np.ndarray:
        fresh = tuple(self.fresh)
        return summed(self.rows, lambda *block: looked(block, fresh, *args), np.zeros(size))

    def add(self, tree: Tree) -> None:
        """Errors are written now and then, so that a look has few trees to look up."""
        self.fresh.append(tree)
        if len(self.fresh) >= min(REFRESH, max(FEW_TREES, LOOKED_UP // max(1, self.largest))):
            fresh = tuple(self.fresh)
            newer = self.rows.map(lambda b: (*b[:3], b[3] + sum(t.predict(b[1]) for t in fresh), b[4])).persist(StorageLevel.MEMORY_AND_DISK)
            newer.count()
            self.rows.unpersist()
            self.rows, self.fresh = newer, []


class Here:
    """Blocks in this task."""

    def __init__(self, held: Sequence[Block]):
        self.held = list(held)

    def look(self, *args, size: int) -> np.ndarray:
        return sum((looked(b, (), *args) for b in self.held), np.zeros(size))

    def add(self, tree: Tree) -> None:
        self.held = [(*b[:3], b[3] + tree.predict(b[1]), b[4]) for b in self.held]


def boost(data: DataFrame, k: int, how: Growth) -> tuple[list[Tree], int]:
    """Trees for squared errors of ``binned_rows``, and how many of them have the least error on the later rows.

    Trees that see all rows are grown on ``cells``. Where there are at most
    ``ROWS_HERE`` rows, one task makes all passes; else a pass is a job.
    """
    merged = cells(data).persist() if how.rows >= 1 else None
    rows = blocks(data if merged is None else fewer_parts(merged), lambda b: _block(b, k), BLOCK)
    sizes = rows.mapPartitions(lambda held: [sum(len(b[3]) for b in held)]).collect()  # one number a task
    if merged is not None:
        merged.unpersist()
    if sum(sizes) <= ROWS_HERE:
        found = rows.coalesce(1).mapPartitions(lambda held: [boosted(Here(held), k, how)]).collect()
        rows.unpersist()
        return found[0] if found else ([], 0)
    spread = Spread(rows, max(sizes))
    out = boosted(spread, k, how)
    spread.rows.unpersist()
    return out


def boosted(held: Spread | Here, k: int, how: Growth) -> tuple[list[Tree], int]:
    """Trees, and how many of them have the least error on the later rows.

    A level of a tree is one pass: all its nodes' histograms at once, so a tree
    takes ``depth`` passes also where leaves open by gain, since every node
    that may open is known by then. It stops ``patience`` trees after the least
    error, or where no split gains.
    """
    trees: list[Tree] = []
    least, best = math.inf, 0
    while True:
        partial, splits, root = Tree(), {}, (0.0, 0.0)
        columns = drawn_columns(k, how, len(trees))
        stop = False
        for level in range(how.depth):
            size = len(columns) * (1 << level) * BINS * 2
            found = held.look(partial, level, columns, how, len(trees), size=size + 2)
            hist = found[:size].reshape(len(columns), 2, 1 << level, BINS).transpose(2, 0, 3, 1)
            if level == 0:
                root = tuple(hist[0, 0].sum(axis=0))
                error, n = found[size:]
                if n:
                    if error / n < least:
                        least, best = error / n, len(trees)
                    stop = len(trees) - best >= how.patience
                else:
                    best = len(trees)
                if stop or len(trees) == how.trees:
                    stop = True
                    break
            opened = False
            for i in range(1 << level):
                node = (1 << level) - 1 + i
                if level and node not in {c for p in partial.feature for c in (2 * p + 1, 2 * p + 2)}:
                    continue
                if (s := best_split(hist[i], range(len(columns)), how.penalty, how.least_weight)) is not None:
                    s = replace(s, feature=columns[s.feature])
                    splits[node], partial.feature[node], partial.cut[node], opened = s, s.feature, s.cut, True
            if not opened:
                break
        if stop or not splits:
            break
        trees.append(grown(splits, root, how))
        held.add(trees[-1])
    return trees, best


def importances(trees: Sequence[Tree], k: int, mean: bool) -> np.ndarray:
    """Share of each feature in the gains, summed, or their mean over the feature's splits."""
    total, n = np.zeros(k), np.zeros(k)
    for t in trees:
        for node, f in t.feature.items():
            total[f] += t.gain[node]
            n[f] += 1
    got = total / np.maximum(n, 1) if mean else total
    return got / got.sum() if got.sum() > 0 else got


#: Trees by levels with penalised leaves, and trees whose leaves open by gain, whose rows are not sampled.
SECOND_ORDER = Growth()
LEAF_WISE = Growth(leaves=15, penalty=0.0, least_weight=20.0, rows=1.0)


def boosted_selection(data: DataFrame, factors: Sequence[str], how: Growth = SECOND_ORDER, later: object = None, top: int = 10) -> dict[str, float]:
    """The ``top`` factors by gain of trees boosted on ``data(date, stock_id, features, label)``.

    Rows after the date ``later`` are not learnt from; they tell when to stop.
    Trees by levels are judged by the mean gain of all trees, those by leaves
    by the sum of gains up to the least error. Without rows, or where nothing
    gains, none is chosen.
    """
    k = len(factors)
    rows, _ = binned_rows(data, k, later)
    trees, best = boost(rows, k, how)
    weights = importances(trees if how.leaves is None else trees[:best], k, mean=how.leaves is None)
    return dict(sorted(((f, float(w)) for f, w in zip(factors, weights, strict=True) if w > 0), key=lambda x: -x[1])[:top])
