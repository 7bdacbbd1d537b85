"""A random forest whose trees are grown side by side, a level of all of them in one pass."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame

from millrace.operators.blocks import blocks
from millrace.operators.boosting import BINS, BLOCK, Tree, _matrix, binned_rows

#: Bytes of the histograms that are made at once.
HISTOGRAMS = 1 << 22
#: How often a row is drawn for a tree, by 16 random bits: the Poisson law of mean 1.
DRAWS = np.searchsorted(np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)])), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(float)


def drawn(h: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row, by its hash, is drawn for a tree: the same wherever the row lies."""
    salt = np.uint64(zlib.crc32(f"{seed}:{tree // 4}".encode()) * 2 + 1)
    z = (h.view(np.uint64) ^ salt) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return DRAWS[((z ^ (z >> np.uint64(31))) >> np.uint64(16 * (tree % 4))).astype(np.uint16)]


def tried(k: int, seed: int, tree: int, level: int) -> np.ndarray:
    """``(node, feature)``: a third of the features, drawn anew for each node of a level."""
    order = np.random.default_rng([seed, tree, level]).random((1 << level, k)).argsort(axis=1)
    return order[:, : -(-k // 3)]


def _block(b: pa.RecordBatch, k: int) -> tuple[np.ndarray, ...]:
    """(hashes, labels less their mean, number of each row's cell, bins of the cells) of a batch of ``binned_rows``."""
    bins = _matrix(b.column("bins"), k)
    found, cell = np.unique(np.ascontiguousarray(bins).view(np.dtype((np.void, k))).ravel(), return_inverse=True)
    return b.column("h").to_numpy(), b.column("y").to_numpy() - b.column("pred").to_numpy(), cell, np.frombuffer(found.tobytes(), dtype=np.uint8).reshape(-1, k).astype(np.int64)


def histograms(held: Sequence[tuple[np.ndarray, ...]], trees: Sequence[tuple[int, Tree]], level: int, k: int, seed: int) -> np.ndarray:
    """``(tree, node, place in tried, bin, [rows, label])``: sums over drawn rows.

    Rows of a cell go through a tree together: their draws are summed first.
    """
    first, nodes, m = (1 << level) - 1, 1 << level, -(-k // 3)
    out = np.zeros((len(trees), m, 2, nodes * BINS))
    for i, (number, tree) in enumerate(trees):
        ends, find = tree.finder()
        among = tried(k, seed, number, level)
        for h, y, cell, bins in held:
            times = drawn(h, seed, number)
            n, total = np.bincount(cell, times, len(bins)), np.bincount(cell, times * y, len(bins))
            node = ends[find(bins)] - first
            here = np.flatnonzero(node >= 0)
            if not len(here):
                continue
            node, n, total = node[here], n[here], total[here]
            for j in range(m):
                key = node * BINS + bins[here, among[node, j]]
                out[i, j, 0] += np.bincount(key, n, nodes * BINS)
                out[i, j, 1] += np.bincount(key, total, nodes * BINS)
    return out.reshape(len(trees), m, 2, nodes, BINS).transpose(0, 3, 1, 4, 2)


def splits(hist: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, place in tried, last bin of the left side) of each tree's nodes; a side has ``least`` drawn rows. No gain is 0.

    The gain is how much the squared error falls.
    """
    left = hist.cumsum(axis=3)
    whole = left[:, :, :, -1:, :]
    right = whole - left
    part = lambda s: s[..., 1] ** 2 / np.maximum(s[..., 0], 1.0)
    rise, before = part(left) + part(right), part(whole)
    gain = np.where((left[..., 0] >= least) & (right[..., 0] >= least) & (rise > before * (1 + 1e-12)), rise - before, 0.0)
    flat = gain.reshape(*gain.shape[:2], -1)
    at = flat.argmax(axis=2)
    return np.take_along_axis(flat, at[..., None], axis=2)[..., 0], at // BINS, at % BINS


def grow(rows: RDD, k: int, trees: int, depth: int, least: int, seed: int) -> list[Tree]:
    """Trees by levels; a level of all trees is one job, whose histograms meet tree by tree."""
    out = [Tree() for _ in range(trees)]
    parts = max(1, rows.getNumPartitions())
    for level in range(depth):
        each = max(1, HISTOGRAMS // ((1 << level) * -(-k // 3) * BINS * 16))
        open_ = [(i, t) for i, t in enumerate(out) if not level or any(p >= (1 << (level - 1)) - 1 for p in t.feature)]
        chunks = [open_[lo : lo + each] for lo in range(0, len(open_), each)]

        def work(held: Iterator[tuple[np.ndarray, ...]], chunks: list = chunks, level: int = level) -> Iterator[tuple[int, np.ndarray]]:
            held = list(held)
            for c, some in enumerate(chunks):
                yield c, histograms(held, some, level, k, seed)

        for c, (gain, place, cut) in rows.mapPartitions(work).reduceByKey(np.add, min(parts, max(1, len(chunks)))).mapValues(lambda x: splits(x, least)).collect():
            for (i, tree), g, p, x in zip(chunks[c], gain, place, cut, strict=True):
                among = tried(k, seed, i, level)
                for n in np.flatnonzero(g > 0).tolist():
                    node = (1 << level) - 1 + n
                    tree.feature[node], tree.cut[node], tree.gain[node] = int(among[n, p[n]]), int(x[n]), float(g[n])
    return out


def shares(trees: Sequence[Tree], k: int) -> np.ndarray:
    """Mean share of each feature in the gains of a tree."""
    total = np.zeros(k)
    for t in trees:
        own = np.bincount(list(t.feature.values()), list(t.gain.values()), k) if t.feature else np.zeros(k)
        total += own / own.sum() if own.sum() > 0 else own
    return total / total.sum() if total.sum() > 0 else total


def forest(data: DataFrame, k: int, trees: int = 500, depth: int = 6, least: int = 20, seed: int = 42) -> list[Tree]:
    """Trees on ``data(date, stock_id, features, label)``, each on rows drawn with repetition; a node tries a third of the features."""
    binned, _ = binned_rows(data, k, None)
    rows = blocks(binned, lambda b: _block(b, k), BLOCK)
    out = grow(rows, k, trees, depth, least, seed)
    rows.unpersist()
    return out
