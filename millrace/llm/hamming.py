"""Links between fingerprints that differ in few bits, found by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

#: Fingerprints compared all against all in one task; larger blocks are split.
CHUNK = 4096
#: Parts that a fingerprint is cut into. Three may hold a differing bit, so a
#: block key is two of them, 25 or 26 bits, and there are ten keys at every input size.
PARTS = 5


def cut_bits(bits: list[int], n: int) -> list[int]:
    """The bits' places in ``n`` runs of near equal length, as masks."""
    cuts = [len(bits) * i // n for i in range(n + 1)]
    return [sum(1 << k for k in bits[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def block_masks(max_diff: int, parts: int = PARTS, width: int = 64) -> list[int]:
    """Masks such that two fingerprints with at most ``max_diff`` differing bits agree on one.

    Differing bits lie in at most ``max_diff`` of the ``parts``, so every choice
    of the other ``parts - max_diff`` is a mask.
    """
    return [sum(c) for c in combinations(cut_bits(list(range(width)), max(parts, max_diff + 1)), max(parts, max_diff + 1) - max_diff)]


def inner_masks(mask: int, max_diff: int, width: int = 64) -> list[int]:
    """Masks over the bits that ``mask`` leaves; two fingerprints that agree under it and link agree on one of these."""
    return cut_bits([k for k in range(width) if not mask >> k & 1], max_diff + 1)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def mask_keys(fingerprint: Column, masks: list[int]) -> Column:
    """array<struct<tab,key>> of a 64-bit fingerprint's values under each mask."""
    return F.array(*(F.struct(F.lit(i).alias("tab"), fingerprint.bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)))


def sized_blocks(keyed: DataFrame) -> DataFrame:
    """``keyed(tab, key, node)`` of blocks with two nodes or more, with their sizes ``n``.

    Sizes are summed where the rows are and joined back, so no block meets in a task.
    """
    sizes = keyed.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(sizes, ["tab", "key"])


def shared_blocks(keyed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows ``(tab, key, sub, node)`` of blocks with at least two nodes.

    A block of more than ``chunk`` nodes is dealt into pieces by a hash of the
    node; each row goes to every pair of pieces that has its own, so each pair
    of nodes still meets, and no task holds more than about two pieces.
    """
    sized = sized_blocks(keyed)
    pieces = F.ceil(F.col("n") / F.lit(chunk)).cast("int")
    own = F.pmod(F.xxhash64("node"), pieces).cast("int")
    subs = F.when(pieces == 1, F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), pieces - 1), lambda j: F.least(own, j) * pieces + F.greatest(own, j)))
    return sized.select("tab", "key", "node", F.explode(subs).alias("sub"))


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def pairs_within(node: np.ndarray, sig: np.ndarray, start: np.ndarray, max_diff: int, apart=bits_apart) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of rows in the same group; spanning pairs only for groups over 64 rows."""
    size = np.diff(start)
    row_end = np.repeat(start[1:], size)
    small = np.repeat(size <= 64, size)
    i = np.flatnonzero(small)
    gap = 1
    while len(i := i[i + gap < row_end[i]]):
        diff = apart(sig[i], sig[i + gap])
        hit = i[diff <= max_diff]
        if len(hit):
            yield node[hit], node[hit + gap]
        gap += 1
    for lo, hi in ((start[g], start[g + 1]) for g in np.flatnonzero(size > 64)):
        # breadth first over the links; each step compares a frontier row with the rows not yet reached
        rest = np.arange(lo, hi)
        while len(rest):
            frontier, rest = [rest[0]], rest[1:]
            while frontier and len(rest):
                at = frontier.pop()
                near = apart(sig[rest], sig[at]) <= max_diff
                if near.any():
                    found = rest[near]
                    yield np.full(len(found), node[at]), node[found]
                    frontier.extend(found.tolist())
                    rest = rest[~near]


def pairs_near(node: np.ndarray, sig: np.ndarray, start: np.ndarray, max_diff: int, apart=bits_apart, nearest: int = 8) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of rows in the same group; for groups over 64 rows each row with its ``nearest`` links only."""
    size = np.diff(start)
    small = np.concatenate([np.arange(a, b) for a, b in zip(start[:-1], start[1:], strict=True) if b - a <= 64] or [np.empty(0, np.int64)]).astype(np.int64)
    if len(small):
        yield from pairs_within(node[small], sig[small], np.append(0, np.cumsum(size[size <= 64])), max_diff, apart)
    for lo, hi in ((start[g], start[g + 1]) for g in np.flatnonzero(size > 64)):
        bits = sig[lo:hi]
        for i in range(hi - lo):
            away = apart(bits, bits[i])
            away[i] = max_diff + 1
            near = np.argpartition(away, nearest)[:nearest]
            near = near[away[near] <= max_diff]
            if len(near):
                yield np.full(len(near), node[lo + i]), node[lo + near]


def pairs_across(node: np.ndarray, sig: np.ndarray, start: np.ndarray, max_diff: int, apart=bits_apart) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every linked pair of rows in a group of over 64 whose last words, the names of their components, differ."""
    for lo, hi in ((start[g], start[g + 1]) for g in np.flatnonzero(np.diff(start) > 64)):
        at = lo + np.argsort(sig[lo:hi, -1], kind="stable")
        bits, root = sig[at, :-1], sig[at, -1]
        after = np.searchsorted(root, root, side="right")
        for i in range(len(at)):
            near = apart(bits[after[i] :], bits[i]) <= max_diff
            if near.any():
                found = at[after[i] :][near]
                yield np.full(len(found), node[at[i]]), node[found]


def _linker(max_diff: int, with_sig: bool, pairs=pairs_within):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        def work(table: pa.Table):
            if not table.num_rows:
                return
            node = table["node"].to_numpy()
            if with_sig:
                flat = table["sig"].combine_chunks()
                flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
                sig = np.frombuffer(b"".join(flat.to_pylist()), dtype=np.uint64).reshape(len(node), -1)
            else:
                sig = node.view(np.uint64)[:, None]
            keys = [table[c].to_numpy() for c in ("tab", "key", "sub")]
            new = np.ones(len(node), dtype=bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            start = np.append(np.flatnonzero(new), len(node))
            for a, b in pairs(node, sig, start, max_diff):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if tail is not None and tail.num_rows:
                table = pa.concat_tables([tail, table])
            # the last group may go on in the next batch
            n = table.num_rows
            if not n:
                continue
            last = [table[c][n - 1].as_py() for c in ("tab", "key", "sub")]
            same = np.logical_and.reduce([table[c].to_numpy() == v for c, v in zip(("tab", "key", "sub"), last, strict=True)])
            cut = n - int(np.argmin(same[::-1])) if not same.all() else 0
            yield from work(table.slice(0, cut))
            tail = table.slice(cut)
        if tail is not None:
            yield from work(tail)

    return run


def links(blocks: DataFrame, max_diff: int, pairs=pairs_within) -> DataFrame:
    """Edges ``(a, b)`` between nodes of a block ``(tab, key, sub)`` whose signatures differ in at most ``max_diff`` bits.

    Without a column ``sig`` (binary) a node is itself its 64-bit signature.
    Components of the edges equal components of all links: in groups of up to 64
    rows every link is given, in larger ones by default a spanning forest of them, so the
    output is linear in the rows. Other ``pairs`` decide otherwise which rows of
    a block are paired.
    """
    signed_ = "sig" in blocks.columns
    cols = ["tab", "key", "sub", "node"] + (["sig"] if signed_ else [])
    dealt = blocks.select(*cols).repartition("tab", "key", "sub").sortWithinPartitions(*cols[: 4 if signed_ else 3])
    return dealt.mapInArrow(_linker(max_diff, signed_, pairs), "a long, b long")


def fingerprint_links(scratch: Scratch, nodes: DataFrame, max_diff: int, parts: int = PARTS, chunk: int = CHUNK) -> DataFrame:
    """Edges between the distinct 64-bit fingerprints ``nodes(node long)``.

    The nodes of a block over ``chunk`` meet by the same principle once more:
    of ``max_diff + 1`` runs of the bits that the block's key leaves, a linked
    pair agrees on one. Only what is still over ``chunk`` then is dealt into
    pieces that meet two by two.
    """
    masks = block_masks(max_diff, parts)
    keyed = scratch.keep(nodes.select("node", F.explode(mask_keys(F.col("node"), masks)).alias("k")).select("k.tab", "k.key", "node"))
    sized = scratch.keep(sized_blocks(keyed))
    small = sized.where(F.col("n") <= chunk).select("tab", "key", F.lit(0).alias("sub"), "node")
    # tab * (max_diff + 1) + run tells the inner tables apart; their keys hold the block's bits, too
    finer = F.element_at(F.array(*[F.array(*[
        F.struct(F.lit(-1 - i * (max_diff + 1) - j).alias("tab"), F.col("node").bitwiseAND(F.lit(signed(m | x))).alias("key")) for j, x in enumerate(inner_masks(m, max_diff))]) for i, m in enumerate(masks)]), F.col("tab") + 1)
    large = sized.where(F.col("n") > chunk).select("node", F.explode(finer).alias("k")).select("k.tab", "k.key", "node")
    return links(small.union(shared_blocks(large, chunk).select("tab", "key", "sub", "node")), max_diff)
