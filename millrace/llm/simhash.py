"""Near-duplicate detection by SimHash fingerprints and pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hamming import CHUNK, fingerprint_links, links, pairs_across, pairs_near, shared_blocks
from .shared import Scratch, components, named_components, small_batches

SEED = 42


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased runs of anything but space, tab and the four line breaks of ASCII."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles_of(words: list[bytes], n: int) -> list[bytes]:
    """Space-joined runs of ``n`` words with repeats; fewer words give the whole sequence, none nothing."""
    if len(words) < n:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)))


def majority_bits(hashes: np.ndarray) -> np.ndarray:
    """Little-endian 64-bit words of which a bit is 1 if set in over half the rows of ``hashes(n, words)``."""
    n, width = hashes.shape
    if not n:
        return np.zeros(width, dtype=np.uint64)
    counts = np.zeros(64 * width, dtype=np.int64)
    for at in range(0, n, 4096):
        raw = np.ascontiguousarray(hashes[at : at + 4096]).astype("<u8", copy=False).view(np.uint8)
        counts += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * counts > n, bitorder="little").view("<u8").astype(np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text, unsigned; zero without words."""
    parts = shingles_of(words_of(text), shingle)
    h = xxhash.xxh64_intdigest
    return int(majority_bits(np.array([h(s, SEED) for s in parts], dtype=np.uint64).reshape(-1, 1))[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp long)``: one row per input row, whole texts, null text like the empty one."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, T.StructType([T.StructField("id", slim.schema["id"].dataType), T.StructField("fp", T.LongType())]))


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_diff: int = 3) -> DataFrame:
    """``(id, fp long, component)`` per input row; component: least id reachable over links.

    Texts with equal fingerprints form one node, so a group of any number of
    copies is one row in the search. Nulls count as empty texts, which all have
    fingerprint zero and are linked like any other; repeated rows each get a
    row; null ids are never a component's name unless all its ids are null;
    an empty table gives an empty result. Extra columns are ignored.
    """
    scratch = Scratch(df.sparkSession, "simhash")
    docs = scratch.keep(fingerprints(df, id_col, text_col, shingle))
    nodes = scratch.keep(docs.groupBy(F.col("fp").alias("node")).agg(F.min("id").alias("least_id")))
    roots = components(scratch, fingerprint_links(scratch, nodes.select("node"), max_diff))
    per_node = named_components(scratch, nodes, roots).withColumnRenamed("node", "fp")
    return docs.join(per_node, "fp").select("id", "fp", "component")


# --- wide fingerprints: similarity of five-word shingles -------------------------------------

#: 64-bit words of a wide fingerprint.
WIDE = 8
#: Largest share of differing bits between wide five-word fingerprints at a
#: Jaccard similarity s is acos(2s / (1 + s)) / pi.
def wide_limit(similarity: float, bits: int = 64 * WIDE) -> int:
    return int(np.floor(bits * np.arccos(2 * similarity / (1 + similarity)) / np.pi + 0.5))


#: Texts in which common shingles are counted, count that makes one common, and number of
#: them told apart. They set the order of prefixes, and so the size of blocks, not the pairs found.
SAMPLE, COMMON, RANKED = 8192, 4, 1 << 16
#: Standard deviations by which a pre-filter's limit exceeds the expected distance; ties
#: of the majority put a pair of 4 and 5 shingles two of them above what is expected.
MARGIN = 7


def wide_filter(similarity: float, bits: int = 64 * WIDE) -> int:
    """Most differing bits at which a pair is compared exactly."""
    mean = wide_limit(similarity, bits)
    return int(np.ceil(mean + MARGIN * np.sqrt(mean * (1 - mean / bits))))


def _mixed(h: np.ndarray, words: int) -> np.ndarray:
    """``words`` independent 64-bit hashes of each 64-bit hash (SplitMix64 steps)."""
    step = (np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    z = h[:, None] + step
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


#: 64-bit words of a parity sketch.
PARITY = 8


def parity_bits(hashes: np.ndarray) -> np.ndarray:
    """For each of ``64 * PARITY`` classes of hashes whether an odd number of the distinct ``hashes`` is in it.

    Two sketches differ in at most as many bits as the sets have elements that
    are not in both, so the bits bound the similarity from above, without error.
    """
    counts = np.bincount((hashes >> np.uint64(32)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY)
    return np.packbits(counts & 1, bitorder="little").view("<u8").astype(np.uint64)


def sketch_gap(similarity: float):
    """Differing SimHash bits of rows (SimHash, parity bits, size), and past all limits for pairs that cannot have the similarity."""
    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = np.bitwise_count(a[..., : WIDE + PARITY] ^ b[..., : WIDE + PARITY])
        only_one = x[..., WIDE:].sum(axis=-1, dtype=np.int64)
        size = a[..., -1].astype(np.int64) + b[..., -1].astype(np.int64)
        return np.where(only_one * (1 + similarity) <= size * (1 - similarity) + 1e-6, x[..., :WIDE].sum(axis=-1, dtype=np.int64), 1 << 30)

    return apart


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in set(shingles_of(words, shingle))], dtype=np.uint64))


def _similar(similarity: float):
    """Of rows ``(a, b, set a, set b)`` those whose sets have that Jaccard similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def shingle_sets(nodes: DataFrame, met: DataFrame, slim: DataFrame, shingle: int) -> DataFrame:
    """``(node, set binary)`` of the nodes in ``met(node)``; h: hash of one of a node's texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_hashes(words_of(t.as_py()), shingle).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    wanted = nodes.select("node", "h").join(met.distinct(), "node")
    texts = slim.select("text", F.xxhash64("text").alias("h")).join(wanted, "h")
    return texts.select("node", "text").mapInArrow(run, "node long, set binary").groupBy("node").agg(F.first("set").alias("set"))


def verified(scratch: Scratch, pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of the distinct ``pairs(a, b)`` those whose ``sets(node, set)`` have that Jaccard similarity."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("set").alias(f"s{c}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")
    return scratch.keep(full.mapInArrow(_similar(similarity), "a long, b long"))


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def common_shingles(slim: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of shingles that stand in ``COMMON`` texts or more of a sample."""
    every = max(1, slim.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shingle_hashes(words_of(t.as_py()), shingle) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *got]).view(np.int64))], names=["h"])

    sampled = slim.where(F.pmod(F.xxhash64("id", "text"), F.lit(every)) == 0).select("text")
    # at most RANKED rows reach the driver
    rows = sampled.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "h").limit(RANKED).collect()
    h, n = np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64), np.array([r[1] for r in rows], dtype=np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first ``n - ceil(similarity n) + 1`` of a set of ``n`` hashes, rare ones first.

    Sets of that Jaccard similarity have ``ceil(similarity n)`` elements of each
    in common, so under one order of all elements their prefixes share one.
    """
    n = len(hashes)
    if not n:
        return hashes
    rank = np.zeros(n, dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        rank = np.where(common[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, rank))[: n - int(np.ceil(similarity * n - 1e-9)) + 1]]


def similar_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """``(id, h, root, component)`` per row: groups of texts of Jaccard similarity ``similarity`` or more; h: XXH64 of the text, root: one for each group.

    Pairs meet in the blocks of their shingles' ``prefix``, as every pair of
    that similarity does. Those whose SimHash fingerprints differ in at most
    ``wide_filter`` bits, and whose ``parity_bits`` do not rule the similarity
    out, are compared by their shingles themselves, and link if these have it.
    Of a block of over 64 nodes each node is first compared with the nearest
    fingerprints, then every pair whose texts are not yet in one group.
    Texts with equal words share a node. Texts without words are compared as
    one and the same text. Nulls, repeats and empty tables as in
    ``simhash_components``.
    """
    small_batches(df.sparkSession)
    scratch = Scratch(df.sparkSession, "simhash-wide")
    slim = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    common, counts = common_shingles(slim, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, sig, keys = [], [], []
            for t in b.column(1):
                words = words_of(t.as_py())
                hashes = shingle_hashes(words, shingle)
                node.append(xxhash.xxh64_intdigest(b" ".join(words), SEED) - (1 << 63))
                sig.append(np.concatenate([majority_bits(_mixed(hashes, WIDE)), parity_bits(hashes), np.array([len(hashes)], np.uint64)]).tobytes())
                keys.append(prefix(hashes, similarity, common, counts).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(node, pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "h", "node", "sig", "keys"])

    docs = scratch.keep(slim.select("id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, T.StructType([
        T.StructField("id", slim.schema["id"].dataType), T.StructField("h", T.LongType()), T.StructField("node", T.LongType()),
        T.StructField("sig", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])))
    nodes = scratch.keep(docs.groupBy("node").agg(F.min("id").alias("least_id"), F.min("h").alias("h"), F.min("sig").alias("sig"), F.min("keys").alias("keys")))
    keyed = nodes.select("node", F.lit(0).alias("tab"), F.explode("keys").alias("key"))
    blocks = scratch.keep(shared_blocks(keyed, CHUNK))
    limit, gap = wide_filter(similarity), sketch_gap(similarity)
    large = blocks.groupBy("tab", "key", "sub").agg(F.count(F.lit(1)).alias("n")).where("n > 64").drop("n")
    crowded = scratch.keep(blocks.join(large, ["tab", "key", "sub"]))
    found = scratch.keep(ordered(links(blocks.join(nodes.select("node", "sig"), "node"), limit, partial(pairs_near, apart=gap))))
    met = found.select(F.col("a").alias("node")).union(found.select("b")).union(crowded.select("node"))
    sets = scratch.keep(shingle_sets(nodes, met, slim, shingle))
    similar = verified(scratch, found, sets, similarity)
    roots = components(scratch, similar)
    named = nodes.join(roots, "node", "left").select("node", F.concat("sig", F.to_binary(F.lpad(F.hex(F.coalesce("root", "node")), 16, "0"), F.lit("hex"))).alias("sig"))
    more = verified(scratch, ordered(links(crowded.join(named, "node"), limit, partial(pairs_across, apart=gap))), sets, similarity)
    if not more.isEmpty():
        roots = components(scratch, similar.union(more))
    per_node = named_components(scratch, nodes, roots)
    return docs.select("id", "h", "node").join(per_node, "node").select("id", "h", "root", "component")


def similar_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """``(id, component)`` of every row, as in ``similar_rows``."""
    return similar_rows(df, id_col, text_col, similarity, shingle).select("id", "component")


def without_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """One row of each group of ``similar_rows``, with the columns of ``df``: that of least id, then of least text hash.

    Null ids come last. Rows equal in id and text are one document, of which
    the least row by all columns stays. Texts move once, to their id and hash.
    """
    rows = similar_rows(df, id_col, text_col, similarity, shingle)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("h")))
    stay = rows.groupBy("root").agg(first.alias("s")).select(F.xxhash64("s.id").alias("_i"), F.col("s.h").alias("_h")).distinct()
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.xxhash64(F.col(f"`{id_col}`")).alias("_i"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("_h"))
    return keyed.join(stay, ["_i", "_h"], "left_semi").groupBy("_i", "_h").agg(F.min("_row").alias("_row")).select("_row.*")
