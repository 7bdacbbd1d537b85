"""Packing tokenised documents into sequences by exact complements, then best fit."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbering import bucket_count, number_rows
from .shared import Scratch, small_batches

#: Numbering buckets of a length at most, and rows of one aimed at.
BUCKETS, BUCKET_ROWS = 4096, 250

Pattern = tuple[tuple[int, ...], int]


class SumIndex:
    """Hash index of the sums of one, two and three available lengths.

    ``left[l]`` is the number of pieces of length l not yet packed: the index
    of single sums. ``pairs[s]`` lists the larger lengths of the pairs of sum
    s, ``triples[s]`` the lengths that a pair completes to s. Counts only fall,
    so an entry whose lengths have run out is taken off when it is met, and
    all look-ups together cost no more than building the index.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = [0] * (capacity + 1)
        for length, n in counts.items():
            if not 0 < length <= capacity:
                raise ValueError(f"length {length} does not fit {capacity}")
            self.left[length] = n
        there = np.array(self.left) > 0
        lengths = np.flatnonzero(there)
        self.pairs: dict[int, list[int]] = {}
        self.triples: dict[int, list[int]] = {}
        for s in range(2, capacity + 1):
            big = lengths[(lengths < s) & (2 * lengths >= s)]
            if len(big := big[there[s - big]]):
                self.pairs[s] = big.tolist()  # the largest last, where entries are taken
        paired = np.zeros(capacity + 1, dtype=bool)
        paired[list(self.pairs)] = True
        for s in range(3, capacity + 1):
            one = lengths[lengths < s - 1]
            if len(one := one[paired[s - one]]):
                self.triples[s] = one.tolist()

    def pair(self, s: int, kept: int = 0) -> tuple[int, int] | None:
        """An available pair of sum ``s`` while one piece of length ``kept`` is set aside."""
        entries = self.pairs.get(s, [])
        i = len(entries) - 1
        while i >= 0:
            a, b = entries[i], s - entries[i]
            have_a, have_b = self.left[a], self.left[b]
            if not have_a or not have_b or (a == b and have_a < 2):
                entries.pop(i)
            elif have_a - (a == kept) >= 1 + (a == b) and have_b - (b == kept) >= 1:
                return a, b
            i -= 1
        return None

    def triple(self, s: int) -> tuple[int, int, int] | None:
        entries = self.triples.get(s, [])
        i = len(entries) - 1
        while i >= 0:
            a = entries[i]
            if not self.left[a] or not self.pairs.get(s - a):
                entries.pop(i)
            elif two := self.pair(s - a, a):
                return (a, *two)
            i -= 1
        return None

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that sum to ``gap``."""
        if gap and self.left[gap]:
            return (gap,)
        return self.pair(gap) or self.triple(gap)


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Sequences as (lengths in order, how many), using every piece exactly once.

    From the longest length down, combinations of one, two or three lengths that
    fill its gap exactly are looked up in the index of sums and consumed as
    often as their counts allow; what has no complement goes to best fit: longest first, each into the fullest
    open sequence that has room. Works on counts, so its time and size depend
    on the capacity, not on the number of documents.
    """
    index = SumIndex(counts, capacity)
    left = index.left
    out: list[Pattern] = []
    residual: dict[int, int] = {}
    for length in range(capacity, 0, -1):
        while left[length]:
            left[length] -= 1
            rest = index.complement(capacity - length) if length < capacity else ()
            left[length] += 1
            if rest is None:
                residual[length], left[length] = left[length], 0
                break
            whole = (length, *rest)
            times = min(left[x] // whole.count(x) for x in set(whole))
            for x in whole:
                left[x] -= times
            out.append((whole, times))
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    gaps = np.zeros(capacity + 1, dtype=bool)
    for length in sorted(residual, reverse=True):
        n = residual[length]
        while n:
            fits = np.flatnonzero(gaps[length:])
            if not len(fits):
                room[capacity][()] += n  # n new sequences; those not needed are taken back below
                gaps[capacity] = True
                continue
            gap = length + int(fits[0])
            whole, there = next(iter(room[gap].items()))
            times = min(n, there)
            if there == times:
                del room[gap][whole]
            else:
                room[gap][whole] -= times
            gaps[gap] = bool(room[gap])
            if not whole:  # as many of this length as fit go into each new sequence
                each = capacity // length
                times = n // each
                if times:
                    room[capacity - each * length][(length,) * each] += times
                    gaps[capacity - each * length] = True
                    n -= times * each
                if n:
                    room[capacity - n * length][(length,) * n] += 1
                    gaps[capacity - n * length] = True
                    n = 0
                room[capacity].clear()
                gaps[capacity] = False
            else:
                room[gap - length][(*whole, length)] += times
                gaps[gap - length] = True
                n -= times
    out += [(whole, n) for by in room.values() for whole, n in by.items() if whole]
    return out


def _lookup(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks, first sequence ids and offsets of its slots."""
    used: dict[int, int] = defaultdict(int)
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    first = 0
    for whole, times in patterns:
        at = 0
        for length in whole:
            slots[length].append((used[length], first, at))
            used[length] += times
            at += length
        first += times
    return {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v, strict=True)) for k, v in slots.items()}


def pack(pieces: DataFrame, capacity: int, length_col: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``pieces`` is read three times.

    The driver sees one count per length (at most ``capacity``) and plans; each
    piece is numbered among those of its length and looks its slot up. Rows
    equal in all columns get slots of their own; null lengths are an error; an
    empty table gives an empty result.
    """
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy(length_col).count().collect()}
    slots = _lookup(plan(counts, capacity))
    split = {k: b for k, n in counts.items() if (b := bucket_count(n, BUCKET_ROWS, BUCKETS)) > 1}
    per = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in split.items() for x in kv]), F.col(length_col).cast("int")), F.lit(1)) if split else 1
    ranked = number_rows(pieces, "_rank", per, length_col)
    kept = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(len(kept)).to_numpy(), b.column(len(kept) + 1).to_numpy()
            seq, off = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
            for k in np.unique(length).tolist():
                here = np.flatnonzero(length == k)
                start, first, at = slots[k]
                i = np.searchsorted(start, rank[here], side="right") - 1
                seq[here], off[here] = first[i] + rank[here] - start[i], at[i]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(seq), pa.array(off)], names=[*kept, "sequence_id", "offset"])

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*kept, F.col(length_col).cast("long").alias("_len"), F.col("_rank").alias("_r")).mapInArrow(run, schema)


# --- documents -------------------------------------------------------------------------------

_encodings: dict = {}


def _ids(path: str, pattern: str, text: str) -> np.ndarray:
    """Ids that the tokenizers library gives for the file, without special tokens added.

    Computed by tiktoken over the same ranks, several times faster; equal ids
    are a test's matter (tests/llm/test_operators.py). Strings of special
    tokens are special, as in the library. Texts with a run of white space
    that exceeds tiktoken's depth of search are encoded by this package's own
    encoder, which has no such limit.
    """
    from .bpe import encoder

    if path not in _encodings:
        import tiktoken

        own = encoder(path, pattern)
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=own.ids, special_tokens=own.special)
    try:
        return _encodings[path].encode_to_numpy(text, allowed_special="all")
    except ValueError as beyond:
        if "Regex error" not in str(beyond):
            raise
        return np.array(encoder(path, pattern).encode(text), dtype=np.uint32)


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def document_pieces(df: DataFrame, path: str, pattern: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32)`` of every document's ids followed by ``end_id``."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for k, t in enumerate(b.column(1)):
                ids = np.append(_ids(path, pattern, t.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for p, (start, n) in enumerate(cut_pieces(len(ids), capacity)):
                    for to, x in zip(rows, (k, p, start, n, zlib.crc32(ids[start : start + n].tobytes())), strict=True):
                        to.append(x)
            at = pa.array(rows[0], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])], names=["id", "piece", "start", "length", "ids_crc32"])

    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, T.StructType([
        T.StructField("id", slim.schema["id"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]))


def pack_documents(df: DataFrame, path: str, pattern: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)``, one row per piece.

    Null texts are empty: one piece of one token. Null ids and repeated rows
    are documents like others; an empty table gives an empty result; extra
    columns are ignored. Texts are tokenised once, the slim table of pieces
    goes to the shared folder.
    """
    scratch = Scratch(df.sparkSession, "packing")
    pieces = scratch.keep(document_pieces(df, path, pattern, capacity, end_id, id_col, text_col))
    return pack(pieces, capacity)
