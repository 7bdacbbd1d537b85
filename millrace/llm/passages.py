"""Repeated passages: difference-cover anchors find the places, hashes of whole windows decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import CHUNK_BYTES, WHITE, Words, byte_set, shared_keys, text_chunks, unpacked, words_of
from .shared import Scratch

#: Periods r * r + r + 1 of r = 1 to 5, for which a cover of r + 1 places exists in which each difference comes once.
PERIODS = tuple(r * r + r + 1 for r in range(1, 6))
#: Odd bases of the two window hashes modulo 2 ** 64; the words' own hashes are random.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: A unit of words begins where a hash of so many words is zero in so many low bits.
UNIT_WORDS, UNIT_BITS = 3, 5
#: Words or windows that are looked at at once, rows of a batch that a task sends back, and low bits of an exponent.
STEP_WORDS, SENT_ROWS, LOW_BITS = 1 << 16, 1 << 16, 12
_GAP = byte_set(WHITE)


@cache
def difference_cover(period: int) -> tuple[int, ...]:
    """The first smallest set with zero whose differences give every residue modulo ``period``."""
    size = 1
    while True:
        for rest in combinations(range(1, period), size - 1):
            if len({(a - b) % period for a in (0, *rest) for b in (0, *rest)}) == period:
                return (0, *rest)
        size += 1


def period_of(window: int) -> int:
    """The longest period that leaves over a third of the window to the anchor; one where no period does."""
    return max([1, *(p for p in PERIODS if 3 * (window - p + 1) > window)])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Rolling:
    """Hashes of any run of words, from sums of the words' hashes times powers of a base."""

    def __init__(self, hashes: np.ndarray, base: int):
        self.sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        up, self.down = _Powers(base, len(hashes)), _Powers(pow(base, -1, 1 << 64), len(hashes))
        for at in range(0, len(hashes), STEP_WORDS):
            some = hashes[at : at + STEP_WORDS]
            np.cumsum(some * up.of(np.arange(at, at + len(some))), out=self.sums[at + 1 : at + 1 + len(some)])
            self.sums[at + 1 : at + 1 + len(some)] += self.sums[at]

    def of(self, start: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Hashes of the ``n`` words from each ``start``, some at a time."""
        out = np.empty(len(start), dtype=np.uint64)
        for at in range(0, len(start), STEP_WORDS):
            first = start[at : at + STEP_WORDS]
            many = np.asarray(n[at : at + STEP_WORDS] if np.ndim(n) else n)
            run = (self.sums[first + many] - self.sums[first]) * self.down.of(first)
            out[at : at + len(first)] = _mixed(run + many.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        return out


class _Powers:
    """Powers of a base modulo 2 ** 64, as products of two short tables."""

    def __init__(self, base: int, most: int):
        self.low = self._table(base, 1 << LOW_BITS)
        self.high = self._table(pow(base, 1 << LOW_BITS, 1 << 64), (most >> LOW_BITS) + 1)

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def of(self, n: np.ndarray) -> np.ndarray:
        return self.low[n & ((1 << LOW_BITS) - 1)] * self.high[n >> LOW_BITS]


class Chunk:
    """Windows, anchors and units of the texts of one chunk.

    What is held for each word is narrow, and whatever a pass does with single
    words or windows it does with some at a time. The words' places in the
    texts are dropped unless ``spelt``, the second hash unless ``twice``.
    """

    def __init__(self, lengths: bytes, body: bytes, window: int, twice: bool = True, spelt: bool = False):
        texts = unpacked(lengths, body)
        self.texts = len(texts)
        words: Words = words_of(texts, _GAP)
        del texts
        self.window, self.period = window, period_of(window)
        hashes = np.array([xxhash.xxh64_intdigest(w.as_py()) for w in words.known], dtype=np.uint64)[words.code]
        words.code = words.known = None
        n = len(hashes)
        self.roll = [Rolling(hashes, b) for b in (BASES if twice else BASES[:1])]
        del hashes
        number = np.arange(n, dtype=words.text.dtype)
        #: Words of the text before a word, and from it on.
        self.place, self.left = words.first_and_end(self.texts)
        np.subtract(number, self.place, out=self.place)
        np.subtract(self.left, number, out=self.left)
        del number
        self.words = words if spelt else None
        #: Whether a window starts at a word.
        self.opens = self.left >= window
        begins = self.opens & (self.place == 0)
        for start in self.starts():
            begins[start] |= self.roll[0].of(start, min(UNIT_WORDS, window)) & np.uint64((1 << UNIT_BITS) - 1) == 0
        self.unit_start = np.flatnonzero(begins)
        self.unit_of = np.cumsum(begins, dtype=self.place.dtype)
        self.unit_of -= 1
        # a unit's windows start at its words up to the next unit or the text's last window
        last = np.append(self.unit_start[1:], n)[: len(self.unit_start)] - 1
        ends = np.minimum(last, self.unit_start + self.left[self.unit_start] - window) + window
        self.units = self.roll[0].of(self.unit_start, ends - self.unit_start) | np.uint64(1)

    def starts(self, gone: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """Words at which a window starts, but for ``gone``, some at a time."""
        for at in range(0, len(self.opens), STEP_WORDS):
            some = self.opens[at : at + STEP_WORDS]
            yield np.flatnonzero(some if gone is None else some & ~gone[at : at + STEP_WORDS]) + at

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Words at which an anchor begins, and its even hash; texts without a window have none."""
        size = self.window - self.period + 1
        cover = np.zeros(self.period, dtype=bool)
        cover[list(difference_cover(self.period))] = True
        at = []
        for first in range(0, len(self.place), STEP_WORDS):
            place, left = self.place[first : first + STEP_WORDS], self.left[first : first + STEP_WORDS]
            at.append(np.flatnonzero(cover[place % self.period] & (left >= size) & (left + place >= self.window)) + first)
        at = np.concatenate([np.zeros(0, dtype=np.int64), *at])
        return at, self.roll[0].of(at, size) & ~np.uint64(1)

    def near_anchors(self, at: np.ndarray) -> np.ndarray:
        """Whether one of the anchors ``at`` begins within the first ``period`` words of the window at a word."""
        n = len(self.place)
        step = np.zeros(n + 1, dtype=self.place.dtype)
        np.add.at(step, np.maximum(at - self.period + 1, at - self.place[at]), 1)
        step[at + 1] -= 1
        return (np.cumsum(step, dtype=step.dtype, out=step)[:n] > 0) & self.opens

    def window_hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.roll[0].of(at, self.window), (self.roll[1].of(at, self.window) >> np.uint64(33)).astype(np.int32)


def _isin(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether values are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(x), dtype=bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _pairs_in(a: np.ndarray, b: np.ndarray, known_a: np.ndarray, known_b: np.ndarray) -> np.ndarray:
    """Whether pairs are among the known ones, whose first members are sorted."""
    hit = np.zeros(len(a), dtype=bool)
    at = np.searchsorted(known_a, a)
    still = np.flatnonzero(_isin(a, known_a))
    while len(still):
        hit[still] = known_b[at[still]] == b[still]
        at[still] += 1
        still = still[~hit[still] & (at[still] < len(known_a))]
        still = still[known_a[at[still]] == a[still]]
    return hit


def _keys(table: pa.Table) -> np.ndarray:
    h = table.column("h").to_numpy().view(np.uint64)
    return h if len(h) < 2 or np.all(h[:-1] <= h[1:]) else np.sort(h)


def _longs(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _each(chunks: pa.Table, window: int, run: Callable, **more: bool) -> pa.Table:
    """``run`` on the single row of a chunk's table."""
    (row,) = chunks.select(["chunk", "lengths", "body"]).to_pylist()
    return run(row["chunk"], Chunk(row["lengths"], row["body"], window, **more))


def _sent(number: int, columns: dict[str, np.ndarray]) -> pa.Table:
    """Columns behind a chunk's number, in batches that neither side has to hold whole."""
    n = len(next(iter(columns.values())))
    own = pa.array(np.full(min(n, SENT_ROWS), number))
    parts = [{"chunk": own.slice(0, min(SENT_ROWS, n - at)), **{k: pa.array(v[at : at + SENT_ROWS]) for k, v in columns.items()}} for at in range(0, max(n, 1), SENT_ROWS)]
    return pa.Table.from_batches([pa.record_batch(p) for p in parts])


def _first_keys(window: int) -> Callable:
    def run(chunks: pa.Table) -> pa.Table:
        def rows(number: int, c: Chunk) -> pa.Table:
            h, n = np.unique(np.concatenate([c.anchors()[1], c.units]), return_counts=True)
            return _sent(number, {"h": h.view(np.int64), "many": n > 1})

        return _each(chunks, window, rows, twice=False)

    return run


def _counted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs, and whether each comes more than once."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    del order
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    return a[first], b[first], np.diff(first, append=len(a)) > 1


def _window_keys(window: int) -> Callable:
    def run(chunks: pa.Table, found: pa.Table) -> pa.Table:
        def rows(number: int, c: Chunk) -> pa.Table:
            known, led = _keys(found), _keys(found.filter(found.column("lead")))
            at, h = c.anchors()
            asked = c.near_anchors(at[_isin(h, known)])
            del at, h
            # a repeated unit's windows are asked for in its least chunk alone
            silent = _isin(c.units, known) & ~_isin(c.units, led)
            asked &= ~silent[c.unit_of] if len(silent) else True
            del known, led
            c.place = c.left = c.unit_of = None
            a, b, many = _counted(*c.window_hashes(np.flatnonzero(asked)))
            return _sent(number, {"h": a.view(np.int64), "h2": b, "many": many})

        return _each(chunks, window, rows)

    return run


def _kept(window: int) -> Callable:
    def run(chunks: pa.Table, found: pa.Table) -> pa.Table:
        def rows(_: int, c: Chunk) -> pa.Table:
            whole = found.column("h2").is_null()
            units, windows = _keys(found.filter(whole)), found.filter(pa.compute.invert(whole)).sort_by("h")
            h, h2 = windows.column("h").to_numpy(), windows.column("h2").to_numpy()
            del windows
            n = len(c.place)
            hit = np.zeros(n, dtype=bool)
            if len(c.units):
                hit = _isin(c.units, units)[c.unit_of] & c.opens
            for start in c.starts(hit):
                a = c.roll[0].of(start, c.window).view(np.int64)
                maybe = start[_isin(a, h)]
                if len(maybe):
                    a, b = c.window_hashes(maybe)
                    hit[maybe] = _pairs_in(a.view(np.int64), b, h, h2)
            c.roll = c.unit_of = c.place = c.left = None
            step = np.zeros(n + 1, dtype=np.int8)
            at = np.flatnonzero(hit)
            step[at] += 1
            step[at + window] -= 1
            del at
            gone = np.cumsum(step, dtype=c.words.text.dtype)[:n] > 0
            return _remaining(c, gone)

        out = _each(chunks, window, rows, spelt=True)
        ids = chunks.column("ids").combine_chunks().flatten()
        return out.add_column(0, "id", ids)

    return run


def _remaining(c: Chunk, gone: np.ndarray) -> pa.Table:
    """Per text the counts of words and of ``gone`` ones, and the others joined by one space."""
    w, texts = c.words, c.texts
    raw = w.raw.copy()
    raw[w.end] = 32
    edge = np.zeros(len(raw) + 1, dtype=np.int8)
    edge[w.start[~gone]] += 1
    edge[w.end[~gone] + 1] -= 1
    data = raw[np.cumsum(edge[:-1], dtype=np.int8, out=edge[:-1]).view(bool)].tobytes()
    del raw, edge
    size = lambda mask: np.bincount(w.text[mask], weights=(w.end - w.start + 1)[mask], minlength=texts).astype(np.int64)
    ends = np.cumsum(size(~gone))
    kept = [data[a : max(a, b - 1)] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if texts else []
    count = lambda mask: pa.array(np.bincount(w.text[mask], minlength=texts), pa.int64())
    return pa.table({"n_words": count(np.ones(len(gone), dtype=bool)), "n_removed": count(gone), "kept": pa.array(kept, pa.binary()).cast(pa.string())})


def without_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(id, n_words, n_removed, kept string)`` per row: words in no window of ``window`` words that starts elsewhere too.

    Three passes over the texts, which are dealt into chunks once:

    1. Anchors, hashes of ``window - period + 1`` words at the places of a
       difference cover modulo ``period``: two places always have a common shift
       into the cover, so equal windows share an anchor of equal hash. Also
       units, runs between places that the words decide, each with the rest of
       its last window; equal units have equal windows.
    2. Windows that hold a repeated anchor. All copies of a unit are known to
       be repeated by then, so only its least chunk asks for its windows, for
       the sake of other texts that hold some of them.
    3. Windows found in two chunks or twice in one, by 95 bits of two hashes,
       and repeated units are removed.

    A chunk gives each hash once, so a hash of any frequency has a row a chunk
    at most, and no pairs are made. Words are runs of other characters than
    space, tab and ASCII line breaks, compared exactly. Null texts are empty
    ones: no words, an empty ``kept``. Null ids and repeated rows are documents
    like others, so repeated rows repeat each other's windows. An empty table
    gives an empty result; extra columns are ignored.
    """
    if window < 1:
        raise ValueError("a window has at least one word")
    scratch = Scratch(df.sparkSession, "passages")
    chunks = text_chunks(scratch, df, id_col, text_col, chunk_bytes)
    slim = chunks.select("chunk", "lengths", "body").groupBy("chunk")
    kind = chunks.schema["ids"].dataType.elementType
    rows = slim.applyInArrow(_first_keys(window), "chunk long, h long, many boolean")
    found = scratch.keep(shared_keys(rows, "h"))
    asked = slim.cogroup(found.groupBy("chunk")).applyInArrow(_window_keys(window), "chunk long, h long, h2 int, many boolean")
    windows = scratch.keep(shared_keys(asked, "h", "h2").select("chunk", "h", "h2"))
    units = found.where(F.col("h").bitwiseAND(F.lit(1)) == 1).select("chunk", "h", F.lit(None).cast("int").alias("h2"))
    schema = T.StructType([T.StructField("id", kind), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return chunks.groupBy("chunk").cogroup(windows.union(units).groupBy("chunk")).applyInArrow(_kept(window), schema)
