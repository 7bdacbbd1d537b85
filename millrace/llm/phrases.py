"""Frequent phrases by relational mining: occurrence relations, merge-joined, counted, reduced to frequent groups."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import byte_set, dealt, new_chunk, packed_numbers, unpacked_numbers, words_of
from .shared import Scratch, small_batches

#: Bytes of text that a task holds as word codes before it closes the largest language's chunk.
HELD_BYTES = 16 << 20
#: Bytes of text that are taken apart at once, but for a single longer word, and places of a chunk that are looked at at once.
STEP_BYTES, STEP_PLACES = 1 << 20, 1 << 18
#: Rows of a batch that a task sends back.
SENT_ROWS = 1 << 16
#: Candidates that one task ranks before a language's best meet.
RANKED = 100_000
#: Name of a missing language.
UNKNOWN = "und"
_BREAK = byte_set(b".,;:!?\n\v\f\r")
_GAP = _BREAK | byte_set(b" \t")
_CUT = re.compile(rb"[ \t.,;:!?\n\v\f\r]")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _occurrences(raw: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes from 1 of the words in order, 0 where a piece ends; the words by code, and their counts."""
    w = words_of([raw], _GAP, _FOLD)
    breaks = np.cumsum(_BREAK[w.raw[:-1]], dtype=np.int32)
    before = np.concatenate([[0], breaks[w.start], breaks[-1:]])
    return np.insert(w.code + 1, np.flatnonzero(np.diff(before)), 0).astype(np.uint32), w.known, np.bincount(w.code, minlength=len(w.known))


class _Chunk:
    """Texts of one language as the codes of their words, taken apart a step of bytes at a time."""

    def __init__(self):
        self.size, self.waiting, self.texts, self.parts = 0, 0, [], []

    def add(self, text: bytes) -> None:
        self.texts.append(text)
        self.size += len(text) + 1
        self.waiting += len(text) + 1
        if self.waiting >= STEP_BYTES:
            self._take()

    def _take(self) -> None:
        raw = b"\n".join([*self.texts, b""])
        self.texts, self.waiting, at = [], 0, 0
        while at < len(raw):
            cut = _CUT.search(raw, at + STEP_BYTES)
            end = cut.end() if cut else len(raw)
            self.parts.append(_occurrences(raw[at:end]))
            at = end

    def close(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """What ``_occurrences`` gives for all texts."""
        self._take()
        one = pa.concat_arrays([words for _, words, _ in self.parts]).dictionary_encode()
        words, codes, own, at = one.dictionary, [], one.indices.to_numpy(), 0
        counts = np.zeros(len(words), dtype=np.int64)
        for k, (code, _, n) in enumerate(self.parts):
            of, at = own[at : at + len(n)], at + len(n)
            counts[of] += n
            codes.append(np.concatenate([[0], of + 1]).astype(np.uint32)[code])
            self.parts[k] = None
        return np.concatenate(codes), words, counts


def _word_relation(df: DataFrame, lang_col: str, text_col: str, held_bytes: int) -> DataFrame:
    """``(chunk, lang, words, counts, body)``: words of a chunk of texts of one language, ``body`` their codes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Chunk] = {}
        n = 0

        def close(lang: str) -> pa.RecordBatch:
            codes, words, counts = held.pop(lang).close()
            ends = pa.array([0, len(words)], pa.int32())
            return pa.RecordBatch.from_arrays([
                pa.array([new_chunk(n)], pa.int64()), pa.array([lang]), pa.ListArray.from_arrays(ends, words.cast(pa.binary()).cast(pa.string())),
                pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64())), pa.array([packed_numbers(codes)], pa.binary())], names=["chunk", "lang", "words", "counts", "body"])

        for b in batches:
            for lang, text in zip(b.column(0), b.column(1), strict=True):
                lang = lang.as_py()
                held.setdefault(lang, _Chunk()).add(text.as_py())
                if sum(c.size for c in held.values()) >= held_bytes:
                    yield close(max(held, key=lambda x: held[x].size))
                    n += 1
        for lang in list(held):
            yield close(lang)
            n += 1

    slim = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    return slim.mapInArrow(run, "chunk long, lang string, words array<string>, counts array<long>, body binary")


def _frequent(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """``rows(chunk, .., n)`` of groups counted ``least`` times or more over all chunks, with the count ``a`` and the group's number ``gid``.

    A chunk has one row of a group, so a group of any frequency has at most a
    row a chunk. ``gid`` is the place of the group's first row, which the order
    of rows within a group does not touch; ``first`` marks one row a group.
    """
    same = Window.partitionBy(*keys)
    counted = rows.withColumn("a", F.sum("n").over(same)).where(F.col("a") >= least)
    numbered = counted.withColumn("_id", F.monotonically_increasing_id()).withColumn("gid", F.min("_id").over(same))
    return numbered.withColumn("first", F.col("_id") == F.col("gid")).drop("_id", "n")


def _relation(chunk: int, gids: np.ndarray, codes: np.ndarray) -> pa.Table:
    """A chunk of an occurrence relation: at each place the 1-based number in ``gids`` of the group that begins there, or 0."""
    ends = pa.array([0, len(gids)], pa.int32())
    return pa.table({"chunk": pa.array([chunk], pa.int64()), "gids": pa.ListArray.from_arrays(ends, pa.array(gids, pa.int64())), "body": pa.array([packed_numbers(codes)], pa.binary())})


RELATION = "chunk long, gids array<long>, body binary"


def _codes(row: pa.Table) -> tuple[int, np.ndarray]:
    """The number of a chunk and what stands at its places."""
    return row.column("chunk")[0].as_py(), unpacked_numbers(row.column("body")[0].as_buffer())


def _groups(row: pa.Table) -> np.ndarray:
    """The groups of a chunk by their number in it."""
    return row.column("gids")[0].values.to_numpy()


def _frequent_words(words: pa.Table, found: pa.Table) -> pa.Table:
    """The relation of the frequent words: a semi-join of a chunk's words with the frequent ones."""
    chunk, codes = _codes(words)
    code, gids = found.column("code").to_numpy(), found.column("gid").to_numpy()
    place = np.zeros(max(codes.max(initial=0), code.max(initial=0)) + 1, dtype=np.uint32)
    place[code] = np.arange(1, len(code) + 1)
    return _relation(chunk, gids, place[codes])


def _adjacent(codes: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Some places at a time, but the last: the first one, and for each the joint number of two groups that begin there and one place on, or -1."""
    for at in range(0, len(codes) - 1, STEP_PLACES):
        c = codes[at : at + STEP_PLACES + 1].astype(np.int64)
        a, b = c[:-1], c[1:]
        yield at, np.where((a > 0) & (b > 0), (a - 1) * n + b - 1, -1)


def _joined(relation: pa.Table) -> pa.Table:
    """The merge join of a relation with itself at adjacent places, counted: ``(chunk, g1, g2, n)``."""
    (chunk, codes), gids = _codes(relation), _groups(relation)
    each = max(1, len(gids))
    key = np.empty(np.count_nonzero((codes[:-1] > 0) & (codes[1:] > 0)), dtype=np.int64)
    filled = 0
    for _, both in _adjacent(codes, each):
        both = both[both >= 0]
        key[filled : filled + len(both)] = both
        filled += len(both)
    del codes
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    n, key = np.diff(first, append=len(key)), key[first]
    batches = []
    for at in range(0, len(key), SENT_ROWS):
        some = key[at : at + SENT_ROWS]
        batches.append(pa.record_batch({"chunk": pa.array(np.full(len(some), chunk)), "g1": pa.array(gids[some // each]), "g2": pa.array(gids[some % each]), "n": pa.array(n[at : at + SENT_ROWS])}))
    return pa.Table.from_batches(batches, pa.schema([(c, pa.int64()) for c in ("chunk", "g1", "g2", "n")]))


def _longer(relation: pa.Table, found: pa.Table) -> pa.Table:
    """The relation of the frequent groups one word longer: a semi-join of the joined places with them."""
    (chunk, codes), gids = _codes(relation), _groups(relation)
    order = np.argsort(gids)
    own = lambda c: order[np.searchsorted(gids, found.column(c).to_numpy(), sorter=order)]
    key = own("g1") * len(gids) + own("g2")
    by_key = np.argsort(key)
    key, new = key[by_key], found.column("gid").to_numpy()[by_key]
    if not len(key):
        return _relation(chunk, new, np.zeros(0, dtype=np.uint32))
    out = np.zeros(max(0, len(codes) - 1), dtype=np.uint32)
    for first, both in _adjacent(codes, len(gids)):
        at = np.minimum(np.searchsorted(key, both), len(key) - 1)
        out[first : first + len(both)] = np.where(key[at] == both, at + 1, 0)
    del codes
    return _relation(chunk, new, out)


def frequent_phrases(scratch: Scratch, df: DataFrame, lang_col: str, text_col: str, most_words: int, least: int, held_bytes: int = HELD_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(lang, words array, a)`` of all frequent phrases of up to ``most_words`` words, and ``(lang, n)``, all words of a language.

    Each length's occurrence relation is kept in the shared folder, dealt by
    chunk. The next length joins it with itself at adjacent places, counts the
    groups over all chunks and keeps the places of frequent ones only.
    """
    small_batches(df.sparkSession)
    raw = scratch.keep(_word_relation(df, lang_col, text_col, held_bytes), large=True)
    totals = raw.groupBy("lang").agg(F.sum(F.expr("aggregate(counts, 0L, (x, y) -> x + y)")).alias("n"))
    totals = scratch.keep(totals)
    each = raw.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "x")).select("chunk", "lang", (F.col("code") + 1).alias("code"), F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    found = scratch.keep(_frequent(each, ["lang", "word"], least))
    known = scratch.keep(found.where("first").select("gid", "lang", F.array("word").alias("words"), "a"))
    phrases = [known]
    longer = raw.select("chunk", "body").groupBy("chunk").cogroup(found.select("chunk", "code", "gid").groupBy("chunk")).applyInArrow(_frequent_words, RELATION)
    relation, past = dealt(scratch, scratch.keep(longer, large=True), "body"), [raw, found]
    for k in range(2, most_words + 1):
        for gone in past:  # what the next relation was made of
            scratch.drop(gone)
        found = scratch.keep(_frequent(relation.groupBy("chunk").applyInArrow(_joined, "chunk long, g1 long, g2 long, n long"), ["g1", "g2"], least))
        head, tail = known.select(F.col("gid").alias("g1"), "lang", F.col("words").alias("head")), known.select(F.col("gid").alias("g2"), F.element_at("words", -1).alias("tail"))
        known = scratch.keep(found.where("first").select("gid", "g1", "g2", "a").join(head, "g1").join(tail, "g2").select("gid", "lang", F.array_append("head", F.col("tail")).alias("words"), "a"))
        phrases.append(known)
        past = [relation, found]
        if k < most_words:
            longer = relation.groupBy("chunk").cogroup(found.select("chunk", "g1", "g2", "gid").groupBy("chunk")).applyInArrow(_longer, RELATION)
            relation = dealt(scratch, scratch.keep(longer, large=True), "body")
    for gone in past:
        scratch.drop(gone)
    out = phrases[0]
    for more in phrases[1:]:
        out = out.union(more)
    return out.select("lang", "words", "a"), totals


def collocations(
    df: DataFrame, lang_col: str = "lang", text_col: str = "text", most_words: int = 4, least: int = 30, keep: int = 2000, covered: int = 80, held_bytes: int = HELD_BYTES,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``keep`` best phrases of two to ``most_words`` words.

    A-Z are lower-cased, texts split at ``.,;:!?`` and line breaks into pieces,
    those at spaces and tabs into words. ``a`` counts a phrase's occurrences
    within pieces, ``n`` all words of the language. A phrase counted ``least``
    times or more is cut after each of its first words into parts counted ``l``
    and ``r``; the cut of least ``2000000 a / (l + r)``, floored, gives its
    score, the first one of equal ones. Phrases inside a longer one with
    ``covered`` per cent of their count or more are left out. Order: score and
    ``a`` downwards, then the phrase's bytes.

    Null languages are ``und``, null texts empty; repeated rows count each
    time; a language without candidates has no row; an empty table gives an
    empty result; extra columns are ignored.
    """
    scratch = Scratch(df.sparkSession, "phrases")
    found, totals = frequent_phrases(scratch, df, lang_col, text_col, most_words, least, held_bytes)
    spelt = scratch.keep(found.select("lang", "words", F.array_join("words", " ").alias("phrase"), F.size("words").alias("k"), "a"))
    known = spelt.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    part = lambda x, name, f: x.select("lang", F.col("part").alias(name), F.col("f").alias(f))
    candidates = spelt.where("k > 1")
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"), "words", "k").select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("head"), F.array_join(F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("rest"))
    scored = cuts.join(part(known, "head", "l"), ["lang", "head"]).join(part(known, "rest", "r"), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    scored = scored.withColumn("_up", wide("a") * F.lit(2000000).cast("decimal(7,0)")).withColumn("_down", wide("l") + wide("r")).withColumn("score", F.expr("_up div _down"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("_b")).select("lang", "phrase", "a", "_b.l", "_b.r", "_b.score")
    inner = candidates.where("k > 2").select("lang", "words", "k", F.col("a").alias("f"), F.explode(F.expr("sequence(2, k - 1)")).alias("m")).select(
        "lang", "words", "f", "m", F.explode(F.expr("sequence(1, k - m + 1)")).alias("s")).select("lang", "f", F.array_join(F.expr("slice(words, s, m)"), " ").alias("phrase"))
    inside = inner.groupBy("lang", "phrase").agg(F.max("f").alias("_f"))
    left = best.join(inside, ["lang", "phrase"], "left").where((F.col("_f").isNull()) | (F.lit(100).cast("decimal(3,0)") * wide("_f") < F.lit(covered).cast("decimal(3,0)") * wide("a"))).drop("_f")
    left = scratch.keep(left)
    buckets = max(1, -(-left.count() // RANKED))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = left.withColumn("_b", F.pmod(F.xxhash64("phrase"), F.lit(buckets)))
    few = some.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_b").orderBy(*order))).where(F.col("_r") <= keep)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= keep)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
