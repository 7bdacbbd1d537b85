"""Byte-level BPE encoding and decoding by a contiguous rank array."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches

#: Words of more bytes are merged through a heap of adjacent ranks, which gives
#: the same parts in O(n log n); the array's repeated scans are quadratic.
ARRAY_BYTES = 128
#: Words a worker remembers; past it all are forgotten, so memory is bounded.
REMEMBERED = 1 << 18
NO_RANK = 1 << 62


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others for the code
    points from 256 on, in order.
    """
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBPE:
    """Encoder and decoder of one vocabulary file of the tokenizers library.

    ``pattern`` splits texts into words as the file's byte-level pre-tokenizer
    does; texts with unassigned code points go to the library's own splitter
    (see ``_unassigned``).
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, pre = file["model"], file["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or file["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE")
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.ids = {raw(t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.ranks: dict[bytes, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(raw(a) + raw(b), rank)
        self.special = {x["content"]: x["id"] for x in file.get("added_tokens", [])}
        for x in file.get("added_tokens", []):
            self.ids.pop(x["content"].encode(), None)
            if x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]:
                raise ValueError(f"{path}: added token {x['content']} strips or is a single word")
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.digits_of = {i: str(i) for i in self.bytes_of}
        self.path = path
        self.words = regex.compile(pattern)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.seen: dict[str, tuple[int, ...]] = {}
        self.spelt: dict[str, tuple[int, str, bytes]] = {}
        self.unassigned = _unassigned()
        self._library = None

    # -- merging one word ---------------------------------------------------------------------

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word's parts."""
        bounds = self._by_array(word) if len(word) <= ARRAY_BYTES else self._by_heap(word)
        return tuple(self.ids[word[a:b]] for a, b in zip(bounds, bounds[1:], strict=False))

    def _by_array(self, word: bytes) -> list[int]:
        """Part boundaries; ``near[i]`` is the rank of joining parts i and i + 1."""
        rank = self.ranks.get
        bounds = list(range(len(word) + 1))
        near = [rank(word[i : i + 2], NO_RANK) for i in range(len(word) - 1)]
        while near and (least := min(near)) != NO_RANK:
            i = near.index(least)
            del bounds[i + 1], near[i]
            if i < len(near):
                near[i] = rank(word[bounds[i] : bounds[i + 2]], NO_RANK)
            if i:
                near[i - 1] = rank(word[bounds[i - 1] : bounds[i + 1]], NO_RANK)
        return bounds

    def _by_heap(self, word: bytes) -> list[int]:
        rank, n = self.ranks.get, len(word)
        end = list(range(1, n + 1))  # of the part that starts at i; 0: no part starts there
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue  # one of the two parts has changed
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := rank(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (b := before[i]) >= 0 and (r := rank(word[b:stop])) is not None:
                heapq.heappush(heap, (r, b, stop))
        bounds, i = [0], 0
        while i < n:
            i = end[i]
            bounds.append(i)
        return bounds

    # -- whole texts --------------------------------------------------------------------------

    def split(self, text: str) -> Iterable[str]:
        if BEYOND_FIRST_BLOCKS.search(text) is None or self.unassigned.search(text) is None:
            return self.words.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        seen, put = self.seen, out.extend
        for k, part in enumerate(self.cut.split(text) if self.cut and self.cut.search(text) else [text]):
            if k % 2:
                out.append(self.special[part])
                continue
            for w in self.split(part):
                ids = seen.get(w)
                if ids is None:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    ids = self.merge(w.encode("utf-8"))
                    if len(w) <= ARRAY_BYTES:
                        seen[w] = ids
                put(ids)
        return out

    def parts(self, text: str | None) -> list[tuple[int, str, bytes]]:
        """What ``encode`` gives, word by word: number of ids, the ids in decimal joined by commas, the bytes they decode to."""
        out: list[tuple[int, str, bytes]] = []
        if not text:
            return out
        known, get = self.spelt, self.spelt.get
        for k, part in enumerate(self.cut.split(text) if self.cut and self.cut.search(text) else [text]):
            if k % 2:
                out.append(self._spelt((self.special[part],)))
                continue
            words = self.split(part)
            found = list(map(get, words))
            if None in found:
                for i in [i for i, x in enumerate(found) if x is None]:
                    one = get(w := words[i])
                    if one is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        one = self._spelt(self.merge(w.encode("utf-8")))
                        if len(w) <= ARRAY_BYTES:
                            known[w] = one
                    found[i] = one
            out += found
        return out

    def _spelt(self, ids: tuple[int, ...]) -> tuple[int, str, bytes]:
        return len(ids), ",".join([self.digits_of[i] for i in ids]), b"".join([self.bytes_of[i] for i in ids])

    def decode(self, ids: Iterable[int]) -> str:
        """The ids' bytes in a row, read as UTF-8 with a replacement mark where they are none."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _unassigned() -> re.Pattern[str]:
    """Code points that this Python's Unicode tables leave unassigned.

    Later Unicode versions make some of them letters or digits, and the
    ``regex`` module's version need not be the library's; all other code points
    split alike in both (tests/llm/test_operators.py goes through them).
    """
    spans: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c)) == "Cn":
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]")


#: Finds texts that may need the detailed search: the first unassigned code point is U+0378.
BEYOND_FIRST_BLOCKS = re.compile("[^\x00-\u0377]")

_loaded: dict[tuple[str, str], ByteBPE] = {}


def encoder(path: str, pattern: str) -> ByteBPE:
    """One encoder a process and vocabulary."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE(path, pattern)
    return _loaded[path, pattern]


def encode_column(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` of every whole text; null texts have no ids."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for b in batches:
            ids = [bpe.encode(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, T.StructType([T.StructField("id", slim.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode_column(df: DataFrame, path: str, pattern: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``(id, text)`` from arrays of ids; null arrays give the empty text."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x.as_py() or ()) for x in b.column(1)], pa.string())], names=["id", "text"])

    slim = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return slim.mapInArrow(run, T.StructType([T.StructField("id", slim.schema["id"].dataType), T.StructField("text", T.StringType())]))


def round_trip_digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: encode, then decode the ids, in one pass.

    A word's ids are spelt and decoded once a worker, not at each occurrence.

    Null and empty texts have no ids, so both digests are those of the empty
    string. Repeated rows each give a row; extra columns are ignored.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        sha = hashlib.sha256
        for b in batches:
            n, of_ids, of_text = [], [], []
            for t in b.column(1):
                parts = bpe.parts(t.as_py())
                n.append(sum([k for k, _, _ in parts]))
                of_ids.append(sha(",".join([d for _, d, _ in parts]).encode()).hexdigest())
                of_text.append(sha(b"".join([x for _, _, x in parts]).decode("utf-8", "replace").encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, T.StructType([
        T.StructField("id", slim.schema["id"].dataType), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))
