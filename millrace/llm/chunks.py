"""Texts in chunks that tasks treat as arrays: words by number, and tables of chunks that keys can be sent back to."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, small_batches

#: Bytes of text after which a chunk is closed; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Bytes of a table of chunks that one task reads, and most parts of such a table.
PART_BYTES, MOST_PARTS = 16 << 20, 100_000
#: Space, tab and the four line breaks of ASCII.
WHITE = b" \t\n\v\f\r"


def byte_set(chars: bytes) -> np.ndarray:
    """A table of 256 truths, true at ``chars``."""
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


def places_of(n: int) -> type:
    """The narrower kind of whole numbers that holds places up to ``n``."""
    return np.int32 if n < 1 << 31 else np.int64


@dataclass
class Words:
    """Words of several texts, in order; ``text`` is the number of a word's text, ``code`` its place in ``known``."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    code: np.ndarray
    known: pa.Array

    def first_and_end(self, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """For each word the numbers of its text's first word and of the word after its last."""
        of = np.searchsorted(self.text, np.arange(texts + 1, dtype=self.text.dtype)).astype(self.text.dtype)
        return of[:-1][self.text], of[1:][self.text]


def words_of(texts: list[bytes], gap: np.ndarray, fold: np.ndarray | None = None) -> Words:
    """Runs of bytes outside ``gap``; ``fold`` maps the bytes first. A line break is a gap and parts the texts."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    raw = raw if fold is None else fold[raw]
    blank = gap[raw]
    kind = places_of(len(raw))
    edge = np.diff(blank.view(np.int8), prepend=np.int8(1))
    start, end = np.flatnonzero(edge == -1).astype(kind), np.flatnonzero(edge == 1).astype(kind)
    del edge
    bounds = np.cumsum([len(t) + 1 for t in texts]).astype(kind)
    offsets = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(end - start, out=offsets[1:])
    spelt = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[~blank])]).dictionary_encode()
    return Words(raw, start, end, np.searchsorted(bounds, start, side="right").astype(kind), spelt.indices.to_numpy(), spelt.dictionary)


def packed(texts: list[bytes]) -> tuple[bytes, bytes]:
    """The texts' lengths and the texts, compressed."""
    lengths = np.array([len(t) for t in texts], dtype="<i8").tobytes()
    return lengths, _squeezed(b"".join(texts))


def unpacked(lengths: bytes, body: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(lengths, dtype="<i8"))
    whole = _restored(body)
    return [whole[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(ends) else []


def _squeezed(raw: bytes | pa.Buffer) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _restored(body: bytes | pa.Buffer) -> bytes:
    size = int.from_bytes(body[:8], "little")
    return pa.decompress(body[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def packed_numbers(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, compressed byte by byte of equal weight."""
    return _squeezed(pa.py_buffer(np.ascontiguousarray(values.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T)))


def unpacked_numbers(body: bytes | pa.Buffer) -> np.ndarray:
    planes = np.frombuffer(_restored(body), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def new_chunk(n: int) -> int:
    """A number that no other chunk of the running job has."""
    return (TaskContext.get().partitionId() << 32) + n


def text_chunks(scratch: Scratch, df: DataFrame, id_col: str, text_col: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """``(chunk, ids array, lengths, body)``: the rows of each task in chunks of about ``limit`` bytes of text.

    Null texts are empty ones. The first table is written where its tasks made
    it, so a chunk is what one committed task wrote, whatever is recomputed
    later; the second is dealt by chunk, so that no text moves again.
    """
    small_batches(df.sparkSession)
    slim = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = slim.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        texts: list[bytes] = []
        n = held = 0

        def close() -> pa.RecordBatch:
            listed = pa.concat_arrays(ids)
            row = [pa.array([new_chunk(n)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed), *(pa.array([x], pa.binary()) for x in packed(texts))]
            return pa.RecordBatch.from_arrays(row, names=["chunk", "ids", "lengths", "body"])

        for b in batches:
            at = 0
            for k, t in enumerate(b.column(1).to_pylist()):
                texts.append(t)
                held += len(t)
                if held >= limit:
                    ids.append(b.column(0).slice(at, k + 1 - at))
                    yield close()
                    ids, texts, held, at, n = [], [], 0, k + 1, n + 1
            if at < b.num_rows:
                ids.append(b.column(0).slice(at))
        if texts:
            yield close()

    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("lengths", T.BinaryType()), T.StructField("body", T.BinaryType())])
    return dealt(scratch, scratch.keep(slim.mapInArrow(run, schema), large=True), "body")


def dealt(scratch: Scratch, chunks: DataFrame, weight: str) -> DataFrame:
    """The kept table ``chunks``, bucketed by chunk; ``weight`` is its large column. The first copy goes."""
    total = chunks.agg(F.sum(F.octet_length(weight))).first()[0] or 0
    out = scratch.keep_by(chunks, "chunk", max(1, min(-(-total // PART_BYTES), MOST_PARTS)))
    scratch.drop(chunks)
    return out


def shared_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """``(chunk, *keys, lead)`` of ``rows(chunk, *keys, many)``: keys in two chunks, or ``many`` times in one.

    A chunk gives a key once, so a key of any frequency has at most one row a
    chunk and a partition no more rows than its share. ``lead`` marks the
    key's least chunk.
    """
    same = Window.partitionBy(*keys)
    counted = rows.withColumns({"_n": F.count(F.lit(1)).over(same), "_many": F.max("many").over(same), "lead": F.col("chunk") == F.min("chunk").over(same)})
    return counted.where("_n > 1 or _many").select("chunk", *keys, "lead")
