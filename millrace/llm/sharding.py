"""Reproducible shuffle into shards by a Feistel permutation of global row numbers."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import bucket_count, number_rows, utf8_bytes, utf8_crc32

ROUNDS = 6
#: Sides tried for the domain; the best of them leaves few values to walk over.
SIDES = 512


def domain(n: int) -> tuple[int, int]:
    """Sides (a, b) near the square root with a * b >= n and the least excess among ``SIDES`` choices."""
    root = max(1, isqrt(max(n, 1)))
    return min(((a, -(-n // a)) for a in range(max(1, root - SIDES // 2), root + SIDES // 2 + 1)), key=lambda s: (s[0] * s[1] - n, abs(s[0] - s[1]))) if n else (1, 1)


def _feistel(df: DataFrame, x: str, a: int, b: int, seed: int, only: Column | None = None) -> DataFrame:
    """One pass of the permutation of 0 .. a*b-1 over column ``x``; rows outside ``only`` keep theirs.

    x = left * b + right; the rounds add a keyed hash of one half to the other,
    modulo that half's side, so each round and the whole can be inverted.
    """
    df = df.withColumns({"_l": F.floor(F.col(x) / F.lit(b)).cast("long") if b == 1 else F.expr(f"`{x}` div {b}"), "_r": F.pmod(F.col(x), F.lit(b))})
    for k in range(ROUNDS):
        side, half, other = (a, "_l", "_r") if k % 2 == 0 else (b, "_r", "_l")
        df = df.withColumn(half, F.pmod(F.col(half) + F.pmod(F.xxhash64(F.col(other), F.lit(seed), F.lit(k)), F.lit(side)), F.lit(side)))
    out = F.col("_l") * F.lit(b) + F.col("_r")
    return df.withColumn(x, out if only is None else F.when(only, out).otherwise(F.col(x))).drop("_l", "_r")


def permute(df: DataFrame, number: str, n: int, name: str, seed: int = 7) -> DataFrame:
    """``df`` with ``name``: a permutation of 0 .. n-1 applied to column ``number``.

    The Feistel domain a * b may exceed n by a few values; a row that lands on
    one walks on along its cycle until it is below n. A cycle has no more such
    values than there are, so a * b - n further passes end every walk.
    """
    a, b = domain(n)
    out = _feistel(df.withColumn(name, F.col(number)), name, a, b, seed)
    for _ in range(a * b - n):
        out = _feistel(out, name, a, b, seed, F.col(name) >= F.lit(n))
    return out


def shards(df: DataFrame, count: int = 16, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """``(id, size, text_crc32, law, shard, slot)`` of every row; law ``rows``.

    The row's global number, decided by id, size and CRC alone, is permuted;
    the permuted number p gives shard p mod ``count`` and slot p div ``count``,
    so shards differ by one row at most, slots have no gaps, and both can be
    computed for any row number. Null ids and texts are values like others
    (size 1, CRC 0 for null texts), repeated rows each get a slot, an empty
    table gives an empty result; extra columns are ignored.
    """
    text = F.col(f"`{text_col}`").cast("string")
    slim = df.select(F.col(f"`{id_col}`").alias("id"), (utf8_bytes(text) + 1).alias("size"), utf8_crc32(text).alias("text_crc32"))
    n = df.count()
    placed = permute(number_rows(slim, "_number", bucket_count(n)), "_number", n, "_p", seed)
    return placed.select("id", "size", "text_crc32", F.lit("rows").alias("law"), F.pmod("_p", F.lit(count)).cast("int").alias("shard"), F.expr(f"_p div {count}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
