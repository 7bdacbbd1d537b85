"""Gapless row numbers, decided by the rows' values alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a numbering bucket aimed at, and most buckets of a group; beyond both, buckets grow.
BUCKET_ROWS, MOST_BUCKETS = 250, 1 << 16
#: Equal rows that are numbered together; a row that is repeated more often is dealt into pieces.
REPEATS = 1024


def number_rows(df: DataFrame, name: str, buckets: Column | int, within: str | None = None, repeats: int = REPEATS) -> DataFrame:
    """``df`` with long column ``name``: 0 .. n-1, in each value of ``within`` if it is named.

    Equal rows are counted first and given back by the end, so no number of
    repeats meets in one task; pieces of ``repeats`` equal rows go to
    ``buckets`` by a hash of all columns, a bucket's numbers begin after the
    rows of the buckets before it (a table of one row a bucket), and a window
    over the bucket gives the places in it. Only the rows' values decide, not
    their order or partitions. Nulls are values like others; columns must be
    of types that can be grouped and ordered.
    """
    cols = df.columns
    group = [within] if within else []
    quoted = [F.col(f"`{c}`") for c in cols]
    counted = df.groupBy(*quoted).agg(F.count(F.lit(1)).alias("_n"))
    pieces = counted.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {repeats}"))))
    pieces = pieces.select(*quoted, "_piece", F.least(F.lit(repeats), F.col("_n") - F.col("_piece") * repeats).alias("_m"))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*quoted, "_piece"), F.lit(buckets) if isinstance(buckets, int) else buckets).cast("int"))
    sizes = dealt.groupBy(*group, "_bucket").agg(F.sum("_m").alias("_rows"))
    so_far = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, "_bucket", F.coalesce(F.sum("_rows").over(so_far), F.lit(0)).alias("_offset"))
    here = Window.partitionBy(*group, "_bucket").orderBy(*quoted, "_piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_place", F.coalesce(F.sum("_m").over(here), F.lit(0)))
    same = [placed[c].eqNullSafe(offsets[c]) for c in group]
    first = placed.join(offsets, [*same, placed["_bucket"] == offsets["_bucket"]]).select(*[placed[f"`{c}`"] for c in cols], (F.col("_offset") + F.col("_place")).alias("_first"), "_m")
    return first.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1))).select(*quoted, (F.col("_first") + F.col("_k")).alias(name))


def bucket_count(n: int, rows: int = BUCKET_ROWS, most: int = MOST_BUCKETS) -> int:
    """Buckets of about ``rows`` of ``n`` rows, ``most`` of them at most."""
    return max(1, min(-(-n // rows), most))


def utf8_bytes(text: Column) -> Column:
    """Bytes of the text in UTF-8, zero for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def utf8_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the text's UTF-8 bytes, that of no bytes (0) for null."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
