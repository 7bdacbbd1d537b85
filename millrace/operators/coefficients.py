"""Rank coefficients of one column with many, date by date, from wide rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a date that make a stretch of its values worth a task, stretches of a date at most, and rows drawn for each end of a stretch.
LEAST_ROWS, STRETCHES, DRAWN = 16384, 64, 64
#: Parts that the rows of one very frequent value are dealt into.
PARTS = 64

_SUMS = ["n", "xy", "xx", "yy"]


def _ordered(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles: -0 is 0, all NaN are one and the greatest, as Spark orders them."""
    x = np.where(np.isnan(x), np.nan, x) + 0.0
    bits = x.view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def _filled(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ordered integers of doubles, and which are there."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    return _ordered(column.fill_null(0.0).to_numpy(zero_copy_only=False)), there


#: For each value the places and weights of the columns whose sum it is.
Sums = Sequence[Sequence[tuple[int, float]]]


def _matrix(column: pa.Array | pa.ChunkedArray, width: int, sums: Sums | None) -> tuple[np.ndarray, np.ndarray]:
    """``(row, value)``: ordered integers, and which are there."""
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    there = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, width)
    x = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, width)
    if sums is not None:
        x, parts, all_there = np.zeros((len(x), len(sums))), np.ascontiguousarray(x.T), np.ascontiguousarray(there.T)
        there = np.ones(x.shape, bool)
        for k, terms in enumerate(sums):
            for i, w in terms:
                x[:, k] += parts[i] * w
                there[:, k] &= all_there[i]
    return _ordered(x), there


def _by_date(column: pa.Array) -> Iterator[tuple[object, np.ndarray]]:
    """Each date of a batch with the places of its rows."""
    codes = column.dictionary_encode(null_encoding="encode")
    code = codes.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(code[order])) + 1, len(order))
    names = codes.dictionary.to_pylist()
    for a, e in zip([0, *ends[:-1]], ends, strict=True):
        if e > a:
            yield names[code[order[a]]], order[a:e]


def _ends(drawn: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of stretches of about equal rows, and which of them are values that fill a stretch."""
    drawn = np.sort(drawn)
    k = min(STRETCHES - 1, n // LEAST_ROWS)
    picked = drawn[np.arange(1, k + 1) * len(drawn) // (k + 1)] if len(drawn) else drawn
    ends, times = np.unique(picked, return_counts=True)
    return ends, times > 1


def _stretch(ends: tuple[np.ndarray, np.ndarray], key: np.ndarray) -> np.ndarray:
    """Even: between two ends, the upper one included; odd: a frequent value, alone."""
    values, frequent = ends
    at = np.searchsorted(values, key)
    if not len(values):
        return at
    low = np.minimum(at, len(values) - 1)
    return 2 * at + ((values[low] == key) & frequent[low])


def _dot(a: np.ndarray, b: np.ndarray) -> int:
    """The exact sum of products of integers under 2 ** 31."""
    if not len(a):
        return 0
    if int(np.abs(a).max()) * int(np.abs(b).max()) * len(a) < 1 << 62:
        return int(np.dot(a, b))
    return sum((int(np.dot(x >> 20, y)) << 20) + int(np.dot(x & 0xFFFFF, y)) for x, y in ((a[i : i + 4096], b[i : i + 4096]) for i in range(0, len(a), 4096)))


def _places(sorted_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and end of each value's run, for each place of a sorted array."""
    new = np.append(True, sorted_key[1:] != sorted_key[:-1])
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    return first[run], np.append(first[1:], len(sorted_key))[run]


def rank_coefficients(rows: DataFrame, shared: str, values: Sequence[Column], by: str = "date", sums: Sums | None = None) -> DataFrame:
    """``(by, i int, ic, n)``: the rank correlation of column ``shared`` with each of ``values`` over their complete pairs; null where a side does not vary.

    ``rows`` is read four times, so it should be written; ``values`` are
    computed from its columns where they are needed and never written. With
    ``sums`` the sides are weighted sums of ``values``, null where one of a sum's is. Nulls of ``by`` are a group.

    The rows of a date are dealt into stretches of ``shared`` and ranked there
    for all ``values`` at once; each value then goes with that rank, eight and four
    bytes, to its own stretch. Counts of all stretches give the ranks
    before them. The ends of stretches come from drawn rows and only deal the
    work; a value that fills a stretch has its rank from the counts, so its
    rows need not meet. Ranks are whole numbers, doubled and centred, and
    summed exactly: equal orders have equal coefficients.

    Dates of up to ``LEAST_ROWS`` rows are one stretch. The driver holds the
    ends and counts of the other ones, some 50 bytes for each ``LEAST_ROWS`` values.
    """
    columns, width = len(values), len(values if sums is None else sums)
    rows = rows.where(F.col(shared).isNotNull())
    kind = rows.schema[by].dataType
    wide = lambda df, *more: df.select(by, F.col(shared).cast("double").alias("_s"), F.array(*[v.cast("double") for v in values]).alias("_v"), *more)
    sizes = {r[0]: r[1] for r in rows.groupBy(by).count().where(F.col("count") > LEAST_ROWS).collect()}
    ends: dict = {}
    counts: dict = {}
    if sizes:
        shares = [(d, DRAWN * min(STRETCHES, 1 + n // LEAST_ROWS) / n) for d, n in sizes.items()]
        known = rows.sparkSession.createDataFrame(shares, T.StructType([T.StructField("_d", kind), T.StructField("_share", T.DoubleType())]))
        large = rows.join(F.broadcast(known), F.col(by).eqNullSafe(F.col("_d")))  # one row a date
        ends = _all_ends(wide(large.where(F.rand() < F.col("_share"))), by, kind, columns, sums, sizes)
        counts = _all_counts(wide(large), by, kind, columns, sums, ends)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, part = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int32)
            key = _filled(b.column(b.schema.get_field_index("_s")))[0]
            for date, at in _by_date(b.column(b.schema.get_field_index(by))):
                if date in ends:
                    code[at] = _stretch(ends[date][0], key[at])
            alone = np.flatnonzero(code % 2)
            part[alone] = alone % PARTS
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code), pa.array(part)], names=[*b.schema.names, "_code", "_part"])

    if sizes:
        keyed = rows.withColumn("_s", F.col(shared).cast("double"))
        dealt = keyed.mapInArrow(deal, T.StructType([*keyed.schema.fields, T.StructField("_code", T.IntegerType()), T.StructField("_part", T.IntegerType())])).drop("_s")
    else:
        dealt = rows.withColumns({"_code": F.lit(0), "_part": F.lit(0)})

    fields = [("_keys", pa.binary()), ("_ranks", pa.binary()), *[(c, pa.decimal128(38, 0)) for c in _SUMS]]

    def rank(group: pa.Table) -> pa.Table:
        date, code = group.column(by)[0].as_py(), group.column("_code")[0].as_py()
        s, _ = _filled(pa.concat_arrays(group.column("_s").chunks))
        v, there = _matrix(group.column("_v"), columns, sums)
        order = np.argsort(s, kind="stable")
        s, v, there = s[order], v[order], there[order]
        before = np.zeros((len(s) + 1, width), np.int64)
        np.cumsum(there, axis=0, out=before[1:])
        first, last = _places(s)
        if date in counts:
            here, there_n = counts[date]
            offset, n = here[:code].sum(axis=0), here.sum(axis=0)
        else:
            offset, n = np.zeros(width, np.int64), before[-1]
        if code % 2:
            x = np.broadcast_to(2 * offset + here[code] - n, v.shape)
        else:
            x = 2 * offset + before[first] + before[last] - n
        out: list[tuple] = []
        for k in range(width):
            pick = there[:, k]
            key, c = v[pick, k], x[pick, k]
            if not len(key):
                continue
            order = np.argsort(key, kind="stable")
            key, c = key[order], c[order]
            if date not in counts:
                a, e = _places(key)
                y = a + e - n[k]
                out.append((k, -1, b"", b"", len(key), _dot(c, y), _dot(c, c), _dot(y, y)))
                continue
            codes = _stretch(ends[date][1][k], key)
            cuts = np.append(np.flatnonzero(np.append(True, codes[1:] != codes[:-1])), len(codes))
            small = c.astype(np.int32)  # a date has under 2 ** 31 rows
            for a, e in zip(cuts[:-1], cuts[1:], strict=True):
                m = int(codes[a])
                if m % 2:
                    y = int(2 * there_n[k, :m].sum() + there_n[k, m] - n[k])
                    out.append((k, -1, b"", b"", int(e - a), int(c[a:e].sum()) * y, _dot(c[a:e], c[a:e]), int(e - a) * y * y))
                else:
                    out.append((k, m, key[a:e].tobytes(), small[a:e].tobytes(), 0, 0, 0, 0))
        names = pa.array([date] * len(out), group.schema.field(by).type)
        sides = list(zip(*out, strict=True)) or [()] * 8
        return pa.Table.from_arrays([names, pa.array(sides[0], pa.int32()), pa.array(sides[1], pa.int32()), *[
            pa.array(x if t == pa.binary() else [Decimal(i) for i in x], t) for x, (_, t) in zip(sides[2:], fields, strict=True)]], names=[by, "i", "_code", *[f for f, _ in fields]])

    def meet(group: pa.Table) -> pa.Table:
        date, k, code = (group.column(c)[0].as_py() for c in (by, "i", "_code"))
        if code < 0:
            sums = [sum(int(x) for x in group.column(c).to_pylist()) for c in _SUMS]
        else:
            key = np.frombuffer(b"".join(group.column("_keys").to_pylist()), np.int64)
            c = np.frombuffer(b"".join(group.column("_ranks").to_pylist()), np.int32).astype(np.int64)
            order = np.argsort(key)
            a, e = _places(key[order])
            all_n = counts[date][1][k]
            y, c = int(2 * all_n[:code].sum() - all_n.sum()) + a + e, c[order]
            sums = [len(c), _dot(c, y), _dot(c, c), _dot(y, y)]
        return pa.Table.from_arrays([group.column(by).slice(0, 1), pa.array([k], pa.int32()), *[pa.array([Decimal(x)], pa.decimal128(38, 0)) for x in sums]], names=[by, "i", *_SUMS])

    whole = [T.StructField(c, T.DecimalType(38, 0)) for c in _SUMS]
    head = [T.StructField(by, kind), T.StructField("i", T.IntegerType())]
    blobs = T.StructType([*head, T.StructField("_code", T.IntegerType()), T.StructField("_keys", T.BinaryType()), T.StructField("_ranks", T.BinaryType()), *whole])
    ranked = wide(dealt.repartition(by, "_code", "_part"), "_code", "_part").groupBy(by, "_code", "_part").applyInArrow(lambda g: rank(g), blobs)
    parts = ranked.groupBy(by, "i", "_code").applyInArrow(lambda g: meet(g), T.StructType([*head, *whole]))
    total = parts.groupBy(by, "i").agg(*[F.sum(c).cast("double").alias(c) for c in _SUMS])
    return total.select(by, "i", F.try_divide("xy", F.sqrt("xx") * F.sqrt("yy")).alias("ic"), F.col("n").cast("long").alias("n"))


def _all_ends(drawn: DataFrame, by: str, kind: T.DataType, columns: int, sums: Sums | None, sizes: dict) -> dict:
    """For each date the ends of the stretches of the shared column and of each value, from drawn rows."""

    width = columns if sums is None else len(sums)

    def end(group: pa.Table) -> pa.Table:
        date = group.column(0)[0].as_py()
        s = _filled(pa.concat_arrays(group.column(1).chunks))[0]
        v, there = _matrix(group.column(2), columns, sums)
        found = [_ends(s, sizes[date]), *[_ends(v[there[:, k], k], sizes[date]) for k in range(width)]]
        return pa.Table.from_arrays([group.column(0).slice(0, 1), pa.array([[x.tolist() for x, _ in found]], pa.list_(pa.list_(pa.int64()))), pa.array([[x.tolist() for _, x in found]], pa.list_(pa.list_(pa.bool_())))], names=[by, "ends", "frequent"])

    out = T.StructType([T.StructField(by, kind), T.StructField("ends", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("frequent", T.ArrayType(T.ArrayType(T.BooleanType())))])
    got = {r[0]: [(np.array(e, np.int64), np.array(f, bool)) for e, f in zip(r[1], r[2], strict=True)] for r in drawn.groupBy(by).applyInArrow(lambda g: end(g), out).collect()}
    none = (np.empty(0, np.int64), np.empty(0, bool))
    return {d: (e[0], e[1:]) for d, e in ((d, got.get(d, [none] * (width + 1))) for d in sizes)}


def _all_counts(wide: DataFrame, by: str, kind: T.DataType, columns: int, sums: Sums | None, ends: dict) -> dict:
    """For each date the pairs of each value in each stretch of the shared column (stretch, value) and of its own (value, stretch)."""
    most, width = 2 * STRETCHES, columns if sums is None else len(sums)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kind_ = None
        for b in batches:
            kind_ = b.schema.field(0).type
            s = _filled(b.column(1))[0]
            v, there = _matrix(b.column(2), columns, sums)
            for date, at in _by_date(b.column(0)):
                here, own = held.setdefault(date, (np.zeros((most, width), np.int64), np.zeros((width, most), np.int64)))
                code = _stretch(ends[date][0], s[at])
                order = np.argsort(code, kind="stable")
                cuts = np.flatnonzero(np.append(True, np.diff(code[order]) != 0))
                here[code[order][cuts]] += np.add.reduceat(there[at][order].astype(np.int64), cuts, axis=0)
                for k in range(width):
                    own[k] += np.bincount(_stretch(ends[date][1][k], v[at, k][there[at, k]]), minlength=most)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), kind_), pa.array([np.concatenate([h.ravel(), o.ravel()]).tobytes() for h, o in held.values()], pa.binary())], names=[by, "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.int64) for x in group.column(1).to_pylist()], axis=0)
        return pa.Table.from_arrays([group.column(0).slice(0, 1), pa.array([total.astype(np.int64).tobytes()], pa.binary())], names=[by, "counts"])

    out = T.StructType([T.StructField(by, kind), T.StructField("counts", T.BinaryType())])
    got = {r[0]: np.frombuffer(r[1], np.int64) for r in wide.mapInArrow(count, out).groupBy(by).applyInArrow(lambda g: add(g), out).collect()}
    return {d: (x[: most * width].reshape(most, width), x[most * width :].reshape(width, most)) for d, x in got.items()}
