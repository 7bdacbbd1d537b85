"""Rolling order statistics of a stock: one pass over its rows with a sorted window."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a stock that one call of a task goes over, besides those that lead in.
BLOCK_ROWS = 8192


def tail_of(values: list[float | None], n: int, least: int, share: float) -> Iterator[tuple[float | None, float | None]]:
    """For each place the ``share`` quantile of the last ``n`` values and the mean of those at most that; nulls are no values.

    The window is kept sorted: a value is inserted, the one that leaves is
    removed, and both results come from the low end.
    """
    low_first: list[float] = []
    for i, v in enumerate(values):
        if i >= n and (gone := values[i - n]) is not None:
            del low_first[bisect_left(low_first, gone)]
        if v is not None:
            insort(low_first, v)
        m = len(low_first)
        if m < least or not m:
            yield None, None
            continue
        at = (m - 1) * share
        low = int(at)
        cut = low_first[low]
        if at > low and low_first[low + 1] != cut:
            cut = (low + 1 - at) * cut + (at - low) * low_first[low + 1]
        end = low + 1
        while end < m and low_first[end] <= cut:
            end += 1
        total = 0.0
        for x in low_first[:end]:
            total += x
        yield cut, total / end


def peaks_of(values: list[float | None], n: int, least: int) -> Iterator[float | None]:
    """For each place the greatest of the last ``n`` values, null under ``least`` of them; no value is looked at more than twice."""
    falling: deque[tuple[int, float]] = deque()
    known = 0
    for i, v in enumerate(values):
        known += (v is not None) - (i >= n and values[i - n] is not None)
        if falling and falling[0][0] <= i - n:
            falling.popleft()
        if v is not None:
            while falling and falling[-1][1] <= v:
                falling.pop()
            falling.append((i, v))
        yield falling[0][1] if known >= least and falling else None


def ulcers_of(closes: list[float | None], n: int, least: int) -> Iterator[float | None]:
    """Root of the mean squared fall from the peak over the last ``n`` values, null under ``least`` falls."""
    squares: list[float | None] = []
    for close, peak in zip(closes, peaks_of(closes, n, least), strict=True):
        fall = (close - peak) / peak if close is not None and peak else None
        squares.append(None if fall is None else fall * fall)
    x = np.array([np.nan if s is None else s for s in squares])
    frames = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n - 1, np.nan), x]), n) if len(x) else np.zeros((0, n))
    counts = (~np.isnan(frames)).sum(axis=1)
    sums = np.nansum(frames, axis=1)
    for c, s in zip(counts.tolist(), sums.tolist(), strict=True):
        yield float(np.sqrt(s / c)) if c >= least else None


def by_blocks(panel: DataFrame, value: str, names: list[str], n: int, work: Callable[[list], list[tuple]], block: int = BLOCK_ROWS) -> DataFrame:
    """``(stock_id, date, names..)``: what ``work`` gives for each place of a stock's values in order of dates.

    A stock's rows are numbered and dealt into blocks; a block has the ``n``
    rows before it as well, so a long history is as many calls as it has
    blocks. Rows of one stock and date keep an order by their value.
    """
    place = F.row_number().over(Window.partitionBy("stock_id").orderBy("date", value)) - 1
    numbered = panel.select("stock_id", "date", F.col(value).cast("double").alias("v"), place.alias("i"))
    at = lambda i: F.floor(i / block).cast("long")
    blocks = F.sequence(at(F.col("i")), at(F.col("i") + n))
    dealt = numbered.select("stock_id", "date", "v", "i", F.explode(blocks).alias("b"))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("i")
        rows = work([None if v != v else v for v in group.column("v").to_pylist()])
        own = pa.compute.equal(pa.compute.divide(group.column("i"), block), group.column("b"))
        out = pa.table({"stock_id": group.column("stock_id"), "date": group.column("date")} | {c: pa.array([r[k] for r in rows], pa.float64()) for k, c in enumerate(names)})
        return out.filter(own)

    schema = T.StructType([panel.schema["stock_id"], panel.schema["date"], *[T.StructField(c, T.DoubleType()) for c in names]])
    return dealt.groupBy("stock_id", "b").applyInArrow(lambda group: run(group), schema)


def moving_tail(panel: DataFrame, n: int = 252, least: int = 60, share: float = 0.05, value: str = "return", block: int = BLOCK_ROWS) -> DataFrame:
    """``(stock_id, date, var_95, cvar_95)``: the low quantile of the last ``n`` returns and the mean of those at most that."""
    return by_blocks(panel, value, ["var_95", "cvar_95"], n, lambda v: list(tail_of(v, n, least, share)), block)


def moving_ulcer(panel: DataFrame, n: int = 126, least: int = 30, value: str = "close", block: int = BLOCK_ROWS) -> DataFrame:
    """``(stock_id, date, ulcer_index)``; a block's lead-in holds the falls and their peaks."""
    return by_blocks(panel, value, ["ulcer_index"], 2 * n, lambda v: [(u,) for u in ulcers_of(v, n, least)], block)
