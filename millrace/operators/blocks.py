"""Rows as arrays in few partitions, for models that pass over them many times."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, SparkContext, StorageLevel
from pyspark.sql import DataFrame

#: Rows that make a task worth its start, and the most rows of a task.
ROWS_A_TASK, ROWS_AT_MOST = 16384, 1 << 21
#: Bytes of all tasks' sums that the driver adds itself.
SUMS_AT_ONCE = 1 << 26


def parts_of(context: SparkContext, rows: int) -> int:
    """Partitions for so many rows: no more than the cores, or whole rounds of all cores where tasks would grow too large."""
    cores = max(1, context.defaultParallelism)
    return max(1, min(-(-rows // ROWS_A_TASK), cores * max(1, -(-rows // (cores * ROWS_AT_MOST)))))


def fewer_parts(df: DataFrame) -> DataFrame:
    """``df``, which is cheap to count, in as many partitions as its rows are worth."""
    parts = parts_of(df.sparkSession.sparkContext, df.count())
    return df.coalesce(parts) if df.rdd.getNumPartitions() >= parts else df.repartition(parts)


def blocks(df: DataFrame, arrays: Callable[[pa.RecordBatch], tuple[np.ndarray, ...]], least: int = 1) -> RDD:
    """What ``arrays`` makes of batches of ``df``, ``least`` rows or more where there are as many, persisted: a pass over them starts no SQL query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        made = lambda: pa.RecordBatch.from_arrays([pa.array([pickle.dumps(arrays(pa.concat_batches(held)))], pa.binary())], names=["block"])
        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= least:
                yield made()
                held = []
        if held:
            yield made()

    return df.mapInArrow(run, "block binary").rdd.map(lambda r: pickle.loads(r[0])).persist(StorageLevel.MEMORY_AND_DISK)


def summed(rows: RDD, work: Callable[..., np.ndarray], like: np.ndarray) -> np.ndarray:
    """The sum of ``work(*block)`` over all blocks, from zeros like ``like``; many or large sums of tasks are added in a tree."""

    def run(held: Iterator[tuple[np.ndarray, ...]]) -> Iterator[np.ndarray]:
        total = np.zeros_like(like)
        for block in held:
            total += work(*block)
        yield total

    parts = rows.getNumPartitions()
    if not parts:
        return np.zeros_like(like)
    totals = rows.mapPartitions(run)
    return sum(totals.collect(), np.zeros_like(like)) if parts * like.nbytes <= SUMS_AT_ONCE else totals.treeReduce(np.add)
