"""Connected components and other helpers of the operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.scratch import Scratch

#: Rows an Arrow batch holds at most when whole texts travel to Python workers;
#: bounds a worker's memory by this many texts at a time.
TEXT_ROWS_PER_BATCH = 512


#: Bytes of an Arrow batch at most, but for a single longer row.
TEXT_BYTES_PER_BATCH = 32 << 20


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS_PER_BATCH, size: int = TEXT_BYTES_PER_BATCH) -> None:
    """Bound the rows and the bytes of an Arrow batch for this session if the bounds in force are wider."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key)
        if not (now.rstrip("b").isdecimal() and 0 < int(now.rstrip("b")) <= most):
            spark.conf.set(key, str(most))


#: Contracted edges that one task joins at the end; a bound that does not grow with the input.
LAST_EDGES = 8192


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(node, top)`` of the nodes of a few edges."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            up[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([find(x) for x in list(up)], pa.int64())], names=["node", "top"])


def components(scratch: Scratch, edges: DataFrame, last_edges: int = LAST_EDGES) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, root)``.

    Each round hooks every node to the neighbour of least hash (itself
    included), jumps one pointer further, contracts the edges to the parents
    and drops loops and repeats, so the edge table shrinks geometrically; a
    round's tables go to the shared folder. Once at most ``last_edges`` are
    left, one task joins them. Nodes without an edge are absent. Hashes are
    seeded by the round, so no ordering of ids makes long chains.
    """
    edges = scratch.keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels: DataFrame | None = None
    step = 0
    while not edges.isEmpty():
        step += 1
        last = edges.limit(last_edges + 1).count() <= last_edges
        if last:
            parent = scratch.keep(edges.coalesce(1).mapInArrow(_joined, "node long, top long"))
        else:
            both = edges.union(edges.select("b", "a")).toDF("node", "near")
            rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(step)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
            hook = scratch.keep(both.groupBy("node").agg(F.min(rank("near")).alias("m")).select("node", F.least(rank("node"), F.col("m"))["n"].alias("up")))
            upper = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            parent = scratch.keep(hook.join(upper, "up").select("node", "top"))
            scratch.drop(hook)
        if labels is None:
            labels_new = scratch.keep(parent.withColumnRenamed("top", "root"))
        else:
            moved = parent.select(F.col("node").alias("root"), "top")
            labels_new = scratch.keep(labels.join(moved, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
            scratch.drop(labels)
        labels = labels_new
        if last:
            for gone in (edges, parent):
                scratch.drop(gone)
            break
        to_a = parent.select(F.col("node").alias("a"), F.col("top").alias("ta"))
        to_b = parent.select(F.col("node").alias("b"), F.col("top").alias("tb"))
        left = edges.join(to_a, "a").join(to_b, "b").where("ta <> tb")
        shrunk = scratch.keep(left.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        for gone in (edges, parent):
            scratch.drop(gone)
        edges = shrunk
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


def named_components(scratch: Scratch, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``(node, root, component)`` of all ``nodes(node, least_id, ..)``: the least id of a node's component.

    The least ids are written before they are joined, so a component of any
    size is only a skewed side of a plain join, which adaptive execution splits.
    """
    named = scratch.keep(nodes.join(roots, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root")))
    least = scratch.keep(named.groupBy("root").agg(F.min("least_id").alias("component")))
    return named.join(least, "root").select("node", "root", "component")
