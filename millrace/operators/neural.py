"""Factor selection by a small neural network whose gradients are summed where the rows are."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.blocks import blocks, parts_of, summed

#: Rates of the first and second moments of the gradient, and what is added to the root of the second.
MOMENTS, SMALL = (0.9, 0.999), 1e-8
#: Rows that go through the network at a time: what layers give for them stays in a core's cache.
STRETCH = 2048


def layers_of(flat: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights, offsets) of each layer, as views of one array."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:], strict=False):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def outputs(flat: np.ndarray, sizes: Sequence[int], x: np.ndarray) -> list[np.ndarray]:
    """What every layer gives for the rows ``x``; negative values of inner layers are cut to zero."""
    out = [x]
    layers = layers_of(flat, sizes)
    for i, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        out.append(np.maximum(z, 0) if i + 1 < len(layers) else z)
    return out


def gradient(flat: np.ndarray, sizes: Sequence[int], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Gradient of half the sum of squared errors."""
    got, grad = outputs(flat, sizes, x), np.zeros_like(flat)
    back = got[-1] - y[:, None]
    for (w, _), (gw, gb), before in zip(reversed(layers_of(flat, sizes)), reversed(layers_of(grad, sizes)), reversed(got[:-1]), strict=True):
        gw[:], gb[:] = before.T @ back, back.sum(axis=0)
        back = (back @ w.T) * (before > 0)
    return grad


def _block(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(x, y, valid) of a batch of ``scaled_rows``."""
    x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
    return x, b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)


def scaled_rows(data: DataFrame) -> DataFrame | None:
    """``(x, y, valid)`` with features and label in deviations from their means; a tenth of the rows, by hash, is valid.

    Rows are dealt by hash, so each batch is a random mixture. None without rows or if the label does not vary.
    """
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    label = data.agg(F.avg("label").alias("m"), F.stddev_pop("label").alias("d"), F.count("label").alias("n")).first()
    if not label["d"]:
        return None
    stats = data.agg(Summarizer.metrics("mean", "std").summary(F.col("features")).alias("s")).first()["s"]
    mean, dev = stats["mean"].toArray(), stats["std"].toArray()
    dev = np.where(dev > 0, dev, 1.0)
    x = vector_to_array("features")
    scaled = F.array(*[(x[i] - float(m)) / float(d) for i, (m, d) in enumerate(zip(mean, dev, strict=True))])
    h = F.xxhash64("date", "stock_id")
    rows = data.select(h.alias("h"), scaled.alias("x"), ((F.col("label") - label["m"]) / label["d"]).alias("y"))
    parts = parts_of(data.sparkSession.sparkContext, label["n"])
    dealt = rows.repartition(parts, "h").sortWithinPartitions("h").coalesce(parts)  # no more tasks a step where a session deals by more partitions
    return dealt.select("x", "y", (F.pmod("h", F.lit(10)) == 0).alias("valid"))


def fit(rows: RDD, inputs: int, hidden: Sequence[int], rate: float, penalty: float, steps: int, patience: int, seed: int) -> np.ndarray:
    """Weights of least error on the valid rows over ``steps`` steps of Adam on all others.

    It stops after ``patience`` steps without a gain. The state has the size of
    the network, whatever the rows; each step is one aggregation of its gradient.
    """
    sizes = (inputs, *hidden, 1)
    rng = np.random.default_rng(seed)
    flat = np.concatenate([np.concatenate([rng.normal(0, np.sqrt(2 / a), a * b), np.zeros(b)]) for a, b in zip(sizes, sizes[1:], strict=False)])
    kept, least, waited = flat, np.inf, 0
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    for step in range(1, steps + 1):
        def work(x: np.ndarray, y: np.ndarray, valid: np.ndarray, flat: np.ndarray = flat) -> np.ndarray:
            valid = valid.astype(bool)
            off = outputs(flat, sizes, x[valid])[-1][:, 0] - y[valid]
            x, y = x[~valid], y[~valid]
            grad = sum((gradient(flat, sizes, x[i : i + STRETCH], y[i : i + STRETCH]) for i in range(0, len(x), STRETCH)), np.zeros_like(flat))
            return np.concatenate([grad, [len(x), off @ off, valid.sum()]])

        total = summed(rows, work, np.zeros(len(flat) + 3))
        n, error, checked = total[-3:]
        if not n:
            break
        if checked:
            if error / checked < least - 1e-4 * min(least, 1.0):
                kept, least, waited = flat, error / checked, 0
            elif (waited := waited + 1) > patience:
                break
        else:
            kept = flat
        grad = (total[:-3] + penalty * flat) / n
        first, second = MOMENTS[0] * first + (1 - MOMENTS[0]) * grad, MOMENTS[1] * second + (1 - MOMENTS[1]) * grad**2
        flat = flat - rate * (first / (1 - MOMENTS[0] ** step)) / (np.sqrt(second / (1 - MOMENTS[1] ** step)) + SMALL)
    return kept


def importances(rows: RDD, flat: np.ndarray, sizes: Sequence[int], repeats: int, seed: int) -> np.ndarray:
    """Mean rise of the error, in variances of the label, where a column's values are dealt anew among the rows of a batch."""
    k = sizes[0]

    def work(x: np.ndarray, y: np.ndarray, valid: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng([seed, zlib.crc32(x[0].tobytes())])
        off = outputs(flat, sizes, x)[-1][:, 0] - y
        found = [off @ off, y @ y]
        for j in range(k):
            for _ in range(repeats):
                other = x.copy()
                other[:, j] = x[rng.permutation(len(x)), j]
                off = outputs(flat, sizes, other)[-1][:, 0] - y
                found.append(off @ off)
        return np.array(found)

    total = summed(rows, work, np.zeros(2 + k * repeats))
    return (total[2:].reshape(k, repeats).mean(axis=1) - total[0]) / max(total[1], 1e-300)


def neural_selection(
    data: DataFrame, factors: Sequence[str], hidden: Sequence[int] = (64, 32), rate: float = 0.03, penalty: float = 0.001, steps: int = 100, patience: int = 10,
    repeats: int = 5, top: int = 10, seed: int = 42,
) -> dict[str, float]:
    """The ``top`` factors whose permutation raises the error of a network fitted on ``data(date, stock_id, features, label)``.

    Without rows, or where the label does not vary, none is chosen.
    """
    scaled = scaled_rows(data)
    if scaled is None:
        return {}
    rows = blocks(scaled, _block)
    flat = fit(rows, len(factors), hidden, rate, penalty, steps, patience, seed)
    weights = importances(rows, flat, (len(factors), *hidden, 1), repeats, seed)
    rows.unpersist()
    return dict(sorted(((f, float(w)) for f, w in zip(factors, weights, strict=True) if w > 0), key=lambda x: -x[1])[:top])
