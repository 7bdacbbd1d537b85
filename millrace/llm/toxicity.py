"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, small_batches

#: Buckets that n-grams are hashed into.
BUCKETS = 1 << 18
LENGTHS = (3, 4, 5, 6)
#: Labelled texts of each class that the model is fitted on at most, least hash first.
SAMPLE = 3000
#: Weight of the penalty and prior counts of the log ratios.
PENALTY, PRIOR = 1e-3, 1.0
STEPS = 300
#: Power of the class ratio by which toxic rows are weighed.
TILT = 0.5
#: Standard errors that a log-count ratio must differ from zero by.
SURE = 3.5
#: Sampled texts that an n-gram must be in.
LEAST = 3
#: Bytes of a text whose n-grams are hashed at a time; bounds memory for long texts.
PIECE = 1 << 20


def gram_pieces(text: str | None) -> Iterator[np.ndarray]:
    """Hash buckets of the text's n-grams of bytes, piece by piece, repeats included.

    Letters are lower-cased, white space counts as one mark; an n-gram may begin
    or end with the mark but not hold it inside, so it tells where words end.
    """
    if not text:
        return
    raw = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").split()) + b" ", dtype=np.uint8)
    most = max(LENGTHS)
    for at in range(0, len(raw), PIECE):
        here = raw[at : at + PIECE + most - 1].astype(np.uint64)
        gap = np.concatenate(([0], np.cumsum(here == 32)))
        h = np.zeros(len(here), dtype=np.uint64)
        for n in range(1, most + 1):
            if len(here) < n:
                break
            h = (h[: len(here) - n + 1] ^ here[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if n in LENGTHS:
                whole = gap[n - 1 : len(here)][: len(h)] == gap[1 : len(h) + 1]
                yield (h[whole] & np.uint64(BUCKETS - 1)).astype(np.int32)


def text_grams(text: str | None) -> np.ndarray:
    """Distinct buckets of a whole text."""
    grams = [np.unique(g) for g in gram_pieces(text)]
    return np.unique(np.concatenate(grams)) if grams else np.empty(0, np.int32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        """Probability of the toxic class; every bucket of the text counts once."""
        hits = [np.unique(g[self.weights[g] != 0]) for g in gram_pieces(text)]
        z = self.bias
        if hits:
            z += float(self.weights[np.unique(np.concatenate(hits))].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def sure_ratios(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-count ratios from each bucket's number of toxic and clean texts, and which of them are hardly chance."""
    ratio = np.log((pos + PRIOR) / (n_pos + 2 * PRIOR)) - np.log((neg + PRIOR) / (n_neg + 2 * PRIOR))
    return ratio, (pos + neg >= LEAST) & (np.abs(ratio) >= SURE * np.sqrt(1 / (pos + PRIOR) + 1 / (neg + PRIOR)))


def constant(n_pos: int, n_neg: int) -> Model:
    """The model without weights: the share of toxic labels, low without any."""
    if not n_pos + n_neg:
        return Model(np.zeros(BUCKETS, np.float32), -2.0)
    return Model(np.zeros(BUCKETS, np.float32), float(np.log((n_pos + 0.5) / (n_neg + 0.5))))


def train(grams: list[np.ndarray], toxic: np.ndarray, ratio: np.ndarray, sure: np.ndarray) -> Model:
    """Logistic regression over presence times log-count ratio, by accelerated gradient steps.

    ``grams`` holds each text's buckets among the ``sure`` ones. Without labels
    of both classes the model is a constant. Weights under a thousandth of the
    largest are dropped, so that a word's usual n-grams cost nothing when texts
    are scored.
    """
    y = toxic.astype(np.float64)
    n_pos, n_neg = int(y.sum()), int(len(y) - y.sum())
    if not n_pos or not n_neg:
        return constant(n_pos, n_neg)
    if not sure.any():
        return Model(np.zeros(BUCKETS, np.float32), 0.0 if n_pos >= n_neg else -2.0)
    used = np.flatnonzero(sure)
    at = (np.cumsum(sure, dtype=np.int32) - 1)[np.concatenate(grams)]
    rows = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])
    value = ratio[used][at]
    # between equal rows and equal classes: rare labels count, clean texts still outweigh them
    each = np.where(y == 1, (n_neg / n_pos) ** TILT, 1.0) / len(y)
    row_norm = np.bincount(rows, weights=value**2, minlength=len(y))
    step = 1 / (0.25 * (row_norm + 1).max() + PENALTY)
    w, b = np.zeros(len(used)), 0.0
    vw, vb, pw, pb = w, b, w, b
    for k in range(1, STEPS + 1):
        z = np.bincount(rows, weights=value * vw[at], minlength=len(y)) + vb
        g = each * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        w, b = vw - step * 8 * (np.bincount(at, weights=value * g[rows], minlength=len(used)) + PENALTY * vw), vb - step * 8 * g.sum()
        m = (k - 1) / (k + 2)
        vw, vb, pw, pb = w + m * (w - pw), b + m * (b - pb), w, b
    full = np.zeros(BUCKETS, np.float32)
    full[used] = w * ratio[used]
    full[np.abs(full) < 1e-3 * np.abs(full).max()] = 0
    return Model(full, float(b))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(id, text, toxic)`` of training rows: at most ``sample`` a class, by least hash of the id; of rows with one id that of least text hash."""
    ids = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    ids = ids.where(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5)) != 0).groupBy("id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("id"), F.col("id")]
    few = ids.where("toxic = 1").orderBy(*order).limit(sample).union(ids.where("toxic = 0").orderBy(*order).limit(sample))
    # at most twice ``sample`` rows are broadcast
    found = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(few), "id")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))
    return found.groupBy("id", "toxic").agg(one.alias("t")).select("id", "t.text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of at most ``sample`` labelled texts a class; ids' order decides nothing else.

    The sampled texts go to the shared folder and are read twice: executors
    count texts by bucket and class, then pick each text's buckets among those
    that the counts leave, so the driver sees at most one row per bucket and
    per text the few buckets that carry a weight.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "toxicity")
    found = scratch.keep(labelled(docs, labels, sample))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            for t, y in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                seen[y, text_grams(t.as_py())] += 1
        there = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(seen[1, there]), pa.array(seen[0, there])], names=["bucket", "pos", "neg"])

    size = dict(found.groupBy("toxic").count().collect())
    n_pos, n_neg = size.get(1, 0), size.get(0, 0)
    if not n_pos or not n_neg:
        return constant(n_pos, n_neg)
    by = found.mapInArrow(count, "bucket long, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    few = by.where(F.col("pos") + F.col("neg") >= LEAST).toArrow()
    pos, neg = np.zeros(BUCKETS), np.zeros(BUCKETS)
    pos[few.column(0).to_numpy()], neg[few.column(0).to_numpy()] = few.column(1).to_numpy(), few.column(2).to_numpy()
    ratio, sure = sure_ratios(pos, neg, n_pos, n_neg)
    shared = spark.sparkContext.broadcast(sure)  # 0.3 MB at any input size

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = [text_grams(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[shared.value[g]].tobytes() for g in grams], pa.binary()), b.column(2)], names=["id", "grams", "toxic"])

    schema = T.StructType([T.StructField("id", found.schema["id"].dataType), T.StructField("grams", T.BinaryType()), T.StructField("toxic", T.IntegerType())])
    got = sorted(found.mapInArrow(pick, schema).collect(), key=lambda r: (r[0], bytes(r[1])))
    scratch.drop(found)
    return train([np.frombuffer(r[1], np.int32) for r in got], np.array([r[2] for r in got], dtype=np.int64), ratio, sure)


def scores(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every whole text; null texts score like empty ones."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # 1 MB at any input size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Model(*shared.value)
        for b in batches:
            got = [here.score(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], names=["id", "score"])

    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, T.StructType([T.StructField("id", slim.schema["id"].dataType), T.StructField("score", T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document.

    Null and empty texts score the model's bias; null ids are never held out;
    repeated rows each get a row; an empty table gives an empty result; extra
    columns are ignored.
    """
    out = scores(docs, fit(docs, labels, sample))
    held = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that score under 0.5, with their own columns."""
    small_batches(docs.sparkSession)
    model = fit(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Model(*shared.value)
        for b in batches:
            ok = [here.score(t.as_py()) < 0.5 for t in b.column(b.schema.get_field_index("text"))]
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
