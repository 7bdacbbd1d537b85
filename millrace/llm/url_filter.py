"""URL filter: list rules first, then a ratio of two smoothed variable-order character models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: (verdict, host, path); the longest that fits decides.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Characters that the models tell apart; digits are one, all others are one.
LETTERS = "abcdefghijklmnopqrstuvwxyz-_./?=&#%:"
SIZE = len(LETTERS) + 3  # and: digit, other, start of a URL
ORDER = 3
BINS = 4000
SPAN = 4.0
A_TO_Z = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without."""
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), *A_TO_Z), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null without one."""
    name = verdict = None
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(F.lit(None).cast("string") if name is None else name)
        verdict = F.when(fits, F.lit(v)).otherwise(F.lit(None).cast("string") if verdict is None else verdict)
    return name, verdict


def _codes() -> np.ndarray:
    table = np.full(256, SIZE - 2, dtype=np.int64)
    for i, c in enumerate(LETTERS):
        table[ord(c)] = i
    for c in range(ord("A"), ord("Z") + 1):
        table[c] = table[c + 32]
    table[ord("0") : ord("9") + 1] = SIZE - 3
    return table


def url_codes(url: str | None) -> np.ndarray:
    """Codes of what follows the scheme, after ``ORDER`` starts; empty for null and empty."""
    text = (url or "").split("://", 1)[-1].encode("utf-8", "replace")
    return np.concatenate((np.full(ORDER, SIZE - 1), _CODES[np.frombuffer(text, np.uint8)])) if text else np.empty(0, np.int64)


_CODES = _codes()


def gram_ids(codes: np.ndarray) -> np.ndarray:
    """Each character with its ``ORDER`` predecessors as one number."""
    if len(codes) <= ORDER:
        return np.empty(0, np.int64)
    out = np.zeros(len(codes) - ORDER, dtype=np.int64)
    for k in range(ORDER + 1):
        out = out * SIZE + codes[k : k + len(out)]
    return out


def smoothed(counts: np.ndarray) -> np.ndarray:
    """log p(character | up to ``ORDER`` before it), every order blended with the shorter one.

    A context seen n times with d different successors trusts its own counts
    with n / (n + d) and the context without its first character with the rest,
    down to equal chances, so contexts that were never seen fall back wholly.
    """
    full = counts.reshape((SIZE,) * (ORDER + 1)).astype(np.float64)
    p = np.full(SIZE, 1.0 / SIZE)
    for order in range(ORDER + 1):
        c = full.sum(axis=tuple(range(ORDER - order))) if order < ORDER else full
        n, d = c.sum(axis=-1, keepdims=True), (c > 0).sum(axis=-1, keepdims=True)
        p = (c + np.maximum(d, 1) * p) / (n + np.maximum(d, 1))
    return np.log(p).reshape(-1)


def _runner(kind: str, shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SIZE ** (ORDER + 1)), dtype=np.int64)
        for b in batches:
            for k in (0, 1):
                grams = [gram_ids(url_codes(u.as_py())) for u, c in zip(b.column(0), b.column(1), strict=True) if c.as_py() == k]
                if grams:
                    ids, n = np.unique(np.concatenate(grams), return_counts=True)
                    total[k][ids] += n
        for k in (0, 1):
            at = np.flatnonzero(total[k])
            for i in range(0, len(at), 50_000):
                ids = at[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), k, np.int32)), pa.array(ids), pa.array(total[k][ids])], names=["kind", "gram", "n"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for b in batches:
            out = []
            for u in b.column(b.num_columns - 1):
                ids = gram_ids(url_codes(u.as_py()))
                out.append(float(ratio[ids].mean(dtype=np.float64)) if len(ids) else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, "score"])

    return count if kind == "count" else score


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """``(id, host, path, rule, verdict, score)`` of every row.

    The accepted and the rejected model count the characters of all URLs that a
    rule allows or blocks, but every fifth by hash, which calibrate: the cut is
    the score (mean log-likelihood difference a character) that best separates
    their verdicts, by mean recall of both. Tables have one entry for each
    character and its three predecessors, 2.3 million at any input size. Without
    rules of both verdicts in the data, everything that no rule decides is
    allowed. Null and empty URLs score 0 and are allowed unless the cut is above
    0; repeated rows each get a row; extra columns are ignored.
    """
    spark = pages.sparkSession
    small_batches(spark, 4096)
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), host(url).alias("host"), path(url).alias("path"), url.alias("url"))
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("id", "host", "path", name.alias("rule"), verdict.alias("ruled"), "url")
    ruled = rows.where("ruled is not null")
    fifth = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    counted = ruled.where(~fifth).select("url", (F.col("ruled") == "allow").cast("int").alias("kind")).mapInArrow(_runner("count", None), "kind int, gram long, n long")
    counts = np.zeros((2, SIZE ** (ORDER + 1)), dtype=np.int64)
    for r in counted.groupBy("kind", "gram").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["kind"], r["gram"]] = r["n"]
    if not counts.any(axis=1).all():
        cut, ratio = -1e9, np.zeros(SIZE ** (ORDER + 1), np.float32)
    else:
        cut, ratio = None, (smoothed(counts[1]) - smoothed(counts[0])).astype(np.float32)
    shared = spark.sparkContext.broadcast(ratio)  # SIZE ** 4 floats: 9 MB
    schema = "id {0}, host string, path string, rule string, ruled string, url string, score double".format(rows.schema["id"].dataType.simpleString())
    if cut is None:
        held = ruled.where(fifth).mapInArrow(_runner("score", shared), schema)
        at = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") + SPAN) / (2 * SPAN) * BINS))).cast("int")
        bins = np.zeros((2, BINS))
        for r in held.groupBy((F.col("ruled") == "allow").cast("int").alias("kind"), at.alias("bin")).count().collect():  # at most 2 * BINS rows
            bins[r["kind"], r["bin"]] = r["count"]
        share = bins / np.maximum(bins.sum(axis=1, keepdims=True), 1)
        rejected = np.concatenate(([0], np.cumsum(share, axis=1)[0]))
        kept = 1 - np.concatenate(([0], np.cumsum(share, axis=1)[1]))
        cut = int(np.argmax(rejected + kept)) / BINS * 2 * SPAN - SPAN if bins.any(axis=1).all() else 0.0
    scored = rows.mapInArrow(_runner("score", shared), schema)
    by_model = F.when(F.col("score") >= F.lit(cut), "allow").otherwise("block")
    return scored.select("id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score")
