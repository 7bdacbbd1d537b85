"""Research memory, result cache and run identity over Parquet and JSON in a shared folder."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMAS = {
    "candidates": ("ast_hash", "ast_hash string, canonical string, required_fields string, lookback int, status string, at double"),
    "evaluations": ("ast_hash", "ast_hash string, mean_ic double, ir double, sharpe double, fm_tstat double, verdict string, at double"),
    "factor_correlations": ("pair", "pair string, rho double, at double"),
    "checkpoints": ("name", "name string, state string, at double"),
}


def run_identity(**parts) -> str:
    """SHA-256 of the named parts, whatever their order."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def fingerprint(kind: str, name: str, universe: str, version: str, meta: dict) -> str:
    return hashlib.md5("|".join((kind, name, universe, version, json.dumps(meta, sort_keys=True))).encode()).hexdigest()


def pair_key(a: str, b: str) -> str:
    return "|".join(sorted((a, b)))


class ResearchMemory:
    """Four tables of appended events; the latest event of a key is its row."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def put(self, name: str, rows: Sequence[tuple]) -> None:
        self.spark.createDataFrame(list(rows), SCHEMAS[name][1]).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def table(self, name: str) -> DataFrame:
        key, schema = SCHEMAS[name]
        try:
            events = self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            events = self.spark.createDataFrame([], schema)
        # events of one time: the greatest by all columns, whatever order they are read in
        newest = F.row_number().over(Window.partitionBy(key).orderBy(F.col("at").desc(), *[F.col(c).desc() for c in events.columns if c not in (key, "at")]))
        return events.withColumn("_k", newest).where("_k = 1").drop("_k")

    def get(self, name: str, key: str) -> dict | None:
        """The row of one key, or None."""
        row = self.table(name).where(F.col(SCHEMAS[name][0]) == key).first()
        return row and row.asDict()

    def put_correlation(self, a: str, b: str, rho: float, at: float) -> None:
        self.put("factor_correlations", [(pair_key(a, b), float(rho), float(at))])

    def put_checkpoint(self, name: str, state: dict, at: float) -> None:
        """State of a run that may be paused; the latest one counts."""
        self.put("checkpoints", [(name, json.dumps(state, sort_keys=True), float(at))])

    def checkpoint(self, name: str) -> dict | None:
        row = self.get("checkpoints", name)
        return row and json.loads(row["state"])

    def compact(self, name: str) -> None:
        """Replace the events that a table holds now by its latest rows in one file.

        The rows are added before the old files go: a stop in between leaves
        both, which read the same, and events added meanwhile are in other
        files. A reader that has listed the old files must start again.
        """
        rows = self.table(name)
        old = rows.inputFiles()
        if not old:
            return
        rows.coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for file in old:
            where = jvm.org.apache.hadoop.fs.Path(file)
            where.getFileSystem(conf).delete(where, False)

    def candidates(self) -> DataFrame:
        """Candidates with the status of their latest evaluation, so one append changes both."""
        judged = self.table("evaluations").select("ast_hash", "verdict")
        return self.table("candidates").join(judged, "ast_hash", "left").withColumn("status", F.coalesce("verdict", "status")).drop("verdict")

    def stats(self) -> DataFrame:
        passed = self.candidates().agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "PASSED").alias("passed"))
        return passed.crossJoin(F.broadcast(self.table("evaluations").agg(F.count(F.lit(1)).alias("evaluations"))))  # one row each


class Cache:
    """Frames (Parquet) and metrics (JSON) by fingerprint; ``None`` where nothing is kept."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def put(self, layer: str, key: str, frame: DataFrame) -> DataFrame:
        frame.write.mode("overwrite").parquet(f"{self.root}/{layer}/{key}")
        return self.get(layer, key)

    def get(self, layer: str, key: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/{layer}/{key}")
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def put_metrics(self, key: str, metrics: dict) -> None:
        self.spark.createDataFrame([(json.dumps(metrics, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/metrics/{key}")

    def metrics(self, key: str) -> dict | None:
        try:
            return json.loads(self.spark.read.text(f"{self.root}/metrics/{key}").first()[0])
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def counts(self) -> dict[str, int]:
        """Entries of each layer."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        out = {}
        for layer in ("raw", "nodes", "factors", "metrics"):
            where = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{layer}")
            fs = where.getFileSystem(conf)
            out[layer] = len(list(fs.listStatus(where))) if fs.exists(where) else 0
        return out


class Harness:
    """Cache and memory of one run. Raw data is shared by all runs of one request; nodes, factors and metrics belong to the stocks it resolved to.

    Without a cache or a memory, storing does nothing and loading gives None.
    """

    def __init__(self, spark: SparkSession, root: str, request: dict, stocks: Sequence[str], fields: Sequence[str], cache: bool = True, memory: bool = True):
        self.request = run_identity(**request)
        self.resolved = run_identity(**request, stock_ids=sorted(stocks), fields=sorted(fields))
        self._cache = Cache(spark, f"{root.rstrip('/')}/cache") if cache else None
        self._memory = ResearchMemory(spark, f"{root.rstrip('/')}/memory") if memory else None

    @property
    def memory(self) -> ResearchMemory:
        if self._memory is None:
            raise RuntimeError("research memory is disabled")
        return self._memory

    def _key(self, layer: str, name: str, meta: dict) -> str:
        return fingerprint(layer, name, self.request if layer == "raw" else self.resolved, "1", meta)

    def store(self, layer: str, name: str, frame: DataFrame, **meta) -> DataFrame:
        """Layers: ``raw``, ``nodes`` (parts of expressions) and ``factors``."""
        return frame if self._cache is None else self._cache.put(layer, self._key(layer, name, meta), frame)

    def load(self, layer: str, name: str, **meta) -> DataFrame | None:
        return None if self._cache is None else self._cache.get(layer, self._key(layer, name, meta))

    def store_metrics(self, name: str, metrics: dict, **meta) -> None:
        if self._cache is not None:
            self._cache.put_metrics(self._key("metrics", name, meta), metrics)

    def load_metrics(self, name: str, **meta) -> dict | None:
        return None if self._cache is None else self._cache.metrics(self._key("metrics", name, meta))

    def counts(self) -> dict[str, int] | None:
        return self._cache and self._cache.counts()
