"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, one is set: under the warehouse, which a cluster shares,
    or in the temporary folder of a session without other machines.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        alone = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}" if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Parquet looks at a page's bytes from the first row on. By default it looks after 100 rows, so that all large values
#: of a file are one page, and the codecs keep buffers of a page's size outside of the heap as long as an executor runs.
PAGES = {"parquet.page.size.row.check.min": "1"}


class Scratch:
    """Parquet tables under the checkpoint folder, deleted when the driver ends.

    ``keep`` writes a frame and rereads it, which cuts lineage at a place that
    survives the loss of any executor, fixes values that a recomputation might
    sum in another order, and gives the planner real sizes.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        self._file_system(self.root)[0].deleteOnExit(self._file_system(self.root)[1])

    def _file_system(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _next(self) -> str:
        self._n += 1
        return f"{self.root}/{self._n}"

    def keep(self, df: DataFrame, large: bool = False) -> DataFrame:
        """``large``: single values may have megabytes."""
        path = self._next()
        df.write.mode("overwrite").options(**PAGES if large else {}).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kept_at = path
        return out

    def keep_by(self, df: DataFrame, column: str, parts: int) -> DataFrame:
        """Like ``keep`` of large values, as a table in ``parts`` buckets by ``column``: groupings by it read it without a shuffle."""
        path, name = self._next(), f"kept_{uuid.uuid4().hex}"
        df.repartition(parts, column).write.format("parquet").options(**PAGES).bucketBy(parts, column).option("path", path).saveAsTable(name)
        out = self.spark.table(name)
        out._kept_at = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a kept table that no later frame reads."""
        path = getattr(df, "_kept_at", None)
        if path:
            fs, where = self._file_system(path)
            fs.delete(where, True)


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once, so that all that is derived from it sees the same values."""
    return Scratch(df.sparkSession, "settled").keep(df)
