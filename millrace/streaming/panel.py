"""A panel of daily bars that a stream keeps up to date."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SUMS = "stock_id long, date date, total double, low double, high double, n long, first struct<ts: timestamp, value: double>, last struct<ts: timestamp, value: double>"


class StreamedPanel:
    """Daily sums of each micro-batch in a folder of its own; a bar is what all batches together say of its day.

    A batch that is run again, after a loss or a restart, overwrites its own
    folder, so nothing counts twice. Events of any age are merged into their
    day; the stream needs no state and no watermark.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, events: DataFrame, batch: int) -> None:
        """The sums of ``events(user_id, ts, value)`` as those of micro-batch ``batch``; events without a user, time or value are left out."""
        whole = events.where("user_id is not null and ts is not null and value is not null")
        at = F.struct(F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
        sums = whole.groupBy(F.col("user_id").cast("long").alias("stock_id"), F.to_date("ts").alias("date")).agg(
            F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
        sums.write.mode("overwrite").parquet(f"{self.root}/batch={batch}")

    def start(self, events: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Keep the panel up to date with the stream ``events``; ``trigger`` as in ``DataStreamWriter.trigger``."""
        writer = events.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def bars(self) -> DataFrame:
        """``(stock_id, date, open, high, low, close, mean, n)``; opening and closing values are those of the first and last event, of equal times the least and greatest value."""
        try:
            sums = self.spark.read.schema(SUMS).parquet(self.root)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            sums = self.spark.createDataFrame([], SUMS)
        merged = sums.groupBy("stock_id", "date").agg(
            F.min("first").alias("_f"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("last").alias("_l"), F.sum("total").alias("_t"), F.sum("n").alias("n"))
        return merged.select("stock_id", "date", F.col("_f.value").alias("open"), "high", "low", F.col("_l.value").alias("close"), (F.col("_t") / F.col("n")).alias("mean"), "n")
