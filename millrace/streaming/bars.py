"""Daily bars of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_bars(events: DataFrame, late: str = "2 days") -> DataFrame:
    """``(stock_id, date, close, volume)`` per user and day of ``events(user_id, ts, value)``, batch or stream.

    State of a day is dropped once the watermark passes its end, so it holds
    the open days only; events later than ``late`` are ignored on a stream.
    """
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    day = F.window("ts", "1 day")
    bars = timed.groupBy(F.col("user_id").cast("long").alias("stock_id"), day.alias("day")).agg(
        F.avg("value").alias("close"), F.count(F.lit(1)).alias("volume"))
    return bars.select("stock_id", F.to_date("day.start").alias("date"), "close", "volume")
