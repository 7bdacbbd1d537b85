"""Stock panels ``(stock_id, date, ..)`` from the ``lineitem`` and ``events`` tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F


def by_stock() -> WindowSpec:
    return Window.partitionBy("stock_id").orderBy("date")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_suppkey").cast("long").alias("stock_id"), F.to_date("l_shipdate").alias("date"),
        F.col("l_extendedprice").cast("double").alias("ext"), F.col("l_quantity").cast("double").alias("qty"),
        F.col("l_discount").cast("double").alias("disc"), F.col("l_tax").cast("double").alias("tax"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("line"), F.col("l_linenumber").alias("n"))


def price_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily prices, volume, market cap and return of each supplier; the first day has no return and goes."""
    price = F.try_divide("ext", "qty")
    daily = _lines(spark, sf_dir).groupBy("stock_id", "date").agg(
        F.min_by(price, "line").alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.try_divide(F.sum("ext"), F.sum("qty")).alias("close"), F.sum("qty").alias("volume"), F.sum("ext").alias("amount"))
    daily = daily.withColumns({
        "market_cap": F.col("close") * F.col("volume") / 1e6,
        "shares_outstanding": (1000 + 10 * F.col("stock_id")).cast("double"),
        "return": F.try_divide("close", F.lag("close").over(by_stock())) - 1})
    return daily.where("`return` is not null")


def daily_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(stock_id, date, close, volume)`` of each supplier's days."""
    return _lines(spark, sf_dir).groupBy("stock_id", "date").agg(F.try_divide(F.sum("ext"), F.sum("qty")).alias("close"), F.sum("qty").alias("volume"))


LINE_SQL = """
line AS (
  SELECT CAST(l_suppkey AS BIGINT) AS stock_id, CAST(l_shipdate AS DATE) AS date, CAST(l_extendedprice AS DOUBLE) AS ext,
         CAST(l_quantity AS DOUBLE) AS qty, CAST(l_discount AS DOUBLE) AS disc, CAST(l_tax AS DOUBLE) AS tax,
         l_orderkey AS o, l_linenumber AS n, l_partkey AS p
  FROM lineitem)"""

PRICE_SQL = LINE_SQL + """,
daily AS (
  SELECT stock_id, date, min_by(ext / qty, (o, n, p)) AS open, max(ext / qty) AS high, min(ext / qty) AS low,
         sum(ext) / sum(qty) AS close, sum(qty) AS volume, sum(ext) AS amount
  FROM line GROUP BY ALL),
px AS (
  SELECT *, close * volume / 1e6 AS market_cap, CAST(1000 + 10 * stock_id AS DOUBLE) AS shares_outstanding FROM (
    SELECT *, close / lag(close) OVER (PARTITION BY stock_id ORDER BY date) - 1 AS ret FROM daily)
  WHERE ret IS NOT NULL)"""


def fundamentals_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly statements of each supplier, to four digits; ``date`` is the month's first day."""
    ext, qty, disc, tax = (F.col(c) for c in ("ext", "qty", "disc", "tax"))
    sums = {
        "sales": ext, "gross_profit": ext * (1 - disc), "operating_income": ext * ((1 - disc) * (1 - tax) - 0.9),
        "net_income": ext * (disc - tax), "cfo": ext * (0.04 - tax), "total_assets": 1000 * qty, "total_liabilities": 5000 * qty * disc,
        "current_assets": F.when(F.col("n") % 2 == 1, ext).otherwise(0.0), "current_liabilities": F.when(F.col("n") % 2 == 0, ext).otherwise(0.0),
        "cash": F.when(F.col("n") == 1, ext).otherwise(0.0), "short_term_debt": F.when(F.col("n") == 2, ext).otherwise(0.0),
        "depreciation": ext * tax, "retained_earnings": ext * disc, "volume": qty}
    month = F.trunc("date", "month").alias("month")
    out = _lines(spark, sf_dir).groupBy("stock_id", month).agg(*[F.round(F.sum(v), 4).alias(k) for k, v in sums.items()])
    return out.withColumnRenamed("month", "date").withColumns({
        "book_equity": F.col("total_assets") - F.col("total_liabilities"), "total_debt": F.col("total_liabilities"),
        "market_cap": F.col("sales") / 1e6, "close": F.try_divide("sales", "volume")})


FUNDAMENTALS_ONLY_SQL = """
fx AS (
  SELECT *, total_assets - total_liabilities AS book_equity, total_liabilities AS total_debt, sales / 1e6 AS market_cap, sales / volume AS close FROM (
    SELECT stock_id, CAST(date_trunc('month', date) AS DATE) AS date, round(sum(ext), 4) AS sales, round(sum(ext * (1 - disc)), 4) AS gross_profit,
           round(sum(ext * ((1 - disc) * (1 - tax) - 0.9)), 4) AS operating_income, round(sum(ext * (disc - tax)), 4) AS net_income, round(sum(ext * (0.04 - tax)), 4) AS cfo,
           round(sum(1000 * qty), 4) AS total_assets, round(sum(5000 * qty * disc), 4) AS total_liabilities,
           round(sum(CASE WHEN n % 2 = 1 THEN ext ELSE 0 END), 4) AS current_assets, round(sum(CASE WHEN n % 2 = 0 THEN ext ELSE 0 END), 4) AS current_liabilities,
           round(sum(CASE WHEN n = 1 THEN ext ELSE 0 END), 4) AS cash, round(sum(CASE WHEN n = 2 THEN ext ELSE 0 END), 4) AS short_term_debt,
           round(sum(ext * tax), 4) AS depreciation, round(sum(ext * disc), 4) AS retained_earnings, round(sum(qty), 4) AS volume
    FROM line GROUP BY ALL))"""

FUNDAMENTALS_SQL = LINE_SQL + "," + FUNDAMENTALS_ONLY_SQL


def cross_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily cross-sections of users: factors ``f1`` (mean), ``f2`` (spread), ``f3`` (purchases), return and next return.

    A day's values are summed in the order of its events, so equal days have
    equal means to the last bit, however the table is cut into files and tasks.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").cast("long").alias("stock_id"), F.to_date("ts").alias("date"), "ts", "event_id", "event_type", "value")
    ordered = events.repartition("stock_id", "date").sortWithinPartitions("stock_id", "date", "ts", "event_id")
    daily = ordered.groupBy("stock_id", "date").agg(
        F.avg("value").alias("f1"), (F.max("value") - F.min("value")).alias("f2"),
        F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("f3"), F.count(F.lit(1)).alias("volume"))
    moved = daily.withColumn("return", F.try_divide("f1", F.lag("f1").over(by_stock())) - 1).where("`return` is not null")
    return moved.withColumn("forward_1d_ret", F.lead("return").over(by_stock()))


CROSS_SQL = """
xs AS (
  SELECT *, lead(ret) OVER (PARTITION BY stock_id ORDER BY date) AS fwd FROM (
    SELECT *, f1 / nullif(lag(f1) OVER (PARTITION BY stock_id ORDER BY date), 0) - 1 AS ret FROM (
      SELECT CAST(user_id AS BIGINT) AS stock_id, CAST(ts AS DATE) AS date, avg(value) AS f1, max(value) - min(value) AS f2,
             sum(CASE WHEN event_type = 'purchase' THEN value END) AS f3, count(*) AS volume
      FROM events GROUP BY ALL))
  WHERE ret IS NOT NULL)"""
