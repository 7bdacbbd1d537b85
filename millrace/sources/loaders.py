"""Panels from files and raw tables: stock lists, daily bars, wide tables, statements, and made-up panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources.panels import by_stock

#: Statement columns that a price panel without statements has as nulls.
STATEMENT_COLUMNS = ("book_equity", "net_income", "sales", "gross_profit", "operating_income", "total_assets", "total_liabilities", "current_assets", "current_liabilities", "cash", "short_term_debt", "cfo")


def listed_stocks(raw: DataFrame, code: str = "code", name: str = "name") -> DataFrame:
    """``(stock_id, name, market_cap)`` of codes of six digits; the cap is not known yet."""
    return raw.where(F.col(code).rlike("^[0-9]{6}$")).select(F.col(code).alias("stock_id"), F.col(name).alias("name"), F.lit(None).cast("double").alias("market_cap"))


def exchange_symbol(code: Column) -> Column:
    """The code with its exchange's prefix: ``sh`` for those that begin with 6 or 9, else ``sz``."""
    return F.concat(F.when(code.startswith("6") | code.startswith("9"), "sh").otherwise("sz"), code)


def daily_bars_of(spark: SparkSession, path: str, symbols: Sequence[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Daily bars under ``path``, Parquet partitioned by ``stock_id``: symbols prune folders, dates reach the scan."""
    out = spark.read.option("basePath", path).parquet(path).withColumn("stock_id", F.col("stock_id").cast("string")).withColumn("date", F.to_date("date"))
    if symbols is not None:
        out = out.where(F.col("stock_id").isin(list(symbols)))
    if start is not None:
        out = out.where(F.col("date") >= F.to_date(F.lit(start)))
    return out if end is None else out.where(F.col("date") <= F.to_date(F.lit(end)))


def with_returns(daily: DataFrame) -> DataFrame:
    """Bars with market cap (close times volume, in millions) and return; a stock's first row has none and goes."""
    out = daily.withColumn("market_cap", F.col("close") * F.col("volume") / 1e6)
    return out.withColumn("return", F.try_divide("close", F.lag("close").over(by_stock())) - 1).where("`return` is not null")


def from_wide(wide: DataFrame, stocks: Sequence[str], fields: Sequence[str] = ("close", "volume"), sep: str = "|") -> DataFrame:
    """A panel of a table with one column ``<field><sep><stock>`` each, with returns and null statements."""
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("stock_id"), *[F.col(f"`{f}{sep}{s}`").cast("double").alias(f) for f in fields]) for s in stocks]))
    long = wide.select("date", rows.alias("r")).select("date", "r.*").where("close is not null")
    return with_returns(long).withColumns({c: F.lit(None).cast("double") for c in STATEMENT_COLUMNS})


#: Statements that one request names.
DATES_A_REQUEST = 5


def date_batches(reports: DataFrame, size: int = DATES_A_REQUEST) -> DataFrame:
    """``(stock_id, batch, dates)`` of ``reports(stock_id, report_date)``: each stock's dates from the latest on, ``size`` to a batch, joined by commas.

    A time of day is cut off; missing and repeated dates count once or not at all.
    """
    day = F.substring_index(F.col("report_date").cast("string"), " ", 1)
    days = reports.select("stock_id", day.alias("day")).where("day <> ''").distinct()
    place = F.row_number().over(Window.partitionBy("stock_id").orderBy(F.desc("day"))) - 1  # a stock's report dates
    numbered = days.withColumns({"place": place}).withColumn("batch", F.floor(F.col("place") / size).cast("int"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "day"))), lambda d: d["day"])
    return numbered.groupBy("stock_id", "batch").agg(F.array_join(listed, ",").alias("dates"))


def statement_payloads(raw: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Statements of ``raw(stock_id, payload)``, and the rows whose payload holds none.

    A payload is JSON, ``{"data": [{"REPORT_DATE": .., column: ..}, ..]}``; the
    schema is given, so nothing is inferred from the data. Statements are
    ``(stock_id, report_date, columns.. string)``, one each, the last of a
    stock's equal dates by all columns; without a date they go. The second
    frame keeps payloads that are no such JSON or null, unchanged.
    """
    item = ", ".join(f"`{c}` string" for c in ("REPORT_DATE", *columns))
    parsed = raw.withColumn("_p", F.from_json("payload", f"data array<struct<{item}>>, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    whole = F.col("_p._corrupt").isNull() & F.col("_p.data").isNotNull()
    rows = parsed.where(whole).select("stock_id", F.explode("_p.data").alias("s"))
    rows = rows.select("stock_id", F.substring_index("s.REPORT_DATE", " ", 1).alias("report_date"), *[F.col(f"s.`{c}`").alias(c) for c in columns]).where("report_date <> ''")
    last = rows.groupBy("stock_id", "report_date").agg(F.max(F.struct(*columns)).alias("r")).select("stock_id", "report_date", "r.*")
    return last, parsed.where(~F.coalesce(whole, F.lit(False))).drop("_p")


def latest_statements(reports: DataFrame, columns: Sequence[str], date: str = "report_date") -> DataFrame:
    """``(stock_id, columns..)`` of each stock's last report; what is missing or no number is zero.

    Retained earnings are surplus reserve and undistributed profit together,
    null unless above zero, where the reports have both; gross profit is sales
    less operating cost. Of two reports of one date the greater by ``columns`` counts.
    """
    last = reports.groupBy("stock_id").agg(F.max_by(F.struct(*columns), F.struct(date, *columns)).alias("r")).select("stock_id", *[F.coalesce(F.expr(f"try_cast(r.`{c}` AS double)"), F.lit(0.0)).alias(c) for c in columns])
    if {"surplus_reserve", "undistributed_profit"} <= set(columns):
        kept = F.col("surplus_reserve") + F.col("undistributed_profit")
        last = last.withColumn("retained_earnings", F.when(kept > 0, kept))
    if {"sales", "operating_cost"} <= set(columns):
        last = last.withColumn("gross_profit", F.col("sales") - F.col("operating_cost"))
    return last


def statement_panel(daily: DataFrame, reports: DataFrame, columns: Sequence[str], most: int | None = None) -> DataFrame:
    """Bars of the ``most`` least stock ids with returns and, on all rows of a stock, its latest statement; total debt is its liabilities."""
    if most is not None:
        daily = daily.join(daily.select("stock_id").distinct().orderBy("stock_id").limit(most), "stock_id", "left_semi")
    out = with_returns(daily).join(latest_statements(reports, columns), "stock_id", "left")
    return out.withColumn("total_debt", F.col("total_liabilities")) if "total_liabilities" in columns else out


def synthetic_panel(spark: SparkSession, stocks: int = 500, days: int = 1260, seed: int = 42, start: str = "2020-01-01") -> DataFrame:
    """Made-up daily rows: each stock's returns are normal with a drift and a deviation of its own, caps and volumes log-normal.

    Every value depends on stock, day and seed alone, so partitions do not matter.
    """
    unit = lambda *what: (F.pmod(F.xxhash64(F.lit(seed), *what), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
    normal = lambda tag, *what: F.sqrt(-2 * F.log(unit(F.lit(tag), *what))) * F.cos(2 * F.lit(3.141592653589793) * unit(F.lit(tag + "'"), *what))
    s, d = F.col("s"), F.col("d")
    grid = spark.range(stocks).withColumnRenamed("id", "s").select("s", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("d"))
    drift, dev = 0.0005 + 0.003 * normal("drift", s), (0.15 + 0.45 * unit(F.lit("dev"), s)) / F.sqrt(F.lit(252.0))
    rows = grid.select(F.format_string("STOCK_%04d", "s").alias("stock_id"), F.date_add(F.to_date(F.lit(start)), d).alias("date"), (drift + dev * normal("ret", s, d)).alias("return"),
                       F.exp(15 + 1.5 * normal("volume", s, d)).alias("volume"), F.exp(22 + 1.5 * normal("cap", s, d)).alias("market_cap"))
    return rows.withColumn("close", 100 * F.exp(F.sum("return").over(by_stock())))
