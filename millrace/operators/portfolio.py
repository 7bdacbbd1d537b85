"""Top-N portfolios with scheduled rebalancing and costs, in closed form: weights do not drift between rebalances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252


def schedule(dates: DataFrame, rebalance: str = "weekly") -> DataFrame:
    """``(date, rebalanced)``: each date with the last rebalance date up to it; one row per date."""
    first = F.col("date") if rebalance == "daily" else F.min("date").over(Window.partitionBy(F.date_trunc("week", "date")))
    return dates.select("date", first.alias("rebalanced"))


def target_weights(panel: DataFrame, factor: str, top_n: int = 10, scheme: str = "equal") -> DataFrame:
    """``(date, stock_id, w)`` of the highest scores of each date, ties by id."""
    order = Window.partitionBy("date").orderBy(F.col("s").desc(), "stock_id")
    top = panel.select("date", "stock_id", F.col(factor).alias("s")).where("s is not null").withColumn("k", F.row_number().over(order)).where(F.col("k") <= top_n)
    size = F.lit(1.0) if scheme == "equal" else F.abs("s")
    return top.select("date", "stock_id", F.try_divide(size, F.sum(size).over(Window.partitionBy("date"))).alias("w"))


def backtest(panel: DataFrame, factor: str, ret: str = "forward_1d_ret", top_n: int = 10, rebalance: str = "weekly", bps: float = 10.0, scheme: str = "equal") -> DataFrame:
    """``(date, ret, nav, benchmark_nav, drawdown)``, one row per date with returns.

    Costs: one on the first date, else the sum over names held now of the
    change of weight since the rebalance before, on rebalance dates only. Only
    tables of one row per date or of ``top_n`` names per date are ordered.
    """
    valid = panel.where(F.col(factor).isNotNull() & F.col(ret).isNotNull()).select("date", "stock_id", F.col(factor).alias("f"), F.col(ret).alias("r"))
    benchmark = valid.groupBy("date").agg(F.avg("r").alias("bench"))
    days = schedule(benchmark.select("date"), rebalance)
    by_date = Window.orderBy("date")
    turns = days.select("rebalanced").distinct().select("rebalanced", F.lag("rebalanced").over(Window.orderBy("rebalanced")).alias("before"))
    weights = target_weights(valid, "f", top_n, scheme).withColumnRenamed("date", "rebalanced").join(turns, "rebalanced")
    was = weights.select(F.col("rebalanced").alias("before"), "stock_id", F.col("w").alias("w0"))
    cost = weights.join(was, ["before", "stock_id"], "left").groupBy("rebalanced").agg(
        F.sum(F.abs(F.col("w") - F.coalesce("w0", F.lit(0.0)))).alias("moved"), F.max("before").alias("before"))
    cost = cost.select(F.col("rebalanced").alias("date"), F.when(F.col("before").isNull(), 1.0).otherwise(F.col("moved")).alias("moved"))
    held = days.join(weights, "rebalanced").join(valid.select("date", "stock_id", "r"), ["date", "stock_id"], "left")
    gross = held.groupBy("date").agg(F.coalesce(F.sum(F.col("w") * F.col("r")), F.lit(0.0)).alias("gross"))
    daily = benchmark.join(gross, "date").join(cost, "date", "left").select(
        "date", (F.col("gross") - F.coalesce("moved", F.lit(0.0)) * (bps / 1e4)).alias("ret"), "bench")
    so_far = by_date.rowsBetween(Window.unboundedPreceding, 0)
    nav = daily.select("date", "ret", F.product(1 + F.col("ret")).over(so_far).alias("nav"), F.product(1 + F.col("bench")).over(so_far).alias("benchmark_nav"))
    return nav.withColumn("drawdown", F.try_divide("nav", F.max("nav").over(so_far)) - 1)


def metrics(nav: DataFrame) -> DataFrame:
    """One row ``(annual_return, sharpe, max_drawdown, n_days)``."""
    n = F.count(F.lit(1))
    annual = F.pow(F.max_by("nav", "date"), F.lit(float(YEAR)) / n) - 1
    return nav.agg(annual.alias("annual_return"), F.try_divide(annual, F.stddev_samp("ret") * F.sqrt(F.lit(YEAR))).alias("sharpe"), F.min("drawdown").alias("max_drawdown"), n.alias("n_days"))


def holdings(panel: DataFrame, factor: str, top_n: int = 10) -> DataFrame:
    """``(date, names)``: at most ``top_n`` ids per date, sorted."""
    return target_weights(panel, factor, top_n).groupBy("date").agg(F.sort_array(F.collect_list("stock_id")).alias("names"))


def as_of(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """``left(stock_id, date, ..)`` with the latest ``value`` of ``right(stock_id, date, value)`` at or before each row.

    One shuffle by stock: both sides are stacked and the last value is carried on; no range join.
    """
    cols = left.columns
    a = left.select(*cols, F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(*[F.col(c) if c in ("stock_id", "date") else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols], F.lit(0).alias("_side"), F.col(value).alias("_v"))
    carry = Window.partitionBy("stock_id").orderBy("date", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("_v", F.last("_v", ignorenulls=True).over(carry)).where("_side = 1").select(*cols, F.col("_v").alias(value))
