"""Steps between a factor panel and its tests: standardising, filters, samples and per-stock assignments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.cross import winsorized, with_cross, zscore
from millrace.functions.order import cumulative, quantiles
from millrace.sources.scratch import settled

EPS = 1e-10


def standardized(panel: DataFrame, factors: Sequence[str], limit: float = 0.01) -> DataFrame:
    """``panel`` with ``<factor>_z``: clipped to the date's ``limit`` and 1 - ``limit`` quantiles, then the distance from the clipped mean in deviations."""
    clipped = with_cross(panel, {f"_c_{f}": winsorized(F.col(f), limit) for f in factors})
    scored = with_cross(clipped, {f"{f}_z": zscore(F.col(f"_c_{f}"), EPS) for f in factors})
    return scored.select(*panel.columns, *[f"{f}_z" for f in factors])


def enough_factors(panel: DataFrame, factors: Sequence[str], least: int | None = None) -> DataFrame:
    """Rows with at least ``least`` factors that are not null (default: half of them, three at least)."""
    return panel.na.drop(thresh=max(3, len(factors) // 2) if least is None else least, subset=list(factors))


def last_cross_section(panel: DataFrame) -> DataFrame:
    """The rows of the last date."""
    return panel.join(F.broadcast(panel.agg(F.max("date").alias("date"))), "date", "left_semi")  # one row


def coverage(panel: DataFrame, factors: Sequence[str]) -> DataFrame:
    """``(factor, n)``: values of each factor that are not null, from one pass."""
    counts = panel.agg(*[F.count(f).alias(f) for f in factors])
    return counts.unpivot([], list(factors), "factor", "n")


def covered(panel: DataFrame, factors: Sequence[str], more_than: int = 100) -> list[str]:
    """Factors with more than ``more_than`` values, in the given order."""
    known = {r["factor"] for r in coverage(panel, factors).where(F.col("n") > more_than).collect()}  # one row per factor
    return [f for f in factors if f in known]


def first_per_stock(panel: DataFrame) -> DataFrame:
    """Each stock's row of least date; of several that by all its columns."""
    rest = [c for c in panel.columns if c not in ("stock_id", "date")]
    least = panel.groupBy("stock_id").agg(F.min(F.struct("date", *rest)).alias("_r"))
    return least.select("stock_id", "_r.*").select(*panel.columns)


def first_stocks(panel: DataFrame, most: int) -> DataFrame:
    """Rows of the ``most`` least stock ids."""
    few = panel.select("stock_id").distinct().orderBy("stock_id").limit(most)
    return panel.join(few, "stock_id", "left_semi")


def every_kth_date(panel: DataFrame, k: int) -> DataFrame:
    """Rows of the first date and of each ``k``-th after it."""
    order = panel.select("date").distinct().select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("_i"))  # one row per date
    return panel.join(F.broadcast(order.where(F.col("_i") % k == 0).drop("_i")), "date", "left_semi")


def assigned(panel: DataFrame, values: DataFrame) -> DataFrame:
    """``panel`` with the columns of ``values(stock_id, ..)``, one row per stock, on all rows of the stock."""
    return panel.join(values, "stock_id", "left")


def union_of(*selections: Sequence[str], most: int = 15) -> list[str]:
    """Names in any of the selections: those chosen most often first, then by name."""
    votes = {n: sum(n in s for s in selections) for s in selections for n in s}
    return sorted(votes, key=lambda n: (-votes[n], n))[:most]


def distribution(panel: DataFrame, factor: str, k: int = 1) -> DataFrame:
    """``(date, low, q25, q50, q75, high, n)`` of the factor on every ``k``-th date."""
    rows = settled(every_kth_date(panel, k).select("date", F.col(factor).alias("x")))
    q = quantiles(cumulative(rows, ("date",), "x"), ("date",), "x", (0.25, 0.5, 0.75), "_q")
    ends = rows.groupBy("date").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("x").alias("n"))
    return ends.join(q, "date", "left").select("date", "low", F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q75"), "high", "n")
