"""Factor tests: information coefficients, bucket portfolios, cross-section regressions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.cross import bucket, pct_rank, with_cross
from millrace.operators.coefficients import rank_coefficients
from millrace.sources.scratch import settled

EPS = 1e-10
YEAR = 252
LEAST_NAMES = 30


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of a group; null where a side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def daily_ic(panel: DataFrame, factor: str, ret: str = "forward_1d_ret", method: str = "spearman", least: int = LEAST_NAMES) -> DataFrame:
    """``(date, ic, n)`` of dates with ``least`` complete pairs or more."""
    pairs = panel.select("date", F.col(factor).alias("x"), F.col(ret).alias("y")).where("x is not null and y is not null")
    if method == "spearman":
        out = rank_coefficients(settled(pairs), "y", [F.col("x")]).drop("i")
    else:
        out = pairs.groupBy("date").agg(correlation(F.col("x"), F.col("y")).alias("ic"), F.count(F.lit(1)).alias("n"))
    return out.where((F.col("n") >= least) & F.col("ic").isNotNull())


def ic_summary(ic: DataFrame) -> DataFrame:
    """One row: mean, deviation, ratio, t value, share above zero and number of dates."""
    mean, dev, n = F.avg("ic"), F.stddev_samp("ic"), F.count("ic")
    return ic.agg(mean.alias("mean_ic"), dev.alias("std_ic"), (mean / (dev + EPS)).alias("ir"), (mean / (dev / F.sqrt(n) + EPS)).alias("t_stat"),
                  F.avg((F.col("ic") > 0).cast("double")).alias("positive_ratio"), n.alias("n_periods"))


def ic_decay(panel: DataFrame, factor: str, lags: int = 20, least: int = LEAST_NAMES) -> DataFrame:
    """``(lag, mean_ic, n_periods)`` of the factor with the return ``lag`` rows ahead of each stock."""
    stock = Window.partitionBy("stock_id").orderBy("date")
    rows = settled(panel.select("date", F.col(factor).alias("x"), *[F.lead("return", k).over(stock).alias(f"y{k}") for k in range(1, lags + 1)]))
    ic = rank_coefficients(rows, "x", [F.col(f"y{k}") for k in range(1, lags + 1)]).where(F.col("n") >= least)
    return ic.groupBy((F.col("i") + 1).alias("lag")).agg(F.avg("ic").alias("mean_ic"), F.count("ic").alias("n_periods"))


def half_life(decay: DataFrame) -> DataFrame:
    """One row: the first lag whose mean falls under half of the first one's, null if none does."""
    first = F.max(F.when(F.col("lag") == 1, F.abs("mean_ic"))).over(Window.partitionBy())  # one row per lag
    return decay.select("lag", (F.abs("mean_ic") < first / 2).alias("under")).agg(F.min(F.when(F.col("under"), F.col("lag"))).alias("half_life"))


def bucketed(panel: DataFrame, factor: str, groups: int, ret: str = "forward_1d_ret", least: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """``(date, stock_id, grp, r, keep..)`` of dates with five names a bucket or more."""
    pairs = panel.select("date", "stock_id", F.col(factor).alias("x"), F.col(ret).alias("r"), *keep).where("x is not null and r is not null")
    sizes = pairs.groupBy("date").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= (5 * groups if least is None else least))
    return with_cross(pairs.join(sizes, "date", "left_semi"), {"grp": bucket(F.col("x"), groups)}).select("date", "stock_id", "grp", "r", *keep)


def group_returns(panel: DataFrame, factor: str, groups: int = 5, ret: str = "forward_1d_ret", weight: str | None = None) -> DataFrame:
    """``(date, grp, ret)``, equally weighted or by ``weight`` where its sum is positive."""
    return bucket_returns(bucketed(panel, factor, groups, ret, keep=[weight] if weight else []), weight)


def bucket_returns(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """``group_returns`` of rows that have their buckets."""
    mean = F.avg("r")
    if weight:
        total = F.sum(weight)
        mean = F.when(total > 0, F.try_divide(F.sum(F.col("r") * F.col(weight)), total)).otherwise(mean)
    return rows.groupBy("date", "grp").agg(mean.alias("ret"))


def membership_turnover(panel: DataFrame, factor: str, groups: int = 5, ret: str = "forward_1d_ret") -> DataFrame:
    """``(date, grp, turnover)``: Jaccard distance of a bucket's names from those of the date before; 1 where it was absent, null on the first date.

    Names are joined with themselves one date on, so no bucket's names meet in one row.
    """
    return bucket_turnover(bucketed(panel, factor, groups, ret))


def bucket_turnover(rows: DataFrame) -> DataFrame:
    """``membership_turnover`` of rows that have their buckets."""
    rows = rows.select("date", "grp", "stock_id")
    dates = rows.select("date").distinct()
    order = dates.select("date", F.lag("date").over(Window.orderBy("date")).alias("before"))  # one row per date
    now = rows.groupBy("date", "grp").agg(F.count(F.lit(1)).alias("n"))
    kept = rows.join(order, "date").alias("a").join(
        rows.alias("b"), (F.col("a.before") == F.col("b.date")) & (F.col("a.grp") == F.col("b.grp")) & (F.col("a.stock_id") == F.col("b.stock_id")))
    kept = kept.groupBy(F.col("a.date").alias("date"), F.col("a.grp").alias("grp")).agg(F.count(F.lit(1)).alias("both"))
    was = now.select(F.col("date").alias("before"), "grp", F.col("n").alias("m"))
    joined = now.join(order, "date").join(was, ["before", "grp"], "left").join(kept, ["date", "grp"], "left")
    both = F.coalesce("both", F.lit(0))
    return joined.select("date", "grp", F.when(F.col("before").isNotNull(), F.when(F.col("m").isNull(), 1.0).otherwise(1 - both / (F.col("n") + F.col("m") - both))).alias("turnover"))


def net_group_returns(panel: DataFrame, factor: str, groups: int = 5, bps: float = 10.0) -> DataFrame:
    """Bucket returns less ``bps`` on the names exchanged; the first date is free."""
    rows = settled(bucketed(panel, factor, groups))
    return bucket_returns(rows).join(bucket_turnover(rows), ["date", "grp"]).select(
        "date", "grp", (F.col("ret") - F.coalesce("turnover", F.lit(0.0)) * (bps / 1e4)).alias("ret"))


def long_short(returns: DataFrame) -> DataFrame:
    """``(date, ret)``: highest bucket less lowest bucket of the whole run; null where a date lacks one."""
    ends = returns.agg(F.min("grp").alias("low"), F.max("grp").alias("high"))
    spread = returns.crossJoin(F.broadcast(ends))  # one row
    side = lambda c: F.max(F.when(F.col("grp") == F.col(c), F.col("ret")))
    return spread.groupBy("date").agg((side("high") - side("low")).alias("ret"))


def group_summary(returns: DataFrame) -> DataFrame:
    """``(grp, daily_mean, annual_mean, annual_std, sharpe)``."""
    mean, dev = F.avg("ret"), F.stddev_samp("ret")
    return returns.groupBy("grp").agg(mean.alias("daily_mean"), (mean * YEAR).alias("annual_mean"), (dev * F.sqrt(F.lit(YEAR))).alias("annual_std"),
                                      (mean * YEAR / (dev * F.sqrt(F.lit(YEAR)) + EPS)).alias("sharpe"))


def regressions(panel: DataFrame, factor: str, ret: str = "forward_1d_ret", least: int = 12) -> DataFrame:
    """``(date, slope, intercept, r2)`` of each date's regression of returns on one factor."""
    pairs = panel.select("date", F.col(factor).alias("x"), F.col(ret).alias("y")).where("x is not null and y is not null")
    out = pairs.groupBy("date").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.count(F.lit(1)).alias("n"))
    return out.where((F.col("n") >= least) & F.col("slope").isNotNull()).drop("n")


#: Dates whose factors a task holds before it hands them on, and pieces in which a date's factors are merged first.
HELD_DATES, MERGED_APART = 4096, 16


def _triangle(rows: np.ndarray) -> np.ndarray:
    """The upper triangle R of rows = QR, with as many rows as columns at most: all that least squares needs of the rows."""
    return np.linalg.qr(rows, mode="r")


def _merged(parts: Sequence[np.ndarray], width: int) -> np.ndarray:
    return _triangle(np.concatenate([np.asarray(p, dtype=float).reshape(-1, width) for p in parts]))


def many_regressions(panel: DataFrame, factors: Sequence[str], ret: str = "forward_1d_ret") -> DataFrame:
    """``(date, coefficients array)`` with intercept first; each date's least squares of least norm, null dates included.

    A task turns its rows of a date into a triangle of the size of the
    factors; triangles are merged in two steps, so a date's rows never meet in
    one task and no product of columns loses digits. Directions that are
    nothing beside the greatest one, as by repeated columns, get no weight.
    Rows with a null or NaN value are left out, and dates with fewer than
    2 k + 10 rows.
    """
    k = len(factors)
    width = k + 2
    rows = panel.select("date", *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(factors)], F.col(ret).cast("double").alias("y")).na.drop(subset=[*[f"x{i}" for i in range(k)], "y"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            dates, parts = pa.array(list(held), kind), list(held.values())
            return pa.RecordBatch.from_arrays([dates, pa.array([r.ravel() for r, _ in parts], pa.list_(pa.float64())), pa.array([n for _, n in parts], pa.int64())], names=["date", "r", "n"])

        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            codes = b.column(0).dictionary_encode(null_encoding="encode")
            code = codes.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            x = np.column_stack([np.ones(b.num_rows), *[b.column(1 + i).to_numpy() for i in range(k + 1)]])[order]
            ends = np.append(np.flatnonzero(np.diff(code[order])) + 1, len(order))
            names = codes.dictionary.to_pylist()
            for a, e in zip([0, *ends[:-1]], ends, strict=True):
                if e > a:
                    date = names[code[order[a]]]
                    before, n = held.get(date, (np.zeros((0, width)), 0))
                    held[date] = (_triangle(np.concatenate([before, x[a:e]])), n + int(e - a))
            if len(held) > HELD_DATES:
                yield out()
                held.clear()
        if held:
            yield out()

    def merge(group: pa.Table) -> pa.Table:
        r = _merged(group.column("r").to_pylist(), width)
        return pa.table({"date": group.column("date").slice(0, 1), "r": pa.array([r.ravel()], pa.list_(pa.float64())), "n": pa.array([pa.compute.sum(group.column("n")).as_py()], pa.int64())})

    def solve(group: pa.Table) -> pa.Table:
        r, n = _merged(group.column("r").to_pylist(), width), pa.compute.sum(group.column("n")).as_py()
        if n < 2 * k + 10:
            return pa.table({"date": group.column("date").slice(0, 0), "coefficients": pa.array([], pa.list_(pa.float64()))})
        found = np.linalg.lstsq(r[:, :-1], r[:, -1], rcond=np.finfo(float).eps * max(n, k + 1))[0]
        return pa.table({"date": group.column("date").slice(0, 1), "coefficients": pa.array([found], pa.list_(pa.float64()))})

    kind = rows.schema["date"].dataType
    part = T.StructType([T.StructField("date", kind), T.StructField("r", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])
    parts = rows.mapInArrow(first, part)
    some = parts.groupBy("date", F.pmod(F.xxhash64("r"), F.lit(MERGED_APART)).alias("_p")).applyInArrow(lambda g: merge(g), part)
    return some.groupBy("date").applyInArrow(lambda g: solve(g), T.StructType([T.StructField("date", kind), T.StructField("coefficients", T.ArrayType(T.DoubleType()))]))


def newey_west(series: DataFrame, value: str, most_lags: int = 16) -> DataFrame:
    """``(mean, se, n)`` of a date-indexed series with Bartlett weights over floor(n ** 1/4) lags.

    ``series`` has one row per date, so its order by date is one small window;
    ``most_lags`` lags are prepared, which 17 ** 4 - 1 dates do not exceed.
    """
    e = series.where(F.col(value).isNotNull()).select("date", F.col(value).alias("v"))
    whole, by_date = Window.partitionBy(), Window.orderBy("date")
    e = e.select("date", "v", (F.col("v") - F.avg("v").over(whole)).alias("e"), F.count("v").over(whole).alias("t"))
    lags = F.greatest(F.lit(0), F.least(F.floor(F.pow(F.col("t"), F.lit(0.25)) + 1e-9), F.col("t") - 2))
    terms = e.select("v", "e", "t", lags.alias("l"), *[(F.col("e") * F.lag("e", k).over(by_date)).alias(f"g{k}") for k in range(1, most_lags + 1)])
    n, l = F.max("t"), F.max("l")  # noqa: E741
    var = F.avg(F.col("e") * F.col("e"))
    for k in range(1, most_lags + 1):
        var = var + F.when(l >= k, 2 * (1 - k / (l + 1)) * F.coalesce(F.avg(f"g{k}"), F.lit(0.0))).otherwise(0.0)
    se = F.when(var > 0, F.sqrt(F.try_divide(var, n))).otherwise(F.try_divide(F.stddev_pop("v"), F.sqrt(n)))
    return terms.agg(F.avg("v").alias("mean"), se.alias("se"), F.count("v").alias("n"))


def fama_macbeth(panel: DataFrame, factor: str, ret: str = "forward_1d_ret") -> DataFrame:
    """One row ``(mean_coef, se, t_stat, avg_r2, n_periods)``."""
    fits = regressions(panel, factor, ret)
    nw = newey_west(fits, "slope").select(F.col("mean").alias("mean_coef"), "se", (F.col("mean") / (F.col("se") + EPS)).alias("t_stat"), F.col("n").alias("n_periods"))
    return nw.crossJoin(F.broadcast(fits.agg(F.avg("r2").alias("avg_r2"))))  # one row each


def factor_correlation(panel: DataFrame, factors: Sequence[str], least: int = 10) -> DataFrame:
    """``(left_factor, right_factor, rho, n_periods)``: mean over dates of rank correlations, each pair over its complete rows.

    One frame holds the rows of all pairs, ranked once within pair and date.
    """
    pairs = [F.struct(F.lit(a).alias("left_factor"), F.lit(b).alias("right_factor"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in combinations(factors, 2)]
    rows = panel.select("date", F.explode(F.array(*pairs)).alias("p")).select("date", "p.*").where("x is not null and y is not null")
    by = ("left_factor", "right_factor", "date")
    ranked = with_cross(rows, {"x": pct_rank(F.col("x")), "y": pct_rank(F.col("y"))}, by)
    per_day = ranked.groupBy(*by).agg(correlation(F.col("x"), F.col("y")).alias("rho"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    found = per_day.groupBy("left_factor", "right_factor").agg(F.avg("rho").alias("rho"), F.count("rho").alias("n_periods"))
    every = panel.sparkSession.createDataFrame(list(combinations(factors, 2)), "left_factor string, right_factor string")
    return every.join(found, ["left_factor", "right_factor"], "left").withColumn("n_periods", F.coalesce("n_periods", F.lit(0)))
