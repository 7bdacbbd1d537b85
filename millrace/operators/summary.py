"""Tests of many factors at once, from one long frame: coefficients, bucket portfolios, regressions and their summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.cross import bucket, pct_rank, with_cross
from millrace.operators.coefficients import rank_coefficients
from millrace.operators.testing import EPS, LEAST_NAMES, YEAR, correlation
from millrace.sources.scratch import settled


def long_factors(panel: DataFrame, factors: Sequence[str], ret: str = "forward_1d_ret") -> DataFrame:
    """``(factor, date, stock_id, x, r)`` of complete pairs."""
    rows = panel.select("date", "stock_id", F.col(ret).alias("r"), *[F.col(f).cast("double").alias(f) for f in factors])
    return rows.unpivot(["date", "stock_id", "r"], list(factors), "factor", "x").where("x is not null and r is not null")


def ic_series(panel: DataFrame, factors: Sequence[str], ret: str = "forward_1d_ret", least: int = 10) -> DataFrame:
    """``(factor, date, ic, n)``: rank coefficients of dates with ``least`` pairs or more."""
    rows = settled(panel.select("date", ret, *[F.col(f).alias(f"_x{i}") for i, f in enumerate(factors)]))
    names = F.array(*map(F.lit, factors))
    out = rank_coefficients(rows, ret, [F.col(f"_x{i}") for i in range(len(factors))]).select(names[F.col("i")].alias("factor"), "date", "ic", "n")
    return out.where((F.col("n") >= least) & F.col("ic").isNotNull())


def scalar_ic(panel: DataFrame, factor: str, ret: str = "forward_1d_ret") -> DataFrame:
    """One row ``(ic, n)``: the rank coefficient of all pairs, whatever their date."""
    pairs = panel.select(F.col(factor).alias("x"), F.col(ret).alias("y")).where("x is not null and y is not null")
    ranked = with_cross(pairs.withColumn("_all", F.lit(0)), {"x": pct_rank(F.col("x")), "y": pct_rank(F.col("y"))}, ("_all",))
    return ranked.agg(correlation(F.col("x"), F.col("y")).alias("ic"), F.count(F.lit(1)).alias("n"))


def rolling_ic(ic: DataFrame, days: int = 22, least: int = 5) -> DataFrame:
    """``ic(factor, date, ic, ..)`` with ``rolling``: its mean over the last ``days`` rows, null under ``least``."""
    frame = Window.partitionBy("factor").orderBy("date").rowsBetween(1 - days, 0)  # one row per factor and date
    return ic.withColumn("rolling", F.when(F.count("ic").over(frame) >= least, F.avg("ic").over(frame)))


def group_returns(panel: DataFrame, factors: Sequence[str], groups: int = 5, ret: str = "forward_1d_ret") -> DataFrame:
    """``(factor, date, grp, ret)`` of dates with five names a bucket or more."""
    rows, by = long_factors(panel, factors, ret), ("factor", "date")
    enough = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 5 * groups)
    return with_cross(rows.join(enough, list(by), "left_semi"), {"grp": bucket(F.col("x"), groups)}, by).groupBy(*by, "grp").agg(F.avg("r").alias("ret"))


def long_short(returns: DataFrame) -> DataFrame:
    """``(factor, date, ret)``: each factor's highest bucket less its lowest one; null where a date lacks one."""
    ends = returns.groupBy("factor").agg(F.min("grp").alias("low"), F.max("grp").alias("high"))
    side = lambda c: F.max(F.when(F.col("grp") == F.col(c), F.col("ret")))
    return returns.join(ends, "factor").groupBy("factor", "date").agg((side("high") - side("low")).alias("ret"))


def cumulative(spread: DataFrame) -> DataFrame:
    """``spread(factor, date, ret)`` with ``total``: the product of 1 + ret so far."""
    so_far = Window.partitionBy("factor").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row per factor and date
    return spread.where("ret is not null").withColumn("total", F.product(1 + F.col("ret")).over(so_far))


def spread_summary(spread: DataFrame) -> DataFrame:
    """``(factor, ls_annual, ls_sharpe, ls_t, ls_positive)``."""
    mean, dev, n = F.avg("ret"), F.stddev_samp("ret"), F.count("ret")
    return spread.groupBy("factor").agg((mean * YEAR).alias("ls_annual"), (mean * YEAR / (dev * F.sqrt(F.lit(YEAR)) + EPS)).alias("ls_sharpe"),
                                        (mean / (dev / F.sqrt(n) + EPS)).alias("ls_t"), F.avg((F.col("ret") > 0).cast("double")).alias("ls_positive"))


def regressions(panel: DataFrame, factors: Sequence[str], ret: str = "forward_1d_ret") -> DataFrame:
    """``(factor, date, slope, r2)`` of each date's regression of returns on one factor."""
    out = long_factors(panel, factors, ret).groupBy("factor", "date").agg(F.regr_slope("r", "x").alias("slope"), F.regr_r2("r", "x").alias("r2"), F.count(F.lit(1)).alias("n"))
    return out.where((F.col("n") >= 12) & F.col("slope").isNotNull()).drop("n")


def regression_summary(fits: DataFrame, most_lags: int = 16) -> DataFrame:
    """``(factor, fm_coef, fm_t, fm_r2)`` with Newey-West errors over floor(T ** 1/4) lags, T the factor's dates.

    ``most_lags`` lags are prepared, which 16 ** 4 dates do not exceed.
    """
    by, whole = Window.partitionBy("factor").orderBy("date"), Window.partitionBy("factor")  # one row per factor and date
    e = fits.select("factor", "date", "slope", "r2", (F.col("slope") - F.avg("slope").over(whole)).alias("e"), F.count("slope").over(whole).alias("t"))
    lags = F.greatest(F.lit(0), F.least(F.floor(F.pow(F.col("t"), F.lit(0.25)) + 1e-9), F.col("t") - 2))
    terms = e.select("*", lags.alias("l"), *[(F.col("e") * F.lag("e", k).over(by)).alias(f"g{k}") for k in range(1, most_lags + 1)])
    gamma = [F.coalesce(F.avg(f"g{k}"), F.lit(0.0)) for k in range(1, most_lags + 1)]
    n, l = F.max("t"), F.max("l")  # noqa: E741
    var = F.avg(F.col("e") * F.col("e"))
    for k, g in enumerate(gamma, 1):
        var = var + F.when(l >= k, 2 * (1 - k / (l + 1)) * g).otherwise(0.0)
    se = F.when(var > 0, F.sqrt(var / n)).otherwise(F.stddev_pop("slope") / F.sqrt(n))
    return terms.groupBy("factor").agg(F.avg("slope").alias("fm_coef"), (F.avg("slope") / (se + EPS)).alias("fm_t"), F.avg("r2").alias("fm_r2"))


def test_factors(panel: DataFrame, factors: Sequence[str], groups: int = 10, ret: str = "forward_1d_ret", least: int = LEAST_NAMES) -> DataFrame:
    """One row per factor, best ratio first: coefficients, long-short portfolio and regressions; nulls where too few names allow none."""
    mean, dev, n = F.avg("ic"), F.stddev_samp("ic"), F.count("ic")
    panel = settled(panel.select("date", "stock_id", ret, *factors))
    ic = ic_series(panel, factors, ret, least).groupBy("factor").agg(
        mean.alias("mean_ic"), dev.alias("std_ic"), (mean / (dev + EPS)).alias("ir"), (mean / (dev / F.sqrt(n) + EPS)).alias("ic_t"), F.avg((F.col("ic") > 0).cast("double")).alias("ic_positive"), n.alias("n_periods"))
    names = panel.sparkSession.createDataFrame([(f,) for f in factors], "factor string")
    spread = spread_summary(long_short(group_returns(panel, factors, groups, ret)))
    out = names.join(ic, "factor", "left").join(spread, "factor", "left").join(regression_summary(regressions(panel, factors, ret)), "factor", "left")
    return out.orderBy(F.col("ir").desc_nulls_last(), "factor")


test_factors.__test__ = False  # no test of pytest's


def analysis(summary: DataFrame, ic: float = 0.01, sharpe: float = 0.5, t: float = 1.96, good: float = 0.3, steady: float = 0.55) -> DataFrame:
    """One row on ``test_factors``' rows.

    Numbers of factors with a notable coefficient, portfolio or regression and
    with the first two at once; the factor of the best ratio (of equals the
    first by name) and its Sharpe ratio; those whose coefficient is positive on
    more than ``steady`` of the dates, and the notable ones less these. Quality:
    ``high`` if over ``good`` of all factors have both, ``medium`` if any has,
    else ``low``. Without factors all is null or zero and the quality low.
    """
    high = F.abs("mean_ic") > ic
    strong = F.abs("ls_sharpe") > sharpe
    first = F.struct(F.coalesce(-F.col("ir"), F.lit(float("inf"))).alias("o"), "factor", F.col("ls_sharpe").alias("s"))
    out = summary.agg(F.count(F.lit(1)).alias("n_factors"), F.count_if(high).alias("valid_ic"), F.count_if(strong).alias("valid_sharpe"), F.count_if(F.abs("fm_t") > t).alias("valid_fm"),
                      F.count_if(high & strong).alias("valid_overall"), F.min(first).alias("_b"), F.count_if(F.col("ic_positive") > steady).alias("stable_ic_direction"))
    share = F.try_divide("valid_overall", "n_factors")
    return out.select("n_factors", "valid_ic", "valid_sharpe", "valid_fm", "valid_overall", F.col("_b.factor").alias("best_factor"), F.col("_b.s").alias("best_sharpe"),
                      F.when(share > good, "high").when(F.col("valid_overall") > 0, "medium").otherwise("low").alias("quality"),
                      "stable_ic_direction", (F.col("valid_ic") - F.col("stable_ic_direction")).alias("unstable_ic_direction"))


def best_and_worst(summary: DataFrame, by: str = "ir", best: int = 3, worst: int = 2) -> DataFrame:
    """``(side, factor, value)``: the ``best`` highest and the ``worst`` lowest."""
    rows = summary.where(F.col(by).isNotNull()).select("factor", F.col(by).alias("value"))
    top = rows.orderBy(F.desc("value"), "factor").limit(best).select(F.lit("best").alias("side"), "factor", "value")
    return top.union(rows.orderBy("value", "factor").limit(worst).select(F.lit("worst"), "factor", "value"))


def complete_correlation(panel: DataFrame, factors: Sequence[str], least: int = 10) -> DataFrame:
    """``(left_factor, right_factor, rho, n_periods)`` over rows that have all factors: each is ranked once, one aggregation serves all pairs."""
    rows = panel.select("date", *[F.col(f).cast("double").alias(f) for f in factors]).na.drop()
    ranked = with_cross(rows, {f: pct_rank(F.col(f)) for f in factors})
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    per_day = ranked.groupBy("date").agg(*[correlation(F.col(a), F.col(b)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)], F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    means = per_day.agg(*[F.struct(F.lit(a).alias("left_factor"), F.lit(b).alias("right_factor"), F.avg(f"_{i}").alias("rho"), F.count(f"_{i}").alias("n_periods")).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    return means.select(F.explode(F.array(*[f"_{i}" for i in range(len(pairs))])).alias("p")).select("p.*")


def strong_pairs(correlations: DataFrame, over: float = 0.7) -> DataFrame:
    """Pairs of factors whose coefficient exceeds ``over`` in size."""
    return correlations.where(F.abs("rho") > over)


def mean_turnover(turnover: DataFrame) -> DataFrame:
    """``(date, turnover)``: mean over the buckets of ``turnover(date, grp, turnover)``; the first date has none."""
    return turnover.where("turnover is not null").groupBy("date").agg(F.avg("turnover").alias("turnover"))
