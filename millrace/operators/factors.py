"""The factor registry: each factor as one Spark column of a stock panel."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from millrace.operators.tails import moving_tail, moving_ulcer

EPS = 1e-10
YEAR, LEAST = 252, 60


@dataclass(frozen=True)
class Factor:
    """``requires`` names the columns without which the factor is null; ``kind`` is cross or ts."""

    requires: tuple[str, ...]
    kind: str
    build: Callable[[], Column]
    given: tuple[str, Callable[[], Column]] | None = None  # a column that, where the panel has it, makes the factor by itself


def stock() -> WindowSpec:
    """Windows need a session, so they are made when asked for."""
    return Window.partitionBy("stock_id").orderBy("date")


def last(n: int) -> WindowSpec:
    return stock().rowsBetween(1 - n, 0)


def rolling(agg, x: Column, n: int, least: int) -> Column:
    """``agg`` over the last ``n`` rows, null under ``least`` values."""
    return F.when(F.count(x).over(last(n)) >= least, agg(x).over(last(n)))


def lag(x: Column, n: int = 1) -> Column:
    return F.lag(x, n).over(stock())


def delta(x: Column) -> Column:
    return x - lag(x)


def change(x: Column, n: int) -> Column:
    return F.try_divide(x, lag(x, n)) - 1


def over(top: Column, bottom: Column) -> Column:
    return F.try_divide(top, bottom)


def momentum(lookback: int, skip: int = 21) -> Column:
    close = F.col("close")
    return over(lag(close, skip), lag(close, skip + lookback)) - 1


def rsi(n: int = 14) -> Column:
    d = delta(F.col("close"))
    gain = F.when(d.isNotNull(), F.greatest(d, F.lit(0.0)))
    loss = F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0)))
    return 100 - F.lit(100.0) / (1 + rolling(F.avg, gain, n, n // 2) / (rolling(F.avg, loss, n, n // 2) + EPS))


def bollinger(n: int = 20) -> Column:
    close = F.col("close")
    mean, dev = rolling(F.avg, close, n, n // 2), rolling(F.stddev_samp, close, n, n // 2)
    return (close - (mean - 2 * dev)) / (4 * dev + EPS)


def whole() -> WindowSpec:
    return Window.partitionBy("stock_id")


def frame_sums(n: int, **terms: Column) -> Column:
    """A struct of the sums of ``terms`` over the last ``n`` rows, nulls left out: differences of sums so far.

    Each row costs the same whatever ``n``. Sums of m terms of size M at most
    are off by up to 2 m**2 M 2**-53, and by about the root of m in place of m
    for terms of either sign, so terms should be centred.
    """
    so_far = stock().rowsBetween(Window.unboundedPreceding, 0)
    now = F.struct(*[F.sum(F.coalesce(v.cast("double"), F.lit(0.0))).over(so_far).alias(k) for k, v in terms.items()])
    ends = F.struct(now.alias("now"), F.lag(now, n).over(stock()).alias("then"))
    minus = lambda e: F.struct(*[(e["now"][k] - F.coalesce(e["then"][k], F.lit(0.0))).alias(k) for k in terms])
    return F.transform(F.array(ends), minus)[0]


def from_sums(sums: Column, formula: Callable[[Column], Column]) -> Column:
    """``formula`` of the struct ``sums``, which is computed once."""
    return F.transform(F.array(sums), formula)[0]


def known(x: Column) -> Column:
    return F.when(x.isNotNull(), 1.0)


def moving_mean(x: Column, n: int, least: int) -> Column:
    """Mean of the last ``n`` rows' values, null under ``least``; the sums are of differences from the whole mean."""
    mean = F.avg(x).over(whole())
    return from_sums(frame_sums(n, c=known(x), x=x - mean), lambda s: F.when(s["c"] >= least, s["x"] / s["c"])) + mean


def moving_dev(x: Column, n: int, least: int) -> Column:
    """Deviation of the last ``n`` rows' values, null under ``least``."""
    off = x - F.avg(x).over(whole())
    return from_sums(frame_sums(n, c=known(off), x=off, xx=off * off), lambda s: F.when(s["c"] >= least, F.sqrt(F.greatest((s["xx"] - s["x"] * s["x"] / s["c"]) / (s["c"] - 1), F.lit(0.0)))))


def market() -> Column:
    """The stock's own mean return so far, which stands for the market where no market return is given."""
    return F.avg("return").over(stock().rowsBetween(Window.unboundedPreceding, 0))


def beta(x: Column, y: Column, n: int = YEAR, least: int = LEAST) -> Column:
    """Rolling slope of ``x`` on ``y`` over complete pairs; null unless ``y`` varies."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    a, b = x - F.avg(x).over(whole()), y - F.avg(y).over(whole())

    def slope(s: Column) -> Column:
        spread, joint = s["bb"] - s["b"] * s["b"] / s["c"], s["ab"] - s["a"] * s["b"] / s["c"]
        return F.when((s["c"] >= least) & (spread / (s["c"] - 1) > EPS), joint / spread)

    return from_sums(frame_sums(n, c=known(b), a=a, b=b, ab=a * b, bb=b * b), slope)


def beta_down(mkt: Column | None = None) -> Column:
    mkt = market() if mkt is None else mkt
    down = mkt < rolling(F.avg, mkt, YEAR, YEAR)
    return beta(F.when(down, F.col("return")), F.when(down, mkt))


def residual_risk(mkt: Column) -> Column:
    return moving_dev(F.col("return") - beta(F.col("return"), mkt) * mkt, YEAR, LEAST)


def comoment(power: int) -> Column:
    """Rolling co-skewness (2) or co-kurtosis (3) of returns centred on their whole mean."""
    ret, mkt = F.col("return"), market()
    a, b = ret - F.avg(ret).over(whole()), mkt - F.avg(mkt).over(whole())
    product = a * b * b if power == 2 else a * b * b * b

    def of(s: Column) -> Column:
        dev = lambda x, xx: F.sqrt(F.greatest((s[xx] - s[x] * s[x] / s["c"]) / (s["c"] - 1), F.lit(0.0)))
        sa, sb = dev("a", "aa"), dev("b", "bb")
        scale = F.pow(sa, F.lit(1.5)) * sb if power == 2 else F.sqrt(sa * sa * sb * sb)
        return F.when(s["c"] >= LEAST, s["p"] / s["c"] / (scale + EPS))

    return from_sums(frame_sums(YEAR, c=known(a), a=a, b=F.when(a.isNotNull(), b), aa=a * a, bb=F.when(a.isNotNull(), b * b), p=product), of)


def tail(share: float, mean: bool) -> Column:
    """The ``share`` quantile of the rolling returns, or the mean of those that are at most that.

    A frame is sorted once; both come from the head of the sorted array.
    """
    ret = F.col("return")

    def of(low_first: Column) -> Column:
        at = (F.size(low_first) - 1) * F.lit(share)
        low = F.floor(at).cast("int")
        before, after = F.get(low_first, low), F.get(low_first, low + 1)
        cut = F.when((at == low) | (before == after), before).otherwise((low + 1 - at) * before + (at - low) * after)
        if not mean:
            return cut
        added = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x, lambda a: a / F.size(xs))
        plain = after.isNull() | (after > cut)  # else returns equal to the cut go on behind it
        return F.when(plain, added(F.slice(low_first, 1, low + 1))).otherwise(added(F.filter(low_first, lambda x: x <= cut)))

    frame = F.sort_array(F.collect_list(ret).over(last(YEAR)))
    return F.when(F.count(ret).over(last(YEAR)) >= LEAST, F.transform(F.array(frame), of)[0])


def ulcer(n: int = 126, least: int = 30) -> Column:
    close = F.col("close")
    peak = rolling(F.max, close, n, least)
    drop = over(close - peak, peak)
    return F.sqrt(rolling(F.avg, drop * drop, n, least))


def working_accruals(fill: bool) -> Column:
    d = lambda c: F.coalesce(delta(F.col(c)), F.lit(0.0)) if fill else delta(F.col(c))
    return d("current_assets") - d("cash") - d("current_liabilities") + d("short_term_debt")


def accruals() -> Column:
    return over(working_accruals(True) - F.coalesce("depreciation", F.lit(0.0)), F.col("total_assets"))


def altman() -> Column:
    c, ta = F.col, F.col("total_assets")
    return (1.2 * over(c("current_assets") - c("current_liabilities"), ta) + 1.4 * over(c("retained_earnings"), ta)
            + 3.3 * over(c("operating_income"), ta) + 0.6 * over(c("market_cap"), c("total_liabilities")) + 0.99 * over(c("sales"), ta))


def piotroski() -> Column:
    c, ta = F.col, F.col("total_assets")
    roa, lev = over(c("net_income"), ta), over(c("total_liabilities"), ta)
    current, margin = over(c("current_assets"), c("current_liabilities")), over(c("gross_profit"), c("sales"))
    points = [roa > 0, over(c("cfo"), ta) > 0, delta(roa) > 0, accruals() < 0, delta(lev) < 0, delta(current) > 0,
              delta(c("sales")) > 0, delta(margin) > 0, change(ta, 4) < 0]
    return sum((F.when(p, 1).otherwise(0) for p in points), F.lit(0))


def _ratio(top: str, bottom: str) -> Factor:
    return Factor((top, bottom), "cross", lambda: over(F.col(top), F.col(bottom)))


def _size() -> Column:
    return F.when(F.col("market_cap").isNotNull(), F.log(F.greatest(F.col("market_cap"), F.lit(1e-6))))


def _growth(column: str) -> Factor:
    return Factor((column,), "ts", lambda: change(F.col(column), 4))


def _shares_traded() -> Column:
    return over(F.col("volume"), F.col("shares_outstanding"))


BALANCE = ("current_assets", "cash", "current_liabilities", "short_term_debt")
REGISTRY: dict[str, Factor] = {
    "size": Factor(("market_cap",), "cross", _size),
    "bm": _ratio("book_equity", "market_cap"),
    "ep": _ratio("net_income", "market_cap"),
    "sp": _ratio("sales", "market_cap"),
    "gp_assets": _ratio("gross_profit", "total_assets"),
    "roe": _ratio("net_income", "book_equity"),
    "roa": _ratio("net_income", "total_assets"),
    "roic": Factor(("net_income", "total_debt", "book_equity"), "cross", lambda: over(F.col("net_income"), F.col("total_debt") + F.col("book_equity"))),
    "gp_ratio": _ratio("gross_profit", "sales"),
    "op_margin": _ratio("operating_income", "sales"),
    "net_pm": _ratio("net_income", "sales"),
    "cfo_ta": _ratio("cfo", "total_assets"),
    "lev": _ratio("total_liabilities", "total_assets"),
    "ch_ep": _ratio("net_income", "market_cap"),
    "ch_turnover": Factor(("volume", "shares_outstanding"), "cross", _shares_traded, ("turnover", lambda: F.col("turnover"))),
    "q_roe": _ratio("net_income", "book_equity"),
    "ch_size": Factor(("market_cap",), "cross", _size),
    "q_ia": _growth("total_assets"),
    "q_eg": Factor(("sales", "net_income", "book_equity"), "ts", lambda: change(F.col("sales"), 4) * over(F.col("net_income"), F.col("book_equity"))),
    "interest_cov": Factor(("operating_income", "total_liabilities"), "ts", lambda: over(F.col("operating_income"), F.col("total_liabilities"))),
    "earn_quality": Factor((*BALANCE, "cfo"), "ts", lambda: 1 - F.abs(over(working_accruals(False), F.abs("cfo")))),
    "net_debt_issue": _growth("total_liabilities"),
    "momentum_12m": Factor(("close",), "ts", lambda: momentum(252)),
    "momentum_6m": Factor(("close",), "ts", lambda: momentum(126)),
    "st_reversal_1w": Factor(("close",), "ts", lambda: change(F.col("close"), 5)),
    "st_reversal_1m": Factor(("close",), "ts", lambda: change(F.col("close"), 21)),
    "beta": Factor(("return",), "ts", lambda: beta(F.col("return"), market()), ("mkt_return", lambda: beta(F.col("return"), F.col("mkt_return")))),
    "coskewness": Factor(("return",), "ts", lambda: comoment(2)),
    "cokurtosis": Factor(("return",), "ts", lambda: comoment(3)),
    "max_ret_1m": Factor(("return",), "ts", lambda: rolling(F.max, F.col("return"), 21, 10)),
    "var_95": Factor(("return",), "ts", lambda: tail(0.05, mean=False)),
    "cvar_95": Factor(("return",), "ts", lambda: tail(0.05, mean=True)),
    "ulcer_index": Factor(("close",), "ts", ulcer),
    "ivol_capm": Factor(("return",), "ts", lambda: residual_risk(market()), ("mkt_return", lambda: residual_risk(F.col("mkt_return")))),
    "rsi_14": Factor(("close",), "ts", rsi),
    "bb_width": Factor(("close",), "ts", bollinger),
    "amihud_illiq": Factor(("return", "close", "volume"), "ts", lambda: 1e6 * moving_mean(F.abs("return") / (F.col("close") * F.col("volume") + EPS), YEAR, LEAST)),
    "turnover": Factor(("volume", "shares_outstanding"), "ts", lambda: rolling(F.avg, _shares_traded(), 21, 5), ("turnover", lambda: rolling(F.avg, F.col("turnover"), 21, 5))),
    "dollar_volume": Factor(("close", "volume"), "ts", lambda: F.log(rolling(F.avg, F.col("close") * F.col("volume"), 21, 5))),
    "accruals": Factor((*BALANCE, "depreciation", "total_assets"), "ts", accruals),
    "asset_growth": _growth("total_assets"),
    "sales_growth": _growth("sales"),
    "z_score": Factor(("current_assets", "current_liabilities", "total_assets", "retained_earnings", "operating_income", "market_cap", "total_liabilities", "sales"), "ts", altman),
    "f_score": Factor((*BALANCE, "net_income", "cfo", "depreciation", "total_assets", "total_liabilities", "gross_profit", "sales"), "ts", piotroski),
    "overnight_return": Factor(("open", "close"), "ts", lambda: over(F.col("open"), lag(F.col("close"))) - 1),
    "beta_down": Factor(("return",), "ts", beta_down, ("mkt_return", lambda: beta_down(F.col("mkt_return")))),
    "forward_1d_ret": Factor(("return",), "ts", lambda: F.lead("return").over(stock())),
}


def register_factor(name: str, requires: tuple[str, ...], kind: str, build: Callable[[], Column]) -> None:
    """Add a factor; ``build`` returns a column of the panel."""
    REGISTRY[name] = Factor(requires, kind, build)


def factor(panel: DataFrame, name: str) -> Column:
    """The factor over ``panel``; a null column if the panel lacks what it requires."""
    spec = REGISTRY[name]
    if spec.given and spec.given[0] in panel.columns:
        return spec.given[1]()
    return spec.build() if set(spec.requires) <= set(panel.columns) else F.lit(None).cast("double")


#: Factors from a sorted window, which is no column: what they need and the frame that has them.
MOVING = {"var_95": ("return", moving_tail), "cvar_95": ("return", moving_tail), "ulcer_index": ("close", moving_ulcer)}


def _stages(panel: DataFrame) -> dict[str, tuple[list[tuple[str, Callable[[], Column]]], Callable[[], Column]]]:
    """Factors whose windows lie within windows: columns that are added one by one, and the factor over them."""
    own = "mkt_return" not in panel.columns
    mkt = ("_mkt", market if own else lambda: F.col("mkt_return"))
    down = ("_down", lambda: F.when(F.col("_mkt") < rolling(F.avg, F.col("_mkt"), YEAR, YEAR), F.col("_mkt")))
    slope = ("_slope", lambda: beta(F.col("return"), F.col("_mkt")))
    return {
        "beta": ([mkt], lambda: beta(F.col("return"), F.col("_mkt"))),
        "beta_down": ([mkt, down], lambda: beta(F.when(F.col("_down").isNotNull(), F.col("return")), F.col("_down"))),
        "ivol_capm": ([mkt, slope, ("_rest", lambda: F.col("return") - F.col("_slope") * F.col("_mkt"))], lambda: moving_dev(F.col("_rest"), YEAR, LEAST)),
    }


def compute_factors(panel: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``(stock_id, date, factors..)``: all windows share one partitioning, so one shuffle by stock.

    Those of ``MOVING`` come from frames of their own, joined by stock and
    date; with them a panel has one row of these.
    """
    names = list(REGISTRY) if names is None else names
    apart = {n for n in names if n in MOVING and MOVING[n][0] in panel.columns}
    staged = {n: s for n, s in _stages(panel).items() if n in names and "return" in panel.columns}
    wide = panel
    for name, made in dict(column for steps, _ in staged.values() for column in steps).items():
        wide = wide.withColumn(name, made())
    column = lambda n: staged[n][1]() if n in staged else factor(panel, n)
    out = wide.select("stock_id", "date", *[column(n).cast("double").alias(n) for n in names if n not in apart])
    for make in dict.fromkeys(MOVING[n][1] for n in names if n in apart):
        own = [n for n in names if n in apart and MOVING[n][1] is make]
        frame = make(panel).select("stock_id", "date", *own)
        out = frame if len(own) == len(names) else out.join(frame, ["stock_id", "date"], "left")
    return out.select("stock_id", "date", *names)
