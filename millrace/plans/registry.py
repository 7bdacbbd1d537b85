"""Queries of the factor engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import cross, language
from millrace.operators import mining, portfolio, preparing, summary, testing
from millrace.operators.factors import compute_factors
from millrace.sources import loaders
from millrace.sources.panels import CROSS_SQL, FUNDAMENTALS_ONLY_SQL, FUNDAMENTALS_SQL, PRICE_SQL, cross_panel, daily_closes, fundamentals_panel, price_panel
from millrace.sources.scratch import Scratch
from millrace.streaming.bars import daily_bars
from millrace.streaming.panel import StreamedPanel

Query = Callable[[SparkSession, str], DataFrame]
W = "PARTITION BY stock_id ORDER BY date"
GROUPS = 5


def _roll(agg: str, n: int, least: int, x: str) -> str:
    frame = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} >= {least} THEN {agg.format(x)} {frame} END"


def _beta(x: str, y: str) -> str:
    frame = f"OVER ({W} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({y}) {frame} >= 60 AND var_samp({y}) {frame} > 1e-10 THEN covar_samp({x}, {y}) {frame} / var_samp({y}) {frame} END"


#: Price factors with rolling inputs staged: market proxy, centred returns, peak, cut, slope.
STAGED_PRICE_SQL = f"""{PRICE_SQL},
p1 AS (SELECT *, avg(ret) OVER ({W}) AS mkt, close - lag(close) OVER ({W}) AS d, {_roll("max({})", 126, 30, "close")} AS peak,
       {_roll("quantile_cont({}, 0.05)", 252, 60, "ret")} AS q05 FROM px),
p2 AS (SELECT *, ret - avg(ret) OVER (PARTITION BY stock_id) AS a, mkt - avg(mkt) OVER (PARTITION BY stock_id) AS b,
       CASE WHEN mkt < {_roll("avg({})", 252, 252, "mkt")} THEN mkt END AS down, (close - peak) / peak AS drop, {_beta("ret", "mkt")} AS slope,
       CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS gain, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS loss FROM p1),
p3 AS (SELECT *, CASE WHEN down IS NOT NULL THEN ret END AS downret, ret - slope * mkt AS resid,
       {_roll("stddev_samp({})", 252, 60, "a")} AS sa, {_roll("stddev_samp({})", 252, 60, "b")} AS sb FROM p2)"""

#: Each price factor in DuckDB SQL over ``p3``.
PRICE_FACTORS = {
    "size": "ln(greatest(market_cap, 1e-6))",
    "ch_turnover": "volume / shares_outstanding",
    "momentum_12m": f"lag(close, 21) OVER ({W}) / lag(close, 273) OVER ({W}) - 1",
    "momentum_6m": f"lag(close, 21) OVER ({W}) / lag(close, 147) OVER ({W}) - 1",
    "st_reversal_1w": f"close / lag(close, 5) OVER ({W}) - 1",
    "st_reversal_1m": f"close / lag(close, 21) OVER ({W}) - 1",
    "beta": "slope",
    "beta_down": _beta("downret", "down"),
    "coskewness": _roll("avg({})", 252, 60, "a * b * b") + " / (pow(sa, 1.5) * sb + 1e-10)",
    "cokurtosis": _roll("avg({})", 252, 60, "a * b * b * b") + " / (sqrt(sa * sa * sb * sb) + 1e-10)",
    "max_ret_1m": _roll("max({})", 21, 10, "ret"),
    "var_95": "q05",
    "cvar_95": f"CASE WHEN q05 IS NOT NULL THEN list_avg(list_filter(list(ret) OVER ({W} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW), lambda x: x <= q05)) END",
    "ulcer_index": "sqrt(" + _roll("avg({})", 126, 30, "drop * drop") + ")",
    "ivol_capm": _roll("stddev_samp({})", 252, 60, "resid"),
    "rsi_14": f"100 - 100 / (1 + {_roll('avg({})', 14, 7, 'gain')} / ({_roll('avg({})', 14, 7, 'loss')} + 1e-10))",
    "bb_width": f"(close - ({_roll('avg({})', 20, 10, 'close')} - 2 * {_roll('stddev_samp({})', 20, 10, 'close')})) / (4 * {_roll('stddev_samp({})', 20, 10, 'close')} + 1e-10)",
    "turnover": _roll("avg({})", 21, 5, "volume / shares_outstanding"),
    "dollar_volume": "ln(" + _roll("avg({})", 21, 5, "close * volume") + ")",
    "amihud_illiq": "1e6 * " + _roll("avg({})", 252, 60, "abs(ret) / (close * volume + 1e-10)"),
    "overnight_return": f"open / lag(close) OVER ({W}) - 1",
    "forward_1d_ret": f"lead(ret) OVER ({W})",
}

#: Statement factors with changes staged.
STAGED_FUNDAMENTALS_SQL = f"""{FUNDAMENTALS_SQL},
f1 AS (SELECT *, current_assets - lag(current_assets) OVER w AS dca, cash - lag(cash) OVER w AS dcash, current_liabilities - lag(current_liabilities) OVER w AS dcl,
       short_term_debt - lag(short_term_debt) OVER w AS dstd, net_income / nullif(total_assets, 0) AS roa, total_liabilities / nullif(total_assets, 0) AS lev,
       current_assets / nullif(current_liabilities, 0) AS cr, gross_profit / nullif(sales, 0) AS gm FROM fx WINDOW w AS ({W})),
f2 AS (SELECT *, (coalesce(dca, 0) - coalesce(dcash, 0) - coalesce(dcl, 0) + coalesce(dstd, 0) - coalesce(depreciation, 0)) / nullif(total_assets, 0) AS acc FROM f1)"""


def _growth(x: str) -> str:
    return f"{x} / nullif(lag({x}, 4) OVER ({W}), 0) - 1"


def _up(x: str, sign: str = ">") -> str:
    return f"CASE WHEN {x} - lag({x}) OVER ({W}) {sign} 0 THEN 1 ELSE 0 END"


STATEMENT_FACTORS = {
    name: f"{top} / nullif({bottom}, 0)"
    for name, top, bottom in (
        ("bm", "book_equity", "market_cap"), ("ep", "net_income", "market_cap"), ("sp", "sales", "market_cap"), ("gp_assets", "gross_profit", "total_assets"),
        ("roe", "net_income", "book_equity"), ("roa", "net_income", "total_assets"), ("roic", "net_income", "(total_debt + book_equity)"),
        ("gp_ratio", "gross_profit", "sales"), ("op_margin", "operating_income", "sales"), ("net_pm", "net_income", "sales"), ("cfo_ta", "cfo", "total_assets"),
        ("lev", "total_liabilities", "total_assets"), ("ch_ep", "net_income", "market_cap"), ("q_roe", "net_income", "book_equity"), ("interest_cov", "operating_income", "total_liabilities"))
} | {
    "ch_size": "ln(greatest(market_cap, 1e-6))",
    "q_ia": _growth("total_assets"),
    "asset_growth": _growth("total_assets"),
    "sales_growth": _growth("sales"),
    "net_debt_issue": _growth("total_liabilities"),
    "q_eg": f"({_growth('sales')}) * net_income / nullif(book_equity, 0)",
    "earn_quality": "1 - abs((dca - dcash - dcl + dstd) / nullif(abs(cfo), 0))",
    "accruals": "acc",
    "z_score": """1.2 * (current_assets - current_liabilities) / nullif(total_assets, 0) + 1.4 * retained_earnings / nullif(total_assets, 0)
        + 3.3 * operating_income / nullif(total_assets, 0) + 0.6 * market_cap / nullif(total_liabilities, 0) + 0.99 * sales / nullif(total_assets, 0)""",
    "f_score": f"""CAST(CASE WHEN roa > 0 THEN 1 ELSE 0 END + CASE WHEN cfo / nullif(total_assets, 0) > 0 THEN 1 ELSE 0 END + {_up('roa')}
        + CASE WHEN acc < 0 THEN 1 ELSE 0 END + {_up('lev', '<')} + {_up('cr')} + {_up('sales')} + {_up('gm')} + CASE WHEN {_growth('total_assets')} < 0 THEN 1 ELSE 0 END AS DOUBLE)""",
}
#: Digits kept where values run to millions, so that sums in another order round alike.
DIGITS = {"bm": 1, "ep": 1, "ch_ep": 1, "sp": 1, "earn_quality": 3, "interest_cov": 4}


def _factor(name: str, panel: Query) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = panel(spark, sf_dir)
        unit = 10.0 ** DIGITS.get(name, 6)
        # quotients of whole hundreds tie at any digit: scaled first, both engines round them alike; adding zero clears the sign of zero
        return compute_factors(rows, [name]).select("stock_id", "date", (F.round(F.col(name) * unit) / unit + 0.0).alias(name))

    return query


def _factor_sql(name: str, sql: str, stages: str, source: str) -> str:
    return f"WITH {stages} SELECT stock_id, date, round(({sql}) * {10.0 ** DIGITS.get(name, 6)}) / {10.0 ** DIGITS.get(name, 6)} + CAST(0 AS DOUBLE) AS {name} FROM {source}"


QUERIES: dict[str, Query] = {f"factor_{n}": _factor(n, price_panel) for n in PRICE_FACTORS}
QUERIES |= {f"factor_{n}": _factor(n, fundamentals_panel) for n in STATEMENT_FACTORS}
ORACLE_SQL: dict[str, str] = {f"factor_{n}": _factor_sql(n, sql, STAGED_PRICE_SQL, "p3") for n, sql in PRICE_FACTORS.items()}
ORACLE_SQL |= {f"factor_{n}": _factor_sql(n, sql, STAGED_FUNDAMENTALS_SQL, "f2") for n, sql in STATEMENT_FACTORS.items()}


def add(sql: str | None = None):
    """Register a function as the query of its name, with its SQL if there is any."""

    def register(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLE_SQL[query.__name__] = sql
        return query

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- cross-sections --------------------------------------------------------------------------


def _cross(value: str) -> str:
    return f"WITH {CROSS_SQL} SELECT stock_id, date, round({value}, 6) AS v FROM xs WHERE f1 IS NOT NULL WINDOW d AS (PARTITION BY date)"


def _of(column) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = cross_panel(spark, sf_dir).where("f1 is not null").select("stock_id", "date", "f1")
        return cross.with_cross(rows, {"v": column(F.col("f1"))}).select("stock_id", "date", F.round("v", 6).alias("v"))

    return query


RANK = "(rank() OVER (PARTITION BY date ORDER BY {x}) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2) / count(*) OVER (PARTITION BY date)"
for _name, _column, _sql in (
    ("cs_pct_rank", cross.pct_rank, RANK.format(x="f1")),
    ("cs_zscore", cross.guarded_zscore, "CASE WHEN coalesce(stddev_samp(f1) OVER d, 0) = 0 THEN f1 * 0 ELSE (f1 - avg(f1) OVER d) / stddev_samp(f1) OVER d END"),
    ("cs_zscore_eps", cross.zscore, "(f1 - avg(f1) OVER d) / (stddev_samp(f1) OVER d + 1e-10)"),
    ("cs_minmax", cross.minmax, "(f1 - min(f1) OVER d) / (max(f1) OVER d - min(f1) OVER d + 1e-10)"),
    ("cs_demean", cross.demean, "f1 - avg(f1) OVER d"),
    ("cs_winsorize", cross.winsorized, "least(greatest(f1, quantile_cont(f1, 0.01) OVER d), quantile_cont(f1, 0.99) OVER d)"),
):
    QUERIES[_name], ORACLE_SQL[_name] = _of(_column), _cross(_sql)


BUCKETS_SQL = f"""{CROSS_SQL},
pairs AS (SELECT date, stock_id, f1 AS x, fwd AS r, volume, count(*) OVER (PARTITION BY date) AS n FROM xs WHERE f1 IS NOT NULL AND fwd IS NOT NULL),
edges AS (SELECT date, list_distinct(quantile_cont(x, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS e FROM pairs WHERE n >= 25 GROUP BY date),
grouped AS (SELECT date, stock_id, r, volume, greatest(len(list_filter(e, lambda v: v < x)) - 1, 0) AS grp FROM pairs JOIN edges USING (date)),
returns AS (SELECT date, grp, avg(r) AS ret FROM grouped GROUP BY ALL)"""


@add(f"WITH {BUCKETS_SQL} SELECT date, stock_id, CAST(grp AS INTEGER) AS grp FROM grouped")
def cs_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testing.bucketed(cross_panel(spark, sf_dir), "f1", GROUPS).select("date", "stock_id", F.col("grp").cast("int").alias("grp"))


def _guarded(x: str) -> str:
    return f"CASE WHEN coalesce(stddev_samp({x}) OVER d, 0) = 0 THEN {x} * 0 ELSE ({x} - avg({x}) OVER d) / stddev_samp({x}) OVER d END"


@add(f"WITH {CROSS_SQL} SELECT stock_id, date, round(0.7 * ({_guarded('f1')}) - 0.3 * ({_guarded('f2')}), 6) AS score FROM xs WINDOW d AS (PARTITION BY date)")
def combined_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cross_panel(spark, sf_dir).select("stock_id", "date", "f1", "f2")
    return cross.combined(rows, ["f1", "f2"], "score", [0.7, 0.3], [1, -1]).select("stock_id", "date", F.round("score", 6).alias("score"))


@add(f"WITH {PRICE_SQL} SELECT date, round(avg(ret), 6) AS ch_mkt FROM px GROUP BY date")
def factor_ch_mkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_panel(spark, sf_dir).groupBy("date").agg(F.round(F.avg("return"), 6).alias("ch_mkt"))


# --- tests of a factor -----------------------------------------------------------------------

IC_SQL = f"""{CROSS_SQL},
pairs AS (SELECT date, f1 AS x, fwd AS y FROM xs WHERE f1 IS NOT NULL AND fwd IS NOT NULL),
ranked AS (SELECT date, {RANK.format(x="x")} AS x, {RANK.format(x="y")} AS y FROM pairs),
ic AS (SELECT * FROM (SELECT date, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS ic, count(*) AS n FROM ranked GROUP BY date) WHERE n >= 30 AND ic IS NOT NULL)"""


@add(f"WITH {IC_SQL} SELECT date, round(ic, 6) AS ic, n FROM ic")
def daily_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(testing.daily_ic(cross_panel(spark, sf_dir), "f1"))


@add(f"""WITH {CROSS_SQL} SELECT date, round(ic, 6) AS ic, n FROM (SELECT date, covar_pop(f1, fwd) / nullif(stddev_pop(f1) * stddev_pop(fwd), 0) AS ic, count(*) AS n
    FROM xs WHERE f1 IS NOT NULL AND fwd IS NOT NULL GROUP BY date) WHERE n >= 30 AND ic IS NOT NULL""")
def daily_ic_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(testing.daily_ic(cross_panel(spark, sf_dir), "f1", method="pearson"))


@add(f"""WITH {IC_SQL} SELECT round(avg(ic), 6) AS mean_ic, round(stddev_samp(ic), 6) AS std_ic, round(avg(ic) / (stddev_samp(ic) + 1e-10), 6) AS ir,
    round(avg(ic) / (stddev_samp(ic) / sqrt(count(ic)) + 1e-10), 6) AS t_stat, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive_ratio, count(ic) AS n_periods FROM ic""")
def ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(testing.ic_summary(testing.daily_ic(cross_panel(spark, sf_dir), "f1")))


@add(f"""WITH {CROSS_SQL},
ahead AS (SELECT date, f1 AS x, k AS lag, lead(ret, k) OVER (PARTITION BY stock_id, k ORDER BY date) AS y FROM xs, (SELECT unnest(range(1, 21)) AS k)),
pairs AS (SELECT * FROM ahead WHERE x IS NOT NULL AND y IS NOT NULL),
ranked AS (SELECT date, lag, rank() OVER (PARTITION BY date, lag ORDER BY x) + (count(*) OVER (PARTITION BY date, lag, x) - 1) / 2 AS x,
           rank() OVER (PARTITION BY date, lag ORDER BY y) + (count(*) OVER (PARTITION BY date, lag, y) - 1) / 2 AS y FROM pairs),
ic AS (SELECT date, lag, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS ic, count(*) AS n FROM ranked GROUP BY date, lag)
SELECT CAST(lag AS INTEGER) AS lag, round(avg(ic), 6) AS mean_ic, count(ic) AS n_periods FROM ic WHERE n >= 30 GROUP BY lag""")
def ic_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(testing.ic_decay(cross_panel(spark, sf_dir), "f1"))


@add(f"WITH {BUCKETS_SQL} SELECT date, CAST(grp AS INTEGER) AS grp, round(ret, 6) AS ret FROM returns")
def group_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(testing.group_returns(cross_panel(spark, sf_dir), "f1", GROUPS))


@add(f"""WITH {BUCKETS_SQL} SELECT date, CAST(grp AS INTEGER) AS grp, round(CASE WHEN sum(volume) > 0 THEN sum(r * volume) / sum(volume) ELSE avg(r) END, 6) AS ret
    FROM grouped GROUP BY date, grp""")
def group_returns_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(testing.group_returns(cross_panel(spark, sf_dir), "f1", GROUPS, weight="volume"))


TURNOVER_SQL = f"""{BUCKETS_SQL},
names AS (SELECT date, grp, list(stock_id) AS ids FROM grouped GROUP BY ALL),
days AS (SELECT date, lag(date) OVER (ORDER BY date) AS before FROM (SELECT DISTINCT date FROM grouped)),
moved AS (SELECT n.date, n.grp, CASE WHEN d.before IS NULL THEN NULL WHEN p.ids IS NULL THEN 1.0
    ELSE 1 - len(list_intersect(n.ids, p.ids)) / len(list_distinct(list_concat(n.ids, p.ids))) END AS turnover
  FROM names n JOIN days d USING (date) LEFT JOIN names p ON p.date = d.before AND p.grp = n.grp)"""


@add(f"WITH {TURNOVER_SQL} SELECT date, CAST(grp AS INTEGER) AS grp, round(turnover, 6) AS turnover FROM moved")
def group_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(testing.membership_turnover(cross_panel(spark, sf_dir), "f1", GROUPS))


@add(f"WITH {TURNOVER_SQL} SELECT date, CAST(grp AS INTEGER) AS grp, round(ret - coalesce(turnover, 0) * 0.001, 6) AS ret FROM returns JOIN moved USING (date, grp)")
def group_returns_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(testing.net_group_returns(cross_panel(spark, sf_dir), "f1", GROUPS))


@add(f"""WITH {BUCKETS_SQL} SELECT date, round(max(CASE WHEN grp = (SELECT max(grp) FROM returns) THEN ret END) - max(CASE WHEN grp = (SELECT min(grp) FROM returns) THEN ret END), 6) AS ret
    FROM returns GROUP BY date""")
def long_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(testing.long_short(testing.group_returns(cross_panel(spark, sf_dir), "f1", GROUPS)))


@add(f"""WITH {BUCKETS_SQL} SELECT CAST(grp AS INTEGER) AS grp, round(avg(ret), 6) AS daily_mean, round(avg(ret) * 252, 6) AS annual_mean, round(stddev_samp(ret) * sqrt(252), 6) AS annual_std,
    round(avg(ret) * 252 / (stddev_samp(ret) * sqrt(252) + 1e-10), 6) AS sharpe FROM returns GROUP BY grp""")
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(testing.group_summary(testing.group_returns(cross_panel(spark, sf_dir), "f1", GROUPS)))


FITS_SQL = f"""{CROSS_SQL},
fits AS (SELECT * FROM (SELECT date, regr_slope(fwd, f1) AS slope, regr_intercept(fwd, f1) AS intercept, regr_r2(fwd, f1) AS r2, count(*) AS n
  FROM xs WHERE f1 IS NOT NULL AND fwd IS NOT NULL GROUP BY date) WHERE n >= 12 AND slope IS NOT NULL)"""


@add(f"WITH {FITS_SQL} SELECT date, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2 FROM fits")
def cross_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(testing.regressions(cross_panel(spark, sf_dir), "f1"))


@add(f"""WITH {FITS_SQL},
size AS (SELECT count(*) AS n, avg(slope) AS m, avg(r2) AS avg_r2, stddev_pop(slope) AS sd, greatest(0, least(CAST(floor(pow(count(*), 0.25)) AS INTEGER), count(*) - 2)) AS l FROM fits),
e AS (SELECT row_number() OVER (ORDER BY date) AS i, slope - m AS e FROM fits, size),
g AS (SELECT k, avg(a.e * b.e) AS g FROM (SELECT unnest(range(0, (SELECT l FROM size) + 1)) AS k) JOIN e a ON true JOIN e b ON b.i = a.i - k GROUP BY k),
v AS (SELECT sum(CASE WHEN k = 0 THEN g ELSE 2 * (1 - k / (l + 1)) * g END) AS v FROM g, size),
se AS (SELECT *, CASE WHEN v > 0 THEN sqrt(v / n) ELSE sd / sqrt(n) END AS se FROM size, v)
SELECT round(m, 6) AS mean_coef, round(se, 6) AS se, round(m / (se + 1e-10), 6) AS t_stat, n AS n_periods, round(avg_r2, 6) AS avg_r2 FROM se""")
def fama_macbeth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(testing.fama_macbeth(cross_panel(spark, sf_dir), "f1"))


#: Least squares on two factors by centred sums of products.
TWO_SQL = f"""WITH {CROSS_SQL},
c AS (SELECT date, fwd AS y, f1 AS a, f2 AS b FROM xs WHERE fwd IS NOT NULL AND f1 IS NOT NULL AND f2 IS NOT NULL),
s AS (SELECT date, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy FROM c GROUP BY date),
k AS (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS c1, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS c2 FROM s WHERE n >= 14)
SELECT date, round(my - c1 * ma - c2 * mb, 5) + 0.0 AS intercept, round(c1, 5) + 0.0 AS f1, round(c2, 5) + 0.0 AS f2 FROM k"""


@add(TWO_SQL)
def fama_macbeth_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = testing.many_regressions(cross_panel(spark, sf_dir), ["f1", "f2"])
    return c.select("date", *[(F.round(F.col("coefficients")[i], 5) + 0.0).alias(n) for i, n in enumerate(("intercept", "f1", "f2"))])


def _pair_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS left_factor, '{b}' AS right_factor, round(avg(rho), 6) AS rho, count(rho) AS n_periods FROM (
        SELECT date, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS rho, count(*) AS n FROM (
          SELECT date, {RANK.format(x="x")} AS x, {RANK.format(x="y")} AS y FROM (SELECT date, {a} AS x, {b} AS y FROM xs WHERE {a} IS NOT NULL AND {b} IS NOT NULL))
        GROUP BY date) WHERE n >= 10"""


@add(f"WITH {CROSS_SQL} " + " UNION ALL ".join(_pair_sql(*p) for p in (("f1", "f2"), ("f1", "f3"), ("f2", "f3"))))
def factor_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(testing.factor_correlation(cross_panel(spark, sf_dir), ["f1", "f2", "f3"]))


# --- many factors at once, preparation -------------------------------------------------------

NAMES = ["f1", "f2", "f3"]
LONG_SQL = f"""{CROSS_SQL},
lf AS (SELECT * FROM (SELECT date, stock_id, fwd AS r, unnest(['f1', 'f2', 'f3']) AS factor, unnest([f1, f2, f3]) AS x FROM xs) WHERE x IS NOT NULL AND r IS NOT NULL),
lr AS (SELECT factor, date, rank() OVER (PARTITION BY factor, date ORDER BY x) + (count(*) OVER (PARTITION BY factor, date, x) - 1) / 2 AS x,
       rank() OVER (PARTITION BY factor, date ORDER BY r) + (count(*) OVER (PARTITION BY factor, date, r) - 1) / 2 AS r FROM lf),
lic AS (SELECT * FROM (SELECT factor, date, covar_pop(x, r) / nullif(stddev_pop(x) * stddev_pop(r), 0) AS ic, count(*) AS n FROM lr GROUP BY factor, date) WHERE n >= 10 AND ic IS NOT NULL)"""


@add(f"WITH {LONG_SQL} SELECT factor, date, round(ic, 6) AS ic, n, round(CASE WHEN count(ic) OVER w >= 5 THEN avg(ic) OVER w END, 6) AS rolling FROM lic WINDOW w AS (PARTITION BY factor ORDER BY date ROWS BETWEEN 21 PRECEDING AND CURRENT ROW)")
def ic_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.rolling_ic(summary.ic_series(cross_panel(spark, sf_dir), NAMES)))


@add(f"""WITH {CROSS_SQL}, pairs AS (SELECT f1, fwd FROM xs WHERE f1 IS NOT NULL AND fwd IS NOT NULL),
ranked AS (SELECT rank() OVER (ORDER BY f1) + (count(*) OVER (PARTITION BY f1) - 1) / 2 AS x, rank() OVER (ORDER BY fwd) + (count(*) OVER (PARTITION BY fwd) - 1) / 2 AS y FROM pairs)
SELECT round(corr(x, y), 6) AS ic, count(*) AS n FROM ranked""")
def scalar_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.scalar_ic(cross_panel(spark, sf_dir), "f1"))


SPREAD_SQL = f"""{LONG_SQL},
le AS (SELECT factor, date, list_distinct(quantile_cont(x, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS e FROM lf GROUP BY factor, date HAVING count(*) >= 25),
lg AS (SELECT factor, date, greatest(len(list_filter(e, lambda v: v < x)) - 1, 0) AS grp, avg(r) AS ret FROM lf JOIN le USING (factor, date) GROUP BY ALL),
ends AS (SELECT factor, min(grp) AS low, max(grp) AS high FROM lg GROUP BY factor),
ls AS (SELECT factor, date, max(CASE WHEN grp = high THEN ret END) - max(CASE WHEN grp = low THEN ret END) AS ret FROM lg JOIN ends USING (factor) GROUP BY factor, date)"""


@add(f"WITH {SPREAD_SQL}, lc AS (SELECT factor, date, ret / 1000 AS ret FROM ls WHERE ret IS NOT NULL) SELECT factor, date, round(ret, 6) AS ret, round(product(1 + ret) OVER (PARTITION BY factor ORDER BY date), 6) AS total FROM lc")
def long_short_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns are scaled down: those of the panel are too wild to be multiplied."""
    spread = summary.long_short(summary.group_returns(cross_panel(spark, sf_dir), NAMES, GROUPS))
    return rounded(summary.cumulative(spread.withColumn("ret", F.col("ret") / 1000)))


SUMMARY_SQL = f"""{SPREAD_SQL},
i AS (SELECT factor, avg(ic) AS mean_ic, stddev_samp(ic) AS std_ic, avg(ic) / (stddev_samp(ic) + 1e-10) AS ir, avg(ic) / (stddev_samp(ic) / sqrt(count(ic)) + 1e-10) AS ic_t,
      avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS ic_positive, count(ic) AS n_periods FROM lic WHERE n >= 30 GROUP BY factor),
p AS (SELECT factor, avg(ret) * 252 AS ls_annual, avg(ret) * 252 / (stddev_samp(ret) * sqrt(252) + 1e-10) AS ls_sharpe, avg(ret) / (stddev_samp(ret) / sqrt(count(ret)) + 1e-10) AS ls_t,
      avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END) AS ls_positive FROM ls GROUP BY factor),
fit AS (SELECT * FROM (SELECT factor, date, regr_slope(r, x) AS slope, regr_r2(r, x) AS r2, count(*) AS n FROM lf GROUP BY factor, date) WHERE n >= 12 AND slope IS NOT NULL),
sz AS (SELECT factor, count(*) AS t, avg(slope) AS m, avg(r2) AS r2, stddev_pop(slope) AS sd, greatest(0, least(CAST(floor(pow(count(*), 0.25) + 1e-9) AS INTEGER), count(*) - 2)) AS l FROM fit GROUP BY factor),
fe AS (SELECT factor, row_number() OVER (PARTITION BY factor ORDER BY date) AS i, slope - m AS e FROM fit JOIN sz USING (factor)),
fg AS (SELECT a.factor, a.i - b.i AS k, avg(a.e * b.e) AS g FROM fe a JOIN fe b ON a.factor = b.factor AND a.i - b.i BETWEEN 0 AND 16 GROUP BY ALL),
fv AS (SELECT factor, any_value(t) AS t, any_value(m) AS m, any_value(sz.r2) AS r2, any_value(sd) AS sd, sum(CASE WHEN k = 0 THEN g WHEN k <= l THEN 2 * (1 - k / (l + 1)) * g ELSE 0 END) AS v FROM sz JOIN fg USING (factor) GROUP BY factor),
fm AS (SELECT factor, m AS fm_coef, m / (CASE WHEN v > 0 THEN sqrt(v / t) ELSE sd / sqrt(t) END + 1e-10) AS fm_t, r2 AS fm_r2 FROM fv),
summary AS (SELECT * FROM (SELECT unnest(['f1', 'f2', 'f3']) AS factor) LEFT JOIN i USING (factor) LEFT JOIN p USING (factor) LEFT JOIN fm USING (factor))"""
SUMMARY_COLUMNS = ("mean_ic", "std_ic", "ir", "ic_t", "ic_positive", "ls_annual", "ls_sharpe", "ls_t", "ls_positive", "fm_coef", "fm_t", "fm_r2")


@add(f"WITH {SUMMARY_SQL} SELECT factor, n_periods, {', '.join(f'round({c}, 5) AS {c}' for c in SUMMARY_COLUMNS)} FROM summary")
def factor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.test_factors(cross_panel(spark, sf_dir), NAMES, GROUPS), 5)


@add(f"""WITH {SUMMARY_SQL}, first AS (SELECT factor, ls_sharpe FROM summary ORDER BY ir DESC NULLS LAST, factor LIMIT 1),
a AS (SELECT count(*) AS n_factors, count(*) FILTER (abs(mean_ic) > 0.01) AS valid_ic, count(*) FILTER (abs(ls_sharpe) > 0.5) AS valid_sharpe, count(*) FILTER (abs(fm_t) > 1.96) AS valid_fm,
    count(*) FILTER (abs(mean_ic) > 0.01 AND abs(ls_sharpe) > 0.5) AS valid_overall, count(*) FILTER (ic_positive > 0.55) AS stable_ic_direction FROM summary)
SELECT n_factors, valid_ic, valid_sharpe, valid_fm, valid_overall, factor AS best_factor, round(ls_sharpe, 6) AS best_sharpe,
    CASE WHEN valid_overall / n_factors > 0.3 THEN 'high' WHEN valid_overall > 0 THEN 'medium' ELSE 'low' END AS quality, stable_ic_direction, valid_ic - stable_ic_direction AS unstable_ic_direction FROM a, first""")
def results_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.analysis(summary.test_factors(cross_panel(spark, sf_dir), NAMES, GROUPS)))


@add(f"""WITH {SUMMARY_SQL} (SELECT 'best' AS side, factor, round(ir, 5) AS value FROM summary WHERE ir IS NOT NULL ORDER BY ir DESC, factor LIMIT 2)
    UNION ALL (SELECT 'worst' AS side, factor, round(ir, 5) AS value FROM summary WHERE ir IS NOT NULL ORDER BY ir, factor LIMIT 1)""")
def best_and_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.best_and_worst(summary.test_factors(cross_panel(spark, sf_dir), NAMES, GROUPS), best=2, worst=1), 5)


def _complete_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS left_factor, '{b}' AS right_factor, round(avg(rho), 6) AS rho, count(rho) AS n_periods FROM (
        SELECT date, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS rho, count(*) AS n FROM (SELECT date, {RANK.format(x=a)} AS x, {RANK.format(x=b)} AS y FROM whole) GROUP BY date) WHERE n >= 10"""


@add(f"WITH {CROSS_SQL}, whole AS (SELECT date, f1, f2, f3 FROM xs WHERE f1 IS NOT NULL AND f2 IS NOT NULL AND f3 IS NOT NULL) " + " UNION ALL ".join(_complete_sql(*p) for p in (("f1", "f2"), ("f1", "f3"), ("f2", "f3"))))
def complete_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.complete_correlation(cross_panel(spark, sf_dir), NAMES))


@add(f"WITH {TURNOVER_SQL} SELECT date, round(avg(turnover), 6) AS turnover FROM moved WHERE turnover IS NOT NULL GROUP BY date")
def turnover_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary.mean_turnover(testing.membership_turnover(cross_panel(spark, sf_dir), "f1", GROUPS)))


@add(f"""WITH {CROSS_SQL},
ahead AS (SELECT date, f1 AS x, k AS lag, lead(ret, k) OVER (PARTITION BY stock_id, k ORDER BY date) AS y FROM xs, (SELECT unnest(range(1, 21)) AS k)),
ranked AS (SELECT date, lag, rank() OVER (PARTITION BY date, lag ORDER BY x) + (count(*) OVER (PARTITION BY date, lag, x) - 1) / 2 AS x,
           rank() OVER (PARTITION BY date, lag ORDER BY y) + (count(*) OVER (PARTITION BY date, lag, y) - 1) / 2 AS y FROM ahead WHERE x IS NOT NULL AND y IS NOT NULL),
ic AS (SELECT lag, avg(ic) AS m FROM (SELECT date, lag, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS ic, count(*) AS n FROM ranked GROUP BY date, lag) WHERE n >= 30 GROUP BY lag)
SELECT CAST(min(CASE WHEN abs(m) < (SELECT abs(m) FROM ic WHERE lag = 1) / 2 THEN lag END) AS INTEGER) AS half_life FROM ic""")
def ic_half_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testing.half_life(testing.ic_decay(cross_panel(spark, sf_dir), "f1"))


@add(f"""WITH {CROSS_SQL}, b AS (SELECT date, quantile_cont(f1, 0.01) AS low, quantile_cont(f1, 0.99) AS high FROM xs GROUP BY date),
c AS (SELECT stock_id, date, CASE WHEN f1 IS NOT NULL THEN least(greatest(f1, low), high) END AS v FROM xs JOIN b USING (date))
SELECT stock_id, date, round((v - avg(v) OVER d) / (stddev_samp(v) OVER d + 1e-10), 6) AS f1_z FROM c WINDOW d AS (PARTITION BY date)""")
def winsorized_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(preparing.standardized(cross_panel(spark, sf_dir), ["f1"]).select("stock_id", "date", "f1_z"))


@add(f"WITH {CROSS_SQL} SELECT stock_id, date, f3 IS NULL AS gap FROM xs WHERE (f1 IS NOT NULL)::INT + (f2 IS NOT NULL)::INT + (f3 IS NOT NULL)::INT >= 3 AND date = (SELECT max(date) FROM xs)")
def last_complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = preparing.last_cross_section(cross_panel(spark, sf_dir))
    return preparing.enough_factors(rows, NAMES).select("stock_id", "date", F.col("f3").isNull().alias("gap"))


@add(f"WITH {CROSS_SQL} SELECT * FROM (SELECT unnest(['f1', 'f2', 'f3']) AS factor, unnest([count(f1), count(f2), count(f3)]) AS n FROM xs) WHERE n > 100")
def factor_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparing.coverage(cross_panel(spark, sf_dir), NAMES).where("n > 100")


@add(f"WITH {CROSS_SQL} SELECT stock_id, min(date) AS date, round(min_by(f1, date), 6) AS f1 FROM xs WHERE stock_id IN (SELECT DISTINCT stock_id FROM xs ORDER BY stock_id LIMIT 50) GROUP BY stock_id")
def stock_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(preparing.first_per_stock(preparing.first_stocks(cross_panel(spark, sf_dir), 50).select("stock_id", "date", "f1")))


@add(f"""WITH {CROSS_SQL}, k AS (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM xs)) WHERE i % 5 = 0)
SELECT date, round(min(f1), 6) AS low, round(quantile_cont(f1, 0.25), 6) AS q25, round(quantile_cont(f1, 0.5), 6) AS q50, round(quantile_cont(f1, 0.75), 6) AS q75, round(max(f1), 6) AS high, count(f1) AS n
FROM xs WHERE date IN (SELECT date FROM k) GROUP BY date""")
def distribution_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(preparing.distribution(cross_panel(spark, sf_dir), "f1", 5))


# --- portfolios ------------------------------------------------------------------------------


def _clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    ret = F.col("forward_1d_ret")
    return cross_panel(spark, sf_dir).withColumn("forward_1d_ret", F.when(ret.isNotNull(), F.least(F.greatest(ret, F.lit(-0.1)), F.lit(0.1))))


NAV_SQL = f"""{CROSS_SQL},
ok AS (SELECT date, stock_id, f1 AS f, least(greatest(fwd, -0.1), 0.1) AS r FROM xs WHERE f1 IS NOT NULL AND fwd IS NOT NULL),
days AS (SELECT date, min(date) OVER (PARTITION BY date_trunc('week', date)) AS reb, bench FROM (SELECT date, avg(r) AS bench FROM ok GROUP BY date)),
turns AS (SELECT reb, lag(reb) OVER (ORDER BY reb) AS before FROM (SELECT DISTINCT reb FROM days)),
top AS (SELECT date AS reb, stock_id, 1.0 / count(*) OVER (PARTITION BY date) AS w FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY f DESC, stock_id) AS k FROM ok) WHERE k <= 10),
cost AS (SELECT t.reb AS date, CASE WHEN any_value(t.before) IS NULL THEN 1.0 ELSE sum(abs(a.w - coalesce(b.w, 0))) END AS moved
         FROM turns t JOIN top a ON a.reb = t.reb LEFT JOIN top b ON b.reb = t.before AND b.stock_id = a.stock_id GROUP BY t.reb),
gross AS (SELECT d.date, coalesce(sum(w * r), 0) AS g FROM days d JOIN top USING (reb) LEFT JOIN ok ON ok.date = d.date AND ok.stock_id = top.stock_id GROUP BY d.date),
daily AS (SELECT date, g - coalesce(moved, 0) * 0.001 AS ret, bench FROM days JOIN gross USING (date) LEFT JOIN cost USING (date)),
nav AS (SELECT date, ret, product(1 + ret) OVER (ORDER BY date) AS nav, product(1 + bench) OVER (ORDER BY date) AS benchmark_nav FROM daily),
full_nav AS (SELECT *, nav / max(nav) OVER (ORDER BY date) - 1 AS drawdown FROM nav)"""


@add(f"WITH {NAV_SQL} SELECT date, round(ret, 6) AS ret, round(nav, 6) AS nav, round(benchmark_nav, 6) AS benchmark_nav, round(drawdown, 6) AS drawdown FROM full_nav")
def portfolio_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.backtest(_clipped(spark, sf_dir), "f1"))


@add(f"""WITH {NAV_SQL}, a AS (SELECT pow(max_by(nav, date), 252.0 / count(*)) - 1 AS annual, stddev_samp(ret) AS sd, min(drawdown) AS dd, count(*) AS n FROM full_nav)
SELECT round(annual, 4) AS annual_return, round(annual / (sd * sqrt(252)), 4) AS sharpe, round(dd, 4) AS max_drawdown, n AS n_days FROM a""")
def portfolio_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.metrics(portfolio.backtest(_clipped(spark, sf_dir), "f1")), 4)


@add(f"""WITH {CROSS_SQL} SELECT date, stock_id, round(abs(f1) / sum(abs(f1)) OVER (PARTITION BY date), 6) AS w FROM (
    SELECT *, row_number() OVER (PARTITION BY date ORDER BY f1 DESC, stock_id) AS k FROM xs WHERE f1 IS NOT NULL) WHERE k <= 10""")
def value_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.target_weights(cross_panel(spark, sf_dir), "f1", scheme="value"))


@add(f"""WITH {CROSS_SQL} SELECT date, string_agg(stock_id, ',' ORDER BY stock_id) AS names FROM (
    SELECT *, row_number() OVER (PARTITION BY date ORDER BY f1 DESC, stock_id) AS k FROM xs WHERE f1 IS NOT NULL) WHERE k <= 10 GROUP BY date""")
def portfolio_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.holdings(cross_panel(spark, sf_dir), "f1").select("date", F.concat_ws(",", F.transform("names", lambda x: x.cast("string"))).alias("names"))


@add(f"""WITH {PRICE_SQL}, {FUNDAMENTALS_ONLY_SQL}
SELECT px.stock_id, px.date, round(fx.sales, 2) AS sales FROM px ASOF LEFT JOIN fx ON px.stock_id = fx.stock_id AND px.date >= fx.date""")
def point_in_time_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = price_panel(spark, sf_dir).select("stock_id", "date")
    return rounded(portfolio.as_of(prices, fundamentals_panel(spark, sf_dir), "sales"), 2)


# --- language --------------------------------------------------------------------------------

EXPRESSIONS = {
    "dsl_rank_spread": ("cs_rank(f1) - cs_rank(f2)", f"{RANK.format(x='f1')} - {RANK.format(x='f2')}"),
    "dsl_scaled": ("cs_zscore(f1) / (cs_zscore(f2) + 10)",
                   "((f1 - avg(f1) OVER d) / (stddev_samp(f1) OVER d + 1e-10)) / ((f2 - avg(f2) OVER d) / (stddev_samp(f2) OVER d + 1e-10) + 10 + 1e-10)"),
    "dsl_logs": ("max(log_abs(f1), sqrt_abs(f2)) + sign(f1) * square(f2)", "greatest(ln(abs(f1) + 1e-10), sqrt(abs(f2) + 1e-10)) + sign(f1) * f2 * f2"),
    "dsl_delta": ("ts_delta(f1, 3) + ts_delay(f1, 2)", f"f1 - lag(f1, 3) OVER ({W}) + lag(f1, 2) OVER ({W})"),
    "dsl_rolling": ("ts_mean(f1, 5) + ts_max(f1, 5) - ts_min(f1, 5)", " ".join(f"{s} ({_roll(a, 5, 5, 'f1')})" for s, a in (("", "avg({})"), ("+", "max({})"), ("-", "min({})")))),
    "dsl_signs": ("min(abs(neg(f1)), 50) + log(abs(f1) + 1)", "CASE WHEN f1 IS NOT NULL THEN least(abs(f1), 50) END + ln(abs(f1) + 1)"),
    "dsl_sums": ("ts_sum(f1, 4) + ts_return(f1, 2)", f"{_roll('sum({})', 4, 4, 'f1')} + f1 / nullif(lag(f1, 2) OVER ({W}), 0) - 1"),
    "dsl_nested": ("cs_rank(ts_mean(cs_demean(f1), 3))", None),
    "dsl_deviation": ("ts_std(f1, 5)", _roll("stddev_samp({})", 5, 5, "f1")),
    "dsl_correlation": ("ts_corr(f1, volume, 10)", f"CASE WHEN count(f1) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) >= 10 THEN covar_samp(f1, volume) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) / nullif(stddev_samp(f1) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) * stddev_samp(volume) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 0) END"),
}


def _expression(name: str, text: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        panel = cross_panel(spark, sf_dir).select("stock_id", "date", "f1", "f2", F.col("volume").cast("double").alias("volume"))
        return language.evaluate(panel, {"v": text}).select("stock_id", "date", F.round("v", 6).alias("v"))

    return query


for _name, (_text, _sql) in EXPRESSIONS.items():
    QUERIES[_name] = _expression(_name, _text)
    if _sql is not None:
        ORACLE_SQL[_name] = f"WITH {CROSS_SQL} SELECT stock_id, date, round({_sql}, 6) AS v FROM xs WINDOW d AS (PARTITION BY date)"

ORACLE_SQL["dsl_nested"] = f"""WITH {CROSS_SQL}, a AS (SELECT stock_id, date, f1 - avg(f1) OVER (PARTITION BY date) AS x FROM xs),
b AS (SELECT stock_id, date, round({_roll('avg({})', 3, 3, 'x')}, 9) AS x FROM a)
SELECT stock_id, date, CASE WHEN x IS NOT NULL THEN round((rank() OVER (PARTITION BY date ORDER BY x NULLS LAST) + (count(*) OVER (PARTITION BY date, x) - 1) / 2) / count(x) OVER (PARTITION BY date), 6) END AS v FROM b"""


# --- selection, sources ----------------------------------------------------------------------


@add()
def boosted_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importances of second-order and of leaf-wise boosted trees."""
    methods = {m: mining.METHODS[m] for m in ("second_order", "leaf_wise")}
    return mining.mine(cross_panel(spark, sf_dir), NAMES, methods)


@add(f"""WITH {PRICE_SQL}, days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM px)),
size AS (SELECT any_value(n) AS n, greatest(CAST(floor(any_value(n) * 0.5) AS INTEGER), 60) AS s FROM days),
cut AS (SELECT fold, n, s + fold * ((n - s) // 5) AS t, (n - s) // 5 AS w FROM size, (SELECT unnest(range(0, 5)) AS fold))
SELECT CAST(fold AS INTEGER) AS fold, (SELECT max(date) FROM days WHERE i = t - 1) AS train_end, (SELECT max(date) FROM days WHERE i = t) AS test_start,
  (SELECT max(date) FROM days WHERE i = least(t + w, n - 1)) AS test_end FROM cut WHERE t < n - 20""")
def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.walk_forward(price_panel(spark, sf_dir))


#: Formulas whose fitness has SQL, with their values.
SCORED = {
    "cs_rank(f1)": "f1", "cs_rank(f1) - cs_rank(f2)": f"{RANK.format(x='f1')} - {RANK.format(x='f2')}", "square(cs_demean(f1))": "(f1 - avg(f1) OVER d) * (f1 - avg(f1) OVER d)",
}


def _fitness_sql() -> str:
    cols = ", ".join(f"{sql} AS v{i}" for i, sql in enumerate(SCORED.values()))
    one = lambda i, text: f"""SELECT '{text}' AS formula, round(abs(avg(ic)), 6) AS fitness FROM (SELECT date, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS ic, count(*) AS n FROM (
        SELECT date, {RANK.format(x='x')} AS x, {RANK.format(x='y')} AS y FROM (SELECT date, round(v{i}, 9) AS x, fwd AS y FROM v WHERE v{i} IS NOT NULL AND fwd IS NOT NULL)) GROUP BY date) WHERE n >= 10"""  # noqa: E731
    return f"WITH {CROSS_SQL}, v AS (SELECT date, fwd, {cols} FROM xs WINDOW d AS (PARTITION BY date)) " + " UNION ALL ".join(one(i, t) for i, t in enumerate(SCORED))


@add(_fitness_sql())
def formula_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = cross_panel(spark, sf_dir)
    named = {f"_v{i}": text for i, text in enumerate(SCORED)}
    scored = language.evaluate(panel, named, panel.columns).select("date", "stock_id", "forward_1d_ret", *[F.round(c, 9).alias(c) for c in named])
    means = summary.ic_series(scored, list(named)).groupBy("factor").agg(F.abs(F.avg("ic")).alias("fitness"))
    texts = F.create_map(*[F.lit(x) for kv in named.items() for x in kv])
    return rounded(means.select(texts[F.col("factor")].alias("formula"), "fitness"))


@add()
def formula_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five generations; the search itself has twenty unless told otherwise."""
    return spark.createDataFrame(mining.search_formulas(cross_panel(spark, sf_dir), NAMES, generations=5), "formula string, fitness double")


@add()
def factor_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["f1", "f2", "f3"]
    return mining.votes(mining.mine(cross_panel(spark, sf_dir), names).select("method", "factor"), len(mining.METHODS))


@add("SELECT CAST(user_id AS BIGINT) AS stock_id, CAST(ts AS DATE) AS date, round(avg(value), 6) AS close, count(*) AS volume FROM events GROUP BY ALL")
def daily_event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(daily_bars(spark.read.parquet(f"{sf_dir}/events.parquet")))


@add("SELECT page_id, coalesce(nullif(regexp_extract(html, '<html lang=\"([a-z]+)\"', 1), ''), 'none') AS lang FROM pages")
def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.coalesce(F.nullif(F.regexp_extract("html", '<html lang="([a-z]+)"', 1), F.lit("")), F.lit("none")).alias("lang"))


@add("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY event_type")
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.from_json("props", "k long")["k"]
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k"))


@add("""SELECT s.stock_id, n_name AS nation, r_name AS region FROM (SELECT CAST(s_suppkey AS BIGINT) AS stock_id, s_nationkey FROM supplier) s
    LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def stock_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    stocks = read("supplier").select(F.col("s_suppkey").cast("long").alias("stock_id"), "s_nationkey")
    # nation and region have 25 and 5 rows at every scale
    named = stocks.join(F.broadcast(read("nation")), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(F.broadcast(read("region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return named.select("stock_id", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@add("""SELECT code AS stock_id, s_name AS name, CASE WHEN code[1] IN ('6', '9') THEN 'sh' ELSE 'sz' END || code AS symbol FROM (
    SELECT s_name, CASE WHEN s_suppkey % 3 = 0 THEN 'x' ELSE '' END || lpad(CAST(s_suppkey * 7919 % 1000000 AS VARCHAR), 6, '0') AS code FROM supplier) WHERE regexp_full_match(code, '[0-9]{6}')""")
def listed_stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    code = F.concat(F.when(key % 3 == 0, "x").otherwise(""), F.lpad((key * 7919 % 1000000).cast("string"), 6, "0"))
    found = loaders.listed_stocks(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(code.alias("code"), F.col("s_name").alias("name")))
    return found.select("stock_id", "name", loaders.exchange_symbol(F.col("stock_id")).alias("symbol"))


@add(f"""WITH {FUNDAMENTALS_SQL} SELECT stock_id, round(max_by(sales, date), 2) AS sales, round(max_by(cash, date), 2) AS cash, round(max_by(total_liabilities, date), 2) AS total_liabilities FROM fx GROUP BY stock_id""")
def latest_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(loaders.latest_statements(fundamentals_panel(spark, sf_dir), ["sales", "cash", "total_liabilities"], "date"), 2)


@add(f"""WITH {PRICE_SQL}, {FUNDAMENTALS_ONLY_SQL}, s AS (SELECT stock_id, max_by(sales, date) AS sales, max_by(total_liabilities, date) AS debt FROM fx GROUP BY stock_id)
SELECT px.stock_id, date, round(ret, 6) AS ret, round(sales, 2) AS sales, round(debt, 2) AS total_debt FROM px LEFT JOIN s USING (stock_id) WHERE px.stock_id IN (SELECT DISTINCT stock_id FROM line ORDER BY stock_id LIMIT 60)""")
def statement_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = daily_closes(spark, sf_dir)
    out = loaders.statement_panel(daily, fundamentals_panel(spark, sf_dir).withColumnRenamed("date", "report_date"), ["sales", "total_liabilities"], most=60)
    return out.select("stock_id", "date", F.round("return", 6).alias("ret"), F.round("sales", 2).alias("sales"), F.round("total_debt", 2).alias("total_debt"))


@add(f"""WITH {PRICE_SQL} SELECT stock_id, date, round(close, 6) AS close, round(ret, 6) AS ret FROM px WHERE stock_id BETWEEN 1 AND 3""")
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = daily_closes(spark, sf_dir).where("stock_id between 1 and 3").groupBy("date").pivot("stock_id", [1, 2, 3]).agg(F.first("close").alias("close"), F.first("volume").alias("volume"))
    named = wide.select("date", *[F.col(f"{s}_{f}").alias(f"{f}|{s}") for s in (1, 2, 3) for f in ("close", "volume")])
    return loaders.from_wide(named, ["1", "2", "3"]).select(F.col("stock_id").cast("long").alias("stock_id"), "date", F.round("close", 6).alias("close"), F.round("return", 6).alias("ret"))


#: Statements of suppliers as JSON; each seventh payload is cut short.
def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fundamentals_panel(spark, sf_dir).select("stock_id", F.struct(F.concat(F.col("date").cast("string"), F.lit(" 00:00:00")).alias("REPORT_DATE"), F.round("sales", 2).alias("sales"), F.round("cash", 2).alias("cash")).alias("s"))
    whole = rows.groupBy("stock_id").agg(F.to_json(F.struct(F.collect_list("s").alias("data"))).alias("payload"))
    return whole.withColumn("payload", F.when(F.col("stock_id") % 7 == 0, F.expr("left(payload, length(payload) - 9)")).otherwise(F.col("payload")))


@add(f"""WITH {FUNDAMENTALS_SQL} SELECT stock_id, CAST(date AS VARCHAR) AS report_date, round(sales, 2) AS sales, round(cash, 2) AS cash FROM fx WHERE stock_id % 7 <> 0""")
def statement_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = loaders.statement_payloads(_payloads(spark, sf_dir), ["sales", "cash"])
    return found.select("stock_id", "report_date", F.col("sales").cast("double").alias("sales"), F.col("cash").cast("double").alias("cash"))


@add(f"""WITH {FUNDAMENTALS_SQL} SELECT DISTINCT stock_id FROM fx WHERE stock_id % 7 = 0""")
def corrupt_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaders.statement_payloads(_payloads(spark, sf_dir), ["sales", "cash"])[1].select("stock_id")


@add(f"""WITH {FUNDAMENTALS_SQL}, d AS (SELECT stock_id, date, row_number() OVER (PARTITION BY stock_id ORDER BY date DESC) - 1 AS i FROM fx)
SELECT stock_id, CAST(i // 5 AS INTEGER) AS batch, string_agg(CAST(date AS VARCHAR), ',' ORDER BY i) AS dates FROM d GROUP BY ALL""")
def statement_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaders.date_batches(fundamentals_panel(spark, sf_dir).select("stock_id", F.col("date").alias("report_date")))


@add("""SELECT CAST(user_id AS BIGINT) AS stock_id, CAST(ts AS DATE) AS date, min_by(value, (ts, value)) AS open, max(value) AS high, min(value) AS low, max_by(value, (ts, value)) AS close,
    round(avg(value), 6) AS mean, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL""")
def streamed_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel that a stream over the events, a few files a batch, leaves behind."""
    scratch = Scratch(spark, "stream")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    events.repartition(8).write.parquet(f"{scratch.root}/in")
    panel = StreamedPanel(spark, f"{scratch.root}/panel")
    panel.start(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{scratch.root}/in"), f"{scratch.root}/at", availableNow=True).awaitTermination()
    return rounded(panel.bars())
