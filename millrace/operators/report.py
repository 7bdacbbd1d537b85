"""A whole report of a run: the data of every chart, the summary, its analysis, and pages that show them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import preparing, summary, testing
from millrace.sources import sinks
from millrace.sources.scratch import settled

#: Dates that a distribution shows at most.
SHOWN_DATES = 50


def _each(factors: Sequence[str], make) -> DataFrame:
    """``make(factor)`` of all factors in one frame, with a column for the factor."""
    return reduce(DataFrame.unionByName, (make(f).select(F.lit(f).alias("factor"), "*") for f in factors))


def chart_data(panel: DataFrame, factors: Sequence[str], groups: int = 5, ret: str = "forward_1d_ret", least: int = 10) -> dict[str, DataFrame]:
    """The frames of all charts by name, for at least one factor of ``panel(date, stock_id, return, ret, factors..)``.

    ``ic`` has each date's coefficient and its rolling mean, ``decay`` the mean
    ones by lag, ``groups`` and ``long_short`` the buckets' returns and the
    spread with its product, ``turnover`` the exchange of names, ``correlation``
    pairs of factors, ``distribution`` quartiles on up to 50 dates evenly apart.
    The panel is written once and read by all.
    """
    panel = settled(panel.select("date", "stock_id", *dict.fromkeys(["return", ret, *factors])))
    ic = settled(summary.ic_series(panel, factors, ret, least))
    returns = settled(summary.group_returns(panel, factors, groups, ret))
    every = max(1, -(-panel.select("date").distinct().count() // SHOWN_DATES))
    out = {
        "ic": summary.rolling_ic(ic),
        "decay": _each(factors, lambda f: testing.ic_decay(panel, f, least=least)),
        "groups": _each(factors, lambda f: testing.group_summary(returns.where(F.col("factor") == f).drop("factor"))),
        "long_short": summary.cumulative(summary.long_short(returns)),
        "turnover": _each(factors, lambda f: summary.mean_turnover(testing.membership_turnover(panel, f, groups, ret))),
        "distribution": _each(factors, lambda f: preparing.distribution(panel, f, every)),
    }
    if len(factors) > 1:
        out["correlation"] = summary.complete_correlation(panel, factors, least)
    return out


def _table(frame: DataFrame, rows: int) -> str:
    """The first rows of a frame as a Markdown table."""
    found = frame.orderBy(*frame.columns[:2]).limit(rows).collect()
    cells = lambda r: "| " + " | ".join("-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |"
    return "\n".join([cells(frame.columns), "|" + "-|" * len(frame.columns), *map(cells, found)])


def write_report(panel: DataFrame, factors: Sequence[str], path: str, groups: int = 5, ret: str = "forward_1d_ret", least: int = 30, mined: DataFrame | None = None) -> DataFrame:
    """Everything of a run under ``path``, and the summary.

    Charts' frames as Parquet under ``charts/<name>``, the summary as CSV, its
    analysis as JSON, and the report in Markdown and HTML; ``mined`` is what
    selectors chose, if any. Frames that grow with dates or stocks are written
    by the executors; only rows per factor, bucket, lag or pair are shown.
    """
    charts = chart_data(panel, factors, groups, ret, min(least, 10))
    for name, frame in charts.items():
        frame.write.mode("overwrite").parquet(f"{path}/charts/{name}")
    spark = panel.sparkSession
    kept = lambda name: spark.read.parquet(f"{path}/charts/{name}")
    found = settled(summary.test_factors(panel, factors, groups, ret, least)).orderBy(F.col("ir").desc_nulls_last(), "factor")
    told = summary.analysis(found)
    sinks.write_csv(found, f"{path}/summary")
    sinks.write_json(told, f"{path}/analysis")
    shown = {"groups": ("Buckets", len(factors) * groups), "decay": ("Decay of the coefficient", len(factors) * 20), "correlation": ("Correlated factors", len(factors) ** 2)}
    sections = [(heading, _table(summary.strong_pairs(kept(name)) if name == "correlation" else kept(name), rows)) for name, (heading, rows) in shown.items() if name in charts]
    if mined is not None:
        sections.append(("Selected factors", _table(mined, 10 * len(factors))))
    text = sinks.markdown(found, told, sections=sections)
    sinks.write_text(panel, text, f"{path}/report_md")
    sinks.write_text(panel, sinks.as_html(text, "Factor report"), f"{path}/report_html")
    return found
