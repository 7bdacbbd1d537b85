"""Results as files: CSV, Parquet, JSON, and reports in Markdown and HTML.

Frames are written by Spark. Reports hold a summary, one row per factor, which
is all that reaches the driver.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Sequence
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(frame: DataFrame, path: str) -> None:
    """A small frame, as one CSV file with a header."""
    frame.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_panel(panel: DataFrame, path: str) -> None:
    """A panel as Parquet, one folder a month, so date filters prune folders."""
    panel.withColumn("month", F.date_format("date", "yyyy-MM")).repartition("month", F.pmod(F.xxhash64("stock_id"), F.lit(16))).write.mode("overwrite").partitionBy("month").parquet(path)


def write_nav(nav: DataFrame, path: str) -> None:
    """``(date, portfolio, benchmark)`` of a backtest, by date."""
    write_csv(nav.select("date", F.col("nav").alias("portfolio"), F.col("benchmark_nav").alias("benchmark")).orderBy("date"), path)


def matrix(panel: DataFrame, value: str, stocks: Sequence[str]) -> DataFrame:
    """``(date, <stock>..)`` with single-precision values of the named stocks."""
    return panel.groupBy("date").pivot("stock_id", list(stocks)).agg(F.first(F.col(value).cast("float"), ignorenulls=True))


def write_text(frame: DataFrame, text: str, path: str) -> None:
    """A small text as one file, by the frame's session."""
    frame.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_json(frame: DataFrame, path: str) -> None:
    """The first row of a one-row frame as one JSON document."""
    write_text(frame, json.dumps(frame.first().asDict(), default=str, sort_keys=True), path)


def _cell(v) -> str:
    return "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)


def markdown(summary: DataFrame, analysis: DataFrame | None = None, title: str = "Factor report", sections: Sequence[tuple[str, str]] = ()) -> str:
    """Title, verdict and the summary as a table, best ratio first, then ``sections`` of a heading and Markdown each."""
    rows = summary.collect()  # one row per factor
    lines = [f"# {title}", ""]
    if analysis is not None:
        lines += [f"- {k.replace('_', ' ')}: {_cell(v)}" for k, v in analysis.first().asDict().items()] + [""]
    if rows:
        lines += [f"Best factor: **{rows[0][0]}**", ""]
    lines += ["| " + " | ".join(summary.columns) + " |", "|" + "-|" * len(summary.columns)]
    more = [x for heading, text in sections for x in (f"## {heading}", "", text, "")]
    return "\n".join([*lines, *("| " + " | ".join(map(_cell, r)) + " |" for r in rows), "", *more])


#: Marks within a line, and what they become around the text between them.
INLINE = ((r"`([^`]+)`", "code"), (r"\*\*([^*]+)\*\*", "strong"), (r"\*([^*]+)\*", "em"))
FIGURE = re.compile(r"!\[([^\]]*)\]\(([^)]*)\)")


def _inline(text: str) -> str:
    """Escaped text with its marks turned into elements; links to figures stay as they are."""
    text = html.escape(text.strip())
    for pattern, name in INLINE:
        text = re.sub(pattern, rf"<{name}>\1</{name}>", text)
    return text


def _kind(line: str) -> str:
    """What block a line belongs to."""
    bare = line.strip()
    if not bare:
        return "blank"
    if bare.startswith("#"):
        return "heading"
    if bare.startswith("|") and bare.endswith("|"):
        return "table"
    if FIGURE.fullmatch(bare):
        return "figures"
    return {"- ": "list", "> ": "quote"}.get(bare[:2], "text")


def _block(kind: str, lines: list[str]) -> str:
    """A run of lines of one kind as HTML."""
    tag = lambda name, inside: f"<{name}>{inside}</{name}>"
    if kind == "heading":
        return "".join(tag(f"h{min(6, len(x) - len(x.lstrip('#')))}", _inline(x.lstrip("#"))) for x in lines)
    if kind == "table":
        rows = [[c for c in x.strip("|").split("|")] for x in lines]
        rows = [r for r in rows if not all(re.fullmatch(r"\s*:?-+:?\s*", c) for c in r)]
        cells = lambda name, r: tag("tr", "".join(tag(name, _inline(c)) for c in r))
        return tag("table", tag("thead", cells("th", rows[0])) + tag("tbody", "".join(cells("td", r) for r in rows[1:]))) if rows else ""
    if kind == "figures":
        found = [FIGURE.fullmatch(x) for x in lines]
        return tag("section", "".join(tag("figure", f'<img src="{html.escape(m[2], quote=True)}" alt="{html.escape(m[1], quote=True)}">' + tag("figcaption", html.escape(m[1]))) for m in found))
    if kind == "list":
        return tag("ul", "".join(tag("li", _inline(x[2:])) for x in lines))
    if kind == "quote":
        return tag("blockquote", "".join(tag("p", _inline(x[2:])) for x in lines))
    return tag("p", " ".join(map(_inline, lines))) if kind == "text" else ""


def as_html(text: str, title: str) -> str:
    """A page of Markdown with headings, lists, tables, quotes, figures and marks within lines."""
    runs = groupby((x.strip() for x in text.split("\n")), _kind)
    body = "\n".join(b for kind, lines in runs if (b := _block(kind, list(lines))))
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body>\n{body}\n</body></html>'


def page(summary: DataFrame, analysis: DataFrame | None = None, title: str = "Factor report") -> str:
    """``markdown`` as an HTML page."""
    return as_html(markdown(summary, analysis, title), title)


def write_markdown(summary: DataFrame, path: str, analysis: DataFrame | None = None) -> None:
    write_text(summary, markdown(summary, analysis), path)


def write_html(summary: DataFrame, path: str, analysis: DataFrame | None = None) -> None:
    write_text(summary, page(summary, analysis), path)
