"""The report of a run, its pages, and the formula search."""

from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

from millrace.functions import language
from millrace.operators import mining, report
from millrace.sources import sinks


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(0)
    rows = []
    for d in range(24):
        a, b, noise = rng.normal(size=(3, 36))
        fwd = 0.5 * a + 0.3 * noise
        rows += [(f"2024-01-{d + 1:02}", i, float(fwd[i]) / 50, float(fwd[i]) / 50, float(a[i]), float(b[i])) for i in range(36)]
    return spark.createDataFrame(rows, "date string, stock_id long, return double, forward_1d_ret double, a double, b double").repartition(4)


def test_a_report_has_all_charts_and_pages(spark, panel, tmp_path):
    mined = spark.createDataFrame([("lasso", "a", 0.5)], "method string, factor string, weight double")
    found = report.write_report(panel, ["a", "b"], f"file://{tmp_path}", groups=4, mined=mined).collect()
    assert [r.factor for r in found] == ["a", "b"] and found[0].mean_ic > 0.5
    charts = {c: spark.read.parquet(f"{tmp_path}/charts/{c}") for c in ("ic", "decay", "groups", "long_short", "turnover", "distribution", "correlation")}
    assert charts["ic"].count() == 48 and charts["groups"].count() == 8 and charts["correlation"].count() == 1 and charts["distribution"].count() == 48
    assert charts["decay"].where("factor = 'a' and lag = 1").first().n_periods == 23
    text = spark.read.text(f"{tmp_path}/report_md", wholetext=True).first().value
    page = spark.read.text(f"{tmp_path}/report_html", wholetext=True).first().value
    assert "Best factor: **a**" in text and "## Selected factors" in text and "- quality: high" in text
    assert "<h2>Selected factors</h2>" in page and "<strong>a</strong>" in page and page.count("<table>") >= 4
    assert spark.read.json(f"{tmp_path}/analysis").count() == 1 and spark.read.option("header", True).csv(f"{tmp_path}/summary").count() == 2


def test_one_factor_has_no_correlation(panel):
    assert set(report.chart_data(panel, ["a"])) == {"ic", "decay", "groups", "long_short", "turnover", "distribution"}


def test_markdown_blocks_as_html():
    text = "# A & B\n> made: today\n\n- one **two** `x < y`\n- three *four*\n\n## T\n| a | b |\n|-|:-:|\n| 1 | <i> |\n\n![c](d.png)\n![e](f.png)\n\nlast line\nof two"
    got = sinks.as_html(text, "t<")
    for part in ("<title>t&lt;</title>", "<h1>A &amp; B</h1>", "<blockquote><p>made: today</p></blockquote>", "<li>one <strong>two</strong> <code>x &lt; y</code></li><li>three <em>four</em></li>", "<h2>T</h2>",
                 "<thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>1</td><td>&lt;i&gt;</td></tr></tbody>", '<section><figure><img src="d.png" alt="c">', "<p>last line of two</p>"):
        assert part in got
    assert got.count("<section>") == 1 and sinks.as_html("", "x").endswith("</body></html>")


def test_means_of_mixtures_are_weights_of_start_formulas():
    a, b = ((0, Fraction(1)),), ((1, Fraction(1)),)
    c = mining.mixed(mining.mixed(a, b), a)
    assert c == ((0, Fraction(3, 4)), (1, Fraction(1, 4))) and mining.mixed(c, c) == c
    assert mining.mixture_text(c, ["cs_rank(x)", "neg(y)"]) == "0.75 * (cs_rank(x)) + 0.25 * (neg(y))" and mining.mixture_text(a, ["cs_rank(x)"]) == "cs_rank(x)"


def test_search_gives_formulas_whose_fitness_can_be_recomputed(panel):
    found = mining.search_formulas(panel, ["a", "b"], generations=3, size=12, seed=3)
    assert found == sorted(found, key=lambda x: (-x[1], x[0])) and found[0][1] > 0.5
    again = mining.search_formulas(panel, ["a", "b"], generations=3, size=12, seed=3)
    assert [t for t, _ in again] == [t for t, _ in found]
    best, value = next(f for f in found if "+" in f[0])
    got = mining.fitness(panel, [best])
    assert abs(got[best] - value) < 0.02
    frame = language.evaluate(panel, {"v": best}).toPandas()
    ic = frame.groupby("date")[["v", "forward_1d_ret"]].apply(lambda d: d.v.rank().corr(d.forward_1d_ret.rank()))
    assert isinstance(ic, pd.Series) and abs(abs(ic.mean()) - value) < 0.02
