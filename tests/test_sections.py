"""Ranks, quantiles, the language's evaluation and its store."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import cross, language
from millrace.functions.order import cumulative, quantiles
from millrace.operators import summary
from millrace.sources.store import Harness


def panel(spark, rows):
    return spark.createDataFrame(rows, "date string, stock_id long, x double").repartition(5)


def drawn(n=600):
    rng = random.Random(3)
    value = lambda: rng.choice([None, 0.0, -0.0, 1.0, 1.0, float(rng.randrange(40)), rng.random()])
    return [(rng.choice(["a", "a", "a", "b", None]), i, value()) for i in range(n)] + [("one", 0, 5.0), ("none", 0, None), ("tied", 0, 2.0), ("tied", 1, 2.0)]


@pytest.mark.parametrize("stretches, least", [(64, 4096), (8, 1), (3, 5)])
def test_places_of_values_against_sorted_lists(spark, stretches, least):
    rows = drawn()
    found = cumulative(panel(spark, rows), ("date",), "x", stretches, least)
    got = {(r.date, r.x): (r.n, r.before, r.total) for r in found.collect()}
    want = {}
    for date in {r[0] for r in rows}:
        xs = [r[2] for r in rows if r[0] == date and r[2] is not None]
        want |= {(date, x): (xs.count(x), sum(o < x for o in xs), len(xs)) for x in xs}
    assert got == want
    shares = (0, 0.01, 0.25, 0.5, 0.99, 1)
    for r in quantiles(found, ("date",), "x", shares, "q").collect():
        xs = [x for d, _, x in rows if d == r.date and x is not None]
        assert np.allclose(r.q, np.quantile(xs, shares))


def test_ranks_and_buckets_against_pandas(spark):
    rows = [r for r in drawn() if r[0]]
    out = cross.with_cross(panel(spark, rows), {"r": cross.pct_rank(F.col("x")), "w": cross.winsorized(F.col("x"), 0.1), "z": cross.guarded_zscore(F.col("x")), "b": cross.bucket(F.col("x"), 4)}).toPandas().set_index("stock_id")
    assert sorted(out.columns) == ["b", "date", "r", "w", "x", "z"] and len(out) == len(rows)
    for _, day in out.groupby("date"):
        assert np.allclose(day.r, day.x.rank(pct=True), equal_nan=True)
        assert np.allclose(day.w, day.x.clip(day.x.quantile(0.1), day.x.quantile(0.9)), equal_nan=True)
        if day.x.nunique() > 1:
            assert np.allclose(day.z, (day.x - day.x.mean()) / day.x.std(), equal_nan=True)
            assert (day.b.dropna() == pd.qcut(day.x, 4, labels=False, duplicates="drop").dropna()).all()
    empty = cross.with_cross(panel(spark, rows).limit(0), {"r": cross.pct_rank(F.col("x"))})
    assert empty.collect() == []


def test_combined_scores_take_weights_and_signs(spark):
    rows = panel(spark, [("a", i, float(i * i)) for i in range(6)]).withColumn("y", -F.col("x") + F.col("stock_id"))
    got = cross.combined(rows, ["x", "y"], "s", [3, 1], [1, -1]).toPandas()
    z = lambda v: (v - v.mean()) / v.std()
    assert np.allclose(got.s, 0.75 * z(got.x) - 0.25 * z(got.y))


def test_scalar_coefficient_is_of_ranks(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 20, 300).astype(float)
    y = np.exp(x) + rng.normal(size=300)
    frame = spark.createDataFrame(pd.DataFrame({"f": x, "forward_1d_ret": y}))
    want = pd.Series(x).rank().corr(pd.Series(y).rank())
    got = summary.scalar_ic(frame, "f").first()
    assert abs(got.ic - want) < 1e-12 and got.n == 300


def test_analysis_by_shares(spark):
    columns = "factor string, mean_ic double, ir double, ls_sharpe double, fm_t double, ic_positive double"
    rows = [("a", 0.02, 0.1, 0.6, 2.0, 0.6), ("b", -0.03, 0.3, 0.2, -3.0, 0.5), ("c", 0.0, None, None, 0.0, None), ("d", 0.5, 0.2, 0.1, 0.0, 0.7)]
    got = summary.analysis(spark.createDataFrame(rows, columns)).first()
    assert tuple(got) == (4, 3, 1, 2, 1, "b", 0.2, "medium", 2, 1)
    got = summary.analysis(spark.createDataFrame(rows[:3], columns)).first()
    assert got.quality == "high" and got.unstable_ic_direction == 1
    assert summary.analysis(spark.createDataFrame([], columns)).first().quality == "low"


@pytest.mark.parametrize("formula, want", [
    ("rank({f0})", "cs_rank(size)"), ("zscore({f0}) / (zscore({f1}) + 1)", "cs_zscore(size) / (cs_zscore(momentum_12m) + 1)"), ("-(rank({f0}))", "0 - cs_rank(size)"),
    ("sqrt_abs(zscore({f0}))", "sqrt_abs(cs_zscore(size))"), ("{f0} - ({f1} - {f2}) * 2", "size - (momentum_12m - value) * 2"), (" {f0} / ({f1} / {f2}) / 3", "size / (momentum_12m / value) / 3"),
    ("-{f0} * -2", "(0 - size) * (0 - 2)"), ("{f0} - {f1} - 1", "size - momentum_12m - 1"),
])
def test_mined_formulas_are_spelt_in_the_language(formula, want):
    names = ["size", "momentum_12m", "value"]
    got = language.translate(formula, names)
    assert got == want and language.parse(got, names).canonical


@pytest.mark.parametrize("formula, kind", [
    ("rank({f3})", "PlaceholderOutOfRange"), ("rank({g0})", "UnknownPlaceholder"), ("rank({f0", "UnknownPlaceholder"), ("{f0, f1}", "UnknownPlaceholder"), ("{f1}", "InvalidFeatureName"),
    ("{f0} +", "SyntaxError"), ("{f0} ** 2", "UnsupportedBinaryOp"), ("f({f0})", "UnregisteredOperator"),
])
def test_mined_formulas_that_break_a_rule(formula, kind):
    with pytest.raises(language.LanguageError) as bad:
        language.translate(formula, ["size", "not a name"])
    assert bad.value.kind == kind


def test_at_most_ten_features_and_the_plain_language_has_no_slots():
    assert language.translate("{f9}", [f"a{i}" for i in range(12)]) == "a9"
    for text in ("{f0}", "-size", "rank(size)"):
        with pytest.raises(language.LanguageError):
            language.parse(text, ["size"])
    with pytest.raises(language.LanguageError):
        language.translate("{f10}", [f"a{i}" for i in range(12)])


def test_sections_within_windows_within_sections(spark):
    rng = np.random.default_rng(2)
    data = pd.DataFrame([(f"2024-01-{d:02}", s, float(rng.normal())) for d in range(1, 8) for s in range(9)], columns=["date", "stock_id", "x"])
    got = language.evaluate(spark.createDataFrame(data), {"v": "cs_rank(ts_mean(cs_demean(x), 3)) + cs_rank(x)", "w": "cs_demean(x) * 2"}).toPandas().sort_values(["date", "stock_id"])
    wide = data.pivot(index="date", columns="stock_id", values="x")
    off = wide.sub(wide.mean(axis=1), axis=0)
    want = off.rolling(3).mean().rank(axis=1, pct=True) + wide.rank(axis=1, pct=True)
    assert np.allclose(got.v, want.stack(future_stack=True), equal_nan=True) and np.allclose(got.w, 2 * off.stack(future_stack=True))
    assert list(got.columns) == ["date", "stock_id", "x", "v", "w"]


def test_stored_calls_are_read_and_not_computed_again(spark, tmp_path, monkeypatch):
    rows = panel(spark, [("2024-01-01", 1, 1.0), ("2024-01-01", 2, 2.0), ("2024-01-02", 1, 3.0), ("2024-01-02", 2, None)])
    store = Harness(spark, f"file://{tmp_path}", {"source": "x"}, ["1", "2"], ["x"])
    first = {"a": "cs_rank(x) + 1", "b": "log_abs(cs_rank(x)) * sign(x)"}
    once = language.evaluate(rows, first, store=store).orderBy("date", "stock_id").collect()
    assert once == language.evaluate(rows, first).orderBy("date", "stock_id").collect()
    # the rank, which occurs twice, and the outermost calls log_abs and sign
    assert store.counts()["nodes"] == 3
    built = []
    monkeypatch.setattr(cross, "with_cross", lambda *_: built.append(1))
    assert once == language.evaluate(rows, first, store=store).orderBy("date", "stock_id").collect()
    again = language.evaluate(rows, {"c": "square(cs_rank(x))"}, store=store).orderBy("date", "stock_id").collect()
    assert [r.c for r in again] == [0.25, 1.0, 1.0, None] and store.counts()["nodes"] == 4 and not built
    other = Harness(spark, f"file://{tmp_path}", {"source": "x"}, ["1"], ["x"])
    assert other.load("nodes", language.parse("cs_rank(x)", ["x"]).hash) is None
    off = Harness(spark, f"file://{tmp_path}", {"source": "x"}, ["1", "2"], ["x"], cache=False)
    monkeypatch.undo()
    assert once == language.evaluate(rows, first, store=off).orderBy("date", "stock_id").collect()


def test_registered_operators(spark):
    language.register_operator("twice", 1, lambda x: x * 2)
    language.register_operator("cs_range", 1, lambda x: cross.Cross(x, lambda x, low, high: high - low, (F.min, F.max)), section=True)
    rows = panel(spark, [("a", 1, 1.0), ("a", 2, 5.0), ("b", 1, 7.0)])
    got = language.evaluate(rows, {"v": "twice(cs_range(x))"}).orderBy("date", "stock_id").collect()
    assert [r.v for r in got] == [8.0, 8.0, 0.0]
    for name in ("twice", "cs_range"):
        language.OPERATORS.pop(name)
