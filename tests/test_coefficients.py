"""Rank coefficients from wide rows against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import mining, testing
from millrace.operators.coefficients import rank_coefficients


def _expected(frame, values):
    out = {}
    for date, d in frame.groupby("date"):
        for i, v in enumerate(values):
            both = d[d.s.notna() & v.loc[d.index].notna()]
            out[date, i] = (both.s.rank().corr(v.loc[both.index].rank()), len(both))
    return out


def test_stretches_and_frequent_values_give_the_ranks_of_the_whole_date(spark):
    rng = np.random.default_rng(1)
    n = 70000  # the first date has five stretches, the second one
    frame = pd.DataFrame({"date": np.where(np.arange(n) < 66000, "a", "b"), "s": rng.normal(size=n), "x": rng.normal(size=n), "y": rng.normal(size=n)})
    frame["x"] += frame.s
    frame.loc[rng.random(n) < 0.5, "s"] = 0.25  # half of the rows in one value on both sides
    frame.loc[rng.random(n) < 0.6, "y"] = -1.0
    rows = spark.createDataFrame(frame).repartition(5)
    rows = rows.withColumns({"s": F.when(F.rand(2) < 0.9, F.col("s")), "y": F.when(F.rand(3) < 0.8, F.col("y"))}).persist()
    frame = rows.toPandas()
    got = {(r.date, r.i): (r.ic, r.n) for r in rank_coefficients(rows, "s", [F.col("x"), F.col("y"), F.exp("x")]).collect()}
    want = _expected(frame, [frame.x, frame.y, frame.x])
    assert set(got) == set(want)
    for k, (ic, pairs) in want.items():
        assert got[k][1] == pairs and abs(got[k][0] - ic) < 1e-12
    assert got["a", 0] == got["a", 2]  # equal orders, equal coefficients
    mixed = {(r.date, r.i): (r.ic, r.n) for r in rank_coefficients(rows, "s", [F.col("x"), F.col("y")], sums=[[(0, 0.5), (1, 0.25)], [(1, 1.0)]]).collect()}
    want = _expected(frame, [0.5 * frame.x + 0.25 * frame.y, frame.y])
    assert all(mixed[k][1] == w[1] and abs(mixed[k][0] - w[0]) < 1e-12 for k, w in want.items())


def test_values_that_do_not_vary_nulls_and_nan(spark):
    rows = spark.createDataFrame([(None, 1.0, 2.0, 1.0), (None, 2.0, 2.0, float("nan")), (None, None, 2.0, 3.0), (None, 3.0, 2.0, float("inf"))], "date string, s double, x double, y double")
    got = {r.i: (r.date, r.ic, r.n) for r in rank_coefficients(rows, "s", [F.col("x"), F.col("y")]).collect()}
    assert got[0] == (None, None, 3) and got[1][2] == 3 and got[1][1] == pytest.approx(0.5)  # NaN ranks over infinity
    assert rank_coefficients(rows.limit(0), "s", [F.col("x")]).collect() == []


def test_decay_multiplies_no_rows(spark):
    rows = spark.createDataFrame([(f"2024-01-{1 + i // 40:02d}", i % 40, float(i * 7 % 41), float(i * 11 % 43)) for i in range(800)], "date string, stock_id int, f double, `return` double")
    decay = testing.ic_decay(rows, "f", lags=3)
    assert "Generate" not in decay._jdf.queryExecution().optimizedPlan().toString()
    frame = rows.toPandas().sort_values(["stock_id", "date"])
    for r in decay.collect():
        frame["y"] = frame.groupby("stock_id")["return"].shift(-r.lag)
        ic = [d.f.rank().corr(d.y.rank()) for _, d in frame.dropna().groupby("date")]
        assert r.n_periods == len(ic) == 20 - r.lag and abs(r.mean_ic - np.mean(ic)) < 1e-12


def test_search_writes_cross_sections_not_formulas(spark, monkeypatch):
    rows = [(f"2024-01-{1 + i // 20:02d}", str(i % 20), float(i * 7 % 16), float((i * 31) % 11), float(i * 7 % 16)) for i in range(200)]
    panel = spark.createDataFrame(rows, "date string, stock_id string, a double, b double, forward_1d_ret double")
    written, settled = [], mining.settled
    monkeypatch.setattr(mining, "settled", lambda df: written.append(df.columns) or settled(df))
    mining.search_formulas(panel, ["a", "b"], generations=0, size=30)
    assert len(written) == 1 and len(written[0]) <= 2 + 3 + 6  # beside date and return: the panel's columns, three functions of two factors
