"""Rolling factors against pandas, regressions against NumPy, statements, the streamed panel and compaction."""

import math
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import factors, tails, testing
from millrace.sources import loaders
from millrace.sources.store import ResearchMemory
from millrace.streaming.panel import StreamedPanel


def history(n=420, seed=0, stocks=("A", "B")):
    rng = np.random.default_rng(seed)
    rows = []
    for s in stocks:
        ret = rng.normal(0.001, 0.02, n)
        ret[rng.random(n) < 0.05] = np.nan
        close = 100 * np.exp(np.cumsum(np.nan_to_num(ret)))
        rows.append(pd.DataFrame({"date": pd.date_range("2020-01-01", periods=n).strftime("%Y-%m-%d"), "stock_id": s, "return": ret, "close": close, "volume": rng.integers(1, 9, n).astype(float)}))
    return pd.concat(rows)


def frame(spark, data):
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in data.itertuples(index=False)]
    return spark.createDataFrame(rows, "date string, stock_id string, return double, close double, volume double").repartition(3)


def by_stock(out, data, name):
    out = out.sort_values(["stock_id", "date"])
    return [(out[out.stock_id == s][name].to_numpy(dtype=float), d.reset_index(drop=True)) for s, d in data.groupby("stock_id")]


def test_sums_so_far_give_the_frames_moments(spark):
    data = history()
    got = factors.compute_factors(frame(spark, data), ["beta", "coskewness", "cokurtosis", "ivol_capm", "amihud_illiq"]).toPandas()
    for name in ("beta", "coskewness", "cokurtosis", "ivol_capm", "amihud_illiq"):
        for have, d in by_stock(got, data, name):
            r, m = d["return"], d["return"].expanding().mean()
            m = m.where(m.notna())
            both = r.where(m.notna()), m.where(r.notna())
            slope = both[0].rolling(252, min_periods=60).cov(both[1]) / both[1].rolling(252, min_periods=60).var()
            if name == "beta":
                want = slope.where(both[1].rolling(252, min_periods=60).var() > 1e-10)
            elif name == "ivol_capm":
                want = (r - slope * m).rolling(252, min_periods=60).std()
            elif name == "amihud_illiq":
                want = 1e6 * (r.abs() / (d.close * d.volume + 1e-10)).rolling(252, min_periods=60).mean()
            else:
                a, b = r - r.mean(), m - m.mean()
                sa, sb = a.rolling(252, min_periods=60).std(), b.where(a.notna()).rolling(252, min_periods=60).std()
                p, scale = (a * b * b, sa**1.5 * sb) if name == "coskewness" else (a * b**3, sa * sb)
                want = p.rolling(252, min_periods=60).mean() / (scale + 1e-10)
            want = want.to_numpy()
            ok = ~np.isnan(want)
            assert ok.sum() > 200 and np.isnan(have[~ok & (np.arange(len(have)) < 50)]).all()
            assert np.allclose(have[ok], want[ok], rtol=1e-7, atol=1e-12), name


@pytest.mark.parametrize("block", [50, 8192])
def test_sorted_window_against_pandas(spark, block):
    data = history()
    rows = frame(spark, data)
    got = tails.moving_tail(rows, n=60, least=20, block=block).toPandas()
    assert len(got) == len(data)
    for have, d in by_stock(got, data, "var_95"):
        assert np.allclose(have, d["return"].rolling(60, min_periods=20).quantile(0.05), equal_nan=True)
    for have, d in by_stock(got, data, "cvar_95"):
        want = d["return"].rolling(60, min_periods=20).apply(lambda x: np.nanmean(x[x <= np.nanquantile(x, 0.05)]), raw=True)
        assert np.allclose(have, want, equal_nan=True)
    ulcer = tails.moving_ulcer(rows, n=40, least=10, block=block).toPandas()
    for have, d in by_stock(ulcer, data, "ulcer_index"):
        peak = d.close.rolling(40, min_periods=10).max()
        assert np.allclose(have, np.sqrt((((d.close - peak) / peak) ** 2).rolling(40, min_periods=10).mean()), equal_nan=True)


def test_windows_with_ties_gaps_and_few_values():
    values = [1.0, 1.0, None, -1.0, 1.0, None, None, None, 2.0]
    got = list(tails.tail_of(values, 3, 2, 0.5))
    assert got == [(None, None), (1.0, 1.0), (1.0, 1.0), (0.0, -1.0), (0.0, -1.0), (0.0, -1.0), (None, None), (None, None), (None, None)]
    assert list(tails.peaks_of([3.0, None, 1.0, 2.0, None], 3, 1)) == [3.0, 3.0, 3.0, 2.0, 2.0]
    assert list(tails.tail_of([], 3, 2, 0.5)) == list(tails.ulcers_of([], 3, 2)) == []


def test_moving_factors_join_the_others(spark):
    data = history(150, 1)
    got = factors.compute_factors(frame(spark, data), ["max_ret_1m", "var_95", "cvar_95", "ulcer_index"]).toPandas()
    assert list(got.columns) == ["stock_id", "date", "max_ret_1m", "var_95", "cvar_95", "ulcer_index"] and len(got) == len(data)
    assert factors.compute_factors(frame(spark, data).drop("return"), ["var_95"]).where("var_95 is not null").isEmpty()


def test_regressions_of_least_norm_by_triangles(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for day, n in (("a", 200), ("b", 15), ("c", 40)):
        x = rng.normal(size=(n, 2)) * [1, 0.1] + [1e3, 5]
        x = np.column_stack([x, 2 * x[:, 0] if day == "c" else rng.normal(size=n)])
        y = x @ [0.5, 200.0, -1.0] + rng.normal(size=n)
        rows += [(day, *map(float, r), float(v), "clash", 1) for r, v in zip(x, y, strict=True)]
        if n >= 16:
            want[day] = (np.column_stack([np.ones(n), x]), y)
    rows += [("a", None, 1.0, 1.0, 1.0, "", 1), ("a", float("nan"), 1.0, 1.0, 1.0, "", 1), ("d", 1.0, 1.0, 1.0, None, "", 1)]
    panel = spark.createDataFrame(rows, "date string, u double, v double, w double, forward_1d_ret double, y string, _one int").repartition(7)
    got = {r.date: np.array(r.coefficients) for r in testing.many_regressions(panel, ["u", "v", "w"]).collect()}
    assert set(got) == set(want)
    for day, (x, y) in want.items():
        exact = np.linalg.lstsq(x, y, rcond=None)[0]
        assert np.allclose(x @ got[day], x @ exact, rtol=1e-9) and np.allclose(got[day], exact, rtol=1e-6, atol=1e-6)
    assert testing.many_regressions(panel.limit(0), ["u", "v", "w"]).collect() == []


def test_nested_statements_and_batches_of_dates(spark):
    good = '{"data": [{"REPORT_DATE": "2023-12-31 00:00:00", "sales": 5, "more": {"x": 1}}, {"REPORT_DATE": "2024-03-31", "sales": null}, {"sales": 1}, {"REPORT_DATE": "2024-03-31", "sales": "7"}]}'
    raw = spark.createDataFrame([("A", good), ("B", good[:40]), ("C", None), ("D", '{"data": []}'), ("E", '{"other": 1}'), ("F", "[]")], "stock_id string, payload string")
    found, bad = loaders.statement_payloads(raw, ["sales"])
    assert sorted(map(tuple, found.collect())) == [("A", "2023-12-31", "5"), ("A", "2024-03-31", "7")]
    assert {r.stock_id: r.payload for r in bad.collect()} == {"B": good[:40], "C": None, "E": '{"other": 1}', "F": "[]"} or {r.stock_id for r in bad.collect()} == {"B", "C", "E"}
    dates = [("A", f"2023-{m:02}-01 00:00:00") for m in range(1, 13)] + [("A", "2023-12-01"), ("A", None), ("B", "2020-01-01")]
    got = sorted(map(tuple, loaders.date_batches(spark.createDataFrame(dates, "stock_id string, report_date string")).collect()))
    assert got == [("A", 0, "2023-12-01,2023-11-01,2023-10-01,2023-09-01,2023-08-01"), ("A", 1, "2023-07-01,2023-06-01,2023-05-01,2023-04-01,2023-03-01"), ("A", 2, "2023-02-01,2023-01-01"), ("B", 0, "2020-01-01")]


def test_latest_statement_of_equal_dates_is_the_greater(spark):
    reports = spark.createDataFrame([("A", "2024", "1"), ("A", "2024", "3"), ("A", "2023", "9")], "stock_id string, report_date string, sales string")
    for parts in (1, 3):
        assert loaders.latest_statements(reports.repartition(parts), ["sales"]).first().sales == 3.0


def events(spark, rows):
    return spark.createDataFrame(rows, "user_id int, ts string, value double").withColumn("ts", F.to_timestamp("ts"))


def test_a_repeated_batch_changes_nothing_and_late_days_are_merged(spark, tmp_path):
    panel = StreamedPanel(spark, f"file://{tmp_path}/panel")
    assert panel.bars().collect() == []
    first = events(spark, [(1, "2024-01-02 10:00:00", 5.0), (1, "2024-01-02 09:00:00", 4.0), (1, "2024-01-03 09:00:00", 1.0), (None, "2024-01-02 09:00:00", 1.0), (1, None, 1.0), (1, "2024-01-02 09:30:00", None)])
    for _ in range(2):
        panel.write(first, 0)
    panel.write(events(spark, [(1, "2024-01-02 08:00:00", 9.0), (2, "2024-01-02 08:00:00", 2.0)]), 1)
    got = {(r.stock_id, str(r.date)): (r.open, r.high, r.low, r.close, r["mean"], r.n) for r in panel.bars().collect()}
    assert got == {(1, "2024-01-02"): (9.0, 9.0, 4.0, 5.0, 6.0, 3), (1, "2024-01-03"): (1.0, 1.0, 1.0, 1.0, 1.0, 1), (2, "2024-01-02"): (2.0, 2.0, 2.0, 2.0, 2.0, 1)}


def test_a_stream_that_stops_goes_on_where_it_was(spark, tmp_path):
    rows = [(u, f"2024-01-0{1 + d} 0{h}:00:00", float(u * d + h)) for u in range(5) for d in range(4) for h in range(4)]
    whole = events(spark, rows)
    panel = StreamedPanel(spark, f"file://{tmp_path}/panel")
    for part in (0, 1):
        whole.where(F.col("user_id") % 2 == part).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        panel.start(stream, f"file://{tmp_path}/at", availableNow=True).awaitTermination(120)
    batch = StreamedPanel(spark, f"file://{tmp_path}/batch")
    batch.write(whole, 0)
    assert sorted(map(tuple, panel.bars().collect())) == sorted(map(tuple, batch.bars().collect())) and panel.bars().count() == 20


def test_compaction_keeps_events_that_arrive_meanwhile(spark, tmp_path, monkeypatch):
    memory = ResearchMemory(spark, f"file://{tmp_path}")
    memory.compact("checkpoints")
    for at in (1.0, 2.0):
        memory.put_checkpoint("run", {"at": at}, at)
    real, late = memory.table, threading.Event()

    def table(name):
        rows = real(name)
        if not late.is_set():
            late.set()
            files = rows.inputFiles()
            monkeypatch.setattr(type(rows), "inputFiles", lambda _: files)
            memory.put_checkpoint("other", {"late": 1}, 3.0)
        return rows

    memory.table = table
    memory.compact("checkpoints")
    memory.table = real
    assert memory.checkpoint("run") == {"at": 2.0} and memory.checkpoint("other") == {"late": 1}
    memory.compact("checkpoints")
    assert memory.table("checkpoints").count() == 2
