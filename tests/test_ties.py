"""Means of equal days, interpolated ties and ranks, to the last bit."""

import datetime

import duckdb

from millrace.functions.order import cumulative, quantiles
from millrace.sources.panels import cross_panel


def test_equal_days_have_equal_means_however_the_table_is_cut(spark, tmp_path):
    start, values = datetime.datetime(2024, 1, 1), [0.1, 0.2, 0.3, 0.7, 1e9, 0.6, 0.1]
    rows = [(u * 1000 + 100 * day + i, start + datetime.timedelta(days=day, hours=i), u, "view", v) for u in range(40) for day in (0, 1) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").repartition(7).write.parquet(f"{tmp_path}/events.parquet")
    total = 0.0
    for v in values:
        total += v
    assert {r.f1 for r in cross_panel(spark, str(tmp_path)).select("f1").collect()} == {total / len(values)}


def test_quantiles_equal_those_of_sql_to_the_last_bit(spark):
    rows = [(g, round(7.13 * (i % (1 + g % 7) + g), 2) / 3) for g in range(200) for i in range(2 + g % 37)]
    shares = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
    found = quantiles(cumulative(spark.createDataFrame(rows, "g long, x double"), ("g",), "x"), ("g",), "x", shares, "q").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (g BIGINT, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    want = dict(con.execute("SELECT g, quantile_cont(x, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) FROM t GROUP BY g").fetchall())
    assert {r.g: list(r.q) for r in found} == want
