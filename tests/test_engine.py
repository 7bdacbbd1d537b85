import math
import os
from dataclasses import replace

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import language
from millrace.operators import mining, portfolio
from millrace.plans import registry
from millrace.sources.store import Cache, ResearchMemory, pair_key, run_identity

SMALL = "/root/testdata/sf0.001"
#: Small cross-sections leave these without rows or with one, which the larger table covers.
NAMES = sorted(registry.ORACLE_SQL)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.sql(f"create view {name.split('.')[0]} as select * from '{SMALL}/{name}'")
    return con


def as_rows(frame):
    text = lambda v: "-" if pd.isna(v) else f"{v:.8g}" if isinstance(v, float) else str(v)[:10]
    return sorted(tuple(text(v) for v in row) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SMALL).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert as_rows(got) == as_rows(want)


def test_language_forms_and_errors():
    found = language.parse("cs_zscore(ts_mean(close, 5)) / (volume + 1)")
    assert found.canonical == "(cs_zscore(ts_mean(close, 5)) / (volume + 1))"
    assert (found.fields, found.lookback, len(found.parts)) == (["close", "volume"], 5, 2)
    for text, kind in (("nothing", "UnregisteredField"), ("f(close)", "UnregisteredOperator"), ("cs_rank(close, 2)", "ArgumentMismatch"), ("-close", "DisallowedExpression"),
                       ("close ** 2", "UnsupportedBinaryOp"), ("close +", "SyntaxError"), ("close.x(1)", "InvalidCall"), ("ts_mean(close, 0)", "ArgumentMismatch")):
        with pytest.raises(language.LanguageError) as bad:
            language.parse(text)
        assert bad.value.kind == kind
    names = ["size", "momentum_12m", "value"]
    assert language.translate("zscore({f0}) / (zscore({f1}) + 1)", names) == "cs_zscore(size) / (cs_zscore(momentum_12m) + 1)"
    assert language.translate("-(rank({f0}))", names) == "0 - cs_rank(size)"
    with pytest.raises(language.LanguageError):
        language.translate("rank({f3})", names)


def test_shared_parts_are_computed_once(spark):
    panel = spark.createDataFrame([("2024-01-01", "A", 1.0), ("2024-01-01", "B", 3.0)], "date string, stock_id string, close double")
    out = language.evaluate(panel, {"x": "cs_rank(close) + 1", "y": "cs_rank(close) * 2"}, ["close"]).orderBy("stock_id").collect()
    assert [(r.x, r.y) for r in out] == [(1.5, 1.0), (2.0, 2.0)]
    assert set(out[0].asDict()) == {"date", "stock_id", "close", "x", "y"}


def test_portfolio_of_three(spark):
    rows = [(f"2024-01-0{d}", s, f, r) for d in (2, 3, 4, 5) for s, f, r in (("A", 3.0, 0.01), ("B", 2.0, 0.02), ("C", 1.0, -0.01))]
    panel = spark.createDataFrame(rows, "date string, stock_id string, f double, forward_1d_ret double").selectExpr("to_date(date) as date", "stock_id", "f", "forward_1d_ret")
    got = portfolio.backtest(panel, "f", top_n=1).orderBy("date").collect()
    assert math.isclose(got[0]["ret"], 0.009) and math.isclose(got[-1]["nav"], 1.009 * 1.01**3)
    assert [r.names for r in portfolio.holdings(panel, "f", 2).collect()] == [["A", "B"]] * 4


def test_as_of_takes_the_latest_known(spark):
    left = spark.createDataFrame([("A", 1), ("A", 5), ("B", 5)], "stock_id string, date int")
    right = spark.createDataFrame([("A", 2, 1.0), ("A", 5, 2.0), ("A", 6, 3.0)], "stock_id string, date int, v double")
    assert sorted(map(tuple, portfolio.as_of(left, right, "v").collect()), key=str) == [("A", 1, None), ("A", 5, 2.0), ("B", 5, None)]


def test_selection_finds_the_factor_that_matters(spark):
    rows = [(f"2024-01-{1 + i % 20:02d}", str(i), float(i % 7), float((i * 31) % 11), float(i % 7) * 2 + ((i * 17) % 5) * 0.01) for i in range(400)]
    panel = spark.createDataFrame(rows, "date string, stock_id string, a double, b double, forward_1d_ret double")
    data = mining.features(panel, ["a", "b"]).persist()
    assert next(iter(mining.tree_selection(data, ["a", "b"], numTrees=10))) == "a"
    assert "a" in mining.ridge_selection(data, ["a", "b"]) and "a" in mining.linear_selection(data, ["a", "b"], (1e-3, 1e-1), folds=2)
    chosen = spark.createDataFrame([("x", "a"), ("y", "a"), ("y", "b")], "method string, factor string")
    assert [tuple(r) for r in mining.votes(chosen, 3).collect()] == [("a", 2)]
    data.unpersist()


def test_memory_and_cache(spark, tmp_path):
    memory = ResearchMemory(spark, f"file://{tmp_path}/memory")
    assert tuple(memory.stats().first()) == (0, 0, 0)
    memory.put("candidates", [("h1", "x", "[]", 0, "PENDING", 1.0), ("h2", "y", "[]", 0, "PENDING", 1.0), ("h1", "x2", "[]", 0, "PENDING", 2.0)])
    memory.put("evaluations", [("h1", 0.1, 1.0, 0.5, 2.0, "PASSED", 3.0)])
    assert tuple(memory.stats().first()) == (2, 1, 1)
    assert memory.table("candidates").where("ast_hash = 'h1'").first()["canonical"] == "x2"
    assert pair_key("b", "a") == "a|b" and run_identity(a=1, b=2) == run_identity(b=2, a=1) != run_identity(a=1, b=3)
    cache = Cache(spark, f"file://{tmp_path}/cache")
    assert cache.get("raw", "k") is None and cache.metrics("k") is None
    assert cache.put("raw", "k", spark.range(3)).count() == 3
    cache.put_metrics("k", {"ic": 0.5})
    assert cache.metrics("k") == {"ic": 0.5}


def test_stream_bars_equal_batch_bars(spark, tmp_path):
    from millrace.streaming.bars import daily_bars

    events = spark.read.parquet(f"{SMALL}/events.parquet").select("user_id", "ts", "value").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = daily_bars(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("bars").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got, want = spark.table("bars").toPandas(), daily_bars(events).toPandas()
    assert as_rows(got) == as_rows(want)


def test_columns_of_the_panel_take_precedence(spark):
    from millrace.operators import factors

    rows = [(f"2024-{1 + d // 28:02d}-{1 + d % 28:02d}", "A", 10.0 + d, 100.0, 1000.0, ((d * 7) % 5) / 100 - 0.02, ((d * 3) % 7) / 100 - 0.03, 0.5) for d in range(90)]
    panel = spark.createDataFrame(rows, "date string, stock_id string, close double, volume double, shares_outstanding double, return double, mkt_return double, turnover double")
    got = panel.select(factors.factor(panel, "ch_turnover").alias("t"), factors.factor(panel, "beta").alias("b"), factors.factor(panel.drop("mkt_return"), "beta").alias("own"), factors.factor(panel, "bm").alias("none")).collect()
    last = got[-1]
    x, y = [r[5] for r in rows], [r[6] for r in rows]
    mx, my = sum(x) / 90, sum(y) / 90
    assert last.t == 0.5 and math.isclose(last.b, sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((b - my) ** 2 for b in y)) and last.own != last.b and last.none is None


def test_placeholders_and_spaces_of_mined_formulas():
    assert language.translate("rank ({f0})", ["size"]) == "cs_rank(size)"
    with pytest.raises(language.LanguageError) as bad:
        language.translate("rank({g0})", ["size"])
    assert bad.value.kind == "UnknownPlaceholder"
    assert language.parse("pb + roe").fields == ["pb", "roe"]


def test_search_and_mining(spark):
    rows = [(f"2024-{1 + i // 400:02d}-{1 + (i // 16) % 25:02d}", str(i % 16), float(i * 7 % 16), float((i * 31) % 11), float(i * 7 % 16) + ((i * 17) % 5) * 0.01) for i in range(1200)]
    panel = spark.createDataFrame(rows, "date string, stock_id string, a double, b double, forward_1d_ret double").persist()
    found = mining.search_formulas(panel, ["a", "b"], generations=1, size=6)
    assert found == sorted(found, key=lambda x: (-x[1], x[0])) and found[0][1] > 0.9 and all(0 <= v <= 1 for _, v in found)
    folds = mining.walk_forward(panel, folds=3, least=10, margin=5).orderBy("fold").collect()
    assert [f.fold for f in folds] == [0, 1, 2] and all(f.train_end < f.test_start <= f.test_end for f in folds)
    ridge = {"ridge": mining.ridge_selection}
    picked = mining.mine_walk_forward(panel, ["a", "b"], ridge, folds=3, least=10, margin=5)
    assert {(r.fold, r.factor) for r in picked.collect()} >= {(0, "a"), (1, "a"), (2, "a")}
    assert [r.share for r in mining.consensus(picked).where("factor = 'a'").collect()] == [1.0]
    panel.unpersist()


def test_harness_keeps_requests_and_universes_apart(spark, tmp_path):
    from millrace.sources.store import Harness

    make = lambda stocks, **on: Harness(spark, f"file://{tmp_path}", {"source": "x", "start": "a", "end": "b"}, stocks, ["close"], **on)
    one, other = make(["A", "B"]), make(["A"])
    assert one.request == other.request and one.resolved != other.resolved == make(["A"]).resolved
    one.store("raw", "close", spark.range(2))
    one.store("factors", "f", spark.range(3), ast="h")
    one.store("nodes", "cs_rank(close)", spark.range(4))
    one.store_metrics("f", {"ic": 0.1}, ast="h")
    assert other.load("raw", "close").count() == 2 and other.load("factors", "f", ast="h") is None and one.load("factors", "f", ast="h").count() == 3
    assert one.load_metrics("f", ast="h") == {"ic": 0.1} and one.load_metrics("f", ast="g") is None and one.counts() == {"raw": 1, "nodes": 1, "factors": 1, "metrics": 1}
    off = make(["A"], cache=False, memory=False)
    off.store("raw", "z", spark.range(1))
    assert off.load("raw", "z") is None and off.load_metrics("f") is None
    with pytest.raises(RuntimeError):
        off.memory
    one.memory.put_correlation("b", "a", 0.5, 1)
    one.memory.put_correlation("a", "b", 0.7, 2)
    assert one.memory.get("factor_correlations", "a|b")["rho"] == 0.7 and one.memory.get("factor_correlations", "c|d") is None
    one.memory.put_checkpoint("run", {"step": 1}, 1)
    one.memory.put_checkpoint("run", {"step": 2}, 2)
    one.memory.compact("checkpoints")
    assert one.memory.checkpoint("run") == {"step": 2} and one.memory.checkpoint("none") is None


def test_loaders(spark, tmp_path):
    from millrace.sources import loaders

    raw = spark.createDataFrame([("600000", "a"), ("00001", "b"), ("000002", "c"), ("x00002", "d")], "code string, name string")
    assert [tuple(r) for r in loaders.listed_stocks(raw).withColumn("s", loaders.exchange_symbol(F.col("stock_id"))).orderBy("stock_id").collect()] == [("000002", "c", None, "sz000002"), ("600000", "a", None, "sh600000")]
    bars = spark.createDataFrame([(f"2024-01-0{d}", s, 10.0 + d, 1e6) for s in ("000002", "600000") for d in (1, 2, 3)], "date string, stock_id string, close double, volume double")
    bars.write.partitionBy("stock_id").option("partitionOverwriteMode", "static").parquet(f"{tmp_path}/bars")
    got = loaders.daily_bars_of(spark, f"{tmp_path}/bars", start="2024-01-02", end="2024-01-02")
    assert sorted((r.close, str(r.date)) for r in got.collect()) == [(12.0, "2024-01-02")] * 2
    reports = spark.createDataFrame([("A", "2023", "5", "10", "2", "-9", "4"), ("A", "2024", None, "12", "x", "3", "7"), ("B", "2022", "1", "1", "1", "-2", "")],
                                    "stock_id string, report_date string, cash string, sales string, surplus_reserve string, undistributed_profit string, operating_cost string")
    cols = ["cash", "sales", "surplus_reserve", "undistributed_profit", "operating_cost"]
    last = {r.stock_id: r for r in loaders.latest_statements(reports, cols).collect()}
    assert (last["A"].cash, last["A"].sales, last["A"].retained_earnings, last["A"].gross_profit) == (0.0, 12.0, 3.0, 5.0) and last["B"].retained_earnings is None and last["B"].gross_profit == 1.0
    panel = loaders.statement_panel(bars.replace({"000002": "A", "600000": "B"}, subset=["stock_id"]), reports, cols, most=1).orderBy("date").collect()
    assert [(r.stock_id, r.sales, round(r["return"], 6)) for r in panel] == [("A", 12.0, round(1 / 11, 6)), ("A", 12.0, round(1 / 12, 6))]
    wide = spark.createDataFrame([("2024-01-01", 1.0, 5.0, 2.0, None), ("2024-01-02", 2.0, 5.0, 3.0, None)], "date string, `close|A` double, `volume|A` double, `close|B` double, `volume|B` double")
    assert sorted((r.stock_id, r["return"], r.sales) for r in loaders.from_wide(wide, ["A", "B"]).collect()) == [("A", 1.0, None), ("B", 0.5, None)]
    made = loaders.synthetic_panel(spark, 20, 50)
    rows = made.orderBy("stock_id", "date").collect()
    assert len(rows) == 1000 and rows == loaders.synthetic_panel(spark, 20, 50).repartition(3).orderBy("stock_id", "date").collect() and all(r.close > 0 for r in rows)
    assert abs(sum(r["return"] for r in rows) / 1000) < 0.01


def test_sinks(spark, tmp_path):
    from millrace.operators import summary
    from millrace.sources import sinks

    frame = spark.createDataFrame([("f1", 0.5, 0.9, 2.5), ("f<2", -0.2, None, 0.1)], "factor string, mean_ic double, ls_sharpe double, fm_t double").withColumn("ic_positive", F.lit(0.6)).withColumn("ir", F.col("mean_ic"))
    found = summary.analysis(frame)
    row = found.first()
    assert (row["valid_ic"], row["valid_overall"], row["best_factor"], row["quality"]) == (2, 1, "f1", "high")
    sinks.write_markdown(frame, f"{tmp_path}/md", found)
    sinks.write_html(frame, f"{tmp_path}/html", found)
    sinks.write_json(found, f"{tmp_path}/json")
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/md").collect())
    assert "| f1 | 0.5000 | 0.9000 | 2.5000 | 0.6000 | 0.5000 |" in text and "Best factor: **f1**" in text
    assert "<td>f&lt;2</td>" in spark.read.text(f"{tmp_path}/html", wholetext=True).first().value
    sinks.write_csv(frame, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2
    panel = spark.createDataFrame([("2024-01-31", "A", 1.0), ("2024-02-01", "B", 2.0)], "date string, stock_id string, v double").withColumn("date", F.to_date("date"))
    sinks.write_panel(panel, f"{tmp_path}/panel")
    assert spark.read.parquet(f"{tmp_path}/panel").where("month = '2024-02'").count() == 1
    wide = sinks.matrix(panel, "v", ["A", "B"])
    assert dict(wide.dtypes)["A"] == "float" and [tuple(r)[1:] for r in wide.orderBy("date").collect()] == [(1.0, None), (None, 2.0)]
    nav = panel.select("date", F.col("v").alias("nav"), F.col("v").alias("benchmark_nav"))
    sinks.write_nav(nav, f"{tmp_path}/nav")
    assert spark.read.option("header", True).csv(f"{tmp_path}/nav").columns == ["date", "portfolio", "benchmark"]


def test_linear_selection_equals_a_fit_by_rows(spark):
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.regression import LinearRegression

    rows = [(f"2024-01-{1 + i % 20:02d}", str(i), float(i % 7), float((i * 31) % 11), 3.0, float(i % 7) * 2 - ((i * 31) % 11) * 0.3 + ((i * 17) % 5)) for i in range(400)]
    panel = spark.createDataFrame(rows, "date string, stock_id string, a double, b double, c double, forward_1d_ret double")
    data = mining.features(panel, ["a", "b", "c"]).persist()
    scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(data).transform(data)
    want = LinearRegression(featuresCol="scaled", regParam=0.2, elasticNetParam=1.0, standardization=False, tol=1e-12, maxIter=1000).fit(scaled).coefficients
    got = mining.linear_selection(data, ["a", "b", "c"], (0.2,))
    assert set(got) == {"a", "b"} and all(math.isclose(got[f], w, rel_tol=3e-3) for f, w in zip("ab", want))
    assert set(mining.elastic_selection(data, ["a", "b", "c"])) == {"a", "b"}
    assert mining.early_end(data) == "2024-01-16" and mining.early_end(data.limit(0)) is None
    for select in mining.METHODS["lasso"], mining.METHODS["elastic"], mining.METHODS["ridge"], mining.METHODS["neural"]:
        assert select(data.limit(0), ["a", "b", "c"]) == {}
    for how in (mining.SECOND_ORDER, mining.LEAF_WISE):
        late = mining.histogram_selection(data, ["a", "b", "c"], replace(how, trees=3, rate=0.3))
        assert next(iter(late)) == "a"
    data.unpersist()


def test_moments_of_parts_add_up(spark):
    import numpy as np

    rows = [(f"2024-01-{1 + i % 5:02d}", str(i), float(i % 7), 1e6 + i % 11, float(i % 3)) for i in range(60)]
    data = mining.features(spark.createDataFrame(rows, "date string, stock_id string, a double, b double, forward_1d_ret double"), ["a", "b"])
    whole, parts = mining.moments(data, 2)[0], mining.moments(data, 2, (F.col("date") > "2024-01-02").cast("int"))
    x = np.array([r[2:] for r in rows])
    for m in (whole, parts[0] + parts[1]):
        assert m.n == 60 and np.allclose(m.mean, x.mean(axis=0)) and np.allclose(m.scatter, np.cov(x.T, bias=True) * 60)


def test_network_gradient_and_selection(spark):
    import numpy as np

    from millrace.operators import neural

    rng = np.random.default_rng(1)
    sizes, x, y = (3, 5, 4, 1), rng.normal(size=(20, 3)), rng.normal(size=20)
    flat = rng.normal(size=3 * 5 + 5 + 5 * 4 + 4 + 4 + 1)
    loss = lambda w: 0.5 * ((neural.outputs(w, sizes, x)[-1][:, 0] - y) ** 2).sum()
    step = 1e-6 * np.eye(len(flat))
    assert np.allclose(neural.gradient(flat, sizes, x, y), [(loss(flat + d) - loss(flat - d)) / 2e-6 for d in step], rtol=1e-4, atol=1e-5)
    rows = [(f"2024-01-{1 + i % 20:02d}", str(i), float(i % 7), float((i * 31) % 11), abs(i % 7 - 3.0)) for i in range(400)]
    data = mining.features(spark.createDataFrame(rows, "date string, stock_id string, a double, b double, forward_1d_ret double"), ["a", "b"]).persist()
    got = neural.neural_selection(data, ["a", "b"], hidden=(16,), steps=40)  # not linear in a
    assert next(iter(got)) == "a" and got["a"] > 10 * got.get("b", 0.0)
    assert neural.neural_selection(data.withColumn("label", F.lit(1.0)), ["a", "b"]) == {}
    data.unpersist()


def test_tail_factors_with_ties_and_gaps(spark):
    import numpy as np

    from millrace.operators import factors

    ret = [None if d % 17 == 0 else ((d * 7) % 5) / 10 - 0.2 if d % 3 else float((d * 31) % 97) / 100 - 0.5 for d in range(400)]
    panel = spark.createDataFrame([(d, "A", r) for d, r in enumerate(ret)] + [(0, "B", None)], "date int, stock_id string, return double")
    got = panel.select("stock_id", "date", factors.factor(panel, "var_95").alias("q"), factors.factor(panel, "cvar_95").alias("m")).collect()
    assert len(got) == 401
    for r in got:
        seen = np.array([x for x in ret[max(0, r.date - 251) : r.date + 1] if x is not None] if r.stock_id == "A" else [])
        if len(seen) < 60:
            assert r.q is None and r.m is None
        else:
            cut = np.quantile(seen, 0.05)
            assert math.isclose(r.q, cut, abs_tol=1e-12) and math.isclose(r.m, seen[seen <= r.q].mean(), abs_tol=1e-12)
