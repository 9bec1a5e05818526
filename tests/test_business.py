import datetime as dt
import json

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.errors import DataContractError, EngineError, NotFittedError
from tidemark.operators import currency, deals, finance, snapshots, transforms as X
from tidemark.plans import cli, engine, tools
from tidemark.sources import readers
from tidemark.sources.synthetic import demo_panel, panel_of

STAGES, CLOSED = ["lead", "demo"], {"won_stage": "won", "lost_stage": "lost"}
DEAL = "opp_id string, amount double, stage string"


def test_waterfall_one_deal_a_category(spark):
    b = [("up", 10.0, "lead"), ("down", 10.0, "lead"), ("adv", 5.0, "lead"), ("reg", 5.0, "demo"), ("w", 7.0, "demo"), ("l", 8.0, "lead"), ("gone", 9.0, "lead"), ("same", 3.0, "lead")]
    a = [("up", 12.0, "lead"), ("down", 4.0, "lead"), ("adv", 5.0, "demo"), ("reg", 5.0, "lead"), ("w", 99.0, "won"), ("l", None, "lost"), ("same", 3.0, "lead"), ("new", 6.0, "lead")]
    got = {r.category: (r.n_deals, r.amount) for r in deals.waterfall(spark.createDataFrame(b, DEAL), spark.createDataFrame(a, DEAL), STAGES, **CLOSED).collect()}
    assert got == {"expanded": (1, 2.0), "contracted": (1, -6.0), "advanced": (1, 0.0), "regressed": (1, 0.0), "won": (1, -7.0), "lost": (1, -8.0), "removed": (1, -9.0), "unchanged": (1, 0.0), "created": (1, 6.0)}
    with pytest.raises(DataContractError):
        deals.waterfall(spark.createDataFrame([("x", None, "lead")], DEAL), spark.createDataFrame(a, DEAL), STAGES, **CLOSED)


side = st.dictionaries(st.sampled_from("abcdefg"), st.tuples(st.integers(0, 50), st.sampled_from([*STAGES, "won", "lost"])), min_size=1)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(side, side)
def test_bridge_identity(spark, before, after):
    frame = lambda s: spark.createDataFrame([(k, float(v), g) for k, (v, g) in s.items()], DEAL)
    rows = deals.waterfall_summary(frame(before), frame(after), STAGES, validate=False, **CLOSED).collect()
    assert rows[0].amount + sum(r.amount for r in rows[1:-1]) == pytest.approx(rows[-1].amount)
    assert sum(r.n_deals for r in rows[1:-1]) == len({*before, *after})


def test_weighted_pipeline_keeps_null_groups(spark):
    d = spark.createDataFrame([("a", 10.0, 0.5), (None, 20.0, 0.25), ("a", 30.0, 1.0)], "g string, amount double, proba double")
    got = {r.g: (r.n_deals, r.expected) for r in deals.weighted_pipeline(d, by="g").collect()}
    assert got == {"a": (2, 35.0), None: (1, 5.0)}
    one = deals.weighted_pipeline(d, level=80).first()
    assert 0 <= one.lo_80 <= one.expected <= one.hi_80 <= 60
    with pytest.raises(Exception, match="probabilities"):
        deals.weighted_pipeline(d.withColumn("proba", F.lit(1.5))).collect()


def test_quota(spark):
    f = spark.createDataFrame([("a", 10.0, 10.0, 10.0), ("b", 10.0, 8.0, 12.0)], "unique_id string, yhat double, lo_80 double, hi_80 double")
    got = {r.unique_id: r.probability for r in deals.attainment(f, 10.0).collect()}
    assert got["a"] == 1.0 and got["b"] == pytest.approx(0.5, abs=1e-6)
    q = spark.createDataFrame([("a", 1.0), ("zz", 2.0)], "unique_id string, quota double")
    assert [r.unique_id for r in deals.unmatched_quotas(q, f).collect()] == ["zz"]
    with pytest.raises(Exception, match="no quota"):
        deals.attainment(f, q).collect()


def test_anomalies(spark):
    y = [100.0, 101.0] * 15
    y[20] = 120.0
    for method in ("zscore", "iqr"):
        got = [r.ds for r in deals.detect_anomalies(panel_of(spark, y), method=method).filter("is_anomaly and severity = 'critical'").collect()]
        assert got == [20]
    flat = deals.detect_anomalies(panel_of(spark, [5.0] * 8 + [6.0])).orderBy("ds").collect()
    assert flat[7].score == 0 and flat[8].score == float("inf")


def test_scenarios(spark):
    base = deals.Scenario({"top_of_funnel": 1000, "win_rate": 0.3, "acv": 10})
    assert base.project() == 3000 and base.bump(win_rate=-0.1).project() == pytest.approx(2000)
    assert base.project({"won": "win_rate"}) == 3000
    with pytest.raises(EngineError):
        base.set(typo=1)
    with pytest.raises(EngineError):
        base.set(win_rate=-0.1).project()
    rows = spark.createDataFrame([("base", base.drivers), ("up", base.set(win_rate=0.6).drivers)], "label string, drivers map<string,double>")
    assert {r.label: r.pct_delta for r in deals.compare_scenarios(rows, "base").collect()} == {"base": 0.0, "up": 1.0}


def test_deal_scorer_recovers_signs(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(1500, 2))
    won = r.random(1500) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))
    d = spark.createDataFrame([(i, float(a), float(b), bool(w)) for i, ((a, b), w) in enumerate(zip(x, won))], "opp_id long, x1 double, x2 double, won boolean")
    m = deals.DealScorer(["x1", "x2"], calibrate=True).fit(d)
    assert m.weights[1] > 1.5 and m.weights[2] < -0.6
    p = d.select(m.predict_proba().alias("p"), F.col("won").cast("double").alias("w")).agg(F.avg("p"), F.avg("w")).first()
    assert p[0] == pytest.approx(p[1], abs=0.02)
    with pytest.raises(NotFittedError):
        deals.DealScorer(["x1"]).predict_proba()


def test_currency(spark):
    d = spark.createDataFrame([(1, 100.0, "EUR", "2024-05-01"), (2, 200.0, "GBP", "2024-06-02"), (3, 50.0, "USD", None), (4, 100.0, "EUR", "2024-06-01")], "opp_id int, amount double, currency string, d string")
    rates = spark.createDataFrame([("EUR", "2024-01-01", 1.05), ("EUR", "2024-06-01", 1.10), ("GBP", "2024-01-01", 1.27)], "currency string, as_of string, rate double")
    got = {r.opp_id: round(r.amount, 6) for r in currency.convert(d, rates, date_col="d").collect()}
    assert got == {1: 105.0, 2: 254.0, 3: 50.0, 4: 110.0}
    assert {r.opp_id: round(r.amount, 6) for r in currency.convert(d, {"EUR": 1.08, "GBP": 1.27}).collect()}[1] == 108.0
    with pytest.raises(Exception, match="no rate for GBP"):
        currency.convert(d, {"EUR": 1.08}).collect()
    with pytest.raises(ValueError):
        currency.convert(d, {"EUR": 1.0, ("GBP", "USD"): 2.0})


def test_transforms_invert(spark, panel):
    for t in (X.StandardScaler(), X.LogTransform(), X.Differencer(2), X.LogitTransform(-500, 900), X.Pipeline([("l", X.LogTransform()), ("d", X.Differencer(1))])):
        back = t.inverse_transform(t.fit_transform(panel)).withColumnRenamed("y", "z").join(panel, ["unique_id", "ds"])
        assert back.filter(F.abs(F.col("y") - F.col("z")) > 1e-6).count() == 0 and back.count() >= 3 * 78
    with pytest.raises(NotFittedError):
        X.StandardScaler().transform(panel)
    t = X.StandardScaler().fit(panel)
    with pytest.raises(Exception, match="not fitted"):
        t.transform(panel_of(spark, [1.0], [dt.datetime(2024, 1, 1)], "other")).collect()
    cont = X.Differencer(1)
    cont.fit(panel_of(spark, [1.0, 4.0, 9.0]))
    ahead = spark.createDataFrame([("series-0", 3, 1.0), ("series-0", 4, 2.0)], "unique_id string, ds long, yhat double")
    assert [r.yhat for r in cont.inverse_transform(ahead).orderBy("ds").collect()] == [10.0, 12.0]


def test_imputer(spark):
    p = spark.createDataFrame([("a", i, v) for i, v in enumerate([None, 1.0, None, 3.0, None])], "unique_id string, ds long, y double")
    got = lambda m: [r.y for r in X.Imputer(m).fit_transform(p).orderBy("ds").collect()]
    assert got("interpolate") == [1, 1, 2, 3, 3] and got("ffill") == [None, 1, 1, 3, 3] and got("bfill") == [1, 1, 3, 3, None] and got("mean") == [2, 1, 2, 3, 2]


def test_risk_metrics_by_hand(spark):
    r = [0.1, -0.05, 0.02, 0.0]
    m = finance.risk_metrics(panel_of(spark, r), periods=4).first()
    assert m.total_return == pytest.approx(np.prod([1 + x for x in r]) - 1) and m.hit_rate == 0.5
    assert m.max_drawdown == pytest.approx(-0.05) and m.sharpe == pytest.approx(np.mean(r) / np.std(r, ddof=1) * 2)
    assert m["var"] == pytest.approx(-np.quantile(r, 0.05))
    assert finance.risk_metrics(panel_of(spark, [0.1, None, 0.2])).first().sharpe is None


def test_backtest_positions_and_costs(spark):
    s = spark.createDataFrame([("a", i, 0.01, f) for i, f in enumerate([1.0, -1.0, 1.0])], "unique_id string, ds long, y double, yhat double")
    got = finance.strategy(s, 100.0).orderBy("ds").collect()
    assert [r.position for r in got] == [1, 0, 1] and [round(r.strategy_return, 9) for r in got] == [0.0, -0.01, 0.0]
    summary, frame, periods = finance.backtest(panel_of(spark, np.random.default_rng(0).normal(0, 0.01, 40)), "naive", 10, sizing="kelly")
    assert periods == 252 and frame.count() == 10 and summary.first().n_trades >= 0


def test_monte_carlo_mean(spark):
    q = finance.simulation_summary(finance.simulate(spark, 100.0, 0.001, 0.02, 10, 4000, 3)).orderBy("step").collect()
    assert q[-1]["mean"] == pytest.approx(100 * np.exp(0.01), rel=0.01) and q[-1].q05 < q[-1].q50 < q[-1].q95
    a, b = (finance.simulate_seeded(spark, 1.0, 0, 0.1, 3, 4, 1).toPandas().value.tolist() for _ in range(2))
    assert a == b


def test_snapshots(spark, panel, tmp_path):
    s = snapshots.SnapshotStore(spark, str(tmp_path))
    s.snapshot(panel, "2024-01-01")
    s.snapshot(panel.limit(5), "2024-01-01")
    s.snapshot(panel.filter("unique_id = 'series-0'"), "2024-02-01", label="x")
    assert s.load("2024-01-01").count() == 5 and s.load().count() == 80
    assert s.history().count() == 240 + 5 + 80 and s.history(latest_only=True).count() == 85
    assert {r.unique_id for r in s.history(series="series-0").select("unique_id").distinct().collect()} == {"series-0"}
    assert s.as_of_dates().count() == 2 and s.manifest().count() == 3
    with pytest.raises(EngineError):
        s.load("2030-01-01")
    with pytest.raises(DataContractError):
        s.snapshot(panel, "2024-01-01", kind="deals")


def fake(pages):
    calls = []

    def get(url, headers, params, timeout):
        calls.append((url, dict(headers), dict(params or {})))
        return 200, json.dumps(pages[len(calls) - 1])

    return get, calls


def test_rest_pagination_styles():
    get, calls = fake([{"r": [{"id": 1, "a": {"b": 2}}], "n": "c2"}, {"r": [{"id": 2}], "n": None}])
    got = list(readers.Pages("http://h/x", records_path="r", pagination={"style": "cursor", "cursor_param": "after", "cursor_path": "n"}, get=get))
    assert got == [{"id": 1, "a.b": 2}, {"id": 2}] and calls[1][2] == {"after": "c2"}
    get, calls = fake([[{"id": 1}], []])
    assert len(list(readers.Pages("http://h/x", pagination={"style": "page", "page_param": "p"}, page_size=1, get=get))) == 1 and [c[2]["p"] for c in calls] == [1, 2]
    get, calls = fake([{"data": [{"id": 7}], "has_more": True}, {"data": [], "has_more": False}])
    list(readers.Pages("http://h/x", records_path="data", pagination={"style": "has_more"}, get=get))
    assert calls[1][2] == {"starting_after": 7}
    get, calls = fake([{"r": [], "next": "https://other/y"}, {"r": []}])
    with pytest.warns(UserWarning, match="not sent"):
        list(readers.Pages("http://h/x", headers={"Authorization": "s", "Accept": "j"}, records_path="r", pagination={"style": "next_url", "next_path": "next"}, get=get))
    assert calls[1][1] == {"Accept": "j"}
    with pytest.raises(ValueError):
        readers.Pages("http://h", pagination={"style": "cursor"})
    with pytest.raises(EngineError, match="HTTP 500"):
        list(readers.Pages("http://h", get=lambda *a: (500, "oops")))
    with pytest.raises(EngineError, match="not JSON"):
        list(readers.Pages("http://h", get=lambda *a: (200, "<html>")))


def test_presets_and_sql(spark, tmp_path):
    get, calls = fake([{"results": [{"id": "1", "properties": {"amount": "10", "dealstage": "closedwon", "closedate": "2024-01-02", "hubspot_owner_id": "o"}}]}])
    assert readers.hubspot(spark, "t", get=get).to_panel().first().y == 10.0 and calls[0][1]["Authorization"] == "Bearer t"
    panel_of(spark, [1.0, 2.0]).createOrReplaceTempView("v")
    assert readers.SQLSource(spark, "select * from v where y > :low", {"low": 1}).fetch().count() == 1
    with pytest.raises(EngineError, match="query failed"):
        readers.SQLSource(spark, "select nothing from nowhere").fetch()


def test_csv_to_forecast_by_tool_and_cli(spark, tmp_path, capsys):
    path = str(tmp_path / "in.csv")
    demo_panel(spark, 24).toPandas().to_csv(path, index=False)
    assert tools.preview_panel(spark, csv_path=path)["n_series"] == 6
    assert len(tools.forecast_tool(spark, ["naive"], 2, [80], csv_path=path)) == 12
    q = tools.quota_tool(spark, {"east/alice": 10.0, "nobody": 1.0}, "naive", 2, csv_path=path)
    assert len(q["attainment"]) == 1 and q["unmatched"][0]["unique_id"] == "nobody"
    with pytest.raises(ValueError):
        tools.forecast_tool(spark, ["nope"], 2, csv_path=path)
    assert cli.main(["forecast", path, "--model", "naive", "--h", "2", "--output", str(tmp_path / "out")], spark) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 12
    assert cli.main(["forecast", path, "--model", "nope"], spark) == 2 and "unknown model" in capsys.readouterr().err
    assert len(tools.list_mappings_tool(spark)) == 10


def test_terminal_rows(spark):
    p = demo_panel(spark, 24)
    assert all(len(r.spark) == 12 for r in engine.sparkline(p).collect())
    assert engine.dashboard(p).count() == 6


def test_streamed_panel_equals_batch(spark, tmp_path):
    from tidemark.operators.panel import to_panel
    from tidemark.streaming import panel_stream

    rows = [("a", dt.datetime(2024, 1, 1 + i // 4, i % 4), 1.0) for i in range(12)] + [("b", dt.datetime(2024, 1, 2), 5.0)]
    e = spark.createDataFrame(rows, "k string, t timestamp_ntz, v double")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = panel_stream.windowed_panel(s, "k", "t", "v", late="0 seconds").writeStream.outputMode("complete").format("memory").queryName("kept").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.unique_id, r.ds): r.y for r in spark.sql("select * from kept").collect()}
    assert got == {(r.unique_id, r.ds): r.y for r in to_panel(e, "k", "t", "v", "D").collect()}
