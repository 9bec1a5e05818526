"""Native plans behind the facade, selection, steps, zones, tree sweeps, fits against grids."""

import datetime as dt
import io
import math
from contextlib import redirect_stdout

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import contract as C, dates, series_models as S
from tidemark.functions.errors import EngineError
from tidemark.operators import deals, finance, forecaster, meta, native_models as N, panel as P
from tidemark.plans import cli
from tidemark.plans.engine import Engine
from tidemark.sources.synthetic import generate_series, panel_of


def plan(df):
    return df._jdf.queryExecution().toString()


def test_closed_forms_need_no_python(spark, panel):
    models = ["naive", "seasonal_naive", "drift", "window_average", ("ses", {"alpha": 0.3}), ("holt", {"alpha": 0.3, "beta": 0.1}), "croston", "tsb"]
    e = Engine(models, [80])
    assert "Pandas" not in plan(e.forecast(panel, 3)) and "Arrow" not in plan(e.cross_validate(panel, 3, 2))
    assert "Pandas" in plan(Engine(["theta"]).forecast(panel, 3))


@pytest.mark.parametrize("h, windows, step", [(3, 3, None), (4, 2, 1), (1, 5, 2)])
def test_native_windows_equal_fitted_ones(spark, h, windows, step):
    p = generate_series(spark, 2, 40, seed=3).withColumn("y", F.abs("y") * (F.dayofmonth("ds") % 3 > 0).cast("int"))
    models = ["naive", ("seasonal_naive", {"season_length": 5}), "drift", ("window_average", {"window": 4}), ("ses", {"alpha": 0.4}), ("holt", {"alpha": 0.4, "beta": 0.2}), "croston", "tsb"]
    got = forecaster.cross_validation(p, models, h, windows, step, [80]).toPandas()
    resolved = forecaster.resolve(models)
    want = forecaster._fitted_windows(p.select("unique_id", "ds", "y"), resolved, h, windows, step or h, []).toPandas()
    key = ["unique_id", "model", "window", "step"]
    both = got.merge(want, on=key, suffixes=("", "_w"))
    assert len(got) == len(want) == len(both) == 2 * len(models) * windows * h
    assert (both.ds == both.ds_w).all() and (both.cutoff == both.cutoff_w).all() and np.allclose(both.y, both.y_w)
    assert np.allclose(both.yhat, both.yhat_w) and np.allclose(both.sigma, both.sigma_w)


def test_native_refusals_are_rows(spark):
    p = panel_of(spark, [1.0, -2.0, 3.0, 4.0, 5.0])
    cv = forecaster.cross_validation(p, ["croston", "naive"], 1, 2)
    assert {(r.model, r.error) for r in cv.select("model", "error").distinct().collect()} == {("croston", "ValueError: demand must not be negative"), ("naive", None)}
    assert cv.filter("model = 'croston' and yhat is null").count() == 2


def test_large_residuals_do_not_overflow(spark):
    y = [1e200, -1e200, 3e200, 2e200]
    r = N.naive(panel_of(spark, y), 1).first()
    assert r.sigma == pytest.approx(S.residual_sigma(np.array(y), None), rel=1e-9) and math.isfinite(r.sigma)


def test_selection_fits_winners_only(spark):
    p = generate_series(spark, 3, 60, seed=2)
    out, winners = meta.auto_select(p, ["naive", ("theta", {"season_length": 7}), "drift"], 3, [80], val_h=7)
    best = {r.unique_id: r.model for r in winners.collect()}
    rows = out.collect()
    assert len(rows) == 9 and all(r.model == best[r.unique_id] for r in rows) and set(best.values()) == {"theta"}


def test_selection_takes_its_season_and_pool_from_the_panel(spark):
    daily = generate_series(spark, 2, 70, seed=4, season_amp=30.0)
    out, winners = meta.auto_select(daily, h=2, val_h=7)
    assert {r.model for r in winners.collect()} <= {"seasonal_naive", "theta", "auto_ets"} and out.count() == 4
    assert [x if isinstance(x, str) else x[0] for x in meta.default_pool(7)] == ["naive", "drift", "ses", "window_average", "seasonal_naive", "theta", "auto_ets"]
    assert meta.default_pool(1) == list(meta.PLAIN_POOL)
    with pytest.raises(ValueError, match="intervals"):
        meta.auto_select(daily, metric="coverage-80")
    with pytest.raises(ValueError, match="season_length"):
        meta.auto_select(daily, season_length="weekly")


def test_short_panels_hold_out_their_own_quarter(spark):
    rows = [("short", i, float(i)) for i in range(8)] + [("long", i, float(i % 3)) for i in range(40)]
    p = spark.createDataFrame(rows, "unique_id string, ds long, y double")
    held = meta.holdout(p, forecaster.resolve(["naive", "drift"])).groupBy("unique_id", "model").agg(F.count("*").alias("n"), F.count("yhat").alias("k")).collect()
    assert {(r.unique_id, r.n, r.k) for r in held} == {("short", 2, 2), ("long", 10, 10)}
    _, winners = meta.auto_select(p, ["naive", "drift"], 1, metric="mae")
    assert {r.unique_id: r.model for r in winners.collect()}["short"] == "drift"


def stamps(*days):
    return [dt.datetime.fromisoformat(x) for x in days]


@pytest.mark.parametrize("freq", ["D", "B", "W-SUN", "MS", "ME", "BME", "BMS", "QE", "YS", "h", "2D", "3h"])
def test_steps_follow_calendars(spark, freq):
    for start in ("2023-03-01", "2023-11-17"):
        ds = pd.date_range(start, periods=14, freq=freq)
        p = panel_of(spark, np.arange(9.0), list(ds[:9].to_pydatetime()))
        assert [r.ds for r in dates.future(dates.with_step(p), 5).orderBy("step").collect()] == list(ds[9:].to_pydatetime())


def test_irregular_steps_take_the_middle_difference(spark):
    p = panel_of(spark, np.arange(4.0), stamps("2024-01-01", "2024-01-02", "2024-01-05", "2024-01-07"))
    step = dates.with_step(p)
    assert not step.first().regular and dates.future(step, 1).first().ds == dt.datetime(2024, 1, 9) and dates.season_of(step) == 1 and dates.periods_per_year(step) == 252


def test_zones_bucket_by_their_own_clocks(spark):
    t = spark.createDataFrame([("2024-03-10T04:30:00Z",), ("2024-03-10T05:30:00Z",), ("2024-09-08T05:00:00Z",)], "t string")
    at = lambda zone: [str(r[0]) for r in t.select(dates.bucket_zoned(F.col("t").cast("timestamp"), "D", zone)).collect()]  # noqa: E731  the session is in UTC
    assert at("America/New_York") == ["2024-03-09 05:00:00", "2024-03-10 05:00:00", "2024-09-08 04:00:00"]
    assert at("America/Santiago")[2] == "2024-09-08 04:00:00"  # its midnight was skipped: the day begins at one o'clock


def test_tree_sweeps_equal_the_matrix(spark):
    leaves = ["a/x/1", "a/x/2", "a/y/1", "b/z/1", "b/z/2", "b/z/3", "c/q/1"]
    nodes = sorted({"total", *leaves, *("/".join(x.split("/")[:k]) for x in leaves for k in (1, 2))})
    r = np.random.default_rng(0)
    yhat = {(n, k): float(r.normal(10, 5)) for n in nodes for k in (1, 2)}
    under = lambda n, x: float(n == "total" or x == n or x.startswith(n + "/"))
    s = np.array([[under(n, x) for x in leaves] for n in nodes])
    f = spark.createDataFrame([(n, k, v) for (n, k), v in yhat.items()], "unique_id string, step int, yhat double")
    got = {(x.unique_id, x.step): x.yhat for x in meta.reconcile(f, spark.createDataFrame([(x,) for x in leaves], "unique_id string"), "mint_ols").collect()}
    for k in (1, 2):
        want = s @ np.linalg.solve(s.T @ s, s.T @ np.array([yhat[n, k] for n in nodes]))
        assert [got[n, k] for n in nodes] == pytest.approx(want.tolist())


# ---- fits: no worse than grids, and as their recursions say ----


def series(n=90, seed=0):
    t = np.arange(n)
    return 50 + 0.4 * t + 8 * np.sin(2 * np.pi * t / 12) + np.random.default_rng(seed).normal(0, 3, n)


def test_smoothing_fits_are_no_worse_than_grids():
    y = series()
    alphas = np.linspace(0.01, 0.99, 99)
    assert S.SES().fit(y)["sse"] <= min(S.SES(a).fit(y)["sse"] for a in alphas) * (1 + 1e-7)
    holt = S.Holt().fit(y)["sse"]
    assert holt <= min(S.Holt(a, b).fit(y)["sse"] for a in alphas[::7] for b in np.linspace(0.01, 0.3, 12)) * (1 + 1e-6)
    hw = S.HoltWinters(12).fit(y)["sse"]
    grid = [S.HoltWinters(12, "add", a, b, g).fit(y)["sse"] for a in (0.02, 0.1, 0.3, 0.6) for b in (0.01, 0.05, 0.2) for g in (0.02, 0.1, 0.4, 0.8)]
    assert hw <= min(grid) * (1 + 1e-6)


def test_arima_and_kalman_fits_are_no_worse_than_grids():
    y = series(70, 2)
    for order in ((1, 0, 0), (0, 1, 1), (1, 1, 1)):
        s = S.fit_sarima(y, order)
        w = np.diff(y, n=order[1])
        best = math.inf
        for ar in np.linspace(-0.98, 0.98, 15) if order[0] else [None]:
            for ma in np.linspace(-0.98, 0.98, 15) if order[2] else [None]:
                if order == (1, 1, 1) and max(abs(ar - s["ar"][0]), abs(ma - s["ma"][0])) > 0.3:
                    continue  # the fit starts from zeros, as documented, and two optima may lie apart
                for c in (w.mean(), w.mean() * 1.05) if order[1] == 0 else (0.0,):
                    a, b = np.array([] if ar is None else [ar]), np.array([] if ma is None else [ma])
                    e = S.css_residuals(w.copy(), c * (1 - a.sum()) if order[1] == 0 else 0.0, a, b)
                    best = min(best, float((e[max(order[0], order[2]) :] ** 2).sum()))
        assert s["settled"] and s["sse"] <= best * (1 + 1e-6), order
    k = S.Kalman()
    z = y / float(np.std(np.diff(y)))
    fit = k.fit(y)
    v = np.log([fit["q"][0], fit["r"]])
    assert k._filter(z, v)[0] <= min(k._filter(z, np.array([a, b]))[0] for a in np.linspace(-8, 3, 23) for b in np.linspace(-8, 3, 23)) + 1e-6


def test_conditional_residuals_follow_their_recursion():
    r = np.random.default_rng(1)
    w, ar, ma = r.normal(size=40), np.array([0.4, -0.2]), np.array([0.5, 0.0, 0.3])
    e = np.zeros(40)
    for t in range(40):
        e[t] = w[t] - 0.1 - sum(ar[i] * w[t - 1 - i] for i in range(2) if t > i) - sum(ma[j] * e[t - 1 - j] for j in range(3) if t > j)
    assert np.allclose(S.css_residuals(w.copy(), 0.1, ar, ma), e)


def test_garch_finds_weak_and_strong_persistence():
    r = np.random.default_rng(3)
    for omega, alpha, beta in ((0.05, 0.1, 0.85), (0.8, 0.15, 0.05)):
        v, y = omega / (1 - alpha - beta), []
        for z in r.standard_normal(1500):
            y.append(0.3 + math.sqrt(v) * z)
            v = omega + alpha * (y[-1] - 0.3) ** 2 + beta * v
        y = np.array(y)
        fit = S.fit_garch(y)
        z = (y - y.mean()) / y.std()

        def nll(o, a, b):
            s = np.maximum(S.garch_variances(z, o, a, b), 1e-12)
            return 0.5 * float(np.sum(np.log(s) + z**2 / s))

        grid = min(nll((1 - p) * long, p * q, p * (1 - q)) for p in (0.05, 0.2, 0.5, 0.9, 0.95, 0.98) for q in (0.05, 0.1, 0.3, 0.7) for long in (0.8, 1.0, 1.2))
        assert fit["loss"] <= grid + 1e-6 and fit["alpha"] + fit["beta"] < 0.999
    assert S.GARCH().run(np.full(30, 2.0), 2)[0].tolist() == [0.0, 0.0]


def test_order_search_skips_what_does_not_settle(monkeypatch):
    y, whole, tried = series(60, 5), S.fit_sarima, []

    def spy(*a, **b):
        s = whole(*a, **b)
        tried.append(a[1])
        return s | {"settled": a[1] == (1, a[1][1], 0)}

    monkeypatch.setattr(S, "fit_sarima", spy)
    s = S.AutoARIMA()._fit(y)
    assert len(tried) == 16 and (len(s["ar"]), len(s["ma"])) == (1, 0)


def test_retention_fit_is_no_worse_than_a_grid():
    curve = np.array([1.0, 0.8, 0.7, 0.64, 0.6, 0.57, 0.55])
    lost = -np.diff(curve)

    def nll(a, b):
        s = S.sbg_survival(a, b, 6)
        return -float((lost * np.log(-np.diff(s))).sum() + curve[-1] * math.log(s[-1]))

    assert nll(*S.fit_sbg(curve)) <= min(nll(a, b) for a in np.linspace(0.2, 4, 39) for b in np.linspace(0.2, 9, 89)) + 1e-6


def test_regimes_rise_to_a_fixed_point():
    r = np.random.default_rng(0)
    y = np.concatenate([r.normal(m, 0.5, 60) for m in (-1, 1.2, -1)])
    m = S.fit_hmm(y)

    def likelihood(p):
        a, total = np.full(2, 0.5), 0.0
        for t, v in enumerate(y):
            dens = np.exp(-0.5 * ((v - p["means"]) / p["stds"]) ** 2) / (p["stds"] * math.sqrt(2 * math.pi))
            a = (a if t == 0 else a @ p["trans"]) * dens
            total, a = total + math.log(a.sum()), a / a.sum()
        return total

    top = likelihood(m)
    for key in ("means", "stds"):
        for i in (0, 1):
            for change in (0.9, 1.1):
                other = {k: np.array(v, float) for k, v in m.items() if k in ("means", "stds", "trans")}
                other[key][i] *= change
                assert likelihood(other) < top


def test_deal_scorer_equals_plain_newton(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(600, 2)) * [1, 5] + [0, 2]
    won = (r.random(600) < 1 / (1 + np.exp(-(1.2 * x[:, 0] - 0.2 * x[:, 1])))).astype(float)
    d = spark.createDataFrame([(i, float(a), float(b), float(w)) for i, ((a, b), w) in enumerate(zip(x, won))], "opp_id long, x1 double, x2 double, won double")
    m = deals.DealScorer(["x1", "x2"], calibrate=False).fit(d)
    z = np.column_stack((np.ones(600), (x - x.mean(0)) / x.std(0)))
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag([0, 1, 1]), z.T @ (won - p) - np.array([0, 1, 1]) * w)
    assert m.weights.tolist() == pytest.approx(w.tolist(), abs=1e-6)
    p = 1 / (1 + np.exp(-z @ w))
    assert m.loss == pytest.approx(float(-(won * np.log(p) + (1 - won) * np.log(1 - p)).mean()), abs=1e-6)
    assert deals.DealScorer(["x1", "x2"]).fit(d).loss < 0.7


def test_draws_do_not_depend_on_partitions(spark):
    a, b = (finance.simulate(spark, 1.0, 0.0, 0.1, 5, 50, 3).repartition(n).orderBy("path", "step").toPandas() for n in (1, 7))
    assert a.equals(b)
    z = spark.range(20000).select(finance.normal_draw(1, "id").alias("z")).agg(F.avg("z"), F.stddev("z"), F.expr("corr(z, z)")).first()
    assert abs(z[0]) < 0.03 and z[1] == pytest.approx(1, abs=0.03)
    q = finance.simulation_summary(finance.simulate(spark, 1.0, 0.0, 0.1, 2, 4000, 3), accuracy=10_000).orderBy("step").collect()
    assert q[1].q05 < q[1].q50 < q[1].q95


def test_probabilities_by_key(spark):
    d = spark.createDataFrame([("a", 10.0), ("b", 20.0)], "opp_id string, amount double")
    p = spark.createDataFrame([("b", 0.5), ("a", 0.1), ("z", 0.9)], "opp_id string, proba double")
    assert deals.weighted_pipeline(d, proba=p).first().expected == pytest.approx(11.0)
    with pytest.raises(Exception, match="no win probability for a"):
        deals.weighted_pipeline(d, proba=p.filter("opp_id <> 'a'")).collect()
    with pytest.raises(Exception, match="several win probabilities"):
        deals.weighted_pipeline(d, proba=p.union(p)).collect()


def test_index_operations(spark):
    a, b = panel_of(spark, [1.0, 2, 3]), panel_of(spark, [1.0, 2, 3, 4]).filter("ds > 0")
    ids = lambda x: sorted(r.ds for r in x.collect())
    assert ids(C.index_union(a, b)) == [0, 1, 2, 3] and ids(C.index_intersection(a, b)) == [1, 2] and ids(C.index_difference(a, b)) == [0]


# ---- command line ----


def run(spark, *argv):
    out = io.StringIO()
    with redirect_stdout(out):
        code = cli.main([str(a) for a in argv], spark)
    return code, out.getvalue().splitlines()


def test_command_line_prints_every_row(spark, tmp_path):
    path = tmp_path / "many.csv"
    pd.DataFrame([(f"s{i:04d}", f"2024-01-{d:02d}", d) for i in range(400) for d in (1, 2, 3)], columns=["unique_id", "ds", "y"]).to_csv(path, index=False)
    code, lines = run(spark, "forecast", path, "--model", "naive", "--h", 3)
    assert code == 0 and len(lines) == 1 + 1200


def test_command_line_buckets_before_it_aggregates(spark, tmp_path, capsys):
    path = tmp_path / "deals.csv"
    pd.DataFrame([("ann", "2024-01-05", 1.0), ("ann", "2024-01-25", 2.0), ("ann", "2024-03-02", 5.0)], columns=["rep", "closed", "amount"]).to_csv(path, index=False)
    named = ["--id-col", "rep", "--time-col", "closed", "--target-col", "amount", "--freq", "MS", "--model", "naive", "--h", 1]
    code, lines = run(spark, "forecast", path, *named, "--agg", "sum")
    assert code == 0 and lines[1].split(",")[4] == "5.0"
    assert run(spark, "forecast", path, *named)[0] == 2 and "--agg collapses" in capsys.readouterr().err
    assert run(spark, "forecast", path, *named, "--agg", "sum", "--fill", "null")[0] == 2 and "2024-02-01" in capsys.readouterr().err
    assert run(spark, "forecast", path, "--mapping", "generic_events", "--agg", "sum")[0] == 2 and "takes the place of --agg" in capsys.readouterr().err
    assert run(spark, "forecast", path, "--id-col", "nobody")[0] == 2 and "no column" in capsys.readouterr().err


def test_command_line_zone_and_parameters(spark, tmp_path):
    path = tmp_path / "t.csv"
    pd.DataFrame([("a", f"2024-03-{d:02d}T04:30:00Z", 1.0) for d in range(8, 14)], columns=["unique_id", "ds", "y"]).to_csv(path, index=False)
    code, lines = run(spark, "forecast", path, "--freq", "D", "--tz", "America/New_York", "--model", "naive", "--h", 1)
    assert code == 0 and len(lines) == 2
    code, lines = run(spark, "compare", path, "--models", "ses", "--param", "alpha=0.5", "--h", 1, "--windows", 2)
    assert code == 0 and lines[1].startswith("ses")
    returns = tmp_path / "r.csv"
    pd.DataFrame({"ds": range(30), "y": np.random.default_rng(0).normal(0, 0.01, 30)}).to_csv(returns, index=False)
    code, lines = run(spark, "simulate", "--from-returns", returns, "--steps", 3, "--paths", 50)
    assert code == 0 and len(lines) == 4


def test_seasonal_index_and_lags(spark):
    p = panel_of(spark, [1.0, 2, 3, 3, 6, 9])
    assert [round(r["index"], 6) for r in P.seasonal_index(p, 3).orderBy("place").collect()] == [0.5, 1.0, 1.5]
    assert [r.lag_2 for r in dates.lag_features(p, [2]).orderBy("ds").collect()] == [None, None, 1, 2, 3, 3]
    with pytest.raises(ValueError):
        dates.lag_features(p, [0])
    assert EngineError is not None
