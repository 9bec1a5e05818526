import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import metrics as M
from tidemark.functions.errors import DataContractError
from tidemark.functions.series_models import MODELS, fit_hmm, fit_sbg, sbg_survival, stl
from tidemark.operators import forecaster, meta, native_models as N
from tidemark.plans.engine import Engine
from tidemark.sources.synthetic import air_passengers, generate_returns, panel_of


def scored(spark, y, p):
    return spark.createDataFrame([("a", "m", a, b) for a, b in zip(y, p)], "unique_id string, model string, y double, yhat double")


def test_point_metrics_by_hand(spark):
    got = {r.metric: r.value for r in M.evaluate(scored(spark, [1.0, 2.0, 0.0], [2.0, 2.0, 1.0]), ["mae", "rmse", "mape", "smape", "bias", "pct_bias", "tracking_signal"]).collect()}
    assert got == pytest.approx({"mae": 2 / 3, "rmse": math.sqrt(2 / 3), "mape": 0.5, "smape": (1 / 1.5 + 0 + 2) / 3, "bias": 2 / 3, "pct_bias": 2 / 3, "tracking_signal": 3.0})


def test_interval_metrics_by_hand(spark):
    df = scored(spark, [1.0, 5.0], [1.0, 2.0]).withColumns({"lo_80": F.lit(0.0), "hi_80": F.lit(4.0)})
    got = {r.metric: r.value for r in M.evaluate(df, ["coverage-80", "winkler-80", "wis", "pinball-80"]).collect()}
    assert got["coverage-80"] == 0.5
    assert got["winkler-80"] == pytest.approx((4 + 4 + 10) / 2)
    assert got["wis"] == pytest.approx(((0.4) / 1.5 + (1.5 + 0.1 * 14) / 1.5) / 2)


def test_scaled_metric_and_missing_scale(spark):
    train = panel_of(spark, [1.0, 2.0, 4.0], unique_id="a")
    got = M.evaluate(scored(spark, [5.0], [6.0]), ["mase"], train, 1).first().value
    assert got == pytest.approx(1 / 1.5)
    assert M.evaluate(scored(spark, [5.0], [6.0]), ["mase"], panel_of(spark, [3.0, 3.0], unique_id="a"), 1).first().value is None
    with pytest.raises(ValueError):
        M.evaluate(scored(spark, [5.0], [6.0]), ["mase"])


def test_crps_is_an_alias():
    with pytest.warns(FutureWarning):
        assert M.resolve(["crps", "wis", "mae"]) == ["wis", "mae"]


@pytest.mark.parametrize("name", sorted(MODELS))
def test_every_model_keeps_the_contract(spark, name):
    if name == "garch":
        p = generate_returns(spark, 2, 120, seed=5)
    elif name == "retention_sbg":
        p = panel_of(spark, sbg_survival(1.2, 3.5, 12))
    else:
        t = np.arange(60)
        p = panel_of(spark, np.abs(40 + t * 0.4 + 6 * np.sin(2 * np.pi * t / 7) + np.random.default_rng(3).normal(0, 1, 60)))
    params = {"m": 7} if name in ("sarima", "auto_sarima") else {}
    f = forecaster.forecast(p, [(name, params)], 4, [80, 95]).toPandas()
    assert len(f) == 4 * f.unique_id.nunique() and np.isfinite(f[["yhat", "lo_80", "hi_95"]]).all().all()
    assert (f.lo_95 <= f.lo_80).all() and (f.lo_80 <= f.yhat).all() and (f.yhat <= f.hi_80).all() and (f.hi_80 <= f.hi_95).all()


@pytest.mark.parametrize("name, native", [("naive", N.naive), ("drift", N.drift), ("window_average", N.window_average), ("croston", N.croston), ("tsb", N.tsb), ("seasonal_naive", N.seasonal_naive)])
def test_native_and_numpy_models_agree(spark, panel, name, native):
    p = panel.withColumn("y", F.when(F.dayofmonth("ds") % 3 == 0, 0.0).otherwise(F.col("y"))) if name in ("croston", "tsb") else panel
    a = native(p, 5).toPandas().sort_values(["unique_id", "step"])
    b = forecaster.forecast(p, [name], 5).toPandas().sort_values(["unique_id", "step"])
    assert np.allclose(a.yhat, b.yhat) and np.allclose(a.sigma, b.sigma)


def test_ses_and_holt_folds_agree_with_numpy(spark, panel):
    for native, spec in ((N.ses(panel, 4, 0.4), ("ses", {"alpha": 0.4})), (N.holt(panel, 4, 0.4, 0.2), ("holt", {"alpha": 0.4, "beta": 0.2}))):
        a = native.toPandas().sort_values(["unique_id", "step"])
        b = forecaster.forecast(panel, [spec], 4).toPandas().sort_values(["unique_id", "step"])
        assert np.allclose(a.yhat, b.yhat) and np.allclose(a.sigma, b.sigma)


def test_no_leakage_across_cutoffs(spark):
    p = panel_of(spark, np.arange(20.0))
    cv = forecaster.cross_validation(p, ["naive"], 2, 3).toPandas()
    assert sorted(cv.cutoff.unique()) == [13, 15, 17] and (cv.yhat == cv.cutoff).all() and (cv.ds > cv.cutoff).all()
    with pytest.raises(DataContractError, match="too short"):
        forecaster.cross_validation(p, ["naive"], 10, 3)


def test_failures_are_rows_and_leave_the_board(spark):
    p = panel_of(spark, -np.arange(40.0) - 1)
    board, failed = Engine(["naive", "croston"]).compare(p, 3, 2)
    assert [r.model for r in board.collect()] == ["naive"] and "negative" in failed.first().error
    with pytest.raises(Exception, match="negative"):
        forecaster.forecast(p, ["croston"], 2).collect()


def test_covariates_need_their_future(spark):
    r = np.random.default_rng(3)
    x = r.uniform(0, 10, 60)
    p = spark.createDataFrame([("a", i, 20 + 2.5 * float(v) + float(e), float(v)) for i, (v, e) in enumerate(zip(x, r.normal(0, 0.1, 60)))], "unique_id string, ds long, y double, spend double")
    with pytest.raises(DataContractError):
        forecaster.forecast(p, ["arima"], 2)
    nxt = spark.createDataFrame([("a", 60, 4.0), ("a", 61, 8.0)], "unique_id string, ds long, spend double")
    f = forecaster.forecast(p, [("arima", {"order": (0, 0, 0)})], 2, x_future=nxt).orderBy("step").toPandas()
    assert np.allclose(f.yhat, [30, 40], atol=0.3)


def test_save_and_load(spark, panel, tmp_path):
    m = forecaster.Fitted(("ses", {"alpha": 0.3})).fit(panel)
    m.save(str(tmp_path / "m"))
    again = forecaster.Fitted.load(spark, str(tmp_path / "m"))
    assert again.model == m.model and again.predict(2).count() == m.predict(2).count() == 6
    with pytest.raises(Exception, match="no saved model"):
        forecaster.Fitted.load(spark, str(tmp_path / "none"))


def test_registry_takes_users_models(spark, panel):
    @forecaster.register("zero_test", "ml")
    class Zero(MODELS["naive"]):
        def mean(self, s, h):
            return np.zeros(h)

    assert set(forecaster.forecast(panel, ["zero_test"], 2).toPandas().yhat) == {0.0}
    with pytest.raises(ValueError):
        forecaster.register("zero_test")(Zero)
    assert forecaster.list_models(spark, "ml").count() == 2


def test_seasonal_model_beats_naive_on_passengers(spark):
    board, _ = Engine(["naive", ("holt_winters", {"season_length": 12, "seasonal": "mul"})]).compare(air_passengers(spark), 12, 2)
    assert board.first().model == "holt_winters"


def test_ensemble_and_selection(spark, panel):
    f = forecaster.forecast(panel, ["naive", "drift"], 3, [80])
    e = meta.ensemble(f, "weighted", {"naive": 1, "drift": 3}, [80]).join(f.groupBy("unique_id", "step").pivot("model").agg(F.first("yhat")), ["unique_id", "step"])
    assert e.filter(F.abs(F.col("yhat") - 0.25 * F.col("naive") - 0.75 * F.col("drift")) > 1e-9).count() == 0
    out, winners = meta.auto_select(panel, ["naive", ("seasonal_naive", {"season_length": 7}), ("theta", {"season_length": 7})], 3, val_h=7)
    assert out.count() == 9 and {r.model for r in winners.collect()} == {"theta"}


def test_conformal_width_is_the_order_statistic(spark):
    p = panel_of(spark, [*np.zeros(20), *np.arange(1.0, 10.0)])
    f = meta.conformal(p, "window_average", 1, [80], 0.0, 9).first()
    assert (f.hi_80 - f.lo_80) / 2 == pytest.approx(9.0)


@pytest.mark.parametrize("method", ["bottom_up", "top_down", "mint_ols"])
def test_reconciled_sums_agree(spark, method):
    r = np.random.default_rng(1)
    rows = [(f"{a}/{b}", i, float(r.uniform(5, 9))) for a, b in (("w", "x"), ("w", "y"), ("e", "z")) for i in range(12)]
    p = spark.createDataFrame(rows, "unique_id string, ds long, y double")
    f = {(x.unique_id, x.step): x for x in meta.reconciled(p, "ses", 2, method, level=[80, 95]).collect()}
    for k in (1, 2):
        assert f["w", k].yhat == pytest.approx(f["w/x", k].yhat + f["w/y", k].yhat)
        assert f["total", k].yhat == pytest.approx(f["w", k].yhat + f["e", k].yhat)
        assert all(f[n, k].lo_95 <= f[n, k].lo_80 <= f[n, k].yhat <= f[n, k].hi_80 for n in ("total", "w", "w/x"))
    with pytest.raises(DataContractError):
        meta.check_tree(spark.createDataFrame([("a",), ("a/b",)], "unique_id string"))


def test_parameters_are_recovered():
    assert fit_sbg(sbg_survival(1.2, 3.5, 16)) == pytest.approx((1.2, 3.5), rel=0.02)
    r = np.random.default_rng(0)
    m = fit_hmm(np.concatenate((r.normal(-1, 0.4, 200), r.normal(1, 0.4, 200))))
    assert m["means"] == pytest.approx([-1, 1], abs=0.15)
    t = np.arange(280)
    _, cycles, rest = stl(100 + 5 * np.sin(2 * np.pi * t / 7) + 8 * np.cos(2 * np.pi * t / 28), (7, 28))
    assert set(cycles) == {7, 28} and np.abs(rest[30:-30]).max() < 1.5
