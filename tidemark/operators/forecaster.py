"""Model registry, forecasting and walk-forward cross-validation.

Models that need no iterative fit are built-in expressions (native_models). The others of a series are fitted in one grouped map: one shuffle
on the series whatever the number of models and windows, as windows are cut inside the group. Failures are rows of
data (`error`), never warnings. Forecasts are long: unique_id, model, step, ds, yhat, sigma."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, is_dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.contract import ID, TARGET, TIME, by_time, check_finite, check_future, check_horizon, check_levels, covariates, positions, too_short, validate_panel
from ..functions.errors import DataContractError, EngineError, NotFittedError
from ..functions.metrics import with_bounds
from ..functions.series_models import MODELS, Model, Naive, SeasonalNaive, WindowAverage
from . import native_models

VERSION = 1


@dataclass(frozen=True)
class ModelSpec:
    name: str
    cls: type
    family: str
    description: str


_FAMILIES = {
    "baseline": ("naive", "seasonal_naive", "drift", "window_average"), "statistical": ("ses", "holt", "holt_winters", "auto_ets", "theta", "arima", "auto_arima", "sarima", "auto_sarima", "mstl", "kalman"),
    "ml": ("ridge_lag",), "intermittent": ("croston", "tsb"), "financial": ("garch",), "gtm": ("retention_sbg",), "meta": ("ensemble", "auto_select", "conformal", "reconciled"),
}
REGISTRY: dict[str, ModelSpec] = {}


def register(name: str, family: str = "statistical", description: str | None = None):
    """Decorator for a user's series model (a Model with fit, mean and sigma)."""

    def add(cls):
        if name in REGISTRY:
            raise ValueError(f"model {name!r} is registered")
        if family not in _FAMILIES:
            raise ValueError(f"families are {sorted(_FAMILIES)}")
        lines = (cls.__doc__ or "").strip().splitlines()
        REGISTRY[name] = ModelSpec(name, cls, family, description or (lines[0] if lines else name))
        return cls

    return add


for _family, _names in _FAMILIES.items():
    for _name in _names:
        if _name in MODELS:
            register(_name, _family, _name.replace("_", " "))(MODELS[_name])


def get_model(name: str, **params) -> Model:
    if name not in REGISTRY:
        raise EngineError(f"unknown model {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name].cls(**params)


def list_models(spark: SparkSession, family: str | None = None) -> DataFrame:
    rows = [(s.name, s.family, s.description) for s in REGISTRY.values() if family in (None, s.family)]
    rows += [(n, "meta", n) for n in _FAMILIES["meta"] if family in (None, "meta")]
    return spark.createDataFrame(sorted(rows), "name string, family string, description string")


def resolve(models) -> list[tuple[str, Model]]:
    """(label, model) of names, (name, params) pairs, {label: model} items or Model instances; labels are unique."""
    out = []
    for m in models:
        if isinstance(m, str):
            out.append((m, get_model(m)))
        elif isinstance(m, tuple) and isinstance(m[1], dict):
            out.append((m[0], get_model(m[0], **m[1])))
        elif isinstance(m, tuple):
            out.append((m[0], m[1]))
        elif isinstance(m, Model):
            out.append((type(m).__name__, m))
        else:
            raise ValueError(f"not a model: {m!r}")
    names = [n for n, _ in out]
    if not out or len(set(names)) < len(names):
        raise ValueError(f"models need unique names: {names}")
    return out


def params_of(model: Model) -> dict:
    return asdict(model) if is_dataclass(model) else dict(vars(model))


def clone(model: Model) -> Model:
    return type(model)(**params_of(model)) if is_dataclass(model) else type(model)()


def least_rows(model: Model) -> int:
    """Training rows that a model needs at least, as a candidate of a selection."""
    name, p = next((k for k, c in MODELS.items() if type(model) is c), ""), params_of(model)
    season = int(p.get("season_length") or 1)
    if name in ("arima", "sarima"):
        (a, d, b), (sa, sd, sb), m = p["order"], p.get("seasonal_order", (0, 0, 0)), p.get("m", 1)
        return max(a + sa * m, b + sb * m) + d + sd * m + 5
    if name in ("auto_arima", "auto_sarima"):
        m = p.get("m", 0)
        return max(p["max_p"] + p.get("max_P", 0) * m, p["max_q"] + p.get("max_Q", 0) * m) + p["max_d"] + p.get("max_D", 0) * m + 5
    #: Rows by model
    by_name = {"seasonal_naive": season, "drift": 2, "ses": 3, "holt": 3, "holt_winters": 2 * season, "auto_ets": 4, "theta": 3, "croston": 4, "tsb": 4, "kalman": 5, "garch": 10, "ridge_lag": p.get("lags", 0) + 10}
    return max(model.min_train, by_name.get(name, 1))


OUT = "model string, step int, yhat double, sigma double, error string"


def _run_all(models, h: int, features: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TIME, kind="stable")
        known = pdf[~pdf["_ahead"]] if "_ahead" in pdf else pdf
        y = known[TARGET].to_numpy(float)
        x = known[features].to_numpy(float) if features else None
        xf = pdf[pdf["_ahead"]][features].to_numpy(float)[:h] if features and "_ahead" in pdf else None
        parts = []
        for name, model in [x for x in models if "_model" not in pdf or x[0] == pdf["_model"].iloc[0]]:
            try:
                takes = model.uses_x and x is not None
                mean, sigma, _ = model.run(y, h, x if takes else None, xf if takes else None)
                parts.append(pd.DataFrame({"model": name, "step": np.arange(1, h + 1, dtype=np.int32), "yhat": mean.astype(float), "sigma": sigma.astype(float), "error": None}))
            except Exception as e:  # noqa: BLE001  a failure is a row of the result
                parts.append(pd.DataFrame({"model": [name], "step": np.array([1], np.int32), "yhat": [np.nan], "sigma": [np.nan], "error": [f"{type(e).__name__}: {e}"[:200]]}))
        return pd.concat(parts, ignore_index=True)

    return run


def _pooled(panel: DataFrame, models):
    """Two-phase models: the pooled retention curve is fitted once, from the cohorts' summary."""
    from ..functions.series_models import RetentionSBG, fit_sbg
    from .panel import pooled_curve

    out = []
    for name, m in models:
        if isinstance(m, RetentionSBG) and m.pooled is None:
            curve = pooled_curve(panel).orderBy("age").toPandas()["survival"].to_numpy()  # as long as the longest cohort
            m = RetentionSBG(m.pooled_threshold, fit_sbg(curve) if len(curve) > 2 else None)
        out.append((name, m))
    return out


def _with_future(panel: DataFrame, features: list[str], x_future: DataFrame | None, h: int) -> DataFrame:
    """The panel's rows with, where models read covariates, the future's rows marked _ahead."""
    rows = panel.select(ID, TIME, TARGET, *features)
    if not features:
        return rows
    check_finite(panel, features, "the panel")
    if x_future is None:
        raise DataContractError(f"the panel has covariates {features}: their future values are needed")
    check_future(x_future, panel, h, features)
    ahead = x_future.select(ID, F.col(TIME).cast(dict(rows.dtypes)[TIME]).alias(TIME), F.lit(None).cast("double").alias(TARGET), *features)
    return rows.withColumn("_ahead", F.lit(False)).unionByName(ahead.withColumn("_ahead", F.lit(True)))


def forecast(panel: DataFrame, models, h: int, level=None, x_future: DataFrame | None = None, validate: bool = True, route: DataFrame | None = None, keep_failures: bool = False) -> DataFrame:
    """Long forecasts of all models with bounds of each level; with route (unique_id, model), of each series' own model alone. A series
    that a model refuses stops the job, as its error says, or with keep_failures has one row without values."""
    h, levels = check_horizon(h), check_levels(level)
    panel = validate_panel(panel) if validate else panel
    models = _pooled(panel, resolve(models))
    native, fitted = [x for x in models if native_models.is_native(x[1])], [x for x in models if not native_models.is_native(x[1])]
    parts = []
    if native and route is None:
        parts.append(native_models.ahead(panel, native, h).drop("cut", "n"))
    for x in native if route is not None else []:
        own = panel.join(route.filter(F.col("model") == x[0]).select(ID), ID, "left_semi")
        parts.append(native_models.ahead(own, [x], h).drop("cut", "n"))
    if fitted:
        features = covariates(panel) if any(m.uses_x for _, m in fitted) else []
        rows = _with_future(panel, features, x_future, h)
        if route is not None:
            names = [n for n, _ in fitted]
            rows = rows.join(route.filter(F.col("model").isin(*names)).select(ID, F.col("model").alias("_model")), ID)
        run, key = _run_all(fitted, h, features), dict(rows.dtypes)[ID]
        columns = [ID, "model", "step", "yhat", "sigma", "error"]
        parts.append(rows.groupBy(ID).applyInPandas(lambda k, pdf: run(pdf).assign(**{ID: k[0]})[columns], f"{ID} {key}, {OUT}"))
    found = reduce(DataFrame.unionByName, parts)
    stop = F.raise_error(F.concat(F.col("model"), F.lit(" on "), F.col(ID).cast("string"), F.lit(": "), F.col("error"))).cast("double")
    none = F.lit(None).cast("double")
    found = found.withColumns({c: F.when(F.col("error").isNotNull(), none if keep_failures or c == "sigma" else stop).otherwise(F.col(c)) for c in ("yhat", "sigma")})
    out = dates.future(dates.with_step(panel), h).join(found.drop("error"), [ID, "step"])
    return with_bounds(out, levels).select(ID, "model", "step", TIME, "yhat", "sigma", *[f"{s}_{x}" for x in levels for s in ("lo", "hi")])


def wide(forecasts: DataFrame, models: list[str], levels=()) -> DataFrame:
    """The API's frame: a column per model, and <model>-lo-L and <model>-hi-L."""
    aggs = [F.first("yhat").alias("y"), *[F.first(f"{s}_{x}").alias(f"{s}-{x}") for x in levels for s in ("lo", "hi")]]
    out = forecasts.groupBy(ID, TIME).pivot("model", models).agg(*aggs)
    return out.select(ID, TIME, *[F.col(f"`{m}_y`" if levels else f"`{m}`").alias(m) for m in models], *[F.col(f"`{m}_{s}-{x}`").alias(f"{m}-{s}-{x}") for m in models for x in levels for s in ("lo", "hi")])


def cv_splits(panel: DataFrame, h: int, n_windows: int = 3, step_size: int | None = None) -> DataFrame:
    """Panel rows of each window: window, step (0 in training, else 1 ... h) and cutoff (the last training ds)."""
    step_size = step_size or h
    placed = positions(panel)
    gap = F.col("n") - h - (n_windows - 1 - F.col("window")) * step_size
    out = placed.withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(n_windows - 1)))).withColumn("step", F.greatest(F.col("pos") - gap + 1, F.lit(0)).cast("int"))
    from pyspark.sql import Window

    cutoff = F.max(F.when(F.col("step") == 0, F.col(TIME))).over(Window.partitionBy(ID, "window"))
    return out.filter(F.col("step") <= h).withColumn("cutoff", cutoff).drop("pos", "n")


def check_span(panel: DataFrame, h: int, n_windows: int, step_size: int) -> None:
    span = h + (n_windows - 1) * step_size
    if bad := too_short(panel, span):
        raise DataContractError(f"series need more than {span} rows; too short: {bad}")


def cross_validation(panel: DataFrame, models, h: int, n_windows: int = 3, step_size: int | None = None, level=None, validate: bool = True) -> DataFrame:
    """Long rows (unique_id, ds, cutoff, window, step, y, model, yhat, sigma, bounds, error) of held-out steps. No history is copied for a
    window: native models read each cutoff's state from running windows, and the others cut their windows inside one group a series."""
    h, levels, step_size = check_horizon(h), check_levels(level), step_size or h
    if n_windows < 1 or step_size < 1:
        raise ValueError("n_windows and step_size start at 1")
    panel = validate_panel(panel) if validate else panel
    check_span(panel, h, n_windows, step_size)
    models = _pooled(panel, resolve(models))
    native, fitted = [x for x in models if native_models.is_native(x[1])], [x for x in models if not native_models.is_native(x[1])]
    columns = [ID, TIME, "cutoff", "window", "step", TARGET, "model", "yhat", "sigma", "error"]
    parts = []
    if native:
        f = native_models.ahead(panel, native, h, (n_windows, step_size))
        window = (n_windows - 1 - (F.col("n") - h - F.col("cut")) / step_size).cast("int")
        rows = positions(panel.select(ID, TIME, TARGET)).select(ID, TIME, TARGET, F.col("pos").cast("int").alias("pos"), (F.col("n") - F.col("pos")).alias("left"))
        held = rows.filter(F.col("left") <= h + (n_windows - 1) * step_size).drop("left")
        ends = rows.filter(F.col("left") <= h + 1 + (n_windows - 1) * step_size).select(ID, F.col(TIME).alias("cutoff"), (F.col("pos") + 1).alias("cut"))
        f = f.withColumns({"window": window, "pos": (F.col("cut") + F.col("step") - 1).cast("int")})
        parts.append(f.join(held, [ID, "pos"]).join(ends, [ID, "cut"]).select(columns))
    if fitted:
        features = covariates(panel) if any(m.uses_x for _, m in fitted) else []
        parts.append(_fitted_windows(panel.select(ID, TIME, TARGET, *features), fitted, h, n_windows, step_size, features).select(columns))
    out = reduce(DataFrame.unionByName, parts)
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    return with_bounds(out.withColumns({"yhat": clean("yhat"), "sigma": clean("sigma")}), levels)


def _fitted_windows(rows: DataFrame, models, h: int, n_windows: int, step_size: int, features: list[str]) -> DataFrame:
    run = _run_all(models, h, features)

    def window_of(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
        cut = len(pdf) - h - (n_windows - 1 - window) * step_size
        part = pdf.iloc[: cut + h]
        held = part.iloc[cut:][[TIME, TARGET]].assign(step=np.arange(1, h + 1, dtype=np.int32))
        out = run(part.assign(_ahead=np.arange(len(part)) >= cut)).merge(held, on="step", how="left")
        lost = out["error"].notna()
        if lost.any():  # a failed model still has its rows
            more = held.merge(out.loc[lost, ["model", "error"]], how="cross").assign(yhat=np.nan, sigma=np.nan)
            out = pd.concat([out[~lost], more], ignore_index=True)
        return out.assign(cutoff=part[TIME].iloc[cut - 1], window=np.int32(window))

    def one(key, pdf):
        pdf = pdf.sort_values(TIME, kind="stable")
        out = pd.concat([window_of(pdf, w) for w in range(n_windows)], ignore_index=True).assign(**{ID: key[0]})
        return out[[ID, TIME, "cutoff", "window", "step", TARGET, "model", "yhat", "sigma", "error"]].astype({"step": np.int32})

    kinds = dict(rows.dtypes)
    times = f"{ID} {kinds[ID]}, {TIME} {kinds[TIME]}, cutoff {kinds[TIME]}"
    return rows.groupBy(ID).applyInPandas(one, f"{times}, window int, step int, {TARGET} double, model string, yhat double, sigma double, "
        f"error string")


# ---- fitted models as tables -------------------------------------------------------------------------------------


def fitted_values(panel: DataFrame, model, validate: bool = True) -> DataFrame:
    """(unique_id, ds, y, fitted) in sample."""
    panel = validate_panel(panel) if validate else panel
    (name, m), = resolve([model])
    if type(m) in (SeasonalNaive, WindowAverage, Naive):
        return native_models.fitted(panel, {Naive: "naive", SeasonalNaive: "seasonal_naive", WindowAverage: "window_average"}[type(m)], getattr(m, "season_length", getattr(m, "window", 1)))
    kinds = dict(panel.dtypes)

    def one(pdf):
        pdf = pdf.sort_values(TIME, kind="stable")
        y = pdf[TARGET].to_numpy(float)
        f = m.run(y, 1)[2].get("fitted")
        return pdf[[ID, TIME, TARGET]].assign(fitted=np.concatenate(([np.nan], y[:-1])) if f is None else f)

    out = panel.select(ID, TIME, TARGET).groupBy(ID).applyInPandas(one, f"{ID} {kinds[ID]}, {TIME} {kinds[TIME]}, {TARGET} double, fitted double")
    return out.withColumn("fitted", F.when(~F.isnan("fitted"), F.col("fitted")))


class Fitted:
    """A fitted model: its specification and the panel it was fitted on, saved as a table and JSON, no pickles."""

    def __init__(self, model, panel: DataFrame | None = None):
        (self.name, self.model), = resolve([model])
        self.panel = panel

    def fit(self, panel: DataFrame) -> Fitted:
        return Fitted((self.name, self.model), validate_panel(panel))

    def predict(self, h: int, level=None, x_future: DataFrame | None = None) -> DataFrame:
        if self.panel is None:
            raise NotFittedError(self.name)
        return forecast(self.panel, [(self.name, self.model)], h, level, x_future, validate=False)

    def save(self, path: str) -> None:
        if self.panel is None:
            raise NotFittedError(self.name)
        self.panel.write.parquet(f"{path}/panel")
        self.panel.sparkSession.createDataFrame([(VERSION, self.name, json.dumps(params_of(self.model), default=list))], "version int, name string, "
            "params string").write.parquet(f"{path}/spec")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Fitted:
        try:
            spec = spark.read.parquet(f"{path}/spec").first()
            panel = spark.read.parquet(f"{path}/panel")
        except Exception as e:  # noqa: BLE001  whatever the storage raises
            raise EngineError(f"no saved model at {path}: {str(e)[:200]}") from e
        if spec.version != VERSION:
            raise EngineError(f"saved by version {spec.version}")
        params = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(spec.params).items()}
        return Fitted((spec.name, get_model(spec.name, **params)), panel)


__all__ = ["Fitted", "ModelSpec", "by_time", "cross_validation", "cv_splits", "fitted_values", "forecast", "get_model", "list_models", "register", "resolve", "wide"]
