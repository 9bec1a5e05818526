"""JSON tool functions over a session: records or a CSV in, plain lists of dicts out. Engine errors become ValueErrors."""

from __future__ import annotations

import functools
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.contract import ID, check_levels, validate_panel
from ..functions.errors import EngineError
from ..operators import deals, forecaster, meta, panel as P
from ..sources import mappings, readers
from .engine import Engine


SHOWN = 1000  # series named in a preview


def _said(f):
    @functools.wraps(f)
    def run(*a, **b):
        try:
            return f(*a, **b)
        except EngineError as e:
            raise ValueError(str(e)) from e

    return run


def as_records(df: DataFrame) -> list[dict]:
    return [json.loads(x) for x in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toPandas().iloc[:, 0]]


def build_panel(spark: SparkSession, csv_path=None, records=None, mapping=None, freq=None, agg=None, **overrides) -> DataFrame:
    raw = readers.load_records(spark, csv_path, records)
    if mapping:
        return validate_panel(mappings.apply_mapping(raw, mapping, **overrides, **({"freq": freq} if freq else {}), **({"agg": agg} if agg else {})))
    if agg:
        raw = P.collapse(raw, agg)
    return validate_panel(P.densify(validate_panel(raw), freq) if freq else raw)


def preview(panel: DataFrame) -> DataFrame:
    """Rows, series and range in one row."""
    return panel.agg(F.count("*").alias("n_rows"), F.count_distinct(ID).alias("n_series"), F.min("ds").alias("first"), F.max("ds").alias("last"))


@_said
def preview_panel(spark, **source) -> dict:
    p = build_panel(spark, **source)
    series = [r[0] for r in p.select(ID).distinct().orderBy(ID).limit(SHOWN).collect()]
    return {**as_records(preview(p))[0], "series": series, "head": as_records(p.orderBy(ID, "ds").limit(10))}


@_said
def forecast_tool(spark, models=("auto_ets",), h: int = 12, level=None, **source) -> list[dict]:
    return as_records(Engine(models, level).forecast(build_panel(spark, **source), h).orderBy(ID, "model", "step"))


@_said
def forecast_one(spark, model: str = "auto_select", params: dict | None = None, h: int = 12, level=None, **source) -> list[dict]:
    """Forecasts of one model by name, meta models included, with a level of 80 unless others are named."""
    panel, params, levels = build_panel(spark, **source), dict(params or {}), check_levels([80] if level is None else level)
    try:
        if model == "auto_select":
            out = meta.auto_select(panel, params.pop("candidates", None), h, levels, **params)[0]
        elif model == "reconciled":
            out = meta.reconciled(panel, params.pop("model", "auto_ets"), h, level=levels, **params)
        elif model == "conformal":
            out = meta.conformal(panel, params.pop("model", "auto_ets"), h, levels, **params)
        elif model == "ensemble":
            out = meta.ensemble(Engine(params.pop("models", ["naive", "theta", "auto_ets"]), levels).forecast(panel, h), levels=levels, **params)
        else:
            out = Engine([(model, params)], levels).forecast(panel, h)
        return as_records(out.orderBy(ID, "step"))
    except TypeError as e:
        raise ValueError(f"invalid parameters of {model}: {e}") from e


@_said
def compare_tool(spark, models=("naive", "ses", "theta"), h: int = 12, n_windows: int = 3, metrics=("mae", "rmse", "smape"), seasonality: int = 1, level=None, **source) -> dict:
    if seasonality < 1:
        raise ValueError("seasonality starts at 1")
    board, failed = Engine(models, level).compare(build_panel(spark, **source), h, n_windows, metrics, seasonality)
    return {"leaderboard": as_records(board), "failures": as_records(failed)}


@_said
def quota_tool(spark, quota, model="auto_ets", h: int = 12, level: int = 80, **source) -> dict:
    panel = build_panel(spark, **source)
    f = meta.reconciled(panel, "auto_ets", h, level=[level]) if model == "reconciled" else Engine([model], [level]).forecast(panel, h)
    if isinstance(quota, dict):
        if not f.filter(F.col(ID).isin(*quota)).limit(1).count():
            raise ValueError(f"quota keys {sorted(quota)} match no forecast series")
        q = spark.createDataFrame([(k, float(v)) for k, v in quota.items()], f"{ID} string, quota double")
        return {"attainment": as_records(deals.attainment(f.join(q, ID, "left_semi"), q, level)), "unmatched": as_records(deals.unmatched_quotas(q, f))}
    return {"attainment": as_records(deals.attainment(f, quota, level)), "unmatched": []}


def list_models_tool(spark) -> list[dict]:
    return as_records(forecaster.list_models(spark))


def list_mappings_tool(spark) -> list[dict]:
    return as_records(mappings.list_mappings(spark))
