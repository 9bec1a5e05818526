"""Forecast metrics as aggregate columns over long score rows (unique_id, model, y, yhat, lo_L, hi_L ...)."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contract import ID, TARGET, TIME, by_time
from .numeric import z_of

TINY = 1e-12
SIGNED = ("bias", "pct_bias", "tracking_signal")
SCALED = ("mase", "rmsse")


def _scored(y: Column, yhat: Column) -> Column:
    return y.isNotNull() & yhat.isNotNull()


def mae(y, p):
    return F.avg(F.abs(y - p))


def rmse(y, p):
    return F.sqrt(F.avg(F.pow(y - p, 2)))


def mape(y, p):
    return F.avg(F.when(F.abs(y) > TINY, F.abs((y - p) / F.nullif(y, F.lit(0.0)))))


def smape(y, p):
    d = (F.abs(y) + F.abs(p)) / 2
    return F.avg(F.when(d > TINY, F.try_divide(F.abs(y - p), d)).when(_scored(y, p), F.lit(0.0)))


def bias(y, p):
    return F.avg(p - y)


def pct_bias(y, p):
    d = F.sum(F.when(_scored(y, p), F.abs(y)))
    return F.when(d >= TINY, F.try_divide(F.sum(p - y), d))


def tracking_signal(y, p):
    d = F.avg(F.abs(p - y))
    return F.when(d >= TINY, F.try_divide(F.sum(p - y), d))


def pinball(y, q_hat, q: float):
    d = y - q_hat
    return F.avg(F.greatest(q * d, (q - 1) * d))


def coverage(y, lo, hi):
    return F.avg(((y >= lo) & (y <= hi)).cast("double"))


def _winkler(y, lo, hi, level: int):
    a = 1 - level / 100
    return (hi - lo) + F.when(y < lo, (2 / a) * (lo - y)).when(y > hi, (2 / a) * (y - hi)).when(y.isNotNull() & lo.isNotNull() & hi.isNotNull(), F.lit(0.0))


def winkler(y, lo, hi, level: int):
    return F.avg(_winkler(y, lo, hi, level))


def wis(y, p, bounds: dict[int, tuple[Column, Column]]):
    """Weighted interval score over all levels; a row counts where every bound is there."""
    total = 0.5 * F.abs(y - p)
    for level, (lo, hi) in sorted(bounds.items()):
        total = total + (1 - level / 100) / 2 * _winkler(y, lo, hi, level)
    return F.avg(total / (len(bounds) + 0.5))


POINT = {"mae": mae, "rmse": rmse, "mape": mape, "smape": smape, "bias": bias, "pct_bias": pct_bias, "tracking_signal": tracking_signal}


def resolve(metrics) -> list[str]:
    """Metric names without repeats; crps is a former name of wis."""
    out = []
    for m in metrics:
        if m == "crps":
            warnings.warn("crps is now called wis", FutureWarning, stacklevel=3)
            m = "wis"
        if m not in out:
            out.append(m)
    return out


def levels_in(columns) -> list[int]:
    found = [int(m[1]) for c in columns if (m := re.fullmatch(r"lo_(\d+)", c))]
    return sorted(x for x in found if f"hi_{x}" in columns)


def models_in(columns) -> list[str]:
    """Model columns of a wide frame: those with no interval suffix beyond the frame's own."""
    return [c for c in columns if c not in (ID, TIME, TARGET, "cutoff") and not re.search(r"-(lo|hi)-\d+$", c)]


def naive_scale(train: DataFrame, m: int = 1) -> DataFrame:
    """(unique_id, scale_abs, scale_sq): mean absolute and squared lag-m difference of the training rows."""
    if m < 1:
        raise ValueError("seasonality starts at 1")
    d = F.col(TARGET) - F.lag(TARGET, m).over(by_time())
    return train.select(ID, d.alias("d")).groupBy(ID).agg(F.avg(F.abs("d")).alias("scale_abs"), F.avg(F.pow("d", F.lit(2.0))).alias("scale_sq"))


def _column(name: str, levels: list[int]) -> Column:
    y, p = F.col(TARGET), F.col("yhat")
    bounds = {x: (F.col(f"lo_{x}"), F.col(f"hi_{x}")) for x in levels}
    if name in POINT:
        return POINT[name](y, p)
    if name == "wis":
        if not levels:
            raise ValueError("wis needs intervals")
        return wis(y, p, bounds)
    if name == "mase":
        return F.when(F.first("scale_abs") >= TINY, F.try_divide(mae(y, p), F.first("scale_abs")))
    if name == "rmsse":
        return F.when(F.first("scale_sq") >= TINY, F.sqrt(F.try_divide(F.avg(F.pow(y - p, 2)), F.first("scale_sq"))))
    m = re.fullmatch(r"(coverage|winkler|pinball)-(\d+)", name)
    if not m or int(m[2]) not in bounds:
        raise ValueError(f"unknown metric {name!r}, or no intervals of its level")
    level = int(m[2])
    lo, hi = bounds[level]
    if m[1] == "coverage":
        return coverage(y, lo, hi)
    if m[1] == "winkler":
        return winkler(y, lo, hi, level)
    tail = (1 - level / 100) / 2
    return (pinball(F.when(hi.isNotNull(), y), lo, tail) + pinball(F.when(lo.isNotNull(), y), hi, 1 - tail)) / 2


def evaluate(cv: DataFrame, metrics=("mae", "rmse", "smape"), train: DataFrame | None = None, seasonality: int = 1, by: str | None = None) -> DataFrame:
    """Long scores (unique_id[, cutoff], model, metric, value) in one aggregation over long forecasts."""
    metrics = resolve(metrics)
    keys = [ID, *([by] if by else []), "model"]
    if any(m in SCALED for m in metrics):
        if train is None:
            raise ValueError("scaled metrics need training rows")
        cv = cv.join(naive_scale(train, seasonality), ID, "left")
    levels = levels_in(cv.columns)
    wide = cv.groupBy(*keys).agg(*[_column(m, levels).alias(f"m{i}") for i, m in enumerate(metrics)])
    pairs = ", ".join(f"'{m}', m{i}" for i, m in enumerate(metrics))
    return wide.selectExpr(*[f"`{k}`" for k in keys], f"stack({len(metrics)}, {pairs}) as (metric, value)")


def score_frame(scores: DataFrame, models: list[str]) -> DataFrame:
    """One row per series (and cutoff) and metric, a column per model."""
    keys = [c for c in scores.columns if c not in ("model", "value")]
    return scores.groupBy(*keys).pivot("model", models).agg(F.first("value"))


def sort_rule(metric: str) -> Column:
    """What a leaderboard sorts by: distance from the nominal level, size of signed metrics, or the metric."""
    c = F.col(f"`{metric}`")
    if metric.startswith("coverage-"):
        return F.abs(c - int(metric.split("-")[1]) / 100)
    return F.abs(c) if metric in SIGNED else c


def leaderboard(scores: DataFrame, metrics) -> DataFrame:
    """Mean over series of each metric, best model first by the first metric."""
    metrics = resolve(metrics)
    out = scores.groupBy("model").pivot("metric", metrics).agg(F.avg("value"))
    return out.orderBy(sort_rule(metrics[0]).asc_nulls_last(), "model")


def with_bounds(df: DataFrame, levels: list[int]) -> DataFrame:
    """yhat -/+ z sigma of each level."""
    return df.withColumns({f"{side}_{x}": F.col("yhat") + sign * z_of(x) * F.col("sigma") for x in levels for side, sign in (("lo", -1), ("hi", 1))})
