"""The facade: forecast, cross_validate and compare over any set of models."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.contract import ID, TIME, check_levels, validate_panel
from ..operators import forecaster


class Engine:
    def __init__(self, models=("auto_ets",), level=None):
        self.models, self.level = forecaster.resolve(models), check_levels(level)
        self.names = [n for n, _ in self.models]

    def forecast(self, panel: DataFrame, h: int, level=None, x_future: DataFrame | None = None, as_wide: bool = False) -> DataFrame:
        levels = self.level if level is None else check_levels(level)
        out = forecaster.forecast(panel, self.models, h, levels, x_future)
        return forecaster.wide(out, self.names, levels) if as_wide else out

    def cross_validate(self, panel: DataFrame, h: int, n_windows: int = 3, step_size: int | None = None, level=None, ordered: bool = True) -> DataFrame:
        """Held-out rows in order of series, cutoff and ds, unless not asked for."""
        out = forecaster.cross_validation(panel, self.models, h, n_windows, step_size, self.level if level is None else level)
        return out.orderBy(ID, "cutoff", TIME, "model") if ordered else out

    def compare(self, panel: DataFrame, h: int, n_windows: int = 3, metrics=("mae", "rmse", "smape"), seasonality: int = 1, level=None) -> tuple[DataFrame, DataFrame]:
        """(leaderboard, failures): scores averaged over series, best first; a model that failed anywhere is listed with its first error
        instead. Both have a row a model at most and come as local tables; the held-out rows are kept on disk meanwhile."""
        spark, panel = panel.sparkSession, validate_panel(panel)
        cv = forecaster.cross_validation(panel, self.models, h, n_windows, None, self.level if level is None else level, validate=False).persist(StorageLevel.DISK_ONLY)
        try:
            failed = cv.filter(F.col("error").isNotNull()).groupBy("model").agg(F.min("error").alias("error"))
            failures = spark.createDataFrame(failed.collect(), "model string, error string")
            fine = cv.join(F.broadcast(failures.select("model")), "model", "left_anti")
            board = M.leaderboard(M.evaluate(fine, metrics, panel, seasonality), metrics)
            return spark.createDataFrame(board.collect(), board.schema), failures
        finally:
            cv.unpersist()


def sparkline(panel: DataFrame, value_col: str = "y", width: int = 12) -> DataFrame:
    """(unique_id, spark): the last values as eight block heights; a missing one is a dot, a flat line is in the middle."""
    value = F.col(value_col).cast("double")
    finite = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    rows = panel.groupBy(ID).agg(F.array_sort(F.collect_list(F.struct("ds", finite.alias("v")))).alias("r"))
    v = rows.select(ID, F.transform(F.slice(F.col("r"), F.greatest(F.size("r") - width + 1, F.lit(1)), width), lambda x: x["v"]).alias("v"))
    lo, hi = F.array_min("v"), F.array_max("v")
    height = lambda x: (F.bround((x - lo) / F.nullif(hi - lo, F.lit(0.0)) * 7, 0) + 1).cast("int")
    block = lambda x: F.when(x.isNull(), F.lit("·")).when(hi - lo < 1e-12, F.lit("▄")).otherwise(F.substring(F.lit("▁▂▃▄▅▆▇█"), height(x), F.lit(1)))
    return v.select(ID, F.array_join(F.transform("v", block), "").alias("spark"))


def alerts(forecasts: DataFrame, governance: DataFrame | None, rules: DataFrame) -> DataFrame:
    """Rules (series or '*', kind forecast_below or coverage_below, threshold) that fire, with the value that fired them."""
    first = forecasts.groupBy(ID).agg(F.min_by("yhat", "ds").alias("value")).withColumn("kind", F.lit("forecast_below"))
    seen = first
    if governance is not None:
        seen = first.unionByName(governance.groupBy(ID).agg(F.avg("coverage").alias("value")).withColumn("kind", F.lit("coverage_below")))
    by_name = seen.join(rules.filter("series != '*'").withColumnRenamed("kind", "k"), (F.col("series") == F.col(ID)) & (F.col("k") == F.col("kind")))
    by_all = seen.join(rules.filter("series = '*'").withColumnRenamed("kind", "k"), F.col("k") == F.col("kind"))
    return by_name.unionByName(by_all).filter(F.col("value") < F.col("threshold")).select(ID, "kind", "threshold", "value").distinct()


def governance(panel: DataFrame, model="theta", h: int = 1, n_windows: int = 2, level: int = 80) -> DataFrame:
    """(unique_id, cutoff, pct_bias, coverage, flags) of a walk-forward run; flags: bias under -5 %, coverage 15 points under nominal."""
    cv = forecaster.cross_validation(panel, [model], h, n_windows, level=[level])
    s = M.evaluate(cv, ["pct_bias", f"coverage-{level}"], by="cutoff")
    out = s.groupBy(ID, "cutoff").pivot("metric", ["pct_bias", f"coverage-{level}"]).agg(F.first("value")).withColumnRenamed(f"coverage-{level}", "coverage")
    return with_flags(out, level)


def with_flags(out: DataFrame, level: int = 80) -> DataFrame:
    return out.withColumns({"biased": F.coalesce(F.col("pct_bias") < -0.05, F.lit(False)), "uncovered": F.coalesce(F.col("coverage") < level / 100 - 0.15, F.lit(False))})


def dashboard(panel: DataFrame, season_length: int | None = None) -> DataFrame:
    """A row a series: last value, next value by theta with its band, change in per cent (null from about 0) and sparkline. A series
    that theta refuses has its last value as the next one, so that one bad series stops nothing."""
    last = panel.groupBy(ID).agg(F.max_by("y", "ds").alias("last"), F.count("*").alias("n"))
    ahead = forecaster.forecast(panel, [("theta", {"season_length": season_length})], 1, [80], validate=False, keep_failures=True)
    rows = last.join(ahead.select(ID, "yhat", "lo_80", "hi_80"), ID, "left").withColumn("next", F.coalesce("yhat", "last")).drop("yhat")
    change = F.when(F.abs("last") > 1e-12, F.try_divide(F.col("next") - F.col("last"), F.abs("last")) * 100)
    return rows.join(sparkline(panel), ID).withColumn("delta_pct", change)
