"""Returns metrics, equity curves, strategy backtests, Monte Carlo paths and regimes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.contract import ID, TARGET, TIME, by_time, validate_panel
from ..functions.numeric import normal_cdf, z_of
from ..functions.series_models import fit_hmm
from . import forecaster

TINY = 1e-12


def _known(c: str, value: Column) -> Column:
    """value, or null where any return is missing (metrics propagate missing values)."""
    return F.when(F.count_if(F.col(c).isNull()) == 0, value)


def equity(df: DataFrame, c: str = TARGET) -> DataFrame:
    """With equity = product of 1 + r so far, and drawdown from its peak (the start is a peak)."""
    w = by_time().rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("equity", F.product(1 + F.col(c)).over(w))
    peak = F.greatest(F.max("equity").over(w), F.lit(1.0))
    return out.withColumn("drawdown", F.col("equity") / peak - 1)


def risk_metrics(df: DataFrame, c: str = TARGET, periods: int = 252, rf: float = 0.0, level: float = 0.95) -> DataFrame:
    """One row a series: annualised return and volatility, Sharpe, Sortino, drawdown, Calmar, hit rate, VaR and CVaR."""
    r, root = F.col(c), F.lit(float(periods) ** 0.5)
    n, tail = F.count("*"), 1 - level
    df = df.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    path = equity(df, c)
    excess = r - rf / periods
    growth = F.product(1 + r)
    q = path.groupBy(ID).agg(F.percentile(r, F.lit(tail)).alias("_q"), F.max(F.abs(r)).alias("_m"))
    path = path.join(q, ID)
    mean, sd = F.avg(excess), F.stddev_samp(excess)
    down = F.sqrt(F.avg(F.pow(F.least(excess, F.lit(0.0)), F.lit(2.0))))
    worst = F.min("drawdown")
    annual = F.when(F.min("equity") <= 0, -1.0).otherwise(F.pow(F.greatest(growth, F.lit(0.0)), periods / n) - 1)
    out = path.groupBy(ID).agg(
        _known(c, growth - 1).alias("total_return"), _known(c, annual).alias("annualized_return"), _known(c, F.when(n >= 2, F.stddev_samp(r) * root)).alias("annualized_vol"),
        _known(c, F.when(sd >= TINY, F.try_divide(mean, sd) * root)).alias("sharpe"), _known(c, F.when(down >= TINY, F.try_divide(mean, down) * root)).alias("sortino"),
        _known(c, F.least(worst, F.lit(0.0))).alias("max_drawdown"), F.avg(F.coalesce(r > 0, F.lit(False)).cast("double")).alias("hit_rate"),
        _known(c, F.greatest(-F.first("_q"), F.lit(0.0))).alias("var"), _known(c, F.greatest(-F.avg(F.when(r <= F.col("_q") + 1e-12 * F.col("_m"), r)), F.lit(0.0))).alias("cvar"),
    )
    return out.withColumn("calmar", F.when(F.abs("max_drawdown") >= TINY, F.try_divide(F.col("annualized_return"), F.abs("max_drawdown"))))


def directional_accuracy(df: DataFrame) -> DataFrame:
    return df.groupBy(ID).agg(F.avg((F.signum(TARGET) == F.signum("yhat")).cast("double")).alias("directional_accuracy"))


def position(yhat: Column, sigma: Column | None, sizing: str = "binary", threshold: float = 0.0, kelly_fraction: float = 0.5, max_leverage: float = 1.0) -> Column:
    """How much to hold; a degenerate sigma falls back to the binary rule (within the leverage cap)."""
    binary = (yhat > threshold).cast("double")
    if sizing == "binary":
        return binary
    fine = sigma.isNotNull() & ~F.isnan(sigma) & (sigma > TINY)
    safe = F.when(fine, sigma).otherwise(1.0)
    if sizing == "proportional":
        return F.when(fine, F.least(F.greatest(2 * (normal_cdf((yhat - threshold) / safe) - 0.5), F.lit(0.0)), F.lit(1.0))).otherwise(binary)
    if sizing != "kelly":
        raise ValueError("sizing is binary, proportional or kelly")
    return F.when(fine, F.least(F.greatest(kelly_fraction * (yhat - threshold) / (safe * safe), F.lit(0.0)), F.lit(float(max_leverage)))).otherwise(F.least(binary, F.lit(float(max_leverage))))


def strategy(signals: DataFrame, cost_bps: float = 0.0, **sizing) -> DataFrame:
    """signals (unique_id, ds, y, yhat[, sigma]) with position, strategy_return and equity."""
    sigma = F.col("sigma") if "sigma" in signals.columns else None
    out = signals.withColumn("position", position(F.col("yhat"), sigma, **sizing))
    moved = F.abs(F.col("position") - F.coalesce(F.lag("position").over(by_time()), F.lit(0.0)))
    out = out.withColumn("turnover", moved).withColumn("strategy_return", F.col("position") * F.col(TARGET) - cost_bps / 1e4 * F.col("turnover"))
    return equity(out, "strategy_return").drop("drawdown")


def strategy_summary(frame: DataFrame, periods: int) -> DataFrame:
    risk = risk_metrics(frame, "strategy_return", periods).withColumnsRenamed({"var": "var_95", "cvar": "cvar_95"})
    more = frame.groupBy(ID).agg(F.count_if(F.col("turnover") > 0).alias("n_trades"), F.avg("position").alias("exposure"))
    return risk.join(more, ID)


def backtest(panel: DataFrame, model, test_size: int = 60, step_size: int = 1, cost_bps: float = 0.0, level: int = 80, periods: int | None = None, **sizing) -> tuple[DataFrame, DataFrame, int]:
    """(summary, frame, periods) of trading one-step walk-forward forecasts of returns."""
    if not 0 < level < 100 or int(level) != level:
        raise ValueError("level is a whole percentage")
    if min(sizing.get("kelly_fraction", 1), sizing.get("max_leverage", 1)) <= 0:
        raise ValueError("kelly_fraction and max_leverage are positive")
    panel = validate_panel(panel)
    periods = periods or max(1, round(dates.periods_per_year(dates.with_step(panel)) / step_size))
    cv = forecaster.cross_validation(panel, [model], 1, test_size, step_size, [level], validate=False)
    sigma = (F.col(f"hi_{level}") - F.col(f"lo_{level}")) / (2 * z_of(level))
    frame = strategy(cv.select(ID, TIME, TARGET, "yhat", sigma.alias("sigma")), cost_bps, **sizing)
    return strategy_summary(frame, periods), frame, periods


# ---- simulation and regimes --------------------------------------------------------------------------------------


def gbm_parameters(returns: DataFrame, c: str = TARGET) -> DataFrame:
    """(unique_id, mu, sigma): per-period log drift so that simulated means grow as the returns do."""
    x = F.ln(1 + F.col(c))
    return returns.groupBy(ID).agg((F.avg(x) + F.var_samp(x) / 2).alias("mu"), F.stddev_samp(x).alias("sigma"))


def normal_draw(seed: int, *keys: str) -> Column:
    """A standard normal number fixed by seed and key columns, whatever the partitions: two uniforms of 52 bits from a digest
    of them, by Box and Muller."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    u = lambda at: (F.conv(F.substring(digest, at, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
    return F.sqrt(-2 * F.ln(u(1))) * F.cos(2 * F.pi() * u(17))


def simulate(spark: SparkSession, s0: float, mu: float, sigma: float, steps: int, paths: int, seed: int = 0) -> DataFrame:
    """(path, step, value) of geometric Brownian motion; paths spread over the cluster, numbers fixed by the seed."""
    if steps < 1 or paths < 1 or sigma < 0 or s0 <= 0:
        raise ValueError("steps and paths start at 1, sigma at 0, s0 above 0")
    z = spark.range(paths).select(F.col("id").alias("path"), F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step")).withColumn("z", normal_draw(seed, "path", "step"))
    w = Window.partitionBy("path").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return z.select("path", "step", (s0 * F.exp(F.sum((mu - sigma * sigma / 2) + sigma * F.col("z")).over(w))).alias("value"))


def simulate_seeded(spark: SparkSession, s0: float, mu: float, sigma: float, steps: int, paths: int, seed: int = 0) -> DataFrame:
    """The same with numpy's generator, one stream for all paths (a fixed seed's exact numbers)."""
    z = np.random.default_rng(seed).standard_normal((paths, steps))
    v = s0 * np.exp(np.cumsum((mu - sigma**2 / 2) + sigma * z, axis=1))
    p, t = np.indices(v.shape)
    return spark.createDataFrame(pd.DataFrame({"path": p.ravel(), "step": t.ravel() + 1, "value": v.ravel()}))


def simulation_summary(paths: DataFrame, quantiles=(0.05, 0.25, 0.5, 0.75, 0.95), accuracy: int | None = None) -> DataFrame:
    """mean and quantile columns (q05 ...) of each step. Exact quantiles count equal values of a step, so a step's buffer holds its
    distinct values; with accuracy they are a sketch instead, off by at most 1/accuracy in rank, of bounded memory."""
    shares = F.array(*map(F.lit, quantiles))
    q = F.percentile("value", shares) if accuracy is None else F.percentile_approx("value", shares, accuracy)
    out = paths.groupBy("step").agg(F.avg("value").alias("mean"), q.alias("q"))
    return out.select("step", "mean", *[F.col("q")[i].alias(f"q{round(100 * x):02d}") for i, x in enumerate(quantiles)])


def regimes(returns: DataFrame, n_states: int = 2, seed: int = 0) -> DataFrame:
    """(unique_id, ds, y, state, proba): smoothed state probabilities of each row, states by rising mean."""
    kinds = dict(returns.dtypes)

    def one(pdf):
        pdf = pdf.sort_values(TIME, kind="stable")
        m = fit_hmm(pdf[TARGET].to_numpy(float), n_states, seed=seed)
        return pdf[[ID, TIME, TARGET]].assign(state=m["proba"].argmax(1).astype(np.int32), proba=list(m["proba"]), expected=m["proba"] @ m["means"])

    return returns.select(ID, TIME, TARGET).groupBy(ID).applyInPandas(one, f"{ID} {kinds[ID]}, {TIME} {kinds[TIME]}, {TARGET} double, state int, "
        f"proba array<double>, expected double")
