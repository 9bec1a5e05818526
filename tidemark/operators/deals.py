"""Deal-grain analytics: waterfall, weighted pipeline, quota, anomalies, scenarios and the deal scorer."""

from __future__ import annotations

import functools
import math
from collections.abc import Mapping

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.contract import ID, TARGET, TIME
from ..functions.errors import DataContractError, EngineError, NotFittedError
from ..functions.numeric import normal_cdf, z_of

#: Waterfall categories in display order.
CATEGORIES = ("created", "expanded", "advanced", "regressed", "pushed", "pulled_in", "unchanged", "contracted", "won", "lost", "removed")


def _checked(frame: DataFrame, name: str, id_col: str, amount_col: str, stage_col: str, close_col: str | None, closed: list) -> None:
    need = [id_col, amount_col, stage_col, *([close_col] if close_col else [])]
    if missing := [c for c in need if c not in frame.columns]:
        raise DataContractError(f"{name} lacks column(s) {missing}")
    if not isinstance(frame.schema[amount_col].dataType, T.NumericType):
        raise DataContractError(f"{name}: {amount_col} must be numeric")
    open_ = ~F.coalesce(F.col(stage_col).isin(*closed), F.lit(False)) if closed else F.lit(True)
    a = F.col(amount_col).cast("double")
    per = frame.groupBy(id_col).agg(F.count("*").alias("n"), F.count_if(open_ & (a.isNull() | F.isnan(a))).alias("missing"))
    r = per.agg(F.count_if(F.col("n") > 1).alias("repeated"), F.sum("missing").alias("missing"), F.count_if(F.col(id_col).isNull()).alias("no_id")).first()
    if r.no_id or r.repeated or r.missing:
        raise DataContractError(f"{name}: {r.repeated} repeated ids, {r.missing} open deals without amount, {r.no_id} null ids")


def classify(before: DataFrame, after: DataFrame, stages: list, id_col="opp_id", amount_col="amount", stage_col="stage", close_col=None, won_stage=None, lost_stage=None) -> DataFrame:
    """(id, category, amount) of every deal in either snapshot: one full outer join and one case expression."""
    closed = [s for s in (won_stage, lost_stage) if s is not None]
    close = (lambda: F.col(close_col).try_cast("timestamp")) if close_col else (lambda: F.lit(None).cast("timestamp"))
    side = lambda f, p: f.select(F.col(id_col).alias("id"), F.lit(True).alias(f"{p}in"), F.col(amount_col).cast("double").alias(f"{p}a"), F.col(stage_col).alias(f"{p}s"), close().alias(f"{p}c"))
    j = side(before, "b").join(side(after, "a"), "id", "full_outer")
    within = lambda s: F.coalesce(F.col(s).isin(*closed), F.lit(False)) if closed else F.lit(False)
    rank = lambda s: F.array_position(F.array(*[F.lit(x) for x in stages]), F.col(s))
    was_open = F.coalesce("bin", F.lit(False)) & ~within("bs")
    delta = F.col("aa") - F.col("ba")
    known = (rank("as") > 0) & (rank("bs") > 0)
    gone = F.col("ain").isNull()
    category = (
        F.when(gone, "removed").when(within("as"), F.when(F.col("as") == won_stage, "won").otherwise("lost") if won_stage is not None else F.lit("lost"))
        .when(~was_open, "created").when(delta > 0, "expanded").when(delta < 0, "contracted")
        .when(known & (rank("as") > rank("bs")), "advanced").when(known & (rank("as") < rank("bs")), "regressed")
        .when(F.col("ac") > F.col("bc"), "pushed").when(F.col("ac") < F.col("bc"), "pulled_in").otherwise("unchanged")
    )
    left = -F.when(was_open, F.col("ba")).otherwise(0.0)
    amount = F.when(gone | within("as"), left).when(~was_open, F.col("aa")).otherwise(delta)
    return j.select("id", category.alias("category"), amount.alias("amount"))


def waterfall(before: DataFrame, after: DataFrame, stages: list, validate: bool = True, **cols) -> DataFrame:
    """(category, n_deals, amount) of non-empty categories; order is given by `ord`."""
    closed = [s for s in (cols.get("won_stage"), cols.get("lost_stage")) if s is not None]
    if not stages:
        raise DataContractError("stages must not be empty")
    if both := [s for s in stages if s in closed]:
        raise DataContractError(f"closed stages among the open ones: {both}")
    if validate:
        for f, name in ((before, "before"), (after, "after")):
            _checked(f, name, cols.get("id_col", "opp_id"), cols.get("amount_col", "amount"), cols.get("stage_col", "stage"), cols.get("close_col"), closed)
    out = classify(before, after, stages, **cols).groupBy("category").agg(F.count("*").alias("n_deals"), F.sum("amount").alias("amount"))
    return out.withColumn("ord", F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))).orderBy("ord")


def waterfall_summary(before: DataFrame, after: DataFrame, stages: list, **cols) -> DataFrame:
    """The waterfall between an opening and a closing row, with a running total. At most 13 rows."""
    closed = [s for s in (cols.get("won_stage"), cols.get("lost_stage")) if s is not None]
    stage, amount = cols.get("stage_col", "stage"), cols.get("amount_col", "amount")
    open_ = ~F.coalesce(F.col(stage).isin(*closed), F.lit(False)) if closed else F.lit(True)
    anchor = lambda f, name, o: f.filter(open_).agg(F.lit(name).alias("category"), F.count("*").alias("n_deals"), F.coalesce(F.sum(F.col(amount).cast("double")), F.lit(0.0)).alias("amount"), F.lit(o).cast("long").alias("ord"))
    rows = anchor(before, "opening_pipeline", 0).unionByName(waterfall(before, after, stages, **cols)).unionByName(anchor(after, "closing_pipeline", 99))
    total = F.sum("amount").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running_total", F.when(F.col("ord") == 99, F.col("amount")).otherwise(total)).orderBy("ord")


def with_probabilities(deals: DataFrame, proba: DataFrame, id_col: str = "opp_id", proba_col: str = "proba") -> DataFrame:
    """deals with their win probabilities from a table (id, proba); a deal without one stops the job, and so does a repeated id of the table."""
    one = proba.groupBy(id_col).agg(F.count("*").alias("_n"), F.first(proba_col).alias("_p"))
    said = lambda what: F.raise_error(F.concat(F.lit(what), F.col(id_col).cast("string"))).cast("double")
    p = F.when(F.col("_n") > 1, said("several win probabilities for ")).when(F.col("_p").isNull() | F.isnan("_p"), said("no win probability for ")).otherwise(F.col("_p"))
    return deals.drop(proba_col).join(one, id_col, "left").withColumn(proba_col, p).drop("_n", "_p")


def weighted_pipeline(deals: DataFrame, proba_col: str = "proba", by=None, amount_col: str = "amount", level: int | None = None, proba: DataFrame | None = None, id_col: str = "opp_id") -> DataFrame:
    """Expected value, its standard deviation and, with a level, bounds clamped to what can happen; null groups are kept. The win
    probabilities are a column of deals or, with proba, a table joined by id."""
    deals = deals if proba is None else with_probabilities(deals, proba, id_col, proba_col)
    keys = [by] if isinstance(by, str) else list(by or [])
    fine = (F.col(proba_col) >= -1e-9) & (F.col(proba_col) <= 1 + 1e-9)
    p = F.when(F.coalesce(fine, F.lit(False)), F.least(F.greatest(F.col(proba_col), F.lit(0.0)), F.lit(1.0))).otherwise(F.raise_error(F.lit("win probabilities lie in [0, "
        "1]")).cast("double"))
    a = F.col(amount_col).cast("double")
    aggs = [F.count("*").alias("n_deals"), F.coalesce(F.sum(a), F.lit(0.0)).alias("total"), F.coalesce(F.sum(p * a), F.lit(0.0)).alias("expected"), F.sqrt(F.coalesce(F.sum(p * (1 - p) * a * a), F.lit(0.0))).alias("std"),
            F.coalesce(F.sum(F.least(a, F.lit(0.0))), F.lit(0.0)).alias("_min"), F.coalesce(F.sum(F.greatest(a, F.lit(0.0))), F.lit(0.0)).alias("_max")]
    out = deals.groupBy(*keys).agg(*aggs)
    if level is not None:
        z = z_of(int(level))
        out = out.withColumns({f"lo_{int(level)}": F.greatest(F.col("expected") - z * F.col("std"), F.col("_min")), f"hi_{int(level)}": F.least(F.col("expected") + z * F.col("std"), F.col("_max"))})
    return out.drop("_min", "_max")


def attainment(forecast: DataFrame, quota, level: int = 80) -> DataFrame:
    """(unique_id, expected, sigma, quota, probability) of reaching a quota: a number, or a table (unique_id, quota)."""
    lo, hi = F.col(f"lo_{level}"), F.col(f"hi_{level}")
    per = forecast.groupBy(ID).agg(F.sum("yhat").alias("expected"), F.sqrt(F.sum(F.pow((hi - lo) / (2 * z_of(level)), F.lit(2.0)))).alias("sigma"))
    if isinstance(quota, (int, float)):
        per = per.withColumn("quota", F.lit(float(quota)))
    else:
        per = per.join(quota.select(ID, F.col("quota").cast("double").alias("quota")), ID, "left")
        per = per.withColumn("quota", F.coalesce("quota", F.raise_error(F.concat(F.lit("no quota for "), F.col(ID))).cast("double")))
    x = F.try_divide(F.col("expected") - F.col("quota"), F.when(F.col("sigma") > 0, F.col("sigma")))
    return per.withColumn("probability", F.when(F.col("sigma") > 0, normal_cdf(x)).when(F.col("expected") >= F.col("quota"), 1.0).otherwise(0.0))


def unmatched_quotas(quota: DataFrame, forecast: DataFrame) -> DataFrame:
    return quota.join(forecast.select(ID).distinct(), ID, "left_anti")


def pipeline_coverage(pipeline: DataFrame, quota: DataFrame) -> DataFrame:
    """(unique_id, coverage): value over quota, matched by key; what lacks a side or divides by 0 is null."""
    return pipeline.join(quota, ID, "full_outer").select(ID, F.when(F.col("quota") != 0, F.try_divide("value", "quota")).alias("coverage"))


# ---- anomalies ---------------------------------------------------------------------------------------------------


def detect_anomalies(df: DataFrame, value_col: str = TARGET, by: str = ID, method: str = "zscore", window: int = 6, threshold: float = 3.0) -> DataFrame:
    """df with expected, score, is_anomaly and severity from the trailing window before each row."""
    if method not in ("zscore", "iqr") or window < 2 or threshold <= 0:
        raise ValueError("method is zscore or iqr, window 2 at least, threshold positive")
    w = Window.partitionBy(by).orderBy(TIME).rowsBetween(-window, -1)
    v = F.col(value_col).cast("double")
    full = F.count(v).over(w) == window
    if method == "zscore":
        expected, scale = F.avg(v).over(w), F.stddev_pop(v).over(w)
    else:
        q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(w)
        expected, scale = q[1], (q[2] - q[0]) / 1.349
    out = df.withColumns({"expected": F.when(full, expected), "_scale": F.when(full, scale)})
    d = v - F.col("expected")
    flat = F.when(F.abs(d) <= 1e-8 + 1e-5 * F.abs("expected"), 0.0).when(d > 0, float("inf")).otherwise(float("-inf"))
    tiny = F.col("_scale") <= 1e-12 * F.greatest(F.abs("expected"), F.lit(1.0))
    score = F.when(F.col("_scale").isNull() | v.isNull(), None).when(tiny, flat).otherwise(F.try_divide(d, F.col("_scale")))
    out = out.withColumn("score", score).drop("_scale")
    size = F.coalesce(F.abs("score"), F.lit(0.0))
    return out.withColumns({"is_anomaly": size >= threshold, "severity": F.when(size >= 2 * threshold, "critical").when(size >= 1.5 * threshold, "high").when(size >= threshold, "medium").otherwise("none")})


# ---- scenarios ---------------------------------------------------------------------------------------------------


class Scenario:
    """Named drivers and what they project to. set and bump give new scenarios."""

    def __init__(self, drivers: Mapping[str, float]):
        if not isinstance(drivers, Mapping):
            raise DataContractError("drivers are a mapping of name to number")
        for k, v in drivers.items():
            if not isinstance(k, str) or isinstance(v, bool) or not isinstance(v, (int, float, np.number)) or not math.isfinite(v):
                raise DataContractError(f"driver {k!r} must be a finite number")
        self._drivers = {k: float(v) for k, v in drivers.items()}

    @property
    def drivers(self) -> dict[str, float]:
        return dict(self._drivers)

    def _known(self, names) -> None:
        if new := sorted(set(names) - set(self._drivers)):
            raise EngineError(f"unknown drivers {new}")

    def set(self, **values: float) -> Scenario:
        self._known(values)
        return Scenario(self._drivers | values)

    def bump(self, **deltas: float) -> Scenario:
        self._known(deltas)
        return Scenario(self._drivers | {k: self._drivers[k] + v for k, v in deltas.items()})

    def stage_volumes(self, stages: Mapping[str, float | str]) -> dict[str, float]:
        """Deals of each stage of a funnel whose rates are numbers or drivers' names."""
        if not stages:
            raise ValueError("stages are empty")
        volume, out = self._top(), {}
        for stage, spec in stages.items():
            if isinstance(spec, str):
                self._known([spec])
            rate = self._drivers[spec] if isinstance(spec, str) else float(spec)
            if not 0 <= rate <= 1:
                raise ValueError(f"conversion rates lie in [0, 1]: {stage!r} has {rate}")
            out[stage] = volume = volume * rate
        return out

    def _top(self) -> float:
        if self._drivers.get("top_of_funnel", -1) < 0:
            raise EngineError("a projection needs top_of_funnel, not negative")
        return self._drivers["top_of_funnel"]

    def project(self, stages=None) -> float:
        top, acv = self._top(), self._drivers.get("acv", 1.0)
        if acv < 0:
            raise EngineError("acv must not be negative")
        if stages is not None:
            return list(self.stage_volumes(stages).values())[-1] * acv
        rates = [v for k, v in self._drivers.items() if k.endswith("_rate")]
        if min(rates, default=0) < 0:
            raise EngineError("rates must not be negative")
        return top * math.prod(rates) * acv


def project_scenarios(scenarios: DataFrame) -> DataFrame:
    """(label, projection) of rows (label, drivers map): top_of_funnel times all *_rate times acv."""
    d = F.col("drivers")
    rates = F.map_values(F.map_filter(d, lambda k, v: F.endswith(k, F.lit("_rate"))))
    product = F.aggregate(rates, F.lit(1.0), lambda a, x: a * F.when(x >= 0, x).otherwise(F.raise_error(F.lit("rates must not be negative")).cast("double")))
    return scenarios.select("label", (d["top_of_funnel"] * product * F.coalesce(F.try_element_at(d, F.lit("acv")), F.lit(1.0))).alias("projection"))


def compare_scenarios(scenarios: DataFrame, base: str) -> DataFrame:
    """Projections with delta and pct_delta against the scenario labelled base."""
    p = project_scenarios(scenarios)
    one = p.filter(F.col("label") == base).select(F.col("projection").alias("_base"))
    delta = F.col("projection") - F.col("_base")
    return p.crossJoin(F.broadcast(one)).select("label", "projection", delta.alias("delta"), F.when(F.abs("_base") >= 1e-12, F.try_divide(delta, F.col("_base"))).alias("pct_delta"))


# ---- deal scorer -------------------------------------------------------------------------------------------------


def log_loss(z: Column, y: Column) -> Column:
    """-log likelihood of y (0 to 1) under log odds z, without overflow: log(1 + e^z) - y z."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y * z


class DealScorer:
    """L2 logistic regression with a cross-fitted Platt map. Each Newton step is one aggregate of gradient and curvature sums
    (features are few), the fits of all folds share theirs, and the scaled features are kept on disk meanwhile; scoring is a
    column expression. After fit, loss is the mean log loss on the fitted deals."""

    FOLDS = 5

    def __init__(self, features: list[str] | None = None, l2: float = 1.0, calibrate: bool = True, seed: int = 0):
        self.features, self.l2, self.calibrate, self.seed = features, l2, calibrate, seed
        self.weights: np.ndarray | None = None
        self.platt = (1.0, 0.0)
        self.loss: float | None = None

    @staticmethod
    def _line(w: np.ndarray, xs: list[Column]) -> Column:
        return sum((float(v) * x for v, x in zip(w, xs)), F.lit(0.0))

    @staticmethod
    def _newton(rows: DataFrame, target: Column, xs: list[Column], l2: float, starts: list[np.ndarray], parts: list[Column], rounds: int = 25) -> list[np.ndarray]:
        """A fit for each part (a condition on rows) from its start, all in one aggregate a round."""
        n, fits, open_ = len(xs), [w.copy() for w in starts], set(range(len(starts)))
        penalty = np.array([0.0] + [l2] * (n - 1))
        for _ in range(rounds):
            aggs = []
            for k in sorted(open_):
                p = 1 / (1 + F.exp(-DealScorer._line(fits[k], xs)))
                r, v = F.when(parts[k], target - p), F.when(parts[k], p * (1 - p))
                aggs += [F.sum(r * x).alias(f"g{k}_{i}") for i, x in enumerate(xs)]
                aggs += [F.sum(v * xs[i] * xs[j]).alias(f"h{k}_{i}_{j}") for i in range(n) for j in range(i + 1)]
            sums = rows.agg(*aggs).first()
            for k in sorted(open_):
                g = np.array([sums[f"g{k}_{i}"] for i in range(n)], float)
                h = np.array([[sums[f"h{k}_{max(i, j)}_{min(i, j)}"] for j in range(n)] for i in range(n)], float)
                step = np.linalg.solve(h + np.diag(penalty) + 1e-9 * np.eye(n), g - penalty * fits[k])
                fits[k] = fits[k] + np.clip(step, -8, 8)
                if np.abs(step).max() < 1e-8:
                    open_.discard(k)
            if not open_:
                break
        return fits

    def fit(self, deals: DataFrame, target: str = "won") -> DealScorer:
        if self.features is None:
            self.features = sorted(f.name for f in deals.schema if f.name not in (target, "opp_id") and isinstance(f.dataType, T.NumericType))
        if not self.features:
            raise DataContractError("no numeric features")
        rows, d = deals.withColumn("_y", F.col(target).cast("double")), len(self.features)
        aggs = [F.count("*").alias("n"), F.count_if(F.col("_y").isNull() | ~F.col("_y").isin(0.0, 1.0)).alias("bad"), F.sum("_y").alias("pos")]
        for i, f in enumerate(self.features):
            x = F.col(f).cast("double")
            aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"), F.count_if(x.isNull()).alias(f"x{i}")]
        r = rows.agg(*aggs).first()
        if not r.n or r.bad or any(r[f"x{i}"] for i in range(d)):
            raise DataContractError("the target is 0 or 1 and features have no nulls")
        if not 0 < r.pos < r.n:
            raise DataContractError("both outcomes are needed")
        self.mean, sd = (np.array([r[f"{c}{i}"] for i in range(d)]) for c in "ms")
        self.scale = np.where(sd < 1e-12, 1.0, sd)
        fold = F.pmod(F.xxhash64(*[F.col(c) for c in deals.columns], F.lit(self.seed)), F.lit(self.FOLDS))
        kept = rows.select("_y", fold.alias("_fold"), *[x.alias(f"_x{i}") for i, x in enumerate(self._scaled())]).persist(StorageLevel.DISK_ONLY)
        try:
            xs = [F.lit(1.0), *[F.col(f"_x{i}") for i in range(d)]]
            self.weights = self._newton(kept, F.col("_y"), xs, self.l2, [np.zeros(d + 1)], [F.lit(True)])[0]
            self.platt = (1.0, 0.0)
            if self.calibrate and min(r.pos, r.n - r.pos) >= 20:
                parts = [F.col("_fold") != k for k in range(self.FOLDS)]
                fits = self._newton(kept, F.col("_y"), xs, self.l2, [self.weights] * self.FOLDS, parts)
                out_of_fold = functools.reduce(lambda c, k: c.when(F.col("_fold") == k, self._line(fits[k], xs)), range(1, self.FOLDS), F.when(F.col("_fold") == 0, self._line(fits[0], xs)))
                soft = F.when(F.col("_y") == 1, (r.pos + 1) / (r.pos + 2)).otherwise(1 / (r.n - r.pos + 2))
                scored = kept.select(out_of_fold.alias("_s"), soft.alias("_t"))
                b, a = self._newton(scored, F.col("_t"), [F.lit(1.0), F.col("_s")], 0.0, [np.array([0.0, 1.0])], [F.lit(True)])[0]
                self.platt = (max(float(a), 1e-6), float(b))
            self.loss = kept.agg(F.avg(log_loss(self.platt[0] * self._line(self.weights, xs) + self.platt[1], F.col("_y")))).first()[0]
        finally:
            kept.unpersist()
        return self

    def _scaled(self) -> list[Column]:
        return [(F.col(f).cast("double") - float(m)) / float(s) for f, m, s in zip(self.features, self.mean, self.scale)]

    def predict_proba(self) -> Column:
        if self.weights is None:
            raise NotFittedError("DealScorer")
        a, b = self.platt
        p = 1 / (1 + F.exp(-(a * self._line(self.weights, [F.lit(1.0), *self._scaled()]) + b)))
        return F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
