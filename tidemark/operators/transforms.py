"""Reversible transforms of panels. fit() learns a small table of parameters a series; transform() and inverse() are joins
and windows over it. Inverses act on every numeric column but ids, times and covariates known at fit."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.contract import ID, TARGET, TIME, by_time, covariates
from ..functions.errors import DataContractError, NotFittedError


class Transform:
    """Base: params is a DataFrame with one row a series."""

    def __init__(self):
        self.params: DataFrame | None = None
        self.known: list[str] = []

    def fit(self, df: DataFrame):
        self.known = covariates(df)
        self.params = self._learn(df)
        return self

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def _joined(self, df: DataFrame) -> DataFrame:
        if self.params is None:
            raise NotFittedError(type(self).__name__)
        out = df.join(self.params.withColumn("_fit", F.lit(True)), ID, "left")
        seen = F.when(F.col("_fit"), F.col(ID)).otherwise(F.raise_error(F.concat(F.lit("series not fitted: "), F.col(ID).cast("string"))))
        return out.withColumn(ID, seen).drop("_fit")

    def _values(self, df: DataFrame) -> list[str]:
        skip = {ID, TIME, "cutoff", "step", *self.known}
        return [f.name for f in df.schema if f.name not in skip and isinstance(f.dataType, T.NumericType)]

    def _learn(self, df: DataFrame) -> DataFrame:
        return df.select(ID).distinct()

    def _forward(self, v: Column) -> Column:
        raise NotImplementedError

    def _back(self, v: Column) -> Column:
        raise NotImplementedError

    def transform(self, df: DataFrame) -> DataFrame:
        done = self._joined(df)
        cols = [c for c in df.columns if c in (TARGET, "yhat") or re.search(r"^(lo|hi)[-_]|-(lo|hi)-", c)]
        return done.withColumns({c: self._forward(F.col(f"`{c}`")) for c in cols}).select(*[F.col(f"`{c}`") for c in df.columns])

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        done = self._joined(df)
        return done.withColumns({c: self._back(F.col(f"`{c}`").cast("double")) for c in self._values(df)}).select(*[F.col(f"`{c}`") for c in df.columns])


class Imputer(Transform):
    """Fills missing y: interpolate (by row position, ends carried), ffill, bfill, mean or zero."""

    def __init__(self, method: str = "interpolate"):
        super().__init__()
        if method not in ("interpolate", "ffill", "bfill", "mean", "zero"):
            raise ValueError(f"unknown method {method!r}")
        self.method = method

    def transform(self, df: DataFrame) -> DataFrame:
        if self.params is None:
            raise NotFittedError("Imputer")
        w = by_time()
        back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
        y, pos = F.col(TARGET), F.row_number().over(w)
        before, after = F.last(y, True).over(back), F.first(y, True).over(ahead)
        at = lambda c, f, win: f(F.when(y.isNotNull(), c), True).over(win)
        df1 = df.withColumn("_pos", pos)
        p = F.col("_pos")
        if self.method == "interpolate":
            a, b = at(p, F.last, back), at(p, F.first, ahead)
            v = F.coalesce(y, before + (after - before) * F.try_divide(p - a, b - a), before, after)
        elif self.method == "mean":
            v = F.coalesce(y, F.avg(y).over(Window.partitionBy(ID)))
        elif self.method == "zero":
            v = F.coalesce(y, F.lit(0.0))
        else:
            v = F.coalesce(y, before if self.method == "ffill" else after)
        out = df1.withColumn("_v", v)
        if self.method in ("interpolate", "mean"):
            out = out.withColumn("_v", F.coalesce("_v", F.raise_error(F.lit("a series has no observed value")).cast("double")))
        return out.withColumn(TARGET, F.col("_v")).select(*df.columns)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df


class StandardScaler(Transform):
    """Mean 0 and population deviation 1 (floored at 1e-12) of each series."""

    def _learn(self, df):
        return df.groupBy(ID).agg(F.avg(TARGET).alias("_mu"), F.greatest(F.stddev_pop(TARGET), F.lit(1e-12)).alias("_sd"))

    def _forward(self, v):
        return (v - F.col("_mu")) / F.col("_sd")

    def _back(self, v):
        return v * F.col("_sd") + F.col("_mu")


class LogTransform(Transform):
    """ln(y + offset); offset auto is 0 for positive series, else 1 - min."""

    def __init__(self, offset="auto"):
        super().__init__()
        self.offset = offset

    def _learn(self, df):
        low = F.min(TARGET)
        auto = F.when(low > 0, 0.0).otherwise(1.0 - low)
        return df.groupBy(ID).agg((auto if self.offset == "auto" else F.lit(float(self.offset))).alias("_off"))

    def _forward(self, v):
        inside = v + F.col("_off")
        return F.when(v.isNotNull() & (inside <= 0), F.raise_error(F.lit("log of a value at or below -offset")).cast("double")).otherwise(F.ln(inside))

    def _back(self, v):
        return F.exp(v) - F.col("_off")


class LogitTransform(Transform):
    """Log-odds between lower and upper (numbers, or dicts by series), clipped by eps; the inverse stays strictly inside."""

    def __init__(self, lower=0.0, upper=1.0, eps: float = 1e-6):
        super().__init__()
        self.lower, self.upper, self.eps = lower, upper, eps

    def _learn(self, df):
        def bound(x):
            if isinstance(x, dict):
                return F.try_element_at(F.create_map(*[F.lit(v) for k, b in x.items() for v in (k, float(b))]), F.col(ID))
            return F.lit(float(x))

        return df.select(ID).distinct().select(ID, bound(self.lower).alias("_lo"), bound(self.upper).alias("_hi"))

    def _forward(self, v):
        width = F.col("_hi") - F.col("_lo")
        inside = F.least(F.greatest(v, F.col("_lo") + self.eps * width), F.col("_hi") - self.eps * width)
        return F.ln((inside - F.col("_lo")) / (F.col("_hi") - inside))

    def _back(self, v):
        width = F.col("_hi") - F.col("_lo")
        tiny = math.ulp(1.0)
        x = F.col("_lo") + width / (1 + F.exp(-v))
        return F.least(F.greatest(x, F.col("_lo") + width * tiny), F.col("_hi") - width * tiny)


class Differencer(Transform):
    """d-th difference; the first d rows go. The inverse integrates a full differenced panel from the first values, or a
    continuation (ds after the fitted rows) from the last ones."""

    def __init__(self, d: int = 1):
        super().__init__()
        if d < 1:
            raise ValueError("d starts at 1")
        self.d = d

    def _levels(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("_d0", F.col(TARGET))
        for i in range(1, self.d + 1):
            out = out.withColumn(f"_d{i}", F.col(f"_d{i - 1}") - F.lag(f"_d{i - 1}").over(by_time()))
        return out.withColumn("_pos", F.row_number().over(by_time()) - 1)

    def _learn(self, df):
        lv = self._levels(df)
        aggs = [F.max(TIME).alias("_last_ds"), F.min(F.when(F.col("_pos") == self.d, F.col(TIME))).alias("_first_ds")]
        for i in range(self.d):
            aggs += [F.min_by(f"_d{i}", F.when(F.col("_pos") == self.d - 1, F.col(TIME))).alias(f"_a{i}"), F.max_by(f"_d{i}", TIME).alias(f"_z{i}")]
        return lv.groupBy(ID).agg(*aggs)

    def transform(self, df):
        self._joined(df.limit(0))
        return self._levels(df).filter(F.col("_pos") >= self.d).withColumn(TARGET, F.col(f"_d{self.d}")).select(*df.columns)

    def inverse_transform(self, df):
        out = self._joined(df)
        first = F.min(TIME).over(Window.partitionBy(ID))
        out = out.withColumn("_from", F.when(first == F.col("_first_ds"), F.lit("a")).when(first > F.col("_last_ds"), F.lit("z")).otherwise(F.raise_error(F.lit("integrate the whole differenced panel or its continuation"))))
        values = self._values(df)
        running = by_time().rowsBetween(Window.unboundedPreceding, 0)
        for i in reversed(range(self.d)):
            start = F.when(F.col("_from") == "a", F.col(f"_a{i}")).otherwise(F.col(f"_z{i}"))
            out = out.withColumns({c: start + F.sum(F.col(c)).over(running) for c in values})
        return out.select(*df.columns)


class Pipeline:
    """Named transforms in order; the inverse runs backwards."""

    def __init__(self, steps: list[tuple[str, Transform]]):
        names = [n for n, _ in steps]
        if not steps or len(set(names)) < len(names):
            raise ValueError("steps need unique names")
        self.steps = steps

    def fit_transform(self, df: DataFrame) -> DataFrame:
        for _, t in self.steps:
            df = t.fit_transform(df)
        return df

    def fit(self, df: DataFrame):
        self.fit_transform(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for _, t in self.steps:
            df = t.transform(df)
        return df

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        for _, t in reversed(self.steps):
            df = t.inverse_transform(df)
        return df


def check_observed(df: DataFrame) -> None:
    bad = df.groupBy(ID).agg(F.count(TARGET).alias("n")).filter("n = 0").limit(3).collect()
    if bad:
        raise DataContractError(f"series without any value: {[r[0] for r in bad]}")
