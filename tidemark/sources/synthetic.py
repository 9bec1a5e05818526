"""Seeded fixtures and helpers that make panels from arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.contract import ID, TARGET, TIME

#: Monthly airline passengers, 1949 to 1960, in thousands (Box and Jenkins).
PASSENGERS = """112 118 132 129 121 135 148 148 136 119 104 118 115 126 141 135 125 149 170 170 158 133 114 140
145 150 178 163 172 178 199 199 184 162 146 166 171 180 193 181 183 218 230 242 209 191 172 194
196 196 236 235 229 243 264 272 237 211 180 201 204 188 235 227 234 264 302 293 259 229 203 229
242 233 267 269 270 315 364 347 312 274 237 278 284 277 317 313 318 374 413 405 355 306 271 306
315 301 356 348 355 422 465 467 404 347 305 336 340 318 362 348 363 435 491 505 404 359 310 337
360 342 406 396 420 472 548 559 463 407 362 405 417 391 419 461 472 535 622 606 508 461 390 432"""


def _frame(spark: SparkSession, pdf: pd.DataFrame) -> DataFrame:
    out = spark.createDataFrame(pdf).withColumn(TARGET, F.when(~F.isnan(TARGET), F.col(TARGET)))
    return out.withColumn(TIME, F.col(TIME).cast("timestamp_ntz")) if dict(out.dtypes)[TIME].startswith("timestamp") else out


def panel_of(spark: SparkSession, y, ds=None, unique_id: str = "series-0") -> DataFrame:
    y = np.asarray(y, float)
    return _frame(spark, pd.DataFrame({ID: unique_id, TIME: np.arange(len(y)) if ds is None else ds, TARGET: y}))


def generate_series(spark: SparkSession, n_series=3, length=200, freq="D", start="2024-01-01", level=100.0, trend=0.5, seasonality=7, season_amp=10.0, noise=1.0, seed=0) -> DataFrame:
    r, t = np.random.default_rng(seed), np.arange(length)
    ds = pd.date_range(start, periods=length, freq=freq)
    parts = []
    for i in range(n_series):
        y = level + trend * t + r.normal(0, noise, length)
        if seasonality:
            y = y + season_amp * np.sin(2 * np.pi * t / seasonality)
        parts.append(pd.DataFrame({ID: f"series-{i}", TIME: ds, TARGET: y}))
    return _frame(spark, pd.concat(parts))


def generate_returns(spark: SparkSession, n_series=1, length=500, mu=0.0005, sigma=0.01, garch=None, start="2024-01-01", freq="B", seed=0) -> DataFrame:
    r = np.random.default_rng(seed)
    ds = pd.date_range(start, periods=length, freq=freq)
    parts = []
    for i in range(n_series):
        z = r.standard_normal(length)
        if garch is None:
            y = mu + sigma * z
        else:
            omega, alpha, beta = garch
            v, y = omega / max(1 - alpha - beta, 1e-6), np.empty(length)
            for t in range(length):
                e = np.sqrt(v) * z[t]
                y[t] = mu + e
                v = omega + alpha * e * e + beta * v
        parts.append(pd.DataFrame({ID: f"asset-{i}", TIME: ds, TARGET: y}))
    return _frame(spark, pd.concat(parts))


def air_passengers(spark: SparkSession) -> DataFrame:
    y = [float(x) for x in PASSENGERS.split()]
    return panel_of(spark, y, pd.date_range("1949-01-01", periods=len(y), freq="MS"), "AirPassengers")


def demo_panel(spark: SparkSession, months: int = 30, seed: int = 7) -> DataFrame:
    r, t = np.random.default_rng(seed), np.arange(months)
    ds = pd.date_range("2023-01-01", periods=months, freq="MS")
    parts = []
    for team in ("east", "west"):
        for rep in ("alice", "bob", "carol"):
            y = np.maximum(r.uniform(20, 60) + r.uniform(0.2, 1.2) * t + r.uniform(3, 9) * np.sin(2 * np.pi * t / 12) + r.normal(0, 3, months), 0)
            parts.append(pd.DataFrame({ID: f"{team}/{rep}", TIME: ds, TARGET: np.round(y, 2)}))
    return _frame(spark, pd.concat(parts))
