"""Currency conversion with static rates or rates as of a date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.errors import DataContractError


def _static(rates: dict, to: str) -> dict[str, float]:
    pairs = [isinstance(k, tuple) for k in rates]
    if any(pairs) and not all(pairs):
        raise ValueError("rates mix currencies and (from, to) pairs")
    out = {k[0]: float(v) for k, v in rates.items() if k[1] == to} if all(pairs) and pairs else {k: float(v) for k, v in rates.items()}
    if bad := {k: v for k, v in out.items() if not 0 < v < float("inf")}:
        raise ValueError(f"rates must be positive and finite: {bad}")
    return out


def convert(df: DataFrame, rates, amount_col: str = "amount", currency_col: str = "currency", to: str = "USD", date_col: str | None = None) -> DataFrame:
    """df with amount_col in `to`. rates: a dict {currency: rate} or {(from, to): rate}, or a table (currency, as_of, rate), of which
    the latest on or before date_col counts. A row without a rate stops the job and names what lacks it."""
    said = lambda *c: F.raise_error(F.concat(F.lit("no rate for "), *c))
    own = F.col(currency_col) == to
    if isinstance(rates, dict):
        known = _static(rates, to)
        table = F.create_map(*[F.lit(x) for k, v in known.items() for x in (k, v)]) if known else F.create_map().cast("map<string,double>")
        rate = F.when(own, F.lit(1.0)).otherwise(F.coalesce(F.try_element_at(table, F.col(currency_col)), said(F.coalesce(currency_col, F.lit("null")))))
        return df.withColumn(amount_col, F.col(amount_col) * rate)
    if date_col is None:
        raise ValueError("dated rates need date_col")
    found = with_asof_rate(df, rates, currency_col, date_col)
    rate = F.when(own, F.lit(1.0)).otherwise(F.coalesce("asof_rate", said(F.coalesce(currency_col, F.lit("null")), F.lit(" on "), F.coalesce(F.col(date_col).cast("string"), F.lit("null")))))
    return found.withColumn(amount_col, F.col(amount_col) * rate).drop("asof_rate")


def with_asof_rate(df: DataFrame, rates: DataFrame, currency_col: str, date_col: str) -> DataFrame:
    """df with asof_rate, the latest rate of its currency on or before its date. Rows meet rates by currency
    and month, so a frequent currency is split by its months."""
    if missing := [c for c in ("currency", "as_of", "rate") if c not in rates.columns]:
        raise DataContractError(f"a rate table needs {missing}")
    r = rates.select(F.col("currency").alias("_c"), F.col("as_of").cast("timestamp_ntz").alias("_t"), F.col("rate").cast("double").alias("_r"))
    at = F.col(date_col).cast("timestamp_ntz")
    month = lambda c: F.year(c) * 12 + F.month(c)
    latest = df.agg(F.max(month(at))).first()[0] or 0  # one number: how far the open last rates must reach
    # an interval join by currency and month: each rate reaches the months up to the next one, the last one those up to the latest row
    spans = r.withColumn("_until", F.lead("_t").over(Window.partitionBy("_c").orderBy("_t")))
    upto = F.greatest(month(F.col("_t")), F.coalesce(month(F.col("_until")), F.lit(latest)))
    spans = spans.withColumn("_m", F.explode(F.sequence(month(F.col("_t")), upto)))
    within = (at >= spans["_t"]) & (spans["_until"].isNull() | (at < spans["_until"]))
    out = df.join(spans, (F.col(currency_col) == spans["_c"]) & (month(at) == spans["_m"]) & within, "left")
    return out.select(*[df[c] for c in df.columns], F.col("_r").alias("asof_rate"))
