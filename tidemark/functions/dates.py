"""Period labels, steps, future times, and calendar features as columns."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contract import ID, TIME, by_time

NTZ = "timestamp_ntz"


def bucket(c: Column, freq: str) -> Column:
    """The label of the period of freq that holds c: its start (D, h, min, s and multiples, MS, QS, YS) or its last day
    (W, ME, QE, YE)."""
    m = re.fullmatch(r"(\d*)(D|h|min|s|MS|QS|YS|ME|QE|YE|W|W-SUN)", freq)
    if not m:
        raise ValueError(f"unknown frequency {freq!r}")
    k, unit = int(m[1] or 1), m[2]
    c = c.cast(NTZ)
    starts = {"D": "day", "h": "hour", "min": "minute", "s": "second", "MS": "month", "QS": "quarter", "YS": "year"}
    if unit in starts and k == 1:
        return F.date_trunc(starts[unit], c).cast(NTZ)
    if unit in ("D", "h", "min", "s"):
        size = k * {"D": 86400, "h": 3600, "min": 60, "s": 1}[unit] * 1_000_000
        micros = F.unix_micros(c.cast("timestamp"))
        return F.timestamp_micros(micros - F.pmod(micros, F.lit(size))).cast(NTZ)
    if k != 1:
        raise ValueError(f"multiples of {unit} are no calendar periods")
    if unit in ("W", "W-SUN"):
        return F.date_add(F.date_trunc("week", c).cast("date"), 6).cast(NTZ)
    if unit == "ME":
        return F.last_day(c.cast("date")).cast(NTZ)
    months = {"QE": 3, "YE": 12}[unit]
    return F.date_add(F.add_months(F.date_trunc({"QE": "quarter", "YE": "year"}[unit], c).cast("date"), months), -1).cast(NTZ)


def grid(first: Column, last: Column, freq: str) -> Column:
    """All labels from first to last."""
    ends = {"ME": "MS", "QE": "QS", "YE": "YS"}
    if freq in ends:
        whole = grid(bucket(first, ends[freq]), bucket(last, ends[freq]), ends[freq])
        return F.transform(whole, lambda x: bucket(x, freq))
    m = re.fullmatch(r"(\d*)(D|h|min|s|MS|QS|YS|W|W-SUN)", freq)
    k, unit = int(m[1] or 1), m[2]
    every = {"D": "1 day", "h": "1 hour", "min": "1 minute", "s": "1 second", "MS": "1 month", "QS": "3 months", "YS": "1 year", "W": "7 days", "W-SUN": "7 days"}[unit]
    n, word = every.split()
    return F.sequence(first, last, F.expr(f"interval {int(n) * k} {word}"))


def parse_dates(c: Column, kind: str, unit: str | None = None, pattern: str | None = None) -> Column:
    """Numbers need a unit (s, ms, us) or a strftime pattern; text may have a pattern."""
    numeric = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
    if numeric and not (unit or pattern):
        raise ValueError("a numeric date column needs date_unit or date_format")
    if unit:
        make = {"s": F.timestamp_seconds, "ms": F.timestamp_millis, "us": F.timestamp_micros}.get(unit)
        if make is None:
            raise ValueError(f"unknown date unit {unit!r}")
        return make(c.cast("bigint") if unit != "s" else c.cast("double")).cast(NTZ)
    if pattern:
        java = pattern
        for a, b in (("%Y", "yyyy"), ("%m", "MM"), ("%d", "dd"), ("%H", "HH"), ("%M", "mm"), ("%S", "ss"), ("%y", "yy"), ("%b", "MMM"), ("%j", "DDD")):
            java = java.replace(a, b)
        text = c.cast("bigint").cast("string") if numeric else c
        return F.to_timestamp(text, java).cast(NTZ)
    return c.cast(NTZ)


def _business_end(d: Column) -> Column:
    """Last weekday of d's month."""
    last = F.last_day(d)
    return F.date_sub(last, F.greatest(F.weekday(last) - 4, F.lit(0)))


def _business_start(d: Column) -> Column:
    """First weekday of d's month."""
    first = F.trunc(d, "month")
    return F.date_add(first, F.when(F.weekday(first) > 4, 7 - F.weekday(first)).otherwise(0))


def with_step(df: DataFrame) -> DataFrame:
    """One row per series: last (its last ds) and its step. For numbers that is the middle difference. For times it is, of
    three rows or more, one of: whole months between equal days, month ends, or first or last weekdays of months (months and anchor);
    weekdays (business); a constant difference. Without any of these it is the middle difference, and regular is false."""
    numeric = dict(df.dtypes)[TIME] != NTZ
    before = F.lag(TIME).over(by_time())
    if numeric:
        d = df.select(ID, TIME, (F.col(TIME) - before).cast("double").alias("d"))
        return d.groupBy(ID).agg(F.max(TIME).alias("last"), F.coalesce(F.percentile("d", F.lit(0.5)), F.lit(1.0)).alias("number"))
    now = F.col(TIME)
    day, gap = now.cast("date"), F.datediff(now.cast("date"), before.cast("date"))
    clock = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.date_trunc("day", now).cast("timestamp"))
    d = df.select(
        ID, TIME, (F.unix_micros(now.cast("timestamp")) - F.unix_micros(before.cast("timestamp"))).alias("d"),
        ((F.year(now) - F.year(before)) * 12 + F.month(now) - F.month(before)).alias("m"), F.dayofmonth(now).alias("day"), clock.alias("clock"),
        (day == F.last_day(day)).alias("end"), (day == _business_end(day)).alias("bend"), (day == _business_start(day)).alias("bstart"),
        (F.weekday(now) < 5).alias("weekday"), (gap == F.when(F.weekday(before) == 4, 3).otherwise(1)).alias("next"),
    )
    several = F.count("d") > 1
    monthly = several & (F.min("m") == F.max("m")) & (F.min("m") > 0) & (F.min("clock") == F.max("clock"))
    anchor = F.when(F.min("day") == F.max("day"), "day").when(F.bool_and("end"), "end").when(F.bool_and("bstart"), "bstart").when(F.bool_and("bend"), "bend")
    constant = several & (F.min("d") == F.max("d"))
    weekdays = several & ~(F.min("d") == F.max("d")) & F.bool_and("weekday") & F.bool_and("next") & (F.min("clock") == F.max("clock"))
    months = F.when(monthly & anchor.isNotNull(), F.min("m"))
    return d.groupBy(ID).agg(
        F.max(TIME).alias("last"), months.alias("months"), F.when(months.isNotNull(), anchor).alias("anchor"),
        F.coalesce(F.percentile("d", F.lit(0.5)).cast("bigint"), F.lit(86_400_000_000)).alias("micros"),
        F.coalesce(weekdays, F.lit(False)).alias("business"), (months.isNotNull() | F.coalesce(constant | weekdays, F.lit(False))).alias("regular"),
    )


def future(steps: DataFrame, h: int) -> DataFrame:
    """(unique_id, step, ds) of the h steps after each series' last."""
    out = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(h))))
    if "number" in steps.columns:
        whole = dict(steps.dtypes)["last"] == "bigint"
        ds = F.col("last") + F.col("step") * F.col("number")
        return out.select(ID, "step", (F.when(F.lit(whole), F.round(ds)).otherwise(ds)).cast(dict(steps.dtypes)["last"]).alias(TIME))
    last, anchor = F.col("last").cast("date"), F.col("anchor")
    moved = F.add_months(last, F.col("step") * F.col("months"))
    in_month = F.when(anchor == "end", F.last_day(moved)).when(anchor == "bend", _business_end(moved)).when(anchor == "bstart", _business_start(moved)).otherwise(moved)
    # k weekdays on from a weekday: a weekend more for each Friday passed
    weekday = F.date_add(last, (F.col("step") + 2 * F.floor((F.weekday(last) + F.col("step")) / 5)).cast("int"))
    day = F.when(F.col("business"), weekday).otherwise(in_month).cast(NTZ)
    clock = F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.date_trunc("day", F.col("last")).cast("timestamp"))
    by_day = F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + clock).cast(NTZ)
    by_clock = F.timestamp_micros(F.unix_micros(F.col("last").cast("timestamp")) + F.col("step") * F.col("micros")).cast(NTZ)
    return out.select(ID, "step", F.when(F.col("months").isNotNull() | F.col("business"), by_day).otherwise(by_clock).alias(TIME))


def modal_step(steps: DataFrame) -> dict | None:
    """The most common step among series: months, anchor, micros (null with months or business), business and regular. Ties go to
    the step of the first series in order."""
    if "number" in steps.columns:
        return None
    key = ["months", "anchor", "business", "regular", F.when(F.col("months").isNull() & ~F.col("business"), F.col("micros")).alias("micros")]
    r = steps.groupBy(*key).agg(F.count("*").alias("n"), F.min(ID).alias("first")).orderBy(F.desc("n"), "first").first()  # one row a step met
    return r and {k: r[k] for k in ("months", "anchor", "micros", "business", "regular")}


def season_of(steps: DataFrame) -> int:
    """Season length of the most common step: 7 for days, 5 for weekdays, 52 for weeks, 12 for months, 4 for quarters, 24 for hours, else 1."""
    step = modal_step(steps)
    if step is None or not step["regular"]:
        return 1
    if step["business"]:
        return 5
    if step["months"]:
        return {1: 12, 3: 4}.get(step["months"], 1) if step["anchor"] in ("day", "end") else 1
    return {86400: 7, 7 * 86400: 52, 3600: 24}.get(step["micros"] / 1e6, 1)


def lag_features(df: DataFrame, lags, column: str = "y") -> DataFrame:
    """df with lag_k, the value k rows before in the series."""
    if not lags or min(lags) < 1:
        raise ValueError("lags are whole numbers from 1")
    return df.withColumns({f"lag_{k}": F.lag(column, k).over(by_time()) for k in lags})


def wall_clock(c: Column, zone: str) -> Column:
    """What the clocks of a zone show at an instant, without a zone."""
    return F.convert_timezone(F.current_timezone(), F.lit(zone), c.cast("timestamp").cast(NTZ))


def instant_of(c: Column, zone: str) -> Column:
    """The instant at which the clocks of a zone show c, as the session's local time. What a change of clocks skips moves
    forward to the first instant there is, and of a time that comes twice the first counts."""
    return F.convert_timezone(F.lit(zone), F.current_timezone(), c)


def bucket_zoned(c: Column, freq: str, zone: str) -> Column:
    """bucket by the wall clock of a zone: the instant at which the label's period begins (or its last day) there."""
    return instant_of(bucket(wall_clock(c, zone), freq), zone)


#: feature -> (column builder, cycle, first value)
_CALENDAR = {
    "dayofweek": (lambda c: F.weekday(c), 7, 0), "day": (F.dayofmonth, 31, 1), "month": (F.month, 12, 1), "quarter": (F.quarter, 4, 1),
    "dayofyear": (F.dayofyear, 366, 1), "hour": (F.hour, 24, 0), "minute": (F.minute, 60, 0),
}


def calendar_features(df: DataFrame, features=("dayofweek", "month", "dayofyear"), cyclical: bool = True) -> DataFrame:
    """Parts of ds, as integers or as a sine and cosine of their cycle."""
    if unknown := [f for f in features if f not in _CALENDAR]:
        raise ValueError(f"unknown calendar features {unknown}")
    out = {}
    for f in features:
        of, cycle, first = _CALENDAR[f]
        if cyclical:
            angle = (of(F.col(TIME)) - first) * (2 * math.pi / cycle)
            out[f"{f}_sin"], out[f"{f}_cos"] = F.sin(angle), F.cos(angle)
        else:
            out[f] = of(F.col(TIME)).cast("int")
    return df.withColumns(out)


def fourier_features(df: DataFrame, season_length: float, k: int = 3) -> DataFrame:
    """k harmonics of the position in each series."""
    t = F.row_number().over(by_time()) - 1
    out = {}
    for i in range(1, k + 1):
        angle = t * (2 * math.pi * i / season_length)
        out[f"sin_{i}"], out[f"cos_{i}"] = F.sin(angle), F.cos(angle)
    return df.withColumns(out)


class FiscalCalendar:
    """Fiscal years named by the year they end in: whole months from start_month, or 4-4-5 weeks from its first Monday."""

    def __init__(self, start_month: int = 1, scheme: str = "calendar"):
        if not 1 <= start_month <= 12 or scheme not in ("calendar", "445"):
            raise ValueError("start_month is 1 to 12 and scheme is calendar or 445")
        self.start_month, self.scheme = start_month, scheme

    def parts(self, c: Column) -> dict[str, Column]:
        """fiscal_year, fiscal_quarter, fiscal_period, quarter_start, quarter_end."""
        return (self._445 if self.scheme == "445" else self._months)(c.cast("date"))

    def _months(self, d: Column) -> dict[str, Column]:
        shift = self.start_month - 1
        into = F.pmod(F.month(d) - 1 - shift, F.lit(12))
        quarter = F.floor(into / 3).cast("int")
        start = F.add_months(F.trunc(d, "month"), -(into % 3))
        year = F.year(d) + (F.when(F.month(d) > shift, 1).otherwise(0) if shift else F.lit(0))
        return {"fiscal_year": year.cast("int"), "fiscal_quarter": quarter + 1, "fiscal_period": (into + 1).cast("int"), "quarter_start": start, "quarter_end": F.date_add(F.add_months(start, 3), -1)}

    def _anchor(self, year: Column) -> Column:
        return F.next_day(F.date_sub(F.make_date(year, F.lit(self.start_month), F.lit(1)), 1), "MON")

    def _445(self, d: Column) -> dict[str, Column]:
        y = F.year(d)
        begin = F.when(d >= self._anchor(y), y).otherwise(y - 1)
        anchor, after = self._anchor(begin), self._anchor(begin + 1)
        week = F.floor(F.datediff(d, anchor) / 7).cast("int")
        quarter = F.least(F.floor(week / 13), F.lit(3)).cast("int")
        inside = week - quarter * 13
        month = F.when(inside < 4, 0).when(inside < 8, 1).otherwise(2)
        year = begin + (0 if self.start_month == 1 else 1)
        start = F.date_add(anchor, quarter * 91)
        end = F.when(quarter == 3, F.date_sub(after, 1)).otherwise(F.date_add(start, 90))
        return {"fiscal_year": year.cast("int"), "fiscal_quarter": quarter + 1, "fiscal_period": (quarter * 3 + month + 1).cast("int"), "quarter_start": start, "quarter_end": end}

    def label(self, c: Column) -> Column:
        p = self.parts(c)
        return F.format_string("FY%02dQ%d", F.pmod(p["fiscal_year"], F.lit(100)), p["fiscal_quarter"])

    def features(self, df: DataFrame) -> DataFrame:
        """fiscal quarter's sine and cosine, fraction elapsed and days to its end."""
        p = self.parts(F.col(TIME))
        angle = (p["fiscal_quarter"] - 1) * (2 * math.pi / 4)
        size = F.datediff(p["quarter_end"], p["quarter_start"]) + 1
        into = F.datediff(F.col(TIME).cast("date"), p["quarter_start"])
        return df.withColumns({"fiscal_quarter_sin": F.sin(angle), "fiscal_quarter_cos": F.cos(angle), "quarter_elapsed": into / size, "days_to_quarter_end": F.datediff(p["quarter_end"], F.col(TIME).cast("date"))})


#: Periods a year by frequency's unit.
PERIODS = {"D": 252, "B": 252, "W": 52, "MS": 12, "ME": 12, "BME": 12, "QS": 4, "QE": 4, "BQE": 4, "YS": 1, "YE": 1, "BYE": 1, "h": 6048, "min": 362880, "s": 21772800}


def periods_per_year(steps: DataFrame) -> int:
    """Of the most common step among series; 252 where it is no known one."""
    step = modal_step(steps)
    if step is None or not step["regular"] or step["business"]:
        return 252
    if step["months"]:
        return max(1, round(12 / step["months"]))
    seconds = step["micros"] / 1e6
    if seconds >= 7 * 86400 and seconds % (7 * 86400) == 0:
        return max(1, round(52 / (seconds / (7 * 86400))))
    if seconds >= 86400:
        return max(1, round(252 / (seconds / 86400)))
    return max(1, round(252 * 86400 / seconds)) if seconds > 0 else 252
