"""Records to panels: recipes, event aggregation, densification, funnels and cohorts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates
from ..functions.contract import ID, TARGET, TIME
from ..functions.errors import DataContractError

AGGREGATES = ("sum", "mean", "count")
#: A number or an amount of money as text, what to strip from it, and accounting's negative.
MONEY = r"^\s*[-+]?\s*[$€£¥]?\s*(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\s*$"
STRIP = r"[$€£¥,\s]"
NEGATIVE = r"^\s*([$€£¥]?\s*)\(\s*(.*?)\s*\)\s*$"


def money(c: Column) -> tuple[Column, Column]:
    """(value, fine): text to double, parentheses meaning minus; blank is null; fine is false for any other text."""
    text = F.nullif(F.trim(c), F.lit(""))
    body = F.regexp_replace(text, NEGATIVE, "$1$2")
    value = F.regexp_replace(body, STRIP, "").try_cast("double")
    return F.when(text.rlike(NEGATIVE), -value).otherwise(value), F.coalesce(body.rlike(MONEY), F.lit(True))


def clean_numeric_text(df: DataFrame) -> DataFrame:
    """Text columns of which over 80 % of the values are numbers or money become doubles (others there become null), except
    columns of eight-digit dates and those with zero-padded codes. One profiling aggregate over all text columns."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    q = lambda c: F.col(f"`{c}`")
    checks = []
    for i, c in enumerate(texts):
        bare = F.regexp_replace(q(c), STRIP, "")
        checks += [F.avg(q(c).rlike(MONEY).cast("double")).alias(f"share{i}"), F.bool_and(F.trim(q(c)).rlike(r"^\d{8}$")).alias(f"dates{i}"), F.bool_or(bare.rlike(r"^0\d+$")).alias(f"codes{i}")]
    r = df.agg(*checks).first()
    change = {}
    for i, c in enumerate(texts):
        if r[f"share{i}"] is not None and r[f"share{i}"] > 0.8 and not r[f"dates{i}"] and not r[f"codes{i}"]:
            change[c] = F.when(q(c).rlike(MONEY), F.regexp_replace(q(c), STRIP, "").try_cast("double"))
    return df.withColumns(change)


def to_panel(records: DataFrame, id_cols, date_col: str, value_col: str | None = None, freq: str = "MS", agg: str = "sum", fill_value: float | None = 0.0, span: str = "series", sep: str = "/", date_unit: str | None = None, date_format: str | None = None) -> DataFrame:
    """Event rows to a dense panel: ids joined by sep, dates bucketed, values aggregated (row counts without a value column),
    missing periods of the series' (or the whole panel's) range filled."""
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    if agg not in AGGREGATES or span not in ("series", "panel"):
        raise ValueError(f"agg is one of {AGGREGATES} and span is series or panel")
    if missing := [c for c in (*ids, date_col, *([value_col] if value_col else [])) if c not in records.columns]:
        raise DataContractError(f"records lack column(s) {missing}")
    at = dates.parse_dates(F.col(date_col), dict(records.dtypes)[date_col], date_unit, date_format)
    null_key = at.isNull()
    for c in ids:
        null_key = null_key | F.col(c).isNull()
    # a null key stops the job where it is met, so no extra pass is needed
    guard = F.when(null_key, F.raise_error(F.lit("a record has no date or id"))).otherwise(F.concat_ws(sep, *[F.col(c).cast("string") for c in ids]))
    rows = records.select(guard.alias(ID), dates.bucket(at, freq).alias(TIME), (F.col(value_col).cast("double") if value_col else F.lit(1.0)).alias("v"))
    how = F.count("v").cast("double") if agg == "count" or not value_col else F.avg("v") if agg == "mean" else F.coalesce(F.sum("v"), F.lit(0.0))
    return densify(rows.groupBy(ID, TIME).agg(how.alias(TARGET)), freq, fill_value, span)


def densify(panel: DataFrame, freq: str, fill_value: float | None = 0.0, span: str = "series") -> DataFrame:
    """Adds the periods that a series (or, with span panel, the whole panel) spans but lacks."""
    ends = panel.groupBy(ID).agg(F.min(TIME).alias("a"), F.max(TIME).alias("b"))
    if span == "panel":
        all_ = panel.agg(F.min(TIME).alias("a"), F.max(TIME).alias("b"))  # one row
        ends = ends.select(ID).crossJoin(F.broadcast(all_))
    full = ends.select(ID, F.explode(dates.grid(F.col("a"), F.col("b"), freq)).alias(TIME))
    out = full.join(panel.withColumn("here", F.lit(True)), [ID, TIME], "left")
    filled = F.when(F.col("here"), F.col(TARGET)).otherwise(F.lit(fill_value).cast("double"))
    return out.select(ID, TIME, filled.alias(TARGET), *[c for c in panel.columns if c not in (ID, TIME, TARGET)])


def fill_gaps(panel: DataFrame, freq: str, fill_value: float | None = 0.0) -> DataFrame:
    """Each series on its own grid; a ds off the grid is refused."""
    if panel.filter(dates.bucket(F.col(TIME), freq) != F.col(TIME)).limit(1).count():
        raise DataContractError(f"some ds are not on the {freq} grid")
    return densify(panel, freq, fill_value)


def collapse(panel: DataFrame, how: str = "sum") -> DataFrame:
    """Repeated (unique_id, ds) to one row."""
    f = {"sum": lambda: F.coalesce(F.sum(TARGET), F.lit(0.0)), "mean": lambda: F.avg(TARGET), "count": lambda: F.count(TARGET).cast("double")}[how]
    return panel.groupBy(ID, TIME).agg(f().alias(TARGET))


@dataclass(frozen=True)
class SchemaMapping:
    """A recipe from a platform's export to a panel; every field can be overridden when it is applied."""

    name: str
    description: str
    date_col: str
    id_cols: tuple[str, ...] | str = ()
    value_col: str | None = None
    renames: dict[str, str] = field(default_factory=dict)
    filters: dict[str, tuple] = field(default_factory=dict)
    freq: str = "MS"
    agg: str = "sum"
    fill_value: float = 0.0
    span: str = "series"
    sep: str = "/"
    date_unit: str | None = None
    date_format: str | None = None

    def apply(self, records: DataFrame, **overrides) -> DataFrame:
        """Lazy: renames, filters (pushed to the scan), number parsing, then to_panel."""
        if unknown := set(overrides) - {f.name for f in fields(self)}:
            raise ValueError(f"unknown mapping override(s) {sorted(unknown)}")
        m = replace(self, **overrides)
        ids = [m.id_cols] if isinstance(m.id_cols, str) else list(m.id_cols)
        needed = [*ids, m.date_col, *([m.value_col] if m.value_col else []), *m.filters]
        after = [m.renames.get(c, c) for c in records.columns]
        if clash := sorted({c for c in needed if after.count(c) > 1}):
            raise DataContractError(f"several source columns become {clash}")
        if missing := [c for c in needed if c not in after]:
            raise DataContractError(f"mapping {m.name!r} needs column(s) {missing} after renames; records have {sorted(after)[:12]}")
        out = records.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(records.columns, after) if after.count(a) == 1])
        for c, allowed in m.filters.items():
            out = out.filter(F.col(c).isin(*(allowed if isinstance(allowed, (list, tuple, set)) else (allowed,))))
        if m.value_col and m.agg != "count" and dict(out.dtypes)[m.value_col] == "string":
            value, fine = money(F.col(m.value_col))
            said = F.concat(F.lit(f"mapping {m.name}: "), F.col(m.value_col), F.lit(" is not a number"))
            out = out.withColumn(m.value_col, F.when(fine, value).otherwise(F.raise_error(said)))
        if not ids:
            out, ids = out.withColumn("_series", F.lit(m.name)), ["_series"]
        return to_panel(out, ids, m.date_col, m.value_col, m.freq, m.agg, m.fill_value, m.span, m.sep, m.date_unit, m.date_format)


# ---- funnel and cohorts ------------------------------------------------------------------------------------------


def stage_panel(records: DataFrame, stage_col: str, date_col: str, freq: str = "MS", id_cols=None, sep: str = "/") -> DataFrame:
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols or [])
    return to_panel(records, [*ids, stage_col], date_col, None, freq, sep=sep)


def conversion_rates(panel: DataFrame, stages: list[str], sep: str = "/") -> DataFrame:
    """(unique_id, ds, from_stage, to_stage, rate) of consecutive stages that a prefix has; a missing count is 0, a rate over 0 is null."""
    if len(stages) < 2:
        raise ValueError("conversion needs two stages at least")
    stage, prefix = F.substring_index(ID, sep, -1), F.regexp_replace(ID, r"(?:^|" + re.escape(sep) + r")[^" + re.escape(sep) + r"]*$", "")
    for s in sorted(stages, key=len):  # the longest name that fits wins
        stage = F.when((F.col(ID) == s) | F.endswith(ID, F.lit(sep + s)), F.lit(s)).otherwise(stage)
        prefix = F.when(F.col(ID) == s, F.lit("")).when(F.endswith(ID, F.lit(sep + s)), F.expr(f"left(unique_id, "
            f"length(unique_id) - {len(s) + len(sep)})")).otherwise(prefix)
    rows = panel.select(prefix.alias("prefix"), stage.alias("stage"), TIME, TARGET).filter(F.col("stage").isin(*stages))
    wide = rows.groupBy("prefix", TIME).pivot("stage", stages).agg(F.sum(TARGET))
    w = Window.partitionBy("prefix")
    c = lambda x: F.col(f"`{x}`")
    wide = wide.select("*", *[(F.count(c(x)).over(w) > 0).alias(f"has {x}") for x in stages])
    zero = lambda x: F.coalesce(c(x), F.lit(0.0))
    pairs = F.array(*[F.struct(F.lit(x).alias("from_stage"), F.lit(y).alias("to_stage"), zero(x).alias("a"), zero(y).alias("b"), (c(f"has {x}") & c(f"has {y}")).alias("both"), (c(x).isNotNull() | c(y).isNotNull()).alias("any")) for x, y in zip(stages, stages[1:])])
    out = wide.select("prefix", TIME, F.explode(pairs).alias("p")).filter("p.both and p.any")
    name = F.concat(F.when(F.col("prefix") == "", F.lit("")).otherwise(F.concat("prefix", F.lit(sep))), F.col("p.from_stage"), F.lit("->"), F.col("p.to_stage"))
    return out.select(name.alias(ID), TIME, "p.from_stage", "p.to_stage", F.when(F.col("p.a") != 0, F.try_divide("p.b", "p.a")).alias("rate"))


def propagate(top: DataFrame, rates: dict[str, float]) -> DataFrame:
    """Adds a column per stage: yhat times the rates so far."""
    if not rates:
        raise ValueError("rates are empty")
    if bad := {k: r for k, r in rates.items() if not 0 <= r <= 1}:
        raise ValueError(f"conversion rates lie in [0, 1]: {bad}")
    product, out = F.col("yhat"), {}
    for stage, r in rates.items():
        product = product * r
        out[stage] = product
    return top.withColumns(out)


def cohort_panel(records: DataFrame, cohort_col: str, period_col: str, retained_col: str, n_customers_col: str | None = None) -> DataFrame:
    """ds = age, y = retained share (retained over the cohort's size where one is given)."""
    y = F.col(retained_col).cast("double")
    if n_customers_col:
        y = F.try_divide(y, F.col(n_customers_col).cast("double"))
    fine = (y >= -1e-9) & (y <= 1 + 1e-9)
    checked = F.when(F.coalesce(fine, F.lit(False)), F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0))).otherwise(F.raise_error(F.lit("retention must lie in [0, "
        "1]")))
    return records.select(F.col(cohort_col).cast("string").alias(ID), F.col(period_col).cast("bigint").alias(TIME), checked.alias(TARGET))


def pooled_curve(cohorts: DataFrame) -> DataFrame:
    """(age, survival): mean clipped period-over-period ratio at each position, cumulated; a position without one stays flat."""
    w = Window.partitionBy(ID).orderBy(TIME)
    before = F.lag(TARGET).over(w)
    r = cohorts.select((F.row_number().over(w) - 1).alias("age"), F.when(before > 1e-12, F.least(F.greatest(F.try_divide(F.col(TARGET), before), F.lit(0.0)), F.lit(1.0))).alias("r"))
    ratios = r.groupBy("age").agg(F.coalesce(F.avg("r"), F.lit(1.0)).alias("r"))
    # as many rows as the longest cohort has periods
    folded = ratios.agg(F.array_sort(F.collect_list(F.struct("age", "r"))).alias("rs"))
    path = F.aggregate("rs", F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(F.when(x["age"] == 0, 1.0).otherwise(F.element_at(a, -1) * x["r"]))))
    return folded.select(F.posexplode(path).alias("age", "survival"))


def seasonal_index(panel: DataFrame, m: int) -> DataFrame:
    """(unique_id, place, index, multiplicative): the mean of each place in a season of m rows over the series' mean, or its difference
    from it where values are not all positive."""
    place = (F.row_number().over(Window.partitionBy(ID).orderBy(TIME)) - 1) % m
    rows = panel.select(ID, place.cast("int").alias("place"), TARGET)
    means = rows.groupBy(ID, "place").agg(F.avg(TARGET).alias("by"))
    whole = rows.groupBy(ID).agg(F.avg(TARGET).alias("all"), ((F.min(TARGET) > 0) & (F.avg(TARGET) > 1e-12)).alias("multiplicative"))
    index = F.when(F.col("multiplicative"), F.try_divide("by", "all")).otherwise(F.col("by") - F.col("all"))
    return means.join(whole, ID).select(ID, "place", index.alias("index"), "multiplicative")


def centred_average(panel: DataFrame, m: int) -> DataFrame:
    """panel with y as the mean of the m rows around each (m odd; for even m the outermost two count half); null where they are not all there."""
    half = m // 2
    w = Window.partitionBy(ID).orderBy(TIME).rowsBetween(-half, half)
    total = F.sum(TARGET).over(w)
    if m % 2 == 0:
        at = Window.partitionBy(ID).orderBy(TIME)
        total = total - (F.lag(TARGET, half).over(at) + F.lead(TARGET, half).over(at)) / 2
    return panel.withColumn(TARGET, F.when(F.count(TARGET).over(w) == 2 * half + 1, total / m))
