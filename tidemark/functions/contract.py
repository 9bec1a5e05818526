"""The panel contract: (unique_id, ds, y) rows, unique on (unique_id, ds); null means missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import DataContractError

ID, TIME, TARGET = "unique_id", "ds", "y"
MAX_HORIZON = 10_000


def by_time():
    return Window.partitionBy(ID).orderBy(TIME)


def whole():
    return Window.partitionBy(ID)


def check_levels(level) -> list[int]:
    """Whole percentages strictly between 0 and 100, sorted."""
    out = []
    for x in [level] if isinstance(level, (int, float)) else list(level or []):
        if abs(x - round(x)) > 1e-9 or not 0 < x < 100:
            raise ValueError(f"a confidence level is a whole percentage between 0 and 100, not {x!r}")
        out.append(int(round(x)))
    return sorted(set(out))


def check_horizon(h) -> int:
    if isinstance(h, bool) or int(h) != h or not 1 <= h <= MAX_HORIZON:
        raise ValueError(f"a horizon is a whole number from 1 to {MAX_HORIZON}, not {h!r}")
    return int(h)


def shaped(df: DataFrame) -> DataFrame:
    """df with y as double (NaN becomes null) and ds as a timestamp without zone or a number; raises on a wrong schema."""
    missing = [c for c in (ID, TIME, TARGET) if c not in df.columns]
    if missing:
        raise DataContractError(f"a panel needs column(s) {missing}; it has {df.columns[:12]}")
    kinds = dict((f.name, f.dataType) for f in df.schema)
    if not isinstance(kinds[TARGET], (T.NumericType, T.BooleanType)):
        raise DataContractError(f"y must be numeric, not {kinds[TARGET].simpleString()}")
    y = F.col(TARGET).cast("double")
    ds = F.col(TIME)
    if isinstance(kinds[TIME], T.StringType):
        ds = F.coalesce(ds.try_cast("bigint").cast("string"), ds)
        raise_if_text = df.filter(F.col(TIME).isNotNull() & F.col(TIME).try_cast("timestamp_ntz").isNull()).limit(1)
        if raise_if_text.count():
            raise DataContractError("ds has text that is no date")
        ds = F.col(TIME).cast("timestamp_ntz")
    elif isinstance(kinds[TIME], (T.DateType, T.TimestampType)):
        ds = ds.cast("timestamp_ntz")
    elif isinstance(kinds[TIME], T.IntegralType):
        ds = ds.cast("bigint")
    return df.withColumns({TARGET: F.when(~F.isnan(y), y), TIME: ds})


def violations(df: DataFrame) -> DataFrame:
    """One row of counts: rows, null ids, null times, infinite and missing targets, repeated keys."""
    inf = F.col(TARGET).isin(float("inf"), float("-inf"))
    repeated = df.groupBy(ID, TIME).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("n_repeated"))
    counts = df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col(ID).isNull()).alias("n_null_id"),
        F.count_if(F.col(TIME).isNull()).alias("n_null_ds"),
        F.count_if(F.coalesce(inf, F.lit(False))).alias("n_infinite"),
        F.count_if(F.col(TARGET).isNull()).alias("n_missing"),
    )
    return counts.crossJoin(repeated)  # one row each


def validate_panel(df: DataFrame, allow_missing: bool = False) -> DataFrame:
    """The shaped panel, or DataContractError. One action, whatever the size."""
    out = shaped(df)
    r = violations(out).first()
    said = {
        "the panel is empty": r.n_rows == 0,
        f"{r.n_null_id} null unique_id": r.n_null_id,
        f"{r.n_null_ds} null ds": r.n_null_ds,
        f"{r.n_repeated} repeated (unique_id, ds)": r.n_repeated,
        f"{r.n_infinite} infinite y": r.n_infinite,
        f"{r.n_missing} missing y": r.n_missing and not allow_missing,
    }
    if bad := [k for k, v in said.items() if v]:
        raise DataContractError("; ".join(bad))
    return out


def positions(df: DataFrame) -> DataFrame:
    """With pos (from 0) and n (length) of each row in its series."""
    return df.withColumns({"pos": F.row_number().over(by_time()) - 1, "n": F.count("*").over(whole())})


def covariates(df: DataFrame) -> list[str]:
    return sorted(f.name for f in df.schema if f.name not in (ID, TIME, TARGET) and isinstance(f.dataType, T.NumericType))


def check_finite(df: DataFrame, columns: list[str], where: str) -> None:
    if columns:
        bad = [F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).alias(c) for c in columns]
        found = df.agg(*bad).first().asDict()
        if wrong := [c for c, n in found.items() if n]:
            raise DataContractError(f"covariates {wrong} have missing or infinite values in {where}")


def check_future(x: DataFrame, ids: DataFrame, h: int, columns: list[str]) -> None:
    """Known-future covariates must hold exactly h rows for each fitted series."""
    if missing := [c for c in (ID, TIME, *columns) if c not in x.columns]:
        raise DataContractError(f"future covariates lack {missing}")
    counts = x.groupBy(ID).agg(F.count("*").alias("n"))
    wrong = ids.select(ID).distinct().join(counts, ID, "left").filter(F.coalesce("n", F.lit(0)) != h).limit(3).collect()
    if wrong:
        raise DataContractError(f"future covariates need {h} rows a series; wrong for {[r[0] for r in wrong]}")
    check_finite(x, columns, "the future")


def check_sorted(df: DataFrame) -> None:
    """ds must rise strictly within each series."""
    if df.select((F.col(TIME) <= F.lag(TIME).over(by_time())).alias("bad")).filter("bad").limit(1).count():
        raise DataContractError("a forecast repeats a time step")


def too_short(df: DataFrame, least: int) -> list:
    return [r[0] for r in df.groupBy(ID).agg(F.count("*").alias("n")).filter(F.col("n") <= least).orderBy(ID).limit(5).collect()]


def single_currency(df: DataFrame, column: str = "currency") -> DataFrame:
    """df, unless it mixes currencies."""
    found = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().limit(3).collect()]
    if len(found) > 1:
        raise DataContractError(f"amounts mix currencies {sorted(found)}; convert them first")
    return df


def index_of(df: DataFrame) -> DataFrame:
    """The distinct (unique_id, ds) of a panel."""
    return df.select(ID, TIME).distinct()


def index_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(ID, TIME).union(b.select(ID, TIME)).distinct()


def index_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(ID, TIME).intersect(b.select(ID, TIME))


def index_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of a that b lacks."""
    return a.select(ID, TIME).subtract(b.select(ID, TIME))


def null_if_not_finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
