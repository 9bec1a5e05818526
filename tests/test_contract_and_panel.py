import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import contract as C, dates
from tidemark.functions.errors import DataContractError
from tidemark.operators import panel as P
from tidemark.sources.synthetic import panel_of


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.mark.parametrize("bad, said", [([("a", 1, 1.0), ("a", 1, 2.0)], "repeated"), ([(None, 1, 1.0)], "null unique_id"), ([("a", None, 1.0)], "null ds"), ([("a", 1, math.inf)], "infinite"), ([("a", 1, math.nan)], "missing"), ([], "empty")])
def test_contract_violations(spark, bad, said):
    with pytest.raises(DataContractError, match=said):
        C.validate_panel(spark.createDataFrame(bad, "unique_id string, ds long, y double"))


def test_contract_missing_column_and_allowed_gap(spark):
    with pytest.raises(DataContractError, match="needs column"):
        C.validate_panel(spark.createDataFrame([("a", 1)], "unique_id string, ds long"))
    out = C.validate_panel(spark.createDataFrame([("a", 1, math.nan)], "unique_id string, ds long, y double"), allow_missing=True)
    assert rows(out) == [("a", 1, None)]


def test_levels_and_horizon():
    assert C.check_levels([95, 80.0, 80]) == [80, 95]
    for bad in (0, 100, 80.5):
        with pytest.raises(ValueError):
            C.check_levels([bad])
    for bad in (0, 10_001, 1.5, True):
        with pytest.raises(ValueError):
            C.check_horizon(bad)


def test_to_panel_sums_and_fills(spark):
    r = spark.createDataFrame([("east", "alice", "2024-01-05", 100.0), ("east", "alice", "2024-01-20", 200.0), ("east", "alice", "2024-03-01", 50.0), ("west", "bob", "2024-02-01", 7.0)], "team string, rep string, d string, amount double")
    out = P.to_panel(r, ["team", "rep"], "d", "amount")
    assert [x[2] for x in rows(out.filter("unique_id = 'east/alice'"), "ds")] == [300.0, 0.0, 50.0]
    wide = P.to_panel(r, ["team", "rep"], "d", "amount", span="panel")
    assert [x[2] for x in rows(wide.filter("unique_id = 'west/bob'"), "ds")] == [0.0, 7.0, 0.0]
    counts = P.to_panel(r, "team", "d", None, agg="count")
    assert [x[2] for x in rows(counts.filter("unique_id = 'east'"), "ds")] == [2.0, 0.0, 1.0]


def test_to_panel_refuses_null_keys_and_unitless_numbers(spark):
    r = spark.createDataFrame([("a", None)], "k string, d string")
    with pytest.raises(Exception, match="no date or id"):
        P.to_panel(r, "k", "d").collect()
    with pytest.raises(ValueError, match="date_unit"):
        P.to_panel(spark.createDataFrame([("a", 5)], "k string, d int"), "k", "d")


@pytest.mark.parametrize("freq, want", [("D", "2024-05-16"), ("W", "2024-05-19"), ("MS", "2024-05-01"), ("ME", "2024-05-31"), ("QS", "2024-04-01"), ("QE", "2024-06-30"), ("YS", "2024-01-01"), ("YE", "2024-12-31")])
def test_period_labels(spark, freq, want):
    got = spark.range(1).select(dates.bucket(F.lit(dt.datetime(2024, 5, 16, 13)).cast("timestamp_ntz"), freq)).first()[0]
    assert str(got.date()) == want


def test_future_follows_month_ends_and_days(spark):
    ends = panel_of(spark, [1.0, 2, 3, 4], [dt.datetime(2023, 11, 30), dt.datetime(2023, 12, 31), dt.datetime(2024, 1, 31), dt.datetime(2024, 2, 29)])
    assert [str(r.ds.date()) for r in dates.future(dates.with_step(ends), 3).orderBy("step").collect()] == ["2024-03-31", "2024-04-30", "2024-05-31"]
    numbers = panel_of(spark, [1.0, 2, 3])
    assert [r.ds for r in dates.future(dates.with_step(numbers), 2).orderBy("step").collect()] == [3, 4]


def test_money_text(spark):
    t = spark.createDataFrame([("$1,234.50",), ("(500)",), ("$(20)",), ("  ",), (None,), ("1.000,50",)], "t string")
    value, fine = P.money(F.col("t"))
    assert [tuple(r) for r in t.select(value, fine).collect()][:5] == [(1234.5, True), (-500.0, True), (-20.0, True), (None, True), (None, True)]
    assert t.filter(~fine).count() == 1


def test_cleaning_keeps_codes_and_dates(spark):
    t = spark.createDataFrame([("$1", "00190", "20240101", "x"), ("2.5", "190", "20240102", "y")], "a string, code string, d string, s string")
    assert dict(P.clean_numeric_text(t).dtypes) == {"a": "double", "code": "string", "d": "string", "s": "string"}


def test_mapping_recipe_filters_and_collisions(spark):
    from tidemark.sources.mappings import apply_mapping

    r = spark.createDataFrame([("2024-01-03", "$1,000", "Closed Won", "ann"), ("2024-01-09", "500", "Closed Won", "bob"), ("2024-01-10", "9", "Lost", "bob")], "CloseDate string, Amount string, StageName string, Owner string")
    assert rows(apply_mapping(r, "salesforce_opportunities"))[0][2] == 1500.0
    assert {x[0] for x in rows(apply_mapping(r, "salesforce_opportunities", id_cols="owner"))} == {"ann", "bob"}
    with pytest.raises(DataContractError, match="several source"):
        apply_mapping(r.withColumn("Close Date", F.col("CloseDate")), "salesforce_opportunities")
    with pytest.raises(ValueError, match="override"):
        apply_mapping(r, "salesforce_opportunities", nonsense=1)


def test_conversion_rates_and_missing_counts(spark):
    d = [dt.datetime(2024, m, 1) for m in (1, 2, 3)]
    p = spark.createDataFrame([("lead", d[0], 10.0), ("lead", d[1], 0.0), ("lead", d[2], 4.0), ("mql", d[0], 5.0), ("mql", d[2], 2.0)], "unique_id string, ds timestamp_ntz, y double")
    out = rows(P.conversion_rates(p, ["lead", "mql"]).select("ds", "rate"), "ds")
    assert [x[1] for x in out] == [0.5, None, 0.5]


def test_cohorts_and_pooled_curve(spark):
    c = spark.createDataFrame([("a", 0, 10, 10), ("a", 1, 8, 10), ("a", 2, 4, 10), ("b", 0, 4, 4), ("b", 1, 3, 4)], "c string, age int, r int, n int")
    p = P.cohort_panel(c, "c", "age", "r", "n")
    assert [x[2] for x in rows(p, "unique_id", "ds")] == [1.0, 0.8, 0.4, 1.0, 0.75]
    assert [round(x[1], 6) for x in rows(P.pooled_curve(p), "age")] == [1.0, 0.775, 0.3875]


def test_fiscal_calendars(spark):
    def parts(cal, *day):
        r = spark.range(1).select(*[c.alias(k) for k, c in cal.parts(F.lit(dt.date(*day))).items()]).first()
        return r.fiscal_year, r.fiscal_quarter

    assert parts(dates.FiscalCalendar(2), 2024, 1, 31) == (2024, 4)
    assert parts(dates.FiscalCalendar(2), 2024, 2, 1) == (2025, 1)
    assert parts(dates.FiscalCalendar(1, "445"), 2024, 1, 1) == (2024, 1)
    assert parts(dates.FiscalCalendar(1, "445"), 2023, 1, 1) == (2022, 4)
