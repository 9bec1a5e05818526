"""Queries of the engine by name, each with the same query as DuckDB SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, metrics as M
from ..functions import contract as C
from ..functions.contract import ID, TARGET, TIME, positions, single_currency, violations
from ..functions.errors import DataContractError
from ..functions.numeric import normal_cdf_sql, z_of
from ..operators import currency, deals, finance, forecaster, meta, native_models as N, panel as P, snapshots, transforms as X
from ..sources import readers
from . import engine, fixtures as V, tools, workspace
from .fixtures import with_views as views

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalogue_edges  # noqa: F401  registers more

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def day(c: str = TIME) -> Column:
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def rnd(*cols: str, n: int = 4) -> list[Column]:
    return [F.when(F.round(c, n) == 0, 0.0).otherwise(F.round(c, n)).alias(c) for c in cols]  # no negative zero


def sday(c: str = "ds") -> str:
    return f"strftime({c}, '%Y-%m-%d') as {c}"


def srnd(*cols: str, n: int = 4) -> str:
    return ", ".join(f"{pos(c, n)} as {c}" for c in cols)


def pos(c: str, n: int) -> str:
    return f"case when round({c}, {n}) = 0 then 0 else round({c}, {n}) end"


PANEL = f"select unique_id, {sday()}, {srnd('y')} from "


def out(df: DataFrame, *more: str, n: int = 4) -> DataFrame:
    return df.select(ID, day(), *rnd(TARGET, *more, n=n))


# ---- shaping -----------------------------------------------------------------------------------------------------

_LABEL = {"D": "date_trunc('day', ts)", "W": "date_trunc('week', ts) + interval 6 days", "QE": "date_trunc('quarter', "
    "ts) + interval 3 months - interval 1 day", "MS": "date_trunc('month', ts)", "ME": "last_day(ts)"}


def _shape(name, freq, agg, value):
    how = {"sum": "sum(value)", "mean": "avg(value)", "count": "count(*)::double"}[agg]
    sql = f"with p as (select event_type as unique_id, ({_LABEL[freq]})::timestamp as ds, {how} as y from events group by all) {PANEL} p"

    @query(name, sql)
    def run(s, d):
        return out(P.to_panel(V.table(s, d, "events"), "event_type", "ts", "value" if value else None, freq, agg))


_shape("panel_daily_sum", "D", "sum", True)
_shape("panel_daily_count", "D", "count", False)
_shape("panel_monthly_mean", "MS", "mean", True)
_shape("panel_weekly_end", "W", "sum", True)
_shape("panel_quarter_end", "QE", "sum", True)
_shape("panel_month_end", "ME", "sum", True)


@query("panel_span_panel", views("hier_m") + PANEL + "hier_m")
def _(s, d):
    return out(V.hier_m(s, d))


_SPARSE = ("sparse", "select * from panel_d where day(ds) % 3 <> 1 or ds in (select min(ds) from panel_d union select max(ds) from panel_d)")
_DENSE = "select k.unique_id, k.ds, {} as y from (select unique_id, unnest(generate_series(min(ds), max(ds), interval 1 day)) as ds from sparse group by unique_id) k left join sparse s on s.unique_id = k.unique_id and s.ds = k.ds"


def _sparse(s, d):
    p = V.panel_d(s, d)
    ends = p.agg(F.min(TIME).alias("a"), F.max(TIME).alias("b"))
    return p.crossJoin(F.broadcast(ends)).filter((F.dayofmonth(TIME) % 3 != 1) | (F.col(TIME) == F.col("a")) | (F.col(TIME) == F.col("b"))).drop("a", "b")


@query("densify_zero", views("panel_d", _SPARSE, ("f", _DENSE.format("coalesce(s.y, 0)"))) + PANEL + "f")
def _(s, d):
    return out(P.fill_gaps(_sparse(s, d), "D"))


@query("densify_null", views("panel_d", _SPARSE, ("f", _DENSE.format("s.y"))) + PANEL + "f")
def _(s, d):
    return out(P.densify(_sparse(s, d), "D", None))


@query("dup_collapse", "select event_type as unique_id, strftime(date_trunc('day', ts), '%Y-%m-%d') as ds, round(avg(value), 4) as y from events "
    "group by all")
def _(s, d):
    e = V.table(s, d, "events").select(F.col("event_type").alias(ID), F.date_trunc("day", "ts").cast("timestamp_ntz").alias(TIME), F.col("value").alias(TARGET))
    return out(P.collapse(e, "mean"))


@query("contract_violations", """with p as (select nullif(event_type, 'click') as unique_id, date_trunc('hour', ts) as ds, case when event_id % 10 = 0 then null else value end as y from events)
select count(*) as n_rows, count_if(unique_id is null)::bigint as n_null_id, count_if(ds is null)::bigint as n_null_ds, 0::bigint as n_infinite, count_if(y is null)::bigint as n_missing,
(select sum(c - 1)::bigint from (select count(*) as c from p group by unique_id, ds)) as n_repeated from p""")
def _(s, d):
    p = V.table(s, d, "events").select(F.nullif("event_type", F.lit("click")).alias(ID), F.date_trunc("hour", "ts").alias(TIME), F.when(F.col("event_id") % 10 != 0, F.col("value")).alias(TARGET))
    return violations(p)


@query("mapping_filter_rename", f"with p as (select o_orderpriority as unique_id, date_trunc('month', o_orderdate)::timestamp as ds, "
    f"sum(o_totalprice) as y from orders where o_orderstatus = 'F' group by all), g as (select unique_id, unnest(generate_series(min(ds), max(ds), "
    f"interval 1 month)) as ds from p group by unique_id) select g.unique_id, {sday('g.ds').replace('as g.ds', 'as ds')}, round(coalesce(y, 0), "
    f"4) as y from g left join p using (unique_id, ds)")
def _(s, d):
    m = P.SchemaMapping("orders", "", "close_date", ("owner",), "amount", {"o_orderdate": "close_date", "o_totalprice": "amount", "o_orderstatus": "stage", "o_orderpriority": "owner"}, {"stage": ("F",)})
    return out(m.apply(V.table(s, d, "orders")))


_MONEY = "case o_orderkey % 4 when 0 then '$' || o_orderkey || '.50' when 1 then '(' || o_orderkey || ')' when 2 then '  ' else '' || o_orderkey end"


@query("money_text_clean", "select o_orderkey as opp_id, case o_orderkey % 4 when 0 then o_orderkey + 0.5::double when 1 then -o_orderkey::double "
    "when 2 then null else o_orderkey::double end as amount from orders")
def _(s, d):
    t = V.table(s, d, "orders").withColumn("t", F.expr(_MONEY))
    value, fine = P.money(F.col("t"))
    return t.select(F.col("o_orderkey").alias("opp_id"), F.when(fine, value).alias("amount"))


@query("numeric_text_columns", "select o_orderkey::double as a, strftime(o_orderdate, '%Y%m%d') as b, lpad(o_orderkey::varchar, 8, '0') as c, "
    "o_totalprice as e from orders")
def _(s, d):
    o = V.table(s, d, "orders")
    return P.clean_numeric_text(o.select(F.col("o_orderkey").cast("string").alias("a"), F.date_format("o_orderdate", "yyyyMMdd").alias("b"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("c"), F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("e")))


@query("epoch_dates", f"select event_type as unique_id, strftime(date_trunc('day', ts), '%Y-%m-%d') as ds, count(*)::double as y from events "
    f"group by all")
def _(s, d):
    e = V.table(s, d, "events").select("event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return out(P.to_panel(e, "event_type", "ms", None, "D", date_unit="ms"))


@query("yyyymmdd_dates", "select event_type as unique_id, strftime(date_trunc('day', ts), '%Y-%m-%d') as ds, count(*)::double as y from events "
    "group by all")
def _(s, d):
    e = V.table(s, d, "events").select("event_type", F.date_format("ts", "yyyyMMdd").cast("int").alias("d"))
    return out(P.to_panel(e, "event_type", "d", None, "D", date_format="%Y%m%d"))


# ---- currency, funnel, cohorts -----------------------------------------------------------------------------------

_RATES = {"AFRICA": 0.5, "AMERICA": 1.0, "ASIA": 0.9, "EUROPE": 1.1, "MIDDLE EAST": 0.7}


@query("currency_static", views("deals_ccy") + "select opp_id, currency, round(amount * (1.0::double + r_regionkey * 0.25::double), 4) as amount "
    "from deals_ccy join region on r_name = currency")
def _(s, d):
    names = [(r["r_name"], 1.0 + r["r_regionkey"] * 0.25) for r in V.table(s, d, "region").collect()]  # a fixed dimension of five rows
    return currency.convert(V.deals_ccy(s, d), dict(names), to="none").select("opp_id", "currency", *rnd("amount"))


@query("currency_asof", views("deals_ccy rates") + "select d.opp_id, d.currency, round(amount * rate, 4) as amount from deals_ccy d asof "
    "join rates r on d.currency = r.currency and d.close_date >= r.as_of")
def _(s, d):
    return currency.convert(V.deals_ccy(s, d), V.rates(s, d), to="none", date_col="close_date").select("opp_id", "currency", *rnd("amount"))


@query("single_currency_guard", views("deals_ccy") + "select count(distinct currency) as n_currencies, count(distinct currency) > 1 as mixed "
    "from deals_ccy")
def _(s, d):
    x = V.deals_ccy(s, d)
    try:
        single_currency(x)
        mixed = False
    except DataContractError:
        mixed = True
    return x.agg(F.count_distinct("currency").alias("n_currencies")).withColumn("mixed", F.lit(mixed))


_FUNNEL = ["view", "click", "signup"]


@query("stage_panel", f"select event_type as unique_id, strftime(date_trunc('day', ts), '%Y-%m-%d') as ds, count(*)::double as y from events "
    f"group by all")
def _(s, d):
    return out(P.stage_panel(V.table(s, d, "events"), "event_type", "ts", "D"))


@query("conversion_rates", """with c as (select user_id % 3 as g, event_type as stage, date_trunc('day', ts)::timestamp as ds, count(*)::double as y from events where event_type in ('view', 'click', 'signup') group by all),
k as (select g, ds, sum(case when stage = 'view' then y else 0 end) as v, sum(case when stage = 'click' then y else 0 end) as c, sum(case when stage = 'signup' then y else 0 end) as u from c group by all)
select g || '/view->click' as unique_id, strftime(ds, '%Y-%m-%d') as ds, 'view' as from_stage, 'click' as to_stage, round(c / nullif(v, 0), 6) as rate from k
union all select g || '/click->signup', strftime(ds, '%Y-%m-%d'), 'click', 'signup', round(u / nullif(c, 0), 6) from k""")
def _(s, d):
    e = V.table(s, d, "events").withColumn("g", F.col("user_id") % 3)
    p = P.stage_panel(e.filter(F.col("event_type").isin(*_FUNNEL)), "event_type", "ts", "D", "g")
    return P.conversion_rates(p, _FUNNEL).select(ID, day(), "from_stage", "to_stage", *rnd("rate", n=6))


@query("funnel_propagate", views("panel_d") + f"select unique_id, {sday()}, round(y * 0.5::double, 4) as mql, round(y * 0.5::double * 0.2::double, "
    f"4) as sql from panel_d")
def _(s, d):
    top = V.panel_d(s, d).withColumnRenamed(TARGET, "yhat")
    return P.propagate(top, {"mql": 0.5, "sql": 0.2}).select(ID, day(), *rnd("mql", "sql"))


@query("cohort_panel", views("cohort_rows") + "select cohort as unique_id, age as ds, round(retained / n, 6) as y from cohort_rows")
def _(s, d):
    return P.cohort_panel(V.cohort_rows(s, d), "cohort", "age", "retained", "n").select(ID, TIME, *rnd(TARGET, n=6))


@query("pooled_retention_curve", views("cohort_rows", ("c", "select cohort, age, retained / n as y, row_number() over w - 1 as pos, "
    "lag(retained / n) over w as b from cohort_rows window w as (partition by cohort order by age)"),
       ("r", "select pos, coalesce(avg(case when b > 1e-12 then least(greatest(y / b, 0), 1) end), 1) as r from c "
           "group by pos")) + "select pos::int as age, round(product(case when pos = 0 then 1 else r end) over (order by pos), 6) as survival from r")
def _(s, d):
    return P.pooled_curve(P.cohort_panel(V.cohort_rows(s, d), "cohort", "age", "retained", "n")).select("age", *rnd("survival", n=6))


# ---- transforms --------------------------------------------------------------------------------------------------

_HOLES = ("h", "select unique_id, ds, case when day(ds) % 4 = 2 then null else y end as y from panel_d")


def _holes(s, d):
    return V.panel_d(s, d).withColumn(TARGET, F.when(F.dayofmonth(TIME) % 4 != 2, F.col(TARGET)))


@query("impute_ffill", views("panel_d", _HOLES) + f"select unique_id, {sday()}, round(last_value(y ignore nulls) over (partition by unique_id "
    f"order by h.ds), 4) as y from h")
def _(s, d):
    h = _holes(s, d)
    return out(X.Imputer("ffill").fit_transform(h))


@query("impute_mean", views("panel_d", _HOLES) + f"select unique_id, {sday()}, round(coalesce(y, avg(y) over (partition by unique_id)), 4) as y "
    f"from h")
def _(s, d):
    return out(X.Imputer("mean").fit_transform(_holes(s, d)))


@query("impute_interpolate", views("panel_d", _HOLES, ("q", """select unique_id, ds, y, row_number() over w as p, last_value(y ignore nulls) over w as a, first_value(y ignore nulls) over (partition by unique_id order by ds rows between current row and unbounded following) as b,
    last_value(case when y is not null then n end ignore nulls) over w as pa, first_value(case when y is not null then n end ignore nulls) over (partition by unique_id order by ds rows between current row and unbounded following) as pb
    from (select *, row_number() over (partition by unique_id order by ds) as n from h) window w as (partition by unique_id order by ds rows between unbounded preceding and current row)""")) + f"select unique_id, "
        f"{sday()}, round(coalesce(y, a + (b - a) * (p - pa) / nullif(pb - pa, 0), a, b), 4) as y from q")
def _(s, d):
    return out(X.Imputer("interpolate").fit_transform(_holes(s, d)))


@query("scale", views("panel_d") + f"select unique_id, {sday()}, round((y - avg(y) over w) / greatest(stddev_pop(y) over w, 1e-12), 6) as y "
    f"from panel_d window w as (partition by unique_id)")
def _(s, d):
    return out(X.StandardScaler().fit_transform(V.panel_d(s, d)), n=6)


@query("scale_roundtrip", views("panel_d") + PANEL + "panel_d")
def _(s, d):
    t, p = X.StandardScaler(), V.panel_d(s, d)
    return out(t.inverse_transform(t.fit_transform(p)))


@query("log_transform", views("panel_d") + f"select unique_id, {sday()}, round(ln(y + case "
    f"when min(y) over w > 0 then 0 else 1 - min(y) over w end), 6) as y from panel_d window w as (partition by unique_id)")
def _(s, d):
    return out(X.LogTransform().fit_transform(V.panel_d(s, d)), n=6)


@query("logit_transform", views("panel_d", ("u", "select unique_id, ds, y / (max(y) over ()) as y from panel_d")) + f"select unique_id, {sday()}, "
    f"round(ln(least(greatest(y, 1e-6), 1 - 1e-6) / (1 - least(greatest(y, 1e-6), 1 - 1e-6))), 4) as y from u")
def _(s, d):
    p = V.panel_d(s, d)
    top = p.agg(F.max(TARGET).alias("m"))
    return out(X.LogitTransform().fit_transform(p.crossJoin(F.broadcast(top)).select(ID, TIME, (F.col(TARGET) / F.col("m")).alias(TARGET))))


@query("diff1", views("panel_d", ("x", "select unique_id, ds, y - lag(y) over (partition by unique_id order by ds) as y "
    "from panel_d")) + PANEL + "x where y is not null")
def _(s, d):
    return out(X.Differencer(1).fit_transform(V.panel_d(s, d)))


@query("diff2_roundtrip", views("panel_d", ("x", "select *, row_number() over (partition by unique_id order by ds) as n "
    "from panel_d")) + PANEL + "x where n > 2")
def _(s, d):
    t, p = X.Differencer(2), V.panel_d(s, d)
    return out(t.inverse_transform(t.fit_transform(p)))


@query("pipeline_roundtrip", views("panel_d", ("x", "select *, row_number() over (partition by unique_id order by ds) as n "
    "from panel_d")) + PANEL + "x where n > 1")
def _(s, d):
    t, p = X.Pipeline([("log", X.LogTransform()), ("scale", X.StandardScaler()), ("diff", X.Differencer(1))]), V.panel_d(s, d)
    return out(t.inverse_transform(t.fit_transform(p)))


# ---- calendar ----------------------------------------------------------------------------------------------------


@query("calendar_raw", views("panel_d") + f"select unique_id, {sday()}, (isodow(panel_d.ds) - 1)::int as dayofweek, "
    f"month(panel_d.ds)::int as month, dayofyear(panel_d.ds)::int as dayofyear, quarter(panel_d.ds)::int as quarter from panel_d")
def _(s, d):
    return dates.calendar_features(V.panel_d(s, d), ("dayofweek", "month", "dayofyear", "quarter"), False).select(ID, day(), "dayofweek", "month", "dayofyear", "quarter")


@query("calendar_cyclical", views("panel_d") + f"select unique_id, {sday()}, round(sin(2 * pi() * (isodow(panel_d.ds) - 1) / 7), "
    f"6) as dayofweek_sin, round(cos(2 * pi() * (isodow(panel_d.ds) - 1) / 7), 6) as dayofweek_cos, "
    f"round(sin(2 * pi() * (month(panel_d.ds) - 1) / 12), 6) as month_sin, round(cos(2 * pi() * (month(panel_d.ds) - 1) / 12), 6) as month_cos "
    f"from panel_d")
def _(s, d):
    return dates.calendar_features(V.panel_d(s, d), ("dayofweek", "month")).select(ID, day(), *rnd("dayofweek_sin", "dayofweek_cos", "month_sin", "month_cos", n=6))


@query("fourier", views("panel_d", ("x", "select *, row_number() over (partition by unique_id order by ds) - 1 as t "
    "from panel_d")) + f"select unique_id, {sday()}, {pos('sin(2 * pi() * t / 7)', 6)} as sin_1, round(cos(2 * pi() * t / 7), 6) as cos_1, "
    f"{pos('sin(4 * pi() * t / 7)', 6)} as sin_2, round(cos(4 * pi() * t / 7), 6) as cos_2 from x")
def _(s, d):
    return dates.fourier_features(V.panel_d(s, d), 7, 2).select(ID, day(), *rnd("sin_1", "cos_1", "sin_2", "cos_2", n=6))


@query("fiscal_calendar", """select distinct strftime(o_orderdate, '%Y-%m-%d') as d, (year(o_orderdate) + (month(o_orderdate) > 1)::int)::int as fiscal_year, (1 + ((month(o_orderdate) + 10) % 12) // 3)::int as fiscal_quarter,
printf('FY%02dQ%d', (year(o_orderdate) + (month(o_orderdate) > 1)::int) % 100, 1 + ((month(o_orderdate) + 10) % 12) // 3) as label from orders""")
def _(s, d):
    f = dates.FiscalCalendar(2)
    c = F.col("o_orderdate")
    p = f.parts(c)
    return V.table(s, d, "orders").select(F.date_format(c, "yyyy-MM-dd").alias("d"), p["fiscal_year"].alias("fiscal_year"), p["fiscal_quarter"].cast("int").alias("fiscal_quarter"), f.label(c).alias("label")).distinct()


@query("fiscal_445", """with d as (select distinct o_orderdate::date as d from orders),
a as (select d, (make_date(y, 1, 1) + ((8 - isodow(make_date(y, 1, 1))) % 7)::int)::date as a0, y from d, lateral (select unnest([year(d) - 1, year(d)]) as y)),
b as (select d, max(y) as fy, max(a0) as a0 from a where a0 <= d group by d)
select strftime(d, '%Y-%m-%d') as d, fy::int as fiscal_year, (least((d - a0) // 91, 3) + 1)::int as fiscal_quarter from b""")
def _(s, d):
    p = dates.FiscalCalendar(1, "445").parts(F.col("d"))
    o = V.table(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return o.select(F.date_format("d", "yyyy-MM-dd").alias("d"), p["fiscal_year"].alias("fiscal_year"), p["fiscal_quarter"].cast("int").alias("fiscal_quarter"))


# ---- baseline forecasts ------------------------------------------------------------------------------------------

H = 7
Z80 = z_of(80)
_POS = ("q", "select *, row_number() over w as p, lag(y) over w as b, lag(y, 7) over w as b7, first_value(y) over w as y0, count(*) "
    "over (partition by unique_id) as n, avg(y) over (partition by unique_id order by ds rows between 7 preceding and 1 preceding) as m7 "
    "from panel_d window w as (partition by unique_id order by ds)")
_BAND = f"round(yhat - {Z80!r} * sigma, 3) as lo_80, round(yhat + {Z80!r} * sigma, 3) as hi_80"


def _future(mean: str, sigma: str, residual: str, extra: str = "") -> str:
    return views("panel_d", _POS, ("s", f"select unique_id, max(ds) as last_ds, sqrt(sum(r * r) / (count(r) - 1)) as s, arg_max(y, ds) as last_y, "
        f"arg_min(y, ds) as first_y, count(*) as n, avg(case when p > n - 7 then y end) as m from (select *, {residual} as r from q) "
        f"group by unique_id"),
                 ("f", f"select s.unique_id, k::int as step, last_ds + to_days(k::int) as ds, {mean} as yhat, {sigma} as sigma from s, range(1, "
                     f"8) t(k) {extra}")) + f"select unique_id, step, {sday()}, round(yhat, 3) as yhat, {_BAND} from f"  # fmt: skip


def _banded(f: DataFrame) -> DataFrame:
    return M.with_bounds(f, [80]).select(ID, F.col("step").cast("int").alias("step"), day(), *rnd("yhat", "lo_80", "hi_80", n=3))


@query("naive_bands", _future("last_y", "s * sqrt(k)", "y - b"))
def _(s, d):
    return _banded(N.naive(V.panel_d(s, d), H))


@query("seasonal_naive_bands", _future("q.y", "s * sqrt((k - 1) // 7 + 1)", "y - b7", "join q on q.unique_id = s.unique_id "
    "and q.p = s.n - 7 + 1 + (k - 1) % 7"))
def _(s, d):
    return _banded(N.seasonal_naive(V.panel_d(s, d), H, 7))


@query("drift_bands", _future("last_y + k * (last_y - first_y) / (n - 1)", "s * sqrt(k * (1 + k / (n - 1)))", "case "
    "when p >= 3 then y - (b + (b - y0) / (p - 2)) end"))
def _(s, d):
    return _banded(N.drift(V.panel_d(s, d), H))


@query("window_average_bands", _future("m", "s", "y - m7"))
def _(s, d):
    return _banded(N.window_average(V.panel_d(s, d), H, 7))


@query("naive_fitted", views("panel_d") + f"select unique_id, {sday()}, round(y, 4) as y, round(lag(y) over (partition by unique_id "
    f"order by panel_d.ds), 4) as fitted from panel_d")
def _(s, d):
    return N.fitted(V.panel_d(s, d), "naive").select(ID, day(), *rnd(TARGET, "fitted"))


def _recursive(view: str, start: str, step: str, final: str) -> str:
    """A fold over each series' rows in order; x is the state, r the row."""
    return views(view, ("o", f"select unique_id, y, row_number() over (partition by unique_id order by ds) as p, count(*) "
        f"over (partition by unique_id) as n, lead(y) over (partition by unique_id order by ds) as y2, avg(case when y > 0 then y end) "
        f"over (partition by unique_id) as hit_mean, avg((y > 0)::int) over (partition by unique_id) as hit_share, avg(y * y) "
        f"over (partition by unique_id) as ms from {view}"),
                 ("x", f"select unique_id, p, n, {start} from o where p = 1 union all select r.unique_id, r.p, r.n, {step} from x "
                     f"join o r on r.unique_id = x.unique_id and r.p = x.p + 1"), recursive=True) + final  # fmt: skip


@query("ses_fixed", _recursive("panel_d", "y as level, 0::double as sse", "0.3::double * r.y + 0.7::double * x.level, "
    "x.sse + (r.y - x.level) * (r.y - x.level)", "select unique_id, k::int as step, round(level, 3) as yhat, "
    "round(sqrt(sse / (n - 2)) * sqrt(1 + (k - 1) * 0.09::double), 3) as sigma from x, range(1, 8) t(k) where p = n"))
def _(s, d):
    return N.ses(V.panel_d(s, d), H, 0.3).select(ID, F.col("step").cast("int").alias("step"), *rnd("yhat", "sigma", n=3))


@query("holt_fixed", _recursive("panel_d", "y as level, y2 - y as trend, 0::double as sse", "0.3::double * r.y + 0.7::double * (x.level + x.trend), "
    "0.1::double * (0.3::double * r.y + 0.7::double * (x.level + x.trend) - x.level) + 0.9::double * x.trend, "
    "x.sse + (r.y - x.level - x.trend) * (r.y - x.level - x.trend)",
       "select unique_id, k::int as step, round(level + k * trend, 3) as yhat, "
           "round(sqrt(sse / (n - 2)) * sqrt(1 + 0.09::double * (select coalesce(sum((1 + j * 0.1::double) * (1 + j * 0.1::double)), 0) "
           "from range(1, 8) u(j) where j < k)), 3) as sigma from x, range(1, 8) t(k) where p = n"))
def _(s, d):
    return N.holt(V.panel_d(s, d), H, 0.3, 0.1).select(ID, F.col("step").cast("int").alias("step"), *rnd("yhat", "sigma", n=3))


@query("croston", _recursive("panel_u", "case when y > 0 then y end as size, case when y > 0 then 1::double end as gap, case "
    "when y > 0 then 1 else 2 end::double as since",
       "case when r.y > 0 then case when x.size is null then r.y else 0.1::double * r.y + 0.9::double * x.size end else x.size end, case "
           "when r.y > 0 then case when x.size is null then x.since else 0.1::double * x.since + 0.9::double * x.gap end else x.gap end, case "
           "when r.y > 0 then 1 else x.since + 1 end::double",
       "select unique_id, round(coalesce(size / gap, 0), 6) as yhat from x where p = n"))
def _(s, d):
    return N.croston(V.panel_u(s, d), 1).select(ID, *rnd("yhat", n=6))


@query("tsb", _recursive("panel_u", "0.1::double * (y > 0)::int + 0.9::double * hit_share as pr, case "
    "when y > 0 then 0.1::double * y + 0.9::double * hit_mean else coalesce(hit_mean, 0) end as size",
       "0.1::double * (r.y > 0)::int + 0.9::double * x.pr, case "
           "when r.y > 0 then 0.1::double * r.y + 0.9::double * x.size else x.size end", "select unique_id, round(pr * size, 6) as yhat from x "
           "where p = n"))
def _(s, d):
    return N.tsb(V.panel_u(s, d), 1).select(ID, *rnd("yhat", n=6))


@query("croston_users", _SQL["croston"])
def _(s, d):
    return N.croston(V.panel_u(s, d), 1).select(ID, *rnd("yhat", n=6))


@query("tsb_users", _SQL["tsb"])
def _(s, d):
    return N.tsb(V.panel_u(s, d), 1).select(ID, *rnd("yhat", n=6))


@query("garch_path", _recursive("returns_d", "ms as v, y as last", "0.0001::double + 0.1::double * x.last * x.last + 0.8::double * x.v, "
    "r.y", "select unique_id, round(v, 10) as sigma2 from x where p = n"))
def _(s, d):
    return N.garch_path(V.returns_d(s, d), 1e-4, 0.1, 0.8).select(ID, *rnd("sigma2", n=10))


@query("sbg_survival", """with recursive a as (select n_name as unique_id, 1.0::double + n_nationkey * 0.1::double as a, 3.5::double as b from nation),
x as (select unique_id, a, b, 0 as t, 1.0::double as s, a / (a + b) as p from a union all select unique_id, a, b, t + 1, s - case when t + 1 = 1 then p else p * (b + t - 1) / (a + b + t) end, case when t + 1 = 1 then p else p * (b + t - 1) / (a + b + t) end from x where t < 12)
select unique_id, t::int as t, round(s, 8) as survival from x""")
def _(s, d):
    p = V.table(s, d, "nation").select(F.col("n_name").alias(ID), (1.0 + F.col("n_nationkey") * 0.1).alias("alpha"), F.lit(3.5).alias("beta"))
    return N.sbg_survival(p, 12).select(ID, "t", *rnd("survival", n=8))


# ---- evaluation --------------------------------------------------------------------------------------------------

_CV = ("c", """select v.unique_id, v.ds, v.w, t.y, t.p - v.n0 as step, v.cutoff, v.model, v.yhat, v.sigma from
(select q.unique_id, t.ds, w.w, q.n - 7 - (2 - w.w) * 7 as n0, max(case when q.p = q.n - 7 - (2 - w.w) * 7 then q.ds end) as cutoff, 'naive' as model, max(case when q.p = q.n - 7 - (2 - w.w) * 7 then q.y end) as yhat,
 sqrt(sum(case when q.p <= q.n - 7 - (2 - w.w) * 7 then (q.y - q.b) * (q.y - q.b) end) / (count(case when q.p <= q.n - 7 - (2 - w.w) * 7 then q.b end) - 1)) * sqrt(any_value(t.p) - (q.n - 7 - (2 - w.w) * 7)) as sigma
 from q, range(3) w(w), q t where t.unique_id = q.unique_id and t.p > q.n - 7 - (2 - w.w) * 7 and t.p <= q.n - (2 - w.w) * 7 group by q.unique_id, t.ds, w.w, q.n) v join q t on t.unique_id = v.unique_id and t.ds = v.ds""")  # fmt: skip
_CV2 = ("c2", f"""select unique_id, ds, cutoff, y, 'naive' as model, yhat, yhat - {Z80!r} * sigma as lo, yhat + {Z80!r} * sigma as hi from c
union all select c.unique_id, c.ds, c.cutoff, c.y, 'seasonal_naive', q.y, null, null from c join q on q.unique_id = c.unique_id and q.ds = c.ds - to_days(7)""")


def _cv(s, d, models=("naive", ("seasonal_naive", {"season_length": 7}))):
    return forecaster.cross_validation(V.panel_d(s, d), models, 7, 3, level=[80], validate=False)


@query("cv_splits", views("panel_d", _POS) + "select unique_id, w::int as \"window\", count(case "
    "when p <= n - 7 - (2 - w) * 7 then 1 end) as n_train, count(case when p > n - 7 - (2 - w) * 7 and p <= n - (2 - w) * 7 then 1 end) as n_test, "
    "strftime(max(case when p <= n - 7 - (2 - w) * 7 then ds end), '%Y-%m-%d') as cutoff from q, range(3) t(w) group by unique_id, w")
def _(s, d):
    c = forecaster.cv_splits(V.panel_d(s, d), 7, 3)
    return c.groupBy(ID, "window").agg(F.count_if(F.col("step") == 0).alias("n_train"), F.count_if(F.col("step") > 0).alias("n_test"), F.date_format(F.max("cutoff"), "yyyy-MM-dd").alias("cutoff"))


@query("cv_naive", views("panel_d", _POS, _CV) + f"select unique_id, {sday()}, strftime(c.cutoff, '%Y-%m-%d') as cutoff, step::int as step, "
    f"round(y, 3) as y, round(yhat, 3) as yhat, round(yhat - {Z80!r} * sigma, 3) as lo_80, round(yhat + {Z80!r} * sigma, 3) as hi_80 from c")
def _(s, d):
    return _cv(s, d, ["naive"]).select(ID, day(), day("cutoff"), "step", *rnd(TARGET, "yhat", "lo_80", "hi_80", n=3))


_POINT_SQL = {
    "mae": "avg(abs(y - yhat))", "rmse": "sqrt(avg((y - yhat) * (y - yhat)))", "mape": "avg(case when abs(y) > 1e-12 then abs((y - yhat) / y) end)",
    "smape": "avg(case "
        "when abs(y) + abs(yhat) > 2e-12 then abs(y - yhat) / ((abs(y) + abs(yhat)) / 2) else 0 end)", "bias": "avg(yhat - y)", "pct_bias": "sum(yhat - y) / sum(abs(y))", "tracking_signal": "sum(yhat - y) / avg(abs(yhat - y))",
}


def _melted(keys: str, cols: dict[str, str], source: str) -> str:
    return " union all ".join(f"select {keys}, model, '{k}' as metric, round({v}, 4) as value from {source} "
        f"group by {keys.replace(' as cutoff', '')}, model" for k, v in cols.items())


def _scores(df):
    return df.select(*[c for c in df.columns if c not in ("value", "cutoff")], *([day("cutoff")] if "cutoff" in df.columns else []), *rnd("value"))


@query("metrics_point", views("panel_d", _POS, _CV, _CV2) + _melted("unique_id", _POINT_SQL, "c2"))
def _(s, d):
    return _scores(M.evaluate(_cv(s, d), list(_POINT_SQL)))


_SCALED = {"mase": "avg(abs(y - yhat)) / any_value(a)", "rmsse": "sqrt(avg((y - yhat) * (y - yhat)) / any_value(b))"}
_SCALE = ("sc", "select c2.*, a, b from c2 join (select unique_id, avg(abs(y - b7)) as a, avg((y - b7) * (y - b7)) as b from q "
    "group by unique_id) using (unique_id)")


@query("metrics_scaled", views("panel_d", _POS, _CV, _CV2, _SCALE) + _melted("unique_id", _SCALED, "sc"))
def _(s, d):
    return _scores(M.evaluate(_cv(s, d), ["mase", "rmsse"], V.panel_d(s, d), 7))


_A = "(2 / 0.2::double)"
_W = f"((hi - lo) + case when y < lo then {_A} * (lo - y) when y > hi then {_A} * (y - hi) else 0 end)"
_INTERVAL = {
    "coverage-80": "avg((y between lo and hi)::int)", "winkler-80": f"avg({_W})", "pinball-80": "(avg(greatest(0.1::double * (y - lo), "
        "-0.9::double * (y - lo))) + avg(greatest(0.9::double * (y - hi), -0.1::double * (y - hi)))) / 2",
}


@query("metrics_interval", views("panel_d", _POS, _CV, _CV2) + _melted("unique_id", _INTERVAL, "(select * from c2 where model = 'naive')"))
def _(s, d):
    return _scores(M.evaluate(_cv(s, d, ["naive"]), list(_INTERVAL)))


@query("metrics_wis", views("panel_d", _POS, _CV, _CV2) + _melted("unique_id", {"wis": f"avg((0.5::double * abs(y - yhat) + 0.1::double * {_W}) / 1.5::double)"}, "(select * "
    "from c2 where model = 'naive')"))
def _(s, d):
    return _scores(M.evaluate(_cv(s, d, ["naive"]), ["wis"]))


@query("metrics_by_cutoff", views("panel_d", _POS, _CV, _CV2, ("k", "select * replace (strftime(cutoff, '%Y-%m-%d') as cutoff) "
    "from c2")) + _melted("unique_id, cutoff", {k: _POINT_SQL[k] for k in ("mae", "bias")}, "k"))
def _(s, d):
    return _scores(M.evaluate(_cv(s, d), ["mae", "bias"], by="cutoff"))


@query("leaderboard", views("panel_d", _POS, _CV, _CV2) + f"select model, round(avg(mae), 4) as mae, round(avg(rmse), 4) as rmse, round(avg(smape), "
    f"4) as smape from (select unique_id, model, {_POINT_SQL['mae']} as mae, {_POINT_SQL['rmse']} as rmse, {_POINT_SQL['smape']} as smape from c2 "
    f"group by all) group by model")
def _(s, d):
    e = engine.Engine(["naive", ("seasonal_naive", {"season_length": 7})])
    return e.compare(V.panel_d(s, d), 7, 3)[0].select("model", *rnd("mae", "rmse", "smape"))


@query("seasonal_naive_scored", views("panel_d", _POS, ("f", "select t.unique_id, t.y, h.y as yhat, t.n from q t "
    "join q h on h.unique_id = t.unique_id and h.p = t.p - 7 where t.p > t.n - 7"),
       ("s", "select unique_id, sqrt(sum((y - b7) * (y - b7)) / (count(b7) - 1)) as s, avg(abs(y - b7)) as sc from q where p <= n - 7 "
           "group by unique_id")) +
       f"select unique_id, count(*) as n, round({_POINT_SQL['mae']}, 4) as mae, round({_POINT_SQL['smape']}, 6) as smape, "
           f"round({_POINT_SQL['mae']} / any_value(sc), 6) as mase, round(avg((abs(y - yhat) <= {Z80!r} * s)::int), 6) as coverage from f "
           f"join s using (unique_id) group by unique_id")
def _(s, d):
    p = positions(V.panel_d(s, d))
    train, held = p.filter("pos < n - 7").drop("pos", "n"), p.filter("pos >= n - 7")
    f = M.with_bounds(N.seasonal_naive(train, H, 7), [80])
    j = held.select(ID, TARGET, (F.col("pos") - F.col("n") + 8).cast("int").alias("step")).join(f.drop(TIME), [ID, "step"]).join(M.naive_scale(train, 7), ID)
    y, q = F.col(TARGET), F.col("yhat")
    scored = j.groupBy(ID).agg(F.count("*").alias("n"), M.mae(y, q).alias("mae"), M.smape(y, q).alias("smape"), (M.mae(y, q) / F.first("scale_abs")).alias("mase"), M.coverage(y, F.col("lo_80"), F.col("hi_80")).alias("coverage"))
    return scored.select(ID, "n", *rnd("mae"), *rnd("smape", "mase", "coverage", n=6))


# ---- combinations ------------------------------------------------------------------------------------------------

_THREE = "with a as (" + _SQL["naive_bands"] + "), b as (" + _SQL["drift_bands"] + "), c as (" + _SQL["window_average_bands"] + "), u as (select 0.5::double as w, * from a union all select 0.3, * from b union all select 0.2, * from c)"


def _three(s, d):
    p, parts = V.panel_d(s, d), []
    for name, f in (("naive", N.naive(p, H)), ("drift", N.drift(p, H)), ("window_average", N.window_average(p, H, 7))):
        x = M.with_bounds(f, [80])
        parts.append(x.select(ID, "step", TIME, *rnd("yhat", "lo_80", "hi_80", n=3), F.lit(name).alias("model")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


for _mode, _f in (("mean", "avg"), ("median", "median")):

    @query(f"ensemble_{_mode}", _THREE + f" select unique_id, step, ds, round({_f}(yhat), 2) as yhat, round({_f}(lo_80), 2) as lo_80, "
        f"round({_f}(hi_80), 2) as hi_80 from u group by all")
    def _(s, d, mode=_mode):
        return meta.ensemble(_three(s, d), mode, levels=[80]).select(ID, F.col("step").cast("int").alias("step"), day(), *rnd("yhat", "lo_80", "hi_80", n=2))


@query("ensemble_weighted", _THREE + " select unique_id, step, ds, round(sum(w * yhat), 2) as yhat, "
    "round(sum(w * yhat) - sum(w * (hi_80 - lo_80) / 2), 2) as lo_80, round(sum(w * yhat) + sum(w * (hi_80 - lo_80) / 2), 2) as hi_80 from u "
    "group by all")
def _(s, d):
    return meta.ensemble(_three(s, d), "weighted", {"naive": 5, "drift": 3, "window_average": 2}, [80]).select(ID, F.col("step").cast("int").alias("step"), day(), *rnd("yhat", "lo_80", "hi_80", n=2))


@query("conformal_bands", views("panel_d", _POS, ("r", "select unique_id, abs(y - first_value(y) over (partition by unique_id order by p)) as r, p "
    "from q where p >= n - 8"), ("k", "select unique_id, list_sort(list(r)) as s from (select q.unique_id, abs(q.y - h.y) as r from q "
    "join q h on h.unique_id = q.unique_id and h.p = q.n - 8 where q.p > q.n - 8) group by all")) +
       "select unique_id, round(s[1 + ceil(round(least(1, 9 * 0.8::double / 8) * 7, 9))::int], 3) as half from k")
def _(s, d):
    f = meta.conformal(V.panel_d(s, d), "naive", 1, [80], 0.25, 8)
    return f.select(ID, F.round((F.col("hi_80") - F.col("lo_80")) / 2, 3).alias("half"))


@query("auto_select_baselines", views("panel_d", _POS, _CV, _CV2) + f"select unique_id, case when max(case "
    f"when model = 'naive' then m end) <= max(case when model = 'seasonal_naive' then m end) then 'naive' else 'seasonal_naive' end as model, "
    f"round(min(m), 3) as score from (select unique_id, model, {_POINT_SQL['mae']} as m from c2 group by all) group by unique_id")
def _(s, d):
    pool = ["naive", ("seasonal_naive", {"season_length": 7})]
    return meta.auto_select(V.panel_d(s, d), pool, 7, metric="mae", val_h=7, n_windows=3)[1].select(ID, "model", *rnd("score", n=3))


_TREE = ("tree", "select unique_id as leaf, unnest(['total', split_part(unique_id, '/', 1), unique_id]) as node from (select distinct unique_id "
    "from hier_m)")


@query("aggregate_panel", views("hier_m", _TREE) + f"select node as unique_id, {sday()}, round(sum(y), 2) as y from hier_m "
    f"join tree on leaf = unique_id group by node, hier_m.ds")
def _(s, d):
    return out(meta.aggregate_panel(V.hier_m(s, d)), n=2)


_LEAF = ("lf", "select unique_id, arg_max(y, ds) as yhat from hier_m group by all")


@query("reconcile_bottom_up", views("hier_m", _TREE, _LEAF) + "select node as unique_id, round(sum(yhat), 2) as yhat from lf "
    "join tree on leaf = unique_id group by node")
def _(s, d):
    h = V.hier_m(s, d)
    return meta.reconcile(N.naive(h, 1).select(ID, "step", "yhat"), h, "bottom_up").select(ID, *rnd("yhat", n=2))


@query("reconcile_top_down", views("hier_m", _TREE, _LEAF, ("tp", "select sum(y) as top from hier_m group by ds "
    "order by ds desc limit 1 offset 1"), ("x", "select unique_id, yhat / (select sum(yhat) from lf) * (select top from tp) as yhat "
    "from lf")) + "select node as unique_id, round(sum(yhat), 2) as yhat from x join tree on leaf = unique_id group by node")
def _(s, d):
    h = V.hier_m(s, d)
    before = h.filter(F.col(TIME) < h.agg(F.max(TIME)).first()[0])
    leaves = N.naive(h, 1).select(ID, "step", "yhat")
    top = N.naive(meta.aggregate_panel(before).filter(F.col(ID) == "total"), 1).select(ID, "step", "yhat")
    return meta.reconcile(leaves.unionByName(top), h, "top_down").select(ID, *rnd("yhat", n=2))


_MINT = (
    ("agg", "select node as unique_id, ds, sum(y) as y from hier_m join tree on leaf = unique_id group by all"),
    ("st", "select unique_id, arg_min(y, ds) as f, arg_max(y, ds) as l, count(*) as n from agg group by all"),
    ("b", "select unique_id, k::int as step, l + k * (l - f) / (n - 1) as yhat from st, range(1, 3) t(k)"),
    ("lv", "select unique_id, split_part(unique_id, '/', 1) as r, step, yhat from b where contains(unique_id, '/')"),
    ("rg", "select r, step, sum(yhat) as sm, count(*)::double as k from lv group by all"),
    ("rm", "select rg.r, rg.step, sm, k, (b.yhat + sm / k) / (1 + 1 / k) as m, 1 + 1 / k as a from rg join b on b.unique_id = rg.r "
        "and b.step = rg.step"),
    ("tt", "select step, sum(m) as sm, sum(1 / a) as sl from rm group by all"),
    ("top", "select tt.step, sm, sl, (b.yhat + sm / sl) / (1 + 1 / sl) as x from tt join b on b.unique_id = 'total' and b.step = tt.step"),
    ("rx", "select r, rm.step, rm.sm, k, m + (x - top.sm) / sl / a as x from rm join top on top.step = rm.step"),
    ("lx", "select lv.unique_id, lv.step, lv.yhat + (x - sm) / k as x from lv join rx on rx.r = lv.r and rx.step = lv.step"),
)


@query("reconcile_mint_ols", views("hier_m", _TREE, *_MINT) + "select unique_id, step, round(x, 2) as yhat from lx union all select r, step, "
    "round(x, 2) from rx union all select 'total', step, round(x, 2) from top")
def _(s, d):
    return meta.reconciled(V.hier_m(s, d), "drift", 2, "mint_ols").select(ID, F.col("step").cast("int").alias("step"), *rnd("yhat", n=2))


# ---- deals -------------------------------------------------------------------------------------------------------


@query("anomaly_zscore", views("panel_d", ("a", "select *, avg(y) over w as e, stddev_pop(y) over w as sd, count(*) over w as n from panel_d "
    "window w as (partition by unique_id order by ds rows between 6 preceding and 1 preceding)")) + f"select unique_id, {sday()}, round(case "
    f"when n = 6 then e end, 3) as expected, round(case when n = 6 then (y - e) / sd end, 3) as score, coalesce(n = 6 and abs((y - e) / sd) >= 2, "
    f"false) as is_anomaly from a")
def _(s, d):
    return deals.detect_anomalies(V.panel_d(s, d), threshold=2.0).select(ID, day(), *rnd("expected", "score", n=3), "is_anomaly")


@query("anomaly_iqr", views("panel_d", ("a", "select *, quantile_cont(y, 0.5) over w as e, (quantile_cont(y, 0.75) over w - quantile_cont(y, "
    "0.25) over w) / 1.349::double as sd, count(*) over w as n from panel_d window w as (partition by unique_id "
    "order by ds rows between 6 preceding and 1 preceding)")) + f"select unique_id, {sday()}, round(case when n = 6 then e end, 3) as expected, "
    f"round(case when n = 6 then (y - e) / sd end, 3) as score, coalesce(n = 6 and abs((y - e) / sd) >= 2, false) as is_anomaly from a")
def _(s, d):
    return deals.detect_anomalies(V.panel_d(s, d), method="iqr", threshold=2.0).select(ID, day(), *rnd("expected", "score", n=3), "is_anomaly")


_P = "(0.1::double + 0.08::double * (opp_id % 10))"
_WP = f"count(*) as n_deals, round(sum(amount), 2) as total, round(sum({_P} * amount), 2) as expected, round(sqrt(sum({_P} * (1 - {_P}) * amount * amount)), 2) as std"


def _with_p(s, d):
    return V.deals(s, d).withColumn("proba", 0.1 + 0.08 * (F.col("opp_id") % 10))


@query("weighted_pipeline", views("deals") + f"select {_WP}, "
    f"round(greatest(sum({_P} * amount) - {Z80!r} * sqrt(sum({_P} * (1 - {_P}) * amount * amount)), 0), 2) as lo_80, "
    f"round(least(sum({_P} * amount) + {Z80!r} * sqrt(sum({_P} * (1 - {_P}) * amount * amount)), sum(amount)), 2) as hi_80 from deals")
def _(s, d):
    return deals.weighted_pipeline(_with_p(s, d), level=80).select("n_deals", *rnd("total", "expected", "std", "lo_80", "hi_80", n=2))


@query("weighted_pipeline_by", views("deals") + f"select segment, {_WP} from deals group by segment")
def _(s, d):
    return deals.weighted_pipeline(_with_p(s, d), by="segment").select("segment", "n_deals", *rnd("total", "expected", "std", n=2))


_STAGES = ["prospect", "proposal", "review"]
_COLS = {"close_col": "close_date", "won_stage": "won", "lost_stage": "lost"}
_CLASS = ("k", """select case when a.opp_id is null then 'removed' when a.stage = 'won' then 'won' when a.stage = 'lost' then 'lost' when b.opp_id is null or b.stage in ('won', 'lost') then 'created'
    when a.amount > b.amount then 'expanded' when a.amount < b.amount then 'contracted' when list_position(st, a.stage) > list_position(st, b.stage) then 'advanced' when list_position(st, a.stage) < list_position(st, b.stage) then 'regressed'
    when a.close_date > b.close_date then 'pushed' when a.close_date < b.close_date then 'pulled_in' else 'unchanged' end as category,
    case when a.opp_id is null or a.stage in ('won', 'lost') then -case when b.opp_id is not null and b.stage not in ('won', 'lost') then b.amount else 0 end when b.opp_id is null or b.stage in ('won', 'lost') then a.amount else a.amount - b.amount end as amount
    from deals_before b full join deals_after a using (opp_id), (select ['prospect', 'proposal', 'review'] as st)""")  # fmt: skip


@query("waterfall", views("deals_before deals_after", _CLASS) + "select category, count(*) as n_deals, round(sum(amount), 4) as amount from k "
    "group by category")
def _(s, d):
    return deals.waterfall(V.deals_before(s, d), V.deals_after(s, d), _STAGES, **_COLS).select("category", "n_deals", *rnd("amount", n=4))


_ORDER = "list_position(['opening_pipeline', '" + "', '".join(deals.CATEGORIES) + "', 'closing_pipeline'], category)"


@query("waterfall_summary", views("deals_before deals_after", _CLASS, ("r", "select 'opening_pipeline' as category, count(*) as n_deals, "
    "sum(amount) as amount from deals_before where stage <> 'won' union all select category, count(*), sum(amount) from k group by category "
    "union all select 'closing_pipeline', count(*), sum(amount) from deals_after where stage not in ('won', 'lost')")) +
       f"select category, n_deals, round(amount, 4) as amount, round(case when category = 'closing_pipeline' then amount else sum(amount) "
           f"over (order by {_ORDER}) end, 4) as running_total from r")
def _(s, d):
    return deals.waterfall_summary(V.deals_before(s, d), V.deals_after(s, d), _STAGES, **_COLS).select("category", "n_deals", *rnd("amount", "running_total", n=4))


@query("scenario_compare", """with s as (select n_name as label, 1000.0::double * (0.2::double + n_nationkey * 0.01::double) * 0.5::double * 25000 as p from nation)
select label, round(p, 4) as projection, round(p - b, 4) as delta, round((p - b) / b, 6) as pct_delta from s, (select p as b from s where label = (select n_name from nation where n_nationkey = 0))""")
def _(s, d):
    n = V.table(s, d, "nation")
    rows = n.select(F.col("n_name").alias("label"), F.create_map(F.lit("top_of_funnel"), F.lit(1000.0), F.lit("win_rate"), 0.2 + F.col("n_nationkey") * 0.01, F.lit("mql_rate"), F.lit(0.5), F.lit("acv"), F.lit(25000.0)).alias("drivers"))
    base = n.filter("n_nationkey = 0").first()["n_name"]
    return deals.compare_scenarios(rows, base).select("label", *rnd("projection", "delta"), *rnd("pct_delta", n=6))


@query("pipeline_coverage", views("deals") + "select segment as unique_id, round(sum(amount) / (100000.0::double * (1 + length(segment))), "
    "6) as coverage from deals where stage <> 'closed' group by segment")
def _(s, d):
    x = V.deals(s, d)
    v = x.filter("stage <> 'closed'").groupBy(F.col("segment").alias(ID)).agg(F.sum("amount").alias("value"))
    q = x.select(F.col("segment").alias(ID)).distinct().withColumn("quota", 100000.0 * (1 + F.length(ID)))
    return deals.pipeline_coverage(v, q).filter("coverage is not null").select(ID, *rnd("coverage", n=6))


_QUOTA = "with f as (" + _SQL["naive_bands"] + f"), g as (select unique_id, sum(yhat) as e, sqrt(sum(((hi_80 - lo_80) / (2 * {Z80!r})) * ((hi_80 - lo_80) / (2 * {Z80!r})))) as sg from f group by all)"


@query("quota_attainment", _QUOTA + f" select unique_id, round(e, 2) as expected, round(sg, 2) as sigma, "
    f"round({normal_cdf_sql('((e - 3000.0::double) / sg)')}, 4) as probability from g")
def _(s, d):
    f = _banded(N.naive(V.panel_d(s, d), H))
    return deals.attainment(f, 3000.0, 80).select(ID, *rnd("expected", "sigma", n=2), *rnd("probability"))


# ---- snapshots ---------------------------------------------------------------------------------------------------


@query("forecast_vs_actual", views("fc_history") + "select strftime(as_of, '%Y-%m-%d') as as_of, unique_id, strftime(h.ds, '%Y-%m-%d') as ds, "
    "round(yhat - y, 2) as error, round(abs(yhat - y), 2) as abs_error, round((yhat - y) / y, 4) as pct_error from fc_history h "
    "join panel_m using (unique_id, ds)")
def _(s, d):
    f = snapshots.forecast_vs_actual(V.fc_history(s, d), V.panel_m(s, d))
    return f.select(day("as_of"), ID, day(), *rnd("error", "abs_error", n=2), *rnd("pct_error"))


@query("accuracy_over_time", views("fc_history") + "select strftime(as_of, '%Y-%m-%d') as as_of, count(*) as n, round(avg(abs(yhat - y)), "
    "2) as mae, round(avg(yhat - y), 2) as bias, round(sum(yhat - y) / sum(abs(y)), 6) as pct_bias from fc_history join panel_m using (unique_id, "
    "ds) group by 1")
def _(s, d):
    f = snapshots.accuracy_over_time(snapshots.forecast_vs_actual(V.fc_history(s, d), V.panel_m(s, d)))
    return f.select(day("as_of"), "n", *rnd("mae", "bias", n=2), *rnd("pct_bias", n=6))


@query("snapshot_evolution", views("fc_history") + f"select strftime(as_of, '%Y-%m-%d') as as_of, unique_id, {sday()}, round(yhat, 2) as yhat "
    f"from fc_history where ds = timestamp '2000-04-01'")
def _(s, d):
    return snapshots.evolution(V.fc_history(s, d), "2000-04-01 00:00:00", "yhat").select(day("as_of"), ID, day(), *rnd("yhat", n=2))


@query("history_latest_only", views("fc_history") + "select strftime(as_of, '%Y-%m-%d') as as_of, (case "
    "when month(as_of) < 6 then 1 else 0 end)::int as revision, count(*) as n from fc_history group by all")
def _(s, d):
    h = V.fc_history(s, d)
    both = h.withColumn("revision", F.lit(0)).unionByName(h.filter(F.month("as_of") < 6).withColumn("revision", F.lit(1)))
    return snapshots.latest_only(both).groupBy(day("as_of"), "revision").agg(F.count("*").alias("n"))


# ---- finance -----------------------------------------------------------------------------------------------------

_RISK = """round(product(1 + y) - 1, 6) as total_return, round(stddev_samp(y) * sqrt(252), 4) as annualized_vol, round(avg(y) / stddev_samp(y) * sqrt(252), 4) as sharpe,
round(avg(y) / sqrt(avg(least(y, 0) * least(y, 0))) * sqrt(252), 4) as sortino, round(avg((y > 0)::int), 6) as hit_rate, round(greatest(-quantile_cont(y, 0.05), 0), 6) as var"""


@query("risk_metrics", views("returns_d") + f"select unique_id, {_RISK} from returns_d group by unique_id")
def _(s, d):
    r = finance.risk_metrics(V.returns_d(s, d))
    return r.select(ID, *rnd("total_return", n=6), *rnd("annualized_vol", "sharpe", "sortino"), *rnd("hit_rate", "var", n=6))


_EQ = ("e", "select *, product(1 + y) over (partition by unique_id order by ds rows between unbounded preceding and current row) as equity "
    "from returns_d")


@query("drawdown", views("returns_d", _EQ, ("p", "select *, greatest(max(equity) over (partition by unique_id "
    "order by ds rows between unbounded preceding and current row), 1) as peak from e")) + f"select unique_id, {sday()}, round(equity, "
    f"6) as equity, round(equity / peak - 1, 6) as drawdown from p")
def _(s, d):
    return finance.equity(V.returns_d(s, d)).select(ID, day(), *rnd("equity", "drawdown", n=6))


@query("var_cvar", views("returns_d", ("q5", "select unique_id, quantile_cont(y, 0.05) as q, max(abs(y)) as m from returns_d "
    "group by all")) + "select unique_id, round(greatest(-any_value(q), 0), 6) as var, round(greatest(-avg(y), 0), 6) as cvar from returns_d "
    "join q5 using (unique_id) where y <= q + 1e-12 * m group by unique_id")
def _(s, d):
    return finance.risk_metrics(V.returns_d(s, d)).select(ID, *rnd("var", "cvar", n=6))


_SIG = ("sg", "select unique_id, ds, y, lag(y) over (partition by unique_id order by ds) as yhat, 0.3::double as sigma from returns_d")


def _strategy_sql(position: str) -> str:
    return views("returns_d", _SIG, ("ps", f"select *, {position} as pos from sg where yhat is not null"), ("tr", "select *, "
        "abs(pos - coalesce(lag(pos) over (partition by unique_id order by ds), 0)) as moved from ps"), ("sr", "select *, "
        "pos * y - 0.0001::double * moved as r "
        "from tr")) + f"select unique_id, {sday()}, {pos('pos', 6)} as position, {pos('r', 6)} as strategy_return, round(product(1 + r) over (partition by unique_id order by sr.ds rows between unbounded preceding and current row), 6) as equity from sr"


def _strategy(s, d, **sizing):
    r = V.returns_d(s, d)
    from ..functions.contract import by_time

    sig = r.select(ID, TIME, TARGET, F.lag(TARGET).over(by_time()).alias("yhat"), F.lit(0.3).alias("sigma")).filter("yhat is not null")
    return finance.strategy(sig, 1.0, **sizing).select(ID, day(), *rnd("position", "strategy_return", "equity", n=6))


@query("strategy_binary", _strategy_sql("(yhat > 0)::int::double"))
def _(s, d):
    return _strategy(s, d)


@query("strategy_kelly", _strategy_sql("least(greatest(0.5::double * yhat / 0.09::double, 0), 1)"))
def _(s, d):
    return _strategy(s, d, sizing="kelly")


@query("strategy_proportional", _strategy_sql(f"least(greatest(2 * ({normal_cdf_sql('(yhat / 0.3::double)')} - 0.5), 0), 1)"))
def _(s, d):
    return _strategy(s, d, sizing="proportional")


_BT = (
    ("sg", "select *, avg(y) over (partition by unique_id order by ds rows between 7 preceding and 1 preceding) as yhat, row_number() "
        "over (partition by unique_id order by ds desc) as back from returns_d"),
    ("ps", "select *, (yhat > 0)::int as pos from sg where back <= 10"),
    ("tr", "select *, abs(pos - coalesce(lag(pos) over (partition by unique_id order by ds), 0)) as moved, pos * y as r from ps"),
    ("eq", "select *, product(1 + r) over (partition by unique_id order by ds rows between unbounded preceding and current row) as equity from tr"),
    ("pk", "select *, equity / greatest(max(equity) over (partition by unique_id order by ds rows between unbounded preceding and current row), "
        "1) - 1 as dd from eq"),
    ("qt", "select unique_id, quantile_cont(r, 0.05) as q, max(abs(r)) as mx from pk group by all"),
    ("su", """select unique_id, product(1 + r) - 1 as total_return, ln(case when min(equity) <= 0 then 0 else pow(product(1 + r), 252.0::double / count(*)) end) as log_annual, stddev_samp(r) * sqrt(252) as annualized_vol,
        case when stddev_samp(r) >= 1e-12 then avg(r) / stddev_samp(r) * sqrt(252) end as sharpe, case when sqrt(avg(least(r, 0) * least(r, 0))) >= 1e-12 then avg(r) / sqrt(avg(least(r, 0) * least(r, 0))) * sqrt(252) end as sortino,
        least(min(dd), 0) as max_drawdown, avg((r > 0)::int) as hit_rate, greatest(-any_value(q), 0) as var_95, greatest(-avg(case when r <= q + 1e-12 * mx then r end), 0) as cvar_95,
        count(case when moved > 0 then 1 end) as n_trades, avg(pos) as exposure from pk join qt using (unique_id) group by unique_id"""),
)
_BT_COLS = ("total_return", "log_annual", "annualized_vol", "sharpe", "sortino", "max_drawdown", "hit_rate", "var_95", "cvar_95", "exposure")


@query("strategy_backtest", views("returns_d", *_BT) + f"select unique_id, n_trades, {srnd(*_BT_COLS)} from su")
def _(s, d):
    out = finance.backtest(V.returns_d(s, d), "window_average", test_size=10)[0]
    return out.withColumn("log_annual", F.ln(1 + F.col("annualized_return"))).select(ID, "n_trades", *rnd(*_BT_COLS))


@query("risk_annualized", views("returns_d", _EQ, ("pk", "select *, equity / greatest(max(equity) over (partition by unique_id "
    "order by ds rows between unbounded preceding and current row), 1) - 1 as dd from e")) +
       f"select unique_id, {pos('ln(pow(product(1 + y), 252.0::double / count(*)))', 4)} as log_annual, "
           f"{pos('least(min(dd), 0)', 6)} as max_drawdown, round(1 / abs(min(dd)), 4) as calmar_per_return from pk "
           f"group by unique_id having abs(min(dd)) >= 1e-12")
def _(s, d):
    r = finance.risk_metrics(V.returns_d(s, d)).filter("calmar is not null").withColumn("log_annual", F.ln(1 + F.col("annualized_return")))
    return r.withColumn("calmar_per_return", F.col("calmar") / F.col("annualized_return")).select(ID, *rnd("log_annual"), *rnd("max_drawdown", n=6), *rnd("calmar_per_return"))


@query("directional_accuracy", views("returns_d", _SIG) + "select unique_id, round(avg((sign(y) = sign(yhat))::int), 6) as directional_accuracy "
    "from sg where yhat is not null group by unique_id")
def _(s, d):
    sig = V.returns_d(s, d).withColumn("yhat", F.lag(TARGET).over(C.by_time())).filter("yhat is not null")
    return finance.directional_accuracy(sig).select(ID, *rnd("directional_accuracy", n=6))


_UNIFORM = "(('0x' || substr(md5(concat_ws(':', '1', p, k)), {}, 13))::bigint + 0.5::double) / 4503599627370496.0::double"
_GBM = (
    ("z", f"select p, k, sqrt(-2 * ln({_UNIFORM.format(1)})) * cos(2 * pi() * ({_UNIFORM.format(17)})) as z from range(2000) a(p), range(1, "
        f"21) b(k)"),
    ("v", "select k, 100.0::double * exp(sum((0.0005::double - 0.01::double * 0.01::double / 2) + 0.01::double * z) over (partition by p "
        "order by k)) as v from z"),
)


@query("gbm_summary", "with " + ", ".join(f"{n} as ({q})" for n, q in _GBM) + " select k::int as step, round(avg(v), 4) as mean, " + ", "
    "".join(f"round(quantile_cont(v, {x}), 4) as q{round(100 * x):02d}" for x in (0.05, 0.25, 0.5, 0.75, 0.95)) + " from v group by k")
def _(s, d):
    f = finance.simulation_summary(finance.simulate(s, 100.0, 0.0005, 0.01, 20, 2000, seed=1))
    return f.select(F.col("step").cast("int").alias("step"), *rnd("mean", "q05", "q25", "q50", "q75", "q95"))


@query("regimes")
def _(s, d):
    return finance.regimes(V.returns_d(s, d)).select(ID, day(), "state", *rnd("expected", n=6))


# ---- surfaces ----------------------------------------------------------------------------------------------------


@query("preview", views("panel_d") + "select count(*) as n_rows, count(distinct unique_id) as n_series, min(ds) as first, max(ds) as last "
    "from panel_d")
def _(s, d):
    return tools.preview(V.panel_d(s, d))


@query("alerts", "with f as (" + _SQL["naive_bands"] + ") select unique_id, 'forecast_below' as kind, t::double as threshold, yhat as value from f, "
    "(values ('*', 500), ('click', 100000)) r(series, t) where step = 1 and (series = '*' or series = unique_id) and yhat < t")
def _(s, d):
    f = _banded(N.naive(V.panel_d(s, d), H))
    rules = s.createDataFrame([("*", "forecast_below", 500.0), ("click", "forecast_below", 100000.0)], "series string, kind string, threshold double")
    return engine.alerts(f, None, rules)


@query("governance", views("panel_d", _POS, _CV, _CV2) + f"select unique_id, strftime(cutoff, '%Y-%m-%d') as cutoff, "
    f"round(sum(yhat - y) / sum(abs(y)), 4) as pct_bias, round(avg((y between lo and hi)::int), 4) as coverage, "
    f"sum(yhat - y) / sum(abs(y)) < -0.05 as biased, avg((y between lo and hi)::int) < 0.65 as uncovered from c2 where model = 'naive' group by 1, 2")
def _(s, d):
    return engine.governance(V.panel_d(s, d), "naive", 7, 3).select(ID, day("cutoff"), *rnd("pct_bias", "coverage"), "biased", "uncovered")


@query("dashboard")
def _(s, d):
    return engine.dashboard(V.panel_d(s, d))


@query("deal_scorer")
def _(s, d):
    x = V.table(s, d, "labels").join(V.table(s, d, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("quality").alias("won"), F.col("n_chars").cast("double").alias("n_chars"), F.col("toxic").cast("double").alias("toxic"))
    m = deals.DealScorer(["n_chars", "toxic"]).fit(x)
    return x.select("doc_id", "won", F.round(m.predict_proba(), 6).alias("proba"))


def _model_query(name: str, view: str, h: int, sql: str | None = None, **params):
    @query(f"model_{name}", sql)
    def run(s, d):
        p = getattr(V, view)(s, d)
        f = forecaster.forecast(p, [(name, params)], h, [80, 95], validate=False)
        return f.select(ID, "model", "step", day(), *rnd("yhat", "lo_80", "hi_80", "lo_95", "hi_95", n=3))


Z95 = z_of(95)


def _intermittent(name: str, start: str, step: str, rate: str, residuals: str) -> str:
    """Forecasts of a recursion with the root of its squared one-step errors, or of the differences where those are fewer than two."""
    bands = ", ".join(f"round(yhat {sign} {z!r} * sigma, "
        f"3) as {side}_{x}" for x, z in ((80, Z80), (95, Z95)) for side, sign in (("lo", "-"), ("hi", "+")))
    final = f"""select unique_id, '{name}' as model, step, strftime(last_ds + to_days(step), '%Y-%m-%d') as ds, round(yhat, 3) as yhat, {bands} from
        (select x.unique_id, k::int as step, last_ds, {rate} as yhat, greatest(case when {residuals} >= 2 then sqrt(sse / ({residuals} - 1)) when n >= 3 then sqrt(s2 / (n - 2)) else 1 end, 1e-12) as sigma
         from x join (select unique_id, sum(e * e) as s2, max(ds) as last_ds from (select unique_id, ds, y - lag(y) over (partition by unique_id order by panel_u.ds) as e from panel_u) group by all) using (unique_id), range(1, 7) t(k) where p = n)"""
    return _recursive("panel_u", start, step, final)


_SEEN = "x.size is not null"
_INTERMITTENT = {
    "croston": _intermittent("croston", "case when y > 0 then y end as size, case when y > 0 then 1::double end as gap, case "
        "when y > 0 then 1 else 2 end::double as since, 0::double as sse, 0 as cnt",
        f"case when r.y > 0 then case when {_SEEN} then 0.1::double * r.y + 0.9::double * x.size else r.y end else x.size end, case "
            f"when r.y > 0 then case when {_SEEN} then 0.1::double * x.since + 0.9::double * x.gap else x.since end else x.gap end, case "
            f"when r.y > 0 then 1 else x.since + 1 end::double, x.sse + case "
            f"when {_SEEN} then (r.y - x.size / x.gap) * (r.y - x.size / x.gap) else 0 end, x.cnt + ({_SEEN})::int",
        "coalesce(size / gap, 0)", "cnt"),
    "tsb": _intermittent("tsb", "0.1::double * (y > 0)::int + 0.9::double * hit_share as pr, case "
        "when y > 0 then 0.1::double * y + 0.9::double * hit_mean else coalesce(hit_mean, 0) end as size, (y - hit_share * coalesce(hit_mean, "
        "0)) * (y - hit_share * coalesce(hit_mean, 0)) as sse",
        "0.1::double * (r.y > 0)::int + 0.9::double * x.pr, case when r.y > 0 then 0.1::double * r.y + 0.9::double * x.size else x.size end, "
            "x.sse + (r.y - x.pr * x.size) * (r.y - x.pr * x.size)",
        "pr * size", "n"),
}

for _name, _view, _params in (
    ("ses", "panel_m", {}), ("holt", "panel_m", {}), ("holt_winters", "panel_m", {"season_length": 12}), ("auto_ets", "panel_m", {"season_length": 12}), ("theta", "panel_m", {"season_length": 12}),
    ("arima", "panel_m", {}), ("auto_arima", "panel_m", {}), ("sarima", "panel_m", {}), ("auto_sarima", "panel_m", {}), ("mstl", "panel_m", {"periods": 12}),
    ("kalman", "panel_m", {}), ("ridge_lag", "panel_m", {"lags": 6}), ("croston", "panel_u", {}), ("tsb", "panel_u", {}), ("garch", "returns_d", {}),
):
    _model_query(_name, _view, 6, _INTERMITTENT.get(_name), **_params)


@query("model_retention_sbg")
def _(s, d):
    p = P.cohort_panel(V.cohort_rows(s, d), "cohort", "age", "retained", "n")
    return forecaster.forecast(p, ["retention_sbg"], 4, [80], validate=False).select(ID, "model", "step", TIME, *rnd("yhat", "lo_80", "hi_80", n=6))


@query("model_conformal")
def _(s, d):
    return meta.conformal(V.panel_m(s, d), "ses", 6, [80]).select(ID, "step", day(), *rnd("yhat", "lo_80", "hi_80", n=3))


@query("model_auto_select")
def _(s, d):
    return meta.auto_select(V.panel_m(s, d), ["naive", ("seasonal_naive", {"season_length": 12}), "ses", "drift"], 6, [80], val_h=6)[0].select(ID, "model", "step", day(), *rnd("yhat", "lo_80", "hi_80", n=3))


@query("model_reconciled")
def _(s, d):
    return meta.reconciled(V.hier_m(s, d), "ses", 3, level=[80]).select(ID, "step", day(), *rnd("yhat", "lo_80", "hi_80", n=2))


# ---- keys, steps, records and surfaces ---------------------------------------------------------------------------


def _even(s, d):
    p = V.panel_d(s, d)
    return p.filter(F.dayofmonth(TIME) % 2 == 0), p.filter(F.dayofmonth(TIME) % 3 == 0)


for _name, _word, _of in (("union", "union", C.index_union), ("intersection", "intersect", C.index_intersection), ("difference", "except", C.index_difference)):

    @query(f"index_{_name}", views("panel_d") + f"select unique_id, {sday()} from (select unique_id, ds from panel_d where day(ds) % 2 = 0 {_word} "
        f"select unique_id, ds from panel_d where day(ds) % 3 = 0)")
    def _(s, d, of=_of):
        return of(*_even(s, d)).select(ID, day())


@query("lag_features", views("panel_d") + f"select unique_id, {sday()}, round(lag(y, 1) over w, 4) as lag_1, round(lag(y, 7) over w, 4) as lag_7 "
    f"from panel_d window w as (partition by unique_id order by panel_d.ds)")
def _(s, d):
    return dates.lag_features(V.panel_d(s, d), (1, 7)).select(ID, day(), *rnd("lag_1", "lag_7"))


@query("seasonal_index", views("panel_d", ("q", "select unique_id, y, (row_number() over (partition by unique_id order by ds) - 1) % 7 as place "
    "from panel_d"), ("w", "select unique_id, avg(y) as a, min(y) > 0 as mul from q group by all"), ("b", "select unique_id, place, avg(y) as b "
    "from q group by all")) +
       "select unique_id, place::int as place, round(case when mul then b / a else b - a end, 6) as index, mul as multiplicative from b "
           "join w using (unique_id)")
def _(s, d):
    return P.seasonal_index(V.panel_d(s, d), 7).select(ID, "place", *rnd("index", n=6), "multiplicative")


@query("business_steps", views("panel_d", ("b", "select unique_id, max(ds) as last_ds from panel_d where isodow(ds) < 6 "
    "group by all"), ("f", "select unique_id, last_ds + to_days(k::int) as ds from b, range(1, 15) t(k)"),
       ("r", "select *, row_number() over (partition by unique_id order by ds) as step from f where isodow(ds) < 6")) + f"select unique_id, "
           f"step::int as step, {sday('r.ds').replace('as r.ds', 'as ds')} from r where step <= 6")
def _(s, d):
    p = V.panel_d(s, d).filter(F.weekday(TIME) < 5)
    return dates.future(dates.with_step(p), 6).select(ID, "step", day())


@query("business_month_ends", "select * from (values (1, '2024-05-31'), (2, '2024-06-28'), (3, '2024-07-31'), (4, '2024-08-30')) t(step, ds)")
def _(s, d):
    ends = ["2023-12-29", "2024-01-31", "2024-02-29", "2024-03-29", "2024-04-30"]
    p = s.createDataFrame([("a", x, float(i)) for i, x in enumerate(ends)], f"{ID} string, {TIME} string, {TARGET} double")
    return dates.future(dates.with_step(p.withColumn(TIME, F.col(TIME).cast("timestamp_ntz"))), 4).select("step", day())


@query("modal_season", views("panel_d panel_m") + "select 'days' as panel, 7 as season union all select 'months', 12 union all select 'weekdays', 5")
def _(s, d):
    d_, m = P.densify(V.panel_d(s, d), "D"), P.densify(V.panel_m(s, d), "MS")
    found = [("days", d_), ("months", m), ("weekdays", d_.filter(F.weekday(TIME) < 5))]
    return s.createDataFrame([(k, dates.season_of(dates.with_step(p))) for k, p in found], "panel string, season int")


@query("zoned_buckets", "select event_type as unique_id, strftime(date_trunc('day', ts - interval 5 hours) + interval 5 hours, "
    "'%Y-%m-%d %H:%M') as ds, count(*) as n from events group by all")
def _(s, d):
    at = dates.bucket_zoned(F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp"), "D", "America/New_York")
    e = V.table(s, d, "events").select(F.col("event_type").alias(ID), F.convert_timezone(F.current_timezone(), F.lit("UTC"), at).alias(TIME))
    return e.groupBy(ID, F.date_format(TIME, "yyyy-MM-dd HH:mm").alias(TIME)).agg(F.count("*").alias("n"))


@query("weighted_pipeline_keyed", views("deals") + f"select segment, {_WP} from deals group by segment")
def _(s, d):
    proba = V.deals(s, d).select("opp_id", (0.1 + 0.08 * (F.col("opp_id") % 10)).alias("proba"))
    return deals.weighted_pipeline(V.deals(s, d), by="segment", proba=proba).select("segment", "n_deals", *rnd("total", "expected", "std", n=2))


@query("deal_log_loss", "select o_orderkey as opp_id, round(greatest(z, 0) + ln(1 + exp(-abs(z))) - y * z, 6) as loss from (select o_orderkey, "
    "(o_orderkey % 2000 - 1000)::double as z, (o_orderkey % 3 = 0)::int as y from orders)")
def _(s, d):
    z, y = (F.col("o_orderkey") % 2000 - 1000).cast("double"), (F.col("o_orderkey") % 3 == 0).cast("double")
    return V.table(s, d, "orders").select(F.col("o_orderkey").alias("opp_id"), deals.log_loss(z, y).alias("loss")).select("opp_id", *rnd("loss", n=6))


@query("sql_scan", "select o_orderpriority as p, count(*) as n from orders where o_totalprice > 1000 group by 1")
def _(s, d):
    V.table(s, d, "orders").createOrReplaceTempView("tidemark_orders")
    return readers.SQLSource(s, "select o_orderpriority as p, count(*) as n from tidemark_orders where o_totalprice > :least "
        "group by 1", {"least": 1000.0}).fetch()


@query("parquet_scan", "select * from region")
def _(s, d):
    return readers.ParquetSource(s, f"{d}/region.parquet").fetch()


@query("json_records", "select (props->>'k')::bigint as k, count(*) as n from events group by 1")
def _(s, d):
    return readers.flat_records(V.table(s, d, "events").select(F.parse_json("props").alias("v"))).groupBy("k").agg(F.count("*").alias("n"))


@query("watchlist", views("panel_d") + PANEL + "panel_d where unique_id in ('click', 'view')")
def _(s, d):
    return out(workspace.Workspace(watch=["click", "view"]).watched(V.panel_d(s, d)))


@query("engine_baselines", " union all ".join(f"select unique_id, '{n}' as model, step, ds, yhat, lo_80, hi_80 "
    f"from (" + _SQL[f"{n}_bands"] + ")" for n in ("naive", "seasonal_naive", "drift", "window_average")))
def _(s, d):
    f = engine.Engine(["naive", "seasonal_naive", "drift", "window_average"], [80]).forecast(V.panel_d(s, d), H)
    return f.select(ID, "model", F.col("step").cast("int").alias("step"), day(), *rnd("yhat", "lo_80", "hi_80", n=3))
