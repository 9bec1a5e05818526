"""Queries of the engine's edges: sources, snapshots, registries, wide frames. catalogue imports this module for its registrations."""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contract as C, dates
from ..functions.contract import ID, TARGET, TIME
from ..operators import deals, forecaster, meta, native_models as N, panel as P, snapshots
from ..sources import mappings, readers, synthetic
from . import engine, fixtures as V, tools
from .catalogue import _POS, _QUOTA, _SQL, H, PANEL, Z80, _banded, day, out, query, rnd, sday, views

# ---- REST: pages of the nation table as each style serves them ---------------------------------------------------


def _nations(s, d) -> list[dict]:
    rows = V.table(s, d, "nation").orderBy("n_nationkey").collect()  # a fixed dimension of 25 rows
    return [{"id": r.n_nationkey, "at": {"name": r.n_name, "region": r.n_regionkey}} for r in rows]


def _endpoint(rows: list[dict], size: int, style: str):
    """A client that answers as an API of this style would."""

    def get(url, headers, params, timeout):
        params = {k: int(v) for k, v in (params or {}).items() if str(v).isdigit()}
        at = {"page": (params.get("p", 1) - 1) * size, "offset": params.get("o", 0), "cursor": params.get("after", 0), "has_more": params.get("starting_after", -1) + 1, "next_url": int(url.partition("#")[2] or 0)}[style]
        more = at + size < len(rows)
        return 200, json.dumps({"data": {"rows": rows[at : at + size]}, "has_more": more, "next": str(at + size) if more else None, "link": f"#{at + size}" if more else None})

    return get


_STYLES = {
    "page": {"style": "page", "page_param": "p"}, "offset": {"style": "offset", "offset_param": "o"}, "cursor": {"style": "cursor", "cursor_param": "after", "cursor_path": "next"},
    "next_url": {"style": "next_url", "next_path": "link"}, "has_more": {"style": "has_more"},
}

for _name, _spec in _STYLES.items():

    @query(f"rest_{_name}", "select n_nationkey::bigint as id, n_name as name, n_regionkey::bigint as region from nation")
    def _(s, d, style=_name, spec=_spec):
        source = readers.RestSource(s, "http://local/nations", get=_endpoint(_nations(s, d), 7, style), records_path="data.rows", pagination=spec, page_size=7)
        return source.fetch().select("id", F.col("`at.name`").alias("name"), F.col("`at.region`").alias("region"))


@query("rest_truncated", "select count(*) as n from nation where n_nationkey < 14")
def _(s, d):
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # that it is cut
        source = readers.RestSource(s, "http://local/nations", get=_endpoint(_nations(s, d), 7, "page"), records_path="data.rows", pagination=_STYLES["page"], page_size=7, max_pages=2)
        return source.fetch().agg(F.count("*").alias("n"))


def _served(*pages):
    left = list(pages)
    return lambda url, headers, params, timeout: (200, json.dumps(left.pop(0)))


_MONTHS = "strftime(make_date(2024, (1 + n_nationkey % 3)::int, 1), '%Y-%m-%d')"
_PRESET = f"select '{{}}' as unique_id, {_MONTHS} as ds, round(sum(n_nationkey * 2.5::double), 4) as y from nation where n_nationkey % 2 = 0 group by all"


def _deal(r, won: str, lost: str) -> dict:
    return {"month": f"2024-{1 + r['id'] % 3:02d}-15", "amount": r["id"] * 2.5, "stage": won if r["id"] % 2 == 0 else lost}


@query("rest_hubspot", _PRESET.format("hubspot_deals"))
def _(s, d):
    rows = [(r, _deal(r, "closedwon", "closedlost")) for r in _nations(s, d)]
    page = [{"id": str(r["id"]), "properties": {"amount": str(x["amount"]), "dealstage": x["stage"], "closedate": x["month"], "hubspot_owner_id": "o"}} for r, x in rows]
    return out(readers.hubspot(s, "t", get=_served({"results": page[:10], "paging": {"next": {"after": "x"}}}, {"results": page[10:]})).to_panel())


@query("rest_salesforce", _PRESET.format("salesforce_opportunities"))
def _(s, d):
    rows = [(r, _deal(r, "Closed Won", "Closed Lost")) for r in _nations(s, d)]
    page = [{"attributes": {"type": "Opportunity"}, "CloseDate": x["month"], "Amount": x["amount"], "StageName": x["stage"], "Owner": "o"} for _, x in rows]
    get = _served({"records": page[:9], "nextRecordsUrl": "/services/data/more"}, {"records": page[9:], "nextRecordsUrl": None})
    return out(readers.salesforce(s, "https://own.example", "t", "select 1", get=get).to_panel())


@query("rest_stripe", _PRESET.format("stripe_invoices"))
def _(s, d):
    import datetime as dt

    at = lambda month: int(dt.datetime.fromisoformat(f"{month}T00:00:00+00:00").timestamp())
    rows = [(r, _deal(r, "paid", "void")) for r in _nations(s, d)]
    page = [{"id": f"in_{r['id']}", "created": at(x["month"]), "amount_paid": x["amount"], "status": x["stage"]} for r, x in rows]
    return out(readers.stripe(s, "k", get=_served({"data": page[:20], "has_more": True}, {"data": page[20:], "has_more": False})).to_panel())


@query("rest_posthog", f"select n_regionkey || '' as unique_id, {_MONTHS} as ds, count(*)::double as y from nation group by all")
def _(s, d):
    page = [{"timestamp": f"2024-{1 + r['id'] % 3:02d}-01T10:00:00", "event": str(r["at"]["region"])} for r in _nations(s, d)]
    source = readers.posthog(s, "k", "1", get=_served({"results": page[:20], "next": "https://us.posthog.com/api/projects/1/events/?after=x"}, {"results": page[20:], "next": None}))
    return out(source.to_panel(freq="MS").filter("y > 0"))


@query("inline_records", "select r_name as unique_id, strftime(make_date(2024, (1 + r_regionkey)::int, 1), '%Y-%m-%d') as ds, round(r_regionkey * 1.5::double, 4) as y from region")
def _(s, d):
    rows = V.table(s, d, "region").collect()  # a fixed dimension of five rows
    return out(tools.build_panel(s, records=[{"unique_id": r.r_name, "ds": f"2024-{1 + r.r_regionkey:02d}-01", "y": r.r_regionkey * 1.5} for r in rows]))


@query("sql_preview", "select 'select * from t where x > 1' as said, 203 as size")
def _(s, d):
    return s.createDataFrame([(readers.preview_sql("select  *\n from t\twhere x > 1"), len(readers.preview_sql("x" * 900)))], "said string, size int")


@query("air_passengers", "select 'AirPassengers' as unique_id, strftime(timestamp '1949-01-01' + to_months((i - 1)::int), '%Y-%m-%d') as ds, v::double as y from"
       " (select unnest(l) as v, generate_subscripts(l, 1) as i from (select [" + ", ".join(synthetic.PASSENGERS.split()) + "] as l))")
def _(s, d):
    return out(synthetic.air_passengers(s))


@query("array_panel", "select 'own' as unique_id, i as ds, i * 2.0::double as y from range(5) t(i)")
def _(s, d):
    return synthetic.panel_of(s, [0.0, 2, 4, 6, 8], unique_id="own")


# ---- snapshots ---------------------------------------------------------------------------------------------------


def _scratch(s: SparkSession) -> str:
    """A folder that all executors share: that of checkpoints, or the warehouse; a temporary one where all is one process."""
    named = s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    return tempfile.gettempdir() if re.match(r"local(\[|$)", s.sparkContext.master) else s.conf.get("spark.sql.warehouse.dir")


def _store(s: SparkSession, d: str) -> snapshots.SnapshotStore:
    """panel_m as it was known at three dates, one of them taken twice, in a folder that goes when the driver ends."""
    store = snapshots.SnapshotStore(s, f"{_scratch(s)}/tidemark-snapshots-{uuid.uuid4().hex}")

    def remove():
        at, fs = store._path(store.root)
        fs.delete(at, True)

    atexit.register(lambda: _quietly(remove))
    p = V.panel_m(s, d)
    for as_of, until in (("1999-01-01", "1998-06-01"), ("1999-01-01", "1999-01-01"), ("2000-01-01", "2000-01-01"), ("2001-01-01", "2001-01-01")):
        store.snapshot(p.filter(F.col(TIME) < F.lit(until).cast("timestamp_ntz")), as_of, label=until)
    return store


def _quietly(f) -> None:
    try:
        f()
    except Exception:  # noqa: BLE001  the session may have gone first
        pass


_TAKEN = ("taken", "select * from (values ('1999-01-01', 0, '1998-06-01'), ('1999-01-01', 1, '1999-01-01'), ('2000-01-01', 0, '2000-01-01'), ('2001-01-01', 0, '2001-01-01')) t(as_of, revision, until)")
_HISTORY = "select as_of, {} unique_id, " + sday() + ", round(y, 2) as y from panel_m, taken where panel_m.ds < until::timestamp"


@query("snapshot_history", views("panel_m", _TAKEN) + _HISTORY.format("revision::int as revision,"))
def _(s, d):
    return _store(s, d).history().select(day("as_of"), F.col("revision").cast("int").alias("revision"), ID, day(), *rnd(TARGET, n=2))


@query("snapshot_latest", views("panel_m", _TAKEN) + _HISTORY.format("") + " and until <> '1998-06-01' and unique_id = '1-URGENT'")
def _(s, d):
    return _store(s, d).history(series="1-URGENT", latest_only=True).select(day("as_of"), ID, day(), *rnd(TARGET, n=2))


@query("snapshot_load", views("panel_m") + f"select unique_id, {sday()}, round(y, 4) as y from panel_m where panel_m.ds < timestamp '1999-01-01'")
def _(s, d):
    return out(_store(s, d).load("1999-01-01"))


@query("snapshot_manifest", views("panel_m", _TAKEN) + "select 'panel' as kind, as_of, revision::int as revision, count(*) as rows, until as label, as_of as created_at from panel_m, taken where panel_m.ds < until::timestamp group by all")
def _(s, d):
    return _store(s, d).manifest().select("kind", "as_of", F.col("revision").cast("int").alias("revision"), "rows", "label", "created_at")


@query("snapshot_dates", "select unnest(['1999-01-01', '2000-01-01', '2001-01-01']) as as_of")
def _(s, d):
    return _store(s, d).as_of_dates()


# ---- frames and keys ---------------------------------------------------------------------------------------------

_SIDES = ", ".join(f"max(case when model = '{m}' then {s}_80 end) as \"{m}-{s}-80\"" for m in ("naive", "drift") for s in ("lo", "hi"))


@query("forecast_wide", "with u as (" + " union all ".join(f"select '{m}' as model, * from ({_SQL[f'{m}_bands']})" for m in ("naive", "drift")) + ")"
       " select unique_id, ds, max(case when model = 'naive' then yhat end) as naive, max(case when model = 'drift' then yhat end) as drift, " + _SIDES + " from u group by all")
def _(s, d):
    f = engine.Engine(["naive", "drift"], [80]).forecast(V.panel_d(s, d), H, as_wide=True)
    names = ["naive", "drift", *[f"{m}-{x}-80" for m in ("naive", "drift") for x in ("lo", "hi")]]
    return f.select(ID, day(), *[F.round(F.col(f"`{c}`"), 3).alias(c) for c in names])


_QUARTER = ("hq", "select *, greatest(1, n // 4) as hold from q")


@query("holdout_scores", views("panel_d", _POS, _QUARTER) + "select t.unique_id, 'naive' as model, count(*) as n, round(avg(abs(t.y - b.y)), 4) as mae from hq t join hq b on b.unique_id = t.unique_id and b.p = t.n - t.hold where t.p > t.n - t.hold group by t.unique_id")
def _(s, d):
    f = meta.holdout(V.panel_d(s, d), forecaster.resolve(["naive"]))
    return f.groupBy(ID, "model").agg(F.count("yhat").alias("n"), F.avg(F.abs(F.col(TARGET) - F.col("yhat"))).alias("mae")).select(ID, "model", "n", *rnd("mae"))


_KEYED = "(values ('click', 2500::double), ('view', 3500), ('nobody', 1)) k(u, quota)"


@query("quota_table", _QUOTA + f" select unique_id, round(e, 2) as expected, quota, e > quota as likely from g join {_KEYED} on u = unique_id")
def _(s, d):
    f = _banded(N.naive(V.panel_d(s, d), H)).filter(F.col(ID).isin("click", "view"))
    q = s.createDataFrame([("click", 2500.0), ("view", 3500.0), ("nobody", 1.0)], f"{ID} string, quota double")
    return deals.attainment(f, q, 80).select(ID, *rnd("expected", n=2), "quota", (F.col("probability") > 0.5).alias("likely"))


@query("quota_unmatched", views("panel_d") + f"select u as unique_id, quota from {_KEYED} where u not in (select unique_id from panel_d)")
def _(s, d):
    q = s.createDataFrame([("click", 2500.0), ("view", 3500.0), ("nobody", 1.0)], f"{ID} string, quota double")
    return deals.unmatched_quotas(q, V.panel_d(s, d))


@query("too_short_series", views("panel_u", ("k", "select unique_id, count(case when y > 0 then 1 end) as n from panel_u group by all")) + "select unique_id from k where n <= 1 order by unique_id limit 5")
def _(s, d):
    busy = V.panel_u(s, d).filter("y > 0")
    return s.createDataFrame([(x,) for x in C.too_short(busy, 1)], f"{ID} string")


@query("centred_average", views("panel_d", ("c", "select *, avg(y) over w as m, count(*) over w as k from panel_d window w as (partition by unique_id order by ds rows between 3 preceding and 3 following)")) +
       f"select unique_id, {sday('c.ds').replace('as c.ds', 'as ds')}, round(case when k = 7 then m end, 4) as y from c")
def _(s, d):
    return out(P.centred_average(V.panel_d(s, d), 7))


@query("sparkline", views("panel_d", ("r", "select *, row_number() over (partition by unique_id order by ds desc) as back from panel_d"), ("l", "select *, min(y) over (partition by unique_id) as lo, max(y) over (partition by unique_id) as hi from r where back <= 12")) +
       "select unique_id, string_agg(substr('▁▂▃▄▅▆▇█', 1 + round_even((y - lo) / (hi - lo) * 7, 0)::int, 1), '' order by ds) as spark from l group by unique_id")
def _(s, d):
    return engine.sparkline(V.panel_d(s, d))


@query("periods_per_year", "select 'days' as panel, 252 as periods union all select 'months', 12 union all select 'weeks', 52 union all select 'weekdays', 252")
def _(s, d):
    p = P.densify(V.panel_d(s, d), "D")
    weeks = P.to_panel(V.table(s, d, "events"), "event_type", "ts", "value", "W")
    found = [("days", p), ("months", P.densify(V.panel_m(s, d), "MS")), ("weeks", weeks), ("weekdays", p.filter(F.weekday(TIME) < 5))]
    return s.createDataFrame([(k, dates.periods_per_year(dates.with_step(x))) for k, x in found], "panel string, periods int")


@query("large_residuals", "select round(ln(3e200::double * sqrt((4.0::double / 9 + 16.0 / 9 + 1.0 / 9) / 2)), 9) as log_sigma")
def _(s, d):
    f = N.naive(synthetic.panel_of(s, [1e200, -1e200, 3e200, 2e200]), 1)
    return f.select(F.ln("sigma").alias("log_sigma")).select(*rnd("log_sigma", n=9))


@query("model_registry", "select family, count(*) as n from (values ('baseline'), ('baseline'), ('baseline'), ('baseline'), ('ml'), ('intermittent'), ('intermittent'), ('financial'), ('gtm'), ('meta'), ('meta'), ('meta'), ('meta')) t(family) group by family")
def _(s, d):
    families = ("baseline", "ml", "intermittent", "financial", "gtm", "meta")
    known = [f for f in families for _ in range(forecaster.list_models(s, f).filter(~F.col("name").endswith("_test")).count())]
    return s.createDataFrame([(f,) for f in known], "family string").groupBy("family").agg(F.count("*").alias("n"))


@query("mapping_registry", "select unnest(['amplitude_events', 'ga4_events', 'generic_events', 'hubspot_deals', 'mixpanel_events', 'pipedrive_deals', 'posthog_events', 'salesforce_opportunities', 'stripe_charges', 'stripe_invoices']) as name")
def _(s, d):
    return mappings.list_mappings(s).select("name")


@query("preview_head", views("panel_d") + PANEL + "panel_d order by unique_id, panel_d.ds limit 10")
def _(s, d):
    return out(V.panel_d(s, d).orderBy(ID, TIME).limit(10))


