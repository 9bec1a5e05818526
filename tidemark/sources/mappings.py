"""Recipes for platforms' exports. Column names and filter values are fixed values: those of the platforms' own exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.errors import EngineError
from ..operators.panel import SchemaMapping

_RECIPES: dict[str, SchemaMapping] = {}


def register_mapping(m: SchemaMapping) -> SchemaMapping:
    if m.name in _RECIPES:
        raise ValueError(f"mapping {m.name!r} is registered")
    _RECIPES[m.name] = m
    return m


def get_mapping(name: str) -> SchemaMapping:
    if name not in _RECIPES:
        raise EngineError(f"unknown mapping {name!r}; known: {sorted(_RECIPES)}")
    return _RECIPES[name]


def list_mappings(spark: SparkSession) -> DataFrame:
    rows = [(m.name, m.freq, m.value_col, m.description) for m in _RECIPES.values()]
    return spark.createDataFrame(sorted(rows), "name string, freq string, value_col string, description string")


def apply_mapping(records: DataFrame, mapping: str | SchemaMapping, **overrides) -> DataFrame:
    return (get_mapping(mapping) if isinstance(mapping, str) else mapping).apply(records, **overrides)


def _money(name, said, renames, filters, date_col="close_date", **more):
    register_mapping(SchemaMapping(name, said, date_col, (), "amount", renames, filters, "MS", **more))


def _events(name, said, renames, id_cols=("event",), **more):
    register_mapping(SchemaMapping(name, said, "ts", id_cols, None, renames, {}, "D", **more))


_money("salesforce_opportunities", "closed-won amount by close month",
       {"Close Date": "close_date", "CloseDate": "close_date", "Amount": "amount", "Stage": "stage", "StageName": "stage", "Opportunity Owner": "owner", "Owner": "owner"}, {"stage": ("Closed Won",)})
_money("hubspot_deals", "closedwon amount by close month", {"closedate": "close_date", "hs_close_date": "close_date", "dealstage": "stage", "hubspot_owner_id": "owner"}, {"stage": ("closedwon",)})
_money("pipedrive_deals", "won value by month", {"won_time": "close_date", "value": "amount", "owner_name": "owner"}, {"status": ("won",)})
_money("stripe_invoices", "paid invoices by month, "
    "in minor units", {"created": "created_at", "amount_paid": "amount"}, {"status": ("paid",)}, "created_at", date_unit="s")
_money("stripe_charges", "succeeded charges by month, "
    "in minor units", {"created": "created_at"}, {"status": ("succeeded",)}, "created_at", date_unit="s")
_events("posthog_events", "rows a day and event", {"timestamp": "ts"})
_events("ga4_events", "rows a day and event_name", {"event_date": "ts", "event_name": "event"}, date_format="%Y%m%d")
_events("mixpanel_events", "rows a day and event", {"time": "ts"}, date_unit="s")
_events("amplitude_events", "rows a day and event_type", {"event_time": "ts", "event_type": "event"})
_events("generic_events", "rows a day", {"date": "ts", "timestamp": "ts"}, id_cols=())
