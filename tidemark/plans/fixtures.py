"""Views over the test tables that the catalogue's queries read, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.contract import ID, TARGET, TIME, by_time


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def panel_d(s, d) -> DataFrame:
    e = table(s, d, "events")
    return e.groupBy(F.col("event_type").alias(ID), F.date_trunc("day", "ts").cast("timestamp_ntz").alias(TIME)).agg(F.sum("value").alias(TARGET))


def panel_m(s, d) -> DataFrame:
    o = table(s, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias(ID), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias(TIME)).agg(F.sum("o_totalprice").alias(TARGET))


def panel_u(s, d) -> DataFrame:
    """Daily counts of each event type of every user: intermittent demand, zero filled."""
    from ..operators.panel import to_panel

    return to_panel(table(s, d, "events"), ["event_type", "user_id"], "ts", None, "D", span="panel")


def returns_d(s, d) -> DataFrame:
    p = panel_d(s, d)
    return p.withColumn(TARGET, F.col(TARGET) / F.lag(TARGET).over(by_time()) - 1).filter(F.col(TARGET).isNotNull())


def deals(s, d) -> DataFrame:
    stage = F.when(F.col("o_orderstatus") == "O", "prospect").when(F.col("o_orderstatus") == "P", "proposal").otherwise("closed")
    return table(s, d, "orders").select(F.col("o_orderkey").alias("opp_id"), F.col("o_totalprice").alias("amount"), stage.alias("stage"), F.col("o_orderpriority").alias("segment"), F.col("o_orderdate").alias("close_date"), F.col("o_custkey").alias("custkey"))


def deals_before(s, d) -> DataFrame:
    k = F.col("opp_id")
    stage = F.when(k % 5 == 0, "prospect").when(k % 5 == 1, "proposal").when(k % 5 == 2, "review").when(k % 5 == 3, "won").otherwise("prospect")
    return deals(s, d).filter("opp_id % 11 <> 3").select("opp_id", "amount", stage.alias("stage"), "close_date")


def deals_after(s, d) -> DataFrame:
    k = F.col("opp_id")
    stage = F.when(k % 7 == 0, "won").when(k % 7 == 1, "lost").when(k % 7 == 2, "review").when(k % 7 == 3, "proposal").otherwise("prospect")
    amount = F.when(k % 3 == 0, F.col("amount") * 1.25).when(k % 3 == 1, F.col("amount") * 0.5).otherwise(F.col("amount"))
    close = F.when(k % 4 == 0, F.col("close_date") + F.expr("interval 10 days")).when(k % 4 == 1, F.col("close_date") - F.expr("interval 5 days")).otherwise(F.col("close_date"))
    return deals(s, d).filter("opp_id % 13 <> 5").select("opp_id", amount.alias("amount"), stage.alias("stage"), close.alias("close_date"))


def hier_m(s, d) -> DataFrame:
    from ..operators.panel import to_panel

    o, c, n, r = (table(s, d, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return to_panel(j, ["r_name", "n_name"], "o_orderdate", "o_totalprice", "MS", span="panel")


def rates(s, d) -> DataFrame:
    """A rate a region (as currency) and quarter."""
    r = table(s, d, "region")
    q = s.range(28).select(F.col("id").alias("q"), F.expr("make_date(1995 + cast(id div 4 as int), cast(1 + 3 * (id % 4) as int), "
        "1)").cast("timestamp_ntz").alias("as_of"))
    return r.crossJoin(F.broadcast(q)).select(F.col("r_name").alias("currency"), "as_of", (1.0 + F.col("r_regionkey") * 0.1 + F.col("q") * 0.01).alias("rate"))


def deals_ccy(s, d) -> DataFrame:
    c, n, r = (table(s, d, t) for t in ("customer", "nation", "region"))
    j = deals(s, d).join(c, F.col("custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("opp_id", "amount", "stage", "close_date", F.col("r_name").alias("currency"))


def cohort_rows(s, d) -> DataFrame:
    """(cohort, age, retained, n): customers by quarter of their first order."""
    o = table(s, d, "orders").select("o_custkey", (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).alias("q"))
    first = o.groupBy("o_custkey").agg(F.min("q").alias("c"))
    j = o.join(first, "o_custkey").groupBy("c", (F.col("q") - F.col("c")).alias("age")).agg(F.count_distinct("o_custkey").alias("retained"))
    n = first.groupBy("c").agg(F.count("*").alias("n"))
    return j.join(n, "c").select(F.col("c").cast("string").alias("cohort"), F.col("age").cast("bigint").alias("age"), "retained", "n")


def fc_history(s, d) -> DataFrame:
    """Naive three-month forecasts of panel_m from four cut-offs."""
    p = panel_m(s, d)
    cut = s.range(4).select(F.expr("make_date(2000, 1 + 3 * cast(id as int), 1)").cast("timestamp_ntz").alias("as_of"))
    last = p.join(F.broadcast(cut), F.col(TIME) < F.col("as_of")).groupBy(ID, "as_of").agg(F.max_by(TARGET, TIME).alias("yhat"))
    ahead = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")
    return last.select(ID, "as_of", "yhat", ahead).select("as_of", ID, F.add_months("as_of", F.col("k")).cast("timestamp_ntz").alias(TIME), "yhat")


SQL = {
    "panel_d": "select event_type as unique_id, date_trunc('day', ts)::timestamp as ds, sum(value) as y from events group by all",
    "panel_m": "select o_orderpriority as unique_id, date_trunc('month', o_orderdate)::timestamp as ds, sum(o_totalprice) as y from orders "
        "group by all",
    "panel_u": """select k.unique_id, g.ds, coalesce(c.y, 0)::double as y from
        (select distinct event_type || '/' || user_id as unique_id from events) k,
        (select unnest(generate_series(min(date_trunc('day', ts))::timestamp, max(date_trunc('day', ts))::timestamp, interval 1 day)) as ds from events) g
        left join (select event_type || '/' || user_id as unique_id, date_trunc('day', ts)::timestamp as ds, count(*)::double as y from events group by all) c
        on c.unique_id = k.unique_id and c.ds = g.ds""",
    "returns_d": "select unique_id, ds, y / b - 1 as y from (select *, lag(y) over (partition by unique_id order by ds) as b from panel_d) "
        "where b is not null",
    "deals": """select o_orderkey as opp_id, o_totalprice as amount, case o_orderstatus when 'O' then 'prospect' when 'P' then 'proposal' else 'closed' end as stage,
        o_orderpriority as segment, o_orderdate as close_date, o_custkey as custkey from orders""",
    "deals_before": """select opp_id, amount, case opp_id % 5 when 0 then 'prospect' when 1 then 'proposal' when 2 then 'review' when 3 then 'won' else 'prospect' end as stage, close_date
        from deals where opp_id % 11 <> 3""",
    "deals_after": """select opp_id, case opp_id % 3 when 0 then amount * 1.25::double when 1 then amount * 0.5::double else amount end as amount,
        case opp_id % 7 when 0 then 'won' when 1 then 'lost' when 2 then 'review' when 3 then 'proposal' else 'prospect' end as stage,
        case opp_id % 4 when 0 then close_date + interval 10 days when 1 then close_date - interval 5 days else close_date end as close_date from deals where opp_id % 13 <> 5""",
    "hier_m": """select k.unique_id, g.ds, coalesce(c.y, 0)::double as y from (select distinct r_name || '/' || n_name as unique_id from hier_rows) k,
        (select unnest(generate_series(min(ds), max(ds), interval 1 month)) as ds from hier_rows) g
        left join (select r_name || '/' || n_name as unique_id, ds, sum(o_totalprice) as y from hier_rows group by all) c on c.unique_id = k.unique_id and c.ds = g.ds""",
    "hier_rows": """select r_name, n_name, date_trunc('month', o_orderdate)::timestamp as ds, o_totalprice from orders join customer on o_custkey = c_custkey
        join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "rates": """select r_name as currency, make_timestamp((1995 + q // 4)::bigint, (1 + 3 * (q % 4))::bigint, 1, 0, 0, 0.0) as as_of, 1.0::double + r_regionkey * 0.1::double + q * 0.01::double as rate
        from region, (select unnest(range(28)) as q)""",
    "deals_ccy": """select opp_id, amount, stage, close_date, r_name as currency from deals join customer on custkey = c_custkey join nation on c_nationkey = n_nationkey
        join region on n_regionkey = r_regionkey""",
    "cohort_rows": """select j.c::varchar as cohort, age::bigint as age, retained, n from
        (select f.c, o.q - f.c as age, count(distinct o.o_custkey) as retained from (select o_custkey, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 as q from orders) o
         join (select o_custkey, min(year(o_orderdate) * 4 + quarter(o_orderdate) - 1) as c from orders group by all) f using (o_custkey) group by all) j
        join (select c, count(*) as n from (select o_custkey, min(year(o_orderdate) * 4 + quarter(o_orderdate) - 1) as c from orders group by all) group by all) n using (c)""",
    "fc_history": """select as_of, unique_id, (as_of + to_months(k::int))::timestamp as ds, yhat from (select unique_id, as_of, arg_max(y, ds) as yhat from panel_m,
        (select make_timestamp(2000, (1 + 3 * i)::bigint, 1, 0, 0, 0.0) as as_of from range(4) t(i)) where ds < as_of group by all), range(3) s(k)""",
}
_NEEDS = {"returns_d": ["panel_d"], "deals_before": ["deals"], "deals_after": ["deals"], "hier_m": ["hier_rows"], "deals_ccy": ["deals"], "fc_history": ["panel_m"]}


def with_views(names: str, *more: tuple[str, str], recursive: bool = False) -> str:
    """A with clause of these views (and what they need), then more (name, sql)."""
    order: list[str] = []
    for n in names.split():
        for x in [*_NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    parts = [f"{n} as ({SQL[n]})" for n in order] + [f"{n} as ({q})" for n, q in more]
    return ("with recursive " if recursive else "with ") + ",\n".join(parts) + "\n"
