"""Adapter views: the driver's tables in the shape of research tables, as SQL that Spark and DuckDB both run.

``{name}`` stands for a table or for another view. Sums go over
whole cents, so that both engines get the same doubles in whatever order they add.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS = {
    "bars": """select l_suppkey as listing_id, cast(date_trunc('month', l_shipdate) as date) as session_date,
        min(l_extendedprice / l_quantity) as low, max(l_extendedprice / l_quantity) as high,
        sum(cast(round(l_extendedprice * 100) as bigint)) / 100.0E0 / cast(sum(l_quantity) as bigint) as close, cast(sum(l_quantity) as bigint) as volume,
        sum(cast(round(l_extendedprice * 100) as bigint)) / 100.0E0 as amount, sum(cast(round(l_discount * 100) as bigint)) / 100.0E0 / count(*) as score, sum(cast(round(l_tax * 100) as bigint)) / 100.0E0 / count(*) as tax
        from {lineitem} group by 1, 2""",
    "bars_daily": """select l_suppkey as listing_id, cast(l_shipdate as date) as session_date,
        sum(cast(round(l_extendedprice * 100) as bigint)) / 100.0E0 / cast(sum(l_quantity) as bigint) as close, cast(sum(l_quantity) as bigint) as volume from {lineitem} group by 1, 2""",
    "bars_multi": """select l_suppkey as listing_id, cast(date_trunc('month', l_shipdate) as date) as session_date, l_returnflag as source_id,
        floor(sum(cast(round(l_extendedprice * 100) as bigint)) / 100.0E0 / cast(sum(l_quantity) as bigint) / 500) * 500 as close, cast(floor(sum(l_quantity) / 200) as bigint) as volume from {lineitem} group by 1, 2, 3""",
    "factors": """select listing_id, session_date, 1 - score as multiplier, 'src' as source_id from {bars}
        union all select listing_id, session_date, 1 - score + 0.5E0 as multiplier, 'alt' as source_id from {bars} where listing_id % 10 = 3 and volume % 2 = 0""",
    "limits": """select listing_id, session_date, prev * 0.9E0 as lower_limit, prev * 1.1E0 as upper_limit from
        (select listing_id, session_date, lag(close) over (partition by listing_id order by session_date) as prev from {bars}) x where prev is not null""",
    "states": "select listing_id, session_date, volume > 100 as is_trading, volume <= 60 as is_suspended, case when listing_id % 17 = 0 then 'terminated' else 'listed' end as listing_state from {bars}",
    "capital": """select l_suppkey as listing_id, cast(date_trunc('year', l_shipdate) as date) as effective_from,
        case when l_suppkey % 7 = 0 then null else cast(date_trunc('year', l_shipdate) + interval 1 year as date) end as effective_to,
        case when l_returnflag = 'A' then 'a' else 'b' end as source_id, cast(floor(count(*) / 60) * 1000 + 1000 as bigint) as total_shares, cast(date_trunc('year', l_shipdate) as date) as retrieved_on
        from {lineitem} group by 1, 2, 3, 4, 6""",
    "calendar": """select exchange, calendar_date, n > 0 as is_open, case when n > 0 then null else 'no trade' end as closure_reason from
        (select case when l_suppkey % 2 = 0 then 'E' else 'O' end as exchange, cast(l_shipdate as date) as calendar_date, sum(case when l_quantity > 20 then 1 else 0 end) as n from {lineitem} group by 1, 2) x""",
    "panel": """select b.listing_id, b.session_date, b.score, b.tax, round(ln(b.amount), 9) as size, s.s_nationkey as industry, b.close, b.volume,
        lead(b.close) over (partition by b.listing_id order by b.session_date) / b.close - 1 as fwd
        from {bars} b join {supplier} s on b.listing_id = s.s_suppkey""",
    "ic_series": """select session_date, round(value, 8) as value, year(session_date) as subperiod, case when year(session_date) % 2 = 0 then 'even' else 'odd' end as regime, 'ic' as series from
        (select session_date, case when stddev_pop(score) > 0 and stddev_pop(fwd) > 0 then covar_pop(score, fwd) / (stddev_pop(score) * stddev_pop(fwd)) end as value, count(*) as n
         from {panel} where fwd is not null group by 1) x where n >= 10""",
    "weights": "select session_date, listing_id, amount / sum(amount) over (partition by session_date) as weight from {bars}",
    "decay": """select series, horizon, round(value, 8) as value from (select 'g' || cast(industry % 5 as varchar(9)) as series, h as horizon,
        case when stddev_pop(score) > 0 and stddev_pop(r) > 0 then covar_pop(score, r) / (stddev_pop(score) * stddev_pop(r)) end as value from
        (select industry, score, 1 as h, lead(close, 1) over (partition by listing_id order by session_date) / close - 1 as r from {panel}
         union all select industry, score, 3, lead(close, 3) over (partition by listing_id order by session_date) / close - 1 from {panel}
         union all select industry, score, 6, lead(close, 6) over (partition by listing_id order by session_date) / close - 1 from {panel}) x where r is not null group by 1, 2) y""",
    "hypotheses": "select s_nationkey as family, s_suppkey as hypothesis_id, case when s_nationkey = 3 and s_suppkey % 4 = 1 then null else cast(s_suppkey * 37 % 101 as double) / 100 end as p_value from {supplier}",
    "facts": """select o_orderkey as fact_id, o_custkey as company_id, cast(date_trunc('quarter', o_orderdate) as date) as period_end, o_orderpriority as provider_id,
        row_number() over (partition by o_custkey, date_trunc('quarter', o_orderdate), o_orderpriority order by o_orderdate, o_orderkey) - 1 as revision,
        cast(o_orderdate as date) as available_at, cast(o_orderdate + interval 1 day as date) as known_from, cast(null as date) as known_to, round(o_totalprice, 2) as value,
        case o_orderstatus when 'F' then 'pit_verified' when 'O' then 'normalized_current' else 'raw' end as trust_state,
        case when o_orderkey % 41 = 0 then 'blocked' else 'passed' end as quality_state from {orders}""",
    "priced_facts": """select fact_id, company_id, period_end, provider_id, revision, available_at, known_from, known_to, cast(floor(value / 100000) * 100000 as double) as value, case when fact_id % 23 = 0 then 'thousand' else 'one' end as unit,
        case when fact_id % 29 = 0 then 'HKD' when fact_id % 31 = 0 then null else 'CNY' end as currency, trust_state, quality_state from {facts}""",
    "corrections": """select fact_id, company_id, period_end, provider_id, revision, available_at, known_from, known_to, value, trust_state, quality_state from {facts}
        union all select fact_id + 1000000000 * n, company_id, period_end, provider_id, revision, case when fact_id % 8 = 3 then cast(available_at + interval 2 day as date) else available_at end,
        case n when 1 then cast(known_from + interval 20 day as date) else cast(known_from + interval 9 day as date) end, known_to, value + n, trust_state, quality_state
        from {facts} cross join (select 1 as n union all select 2) c where fact_id % 4 = 3 or (n = 1 and fact_id % 4 = 2)""",
    "quarterly": """select l_suppkey as entity_id, cast(year(l_shipdate) as int) * 4 + cast(quarter(l_shipdate) as int) as q, sum(cast(round(l_extendedprice * 100) as bigint)) / 100.0E0 as revenue,
        sum(cast(round(l_extendedprice * 100) as bigint) * (100 - cast(round(l_discount * 100) as bigint))) / 100000.0E0 - 400000 * (l_suppkey % 3) as profit, sum(cast(round(l_extendedprice * 100) as bigint) * (100 - cast(round(l_tax * 100) as bigint))) / 200000.0E0 as cash_flow from {lineitem} group by l_suppkey, 2""",
    "metrics": """select entity_id, q, 'revenue' as metric, revenue as value from {quarterly} union all
        select entity_id, q, 'profit', profit from {quarterly} where (entity_id + q) % 11 <> 0 union all select entity_id, q, 'margin', profit / revenue from {quarterly}""",
    "companies": "select n_nationkey as company_id, n_name as company_name from {nation}",
    "securities": "select s_suppkey as security_id, s_nationkey as company_id, 'A' as share_class from {supplier}",
    "listings": """select s_suppkey as listing_id, s_suppkey as security_id, case when s_suppkey % 2 = 0 then 'E' else 'O' end as exchange,
        date '1995-01-01' as listed_on, case when s_suppkey % 13 = 0 then date '1999-06-30' end as delisted_on from {supplier}""",
    "identifiers": """select s_suppkey as listing_id, 'code' as kind, lpad(cast(s_suppkey % 90 as varchar(9)), 6, '0') as identifier, date '1995-01-01' as valid_from, case when s_suppkey % 5 = 0 then date '1998-01-01' end as valid_to from {supplier}
        union all select s_suppkey, 'code', lpad(cast(s_suppkey + 5000 as varchar(9)), 6, '0'), date '1998-01-01', cast(null as date) from {supplier} where s_suppkey % 5 = 0
        union all select s_suppkey, 'name', s_name, date '1995-01-01', date '1997-01-01' from {supplier}
        union all select s_suppkey, 'name', s_name || ' B', date '1997-06-01', cast(null as date) from {supplier} where s_suppkey % 3 = 0""",
    "industries": """select s_suppkey as security_id, 'sw' as taxonomy, 'I' || cast(s_nationkey % 8 as varchar(9)) as industry_code, date '1995-01-01' as valid_from, case when s_suppkey % 4 = 0 then date '1998-07-01' end as valid_to from {supplier}
        union all select s_suppkey, 'sw', 'I9', date '1998-07-01', cast(null as date) from {supplier} where s_suppkey % 4 = 0""",
    "daily_members": "select distinct 'u' || cast(user_id % 3 as varchar(9)) as universe_id, user_id as listing_id, cast(ts as date) as session_date from {events} where event_type <> 'view'",
    "memberships": """select universe_id, listing_id, min(session_date) as valid_from, case when max(session_date) < date '2024-01-29' then max(session_date) end as valid_to,
        max(listing_id) % 4 <> 0 as research_eligible, max(listing_id) % 6 in (1, 2, 5) as tradable_eligible from {daily_members} group by 1, 2""",
    "views": """select o_orderkey as view_id, o_custkey as security_id, cast(o_orderdate as date) as decision_date, o_totalprice / 1000000 - 0.2E0 as expected_return,
        o_totalprice / 1000000 - 0.3E0 as p10, o_totalprice / 1000000 - 0.2E0 as p50, o_totalprice / 1000000 - 0.05E0 as p90 from {orders}""",
    "components": """select view_id, component, case when component = 'event' and view_id % 5 = 0 then null else expected_return * share / 3.0E0 end as contribution from {views}
        cross join (select 'quality' as component, 0.4 as share union all select 'valuation', 0.3 union all select 'revision', 0.2 union all select 'event', 0.05) c where not (component = 'revision' and view_id % 33 = 0)""",
    "outcomes": "select view_id, security_id, expected_return + (view_id % 41 - 20) / 100.0E0 as realized_return, decision_date + interval 60 day as realized_at from {views} where view_id % 4 <> 1",
    "screens": """select 'scr' || cast(session_date as varchar(10)) as snapshot_id, session_date as decision_date, 'u' as universe_id, listing_id as security_id, score,
        row_number() over (partition by session_date order by score desc, listing_id) as rank, count(*) over (partition by session_date) as universe_size from {bars}""",
    "checkpoints": """select event_type as job_id, event_type || ':' || cast(cast(ts as date) as varchar(10)) as checkpoint_key, user_id % 9 as symbol, event_id as attempt,
        case when value < 2 then 'failed' when value < 4 then 'pending' else 'succeeded' end as status, cast(floor(value) as int) as rows_observed, cast(ts as date) as day, ts as updated_at, props as issue_counts from {events}""",
    "lineage": "select 'd' || cast(o_orderkey as varchar(12)) as upstream_id, 'd' || cast(o_orderkey * 2 + 1 as varchar(12)) as downstream_id, 'derived' as relation from {orders}",
}


def oracle(sql: str) -> str:
    """A query over tables and views as one DuckDB statement: the views it needs come first."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\{(\w+)\}", text):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(sql)
    plain = lambda text: re.sub(r"\{(\w+)\}", lambda m: f"v_{m[1]}" if m[1] in VIEWS else m[1], text)
    parts = ", ".join(f"v_{n} as ({plain(VIEWS[n])})" for n in needed)
    body = plain(sql).strip()
    if not parts:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {parts}, {body[15:]}"
    return f"with {parts}, {body[5:]}" if body.lower().startswith("with ") else f"with {parts} {body}"


class Frames:
    """The tables and views of one data folder as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        return self.sql(VIEWS[name])

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in set(re.findall(r"\{(\w+)\}", text))})


class Registry:
    """Queries by name, each with its SQL where SQL can express it."""

    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = lambda spark, sf_dir: f(Frames(spark, sf_dir))
            if sql:
                self.sql[f.__name__] = oracle(sql)
            return f

        return add
