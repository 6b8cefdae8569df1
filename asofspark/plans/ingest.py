"""Queries: sources, normalisation, mapping, planning, ledgers, audits and bounded listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofspark.operators import audit, checks
from asofspark.sources import ingest

from .testdata import Registry

query = Registry()

RAW = """select lpad(cast(l_suppkey as varchar(9)), 6, '0') as code, cast(cast(l_shipdate as date) as varchar(10)) as date, case when l_quantity > 5 then '1' else '0' end as tradestatus, case l_linenumber % 3 when 0 then '1' when 1 then '0' else '' end as isST, cast(cast(l_quantity as bigint) + 100 as varchar(9)) as open, cast(cast(l_quantity as bigint) + 103 as varchar(9)) as high,
    case when l_linenumber = 2 then '--' else cast(cast(l_quantity as bigint) + 98 as varchar(9)) end as low, case when l_tax = 0 then '' else cast(cast(floor(l_extendedprice) as bigint) as varchar(20)) end as close, cast(cast(l_quantity as bigint) + 99 as varchar(9)) as preclose, cast(cast(l_quantity as bigint) as varchar(9)) as volume, cast(cast(floor(l_extendedprice) as bigint) as varchar(20)) as amount from {lineitem}"""
KLINES = """select 'SH.' || lpad(cast(l_suppkey as varchar(9)), 6, '0') as code, cast(cast(l_shipdate as date) as varchar(10)) || ' 00:00:00' as time_key, cast(cast(l_quantity as bigint) + 100 as varchar(9)) as open, cast(cast(l_quantity as bigint) + 103 as varchar(9)) as high, cast(cast(l_quantity as bigint) + 98 as varchar(9)) as low,
    cast(cast(floor(l_extendedprice) as bigint) as varchar(20)) as close, '' as last_close, case when l_quantity > 10 then cast(cast(l_quantity as bigint) as varchar(9)) else '0' end as volume, cast(cast(floor(l_extendedprice) as bigint) as varchar(20)) as turnover from {lineitem}"""
CODES = "select lpad(cast(s_suppkey as varchar(9)), 6, '0') as code, s_suppkey as listing_id from {supplier} where s_suppkey % 7 <> 1"


@query(f"select r.code, cast(r.date as date) as session_date, tradestatus = '1' as is_trading, tradestatus <> '1' as is_suspended, case when isST in ('0', '1') then isST = '1' end as special_treatment, c.listing_id from ({RAW}) r left join ({CODES}) c using (code)")
def s7_daily_states(v):
    return ingest.split_daily(v.sql(RAW), v.sql(CODES))[0]


@query(f"select r.code, cast(r.date as date) as session_date, try_cast(open as double) as open, try_cast(high as double) as high, try_cast(low as double) as low, try_cast(close as double) as close, try_cast(preclose as double) as previous_close, try_cast(volume as bigint) as volume, try_cast(amount as double) as amount, c.listing_id from ({RAW}) r left join ({CODES}) c using (code) where tradestatus = '1'")
def s13_daily_bars_routed(v):
    return ingest.split_daily(v.sql(RAW), v.sql(CODES))[1]


@query(f"select r.code, r.session_date, open, high, low, close, cast(null as double) as previous_close, volume, amount, c.listing_id from (select substr(code, 4) as code, cast(substr(time_key, 1, 10) as date) as session_date, cast(open as double) as open, cast(high as double) as high, cast(low as double) as low, cast(close as double) as close, cast(volume as bigint) as volume, cast(turnover as double) as amount from ({KLINES})) r left join ({CODES}) c using (code) where volume > 0")
def s13_klines_routed(v):
    return ingest.split_daily(ingest.daily(v.sql(KLINES), "klines"), v.sql(CODES))[1]


@query(f"select substr(r.code, 4) as code, cast(substr(time_key, 1, 10) as date) as session_date, cast(volume as bigint) > 0 as is_trading, cast(volume as bigint) <= 0 as is_suspended, cast(null as boolean) as special_treatment, c.listing_id from ({KLINES}) r left join ({CODES}) c on c.code = substr(r.code, 4)")
def s7_kline_states(v):
    return ingest.split_daily(ingest.daily(v.sql(KLINES), "klines"), v.sql(CODES))[0]


HELD = "select lpad(cast(l_suppkey as varchar(9)), 6, '0') as code, case when l_linenumber = 6 then '-' else cast(cast(l_shipdate as date) as varchar(10)) end as change_date, case when l_quantity > 45 then null else cast(cast(l_quantity as bigint) as varchar(9)) || ',000.5' end as total, cast(cast(l_quantity as bigint) as varchar(9)) || '00' as circulating, case when l_tax > 0.05 then '--' else cast(l_linenumber as varchar(9)) end as restricted from {lineitem}"


@query(f"with x as (select distinct code, try_cast(change_date as date) as effective_on, cast(round(try_cast(replace(total, ',', '') as double) * 10000) as bigint) as total_shares, cast(round(try_cast(replace(circulating, ',', '') as double) * 10000) as bigint) as circulating_shares, cast(round(try_cast(replace(restricted, ',', '') as double) * 10000) as bigint) as restricted_shares from ({HELD})) select *, sha256(concat_ws('|', code, cast(effective_on as varchar), cast(total_shares as varchar), cast(circulating_shares as varchar), coalesce(cast(restricted_shares as varchar), ''))) as record_id from x where total_shares is not null and effective_on is not null")
def s8_share_capital(v):
    return ingest.share_capital(v.sql(HELD))


TERMS = "select l_orderkey as code, cast(cast(l_shipdate as date) as varchar(10)) as ex_date, case when l_returnflag = 'A' then cast(cast(l_quantity as bigint) as varchar(9)) end as cash, case when l_linestatus = 'F' then cast(cast(l_linenumber as bigint) as varchar(9)) end as bonus, cast(null as varchar(9)) as transfer from {lineitem}"


@query(f"select code, ex_date, cast(cash as double) / 10 as cash, cast(bonus as double) / 10 as bonus, cast(transfer as double) as transfer from ({TERMS}) where cash is not null or bonus is not null")
def s8_corporate_actions(v):
    return ingest.actions(v.sql(TERMS)).drop("record_id")


WIDE = "select o_custkey % 400 as code, cast(date_trunc('quarter', o_orderdate) as date) as period_end, 'p' || cast(o_orderkey % 2 as varchar(2)) as provider_id, case when o_orderkey % 5 = 0 then null else o_totalprice end as revenue, case when o_orderkey % 7 = 0 then null else o_totalprice * 0.5 end as cost, o_totalprice * 0.1 as tax, o_orderkey % 9 <> 4 as asked from {orders}"


@query(f"with w as (select *, count(*) over (partition by code, period_end, provider_id) as n from ({WIDE}) where asked), u as (select code, period_end, provider_id, unnest(['revenue', 'cost', 'tax']) as field, unnest([revenue, cost, tax]) as raw_value from w where n = 1) select code, period_end, provider_id, field, round(raw_value, 6) as raw_value from u where raw_value is not null")
def s9_financial_long(v):
    return ingest.financial_long(v.sql(WIDE), ["code", "period_end", "provider_id"], ["revenue", "cost", "tax"], F.col("asked")).withColumn("raw_value", F.round("raw_value", 6))


@query(f"select provider_id, count(*) filter (where asked) as n_rows, count(*) filter (where asked and n > 1) as n_repeated, sum(case when asked and revenue is null then 1 else 0 end + case when asked and cost is null then 1 else 0 end) as n_missing, count(*) filter (where not asked) as n_outside from (select *, count(*) filter (where asked) over (partition by code, period_end, provider_id) as n from ({WIDE})) group by 1")
def s9_financial_counters(v):
    return ingest.financial_counters(v.sql(WIDE), ["provider_id"], ["code", "period_end", "provider_id"], ["revenue", "cost", "tax"], F.col("asked"))


BASIS = "select o_orderkey as k, cast(date_trunc('quarter', o_orderdate) + interval 3 month - interval 1 day as date) as period_end, case o_orderkey % 3 when 0 then 'instant' when 1 then 'year_to_date' else 'quarter' end as value_basis from {orders}"


@query(f"select k, case quarter(period_end) when 4 then 'annual' when 2 then 'half_year' else 'quarter' end as period_type, case value_basis when 'year_to_date' then cast(date_trunc('year', period_end) as date) when 'quarter' then cast(date_trunc('quarter', period_end) as date) end as period_start from ({BASIS})")
def s9_period_bounds(v):
    return v.sql(BASIS).select("k", *ingest.period_bounds())


DAYS = "select exchange, calendar_date, is_open, case when dayofmonth(calendar_date) % 9 = 0 then 'holiday' else closure_reason end as closure_reason from {calendar}"


@query(f"select exchange, calendar_date, 'closed_without_reason' as rule from ({DAYS}) where not is_open and closure_reason is null union all select exchange, calendar_date, 'open_with_reason' from ({DAYS}) where is_open and closure_reason is not null")
def s10_calendar_rules(v):
    return checks.violations(v.sql(DAYS), ["exchange", "calendar_date"], ingest.calendar_rules())


ROWS = "select event_id as row_id, 'p' || cast(user_id % 2 as varchar(2)) as provider_id, event_type as field, value as raw_value, case when user_id % 9 = 0 then 'shares' else 'currency' end as unit, case when user_id % 7 <> 0 then 'CNY' end as currency, 'u' || cast(user_id as varchar(12)) as unit_id, user_id as code, cast(ts as date) as period_end, ts as retrieved_at from {events}"
MAPPINGS = "select 'p0' as provider_id, 'view' as field, 'revenue' as metric, 1000.0E0 as scale, 'both' as scope union all select 'p1', 'view', 'revenue', 1.0E0, 'strict' union all select 'p0', 'click', 'profit', 10.0E0, 'both' union all select 'p0', 'click', 'cost', 10.0E0, 'both' union all select 'p1', 'click', 'cost', 1.0E0, 'current' union all select 'p1', 'error', 'tax', 1.0E0, 'both' union all select 'p0', 'purchase', 'tax', 2.0E0, 'both'"
METRICS = "select 'revenue' as metric, 'currency' as unit union all select 'profit', 'currency' union all select 'cost', 'shares' union all select 'tax', 'currency'"
MAPPED = f"select r.*, case when g.n is null then 'unmapped' when g.n > 1 then 'conflict' when r.unit <> g.u then 'unit_mismatch' when g.u = 'currency' and r.currency is null then 'currency_missing' when g.u <> 'currency' and r.currency is not null then 'currency_unexpected' else 'mapped' end as status, g.metric, g.scale from ({ROWS}) r left join (select provider_id, field, count(distinct m.metric) as n, min(m.metric) as metric, min(scale) as scale, min(x.unit) as u from ({MAPPINGS}) m join ({METRICS}) x on x.metric = m.metric where scope in ('both', 'current') group by 1, 2) g using (provider_id, field)"


def _mapped(v):
    return ingest.map_fields(v.sql(ROWS), v.sql(MAPPINGS), v.sql(METRICS), "current")


@query(f"select row_id, status, case when status = 'mapped' then metric end as metric, case when status = 'mapped' then round(raw_value * scale, 6) end as value from ({MAPPED})")
def j13_field_mapping(v):
    return _mapped(v).select("row_id", "status", "metric", F.round("value", 6).alias("value"))


IDENTITIES = """select c_custkey as code, c_nationkey as company_id, date '2020-01-01' as valid_from, case when c_custkey % 3 = 0 then date '2024-01-15' end as valid_to from {customer} where c_custkey % 6 <> 2
    union all select c_custkey, c_nationkey + 100, case when c_custkey % 2 = 0 then date '2024-01-11' else date '2024-01-19' end, cast(null as date) from {customer} where c_custkey % 3 = 0"""
UNITS = "select 'u' || cast(c_custkey as varchar(12)) as unit_id from {customer}"


@query(f"with m as (select *, cast(retrieved_at + interval 8 hour as date) as day from ({MAPPED}) where status = 'mapped'), c as (select m.code, m.day, count(distinct i.company_id) as n, min(i.company_id) as company_id from (select distinct code, day from m) m left join ({IDENTITIES}) i on i.code = m.code and i.valid_from <= m.day and (i.valid_to is null or m.day < i.valid_to) group by 1, 2) select unit_id, code, case when n = 1 then company_id end as company_id, case when n = 1 then 'resolved' when n > 1 then 'ambiguous' else 'not_found' end as identity_status, metric, period_end, round(raw_value * scale, 6) as value, sha256(code || '|' || metric || '|' || period_end || '|') as observation_id from m join c using (code, day)")
def s21_observations(v):
    rows = _mapped(v).drop("provider_id").withColumn("provider_id", F.lit(""))
    return ingest.observations(rows, v.sql(IDENTITIES), v.sql(UNITS))[0].withColumn("value", F.round("value", 6))


@query(f"select u.unit_id, coalesce(n, 0) as n_rows, coalesce(k, 0) as n_mapped, case when n is null then 'empty' when k = 0 then 'failed' else 'succeeded' end as status from ({UNITS}) u left join (select unit_id, count(*) as n, count(*) filter (where status = 'mapped') as k from ({MAPPED}) group by 1) m using (unit_id)")
def s21_unit_receipts(v):
    return ingest.observations(_mapped(v), v.sql(IDENTITIES), v.sql(UNITS))[1]


OLD = "select o_orderkey as id, 'h' || cast(o_orderkey as varchar(12)) as content_hash from {orders} where o_orderdate < timestamp '1997-01-01 00:00:00'"
NEW = "select case when o_orderkey % 11 = 0 then o_orderkey - 3 else o_orderkey end as id, 'h' || cast(case when o_orderkey % 13 = 0 then o_orderkey + 7 else o_orderkey end as varchar(12)) as content_hash from {orders} where o_orderdate >= timestamp '1995-01-01 00:00:00'"


@query(f"with n as (select distinct * from ({NEW})), o as (select id, count(*) as own from n group by 1), b as (select content_hash, min(id) as lo, max(id) as hi from (select * from ({OLD}) union all select * from n) group by 1), e as (select id, min(content_hash) as have from ({OLD}) group by 1) select n.id, n.content_hash, case when own > 1 or have <> n.content_hash or lo <> hi then 'conflict' when have is not null then 'duplicate' else 'insert' end as action from n join o using (id) left join e using (id) join b using (content_hash)")
def s16_ledger_append(v):
    return ingest.ledger_append(v.sql(OLD), v.sql(NEW))


PLANS = "select c_custkey as plan_id, c_mktsegment as domain, 'm' || cast(c_nationkey as varchar(4)) as market, date '2015-06-01' + cast(c_custkey % 900 as int) as start_date, date '2017-12-20' + cast(c_custkey % 700 as int) as end_date from {customer}"


@query(f"select plan_id, domain, market, greatest(start_date, make_date(y, 1, 1)) as slice_from, least(end_date, make_date(y, 12, 31)) as slice_to, domain || ':' || market || ':' || greatest(start_date, make_date(y, 1, 1)) || ':' || least(end_date, make_date(y, 12, 31)) as checkpoint_key from (select *, unnest(range(year(start_date), year(end_date) + 1)) as y from ({PLANS}))")
def s17_work_units(v):
    return ingest.work_units(v.sql(PLANS))


@query("select c_nationkey, c_custkey as symbol, cast((row_number() over (partition by c_nationkey order by c_custkey) - 1) // 7 as int) as bucket from {customer}")
def s17_symbol_buckets(v):
    return ingest.symbol_buckets(v.customer.withColumnRenamed("c_custkey", "symbol"), 7, ["c_nationkey"])


@query("select distinct checkpoint_key from {checkpoints} where checkpoint_key not in (select checkpoint_key from (select checkpoint_key, arg_max(status, attempt) as s from {checkpoints} group by 1) where s = 'succeeded')")
def s18_pending_units(v):
    c = v.checkpoints
    return ingest.pending_units(c.select("checkpoint_key").distinct(), c)


HASHED = "select job_id, checkpoint_key, 'c' || cast(max(attempt) as varchar(12)) as content_hash from {checkpoints} group by 1, 2"


@query(f"with h as (select job_id, sha256(checkpoint_key || '=' || content_hash) as h from ({HASHED})), a as (select job_id, substr(h, 1, 4) as node, count(*) as n, sha256(string_agg(h, chr(10) order by h)) as h from h group by 1, 2), b as (select job_id, substr(node, 1, 2) as node, sum(n) as n, sha256(string_agg(h, chr(10) order by node)) as h from a group by job_id, substr(node, 1, 2)) select job_id, cast(sum(n) as bigint) as n_checkpoints, sha256(string_agg(h, chr(10) order by node)) as manifest_hash from b group by 1")
def s19_dataset_manifest(v):
    return ingest.dataset_manifest(v.sql(HASHED), ["job_id"])


REQUESTS = "select o_orderkey as request_id, case when o_orderstatus = 'F' then 'strict' else 'current' end as mode, 'f' || cast(o_custkey % 5 as varchar(2)) as field, case when o_orderkey % 4 = 0 then 'a' when o_orderkey % 4 = 1 then 'b' end as excluded_provider from {orders}"
PROFILES = "select 'a' as provider_id, 'primary' as role, 'f0' as field, true as strict_allowed, true as enabled union all select 'b', 'secondary', 'f0', true, true union all select 'c', 'verification', 'f0', true, true union all select 'a', 'primary', 'f1', false, true union all select 'b', 'secondary', 'f1', true, true union all select 'c', 'verification', 'f1', true, true union all select 'a', 'primary', 'f2', true, false union all select 'b', 'secondary', 'f2', false, true union all select 'b', 'secondary', 'f3', true, true"


@query(f"with x as (select request_id, provider_id, case when role = 'primary' then 0 when role = 'secondary' then case when mode = 'strict' then 2 else 1 end else case when mode = 'strict' then 1 else 2 end end as k, case when provider_id is null then 'no_provider' when provider_id = excluded_provider then 'excluded' when not enabled then 'disabled' when mode = 'strict' and not strict_allowed then 'not_strict' end as why from ({REQUESTS}) q left join ({PROFILES}) p using (field)) select request_id, arg_min(provider_id, (k, provider_id)) filter (where why is null) as provider_id, coalesce(string_agg(provider_id || ':' || why, ',' order by provider_id || ':' || why) filter (where why is not null and provider_id is not null), '') as denials from x group by 1")
def k4_source_routing(v):
    return ingest.select_source(v.sql(REQUESTS), v.sql(PROFILES)).withColumn("denials", F.array_join("denials", ","))


# -- audits -------------------------------------------------------------------------------------------------------

UNIT = "select job_id, symbol, checkpoint_key as unit_key, status, case when attempt % 10 = 0 then 0 else rows_observed end as receipt_rows, case when attempt % 10 = 0 then 0 when attempt % 997 = 0 then rows_observed - 1 else rows_observed end as persisted_rows, case when status = 'failed' then 1 else 0 end as rejected_rows, case when attempt % 50 = 0 then 'warned' when attempt % 1999 = 5 then 'failed' else 'passed' end as quality from {checkpoints}"


@query(f"with g as (select job_id, count(*) as n_units, count(*) filter (where status = 'succeeded') as n_completed, sum(case when status = 'succeeded' then receipt_rows else 0 end) as receipt_rows, sum(case when status = 'succeeded' then persisted_rows else 0 end) as persisted_rows, count(*) filter (where status = 'succeeded' and receipt_rows = 0) as zero_units, sum(rejected_rows) as rejected_rows, count(distinct symbol) as n_symbols, count(*) filter (where quality = 'passed') as quality_passed, count(*) filter (where quality = 'warned') as quality_warned, count(*) filter (where quality = 'failed') as quality_failed from ({UNIT}) group by 1) select *, n_units = n_completed and receipt_rows = persisted_rows and quality_failed = 0 as passed from g")
def a10_cohort_audit(v):
    return audit.cohort(v.sql(UNIT))


EXPECTED = "select distinct event_type as job_id, user_id % 10 as symbol from {events}"


@query(f"with s as (select * from ({UNIT}) where status = 'succeeded'), o as (select distinct job_id, symbol from s), x as (select coalesce(e.job_id, o.job_id) as job_id, count(e.symbol) as n_symbols, count(*) filter (where o.symbol is null) as n_missing, count(*) filter (where e.symbol is null) as n_extra from ({EXPECTED}) e full join o on o.job_id = e.job_id and o.symbol = e.symbol group by 1) select job_id, n_symbols, n_missing, n_extra, c as n_completed, 6 * cast(ceil(n_symbols / 4.0) as bigint) as n_expected, n_missing = 0 and n_extra = 0 and c = 6 * ceil(n_symbols / 4.0) as complete from x join (select job_id, count(distinct unit_key) as c from s group by 1) k using (job_id)")
def a11_job_coverage(v):
    return audit.job_coverage(v.sql(UNIT), v.sql(EXPECTED), 3, 2, 4)


@query("select job_id, 'k' as issue, sum(cast(json_extract(issue_counts, '$.k') as bigint)) as total from {checkpoints} group by 1 having sum(cast(json_extract(issue_counts, '$.k') as bigint)) > 0")
def a12_issue_totals(v):
    return audit.issue_totals(v.checkpoints, ["job_id"])


TARGETS = "select c_custkey as entity_id from {customer}"
PROOF = "select o_custkey as entity_id, o_orderpriority as role, cast(o_orderdate as date) as at_, o_orderstatus as dataset_id, o_orderkey % 7 as source_id from {orders} where o_custkey % 5 <> 1"


@query(f"select role, count(*) as n_rows, count(distinct entity_id) as n_entities, min(at_) as first_date, max(at_) as last_date, count(distinct dataset_id) as n_datasets, count(distinct source_id) as n_sources, (select count(*) from ({TARGETS})) as n_targets, round(count(distinct entity_id) * 1.0 / (select count(*) from ({TARGETS})), 8) as coverage from ({PROOF}) where entity_id in (select entity_id from ({TARGETS})) group by 1")
def a13_j20_role_evidence(v):
    return audit.role_evidence(v.sql(TARGETS), v.sql(PROOF).withColumnRenamed("at_", "at")).withColumn("coverage", F.round("coverage", 8))


EVENTS = "select o_custkey as entity_id from {orders}"
WORK = "select o_custkey as entity_id, case when o_orderkey % 4 = 0 then 'succeeded' else 'failed' end as status from {orders}"


@query(f"select t.entity_id, coalesce(n, 0) as n_events, n is not null or coalesce(ok, false) as covered from ({TARGETS}) t left join (select entity_id, count(*) as n from ({EVENTS}) group by 1) a using (entity_id) left join (select entity_id, bool_or(status = 'succeeded') as ok from ({WORK}) group by 1) w using (entity_id)")
def a14_action_coverage(v):
    return audit.action_coverage(v.sql(TARGETS), v.sql(EVENTS), v.sql(WORK))


@query(f"select t.entity_id, count(e.entity_id) as n_rows from ({TARGETS}) t left join ({EVENTS}) e using (entity_id) group by 1")
def j17_requested_counts(v):
    return audit.counts_for(v.sql(TARGETS), v.sql(EVENTS), "entity_id")


NEEDS = "select c_custkey as study_id, x.role, 1 + c_custkey % 2 as min_trust, 0.5E0 + c_custkey % 5 * 0.1E0 as min_coverage, date '1996-01-01' as window_from, date '2000-01-01' as window_to, case when x.role = 'bars' then 'session_close' else 'announcement' end as availability_policy from {customer} cross join (select 'bars' as role union all select 'facts' union all select 'actions') x"
HAVE = "select c_custkey as study_id, x.role, c_custkey % 3 as trust, c_custkey % 17 = 0 as quality_failed, 0.4E0 + c_custkey % 7 * 0.1E0 as coverage, date '1995-06-01' + cast(c_custkey % 300 as int) as first_date, date '2000-06-01' - cast(c_custkey % 400 as int) as last_date, c_custkey % 19 <> 0 as lineage_ok, case when x.role = 'bars' and c_custkey % 23 <> 5 then 'session_close' when c_custkey % 29 <> 6 then 'announcement' end as availability_policy, c_custkey % 31 <> 7 as availability_enforced, c_custkey % 13 = 1 as quality_warned from {customer} cross join (select 'bars' as role union all select 'facts' union all select 'actions') x where c_custkey % 11 <> 3 and not (x.role = 'actions' and c_custkey % 4 = 2)"


@query(f"with x as (select n.study_id, n.role, list_filter([case when h.coverage is null then 'missing:' || n.role end, case when h.trust < n.min_trust then 'trust:' || n.role end, case when quality_failed then 'quality:' || n.role end, case when h.coverage < n.min_coverage then 'coverage:' || n.role end, case when first_date > window_from or last_date < window_to then 'window:' || n.role end, case when not lineage_ok then 'lineage:' || n.role end, case when h.coverage is not null and h.availability_policy is distinct from n.availability_policy then 'availability_policy:' || n.role end, case when not availability_enforced then 'availability_enforcement:' || n.role end], lambda s: s is not null) as b, case when quality_warned and not quality_failed then 'quality_warned:' || n.role end as w from ({NEEDS}) n left join ({HAVE}) h on h.study_id = n.study_id and h.role = n.role) select study_id, coalesce(array_to_string(list_sort(flatten(list(b))), ','), '') as blockers, len(flatten(list(b))) = 0 as permitted, coalesce(string_agg(w, ',' order by w), '') as warnings from x group by 1")
def a21_study_readiness(v):
    return audit.readiness(v.sql(NEEDS), v.sql(HAVE)).withColumns({c: F.array_join(c, ",") for c in ("blockers", "warnings")})


CHECKED = """select o_orderkey as report_id, c.name as check_name, case when (o_orderkey + c.n) % 131 = 0 then 'fail' when (o_orderkey + c.n) % 29 = 0 then 'waived' else 'pass' end as outcome from {orders} cross join (""" + " union all ".join(f"select '{c}' as name, {n} as n" for n, c in enumerate(audit.VALIDATION_CHECKS)) + """) c where (o_orderkey * 7 + c.n) % 97 <> 1
    union all select o_orderkey, 'ic', 'pass' from {orders} where o_orderkey % 53 = 2"""
CONTEXTS = "select o_orderkey as report_id, case when o_orderkey % 10 = 3 then 'current' else 'strict_historical' end as data_mode, case when o_orderstatus = 'P' then 'live' else 'research' end as stage, case when o_orderkey % 12 = 7 then 'normalized_current' else 'pit_verified' end as trust_state from {orders} where o_orderkey % 61 <> 8"


@query(f"with g as (select report_id, concat_ws(',', " + ", ".join(f"case when bool_or(check_name = '{c}') then null else '{c}' end" for c in sorted(audit.VALIDATION_CHECKS)) + f") as missing, count(*) filter (where outcome = 'fail') as n_failed, count(*) - count(distinct check_name) as n_repeated, count(distinct check_name) filter (where outcome = 'pass' and check_name in ('pit_input_qualification', 'walk_forward_oos')) as firm from ({CHECKED}) group by 1), c as (select report_id, data_mode = 'strict_historical' and stage = 'research' and trust_state = 'pit_verified' as h from ({CONTEXTS})) select report_id, missing, n_failed, n_repeated, coalesce(h, false) as historical, missing = '' and n_failed = 0 and n_repeated = 0 and firm = 2 and coalesce(h, false) as may_promote from g left join c using (report_id)")
def a22_promotion_gate(v):
    return audit.promotion_gate(v.sql(CHECKED), v.sql(CONTEXTS)).withColumn("missing", F.array_join("missing", ","))


DATASETS = "select o_orderkey as dataset_id, o_orderpriority || o_orderstatus as domain, cast(o_orderdate as date) as created_at from {orders}"
REPORTS = "select l_orderkey as dataset_id, case when l_linenumber = 7 and l_quantity > 49 then 'failed' else 'passed' end as outcome from {lineitem}"


@query(f"with r as (select dataset_id, max(case when outcome = 'failed' then 1 else 0 end) as f from ({REPORTS}) group by 1), g as (select domain, count(*) as n_datasets, count(r.dataset_id) as n_reported, coalesce(sum(f), 0) as n_failed, max(created_at) as latest from ({DATASETS}) d left join r using (dataset_id) group by 1) select *, case when n_datasets = 0 then 'empty' when n_reported = n_datasets and n_failed = 0 then 'ready' else 'partial' end as state from g")
def a23_dataset_health(v):
    return audit.health(v.sql(DATASETS), v.sql(REPORTS))


BATCH = "select job_id, day, rows_observed, case when job_id = 'view' then null else 20 end as rows_expected, status from {checkpoints}"


@query(f"with g as (select job_id, day, sum(rows_observed) as observed, sum(rows_expected) as expected, count(*) filter (where status = 'failed') as n_failed from ({BATCH}) group by 1, 2), c as (select *, case when expected <> 0 then least(1.0, observed * 1.0 / expected) end as c from g) select job_id, day, observed, expected, n_failed, round(c, 8) as coverage, case when c is null then 'unknown' when c >= 1 then 'full' when c > 0 then 'partial' else 'zero' end as coverage_class from c")
def a25_batch_reports(v):
    return audit.batch_reports(v.sql(BATCH), ["job_id", "day"]).withColumn("coverage", F.round("coverage", 8))


@query("select job_id, status, count(*) as n_rows from {checkpoints} group by 1, 2")
def a26_status_counts(v):
    return audit.status_counts(v.checkpoints, ["job_id"])


LINES = "select o_orderkey % 900 as plan_id, 'd' || cast(o_custkey % 4 as varchar(2)) as domain, 'f' || cast(o_orderkey % 3 as varchar(2)) as field, 'm' || cast(o_custkey % 2 as varchar(2)) as market, o_orderkey % 3 as trust from {orders}"
POLICIES = "select 'd' || cast(n_nationkey % 4 as varchar(2)) as domain, 'f' || cast(n_nationkey % 3 as varchar(2)) as field, 'm' || cast(n_nationkey % 2 as varchar(2)) as market, n_nationkey % 5 <> 0 as allowed, n_nationkey % 3 as ceiling from {nation} where n_nationkey < 11"


@query(f"with x as (select plan_id, list_filter([case when allowed is null then 'missing_capability:' || domain || ':' || field || ':' || market end, case when not allowed then 'use_not_allowed:' || domain || ':' || field || ':' || market end, case when ceiling < trust then 'trust_ceiling:' || domain || ':' || field || ':' || market end], lambda s: s is not null) as b from ({LINES}) l left join ({POLICIES}) p using (domain, field, market)) select plan_id, array_to_string(list_sort(list_distinct(flatten(list(b)))), ',') as blockers, len(flatten(list(b))) = 0 as permitted from x group by 1")
def a27_qualify_plan(v):
    return audit.qualify_plan(v.sql(LINES), v.sql(POLICIES)).withColumn("blockers", F.array_join("blockers", ","))


JOBS = "select distinct job_id from {checkpoints}"
QUALITY = "select job_id, checkpoint_key as report_id, case when max(attempt) % 7 = 0 then 'failed' else 'passed' end as outcome from {checkpoints} where day < date '2024-01-09' group by 1, 2"


@query(f"select job_id, 'checkpoint' as kind, checkpoint_key as item, s as state, null as n from (select job_id, checkpoint_key, arg_max(status, attempt) as s from {{checkpoints}} group by 1, 2) union all select job_id, 'report', report_id, outcome, null from ({QUALITY}) union all select job_id, 'checkpoints', null, s, count(*) from (select job_id, arg_max(status, attempt) as s from {{checkpoints}} group by job_id, checkpoint_key) group by 1, 4 union all select job_id, 'reports', null, outcome, count(*) from ({QUALITY}) group by 1, 4 union all select job_id, 'job', null, null, null from ({JOBS})")
def j19_job_dashboard(v):
    c = v.checkpoints.groupBy("job_id", "checkpoint_key").agg(F.max_by("status", "attempt").alias("status"))
    return audit.dashboard(v.sql(JOBS), c, v.sql(QUALITY))


@query("select fact_id, company_id, available_at from {facts} order by available_at desc, fact_id limit 500")
def k3_bounded_timeline(v):
    return audit.timeline(v.facts.select("fact_id", "company_id", "available_at"), [F.desc("available_at"), "fact_id"], 500)


@query("select upstream_id, downstream_id, relation from {lineage} order by upstream_id, downstream_id, relation")
def k5_ordered_catalog(v):
    return audit.timeline(v.lineage, ["upstream_id", "downstream_id", "relation"])


@query(f"select coalesce(e.job_id, o.job_id) as job_id, coalesce(e.symbol, o.symbol) as symbol, case when o.symbol is null then 'missing' else 'extra' end as kind from ({EXPECTED}) e full join (select distinct job_id, symbol from ({UNIT})) o on o.job_id = e.job_id and o.symbol = e.symbol where e.symbol is null or o.symbol is null")
def u3_reconcile_symbols(v):
    return audit.reconcile_symbols(v.sql(EXPECTED), v.sql(UNIT), ["job_id"])


@query("select symbol, count(distinct job_id) as n_owners from {checkpoints} group by 1 having count(distinct job_id) > 1")
def u3_shared_components(v):
    return audit.shared_components(v.checkpoints, "symbol", "job_id")


@query("select 'dataset' as kind, provider_id as id from {facts} union select 'source', trust_state from {facts} union select 'dataset', cast(listing_id as varchar) from {listings}")
def u4_distinct_id_union(v):
    f = v.facts
    return audit.id_union(f.select(F.lit("dataset").alias("kind"), F.col("provider_id").alias("id")), f.select(F.lit("source").alias("kind"), F.col("trust_state").alias("id")), v.listings.select(F.lit("dataset").alias("kind"), F.col("listing_id").cast("string").alias("id")))


USED = "select o_custkey as artifact_id, 'd' || cast(o_orderkey % 12 as varchar(4)) as dataset_id from {orders}"
APPROVED = "select o_custkey as artifact_id, 'd' || cast(o_orderkey % 11 as varchar(4)) as dataset_id from {orders} where o_custkey % 10 <> 4"


@query(f"with u as (select distinct * from ({USED})), a as (select distinct * from ({APPROVED})) select u.artifact_id, coalesce(string_agg(u.dataset_id, ',' order by u.dataset_id) filter (where a.dataset_id is null), '') as unapproved, count(*) filter (where a.dataset_id is null) = 0 as closed from u left join a on a.artifact_id = u.artifact_id and a.dataset_id = u.dataset_id group by 1")
def u5_lineage_closure(v):
    return audit.lineage_closure(v.sql(USED), v.sql(APPROVED), "artifact_id").withColumn("unapproved", F.array_join("unapproved", ","))


IDS = "select 'd' || cast(o_orderkey as varchar(12)) as id from {orders} where o_orderkey % 7 = 0"


@query(f"select * from {{lineage}} where downstream_id in (select id from ({IDS}))")
def u6_upstream_lineage(v):
    return audit.upstream(v.lineage, v.sql(IDS))


CLOSURE = "with recursive up(id, ancestor_id, depth) as (select i.id, e.upstream_id, 1 from (select distinct id from ({ids})) i join {lineage} e on e.downstream_id = i.id union select up.id, e.upstream_id, depth + 1 from up join {lineage} e on e.downstream_id = up.ancestor_id), c as (select id, ancestor_id, cast(min(depth) as int) as depth from up group by 1, 2)"


@query(CLOSURE.replace("{ids}", IDS) + " select *, id = ancestor_id as cyclic from c")
def u6_upstream_closure(v):
    return audit.upstream_closure(v.lineage, v.sql(IDS))


BUILT = "select o_custkey as artifact_id, 'd' || cast(o_orderkey as varchar(12)) as dataset_id from {orders} where o_orderkey % 3 = 0"
CLEARED = "select o_custkey as artifact_id, 'd' || cast(o_orderkey as varchar(12)) as dataset_id from {orders} union all select o_custkey, 'd' || cast((o_orderkey - 1) // 2 as varchar(12)) from {orders} where o_orderkey % 2 = 1 and o_orderkey % 5 <> 2"


@query(CLOSURE.replace("{ids}", "select dataset_id as id from (" + BUILT + ")") + f", b as (select distinct * from ({BUILT})), u as (select * from b union select artifact_id, ancestor_id from b join c on c.id = b.dataset_id), a as (select distinct * from ({CLEARED})) select u.artifact_id, coalesce(string_agg(u.dataset_id, ',' order by u.dataset_id) filter (where a.dataset_id is null), '') as unapproved, count(*) filter (where a.dataset_id is null) = 0 as closed from u left join a on a.artifact_id = u.artifact_id and a.dataset_id = u.dataset_id group by 1")
def u5_evidence_closure(v):
    return audit.evidence_closure(v.sql(BUILT), v.sql(CLEARED.replace("//", "div")), v.lineage, "artifact_id").withColumn("unapproved", F.array_join("unapproved", ","))


BUILDS = "select o_orderkey as dataset_id, o_orderdate as created_at from {orders}"
FINDINGS = "select l_orderkey as dataset_id, case when l_linenumber = 7 and l_quantity > 49 then 1 else 0 end as checks_failed from {lineitem}"
RUNS = "select event_type || ':' || cast(user_id as varchar(12)) as job_id, case when max(value) > 99 then 'failed' else 'succeeded' end as status, max(ts) as updated_at, count(*) % 5 as k from {events} group by 1"
DECIDED = "select c_custkey as review_id, date '2020-01-01' + cast(c_custkey % 700 as int) as decided_at from {customer} where c_acctbal < 0"
FORECASTS = "select listing_id * 100000 + year(session_date) * 12 + month(session_date) as forecast_id, session_date as effective_session, case when volume > 60 then least(1.0, 100.0 / volume) end as passive_exposure from {bars}"


@query(f"""with r as (select dataset_id, count(*) filter (where checks_failed > 0) as failed from ({FINDINGS}) group by 1), d as (select count(*) as n, count(*) - count(r.dataset_id) + coalesce(sum(failed), 0) as flagged, max(created_at) as newest from ({BUILDS}) b left join r using (dataset_id)), j as (select * from ({RUNS}) where status = 'failed' or k = 0)
    select 'data_health' as section, case when n = 0 then 'empty' when flagged = 0 then 'ready' else 'partial' end as status, n as n_rows, cast(flagged as bigint) as n_flagged, newest from d
    union all select 'active_failures', case when count(*) = 0 then 'empty' else 'partial' end, count(*), count(*), max(updated_at) from j union all select 'pending_tasks', case when count(*) = 0 then 'empty' else 'partial' end, count(*), 0, max(decided_at) from ({DECIDED})
    union all select 'timing_shadow', case when count(*) = 0 then 'empty' else 'partial' end, count(*), count(*) filter (where passive_exposure is null), max(effective_session) from ({FORECASTS})""")
def a23_desk_sections(v):
    jobs = v.sql(RUNS).withColumn("failure_reasons", F.when(F.col("k") == 0, F.array(F.lit("timeout"))))
    out = audit.desk_sections(v.sql(BUILDS), v.sql(FINDINGS), jobs, v.sql(DECIDED), v.sql(FORECASTS))
    return out.withColumn("newest", F.col("newest").cast("timestamp_ntz"))


DRAFTS = "select o_orderkey as plan_id, 'p' || cast(o_custkey % 6 as varchar(9)) as provider_id, 'v' || cast(1 + o_orderkey % 2 as varchar(9)) as profile_version, o_custkey % 400 as bucket_size, o_orderkey % 7 <> 0 as bulk_acknowledged from {orders}"
OFFERS = "select 'p' || cast(n_nationkey as varchar(9)) as provider_id, 'v' || cast(1 + n_nationkey % 2 as varchar(9)) as version, 300 + n_nationkey as row_limit, n_nationkey <> 3 as bulk_allowed from {nation} where n_nationkey < 5"
REACH = "select 'p' || cast(n_nationkey % 5 as varchar(9)) as provider_id, case when n_nationkey % 3 = 0 then 'XSHE' else 'XSHG' end as market, case n_nationkey % 4 when 0 then 'income' when 1 then 'balance' else 'cash' end as statement from {nation}"
ASKED = "select l_orderkey as plan_id, case when l_linenumber % 2 = 0 then 'XSHE' else 'XSHG' end as market, case when l_quantity < 20 then 'income' when l_quantity < 35 then 'balance' else 'cash' end as statement from {lineitem}"


@query(f"""with p as (select d.*, version, row_limit, bulk_allowed from ({DRAFTS}) d left join ({OFFERS}) o using (provider_id)), b as (select plan_id, 'provider_unknown' as blocker from p where version is null union all select plan_id, 'profile_version' from p where version <> profile_version union all select plan_id, 'bulk_not_acknowledged' from p where not bulk_acknowledged
    union all select plan_id, 'bucket_exceeds_row_limit' from p where bucket_size > row_limit union all select plan_id, 'bulk_not_allowed' from p where not bulk_allowed union all select distinct a.plan_id, 'not_covered:' || a.market || ':' || a.statement from ({ASKED}) a join p using (plan_id) left join (select distinct * from ({REACH})) r on r.provider_id = p.provider_id and r.market = a.market and r.statement = a.statement where r.provider_id is null)
    select p.plan_id, coalesce(string_agg(blocker, ',' order by blocker), '') as blockers, count(blocker) = 0 as permitted from p left join b using (plan_id) group by 1""")
def a27_financial_plan(v):
    return audit.qualify_financial_plan(v.sql(DRAFTS), v.sql(OFFERS), v.sql(REACH), v.sql(ASKED)).withColumn("blockers", F.array_join("blockers", ","))
