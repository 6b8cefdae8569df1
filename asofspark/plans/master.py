"""Queries: security master, universes and data checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofspark.operators import checks, identity, universe

from .testdata import Registry

query = Registry()

DATES = "select date '1996-06-01' as as_of union all select date '1999-07-01' union all select date '2000-03-01'"
IDENT = "select l.listing_id, d.as_of, arg_max(h.identifier, (case when h.valid_to is null or d.as_of < h.valid_to then 1 else 0 end, h.valid_from, h.identifier)) as v from {listings} l cross join (" + DATES + ") d join {identifiers} h on h.listing_id = l.listing_id and h.kind = 'KIND' and h.valid_from <= d.as_of where h.valid_from < d.as_of or h.valid_to is null or d.as_of < h.valid_to group by 1, 2"


PHASES = """select s_suppkey as listing_id, date '1995-01-01' as valid_from, case when s_suppkey % 3 = 0 then date '1997-06-01' end as valid_to, 'listed' as listing_state, case when s_suppkey % 4 = 0 then 'none' end as special_treatment from {supplier}
    union all select s_suppkey, date '1997-06-01', cast(null as date), case when s_suppkey % 2 = 0 then 'suspended' else 'listed' end, case when s_suppkey % 6 = 0 then 'star_st' else 'st' end from {supplier} where s_suppkey % 3 = 0 and s_suppkey % 12 <> 9"""


SNAPSHOT = """select d.as_of, l.listing_id, s.security_id, c.company_id, c.company_name, l.exchange, i.v as code, n.v as name, coalesce(x.industries, '') as industries, p.listing_state, p.special_treatment from {listings} l cross join (""" + DATES + """) d join {securities} s on s.security_id = l.security_id join {companies} c on c.company_id = s.company_id
    left join (""" + IDENT.replace("KIND", "code") + """) i on i.listing_id = l.listing_id and i.as_of = d.as_of left join (""" + IDENT.replace("KIND", "name") + """) n on n.listing_id = l.listing_id and n.as_of = d.as_of
    left join (select security_id, d.as_of, string_agg(distinct industry_code, ',' order by industry_code) as industries from {industries} cross join (""" + DATES + """) d where valid_from <= d.as_of and (valid_to is null or d.as_of < valid_to) group by 1, 2) x on x.security_id = s.security_id and x.as_of = d.as_of
    left join (""" + PHASES + """) p on p.listing_id = l.listing_id and p.valid_from <= d.as_of and (p.valid_to is null or d.as_of < p.valid_to)
    where l.listed_on <= d.as_of and (l.delisted_on is null or d.as_of <= l.delisted_on)"""
TRADED_DAYS = "select distinct session_date as as_of from {bars_daily}"


@query(SNAPSHOT)
def j1_j3_identity_snapshot(v):
    return identity.snapshot(v.companies, v.securities, v.listings, v.identifiers, v.industries, v.sql(DATES), v.sql(PHASES)).withColumn("industries", F.array_join("industries", ","))


@query(SNAPSHOT.replace(DATES, TRADED_DAYS))
def j1_all_sessions(v):
    return identity.snapshot(v.companies, v.securities, v.listings, v.identifiers, v.industries, v.sql(TRADED_DAYS), v.sql(PHASES)).withColumn("industries", F.array_join("industries", ","))


CODES = "select case when o_custkey % 2 = 0 then 'E' else 'O' end as exchange, lpad(cast(case when o_orderkey % 3 = 0 then 5000 + o_custkey % 120 else o_custkey % 100 end as varchar(9)), 6, '0') as code, cast(o_orderdate as date) as as_of from {orders}"


@query("""select q.exchange, q.code, q.as_of, case when count(distinct h.listing_id) = 1 then min(h.listing_id) end as listing_id, case count(distinct h.listing_id) when 1 then 'resolved' when 0 then 'not_found' else 'ambiguous' end as status from (select distinct * from (""" + CODES + """)) q
    left join (select i.*, l.exchange from {identifiers} i join {listings} l using (listing_id) where kind = 'code') h on h.exchange = q.exchange and h.identifier = q.code and h.valid_from <= q.as_of and (h.valid_to is null or q.as_of < h.valid_to) group by 1, 2, 3""")
def j4_resolve_listing(v):
    return identity.resolve_listing(v.sql(CODES), v.listings, v.identifiers)


ASK = "select distinct case when o_orderkey % 2 = 0 then 'p1' else 'p2' end as provider, lpad(cast(o_custkey % 140 as varchar(9)), 6, '0') as code, cast(date_trunc('month', o_orderdate) as date) as as_of from {orders}"
CORRECTED = "select 'p1' as provider, lpad(cast(s_suppkey as varchar(9)), 6, '0') as code, s_suppkey + 1 as listing_id, date '1996-01-01' as valid_from, cast(null as date) as valid_to from {supplier} where s_suppkey % 9 = 0"
ALIAS = "select lpad(cast(s_suppkey as varchar(9)), 6, '0') as code, s_suppkey as listing_id, date '1995-01-01' as valid_from, case when s_suppkey % 2 = 0 then date '1998-01-01' end as valid_to from {supplier} where s_suppkey % 7 = 0"
HISTORY = "select identifier as code, listing_id, valid_from, valid_to from {identifiers} where kind = 'code' and listing_id % 3 <> 0"
NOW = "select lpad(cast(s_suppkey as varchar(9)), 6, '0') as code, s_suppkey as listing_id from {supplier}"


def _count(table: str, provider: str = "") -> str:
    live = "t.valid_from <= a.as_of and (t.valid_to is null or a.as_of < t.valid_to)"
    return f"select a.provider, a.code, a.as_of, count(distinct case when {live} then t.listing_id end) as n, min(case when {live} then t.listing_id end) as l from ({ASK}) a join ({table}) t on t.code = a.code {provider} group by 1, 2, 3"


@query(f"""with x as (select a.*, c.n as cn, c.l as cl, s.n as an, s.l as al, coalesce(h.n, 0) as hn, h.l as hl, coalesce(w.n, 0) as wn, w.l as wl from ({ASK}) a left join ({_count(CORRECTED, "and t.provider = a.provider")}) c using (provider, code, as_of) left join ({_count(ALIAS)}) s using (provider, code, as_of)
    left join ({_count(HISTORY)}) h using (provider, code, as_of) left join (select code, count(distinct listing_id) as n, min(listing_id) as l from ({NOW}) group by 1) w using (code)),
    y as (select *, case when cn = 1 then 'correction' when cn > 1 then 'ambiguous' when cn = 0 then 'correction_not_effective' when an = 1 then 'alias' when an > 1 then 'ambiguous' when an = 0 then 'alias_not_effective' when hn = 1 then 'history' when hn > 1 then 'ambiguous' when wn = 1 then 'current' when wn > 1 then 'ambiguous' else 'not_found' end as how from x)
    select provider, code, as_of, case how when 'correction' then cl when 'alias' then al when 'history' then hl when 'current' then wl end as listing_id, how, case when how = 'current' then 'resolved_by_current_listing' end as warning from y""")
def j2_resolve_code(v):
    return identity.resolve(v.sql(ASK), v.sql(CORRECTED), v.sql(ALIAS), v.sql(HISTORY), v.sql(NOW))


BASIC = "select s_suppkey as code, case when s_suppkey % 19 = 4 then null else s_name end as legal_name from {supplier}"
KINDS = "select s_suppkey as code, case when s_suppkey % 5 = 1 then null else 'I' || cast(s_nationkey as varchar(9)) end as industry_code, case when s_suppkey % 10 = 1 then null else 'name' end as industry_name from {supplier} where s_suppkey % 8 <> 3"


@query(f"""with x as (select b.code, legal_name, industry_code, industry_name, (industry_code is null) <> (industry_name is null) as half, legal_name is null as rejected from ({BASIC}) b left join ({KINDS}) k using (code)), y as (select code, legal_name, case when not half then industry_code end as industry_code, case when not half then industry_name end as industry_name, half as partial_classification, rejected from x)
    select y.*, (select avg(case when industry_code is not null then 1.0 else 0.0 end) >= 0.7 from y where not rejected) as coverage_ok from y""")
def s20_security_master(v):
    return identity.build_master(v.sql(BASIC), v.sql(KINDS), 0.7)


# -- universes ----------------------------------------------------------------------------------------------------

SESSIONS = "select universe_id, session_date, row_number() over (partition by universe_id order by session_date) as i, lead(session_date) over (partition by universe_id order by session_date) as nxt from (select distinct universe_id, session_date from {daily_members})"


@query(f"with s as ({SESSIONS}), r as (select m.universe_id, m.listing_id, m.session_date, s.i, s.nxt, s.i - row_number() over (partition by m.universe_id, m.listing_id order by s.i) as g from {{daily_members}} m join s using (universe_id, session_date)) select universe_id, listing_id, min(session_date) as valid_from, arg_max(coalesce(nxt, cast(session_date + interval 1 day as date)), i) as valid_to from r group by universe_id, listing_id, g")
def s11_membership_intervals(v):
    return universe.intervals_from_snapshots(v.daily_members)


@query("select universe_id, listing_id, session_date as valid_from, cast(session_date + interval 1 day as date) as valid_to from {daily_members} where (universe_id, session_date) in (select universe_id, max(session_date) from {daily_members} group by universe_id, date_trunc('week', session_date))")
def s12_month_end_snapshots(v):
    return universe.month_end_snapshots(v.daily_members, "week")


SPARSE = "select universe_id, session_date from {daily_members} where day(session_date) % 5 <> 0"


@query(f"with d as (select distinct universe_id, session_date as d from ({SPARSE})), g as (select universe_id, cast(d + interval 1 day as date) as gap_from, coalesce(lead(d) over (partition by universe_id order by d), date '2024-02-05') as gap_to from d union all select universe_id, date '2023-12-28', min(d) from d group by 1) select * from g where gap_from < gap_to")
def s12_n15_unobserved_intervals(v):
    return universe.unobserved_intervals(v.sql(SPARSE), "2023-12-28", "2024-02-05")


STEPS = f"""with s as ({SESSIONS}), m as (select distinct m.universe_id, listing_id, i from {{daily_members}} m join s using (universe_id, session_date)), p as (select coalesce(a.universe_id, b.universe_id) as universe_id, coalesce(a.i, b.i + 1) as i, a.listing_id as x, b.listing_id as y from m a full join m b on a.universe_id = b.universe_id and a.listing_id = b.listing_id and a.i = b.i + 1),
    g as (select universe_id, i, count(x) as members, count(y) as before, count(x) filter (where y is null) as entries, count(y) filter (where x is null) as exits from p group by 1, 2)
    select universe_id, session_date, members, entries, exits, round((entries + exits) * 1.0 / greatest(members, before, 1), 8) as change_ratio from g join s using (universe_id, i) where i > 1"""


@query(STEPS)
def u2_membership_steps(v):
    return universe.steps(v.daily_members).withColumn("change_ratio", F.round("change_ratio", 8))


@query(f"select universe_id, session_date, rule from ({STEPS}), (values ('cardinality_out_of_range'), ('change_too_large')) r(rule) where (rule = 'cardinality_out_of_range' and not members between 28 and 60) or (rule = 'change_too_large' and change_ratio > 0.2)")
def f14_membership_gates(v):
    return checks.membership_gates(universe.steps(v.daily_members), 28, 60, 0.2)


NAMES = "select c_custkey as listing_id, c_name as name, c_mktsegment as industry from {customer} where c_custkey % 5 <> 1"
SNAP = f"select universe_id, listing_id, research_eligible, tradable_eligible, name is not null as identity_resolved, name, industry from {{memberships}} left join ({NAMES}) using (listing_id) where valid_from <= date 'DAY' and (valid_to is null or date 'DAY' < valid_to)"


@query(SNAP.replace("DAY", "2024-01-10"))
def j5_universe_snapshot(v):
    return universe.snapshot(v.memberships, v.sql(NAMES), "2024-01-10")


FLAGS = "select universe_id, listing_id, valid_from, cast(case when listing_id % 3 = 0 then valid_from + interval 9 day else valid_to end as date) as valid_to, research_eligible, tradable_eligible from {memberships} union all select universe_id, listing_id, cast(valid_from + interval 9 day as date), valid_to, not research_eligible, tradable_eligible from {memberships} where listing_id % 3 = 0"


@query(f"with m as ({FLAGS}), a as (" + SNAP.replace("DAY", "2024-01-04").replace("{memberships}", "m") + "), b as (" + SNAP.replace("DAY", "2024-01-20").replace("{memberships}", "m") + """) select universe_id, listing_id, case when a.research_eligible is null then 'added' when b.research_eligible is null then 'removed' else 'changed' end as change from a full join b using (universe_id, listing_id)
    where a.research_eligible is null or b.research_eligible is null or a.research_eligible <> b.research_eligible or a.tradable_eligible <> b.tradable_eligible""")
def u1_universe_diff(v):
    return universe.diff(v.sql(FLAGS), v.sql(NAMES), "2024-01-04", "2024-01-20")


@query("select universe_id, count(*) as members, count(*) filter (where identity_resolved) as resolved, count(*) filter (where research_eligible) as research, count(*) filter (where tradable_eligible) as tradable, round(count(*) filter (where identity_resolved) * 1.0 / count(*), 8) as resolved_ratio from (" + SNAP.replace("DAY", "2024-01-10") + ") group by 1")
def a18_universe_coverage(v):
    return universe.coverage(universe.snapshot(v.memberships, v.sql(NAMES), "2024-01-10")).withColumn("resolved_ratio", F.round("resolved_ratio", 8))


VERSIONS = "select o_custkey as definition_id, o_orderkey as version_id, cast(o_orderdate as date) as created_at from {orders}"


@query(f"select definition_id, version_id, created_at from (select *, row_number() over (partition by definition_id order by created_at desc, version_id desc) as n from ({VERSIONS})) where n = 1")
def n5_latest_versions(v):
    return universe.latest_versions(v.sql(VERSIONS), ["definition_id"], "created_at", "version_id")


ASKED = "select distinct 'u' || cast(user_id % 4 as varchar(9)) as universe_id, cast(ts as date) as as_of from {events}"


@query(f"select * from ({ASKED}) q where exists (select 1 from {{memberships}} m where m.universe_id = q.universe_id and m.valid_from <= q.as_of and (m.valid_to is null or q.as_of < m.valid_to))")
def j16_has_active_universe(v):
    return universe.has_active(v.sql(ASKED), v.memberships)


# -- checks -------------------------------------------------------------------------------------------------------


def _rules_sql(rows: str, key: str, rules: dict[str, str]) -> str:
    return " union all ".join(f"select {key}, '{n}' as rule from ({rows}) where {c}" for n, c in rules.items())


BARS = "select l_orderkey as k, l_linenumber as n, l_extendedprice / l_quantity as open, l_extendedprice / l_quantity + l_discount - 0.08 as high, case when l_orderkey % 37 = 5 then null else l_extendedprice / l_quantity - l_tax + 0.01 end as low, l_extendedprice / l_quantity - 0.03 as close, l_extendedprice / l_quantity - 1000 as previous_close, case when l_orderkey % 41 = 6 then null else cast(l_quantity - 3 as bigint) end as volume, l_extendedprice - 2000 as amount, case when l_returnflag = 'R' then 'cny' when l_returnflag = 'A' and l_orderkey % 43 = 1 then null else 'CNY' end as currency from {lineitem}"


@query(_rules_sql(BARS, "k, n", {"missing_price": "open is null or high is null or low is null or close is null", "non_positive_previous_close": "previous_close <= 0", "missing_volume": "volume is null", "non_positive_price": "least(open, high, low, close) <= 0", "high_below_range": "high < greatest(open, low, close)", "low_above_range": "low > least(open, high, close)", "negative_volume": "volume < 0", "negative_amount": "amount < 0", "bad_currency": "not coalesce(regexp_matches(currency, '^[A-Z][A-Z][A-Z]$'), false)"}))
def f1_bar_rules(v):
    return checks.violations(v.sql(BARS), ["k", "n"], checks.bar_rules())


@query(_rules_sql("select * from {states}", "listing_id, session_date", {"trading_and_suspended": "is_trading and is_suspended", "terminated_trades": "listing_state = 'terminated' and is_trading"}))
def f2_state_rules(v):
    return checks.violations(v.states, ["listing_id", "session_date"], checks.state_rules())


SHARES = "select listing_id, session_date, volume as total_shares, case when volume % 5 = 0 then null else volume + volume % 7 - 4 end as circulating_shares, case when volume % 3 = 0 then volume - 2 end as free_float_shares, volume % 4 as restricted_shares from {bars}"


@query(_rules_sql(SHARES, "listing_id, session_date", {"circulating_above_total": "circulating_shares > total_shares", "float_without_circulating": "free_float_shares is not null and circulating_shares is null", "float_above_circulating": "free_float_shares > circulating_shares", "parts_above_total": "circulating_shares + restricted_shares > total_shares"}))
def f3_capital_rules(v):
    return checks.violations(v.sql(SHARES), ["listing_id", "session_date"], checks.capital_rules())


ACTIONS = "select o_orderkey as action_id, case o_orderkey % 3 when 0 then 'cash_dividend' when 1 then 'stock_dividend' else 'rights' end as action_type, cast(o_orderdate as date) as ex_date, cast(o_orderdate as date) + cast(o_orderkey % 5 - 3 as int) as record_date, case when o_orderstatus = 'F' then 0.5 end as cash_per_share, case when o_orderstatus <> 'O' then 0.1 end as share_ratio, case when o_orderpriority = '5-LOW' then 3.0 end as subscription_price from {orders}"


@query(_rules_sql(ACTIONS, "action_id", {"record_after_ex": "record_date > ex_date", "cash_dividend_without_cash": "action_type = 'cash_dividend' and cash_per_share is null", "stock_dividend_without_ratio": "action_type = 'stock_dividend' and share_ratio is null", "rights_incomplete": "action_type = 'rights' and (share_ratio is null or subscription_price is null)"}))
def f4_action_rules(v):
    return checks.violations(v.sql(ACTIONS), ["action_id"], checks.action_rules())


REASONS = "select universe_id, listing_id, research_eligible, tradable_eligible, case when listing_id % 5 = 0 then 'size' end as why_in, case when listing_id % 2 = 0 then 'suspended' end as why_out from {memberships}"


@query(_rules_sql(REASONS, "universe_id, listing_id", {"tradable_not_research": "tradable_eligible and not research_eligible", "research_without_reason": "research_eligible and why_in is null", "untradable_without_reason": "not tradable_eligible and why_out is null"}))
def f15_membership_flags(v):
    rows = v.sql(REASONS).withColumns({"inclusion_reasons": F.array_compact(F.array("why_in")), "exclusion_reasons": F.array_compact(F.array("why_out"))})
    return checks.violations(rows, ["universe_id", "listing_id"], checks.membership_rules())


VIEWS = "select view_id, p10, case when view_id % 7 = 0 then p90 + 1 else p50 end as p50, p90, case when view_id % 10 = 3 then p90 + 1 else expected_return end as expected_return, case when view_id % 11 = 0 then 9.0 else p10 end as downside, coalesce(s, 0) as component_sum, 0.0 as residual from {views} left join (select view_id, sum(contribution) as s from {components} group by 1) c using (view_id)"


@query(_rules_sql(VIEWS, "view_id", {"quantiles_out_of_order": "not (p10 <= p50 and p50 <= p90)", "point_outside_interval": "not expected_return between p10 and p90", "downside_above_point": "downside > expected_return", "not_reconciled": "abs(component_sum + residual - expected_return) > 0.02"}))
def f17_view_consistency(v):
    return checks.violations(v.sql(VIEWS), ["view_id"], checks.view_rules(0.02))


SPLITS = "select o_orderkey as run_id, cast(o_orderdate as date) as train_start, cast(o_orderdate as date) + cast(o_orderkey % 50 as int) as train_end, cast(o_orderdate as date) + 45 as validation_start, cast(o_orderdate as date) + cast(60 + o_orderkey % 9 as int) as validation_end, cast(o_orderdate as date) + 64 as test_start, cast(o_orderdate as date) + cast(60 + o_orderkey % 30 as int) as test_end from {orders}"


@query(_rules_sql(SPLITS, "run_id", {"empty_window": "train_start >= train_end or validation_start >= validation_end or test_start >= test_end", "train_overlaps_validation": "train_end > validation_start", "validation_overlaps_test": "validation_end > test_start"}))
def f18_time_splits(v):
    return checks.violations(v.sql(SPLITS), ["run_id"], checks.split_rules())


CLOSES = "select o_custkey as k, o_orderkey as n, cast(o_orderdate as date) as d, o_totalprice - 3000 as c from {orders}"


@query("select k, n, r.rule from (select *, lag(d) over (partition by k order by n) as p from (" + CLOSES + ")) x, (values ('session_not_increasing'), ('non_positive_close')) r(rule) where (rule = 'session_not_increasing' and d <= p) or (rule = 'non_positive_close' and c <= 0)")
def f19_monotone_sessions(v):
    return checks.monotone_sessions(v.sql(CLOSES), "k", "d", "c", "n")


UNIVERSES = "select o_orderkey as version_id, case when o_orderstatus = 'F' then 'pit_verified' else 'normalized_current' end as trust_state, case when o_orderkey % 4 < 2 then o_orderdate end as available_at, case when o_orderkey % 3 = 0 then 'discrete' else 'continuous' end as mode, case when o_orderkey % 2 = 0 then cast(o_orderdate as date) end as seen, cast(o_orderdate as date) as gap_start, cast(o_orderdate as date) + cast(o_orderkey % 4 as int) as gap_end from {orders}"


@query(_rules_sql(UNIVERSES, "version_id", {"pit_without_available_at": "trust_state = 'pit_verified' and available_at is null", "non_pit_with_available_at": "trust_state <> 'pit_verified' and available_at is not null", "discrete_without_dates": "mode = 'discrete' and seen is null", "gap_not_forward": "gap_end <= gap_start"}))
def f20_universe_versions(v):
    rows = v.sql(UNIVERSES).withColumns({"observed_dates": F.array_compact(F.array("seen")), "gaps": F.array(F.struct(F.col("gap_start").alias("start"), F.col("gap_end").alias("end")))})
    return checks.violations(rows, ["version_id"], checks.universe_version_rules())


OUTCOMES = "select v.view_id, v.security_id as view_security_id, case when v.view_id % 13 = 0 then o.security_id + 1 else o.security_id end as security_id, v.decision_date as decision_at, cast(o.realized_at as date) - cast(v.view_id % 70 as int) as realized_at, cast(o.realized_at as date) - cast(v.view_id % 66 as int) as source_available_at, cast(o.realized_at as date) - 20 as recorded_at from {outcomes} o join {views} v using (view_id)"


@query(_rules_sql(OUTCOMES, "view_id", {"realized_before_decision": "realized_at <= decision_at", "source_before_realized": "source_available_at < realized_at", "recorded_before_source": "recorded_at < source_available_at", "identity_differs": "security_id is distinct from view_security_id"}))
def f21_outcome_clocks(v):
    return checks.violations(v.sql(OUTCOMES), ["view_id"], checks.outcome_rules())


SIGNALS = "select snapshot_id, security_id, rank, universe_size, case when security_id % 6 = 0 then rank - 5 end as previous_rank, score * 25 as confidence, decision_date as decision_time, decision_date + cast(security_id % 5 - 3 as int) as cutoff, decision_date + cast(security_id % 7 - 1 as int) as created_at, case security_id % 4 when 0 then 20 when 1 then 60 when 2 then 120 else 30 end as horizon from {screens}"


@query(_rules_sql(SIGNALS, "snapshot_id, security_id", {"rank_out_of_range": "not rank between 1 and universe_size", "previous_rank_out_of_range": "not previous_rank between 1 and universe_size", "confidence_out_of_range": "not confidence between 0 and 1", "clock_out_of_order": "cutoff > decision_time or decision_time > created_at", "unknown_horizon": "horizon not in (20, 60, 120)"}))
def f22_signal_rules(v):
    return checks.violations(v.sql(SIGNALS), ["snapshot_id", "security_id"], checks.signal_rules())


FORECASTS = "select event_id as forecast_id, case user_id % 5 when 0 then 1 when 1 then 5 when 2 then 20 when 3 then 60 else 10 end as horizon, value / 100 - 0.1 as p10, value / 90 - 0.1 as p50, value / 80 - 0.09 - user_id % 3 * 0.05 as p90, value / 50 as exposure, value as lower_bound, value + user_id % 7 - 1 as upper_bound, ts as decision_time, ts - interval 1 hour as cutoff, ts + interval 1 hour as created_at, cast(ts as date) as session_date, case when event_type = 'error' then 'unavailable' else 'quantified' end as status from {events}"


@query(_rules_sql(FORECASTS, "forecast_id", {"unknown_horizon": "horizon not in (1, 5, 20, 60)", "quantiles_out_of_order": "p10 > p50 or p50 > p90", "ratio_out_of_range": "not exposure between 0 and 1", "bounds_out_of_order": "lower_bound > upper_bound", "clock_out_of_order": "cutoff > decision_time or decision_time > created_at", "session_not_local_date": "cast(decision_time + interval 8 hour as date) <> session_date", "unavailable_with_numbers": "status = 'unavailable' and (p10 is not null or p50 is not null or p90 is not null)"}))
def f23_forecast_rules(v):
    return checks.violations(v.sql(FORECASTS).withColumn("decision_time", F.col("decision_time").cast("timestamp")).withColumn("cutoff", F.col("cutoff").cast("timestamp")).withColumn("created_at", F.col("created_at").cast("timestamp")), ["forecast_id"], checks.forecast_rules())


@query("select l_orderkey, l_linenumber, count(*) as n_rows from {lineitem} group by 1, 2 having count(*) > 1")
def f9_duplicate_keys(v):
    return checks.duplicates(v.lineitem, ["l_orderkey", "l_linenumber"])


@query("select o_orderkey, o_custkey from {orders} where o_custkey not in (select c_custkey from {customer} where c_acctbal > 0)")
def f12_orphans(v):
    return checks.orphans(v.orders.select("o_orderkey", "o_custkey"), v.customer.where("c_acctbal > 0"), "o_custkey", "c_custkey")


@query("select l_suppkey, count(distinct l_returnflag) as n_l_returnflag, count(distinct l_linestatus) as n_l_linestatus from {lineitem} where l_shipdate < date '1995-02-10' group by 1 having count(distinct l_returnflag) > 1 or count(distinct l_linestatus) > 1")
def f11_single_version(v):
    return checks.single_version(v.lineitem.where("l_shipdate < date '1995-02-10'"), ["l_suppkey"], ["l_returnflag", "l_linestatus"])


TERMS = "select 'r1' as rule_id, 'block' as severity, 100000.0E0 as tolerance, 'revenue' as m1, 0.1E0 as c1, 'profit' as m2, -1.0E0 as c2 union all select 'r2', 'warn', 0.2E0, 'margin', 1.0E0, 'margin', 0.0E0"


@query("""with t as (select rule_id, severity, tolerance, 2 as k, m1 as metric, c1 as coef from (""" + TERMS + """) union all select rule_id, severity, tolerance, 2, m2, c2 from (""" + TERMS + """)), g as (select entity_id, q, rule_id, severity, tolerance, k, count(value) as n, sum(coef * value) as residual, string_agg(distinct metric, ',' order by metric) as present from {metrics} join t using (metric) group by 1, 2, 3, 4, 5, 6)
    select entity_id, q, rule_id, case when n = k then round(residual, 6) end as residual, present, case when n <> k then 'unavailable' when abs(residual) <= tolerance then 'passed' else 'failed' end as status, severity = 'block' and not (n = k and abs(residual) <= tolerance) as blocks from g""")
def f8_linear_rules(v):
    rules = v.sql(TERMS).select("rule_id", "severity", "tolerance", F.array(F.struct(F.col("m1").alias("metric"), F.col("c1").alias("coef")), F.struct(F.col("m2").alias("metric"), F.col("c2").alias("coef"))).alias("terms"))
    return checks.linear_rules(v.metrics, rules, ["entity_id", "q"]).withColumns({"residual": F.round("residual", 6), "present": F.array_join("present", ",")})


CHAIN = "select o_custkey as document_key, row_number() over (partition by o_custkey order by o_orderkey) - case when o_custkey % 9 = 0 then 0 else 1 end as version_sequence, o_orderkey as disclosure_id, case when o_orderkey % 5 = 0 then null else lag(o_orderkey) over (partition by o_custkey order by o_orderkey) end as supersedes_id, cast(o_orderdate as date) as published_at, o_custkey % 50 + case when o_orderkey % 97 = 0 then 1 else 0 end as company_id, cast(o_orderdate as date) + cast(o_orderkey % 4 - 1 as int) as available_at, cast(o_orderdate as date) + 1 as first_tradable_at, case when o_orderstatus = 'F' then 'published' else 'corrected' end as status from {orders}"


@query("with x as (select *, lag(version_sequence) over w as pv, lag(disclosure_id) over w as pd, lag(published_at) over w as pp, lag(company_id) over w as pc from (" + CHAIN + ") window w as (partition by document_key order by version_sequence, disclosure_id)) " + " union all ".join(f"select document_key, version_sequence, '{n}' as rule from x where {c}" for n, c in {"does_not_start_at_zero": "pv is null and version_sequence <> 0", "sequence_gap": "pv is not null and version_sequence <> pv + 1", "wrong_supersedes": "supersedes_id is distinct from pd", "published_before_previous": "published_at < pp", "identity_changed": "pv is not null and company_id is distinct from pc", "available_before_published": "available_at < published_at", "tradable_before_available": "first_tradable_at < available_at", "wrong_status": "case when version_sequence = 0 then status <> 'published' else status not in ('corrected', 'withdrawn') end"}.items()))
def f13_disclosure_chain(v):
    return checks.disclosure_chain(v.sql(CHAIN))


LIFE = "select user_id as factor_id, event_id as sequence, ts - (event_id % 50 // 49) * interval 30 day as occurred_at, coalesce(lag(event_type) over (partition by user_id order by event_id), 'signup') as f, case when event_type = 'purchase' then 'production' else event_type end as to_status, value > 10 as approved from {events}"
ALLOWED = "select 'signup' as from_status, 'click' as to_status union all select 'click', 'view' union all select 'view', 'production' union all select 'production', 'click' union all select 'error', 'view'"


@query("with x as (select factor_id, sequence, occurred_at, case when f = 'purchase' and sequence % 3 > 0 then 'production' else f end as from_status, to_status, approved from (" + LIFE + ")), y as (select x.*, a.from_status is not null as ok, lag(x.to_status) over w as p, lag(occurred_at) over w as b from x left join (" + ALLOWED + ") a on a.from_status = x.from_status and a.to_status = x.to_status window w as (partition by factor_id order by sequence)) " + " union all ".join(f"select factor_id, sequence, '{n}' as rule from y where {c}" for n, c in {"not_allowed": "not ok", "does_not_continue": "p <> from_status", "out_of_order": "occurred_at < b", "production_without_approval": "to_status = 'production' and not coalesce(approved, false)"}.items()))
def f16_lifecycle_replay(v):
    rows = v.sql(LIFE.replace("event_id % 50 // 49", "floor((event_id % 50) / 49)")).withColumn("from_status", F.expr("case when f = 'purchase' and sequence % 3 > 0 then 'production' else f end"))
    return checks.lifecycle_replay(rows, v.sql(ALLOWED), "factor_id")
