"""Queries: fundamental factors, valuation, expected-return views and screens."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofspark.operators import factors, valuation, views

from .core import STATUS, r
from .testdata import Registry

query = Registry()


def _points(lags: str, rows: str = "{metrics}") -> str:
    picks = ", ".join(f"max(case when p.q = m.q - {k} then p.value end) as v_{k}" for k in lags.split(","))
    return f"select m.entity_id, m.metric, m.q, {picks} from {rows} m join {rows} p on p.entity_id = m.entity_id and p.metric = m.metric and m.q - p.q in ({lags}) group by 1, 2, 3"


IMPROVED = """select entity_id, metric, q, v_0 as level, case when reason is null then case when metric = 'margin' then v_0 - v_4 else v_0 / v_4 - 1 end end as trend, case when reason is null then case when metric = 'margin' then (v_0 - v_4) - (v_1 - v_5) else v_0 / v_4 - v_1 / v_5 end end as value, {status} from
    (select *, case when v_0 is null or v_1 is null or v_4 is null or v_5 is null then 'missing_quarter' when metric <> 'margin' and least(v_4, v_5) <= 0 then 'non_positive_base' end as reason from ({points}))""".replace("{status}", STATUS)
ONE_OFFS = "select entity_id, metric, q, 1000.0E0 * (q % 5) as amount from {metrics} where entity_id % 4 = 1 and metric = 'revenue'"
NET = "(select m.entity_id, m.q, m.metric, m.value - coalesce(o.amount, 0) as value from {metrics} m left join (" + ONE_OFFS + ") o on o.entity_id = m.entity_id and o.metric = m.metric and o.q = m.q)"


@query("select entity_id, metric, q, round(level, 6) as level, round(trend, 6) as trend, round(value, 6) as value, status, unavailable_reason from (" + IMPROVED.replace("{points}", _points("0,1,4,5", NET)) + ")")
def n12_improvement(v):
    return factors.improvement(v.metrics, True, ["margin"], v.sql(ONE_OFFS)).select("entity_id", "metric", "q", *r("level", "trend", "value"), "status", "unavailable_reason")


TREATED = """select entity_id, metric, q, case when (entity_id + q) % 5 = 1 then 'uncontrolled' when q % 11 = 3 then 'unknown' else 'yoy_comparable' end as seasonality, case when (entity_id + q) % 7 = 2 then 'present_unadjusted' else 'absent' end as base_effect,
    case when (entity_id + q) % 9 = 4 then 'included_unadjusted' when q % 13 = 5 then 'unknown' else 'excluded' end as one_off from {metrics} where (entity_id + q) % 19 <> 6"""


@query("""select m.entity_id, m.metric, m.q, case when why is null then round(m.value, 6) end as value, case when why is null then m.status else 'unavailable' end as status, coalesce(why, m.unavailable_reason) as unavailable_reason from (""" + IMPROVED.replace("{points}", _points("0,1,4,5", NET)) + """) m left join (select *, case when seasonality in ('uncontrolled', 'unknown') then 'seasonality_uncontrolled' when base_effect in ('present_unadjusted', 'unknown') then 'base_effect_unadjusted' when one_off in ('included_unadjusted', 'unknown') then 'one_off_unadjusted' end as w from (""" + TREATED + """)) t using (entity_id, metric, q), lateral (select case when t.seasonality is null then 'treatment_missing' else w end as why)""")
def n12_improvement_treated(v):
    return factors.improvement(v.metrics, True, ["margin"], v.sql(ONE_OFFS), v.sql(TREATED)).select("entity_id", "metric", "q", *r("value"), "status", "unavailable_reason")


@query("select entity_id, metric, q, case when v_0 is null or v_1 is null or v_2 is null or least(v_1, v_2) <= 0 then null else round(v_0 / v_1 - v_1 / v_2, 6) end as value from (" + _points("0,1,2", "(select * from {metrics} where metric <> 'margin')") + ")")
def n12_improvement_quarter_on_quarter(v):
    return factors.improvement(v.metrics.where("metric <> 'margin'"), False).select("entity_id", "metric", "q", *r("value"))


@query("select entity_id, max(q) as q from (select entity_id, q from (" + _points("0,1,4,5") + ") where v_0 is not null and v_1 is not null and v_4 is not null and v_5 is not null group by 1, 2 having count(*) = 3) group by 1")
def n13_improvement_window(v):
    return factors.improvement_window(v.metrics, ["revenue", "profit", "margin"])


@query("select entity_id, q, count(value) as n_quantified, case when count(value) > 0 then round(count(*) filter (where value > 0) * 1.0 / count(value), 6) end as breadth, round(count(value) / 3.0, 6) as confidence, case when count(value) >= 3 then 'quantified' when count(value) > 0 then 'partial' else 'unavailable' end as status from (" + IMPROVED.replace("{points}", _points("0,1,4,5")) + ") group by 1, 2")
def a20_improvement_breadth(v):
    return factors.improvement_summary(factors.improvement(v.metrics, True, ["margin"]), 3).select("entity_id", "q", "n_quantified", *r("breadth", "confidence"), "status")


QUALITY = "select entity_id, q, 'net_profit' as metric, profit as value from {quarterly} union all select entity_id, q, 'operating_cash_flow', cash_flow from {quarterly} union all select entity_id, q, 'total_equity', case when entity_id % 6 = 0 then 0 else revenue * 2 end from {quarterly} union all select entity_id, q, 'total_assets', revenue * 5 from {quarterly} where q % 9 <> 0 union all select entity_id, q, 'revenue', revenue from {quarterly}"


@query("with w as (select entity_id, q, max(case when metric = 'net_profit' then value end) as n, max(case when metric = 'operating_cash_flow' then value end) as c, max(case when metric = 'total_equity' then value end) as e, max(case when metric = 'total_assets' then value end) as a, max(case when metric = 'revenue' then value end) as s from (" + QUALITY + ") group by 1, 2), x as (select entity_id, q, 'cash_to_profit' as ratio, c as u, n as d from w union all select entity_id, q, 'return_on_equity', n, e from w union all select entity_id, q, 'asset_turnover', s, a from w) select entity_id, q, ratio, case when reason is null then round(u / d, 6) end as value, " + STATUS + " from (select *, case when u is null or d is null then 'missing_input' when d = 0 then 'zero_denominator' end as reason from x)")
def v16_quality_ratios(v):
    some = {k: factors.QUALITY_RATIOS[k] for k in ("cash_to_profit", "return_on_equity", "asset_turnover")}
    return factors.quality_ratios(v.sql(QUALITY), ["entity_id", "q"], some).select("entity_id", "q", "ratio", *r("value"), "status", "unavailable_reason")


@query("select entity_id, count(value) as n, case when count(value) >= 8 then round(stddev_samp(value), 6) end as value, case when count(value) >= 8 then 'quantified' else 'unavailable' end as status, case when count(value) < 8 then 'insufficient_observations' end as unavailable_reason from {metrics} where metric = 'margin' group by 1")
def v16_margin_stability(v):
    return factors.dispersion(v.metrics.where("metric = 'margin'"), ["entity_id"], 8).select("entity_id", "n", *r("value"), "status", "unavailable_reason")


REQUESTS = "select distinct o_custkey as company_id, case o_custkey % 3 when 0 then 'bank' when 1 then 'industrial' else 'other' end as template, f.feature, cast(date_trunc('year', o_orderdate) as date) as as_of from {orders} cross join (select 'roe' as feature union all select 'debt') f"
RULES = "select 'bank' as template, 'roe' as feature, 'b_roe' as rule_id, 'minimum' as comparator union all select 'industrial', 'roe', 'i_roe', 'minimum' union all select 'industrial', 'debt', 'i_debt', 'maximum' union all select 'bank', 'debt', 'b_debt', 'maximum'"
BINDINGS = "select 'b_roe' as rule_id, 0.1E0 as threshold, 'approved' as status, date '1995-01-01' as valid_from, date '1998-01-01' as valid_to union all select 'b_roe', 0.12E0, 'approved', date '1998-01-01', null union all select 'i_roe', 0.05E0, 'approved', date '1996-01-01', null union all select 'i_debt', 0.6E0, 'approved', date '1995-01-01', null union all select 'i_debt', 0.7E0, 'draft', date '1995-01-01', null union all select 'b_debt', 0.9E0, 'approved', date '1995-01-01', null"
EXCEPTIONS = "select c_custkey as company_id, 'i_debt' as rule_id, date '1997-01-01' as valid_from, cast(null as date) as valid_to from {customer} where c_custkey % 10 = 1"
RESOLVED = f"""select q.company_id, q.template, q.feature, q.as_of, u.rule_id, u.comparator, case when x.company_id is null and count(b.threshold) = 1 then min(b.threshold) end as threshold, case when u.rule_id is null then 'no_rule' when x.company_id is not null then 'not_applicable' when count(b.threshold) = 0 then 'no_threshold' when count(b.threshold) > 1 then 'ambiguous' else 'resolved' end as status
    from ({REQUESTS}) q left join ({RULES}) u on u.template = q.template and u.feature = q.feature left join ({BINDINGS}) b on b.rule_id = u.rule_id and b.status = 'approved' and b.valid_from <= q.as_of and (b.valid_to is null or q.as_of < b.valid_to) left join ({EXCEPTIONS}) x on x.company_id = q.company_id and x.rule_id = u.rule_id and x.valid_from <= q.as_of group by 1, 2, 3, 4, 5, 6, x.company_id"""


def _resolved(v):
    return factors.resolve_thresholds(v.sql(REQUESTS), v.sql(RULES), v.sql(BINDINGS), v.sql(EXCEPTIONS))


@query(RESOLVED)
def v15_threshold_resolution(v):
    return _resolved(v)


FEATURES = "select o_custkey as company_id, cast(date_trunc('year', o_orderdate) as date) as as_of, f.feature, max(case when f.feature = 'roe' then o_totalprice / 3000000 when o_orderkey % 8 = 0 then null else o_totalprice / 500000 end) as value from {orders} cross join (select 'roe' as feature union all select 'debt') f group by 1, 2, 3"


@query(f"select company_id, as_of, count(*) as n_checks, case when bad = 0 and gap = 0 then round(avg(case when ok then 1.0 else 0.0 end), 6) end as value, case when bad = 0 and gap = 0 then 'quantified' else 'unavailable' end as status, case when bad > 0 then 'threshold_unresolved' when gap > 0 then 'missing_value' end as unavailable_reason from (select t.company_id, t.as_of, case when comparator = 'minimum' then value >= threshold else value <= threshold end as ok, count(*) filter (where t.status <> 'resolved') over w as bad, count(*) filter (where t.status = 'resolved' and value is null) over w as gap from ({RESOLVED}) t left join ({FEATURES}) f on f.company_id = t.company_id and f.as_of = t.as_of and f.feature = t.feature window w as (partition by t.company_id, t.as_of)) group by company_id, as_of, bad, gap")
def a19_quality_factor(v):
    return factors.quality(v.sql(FEATURES), _resolved(v)).select("company_id", "as_of", "n_checks", *r("value"), "status", "unavailable_reason")


# -- valuation ----------------------------------------------------------------------------------------------------

LAST = "select entity_id as security_id, profit as net_profit, revenue * 2 as equity from {quarterly} where q = 1998 * 4 + 2"
PRICE = "select listing_id as security_id, max(close) as price from {bars} where session_date <= date '1998-06-01' group by 1"
SHARES = "select listing_id as security_id, min(total_shares) as shares from {capital} where listing_id % 9 <> 4 group by 1"
CODED = "select s_suppkey as security_id, case s_nationkey % 3 when 0 then 'J66' when 1 then 'C27' else 'K70' end as industry_code from {supplier}"
INPUTS = f"select p.security_id, price, net_profit / shares as earnings_per_share, equity / shares as book_per_share, price * shares as market_cap, ln(price * shares) as log_market_cap, case when industry_code like 'J66%' then 'bank' when industry_code like 'C%' then 'manufacturing' else 'unsupported' end as template from ({PRICE}) p left join ({SHARES}) s using (security_id) left join ({LAST}) t using (security_id) left join ({CODED}) i using (security_id)"


def _inputs(v):
    return valuation.inputs(v.sql(PRICE), v.sql(SHARES), v.sql(LAST), v.sql(CODED))


@query(f"select security_id, round(price, 6) as price, round(earnings_per_share, 6) as earnings_per_share, round(book_per_share, 6) as book_per_share, round(market_cap, 4) as market_cap, round(log_market_cap, 8) as log_market_cap, template from ({INPUTS})")
def v2_valuation_inputs(v):
    return _inputs(v).select("security_id", *r("price", "earnings_per_share", "book_per_share"), *r("market_cap", digits=4), *r("log_market_cap", digits=8), "template")


EXTRA = "select security_id, net_profit * 0.8 - 20000 as free_cash_flow, equity + net_profit as enterprise_value, net_profit + 10000 as ebit from (" + LAST + ")"
RATIOS = f"""with x as (select * from ({INPUTS}) left join ({EXTRA}) e using (security_id)), l as (select security_id, template, 'earnings_yield' as ratio, earnings_per_share as a, price as b from x union all select security_id, template, 'book_yield', book_per_share, price from x union all select security_id, template, 'fcf_yield', free_cash_flow, market_cap from x union all select security_id, template, 'ev_ebit', enterprise_value, ebit from x)
    select security_id, template, ratio, case when reason is null then a / b end as value, {STATUS} from (select *, case when template = 'bank' and ratio in ('fcf_yield', 'ev_ebit') then 'not_applicable' when a is null or b is null then 'missing_input' when b <= 0 or (ratio = 'ev_ebit' and a <= 0) then 'non_positive_input' end as reason from l)"""


def _ratios(v):
    return valuation.ratios(_inputs(v).join(v.sql(EXTRA), "security_id", "left"))


@query(f"select security_id, template, ratio, round(value, 8) as value, status, unavailable_reason from ({RATIOS})")
def v1_valuation_ratios(v):
    return _ratios(v).select("security_id", "template", "ratio", *r("value", digits=8), "status", "unavailable_reason")


HISTORICAL = "select entity_id as security_id, 'earnings_yield' as ratio, profit / revenue * 10 as value from {quarterly} union all select entity_id, 'ev_ebit', case when profit <> 0 then revenue / profit end from {quarterly} where entity_id % 5 <> 0"


@query(f"""with v as ({RATIOS}), g as (select template, ratio, median(value) as m, count(value) as n from v group by 1, 2), h as (select security_id, ratio, median(value) as m from ({HISTORICAL}) group by 1, 2), x as (select v.security_id, v.template, v.ratio, v.value, case when g.n >= 3 and g.m > 0 and v.value > 0 then case when v.ratio = 'ev_ebit' then g.m / v.value - 1 else v.value / g.m - 1 end end as a, case when h.m > 0 and v.value > 0 then case when v.ratio = 'ev_ebit' then h.m / v.value - 1 else v.value / h.m - 1 end end as b from v left join g on g.template = v.template and g.ratio = v.ratio left join h on h.security_id = v.security_id and h.ratio = v.ratio)
    select security_id, template, ratio, round(value, 8) as value, round(a, 6) as vs_group, round(b, 6) as vs_history, case when a is not null and b is not null then 'quantified' when a is not null or b is not null then 'partial' else 'unavailable' end as status from x""")
def v3_relative_valuation(v):
    return valuation.relative(_ratios(v), v.sql(HISTORICAL), "template").select("security_id", "template", "ratio", *r("value", digits=8), *r("vs_group", "vs_history"), "status")


MODEL = f"select security_id, template, price, price * 0.04 as base_lo, price * 0.06 as base_hi, book_per_share * 0.9 as book_lo, book_per_share * 1.1 as book_hi, 0.08E0 + security_id % 5 * 0.01E0 as roe_lo, 0.1E0 + security_id % 5 * 0.01E0 as roe_hi, 0.01E0 as growth_lo, 0.03E0 + security_id % 7 * 0.01E0 as growth_hi, 0.08E0 as rate_lo, 0.1E0 as rate_hi from ({INPUTS})"


def _corners(f, first="book") -> str:
    return "[" + ", ".join(f(b, e, g, k) for b in ("lo", "hi") for e in (("lo", "hi") if first == "book" else ("",)) for g in ("lo", "hi") for k in ("lo", "hi")) + "]"


PB = _corners(lambda b, e, g, k: f"book_{b} * (roe_{e} - growth_{g}) / (rate_{k} - growth_{g})")
ROE = _corners(lambda b, e, g, k: f"growth_{g} + price / book_{b} * (rate_{k} - growth_{g})", "")
ANCHOR = f"select *, case when ok then case when template = 'bank' then list_min(c) else base_lo * (1 + growth_lo) / (rate_hi - growth_lo) end end as value_lo, case when ok then case when template = 'bank' then list_max(c) else base_hi * (1 + growth_hi) / (rate_lo - growth_hi) end end as value_hi from (select *, rate_lo > growth_hi and (template <> 'bank' or book_lo is not null) as ok, {PB} as c from ({MODEL}))"
IMPLIED = f"select *, case when template = 'bank' then list_min({ROE}) else (price * rate_lo - base_hi) / (price + base_hi) end as implied_lo, case when template = 'bank' then list_max({ROE}) else (price * rate_hi - base_lo) / (price + base_lo) end as implied_hi from ({MODEL})"


@query(f"select security_id, round(value_lo, 6) as value_lo, round(value_hi, 6) as value_hi, round(value_lo / price - 1, 6) as return_lo, round(value_hi / price - 1, 6) as return_hi, case when ok then null when rate_lo <= growth_hi then 'rate_not_above_growth' else 'missing_input' end as anchor_reason from ({ANCHOR})")
def v4_v5_fundamental_anchor(v):
    return valuation.anchor(_model(v)).select("security_id", *r("value_lo", "value_hi", "return_lo", "return_hi"), "anchor_reason")


def _model(v):
    i, b = _inputs(v), F.col("security_id")
    return i.select("security_id", "template", "price", (F.col("price") * 0.04).alias("base_lo"), (F.col("price") * 0.06).alias("base_hi"), (F.col("book_per_share") * 0.9).alias("book_lo"), (F.col("book_per_share") * 1.1).alias("book_hi"), (0.08 + b % 5 * 0.01).alias("roe_lo"), (0.1 + b % 5 * 0.01).alias("roe_hi"), F.lit(0.01).alias("growth_lo"), (0.03 + b % 7 * 0.01).alias("growth_hi"), F.lit(0.08).alias("rate_lo"), F.lit(0.1).alias("rate_hi"))


@query(f"select security_id, round(implied_lo, 6) as implied_lo, round(implied_hi, 6) as implied_hi from ({IMPLIED})")
def v6_implied_expectation(v):
    return valuation.implied(_model(v)).select("security_id", *r("implied_lo", "implied_hi"))


@query(f"select security_id, round(a, 6) as gap_lo, round(b, 6) as gap_hi, case when a is null or b is null then 'unavailable' when security_id % 4 = 0 then 'partial' else 'quantified' end as gap_status from (select security_id, case when template = 'bank' then roe_lo else growth_lo end - implied_hi as a, case when template = 'bank' then roe_hi else growth_hi end - implied_lo as b from ({IMPLIED}))")
def v7_expectation_gap(v):
    x = valuation.implied(_model(v)).withColumn("n_missing", (F.col("security_id") % 4 == 0).cast("int"))
    return valuation.gap(x, "n_missing").select("security_id", *r("gap_lo", "gap_hi"), "gap_status")


SCENARIOS = "select entity_id as security_id, q, s.scenario, profit / 1000000 + s.d - 0.05 as driver_lo, profit / 1000000 + s.d + 0.05 as driver_hi, 0.1E0 as intercept, 0.5E0 - entity_id % 6 * 0.2E0 as coefficient from {quarterly} cross join (select 'bear' as scenario, -0.2E0 as d union all select 'base', 0.0E0 union all select 'bull', 0.3E0) s where not (entity_id % 10 = 7 and s.scenario = 'bull')"


@query(f"with x as (select security_id, q, scenario, least(intercept + coefficient * driver_lo, intercept + coefficient * driver_hi) as lo, greatest(intercept + coefficient * driver_lo, intercept + coefficient * driver_hi) as hi, case scenario when 'bear' then 1 when 'base' then 2 else 3 end as o from ({SCENARIOS})), y as (select *, case when (lo + hi) / 2 >= lag((lo + hi) / 2) over (partition by security_id, q order by o) then 1 when lag(lo) over (partition by security_id, q order by o) is not null then 0 end as up from x) select security_id, q, scenario, round(lo, 6) as value_lo, round(hi, 6) as value_hi, coalesce(min(up) over w, 1) = 1 as monotone, count(*) over w = 3 as complete from y window w as (partition by security_id, q)")
def v8_scenario_sensitivity(v):
    return valuation.scenarios(v.sql(SCENARIOS), ["security_id", "q"]).select("security_id", "q", "scenario", *r("value_lo", "value_hi"), "monotone", "complete")


ESTIMATES = "select o_custkey as security_id, year(o_orderdate) as period, o_orderpriority as provider_id, cast(o_orderdate as date) as observed_on, min(o_totalprice) / 100 as estimate_lo, max(o_totalprice) / 90 as estimate_hi, cast(o_orderdate as date) + 150 as valid_to, cast(o_orderdate as date) + cast(o_custkey % 9 - 1 as int) as decision_on from {orders} group by 1, 2, 3, 4, 7, 8"
ATTESTED = """select '1-URGENT' as provider_id, 'strict_historical' as provider_use, date '1993-01-01' as qualified_on, date '1997-01-01' as valid_until, 2 as ceiling union all select '1-URGENT', 'strict_historical', date '1996-06-01', cast(null as date), 2
    union all select '2-HIGH', 'strict_historical', date '1994-01-01', date '1996-06-30', 2 union all select '3-MEDIUM', 'private_research', date '1990-01-01', cast(null as date), 2 union all select '4-NOT SPECIFIED', 'strict_historical', date '1990-01-01', cast(null as date), 1"""
STEPS = ("true", "provider_use = 'strict_historical'", "qualified_on <= decision_on", "(valid_until is null or valid_until >= decision_on)", "ceiling >= 2")
PASSED = ", ".join(f"count(*) filter (where a.provider_id is not null and {' and '.join(STEPS[: n + 1])}) as k{n}" for n in range(5))


@query(f"with e as (select *, lag(estimate_lo) over w0 as l, lag(estimate_hi) over w0 as h, lag(valid_to) over w0 as w from ({ESTIMATES}) window w0 as (partition by security_id, period, provider_id order by observed_on)), k as (select security_id, period, e.provider_id, observed_on, decision_on, {PASSED} from e left join ({ATTESTED}) a on a.provider_id = e.provider_id group by 1, 2, 3, 4, 5), x as (select e.*, case when l is null then 'no_prior_estimate' when w < observed_on then 'prior_expired' when observed_on > decision_on then 'snapshot_after_decision' when k0 = 0 then 'source_not_attested' when k1 = 0 then 'attested_for_other_use' when k2 = 0 then 'qualified_after_decision' when k3 = 0 then 'attestation_expired' when k4 = 0 then 'trust_ceiling' end as reason from e join k using (security_id, period, provider_id, observed_on, decision_on)) select security_id, period, provider_id, observed_on, case when reason is null then round(estimate_lo - h, 6) end as revision_lo, case when reason is null then round(estimate_hi - l, 6) end as revision_hi, case when reason is null then round((estimate_lo + estimate_hi - l - h) / 2, 6) end as value, {STATUS} from x")
def v9_analyst_revision(v):
    return valuation.revision(v.sql(ESTIMATES), v.sql(ATTESTED)).select("security_id", "period", "provider_id", "observed_on", *r("revision_lo", "revision_hi", "value"), "status", "unavailable_reason")


PARTS = "select entity_id as security_id, q, 'valuation' as component, case when profit > 0 then 'quantified' else 'unavailable' end as status from {quarterly} union all select entity_id, q, 'improvement', case when (entity_id + q) % 3 = 0 then 'partial' when (entity_id + q) % 3 = 1 then 'unavailable' else 'quantified' end from {quarterly} union all select entity_id, q, 'scenario', case when q % 4 = 0 then 'unavailable' else 'quantified' end from {quarterly} union all select entity_id, q, m.name, case when (entity_id + q) % m.n = 0 then 'unavailable' when m.n = 5 and q % 5 = 1 then 'partial' else 'quantified' end from {quarterly} cross join (select 'relative' as name, 2 as n union all select 'anchor', 4 union all select 'implied', 5 union all select 'revision', 4) m where entity_id % 7 <> 3"


def _combined(names: str, status: str, listed: str) -> str:
    own = f"component in ({names})"
    return f"coalesce(string_agg(component, ',' order by component) filter (where {own} and status <> 'quantified'), '') as {listed}, case when count(*) filter (where {own}) = 0 then null when count(*) filter (where {own} and status = 'quantified') = {names.count(',') + 1} then 'quantified' when count(*) filter (where {own} and status <> 'unavailable') = 0 then 'unavailable' else 'partial' end as {status}"


@query(f"select security_id, q, count(*) filter (where status = 'quantified' and component in ('valuation', 'improvement', 'scenario')) as n_quantified, {_combined("'valuation', 'improvement', 'scenario'", 'status', 'open_components')}, {_combined("'relative', 'anchor', 'implied', 'revision'", 'suite_status', 'open_models')} from ({PARTS}) group by 1, 2")
def v10_combined_analysis(v):
    return valuation.analyze(v.sql(PARTS), ["security_id", "q"]).withColumns({c: F.array_join(c, ",") for c in ("open_components", "open_models")})


SUBJECTS = "select s_suppkey as security_id, d.as_of from {supplier} cross join (select date '1997-03-01' as as_of union all select date '1999-03-01') d"


@query(f"with o as (select * from (select s.security_id, s.as_of, m.taxonomy, m.industry_code, row_number() over (partition by s.security_id, s.as_of order by m.valid_from desc, m.taxonomy, m.industry_code) as n from ({SUBJECTS}) s join {{industries}} m on m.security_id = s.security_id and m.valid_from <= s.as_of and (m.valid_to is null or s.as_of < m.valid_to)) where n = 1) select o.security_id, o.as_of, o.taxonomy, o.industry_code, count(distinct p.security_id) as n_peers, case when count(distinct p.security_id) >= 12 then 'quantified' else 'unavailable' end as status from o left join {{industries}} p on p.taxonomy = o.taxonomy and p.industry_code = o.industry_code and p.valid_from <= o.as_of and (p.valid_to is null or o.as_of < p.valid_to) and p.security_id <> o.security_id group by 1, 2, 3, 4")
def j11_comparable_peers(v):
    return valuation.peers(v.industries, v.sql(SUBJECTS), 12)


GROUPS = "select distinct d.as_of, taxonomy, industry_code from {industries} cross join (select date '1997-03-01' as as_of union all select date '1999-03-01') d"


@query(f"select distinct g.as_of, g.taxonomy, g.industry_code, m.security_id from ({GROUPS}) g join {{industries}} m on m.taxonomy = g.taxonomy and m.industry_code = g.industry_code and m.valid_from <= g.as_of and (m.valid_to is null or g.as_of < m.valid_to)")
def j11_group_members(v):
    return valuation.members(v.industries, v.sql(GROUPS))


EVIDENCE = "select company_id as security_id, case fact_id % 3 when 0 then 'profit' when 1 then 'equity' else 'price' end as metric, period_end as period, 'd' || cast(fact_id % 4 as varchar(9)) as dataset_id, provider_id as source_id, year(period_end) as record_id, case when fact_id % 11 = 1 then 'other' else 'h' || cast(year(period_end) as varchar(4)) end as content_hash, trust_state, available_at from {facts}"


@query(f"with e as (select security_id, metric, period, count(*) as c from ({EVIDENCE}) group by 1, 2, 3), d as (select security_id, count(*) filter (where c > 1) as dup from e group by 1), t as (select security_id, count(*) as n_records, count(*) filter (where h > 1) as torn from (select security_id, record_id, count(distinct content_hash) as h from ({EVIDENCE}) group by 1, 2) group by 1), g as (select security_id, count(distinct dataset_id) as n_datasets, count(distinct source_id) as n_sources, count(distinct content_hash) as n_hashes, max(available_at) as latest_available, count(distinct trust_state) as n_trust, count(*) filter (where metric = 'equity') = 0 as no_e, count(*) filter (where metric = 'profit') = 0 as no_p from ({EVIDENCE}) group by 1), x as (select security_id, n_datasets, n_sources, n_records, n_hashes, latest_available, concat_ws(',', case when dup > 0 then 'duplicate_metric_period' end, case when no_e or no_p then 'missing:' || concat_ws('+', case when no_e then 'equity' end, case when no_p then 'profit' end) end, case when n_trust > 1 then 'mixed_trust' end, case when torn > 0 then 'record_of_two_contents' end) as blockers from g join d using (security_id) join t using (security_id)) select *, blockers = '' as qualified from x")
def a24_input_qualification(v):
    return valuation.qualify_inputs(v.sql(EVIDENCE), ["profit", "equity"]).withColumn("blockers", F.array_join("blockers", ","))


WANTED = "select listing_id, exchange, date '1998-05-05' + cast(listing_id % 400 as int) as as_of from {listings}"
FILES = "select exchange, 'dv' || cast(year(calendar_date) as varchar(4)) || exchange as dataset_version_id, min(calendar_date) as first_date, max(calendar_date) as last_date, year(calendar_date) % 4 as job_id from {calendar} group by 1, 2, 5"
DONE = "select 0 as job_id, 'succeeded' as status union all select 1, 'failed' union all select 2, 'succeeded' union all select 3, 'succeeded'"


@query(f"select w.listing_id, w.as_of, f.dataset_version_id, f.job_id, min(c.total_shares) as total_shares from ({WANTED}) w join ({FILES}) f on f.exchange = w.exchange and w.as_of between f.first_date and f.last_date join ({DONE}) d on d.job_id = f.job_id and d.status = 'succeeded' left join {{capital}} c on c.listing_id = w.listing_id and c.effective_from <= w.as_of and (c.effective_to is null or w.as_of < c.effective_to) group by w.listing_id, w.as_of, f.dataset_version_id, f.job_id, c.effective_from")
def j12_price_catalog(v):
    return valuation.price_candidates(v.sql(WANTED), v.sql(FILES), v.sql(DONE), v.capital)


# -- views and screens --------------------------------------------------------------------------------------------


@query(f"select view_id, n as n_quantified, case when reason is null then round(s, 10) end as value, {STATUS} from (select *, case when names <> 'event,quality,revision,valuation' then 'component_set_differs' when n = 0 then 'no_quantified_component' end as reason from (select view_id, count(contribution) as n, sum(contribution) as s, string_agg(component, ',' order by component) as names from {{components}} group by 1))")
def v11_expected_return(v):
    return views.compile_views(v.components).select("view_id", "n_quantified", *r("value", digits=10), "status", "unavailable_reason")


@query("select view_id, round(abs(realized_return - expected_return), 6) as absolute_error, realized_return between p10 and p90 as inside_interval, sign(realized_return) = sign(expected_return) as direction_correct from {views} join {outcomes} using (view_id)")
def v12_calibration(v):
    return views.calibrate(v.views, v.outcomes).select("view_id", *r("absolute_error"), "inside_interval", "direction_correct")


QUOTES = """select o_custkey as security_id, cast(o_orderdate as date) as session_date, max(o_totalprice) as close, case when o_custkey % 23 = 4 and min(o_orderkey) % 3 = 0 then null else 1 - (2010 - year(o_orderdate)) * 0.01E0 end as multiplier,
    case when o_custkey % 31 = 5 and min(o_orderkey) % 2 = 0 then null else 's' end as source_id from {orders} group by o_custkey, o_orderdate"""


@query(f"""with p as (select *, close * multiplier as adj, row_number() over (partition by security_id order by session_date) as i from ({QUOTES})), o as (select v.view_id, v.security_id, v.decision_date, s.i, s.adj, s.source_id from {{views}} v asof left join p s on s.security_id = v.security_id and v.decision_date >= s.session_date where v.view_id not in (select view_id from {{outcomes}})),
    x as (select o.*, e.session_date as d, e.adj as a1, e.source_id as s1 from o left join p e on e.security_id = o.security_id and e.i = o.i + 3), y as (select *, case when i is null then 'price_missing' when source_id is null then 'source_missing' when d is null or d > date '2000-06-01' then 'horizon_not_reached' when s1 is null then 'source_missing' when adj is null or a1 is null then 'actions_missing' end as reason from x)
    select view_id, security_id, decision_date, case when reason is null then d end as realized_at, case when reason is null then round(a1 / adj - 1, 6) end as realized_return, case when reason is null then 'mature' when reason = 'horizon_not_reached' then 'pending' else 'unavailable' end as status, reason from y""")
def j18_v13_outcome_maturity(v):
    return views.mature(v.views, v.sql(QUOTES), v.outcomes, 3, "2000-06-01").select("view_id", "security_id", "decision_date", "realized_at", *r("realized_return"), "status", "reason")


@query("select * from {screens} where decision_date = (select max(decision_date) from {screens})")
def k1_latest_screen(v):
    return views.latest_screen(v.screens, ["snapshot_id", "universe_id", "decision_date", "universe_size"])


NAMED = "select c_custkey as security_id, 'S' || cast(c_custkey as varchar(9)) as symbol, c_name as name from {customer}"


@query(f"select v.* from {{views}} v join ({NAMED}) n using (security_id) where lower(n.name) = 'customer#000000100' or lower(n.symbol) = 'customer#000000100' order by decision_date desc, view_id desc limit 1")
def k2_select_view(v):
    return views.select_view(v.views, v.sql(NAMED), "CUSTOMER#000000100")


@query("select security_id, universe_id, decision_date, rank, p as previous_rank, p - rank as rank_change, case when p is null then 'unavailable' when p > rank then 'up' when p < rank then 'down' else 'flat' end as direction from (select *, lag(rank) over (partition by security_id, universe_id order by decision_date) as p from {screens})")
def n14_rank_change(v):
    return views.rank_change(v.screens)


FROZEN = "select view_id, cast(view_id % 3 as varchar(9)) as content_hash, expected_return from {views}"
BOUND = "select o_orderkey as view_id, cast(o_orderkey % 2 as varchar(9)) as content_hash, o_custkey as security_id from {orders}"


@query(f"select b.view_id, b.content_hash, b.security_id, f.expected_return from ({BOUND}) b left join ({FROZEN}) f on f.view_id = b.view_id and f.content_hash = b.content_hash")
def j14_bind_views(v):
    return views.bind_views(v.sql(BOUND), v.sql(FROZEN))


SECTORED = "select s.*, case when u.s_nationkey % 5 = 4 then null else u.s_nationkey % 5 end as industry from {screens} s join {supplier} u on u.s_suppkey = s.security_id"


@query(f"select snapshot_id, security_id, string_agg(cast(peer as varchar), ',' order by rank, peer) as peers from (select a.snapshot_id, a.security_id, b.security_id as peer, b.rank, row_number() over (partition by a.snapshot_id, a.security_id order by b.rank, b.security_id) as n from ({SECTORED}) a join ({SECTORED}) b on a.snapshot_id = b.snapshot_id and a.industry = b.industry and a.security_id <> b.security_id) where n <= 5 group by 1, 2")
def j15_industry_peers(v):
    return views.industry_peers(v.sql(SECTORED)).withColumn("peers", F.array_join(F.transform("peers", lambda x: x.cast("string")), ","))


RANKED = "select view_id, security_id, cast(view_id % 50 as int) + 1 as rank from {views}"


@query(f"select s.view_id, s.security_id, s.rank, round(v.p90 - v.p10, 6) as bar_width, coalesce(c.n, 0) as n_components from ({RANKED}) s left join {{views}} v using (view_id) left join (select view_id, count(*) as n from {{components}} group by 1) c using (view_id)")
def v14_screen_projection(v):
    out = views.project(v.sql(RANKED), v.views, v.components)
    return out.select("view_id", "security_id", "rank", *r("bar_width"), F.size(F.split("components", " ")).cast("long").alias("n_components"))
