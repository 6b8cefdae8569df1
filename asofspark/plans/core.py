"""Queries: statistics, transforms, labels, bitemporal facts and market data."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofspark.operators import market, pit, scd, stats, transforms

from .testdata import Registry

query = Registry()
BY = ["session_date"]


def r(*names: str, digits: int = 6):
    """Rounded columns, with -0.0 as 0.0."""
    return [(F.round(F.col(n), digits) + F.lit(0.0)).alias(n) for n in names]


STATUS = "case when reason is null then 'quantified' else 'unavailable' end as status, reason as unavailable_reason"
IC = """select session_date, n_obs, n_missing, case when reason is null then round(greatest(-1.0, least(1.0, c)), 6) end as value, {status} from (select *, case when n_obs < 10 then 'insufficient_observations' when c is null then 'zero_variance' end as reason from
    (select session_date, count(x) as n_obs, count(*) - count(x) as n_missing, case when stddev_pop(x) * stddev_pop(y) > 0 then covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) end as c from ({rows}) group by 1))""".replace("{status}", STATUS)


@query(IC.replace("{rows}", "select session_date, case when fwd is not null then score end as x, case when fwd is not null then fwd end as y from {panel}"))
def a1_information_coefficient(v):
    return stats.ic(v.panel, BY, "score", "fwd", min_obs=10).select("session_date", "n_obs", "n_missing", *r("value"), "status", "unavailable_reason")


@query(IC.replace("{rows}", """select session_date, rank() over (partition by session_date order by score) + (count(*) over (partition by session_date, score) - 1) / 2.0 as x,
    rank() over (partition by session_date order by fwd) + (count(*) over (partition by session_date, fwd) - 1) / 2.0 as y from {panel} where fwd is not null
    union all select session_date, null, null from {panel} where fwd is null"""))
def a2_rank_ic(v):
    return stats.ic(v.panel, BY, "score", "fwd", "spearman", min_obs=10).select("session_date", "n_obs", "n_missing", *r("value"), "status", "unavailable_reason")


@query("""with p as (select session_date, fwd, count(*) over (partition by session_date) as n_obs, row_number() over (partition by session_date order by score, listing_id) - 1 as i from {panel} where fwd is not null),
    m as (select session_date, n_obs, cast(least(4, i * 5 // n_obs) as int) as bucket, avg(fwd) as m, count(*) as n_bucket from p group by 1, 2, 3),
    s as (select *, lead(m) over (partition by session_date order by bucket) - m as step from m),
    t as (select *, max(case when bucket = 4 then m end) over w - max(case when bucket = 0 then m end) over w as spread, avg(case when step is null then null when step >= 0 then 1.0 else 0.0 end) over w as mono from s window w as (partition by session_date))
    select session_date, n_obs, bucket, n_bucket, case when n_obs >= 20 then round(m, 6) end as mean_return, case when n_obs >= 20 then round(mono, 6) end as monotonicity, case when n_obs >= 20 then round(spread, 6) end as value,
    case when n_obs >= 20 then 'quantified' else 'unavailable' end as status, case when n_obs < 20 then 'insufficient_observations' end as unavailable_reason from t""")
def a3_quantile_portfolios(v):
    return stats.quantile_portfolios(v.panel, BY, "score", "fwd", "listing_id", 5, 20).select("session_date", "n_obs", "bucket", "n_bucket", *r("mean_return", "monotonicity", "value"), "status", "unavailable_reason")


@query("""with d as (select distinct session_date from {weights}), p as (select session_date as a, lead(session_date) over (order by session_date) as b from d),
    x as (select a, b, coalesce(w0.listing_id, 0) as l, -weight as w from p join {weights} w0 on w0.session_date = a where b is not null union all select a, b, w1.listing_id, weight from p join {weights} w1 on w1.session_date = b),
    m as (select a, b, l, abs(sum(w)) as d from x group by 1, 2, 3)
    select a as from_period, b as to_period, round(sum(d) / 2, 6) as value, 'quantified' as status, cast(null as varchar) as unavailable_reason from m group by 1, 2""")
def a4_turnover(v):
    return stats.turnover(v.weights, "session_date", "listing_id", "weight").select("from_period", "to_period", *r("value"), "status", "unavailable_reason")


@query("""select industry, n_eligible, n_covered, case when reason is null then round(n_covered * 1.0 / n_eligible, 6) end as value, {status}, case when reason is null then n_covered * 1.0 / n_eligible >= 0.9 end as meets_minimum from
    (select *, case when n_eligible < 100 then 'insufficient_eligible' end as reason from (select industry, count(*) filter (where volume > 30) as n_eligible, count(*) filter (where volume > 30 and fwd is not null) as n_covered from {panel} group by 1))""".replace("{status}", STATUS))
def a5_coverage(v):
    return stats.coverage(v.panel, ["industry"], F.col("volume") > 30, F.col("fwd").isNotNull(), 100, 0.9).select("industry", "n_eligible", "n_covered", *r("value"), "status", "unavailable_reason", "meets_minimum")


@query("""with f as (select *, first_value(value) over (partition by series order by horizon) as c0 from {decay}), s as (select series, horizon, abs(value) / abs(c0) as strength from f)
    select series, horizon, round(strength, 6) as strength, min(case when strength <= 0.8 then cast(horizon as double) end) over (partition by series) as value,
    case when min(case when strength <= 0.8 then horizon end) over (partition by series) is null then 'unavailable' else 'quantified' end as status,
    case when min(case when strength <= 0.8 then horizon end) over (partition by series) is null then 'not_reached' end as unavailable_reason from s""")
def a6_decay(v):
    return stats.decay(v.decay, ["series"], "horizon", "value", 0.8).select("series", "horizon", *r("strength", "value"), "status", "unavailable_reason")


def _fama(moment: str, factors: list[str], least: int) -> str:
    """Period slopes by Cramer's rule on moments, then their means."""
    k = len(factors)
    m = {(i, j): f"s_{min(i, j)}_{max(i, j)}" for i in range(k) for j in range(k)} | {(i, k): f"s_{i}_{k}" for i in range(k)}
    names = [*factors, "fwd"]
    sums = ", ".join(f"{moment.format(names[i], names[j])} as s_{i}_{j}" for i in range(k) for j in range(i, k + 1))

    def det(cols: list[int], rows: tuple[int, ...]) -> str:
        if len(rows) == 1:
            return m[rows[0], cols[0]]
        return "(" + " ".join(f"{'-' if n % 2 else '+'} {m[rows[0], c]} * {det([x for x in cols if x != c], rows[1:])}" for n, c in enumerate(cols)) + ")"

    rows = tuple(range(k))
    slopes = [f"{det([k if c == i else c for c in range(k)], rows)} / {det(list(range(k)), rows)}" for i in range(k)]
    each = " union all ".join(f"select '{f}' as factor, case when n >= {least} then {s} end as b from g" for f, s in zip(factors, slopes, strict=True))
    return f"""with g as (select session_date, count(fwd) as n, {sums} from (select session_date, score, tax, size, fwd from {{panel}}) where fwd is not null group by 1 union all select session_date, 0, {", ".join("null" for i in range(k) for j in range(i, k + 1))} from {{panel}} group by 1 having count(fwd) = 0),
    b as ({each}), a as (select factor, count(b) as n, count(*) - count(b) as x, avg(b) as m, stddev_samp(b) as sd from b group by 1)
    select factor, n as n_periods, x as n_excluded, round(m, 6) as value, 'quantified' as status, cast(null as varchar) as unavailable_reason, round(sd / sqrt(n), 6) as standard_error, round(m / (sd / sqrt(n)), 6) as t_value from a"""


def _of_fama(x):
    return x.select("factor", "n_periods", "n_excluded", *r("value"), "status", "unavailable_reason", *r("standard_error", "t_value"))


@query(_fama("covar_pop({}, {})", ["score"], 10))
def a7_fama_macbeth(v):
    return _of_fama(stats.fama_macbeth(v.panel, "session_date", "fwd", ["score"], 10))


@query(_fama("covar_pop({}, {})", ["score", "tax", "size"], 10))
def a7_fama_macbeth_three_factors(v):
    return _of_fama(stats.fama_macbeth(v.panel, "session_date", "fwd", ["score", "tax", "size"], 10))


@query(_fama("avg({} * {})", ["score", "size"], 10))
def a7_fama_macbeth_without_intercept(v):
    return _of_fama(stats.fama_macbeth(v.panel, "session_date", "fwd", ["score", "size"], 10, intercept=False))


@query("select session_date, count(fwd) as n, 'insufficient_observations' as excluded_reason from {panel} group by 1 having count(fwd) < 10")
def a7_excluded_periods(v):
    return stats.excluded_periods(v.panel, "session_date", "fwd", ["score"], 10)


@query("""with x as (select value, 'regime' as dimension, regime as slice from {ic_series} union all select value, 'subperiod', cast(subperiod as varchar) from {ic_series} union all select value, 'all', 'all' from {ic_series}),
    g as (select dimension, slice, count(value) as n_obs, count(*) - count(value) as n_missing, avg(value) as m, stddev_samp(value) as sd from x group by 1, 2),
    o as (select *, max(case when dimension = 'all' then sign(m) end) over () as overall, count(*) filter (where n_obs < 2) over (partition by dimension) as few from g)
    select dimension, slice, n_obs, n_missing, case when n_obs >= 2 then round(m, 6) end as value, case when n_obs >= 2 then 'quantified' else 'unavailable' end as status, case when n_obs < 2 then 'insufficient_observations' end as unavailable_reason,
    case when n_obs >= 2 then round(sd, 6) end as sd, case when few = 0 then round(avg(case when sign(m) = overall then 1.0 else 0.0 end) over (partition by dimension), 6) end as sign_consistency from o""")
def a8_a9_robustness(v):
    return stats.robustness(v.ic_series, "value", ["regime", "subperiod"]).select("dimension", "slice", "n_obs", "n_missing", *r("value"), "status", "unavailable_reason", *r("sd", "sign_consistency"))


@query("""with x as (select *, row_number() over (partition by family order by p_value nulls first, hypothesis_id) as k, count(*) over (partition by family) as m, count(*) filter (where p_value is null) over (partition by family) as gaps from {hypotheses}),
    y as (select *, 0.2 * k / m as crit, least(1.0, p_value * m / k) as scaled from x), z as (select *, min(scaled) over (partition by family order by k rows between current row and unbounded following) as adj, coalesce(max(case when p_value <= crit then k end) over (partition by family), 0) as cut from y)
    select family, hypothesis_id, m, case when ok then k end as rank, case when ok then round(crit, 8) end as critical_value, case when ok then round(adj, 8) end as value, case when ok then 'quantified' else 'unavailable' end as status,
    case when gaps > 0 then 'missing_p_value' when m < 2 then 'insufficient_hypotheses' end as unavailable_reason, case when ok then k <= cut end as rejected from (select *, gaps = 0 and m >= 2 as ok from z)""")
def n10_benjamini_hochberg(v):
    return stats.benjamini_hochberg(v.hypotheses, ["family"], "hypothesis_id", "p_value", 0.2, 2).select("family", "hypothesis_id", "m", "rank", *r("critical_value", "value", digits=8), "status", "unavailable_reason", "rejected")


@query("""with e as (select series, session_date, value, value - avg(value) over (partition by series) as e from {ic_series}), l as (select *, lag(e, 1) over w as l1, lag(e, 2) over w as l2, lag(e, 3) over w as l3 from e window w as (partition by series order by session_date)),
    g as (select series, count(*) as n, avg(value) as m, (sum(e * e) + 2 * 0.75 * sum(e * l1) + 2 * 0.5 * sum(e * l2) + 2 * 0.25 * sum(e * l3)) / count(*) as lrv from l group by 1)
    select series, n as n_obs, round(m, 8) as value, 'quantified' as status, cast(null as varchar) as unavailable_reason, round(sqrt(lrv / n), 8) as standard_error, round(m / sqrt(lrv / n), 6) as t_value from g""")
def n11_newey_west(v):
    return stats.newey_west(v.ic_series, ["series"], "session_date", "value", 3).select("series", "n_obs", *r("value", digits=8), "status", "unavailable_reason", *r("standard_error", digits=8), *r("t_value"))


@query("""with s as (select series, value, row_number() over (partition by series order by session_date) - 1 as i, count(*) over (partition by series) as n from {ic_series}), z as (select series, count(*) as n, count(*) - count(value) as gaps, avg(value) as m from s group by 1),
    k as (select series, n, resample, b, cast('0x' || substr(md5('0|' || series || '|' || resample || '|' || b), 1, 8) as bigint) % n as s0 from z, range(500) a(resample), lateral (select unnest(range((n - 1) // 6 + 1)) as b) where gaps = 0 and n >= 6),
    p as (select k.series, resample, avg(value) as v from k, range(6) o(j) join s on s.series = k.series and s.i = (k.s0 + j) % k.n where b * 6 + j < k.n group by 1, 2), e as (select series, quantile_cont(v, 0.025) as lo, quantile_cont(v, 0.975) as hi from p group by 1)
    select series, n as n_obs, case when reason is null then round(m, 6) end as value, {status}, round(lo, 6) as lower, round(hi, 6) as upper from (select *, case when gaps > 0 then 'missing_value' when n < 6 then 'block_longer_than_series' end as reason from z left join e using (series))""".replace("{status}", STATUS))
def x6_block_bootstrap(v):
    return stats.block_bootstrap(v.ic_series, ["series"], "session_date", "value", 6, 500).select("series", "n_obs", *r("value"), "status", "unavailable_reason", *r("lower", "upper"))


SAMPLES = "select series, cast(session_date as varchar(10)) as sample_id, i as session_index, i + 3 as label_end_session_index, value is not null and i % 7 <> 5 as available from (select *, row_number() over (partition by series order by session_date) + 40 as i from {ic_series}) x"


@query("""with s as (select sample_id, available, session_index - 41 as i, label_end_session_index - 41 as e from (""" + SAMPLES + """)), n as (select max(i) + 1 as n from s), f as (select unnest(range(0, cast((n - 30) // 11 as int) + 1)) as fold from n),
    g as (select fold, 20 + fold * 11 as t0, sample_id, i, e from f, s where available)
    select 'ic' as series, cast(null as varchar) as unavailable_reason, cast(fold as int) as fold, sample_id, role from (select *, case when i >= t0 and i < t0 + 10 then 'test' when i >= t0 + 10 and i < t0 + 11 then 'embargo' when i < t0 and e < t0 - 2 then 'train' when i < t0 then 'purged' end as role from g) where role is not null""")
def x7_walk_forward(v):
    return stats.walk_forward(v.sql(SAMPLES), ["series"], 20, 10, 2, 1, 3)


@query("select session_date, value, case when session_date < date '1998-01-01' then 'train' when session_date < date '2000-01-01' then 'validation' when session_date < date '2001-01-01' then 'test' end as role from {ic_series}")
def x8_calendar_split(v):
    return stats.calendar_split(v.ic_series.select("session_date", "value"), "session_date", "1998-01-01", "2000-01-01", "2001-01-01")


@query("""select session_date, round(p, 6) as primary_value, round(q, 6) as reference_value, case when p is null or q is null then 'unavailable' when abs(p - q) <= 0.1 + 0.5 * abs(q) then 'matched' else 'mismatch' end as outcome from
    (select session_date, avg(fwd) as p from {panel} group by 1) full join (select session_date, median(fwd) as q from {panel} where volume > 60 group by 1) using (session_date)""")
def x9_crosscheck(v):
    a = v.panel.groupBy("session_date").agg(F.avg("fwd").alias("value"))
    b = v.panel.where("volume > 60").groupBy("session_date").agg(F.median("fwd").alias("value"))
    return stats.crosscheck(a, b, BY, "value", 0.1, 0.5).select("session_date", *r("primary_value", "reference_value"), "outcome")


@query("""with b as (select session_date, count(fwd) as n, quantile_cont(fwd, 0.05) as lo, quantile_cont(fwd, 0.95) as hi from {panel} group by 1)
    select listing_id, session_date, case when reason is null then round(least(greatest(fwd, lo), hi), 6) end as value, {status} from (select *, case when n < 10 then 'insufficient_observations' when fwd is null then 'missing_value' end as reason from {panel} join b using (session_date))""".replace("{status}", STATUS))
def x1_winsorize(v):
    return transforms.winsorize(v.panel, BY, "fwd", 0.05, 0.95, 10).select("listing_id", "session_date", *r("value"), "status", "unavailable_reason")


@query("""select listing_id, session_date, case when reason is null then round((fwd - m) / s, 6) end as value, {status} from (select *, case when n < 10 then 'insufficient_observations' when s = 0 then 'zero_variance' when fwd is null then 'missing_value' end as reason from
    (select *, count(fwd) over w as n, avg(fwd) over w as m, stddev_samp(fwd) over w as s from {panel} window w as (partition by session_date)))""".replace("{status}", STATUS))
def x2_standardize(v):
    return transforms.zscore(v.panel, BY, "fwd", 1, 10).select("listing_id", "session_date", *r("value"), "status", "unavailable_reason")


NEUTRAL = """select listing_id, session_date, case when reason is null then round(yd - sum(xd * yd) over w / sum(xd * xd) over w * xd, 6) end as value, {status} from
    (select *, case when fwd is null then 'missing_value' when n <= k + 1 then 'insufficient_observations' end as reason from (select *, count(y) over w as n, count(distinct i) over w as k from
    (select *, y - avg(y) over w as yd, x - avg(x) over w as xd from (select *, fwd as y, case when fwd is not null then size end as x, case when fwd is not null then industry end as i from {panel}) window w as (partition by session_date, i)) window w as (partition by session_date)))
    window w as (partition by session_date)""".replace("{status}", STATUS)


@query(NEUTRAL)
def x3_neutralize(v):
    return transforms.neutralize(v.panel, BY, "fwd", "industry", "size").select("listing_id", "session_date", *r("value"), "status", "unavailable_reason")


@query("""with p as (select entity_id, q, max(case when metric = 'revenue' then value end) as revenue, max(case when metric = 'profit' then value end) as profit from {metrics} group by 1, 2)
    select entity_id, q, case when profit is null then 'profit' else '' end as missing_inputs, case when reason is null then round(profit / revenue, 6) end as value, {status} from (select *, case when profit is null or revenue is null then 'missing_input' end as reason from p)""".replace("{status}", STATUS))
def x4_feature_formula(v):
    wide = transforms.pivot_inputs(v.metrics, ["entity_id", "q"], "metric", "value", ["revenue", "profit"])
    return transforms.formula(wide, ["revenue", "profit"], "try_divide(profit, revenue)").select("entity_id", "q", F.array_join("missing_inputs", ",").alias("missing_inputs"), *r("value"), "status", "unavailable_reason")


TYPED = """select entity_id, q, metric, value, case when metric = 'revenue' and entity_id % 17 = 3 then 'ratio' else 'currency' end as unit, case when metric = 'profit' and entity_id % 9 = 2 then 'USD' else 'CNY' end as currency,
    case when metric = 'profit' and (entity_id + q) % 13 = 0 then q - 1 else q end as period from {metrics} where metric <> 'margin'"""


@query("""with p as (select entity_id, q, max(case when metric = 'revenue' then value end) as revenue, max(case when metric = 'profit' then value end) as profit, bool_or(unit <> 'currency') as u, bool_or(currency <> 'CNY') as c, count(distinct period) as n from (""" + TYPED + """) group by 1, 2)
    select entity_id, q, concat_ws(',', case when revenue is null then 'revenue' end, case when profit is null then 'profit' end) as missing_inputs, case when reason is null then round(profit / revenue, 6) end as value, case when reason = 'missing_input' then 'rejected' when reason is not null then 'unavailable' else 'quantified' end as status, reason as unavailable_reason from
    (select *, case when profit is null or revenue is null then 'missing_input' when u then 'unit_mismatch' when c then 'currency_mismatch' when n > 1 then 'period_mismatch' when revenue = 0 then 'undefined' end as reason from p)""")
def x4_feature_definition(v):
    x = transforms.feature(v.sql(TYPED), ["entity_id", "q"], {"revenue": ("currency", "CNY"), "profit": ("currency", "CNY")}, "try_divide(profit, revenue)", "reject")
    return x.select("entity_id", "q", F.array_join("missing_inputs", ",").alias("missing_inputs"), *r("value"), "status", "unavailable_reason")


@query("""with raw as (select session_date, listing_id, industry, size, fwd as raw from {panel}), b as (select session_date, quantile_cont(raw, 0.01) as lo, quantile_cont(raw, 0.99) as hi, count(raw) as n from raw group by 1),
    w as (select raw.*, case when raw is not null and n >= 2 then least(greatest(raw, lo), hi) end as win from raw join b using (session_date)),
    z as (select *, case when count(win) over t >= 2 and stddev_samp(win) over t > 0 then (win - avg(win) over t) / stddev_samp(win) over t end as std from w window t as (partition by session_date)),
    d as (select *, std - avg(std) over t as yd, x - avg(x) over t as xd from (select *, case when std is not null then size end as x, case when std is not null then industry end as i from z) window t as (partition by session_date, i)),
    e as (select *, count(std) over t as n, count(distinct i) over t as k, sum(xd * yd) over t as xy, sum(xd * xd) over t as xx from d window t as (partition by session_date)),
    s as (select session_date, listing_id, raw, 'raw' as stage, raw as value from e union all select session_date, listing_id, raw, 'winsorized', win from e union all select session_date, listing_id, raw, 'standardized', std from e
        union all select session_date, listing_id, raw, 'neutralized', case when std is not null and n > k + 1 and xx > 1e-12 then yd - xy / xx * xd end from e)
    select session_date, listing_id, stage, sha256('v1|' || sha256('fwd') || '|' || stage || '|' || cast(session_date as varchar) || '|' || cast(listing_id as varchar) || '|' || coalesce(cast(cast(floor(raw * 1e6 + 0.5) as bigint) as varchar), '') || '|' || coalesce(cast(cast(floor(value * 1e6 + 0.5) as bigint) as varchar), '')) as snapshot_id, round(value, 6) as value, case when value is null then 'unavailable' else 'quantified' end as status from s""")
def x5_feature_snapshots(v):
    return transforms.snapshot(v.panel, BY, "listing_id", "fwd", "industry", "size", "v1", formula="fwd").select("session_date", "listing_id", "stage", "snapshot_id", *r("value"), "status")


PRICES = "select listing_id, session_date, close, volume > 100 as tradable from {bars}"
#: A month after each month with a trade, and that month itself: the next one may have none.
ASKED = "select listing_id, session_date from {bars} union select listing_id, cast(session_date + interval 1 month as date) from {bars}"


@query("""select listing_id, session_date, end_session, case when reason is null then round((c1 - close) / close, 6) end as value, {status} from (select *, case when tradable is null then 'decision_session_missing' when end_session is null then 'horizon_incomplete' when not tradable or not t1 then 'not_tradable' end as reason from
    (select d.listing_id, d.session_date, p.* exclude (listing_id, session_date) from (""".replace("{status}", STATUS) + ASKED + """) d left join
    (select *, lead(close, 6) over w as c1, lead(tradable, 6) over w as t1, lead(session_date, 6) over w as end_session from (""" + PRICES + """) window w as (partition by listing_id order by session_date)) p on p.listing_id = d.listing_id and p.session_date = d.session_date))""")
def n1_forward_return(v):
    return transforms.forward_return(v.sql(PRICES), 6, v.sql(ASKED)).select("listing_id", "session_date", "end_session", *r("value"), "status", "unavailable_reason")


VOL = """select listing_id, session_date, case when n >= 20 then stddev_samp(x) over w * sqrt(244.0) end as vol, n from (select *, count(x) over (partition by listing_id order by session_date rows between 19 preceding and current row) as n from
    (select listing_id, session_date, ln(close / lag(close) over (partition by listing_id order by session_date)) as x from {bars_daily})) window w as (partition by listing_id order by session_date rows between 19 preceding and current row)"""


@query("select listing_id, session_date, round(vol, 6) as value, case when n < 20 then 'unavailable' else 'quantified' end as status, case when n < 20 then 'insufficient_history' end as unavailable_reason from (" + VOL + ")")
def n2_passive_volatility(v):
    return transforms.passive_volatility(v.bars_daily, "listing_id", "session_date", "close").select("listing_id", "session_date", *r("value"), "status", "unavailable_reason")


@query("select listing_id, session_date, case when vol is not null then round(least(1.5, 4.0 / vol), 6) end as exposure, case when n < 20 then 'insufficient_history' end as exposure_reason from (" + VOL + ")")
def n3_volatility_exposure(v):
    vol = transforms.passive_volatility(v.bars_daily, "listing_id", "session_date", "close")
    return transforms.exposure(vol, 4.0, 1.5).select("listing_id", "session_date", *r("exposure"), "exposure_reason")


RECORDED = "select listing_id, session_date, case when listing_id % 3 = 1 then 5.0E0 else 4.0E0 end as target from {bars_daily} where listing_id % 2 = 1 and year(session_date) = 1997"


@query("select listing_id, session_date, case when coalesce(target, 4.0) = 4.0 then round(vol, 6) end as value, case when vol is not null and coalesce(target, 4.0) = 4.0 then round(least(1.5, 4.0 / vol), 6) end as exposure, 1.0::double as static_exposure, case when target is null then 'insert' when target = 4.0 then 'duplicate' else 'conflict' end as action from (" + VOL + ") left join (" + RECORDED + ") r using (listing_id, session_date) where listing_id in (select listing_id from {listings} where delisted_on is null)")
def n16_timing_baseline(v):
    return transforms.timing_baseline(v.bars_daily, v.listings.where("delisted_on is null"), "listing_id", "session_date", "close", 4.0, 1.5, recorded=v.sql(RECORDED)).select("listing_id", "session_date", *r("value", "exposure"), "static_exposure", "action")


# -- bitemporal facts ---------------------------------------------------------------------------------------------



def clocks():
    """The decision and the system time of the queries below."""
    return F.lit("1999-12-31").cast("date"), F.lit("2000-01-31").cast("date")


AUTHORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
ELIGIBLE = "available_at <= date '1999-12-31' and known_from <= date '2000-01-31' and (known_to is null or date '2000-01-31' < known_to) and trust_state in {trust}"
STRICT, CURRENT = ELIGIBLE.replace("{trust}", "('pit_verified')"), ELIGIBLE.replace("{trust}", "('pit_verified', 'normalized_current')")
WINNERS = "select company_id, period_end, provider_id, max(revision) as revision, 1 as n_winners, arg_max(value, revision) as value, arg_max(fact_id, revision) as fact_id, arg_max(quality_state, revision) = 'blocked' as quality_blocked from {facts} where {ok} group by 1, 2, 3"


@query("select fact_id, company_id, value from {facts} where " + STRICT)
def f6_pit_eligible(v):
    return pit.eligible(v.facts, *clocks()).select("fact_id", "company_id", "value")


@query("select fact_id, concat_ws(',', case when trust_state = 'raw' then 'raw_evidence' end, case when available_at > date '1999-12-31' then 'available_after_decision' end, case when trust_state <> 'pit_verified' then 'not_pit_verified' end) as blocked_by from {facts}")
def f5_evidence_gate(v):
    return pit.evidence_gate(v.facts.withColumn("decision_time", clocks()[0]), "strict_historical").select("fact_id", F.array_join("blocked_by", ",").alias("blocked_by"))


@query("select company_id, period_end, provider_id, revision, n_winners, false as conflict, value, fact_id, quality_blocked from (" + WINNERS.replace("{ok}", STRICT) + ")")
def n6_pit_winner(v):
    return pit.select_revision(pit.eligible(v.facts, *clocks())).withColumn("n_winners", F.col("n_winners").cast("int"))


SELECT = """select i.company_id, i.period_end, s.provider_id, s.value, s.fact_id, coalesce(a.n, 0) as n_providers, coalesce(c.conflicts, '') as conflicts, s.provider_id is null or c.conflicts is not null or coalesce(a.held, 0) > 0 as blocks_downstream,
    case when s.provider_id is not null and c.conflicts is null then 'selected' when a.n is not null then 'blocked' else 'unavailable' end as status
    from (select distinct company_id, period_end from {facts}) i
    left join (select company_id, period_end, count(*) as n, count(*) filter (where quality_blocked) as held from (W) group by 1, 2) a on a.company_id = i.company_id and a.period_end = i.period_end
    left join (select company_id, period_end, min(provider_id) as provider_id, arg_min(value, provider_id) as value, arg_min(fact_id, provider_id) as fact_id from (W) where not quality_blocked and provider_id in ('1-URGENT', '2-HIGH', '3-MEDIUM') group by 1, 2) s on s.company_id = i.company_id and s.period_end = i.period_end
    left join (select w.company_id, w.period_end, string_agg(w.provider_id, ',' order by w.provider_id) as conflicts from (W) w left join (select company_id, period_end, min(provider_id) as p, arg_min(value, provider_id) as v from (W) where not quality_blocked and provider_id in ('1-URGENT', '2-HIGH', '3-MEDIUM') group by 1, 2) z
        on z.company_id = w.company_id and z.period_end = w.period_end where not w.quality_blocked and (z.p is null or (w.provider_id <> z.p and w.value is distinct from z.v)) group by 1, 2) c on c.company_id = i.company_id and c.period_end = i.period_end"""


SAID = "struct_pack(v := {}value, u := {}unit, c := {}currency)"
PRICED_WINNERS = WINNERS.replace("{facts}", "{priced_facts}").replace("arg_max(value, revision) as value", "arg_max(value, revision) as value, arg_max(unit, revision) as unit, arg_max(coalesce(currency, '-'), revision) as currency")
PRICED_SELECT = SELECT.replace("{facts}", "{priced_facts}").replace("arg_min(value, provider_id) as v ", "arg_min(" + SAID.format("", "", "") + ", provider_id) as v ").replace("w.value is distinct from z.v", SAID.format("w.", "w.", "w.") + " is distinct from z.v")


@query(PRICED_SELECT.replace("(W)", "(" + PRICED_WINNERS.replace("{ok}", CURRENT) + ")"))
def n7_provider_authority(v):
    return pit.select_fact(v.priced_facts, AUTHORITY, *clocks(), "current").withColumn("conflicts", F.array_join("conflicts", ","))


@query("select company_id, period_end, a.value as current_value, a.status as current_status, b.value as strict_value, b.status as strict_status, a.value is not distinct from b.value as same from (" + SELECT.replace("(W)", "(" + WINNERS.replace("{ok}", CURRENT) + ")") + ") a full join (" + SELECT.replace("(W)", "(" + WINNERS.replace("{ok}", STRICT) + ")") + ") b using (company_id, period_end)")
def n8_compare_modes(v):
    return pit.compare_modes(v.facts, AUTHORITY, *clocks())


@query("select fact_id, lead(known_from) over w as known_to, coalesce(lag(available_at) over w <> available_at, false) as public_time_changed from {corrections} window w as (partition by company_id, period_end, provider_id, revision order by known_from, fact_id)")
def n9_system_correction(v):
    return pit.close_intervals(v.corrections, [*pit.IDENTITY, "provider_id", "revision"]).select("fact_id", "known_to", "public_time_changed")


UNMAPPED = "select event_id as field_id, 'p' || cast(user_id % 3 as varchar(9)) as provider_id, event_type as source_field, case when event_id % 5 = 0 then 'resolved' else 'pending' end as status from {events} where event_type <> 'purchase'"


@query(f"""select 'provider_value_conflict' as mismatch_type, company_id, period_end, string_agg(distinct provider_id, ',' order by provider_id) as provider_ids, string_agg(fact_id, ',' order by fact_id) as related_ids, 'providers disagree on value, unit or currency' as reason from {{priced_facts}} where known_to is null
    group by 2, 3 having count(distinct provider_id) >= 2 and count(distinct struct_pack(v := value, u := unit, c := currency)) >= 2
    union all select 'quality_block', company_id, period_end, provider_id, cast(fact_id as varchar), 'quality state is ' || quality_state from {{priced_facts}} where known_to is null and quality_state = 'blocked'
    union all select 'unmapped_field', null, null, provider_id, cast(field_id as varchar), 'unmapped provider field: ' || source_field from ({UNMAPPED}) where status = 'pending'""")
def a17_provider_mismatches(v):
    found = pit.mismatch_entries(v.priced_facts, v.sql(UNMAPPED))
    return found.withColumns({c: F.array_join(c, ",") for c in ("provider_ids", "related_ids")})


# -- market data --------------------------------------------------------------------------------------------------


@query("select listing_id, session_date, count(distinct source_id) as n_sources, c as conflict, case when not c then min(source_id) end as source_id, case when not c then min(close) end as close, case when not c then min(volume) end as volume from (select *, min(struct_pack(close, volume)) over w <> max(struct_pack(close, volume)) over w as c from {bars_multi} window w as (partition by listing_id, session_date)) group by listing_id, session_date, c")
def a16_select_bar(v):
    return market.select_bar(v.bars_multi, ["close", "volume"])


@query("select listing_id, session_date, count(*) as n_rows, count(distinct struct_pack(close, volume)) as n_variants, string_agg(distinct source_id, ',' order by source_id) as sources from {bars_multi} group by 1, 2 having count(distinct struct_pack(close, volume)) > 1")
def a15_bar_conflicts(v):
    return market.bar_conflicts(v.bars_multi, ["close", "volume"]).withColumn("sources", F.array_join("sources", ","))


@query("""select listing_id, session_date, case when reason is null then round(close * lo, 10) end as value, {status} from (select *, case when lo is null then 'missing_factor' when lo <> hi then 'factor_conflict' end as reason from {bars} left join
    (select listing_id, session_date, min(multiplier) as lo, max(multiplier) as hi from {factors} where volume_ok group by 1, 2) using (listing_id, session_date))""".replace("{status}", STATUS).replace("where volume_ok", "where session_date < date '2001-06-01'"))
def j8_adjusted_close(v):
    return market.adjusted_close(v.bars, v.factors.where("session_date < date '2001-06-01'")).select("listing_id", "session_date", *r("value", digits=10), "status", "unavailable_reason")


LIMITED = "select listing_id, session_date, case when volume % 5 = 0 then upper_limit when volume % 5 = 1 then lower_limit else close end as close, case when volume % 10 = 0 then upper_limit when volume % 10 = 1 then lower_limit else low end as low, case when volume % 10 = 0 then upper_limit when volume % 10 = 1 then lower_limit else high end as high from {bars} join {limits} using (listing_id, session_date) union all select listing_id, session_date, close, low, high from {bars} where (listing_id, session_date) not in (select listing_id, session_date from {limits})"


def limited(bars, limits):
    """The rows of LIMITED. Bars without a limit come from an anti join, as Spark runs NOT IN over two columns as a loop over all
    pairs; a bar without listing or session equals no limit and is no row of either part."""
    bare = bars.where("listing_id is not null and session_date is not null").join(limits, list(market.KEY), "left_anti")
    moved = F.col("volume") % 10
    edge = lambda k, c: F.when(moved % k == 0, F.col("upper_limit")).when(moved % k == 1, F.col("lower_limit")).otherwise(F.col(c)).alias(c)
    return bars.join(limits, list(market.KEY)).select(*market.KEY, edge(5, "close"), edge(10, "low"), edge(10, "high")).unionByName(bare.select(*market.KEY, "close", "low", "high"))


@query("select listing_id, session_date, case when upper_limit is null or close is null then 'unavailable' when close = upper_limit then case when low = upper_limit and high = upper_limit then 'locked_up' else 'limit_up' end when close = lower_limit then case when low = lower_limit and high = lower_limit then 'locked_down' else 'limit_down' end else 'not_at_limit' end as limit_status from (" + LIMITED + ") left join {limits} using (listing_id, session_date)")
def j9_limit_status(v):
    return market.limit_status(limited(v.bars, v.limits), v.limits).select("listing_id", "session_date", "limit_status")


CAPITAL_AT = "select b.listing_id, b.session_date, count(c.source_id) as n, min(total_shares) as lo, max(total_shares) as hi, min(c.source_id) as source_id from {bars} b left join {capital} c on c.listing_id = b.listing_id and c.effective_from <= b.session_date and (c.effective_to is null or b.session_date < c.effective_to) group by 1, 2"


@query("select listing_id, session_date, source_id, case when reason is null then cast(lo as double) end as value, {status} from (select *, case when n = 0 then 'missing_capital' when lo <> hi then 'capital_conflict' end as reason from (".replace("{status}", STATUS) + CAPITAL_AT + "))")
def j6_capital_at(v):
    return market.capital_at(v.bars, v.capital)


@query("select b.listing_id, b.session_date, c.effective_from as matched_at, c.total_shares, c.source_id from {bars} b left join lateral (select * from {capital} c where c.listing_id = b.listing_id and c.effective_from <= b.session_date order by effective_from desc, retrieved_on desc, source_id limit 1) c on true")
def j7_capital_latest(v):
    return market.capital_latest(v.bars, v.capital)


@query("select listing_id, session_date, close, case when n > 0 and lo = hi then cast(lo as double) end as shares, case when reason is null then round(close * lo, 4) end as value, {status} from (select *, case when n = 0 then 'missing_capital' when lo <> hi then 'capital_conflict' end as reason from (".replace("{status}", STATUS) + CAPITAL_AT + ") join {bars} using (listing_id, session_date))")
def j10_market_cap(v):
    return market.market_cap(v.bars, v.capital).withColumn("value", F.round("value", 4))


@query("""select b.listing_id, b.session_date, close, is_trading, round(close * m, 10) as adjusted_close, round(close * s, 4) as market_cap, case when upper_limit is null then 'unavailable' when close = upper_limit then case when low = upper_limit and high = upper_limit then 'locked_up' else 'limit_up' end when close = lower_limit then case when low = lower_limit and high = lower_limit then 'locked_down' else 'limit_down' end else 'not_at_limit' end as limit_status,
    concat_ws(',', case when is_trading is null then 'state' end, case when m is null then 'factor' end, case when s is null then 'capital' end, case when upper_limit is null then 'limit' end) as warnings
    from {bars} b left join {states} using (listing_id, session_date) left join (select listing_id, session_date, case when min(multiplier) = max(multiplier) then min(multiplier) end as m from {factors} group by 1, 2) using (listing_id, session_date)
    left join (select listing_id, session_date, case when lo = hi then lo end as s from (""" + CAPITAL_AT + """)) using (listing_id, session_date) left join {limits} using (listing_id, session_date)""")
def j21_market_summary(v):
    return market.summary(v.bars, v.states, v.factors, v.capital, v.limits).withColumns({"adjusted_close": F.round("adjusted_close", 10), "market_cap": F.round("market_cap", 4), "warnings": F.array_join("warnings", ",")})


DECISIONS = "select listing_id, session_date + interval 10 day as d from {bars}"


@query("select x.listing_id, cast(x.d as date) as decision_date, b.session_date as matched_at, b.source_id, b.close from (" + DECISIONS + ") x left join lateral (select * from {bars_multi} b where b.listing_id = x.listing_id and b.session_date <= x.d order by session_date desc, source_id limit 1) b on true")
def s6_frozen_price(v):
    d = v.sql(DECISIONS).select("listing_id", F.col("d").cast("date").alias("decision_date"))
    return market.latest_at(v.bars_multi, d)


@query("select c.exchange, c.calendar_date, (select min(o.calendar_date) from {calendar} o where o.exchange = c.exchange and o.is_open and o.calendar_date > c.calendar_date) as next_session, c.is_open as is_session from {calendar} c")
def n4_next_session(v):
    return market.next_session(v.calendar.select("exchange", "calendar_date"), v.calendar, "calendar_date")


# -- slowly changing tables ---------------------------------------------------------------------------------------

OBSERVED = "select o_custkey as k, cast(o_orderdate as date) as seen, case when o_totalprice > 250000 then 'high' else 'low' end as state from {orders}"


@query("""with d as (select k, seen, count(distinct state) as n, min(state) as state from (""" + OBSERVED + """) group by 1, 2), s as (select *, coalesce(lag(state) over w = state and lag(n) over w = 1 and n = 1, false) as same from d window w as (partition by k order by seen))
    select k, case when n = 1 then state end as state, seen as valid_from, lead(seen) over (partition by k order by seen) as valid_to, n > 1 as conflict from s where not same""")
def s14_scd2_append(v):
    return scd.scd2(v.sql(OBSERVED), ["k"], "seen", ["state"])


@query("select o_custkey as k, max(cast(o_orderdate as date)) as at, arg_max(o_orderpriority, (o_orderdate, o_orderpriority)) as priority from {orders} group by 1")
def s15_latest_wins(v):
    o = v.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("at"), F.col("o_orderpriority").alias("priority"))
    return scd.latest_wins(o, ["k"], "at", ["priority"])


@query("select o_custkey as k, max(cast(o_orderdate as date)) as at, arg_max(p, (o_orderdate, p)) filter (where p is not null) as priority from (select *, case when o_orderstatus <> 'P' then o_orderpriority end as p from {orders}) group by 1")
def s15_coalesce_latest(v):
    o = v.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("at"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("priority"))
    return scd.coalesce_latest(o, ["k"], "at", ["priority"])


@query("select listing_id, kind, identifier from {identifiers} where valid_from <= date '1998-03-01' and (valid_to is null or date '1998-03-01' < valid_to)")
def f7_valid_at(v):
    return scd.valid_at(v.identifiers, F.lit("1998-03-01").cast("date")).select("listing_id", "kind", "identifier")


SPANS = "select o_custkey as k, cast(o_orderdate as date) as valid_from, cast(o_orderdate + interval 40 day as date) as valid_to from {orders}"


@query("select k, valid_from, valid_to, earlier_end from (select *, max(valid_to) over (partition by k order by valid_from, valid_to rows between unbounded preceding and 1 preceding) as earlier_end from (" + SPANS + ")) where earlier_end > valid_from")
def f10_interval_overlaps(v):
    return scd.overlaps(v.sql(SPANS), ["k"])
