"""Queries: scalar functions, immutable sinks and streams, run on the given tables through scratch folders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from asofspark.functions import scalars
from asofspark.sources import io, merge
from asofspark.sources.store import Store, scratch_dir
from asofspark.streaming import feeds

from . import core, ingest
from .testdata import Registry

query = Registry()

CODES = "select o_orderkey as k, case o_orderkey % 4 when 0 then 'sh.' when 1 then 'SZ.' when 2 then ' bj.' else 'xx' end || case o_custkey % 5 when 0 then '688' when 1 then '300' when 2 then '600' when 3 then '000' else '9' end || lpad(cast(o_custkey % 1000 as varchar(9)), 3, '0') as code, o_totalprice / 400000 - 0.5E0 as x, cast(o_orderdate as date) as d from {orders}"


TEXTS = "select event_id as k, ts, case event_id % 4 when 0 then sha256(event_type) when 1 then upper(sha256(event_type)) when 2 then event_type end as digest, lpad(cast(user_id as varchar(9)), 6, case when event_id % 7 = 0 then ' ' else '0' end) as symbol, event_type || ' /' || cast(user_id as varchar(9)) || '&=+' as label, value / 100 - 0.03E0 as x from {events}"


@query("""select k, coalesce(regexp_matches(digest, '^[0-9a-f]+$') and length(digest) = 64, false) as digest_ok, regexp_matches(symbol, '^[0-9][0-9][0-9][0-9][0-9][0-9]$') as symbol_ok, cast(ts + interval 8 hour as date) as trading_date, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as utc_text,
    replace(url_encode(label), '%20', '+') as path_value, case when x >= 0 or floor(abs(x) * 100 + 0.5) = 0 then '+' else '-' end || printf('%.0f%%', floor(abs(x) * 100 + 0.5)) as percent from (""" + TEXTS + ")")
def fn_text_and_time_functions(v):
    t = v.sql(TEXTS.replace("sha256(event_type)", "sha2(event_type, 256)"))
    at = F.col("ts").cast("timestamp")
    return t.select("k", scalars.is_sha256(F.col("digest")).alias("digest_ok"), scalars.is_symbol(F.col("symbol")).alias("symbol_ok"), scalars.local_date(at).alias("trading_date"), scalars.canonical_utc(at).alias("utc_text"), scalars.partition_value(F.col("label")).alias("path_value"), scalars.signed_percent(F.floor(F.abs(F.col("x")) * 100 + 0.5) / 100 * F.when(F.col("x") >= 0, 1.0).otherwise(-1.0), 0).alias("percent"))


@query("""select k, case when regexp_matches(upper(trim(code)), '^(SH|SZ)[.][0-9][0-9][0-9][0-9][0-9][0-9]$') then upper(trim(code)) end as canonical, case substr(upper(code), 1, 2) when 'SH' then 'XSHG' when 'SZ' then 'XSHE' when 'BJ' then 'XBSE' end as exchange,
    (substr(upper(code), 1, 3) = 'SH.' and substr(code, 4, 3) in ('600', '601', '603', '605', '688', '689')) or (substr(upper(code), 1, 3) = 'SZ.' and substr(code, 4, 3) in ('000', '001', '002', '003', '300', '301', '302')) as a_share,
    case when substr(upper(code), 1, 3) = 'SH.' and substr(code, 4, 3) in ('688', '689') then 'star' when substr(upper(code), 1, 3) = 'SZ.' and substr(code, 4, 3) in ('300', '301', '302') then 'chinext' else 'main' end as board,
    year(d) * 4 + quarter(d) as quarter_ordinal, case when x > 0 then 'positive' when x < 0 then 'negative' else 'flat' end as direction, round(case when x < 0 then 50 - abs(x) / 1.3E0 * 45 else 50 end, 6) as bar_start, sha256(code || '|' || k || '|') as content_hash from (""" + CODES + ")")
def fn_scalar_functions(v):
    c = F.col("code")
    return v.sql(CODES).select("k", scalars.canonical_code(c).alias("canonical"), scalars.exchange_of(c).alias("exchange"), scalars.is_a_share(c).alias("a_share"), scalars.board(F.upper(c)).alias("board"), scalars.quarter_ordinal(F.col("d")).alias("quarter_ordinal"), scalars.bar_direction(F.col("x")).alias("direction"), F.round(scalars.bar_start(F.col("x"), 1.3), 6).alias("bar_start"), scalars.content_hash(c, F.col("k"), F.lit(None)).alias("content_hash"))


def scratch(v) -> str:
    return f"{scratch_dir(v.spark)}/asofspark-{uuid.uuid4().hex}"


VERSIONED = "select listing_id, session_date, 'src' as source_id, close, volume, 'v' || cast(listing_id % 2 as varchar(2)) as dataset_version_id, case when listing_id % 3 = 0 then 'E' else 'O' end as exchange from {bars}"


@query("select listing_id, session_date, source_id, close, volume from (" + VERSIONED + ") where dataset_version_id = 'v1' and session_date between date '1996-03-01' and date '1998-02-01'")
def s1_s2_immutable_bars(v):
    root = scratch(v)
    bars = v.sql(VERSIONED)
    io.write_bars(bars, root)
    if io.ensure_bars(bars, root) != "unchanged":
        raise AssertionError("a repeated write must change nothing")
    return io.read_bars(v.spark, root, "v1", "1996-03-01", "1998-02-01").select("listing_id", "session_date", "source_id", "close", "volume")


@query("select listing_id, session_date, source_id, multiplier from (select listing_id, session_date, source_id, multiplier from {factors}) where session_date between date '1997-01-01' and date '1997-12-31'")
def s3_immutable_factors(v):
    root = scratch(v)
    factors = v.factors.select("listing_id", "session_date", "source_id", "multiplier", F.lit("v1").alias("dataset_version_id"))
    if (io.ensure_factors(factors, root), io.ensure_factors(factors, root)) != ("written", "unchanged"):
        raise AssertionError("a repeated write must change nothing")
    return io.read_factors(v.spark, root, "v1", "1997-01-01", "1997-12-31").select("listing_id", "session_date", "source_id", "multiplier")


MULTI = "select listing_id, session_date, source_id, close, volume, 'v' || cast(listing_id % 2 as varchar(2)) as dataset_version_id, case when listing_id % 3 = 0 then 'E' else 'O' end as exchange from {bars_multi}"


@query("select session_date, source_id, listing_id, close, volume from (" + MULTI + ") where dataset_version_id = 'v1' and listing_id = 7 and session_date between date '1996-01-01' and date '1997-06-01'")
def s4_range_read(v):
    root = scratch(v)
    io.write_bars(v.sql(MULTI), root)
    return io.read_bars(v.spark, root, "v1", "1996-01-01", "1997-06-01", 7).select("session_date", "source_id", "listing_id", "close", "volume")


@query("select session_date, source_id, round(multiplier, 8) as multiplier from {factors} where listing_id = 3 and session_date between date '1996-01-01' and date '1998-12-01'")
def s5_factor_range_read(v):
    root = scratch(v)
    io.write_factors(v.factors.select("listing_id", "session_date", "source_id", "multiplier", F.lit("v1").alias("dataset_version_id")), root)
    return io.read_factors(v.spark, root, "v1", "1996-01-01", "1998-12-01", 3).select("session_date", "source_id", F.round("multiplier", 8).alias("multiplier"))


def in_batches(rows, path: str, n: int = 3) -> None:
    """One file a micro-batch, rows dealt by their hash and so out of order."""
    rows.repartitionById(n, F.pmod(F.xxhash64(*rows.columns), F.lit(n)).cast("int")).write.parquet(path)


def buckets(v) -> int:
    return int(v.spark.conf.get("spark.sql.shuffle.partitions"))


def halves(rows):
    """Two halves of the rows by their hash, so that either has rows before and after the other's."""
    half = F.pmod(F.xxhash64(*rows.columns), F.lit(2))
    return rows.where(half == 0), rows.where(half == 1)


@query(core.query.sql["s14_scd2_append"])
def s14_scd2_merge(v):
    store, columns = Store(v.spark, scratch(v), buckets(v)), (["k"], "seen", ["state"])
    for part in halves(v.sql(core.OBSERVED)):
        merge.scd2(store, "states", part, *columns)
    return merge.scd2_intervals(store, "states", *columns)


@query(core.query.sql["s15_latest_wins"])
def s15_latest_merge(v):
    store = Store(v.spark, scratch(v), buckets(v))
    for part in halves(v.orders.select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("at"), F.col("o_orderpriority").alias("priority"))):
        merge.latest(store, "newest", part, ["k"], "at", ["priority"])
    return store.read("newest")


@query(core.query.sql["s15_coalesce_latest"])
def s15_coalesce_merge(v):
    store = Store(v.spark, scratch(v), buckets(v))
    for part in halves(v.orders.select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("at"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("priority"))):
        merge.coalesced(store, "newest", part, ["k"], "at", ["priority"])
    return store.read("newest").select("k", "at", "priority")


@query(ingest.query.sql["s16_ledger_append"])
def s16_ledger_merge(v):
    store = Store(v.spark, scratch(v), buckets(v))
    merge.ledger(store, "ledger", v.sql(ingest.OLD))
    return merge.ledger(store, "ledger", v.sql(ingest.NEW))


OBSERVED = "select cast(event_id % 7000 as varchar(9)) as id, case when event_id % 900 = 8 then null else 'h' || cast(case when event_id % 500 = 3 then event_id else event_id % 7000 end as varchar(9)) end as content_hash, ts as observed_at from {events}"


@query(f"with n as (select distinct id, content_hash from ({OBSERVED})), o as (select id, count(content_hash) as own from n group by 1), b as (select content_hash, count(distinct id) as ids from n where content_hash is not null group by 1) select n.id, n.content_hash, case when n.content_hash is null or own > 1 or ids > 1 then 'conflict' else 'ledger' end as kind from n join o using (id) left join b using (content_hash)")
def r1_stream_append(v):
    root = scratch(v)
    rows = v.sql(OBSERVED).withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    in_batches(rows, f"{root}/in")
    source = v.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    feeds.append_stream(source, f"{root}/ledger", f"{root}/checkpoint", buckets=buckets(v)).awaitTermination()
    return feeds.appended(v.spark, f"{root}/ledger").select("id", "content_hash", "kind")


@query("select fact_id, lead(known_from) over (partition by company_id, period_end, provider_id, revision order by known_from, fact_id) as known_to from {corrections}")
def r2_stream_revisions(v):
    root = scratch(v)
    facts = v.corrections
    in_batches(facts, f"{root}/in")
    source = v.spark.readStream.schema(facts.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    feeds.revision_stream(source, f"{root}/intervals", f"{root}/checkpoint", ["company_id", "period_end", "provider_id", "revision"], buckets(v)).awaitTermination()
    return feeds.current_intervals(v.spark, f"{root}/intervals").select("fact_id", "known_to")


VIEWED = "select event_id as view_id, user_id as security_id, ts as decision_at, value + 1 as price from {events} where event_type = 'view'"
PRICED = "select user_id as p_security_id, ts as priced_at, value + 2 as close from {events} where event_type = 'click'"


@query("select v.view_id, v.security_id, p.priced_at, round(p.close / v.price - 1, 6) as realized_return, case when p.priced_at is null then 'pending' else 'mature' end as status from (select *, decision_at + interval 5 day as target from (" + VIEWED + ")) v asof left join (select p_security_id, priced_at, min(close) as close from (" + PRICED + ") group by 1, 2) p on v.security_id = p.p_security_id and v.target <= p.priced_at")
def r3_stream_maturity(v):
    root = scratch(v)
    views = v.sql(VIEWED).withColumn("decision_at", F.col("decision_at").cast("timestamp"))
    prices = v.sql(PRICED).withColumn("priced_at", F.col("priced_at").cast("timestamp"))
    in_batches(views, f"{root}/views")
    in_batches(prices, f"{root}/prices")
    stream = lambda df, name: v.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/{name}")
    feeds.maturity_stream(stream(views, "views"), stream(prices, "prices"), f"{root}/out", f"{root}/checkpoint", 5).awaitTermination()
    return feeds.maturity(v.spark, f"{root}/out").select(F.col("view_id").cast("long").alias("view_id"), F.col("security_id").cast("long").alias("security_id"), F.col("priced_at").cast("timestamp_ntz").alias("priced_at"), F.round("realized_return", 6).alias("realized_return"), "status")
