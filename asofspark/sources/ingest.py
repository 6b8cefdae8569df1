"""Normalisation, mapping, planning and append-only ledgers of ingested records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofspark.functions.scalars import content_hash, local_date
from asofspark.operators.scd import slab_join


def content_id(*parts: Column | str) -> Column:
    return content_hash(*[F.col(p) if isinstance(p, str) else p for p in parts])


#: Where the providers' daily rows have each field, as SQL over their text columns.
SHAPES = {
    "flags": {"code": "code", "session_date": "try_cast(date as date)", "trading": "tradestatus = '1'", "special_treatment": "case when isST in ('0', '1') then isST = '1' end", "open": "open", "high": "high", "low": "low", "close": "close", "previous_close": "preclose", "volume": "volume", "amount": "amount"},
    "klines": {"code": "substr(code, 4)", "session_date": "try_cast(substr(time_key, 1, 10) as date)", "trading": "try_cast(volume as bigint) > 0", "special_treatment": "cast(null as boolean)", "open": "open", "high": "high", "low": "low", "close": "close", "previous_close": "last_close", "volume": "volume", "amount": "turnover"},
}


def daily(raw: DataFrame, shape: str) -> DataFrame:
    """Text rows of a provider's shape in the columns of ``flags``, from which states and bars are made."""
    m = SHAPES[shape]
    names = {"session_date": "date", "trading": "tradestatus", "special_treatment": "isST", "previous_close": "preclose"}
    as_text = {"trading": f"case when {m['trading']} then '1' else '0' end", "special_treatment": f"case when {m['special_treatment']} then '1' when not ({m['special_treatment']}) then '0' end", "session_date": f"cast({m['session_date']} as string)"}
    return raw.select(*[F.expr(as_text.get(c, e)).alias(names.get(c, c)) for c, e in m.items()])


def daily_states(raw: DataFrame) -> DataFrame:
    """Market states of all provider rows (text columns code, date, tradestatus, isST); the special-treatment flag may be NULL."""
    st = F.when(F.col("isST").isin("0", "1"), F.col("isST") == "1")
    return raw.select("code", F.expr("try_cast(date as date)").alias("session_date"), (F.col("tradestatus") == "1").alias("is_trading"), (F.col("tradestatus") != "1").alias("is_suspended"), st.alias("special_treatment"))


def daily_bars(raw: DataFrame) -> DataFrame:
    """Bars of trading rows only: a day without trade has a state, never an invented bar."""
    number = lambda c, t="double": F.expr(f"try_cast({c} as {t})").alias(c)
    return raw.where("tradestatus = '1'").select("code", F.expr("try_cast(date as date)").alias("session_date"), *map(number, ("open", "high", "low", "close")), number("preclose").alias("previous_close"), number("volume", "bigint"), number("amount"))


def split_daily(raw: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(states of all rows, bars of trading rows), both with resolved listing ids; unresolved codes have NULL."""
    return daily_states(raw).join(codes, "code", "left"), daily_bars(raw).join(codes, "code", "left")


def actions(raw: DataFrame) -> DataFrame:
    """Per-10-share terms as per-share, records without any term dropped, a content id for each."""
    ten = lambda c: (F.expr(f"try_cast({c} as double)") / 10).alias(c)
    x = raw.select("code", "ex_date", ten("cash"), ten("bonus"), ten("transfer")).where("cash is not null or bonus is not null or transfer is not null")
    return x.withColumn("record_id", content_id("code", "ex_date", F.round("cash", 6), F.round("bonus", 6), F.round("transfer", 6)))


def share_capital(raw: DataFrame, unit: int = 10_000) -> DataFrame:
    """Share counts of text rows (code, change_date, total, circulating, restricted, in units of ``unit`` shares) as whole
    shares with a content id. Rows without a total or a date say nothing and are dropped; equal records count once."""
    shares = lambda c: F.round(F.expr(f"try_cast(replace({c}, ',', '') as double)") * unit).cast("long").alias(f"{c}_shares")
    x = raw.select("code", F.expr("try_cast(change_date as date)").alias("effective_on"), shares("total"), shares("circulating"), shares("restricted")).where("total_shares is not null and effective_on is not null").distinct()
    return x.withColumn("record_id", content_id("code", "effective_on", "total_shares", "circulating_shares", "restricted_shares"))


def financial_long(wide: DataFrame, keys: Sequence[str], fields: Sequence[str], asked: Column | None = None) -> DataFrame:
    """One row per field that has a value (not NULL or NaN); repeated keys are dropped as a whole and flagged elsewhere.
    Rows outside the period that was ``asked`` for are skipped before repeats are looked for."""
    inside = wide if asked is None else wide.where(F.coalesce(asked, F.lit(False)))
    one = inside.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n = 1")
    return one.select(*keys, *[F.col(f).cast("double").alias(f) for f in fields]).unpivot(list(keys), list(fields), "field", "raw_value").where("raw_value is not null and not isnan(raw_value)")


def financial_counters(wide: DataFrame, by: Sequence[str], keys: Sequence[str], fields: Sequence[str], asked: Column | None = None) -> DataFrame:
    """Rows, repeated rows and missing values of each unit within the period that was ``asked`` for, and rows outside it."""
    gaps = sum((F.col(f).isNull().cast("int") for f in fields), F.lit(0))
    x = wide.withColumn("_in", F.lit(True) if asked is None else F.coalesce(asked, F.lit(False)))
    x = x.withColumn("_n", F.count_if("_in").over(Window.partitionBy(*keys))).withColumn("_g", F.when(F.col("_in"), gaps).otherwise(0))
    return x.groupBy(*by).agg(F.count_if("_in").alias("n_rows"), F.count_if(F.col("_in") & (F.col("_n") > 1)).alias("n_repeated"), F.sum("_g").alias("n_missing"), F.count_if(~F.col("_in")).alias("n_outside"))


def period_bounds(period_end: str = "period_end", basis: str = "value_basis") -> list[Column]:
    """period_type and period_start: instant values have no start, year-to-date ones that of the year, others the quarter's."""
    e = F.col(period_end)
    kind = F.when(F.quarter(e) == 4, "annual").when(F.quarter(e) == 2, "half_year").otherwise("quarter")
    start = F.when(F.col(basis) == "instant", F.lit(None).cast("date")).when(F.col(basis) == "year_to_date", F.trunc(e, "year")).otherwise(F.trunc(e, "quarter"))
    return [kind.alias("period_type"), start.alias("period_start")]


def calendar_rules() -> dict[str, Column]:
    reason = F.col("closure_reason").isNotNull()
    return {"closed_without_reason": ~F.col("is_open") & ~reason, "open_with_reason": F.col("is_open") & reason}


#: Units of money.
MONEY = ("currency", "currency_per_share")


def map_fields(rows: DataFrame, mappings: DataFrame, metrics: DataFrame, mode: str) -> DataFrame:
    """Rows with their canonical metric: exactly one mapping in scope and right unit is mapped (value = raw * scale), none is
    unmapped, several a conflict. Values of money need a currency, others must not have one (rows without that column are
    not asked). The catalogs of mappings and metrics are joined by key after counting, so no row multiplies."""
    m = mappings.where((F.col("scope") == "both") | (F.col("scope") == mode)).join(metrics.select("metric", F.col("unit").alias("metric_unit")), "metric")
    g = m.groupBy("provider_id", "field").agg(F.count_distinct("metric").alias("n"), F.min("metric").alias("metric"), F.min("scale").alias("scale"), F.min("metric_unit").alias("metric_unit"))
    x = rows.join(g, ["provider_id", "field"], "left")
    status = F.when(F.col("n").isNull(), "unmapped").when(F.col("n") > 1, "conflict").when(F.col("unit") != F.col("metric_unit"), "unit_mismatch")
    if "currency" in rows.columns:
        money = F.col("metric_unit").isin(*MONEY)
        status = status.when(money & F.col("currency").isNull(), "currency_missing").when(~money & F.col("currency").isNotNull(), "currency_unexpected")
    status = status.otherwise("mapped")
    x = x.withColumn("status", status)
    ok = F.col("status") == "mapped"
    return x.select(*rows.columns, F.when(ok, F.col("metric")).alias("metric"), F.when(ok, F.col("raw_value") * F.col("scale")).alias("value"), "status")


def observations(mapped: DataFrame, identities: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations with identity and content id, receipts): every unit has a receipt, an empty period one of zero rows,
    and a unit with rows of which none is mapped has failed.

    A row's company is that of its code on the day of ``retrieved_at`` in local time, from identities (code, company_id,
    valid_from, valid_to); a code without one that day is not_found, one of several companies ambiguous. Codes are resolved
    once a day, so that a reused code multiplies no rows."""
    ok = mapped.where("status = 'mapped'").withColumn("_day", local_date(F.col("retrieved_at")))
    asked = ok.select("code", F.col("_day").alias("as_of")).distinct()
    one = slab_join(asked, identities.select("code", "company_id", "valid_from", "valid_to"), ["code"], "as_of").groupBy("code", F.col("as_of").alias("_day")).agg(F.count_distinct("company_id").alias("_n"), F.min("company_id").alias("_c"))
    obs = ok.join(one, ["code", "_day"], "left").select(
        "unit_id",
        "code",
        F.when(F.col("_n") == 1, F.col("_c")).alias("company_id"),
        F.when(F.col("_n") == 1, "resolved").when(F.col("_n") > 1, "ambiguous").otherwise("not_found").alias("identity_status"),
        "metric",
        "period_end",
        "value",
        content_id("code", "metric", "period_end", "provider_id").alias("observation_id"),
    )
    n = mapped.groupBy("unit_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("status") == "mapped").alias("n_mapped"))
    r = units.select("unit_id").join(n, "unit_id", "left").select("unit_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_mapped", F.lit(0)).alias("n_mapped"))
    return obs, r.withColumn("status", F.when(F.col("n_rows") == 0, "empty").when(F.col("n_mapped") == 0, "failed").otherwise("succeeded"))


def ledger_append(existing: DataFrame, new: DataFrame, key: str = "id", content: str = "content_hash", bound: DataFrame | None = None) -> DataFrame:
    """Each new row labelled insert, duplicate (same id and content) or conflict (same id, other content, or content that is
    bound to another id). Equal new rows count as one; new rows of one id with different contents conflict, and so do rows
    without id or content. ``existing`` needs the rows of the new ids only, if ``bound`` has those of the new contents."""
    return ledger_labels(existing, new.select(key, content).distinct(), key, content, existing if bound is None else bound)


def ledger_labels(existing: DataFrame, every: DataFrame, key: str, content: str, bound: DataFrame) -> DataFrame:
    """The labels of ``ledger_append`` for distinct pairs."""
    n = every.where(F.col(key).isNotNull() & F.col(content).isNotNull())
    own = n.groupBy(key).agg(F.count("*").alias("_own"))
    by_id = existing.groupBy(key).agg(F.min(content).alias("_have"))
    by_content = bound.select(content, F.col(key).alias("_bound")).unionByName(n.select(content, F.col(key).alias("_bound"))).groupBy(content).agg(F.min("_bound").alias("_lo"), F.max("_bound").alias("_hi"))
    x = n.join(own, key).join(by_id, key, "left").join(by_content, content)
    label = F.when((F.col("_own") > 1) | (F.col("_have") != F.col(content)) | (F.col("_lo") != F.col("_hi")), "conflict").when(F.col("_have").isNotNull(), "duplicate").otherwise("insert")
    broken = every.where(F.col(key).isNull() | F.col(content).isNull()).select(key, content, F.lit("conflict").alias("action"))
    return x.select(key, content, label.alias("action")).unionByName(broken)


def work_units(plan: DataFrame) -> DataFrame:
    """plan (plan_id, domain, market, start_date, end_date) as one unit per calendar year, clipped, with a deterministic key."""
    years = F.explode(F.sequence(F.year("start_date"), F.year("end_date"))).alias("y")
    x = plan.select("plan_id", "domain", "market", "start_date", "end_date", years)
    lo = F.greatest("start_date", F.make_date(F.col("y"), F.lit(1), F.lit(1)))
    hi = F.least("end_date", F.make_date(F.col("y"), F.lit(12), F.lit(31)))
    x = x.select("plan_id", "domain", "market", lo.alias("slice_from"), hi.alias("slice_to"))
    return x.withColumn("checkpoint_key", F.concat_ws(":", "domain", "market", F.col("slice_from").cast("string"), F.col("slice_to").cast("string")))


def symbol_buckets(symbols: DataFrame, size: int, by: Sequence[str]) -> DataFrame:
    """Symbols of each plan in buckets of ``size``, in order."""
    i = F.row_number().over(Window.partitionBy(*by).orderBy("symbol")) - 1
    return symbols.select(*by, "symbol", F.floor(i / size).cast("int").alias("bucket"))


def pending_units(units: DataFrame, checkpoints: DataFrame, key: str = "checkpoint_key", order: str = "attempt") -> DataFrame:
    """Units whose newest checkpoint isn't a success."""
    done = checkpoints.groupBy(key).agg(F.max_by("status", order).alias("status")).where("status = 'succeeded'")
    return units.join(done.select(key), key, "left_anti")


def dataset_manifest(checkpoints: DataFrame, by: Sequence[str]) -> DataFrame:
    """One hash of each dataset over its (checkpoint, content) pairs, in whatever order they come, as a tree: pairs fall
    into leaves by the first four hex digits of their own hash, leaves into branches by the first two, and each node's hash
    is over its sorted members. So no row holds more than a small part of a large dataset."""
    line = F.sha2(F.concat_ws("=", "checkpoint_key", "content_hash"), 256)
    nodes = checkpoints.select(*by, line.alias("node"), line.alias("h"), F.lit(1).cast("long").alias("n"))
    for digits in (4, 2, 0):
        members = F.transform(F.array_sort(F.collect_list(F.struct("node", "h"))), lambda x: x["h"])
        nodes = nodes.groupBy(*by, F.substring("node", 1, digits).alias("up")).agg(F.sha2(F.concat_ws("\n", members), 256).alias("h"), F.sum("n").alias("n")).withColumnRenamed("up", "node")
    return nodes.select(*by, F.col("n").alias("n_checkpoints"), F.col("h").alias("manifest_hash"))


def select_source(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """The first eligible provider of each request by role order, and why others were denied.
    requests: request_id, mode, field, excluded_provider; profiles: provider_id, role, field, strict_allowed, enabled."""
    strict = F.col("mode") == "strict"
    rank = F.when(F.col("role") == "primary", 0).when(F.col("role") == "secondary", F.when(strict, 2).otherwise(1)).otherwise(F.when(strict, 1).otherwise(2))
    x = requests.join(profiles, "field", "left").withColumn("_rank", rank)
    why = F.when(F.col("provider_id").isNull(), "no_provider").when(F.col("provider_id") == F.col("excluded_provider"), "excluded").when(~F.col("enabled"), "disabled").when(strict & ~F.col("strict_allowed"), "not_strict")
    x = x.withColumn("_why", why)
    denied = F.array_sort(F.collect_list(F.when(F.col("_why").isNotNull() & F.col("provider_id").isNotNull(), F.concat_ws(":", "provider_id", "_why"))))
    g = x.groupBy("request_id").agg(F.min(F.when(F.col("_why").isNull(), F.struct("_rank", "provider_id"))).alias("s"), denied.alias("denials"))
    return g.select("request_id", F.col("s.provider_id").alias("provider_id"), "denials")
