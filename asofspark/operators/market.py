"""Bars, factors, capital, limits and calendars for all listings and sessions at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scd import asof, contains
from .status import columns

KEY = ("listing_id", "session_date")


def select_bar(bars: DataFrame, values: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """One row per key: the values of the least source if all sources agree, else a conflict without values."""
    g = bars.groupBy(*key).agg(F.count_distinct("source_id").alias("n_sources"), F.min(F.struct(*values)).alias("lo"), F.max(F.struct(*values)).alias("hi"), F.min("source_id").alias("source_id"))
    clash = ~F.col("lo").eqNullSafe(F.col("hi"))
    return g.select(*key, "n_sources", clash.alias("conflict"), F.when(~clash, F.col("source_id")).alias("source_id"), *[F.when(~clash, F.col(f"lo.{v}")).alias(v) for v in values])


def bar_conflicts(bars: DataFrame, values: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """Keys whose source rows differ in any value."""
    g = bars.groupBy(*key).agg(F.count("*").alias("n_rows"), F.count_distinct(F.struct(*values)).alias("n_variants"), F.array_sort(F.collect_set("source_id")).alias("sources"))
    return g.where("n_variants > 1")


def adjusted_close(bars: DataFrame, factors: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Close times multiplier; missing or disagreeing multipliers are unavailable."""
    f = factors.groupBy(*key).agg(F.min("multiplier").alias("lo"), F.max("multiplier").alias("hi"))
    out = bars.join(f, list(key), "left")
    return out.select(*bars.columns, *columns(F.col("close") * F.col("lo"), ("missing_bar", F.col("close").isNull()), ("missing_factor", F.col("lo").isNull()), ("factor_conflict", F.col("lo") != F.col("hi"))))


def limit_label() -> Column:
    c, lo, hi = F.col("close"), F.col("lower_limit"), F.col("upper_limit")
    up = F.when((F.col("low") == hi) & (F.col("high") == hi), "locked_up").otherwise("limit_up")
    down = F.when((F.col("low") == lo) & (F.col("high") == lo), "locked_down").otherwise("limit_down")
    return F.when(lo.isNull() | hi.isNull() | c.isNull(), "unavailable").when(c == hi, up).when(c == lo, down).otherwise("not_at_limit")


def limit_status(bars: DataFrame, limits: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return bars.join(limits.select(*key, "lower_limit", "upper_limit"), list(key), "left").withColumn("limit_status", limit_label())


def capital_at(points: DataFrame, capital: DataFrame, day: str = "session_date") -> DataFrame:
    """Share capital effective at each point; sources that disagree are a conflict, else the least source."""
    c = capital.select(F.col("listing_id").alias("_l"), "effective_from", "effective_to", "source_id", "total_shares")
    hit = points.select("listing_id", day).join(c, (F.col("listing_id") == F.col("_l")) & contains(F.col(day), "effective_from", "effective_to"), "left")
    g = hit.groupBy("listing_id", day).agg(F.count("source_id").alias("n"), F.min("total_shares").alias("lo"), F.max("total_shares").alias("hi"), F.min("source_id").alias("source_id"))
    return g.select("listing_id", day, "source_id", *columns(F.col("lo").cast("double"), ("missing_capital", F.col("n") == 0), ("capital_conflict", F.col("lo") != F.col("hi"))))


def capital_latest(points: DataFrame, capital: DataFrame, day: str = "session_date", clock: str | None = None) -> DataFrame:
    """The newest capital observation at or before the day (and retrieved by the clock): effective, retrieved, source."""
    if clock is None:
        return asof(points.select("listing_id", day), capital, ["listing_id"], day, "effective_from", ["total_shares", "source_id"], tie=[F.desc("retrieved_on"), "source_id"])
    c = capital.withColumnRenamed("listing_id", "_l")
    hit = points.select("listing_id", day, clock).join(c, (F.col("listing_id") == F.col("_l")) & (F.col("effective_from") <= F.col(day)) & (F.col("retrieved_on") <= F.col(clock)), "left")
    w = Window.partitionBy("listing_id", day, clock).orderBy(F.desc("effective_from"), F.desc("retrieved_on"), "source_id")
    return hit.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("listing_id", day, clock, F.col("effective_from").alias("matched_at"), "total_shares", "source_id")


def market_cap(bars: DataFrame, capital: DataFrame) -> DataFrame:
    """Close times shares in effect."""
    shares = capital_at(bars, capital).select(*KEY, F.col("value").alias("shares"), F.col("unavailable_reason").alias("why"))
    return bars.join(shares, list(KEY), "left").select(*KEY, "close", "shares", *columns(F.col("close") * F.col("shares"), ("missing_bar", F.col("close").isNull()), ("missing_capital", F.col("why") == "missing_capital"), ("capital_conflict", F.col("why") == "capital_conflict")))


def latest_at(prices: DataFrame, decisions: DataFrame) -> DataFrame:
    """Newest session at or before each decision, ties by source. decisions: listing_id, decision_date."""
    return asof(decisions, prices, ["listing_id"], "decision_date", "session_date", ["source_id", "close"], tie=["source_id"])


def next_session(points: DataFrame, calendar: DataFrame, day: str) -> DataFrame:
    """The first open day strictly after each day of its exchange, and whether the day itself is a session.

    Days and open days are one sorted stream per exchange: as-of backwards in time."""
    opened = calendar.where("is_open").select("exchange", F.col("calendar_date").alias("_t"), F.col("calendar_date").alias("_open"))
    stream = points.select("exchange", F.col(day).alias("_t"), F.lit(True).alias("_ask")).distinct().unionByName(opened, allowMissingColumns=True)
    after = Window.partitionBy("exchange").orderBy("_t").rangeBetween(1, Window.unboundedFollowing)
    stream = stream.withColumn("_t", F.unix_date("_t"))
    same = Window.partitionBy("exchange", "_t")
    out = stream.select("exchange", "_t", "_ask", F.min("_open").over(after).alias("next_session"), F.max("_open").over(same).isNotNull().alias("is_session"))
    return out.where("_ask").select("exchange", F.date_from_unix_date(F.col("_t").cast("int")).alias(day), "next_session", "is_session")


def summary(bars: DataFrame, states: DataFrame, factors: DataFrame, capital: DataFrame, limits: DataFrame) -> DataFrame:
    """Selected bar, state, adjusted close, market cap and limit status of each key, missing parts NULL with a warning.

    Every part is aggregated to the key first, so that all joins share one partitioning by (listing, session)."""
    f = factors.groupBy(*KEY).agg(F.when(F.min("multiplier") == F.max("multiplier"), F.min("multiplier")).alias("multiplier"))
    cap = capital_at(bars, capital).select(*KEY, F.col("value").alias("shares"))
    x = bars.join(states.drop("listing_state"), list(KEY), "left").join(f, list(KEY), "left").join(cap, list(KEY), "left").join(limits, list(KEY), "left")
    warn = lambda c, name: F.when(F.col(c).isNull(), F.lit(name))
    return x.select(*KEY, "close", "is_trading", (F.col("close") * F.col("multiplier")).alias("adjusted_close"), (F.col("close") * F.col("shares")).alias("market_cap"), limit_label().alias("limit_status"), F.array_compact(F.array(warn("is_trading", "state"), warn("multiplier", "factor"), warn("shares", "capital"), warn("upper_limit", "limit"))).alias("warnings"))


