"""Universes: membership snapshots, intervals, differences and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scd import contains

KEY = ("universe_id", "listing_id")


def _sessions(daily: DataFrame) -> DataFrame:
    """The sessions of each universe with a dense index: a few rows per universe."""
    w = Window.partitionBy("universe_id").orderBy("session_date")
    return daily.select("universe_id", "session_date").distinct().select("*", F.row_number().over(w).alias("i"), F.lead("session_date").over(w).alias("next_session"))


def intervals_from_snapshots(daily: DataFrame) -> DataFrame:
    """Continuous intervals: each closes at the first session its member is absent from, the last at the day after the
    last session."""
    s = _sessions(daily)
    w = Window.partitionBy(*KEY).orderBy("i")
    runs = daily.select(*KEY, "session_date").distinct().join(s, ["universe_id", "session_date"]).withColumn("g", F.col("i") - F.row_number().over(w))
    return runs.groupBy(*KEY, "g").agg(F.min("session_date").alias("valid_from"), F.max_by(F.coalesce("next_session", F.date_add("session_date", 1)), "i").alias("valid_to")).drop("g")


def month_end_snapshots(daily: DataFrame, unit: str = "month") -> DataFrame:
    """Discrete mode: memberships of the last session of each month (or other unit), as one-day intervals."""
    last = daily.groupBy("universe_id", F.trunc("session_date", unit).alias("m")).agg(F.max("session_date").alias("session_date")).drop("m")
    return daily.select(*KEY, "session_date").distinct().join(last, ["universe_id", "session_date"], "left_semi").select(*KEY, F.col("session_date").alias("valid_from"), F.date_add("session_date", 1).alias("valid_to"))


def unobserved_intervals(observed: DataFrame, start: str, end: str) -> DataFrame:
    """Gaps between observed days of each universe within [start, end)."""
    d = observed.select("universe_id", F.col("session_date").alias("d")).distinct()
    w = Window.partitionBy("universe_id").orderBy("d")
    gaps = d.select("universe_id", F.date_add("d", 1).alias("gap_from"), F.coalesce(F.lead("d").over(w), F.lit(end).cast("date")).alias("gap_to"))
    head = d.groupBy("universe_id").agg(F.lit(start).cast("date").alias("gap_from"), F.min("d").alias("gap_to"))
    return gaps.unionByName(head).where("gap_from < gap_to")


def steps(daily: DataFrame) -> DataFrame:
    """Entries and exits of each session against the one before, change ratio |A ^ B| / max(|A|, |B|, 1)."""
    s = _sessions(daily).select("universe_id", "session_date", "i")
    m = daily.select(*KEY, "session_date").distinct().join(s, ["universe_id", "session_date"])
    here = m.select(*KEY, "i", F.lit(1).alias("a"), F.lit(0).alias("b"))
    before = m.select(*KEY, (F.col("i") + 1).alias("i"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    per = here.unionByName(before).groupBy(*KEY, "i").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    g = per.groupBy("universe_id", "i").agg(F.sum("a").alias("members"), F.sum("b").alias("before"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("entries"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("exits"))
    out = g.join(s, ["universe_id", "i"]).where("i > 1")
    return out.select("universe_id", "session_date", "members", "entries", "exits", ((F.col("entries") + F.col("exits")) / F.greatest("members", "before", F.lit(1))).alias("change_ratio"))


def snapshot(memberships: DataFrame, identities: DataFrame, day: str) -> DataFrame:
    """Active members on a day, with identity (listing_id, name, industry) where it resolves."""
    d = F.lit(day).cast("date")
    return memberships.where(contains(d)).join(identities, "listing_id", "left").select(*KEY, "research_eligible", "tradable_eligible", F.col("name").isNotNull().alias("identity_resolved"), "name", "industry")


def diff(memberships: DataFrame, identities: DataFrame, start: str, end: str) -> DataFrame:
    """Members added, removed and changed between two days."""
    cols = ["research_eligible", "tradable_eligible", "identity_resolved", "name", "industry"]
    a = snapshot(memberships, identities, start).select(*KEY, F.struct(*cols).alias("a"))
    b = snapshot(memberships, identities, end).select(*KEY, F.struct(*cols).alias("b"))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, list(KEY), "full").select(*KEY, kind.alias("change")).where("change is not null")


def coverage(snap: DataFrame) -> DataFrame:
    """Counts of members and their flags by universe."""
    g = snap.groupBy("universe_id").agg(F.count("*").alias("members"), F.count_if("identity_resolved").alias("resolved"), F.count_if("research_eligible").alias("research"), F.count_if("tradable_eligible").alias("tradable"))
    return g.withColumn("resolved_ratio", F.try_divide(F.col("resolved").cast("double"), F.col("members").cast("double")))


def latest_versions(versions: DataFrame, key: Sequence[str], created: str, version: str) -> DataFrame:
    """The newest version of each definition, ties by the greater id."""
    w = Window.partitionBy(*key).orderBy(F.desc(created), F.desc(version))
    return versions.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def has_active(requests: DataFrame, memberships: DataFrame) -> DataFrame:
    """requests (universe_id, as_of) for which some member is active that day."""
    m = memberships.select(F.col("universe_id").alias("_u"), "valid_from", "valid_to")
    return requests.join(m, (F.col("universe_id") == F.col("_u")) & contains(F.col("as_of")), "left_semi")
