"""Slowly changing tables, and as-of and interval joins. Intervals are half-open, NULL is open."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains(day: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    return (F.col(start) <= day) & (F.col(end).isNull() | (day < F.col(end)))


def valid_at(df: DataFrame, day: Column, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    return df.where(contains(day, start, end))


def scd2(observations: DataFrame, keys: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """Intervals from observations: each closes the one before at its own date; different values at one date conflict,
    equal values in a row are one interval."""
    day = observations.groupBy(*keys, at).agg(F.count_distinct(F.struct(*values)).alias("n"), *[F.min(v).alias(v) for v in values])
    w = Window.partitionBy(*keys).orderBy(at)
    same = F.lag(F.struct(*values)).over(w).eqNullSafe(F.struct(*values)) & (F.lag("n").over(w) == 1) & (F.col("n") == 1)
    starts = day.withColumn("_same", F.coalesce(same, F.lit(False))).where("not _same")
    conflict = F.col("n") > 1
    return starts.select(*keys, *[F.when(~conflict, F.col(v)).alias(v) for v in values], F.col(at).alias("valid_from"), F.lead(at).over(w).alias("valid_to"), conflict.alias("conflict"))


def scd2_days(observations: DataFrame, keys: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """One row per key and date: its values, or NULLs and ``conflict``. Days of earlier calls may be among the observations,
    as what has been in conflict stays so."""
    known = F.coalesce(F.max("conflict"), F.lit(False)) if "conflict" in observations.columns else F.lit(False)
    day = observations.groupBy(*keys, at).agg(((F.count_distinct(F.struct(*values)) > 1) | known).alias("conflict"), *[F.min(v).alias(v) for v in values])
    return day.select(*keys, at, *[F.when(~F.col("conflict"), F.col(v)).alias(v) for v in values], "conflict")


def scd2_starts(days: DataFrame, keys: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """Days with ``starts`` (an interval begins) and ``valid_to``, the next start; the intervals are the rows that start."""
    w = Window.partitionBy(*keys).orderBy(at)
    same = F.lag(F.struct(*values)).over(w).eqNullSafe(F.struct(*values)) & ~F.lag("conflict").over(w) & ~F.col("conflict")
    later = Window.partitionBy(*keys).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, -1)
    return days.withColumn("starts", ~F.coalesce(same, F.lit(False))).withColumn("valid_to", F.min(F.when(F.col("starts"), F.col(at))).over(later))


def latest_wins(df: DataFrame, keys: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """The values of the newest row of each key, ties by value."""
    return df.groupBy(*keys).agg(F.max(F.struct(at, *values)).alias("r")).select(*keys, "r.*")


def coalesce_latest(df: DataFrame, keys: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """For each value column the newest non-null one."""
    return df.groupBy(*keys).agg(F.max(at).alias(at), *[F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(at, v))).alias(v) for v in values])


def overlaps(df: DataFrame, keys: Sequence[str], start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Rows whose interval begins before an earlier one of the key has ended."""
    w = Window.partitionBy(*keys).orderBy(start, F.coalesce(end, F.lit("9999-12-31").cast("date"))).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.coalesce(end, F.lit("9999-12-31").cast("date"))).over(w)
    return df.withColumn("earlier_end", before).where(F.col("earlier_end") > F.col(start))


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, columns: Sequence[str], tie: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Each left row with the newest right row of its keys at or before (or, if strict, before) its time.

    Both sides are one stream sorted by key and time, in which right values are carried forward: one shuffle of
    each side, no pairs. ``tie`` orders right rows of one time, the first wins.
    """
    order = Window.partitionBy(*keys, right_at).orderBy(*(tie or columns))
    r = right.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*keys, F.col(right_at).alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.struct(F.col(right_at).alias("matched_at"), *columns).alias("_r"))
    l_row = F.struct(*left.columns)
    stream = r.unionByName(left.select(*keys, F.col(left_at).alias("_t"), F.lit(0 if strict else 1).alias("_side"), l_row.alias("_l")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return stream.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_l is not null").select("_l.*", "_m.*")


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], day: str, start: str = "valid_from", end: str = "valid_to", how: str = "left") -> DataFrame:
    """Equi join on the keys with the right interval containing the left day."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = contains(F.col(day), start, end)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    return left.join(r, on, how).drop(*[f"_r_{k}" for k in keys])


def slab(day: Column, days: int) -> Column:
    """The number of the stretch of ``days`` days that holds a day."""
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / days).cast("int")


def slab_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], day: str, start: str = "valid_from", end: str = "valid_to", how: str = "left", days: int = 64, inclusive: bool = False) -> DataFrame:
    """Points with the intervals that contain their day, as an equi join on the keys and time slabs (keys may be none).

    A point lies in one slab; an interval is repeated for the slabs that it covers and that points lie in, so that a point
    meets only intervals near its day, however long a key's history is, and no pair twice. The slabs with points are one
    row beside the intervals: at most the span of the points by ``days`` numbers."""
    lo, hi = slab(F.col(start), days), slab(F.col(end), days)
    used = points.agg(F.collect_set(slab(F.col(day), days)).alias("_slabs"))
    covered = F.filter("_slabs", lambda s: (s >= lo) & (F.col(end).isNull() | (s <= hi)))
    r = intervals.crossJoin(F.broadcast(used)).withColumn("_slab", F.explode(covered)).drop("_slabs").withColumnsRenamed({k: f"_r_{k}" for k in keys})
    inside = (F.col(start) <= F.col(day)) & (F.col(end).isNull() | ((F.col(day) <= F.col(end)) if inclusive else (F.col(day) < F.col(end))))
    on = (F.col("_at") == F.col("_slab")) & inside
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    return points.withColumn("_at", slab(F.col(day), days)).join(r, on, how).drop("_at", "_slab", *[f"_r_{k}" for k in keys])
