"""Expected-return views, their outcomes and calibration, and ranked screens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asofspark.functions.scalars import signed_percent

from .status import columns, ratio

COMPONENTS = ("quality", "valuation", "revision", "event")


def compile_views(components: DataFrame, residuals: DataFrame | None = None, required: Sequence[str] = COMPONENTS) -> DataFrame:
    """Point estimate of each view: quantified contributions plus residual; needs exactly the required components."""
    g = components.groupBy("view_id").agg(F.sum("contribution").alias("s"), F.count("contribution").alias("n_quantified"), F.array_sort(F.collect_list("component")).alias("names"))
    if residuals is not None:
        g = g.join(residuals.select("view_id", "residual"), "view_id", "left")
    residual = F.coalesce("residual", F.lit(0.0)) if residuals is not None else F.lit(0.0)
    wrong = F.col("names") != F.array(*[F.lit(c) for c in sorted(required)])
    return g.select("view_id", "n_quantified", *columns(F.col("s") + residual, ("component_set_differs", wrong), ("no_quantified_component", F.col("n_quantified") == 0)))


def calibrate(views: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Absolute error, inside the 80 % interval, and direction of each view with its outcome."""
    x = views.join(outcomes.select("view_id", "realized_return"), "view_id")
    return x.select("view_id", F.abs(F.col("realized_return") - F.col("expected_return")).alias("absolute_error"), F.col("realized_return").between(F.col("p10"), F.col("p90")).alias("inside_interval"), (F.signum("realized_return") == F.signum("expected_return")).alias("direction_correct"))


def mature(views: DataFrame, prices: DataFrame, outcomes: DataFrame, horizon: int, today: str) -> DataFrame:
    """Views without an outcome: matured with the return of the adjusted close over ``horizon`` sessions after decision,
    pending, or unavailable for want of a price, of its source or of the adjustment for corporate actions.

    prices: security_id, session_date, close and, if known, multiplier (the adjustment) and source_id; without these
    columns closes count as adjusted and sourced. The sessions of a security are numbered once; decision and end are then
    two equi joins on (security, number)."""
    w = Window.partitionBy("security_id").orderBy("session_date")
    multiplier = F.col("multiplier").cast("double") if "multiplier" in prices.columns else F.lit(1.0)
    sourced = F.col("source_id").isNotNull() if "source_id" in prices.columns else F.lit(True)
    p = prices.select("security_id", "session_date", (F.col("close") * multiplier).alias("adjusted"), sourced.alias("sourced"), F.row_number().over(w).alias("i"))
    open_views = views.join(outcomes.select("view_id"), "view_id", "left_anti").select("view_id", "security_id", "decision_date")
    from .scd import asof

    start = asof(open_views, p, ["security_id"], "decision_date", "session_date", ["adjusted", "sourced", "i"])
    end = p.select("security_id", F.col("i").alias("_j"), F.col("adjusted").alias("a1"), F.col("sourced").alias("s1"), F.col("session_date").alias("realized_at"))
    x = start.withColumn("_j", F.col("i") + horizon).join(end, ["security_id", "_j"], "left")
    late = F.col("realized_at").isNull() | (F.col("realized_at") > F.lit(today).cast("date"))
    why = F.when(F.col("i").isNull(), "price_missing").when(~F.col("sourced"), "source_missing").when(late, "horizon_not_reached").when(~F.col("s1"), "source_missing").when(F.col("adjusted").isNull() | F.col("a1").isNull(), "actions_missing")
    x = x.withColumn("reason", why)
    state = F.when(F.col("reason").isNull(), "mature").when(F.col("reason") == "horizon_not_reached", "pending").otherwise("unavailable")
    return x.select("view_id", "security_id", "decision_date", F.when(state == "mature", F.col("realized_at")).alias("realized_at"), F.when(state == "mature", ratio(F.col("a1"), F.col("adjusted")) - 1).alias("realized_return"), state.alias("status"), "reason")


def latest_screen(screens: DataFrame, binding: Sequence[str]) -> DataFrame:
    """All rows that share the binding of the newest snapshot, by rank and security."""
    top = screens.agg(F.max(F.struct("decision_date", "snapshot_id", *[b for b in binding if b not in ("decision_date", "snapshot_id")])).alias("t")).select(*[F.col(f"t.{b}").alias(f"_{b}") for b in binding])
    on = F.lit(True)
    for b in binding:
        on = on & F.col(b).eqNullSafe(F.col(f"_{b}"))
    return screens.join(F.broadcast(top), on, "left_semi").orderBy("rank", "security_id")  # one row


def select_view(views: DataFrame, names: DataFrame, wanted: str) -> DataFrame:
    """The newest view whose id, symbol or name is the wanted one, whatever the case."""
    x = views.join(names, "security_id", "left")
    q = F.lower(F.lit(wanted))
    hit = (F.lower(F.col("view_id").cast("string")) == q) | (F.lower("symbol") == q) | (F.lower("name") == q)
    return x.where(hit).agg(F.max_by(F.struct(*views.columns), F.struct("decision_date", "view_id")).alias("v")).where("v is not null").select("v.*")


def rank_change(screens: DataFrame, keys: Sequence[str] = ("security_id", "universe_id")) -> DataFrame:
    """previous rank - rank, and its direction."""
    prev = F.lag("rank").over(Window.partitionBy(*keys).orderBy("decision_date"))
    x = screens.select(*keys, "decision_date", "rank", prev.alias("previous_rank"))
    c = F.col("previous_rank") - F.col("rank")
    return x.select("*", c.alias("rank_change"), F.when(c.isNull(), "unavailable").when(c > 0, "up").when(c < 0, "down").otherwise("flat").alias("direction"))


def bind_views(screens: DataFrame, frozen: DataFrame) -> DataFrame:
    """Screen rows with the frozen view of the same id and content hash; a newer view never binds."""
    return screens.join(frozen.select("view_id", "content_hash", "expected_return"), ["view_id", "content_hash"], "left")


def industry_peers(screens: DataFrame, limit: int = 5) -> DataFrame:
    """The best ``limit`` others of each screen row's industry in the same snapshot; unknown industries have none.

    Only the first limit + 1 of a group can be anyone's peers, so that the join stays linear."""
    w = Window.partitionBy("snapshot_id", "industry").orderBy("rank", "security_id")
    known = screens.where("industry is not null")
    top = known.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit + 1).select("snapshot_id", "industry", F.col("security_id").alias("peer_id"), F.col("rank").alias("peer_rank"))
    both = known.select("snapshot_id", "industry", "security_id").join(top, ["snapshot_id", "industry"]).where("peer_id <> security_id")
    g = both.groupBy("snapshot_id", "security_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("peer_rank", "peer_id"))), 1, limit).alias("p"))
    return g.select("snapshot_id", "security_id", F.transform("p", lambda x: x["peer_id"]).alias("peers"))


def project(screens: DataFrame, views: DataFrame, components: DataFrame) -> DataFrame:
    """Screen rows for display: signed text, the 80 % interval, its bar, and components by name."""
    parts = components.groupBy("view_id").agg(F.array_sort(F.collect_list(F.struct("component", "contribution"))).alias("c"))
    x = screens.join(views.select("view_id", "expected_return", "p10", "p90"), "view_id", "left").join(parts, "view_id", "left")
    text = F.transform("c", lambda p: F.concat(p["component"], F.lit("="), signed_percent(p["contribution"])))
    return x.select("view_id", "security_id", "rank", signed_percent(F.col("expected_return")).alias("expected_text"), F.concat(signed_percent(F.col("p10")), F.lit(" .. "), signed_percent(F.col("p90"))).alias("interval_text"), (F.col("p90") - F.col("p10")).alias("bar_width"), F.array_join(text, " ").alias("components"))
