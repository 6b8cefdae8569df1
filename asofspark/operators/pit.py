"""Bitemporal facts: two clocks, trust, revisions, provider authority and conflicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDENTITY = ("company_id", "period_end")
#: What a fact says: facts may come without unit and currency.
MEANING = ("value", "unit", "currency")
TRUST = {"raw": 0, "normalized_current": 1, "pit_verified": 2}


def trust_level(column: str = "trust_state") -> Column:
    out = F.lit(None).cast("int")
    for name, level in TRUST.items():
        out = F.when(F.col(column) == name, F.lit(level)).otherwise(out)
    return out


def is_eligible(decision: Column, system: Column, mode: str) -> Column:
    """Public by the decision, known to the warehouse at the system time (half-open), and trusted enough."""
    least = {"strict_historical": 2, "current": 1}[mode]
    return (F.col("available_at") <= decision) & (F.col("known_from") <= system) & (F.col("known_to").isNull() | (system < F.col("known_to"))) & (trust_level() >= least)


def eligible(facts: DataFrame, decision: Column, system: Column, mode: str = "strict_historical") -> DataFrame:
    return facts.where(is_eligible(decision, system, mode))


def evidence_gate(df: DataFrame, mode: str, decision: str = "decision_time", available: str = "available_at", outcome: str | None = None) -> DataFrame:
    """Adds ``blocked_by``: the reasons that bar a row from statistics, empty if it may pass."""
    rules = [("raw_evidence", trust_level() < 1), ("unknown_trust", trust_level().isNull()), ("available_after_decision", F.col(available) > F.col(decision))]
    if mode == "strict_historical":
        rules.append(("not_pit_verified", trust_level() < 2))
    if outcome:
        rules.append(("outcome_not_after_decision", F.col(outcome) <= F.col(decision)))
    return df.withColumn("blocked_by", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules])))


def meaning(df: DataFrame) -> Column:
    """What two providers must agree on: (value, unit, currency), as far as the facts have them."""
    return F.struct(*[c for c in MEANING if c in df.columns])


def select_revision(facts: DataFrame, identity: Sequence[str] = IDENTITY) -> DataFrame:
    """The highest revision of each (identity, provider) among eligible rows; a tie is a conflict without a value."""
    keys = [*identity, "provider_id"]
    top = facts.withColumn("_top", F.max("revision").over(Window.partitionBy(*keys))).where(F.col("revision") == F.col("_top"))
    g = top.groupBy(*keys).agg(F.max("revision").alias("revision"), F.count("*").alias("n_winners"), F.min_by(meaning(facts), "fact_id").alias("v"), F.min("fact_id").alias("fact_id"), F.max((F.col("quality_state") == "blocked").cast("int")).alias("blocked"))
    tie = F.col("n_winners") > 1
    return g.select(*keys, "revision", "n_winners", tie.alias("conflict"), *[F.when(~tie, F.col(f"v.{c}")).alias(c) for c in MEANING if c in facts.columns], F.when(~tie, F.col("fact_id")).alias("fact_id"), (F.col("blocked") == 1).alias("quality_blocked"))


def select_fact(facts: DataFrame, authority: Sequence[str], decision: Column, system: Column, mode: str = "strict_historical", identity: Sequence[str] = IDENTITY) -> DataFrame:
    """One row per identity: the unblocked winner of the first provider in authority order, the providers that disagree on
    value, unit or currency, and whether downstream use is blocked."""
    seen = facts.select(*identity).distinct()
    winners = select_revision(eligible(facts, decision, system, mode), identity)
    rank = F.array_position(F.array(*[F.lit(p) for p in authority]), F.col("provider_id"))
    usable = ~F.col("quality_blocked") & ~F.col("conflict")
    w = winners.withColumn("_rank", F.when(usable & (rank > 0), rank))
    g = w.groupBy(*identity).agg(
        F.min_by(F.struct("provider_id", "value", "fact_id", meaning(facts).alias("meaning")), "_rank").alias("s"),
        F.count("*").alias("n_providers"),
        F.max((F.col("quality_blocked") | F.col("conflict")).cast("int")).alias("held"),
        F.collect_list(F.struct("provider_id", meaning(facts).alias("meaning"), usable.alias("usable"))).alias("all"),
    )
    others = F.when(F.col("s").isNull(), F.filter("all", lambda x: x["usable"])).otherwise(F.filter("all", lambda x: x["usable"] & (x["provider_id"] != F.col("s.provider_id")) & ~x["meaning"].eqNullSafe(F.col("s.meaning"))))
    out = seen.join(g, list(identity), "left").withColumn("conflicts", F.coalesce(F.array_sort(F.transform(others, lambda x: x["provider_id"])), F.array().cast("array<string>")))
    return out.select(
        *identity,
        F.col("s.provider_id").alias("provider_id"),
        F.col("s.value").alias("value"),
        F.col("s.fact_id").alias("fact_id"),
        F.coalesce("n_providers", F.lit(0)).alias("n_providers"),
        "conflicts",
        (F.col("s").isNull() | (F.size("conflicts") > 0) | (F.coalesce("held", F.lit(0)) == 1)).alias("blocks_downstream"),
        F.when(F.col("s").isNotNull() & (F.size("conflicts") == 0), "selected").when(F.col("all").isNotNull(), "blocked").otherwise("unavailable").alias("status"),
    )


def compare_modes(facts: DataFrame, authority: Sequence[str], decision: Column, system: Column, identity: Sequence[str] = IDENTITY) -> DataFrame:
    """The current and the strict selection side by side."""
    pick = lambda mode, name: select_fact(facts, authority, decision, system, mode, identity).select(*identity, F.col("value").alias(f"{name}_value"), F.col("status").alias(f"{name}_status"))
    both = pick("current", "current").join(pick("strict_historical", "strict"), list(identity), "full")
    return both.withColumn("same", F.col("current_value").eqNullSafe(F.col("strict_value")))


def close_intervals(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A newer known_from closes the open row of the same keys; public timestamps must not change."""
    w = Window.partitionBy(*keys).orderBy("known_from", "fact_id")
    closed = F.coalesce("known_to", F.lead("known_from").over(w))
    moved = F.lag("available_at").over(w) != F.col("available_at")
    return facts.withColumns({"known_to": closed, "public_time_changed": F.coalesce(moved, F.lit(False))})


def mismatches(facts: DataFrame, identity: Sequence[str] = IDENTITY) -> DataFrame:
    """Open facts of an identity on which at least two providers give different (value, unit, currency)."""
    g = facts.where("known_to is null").groupBy(*identity).agg(
        F.count_distinct("provider_id").alias("n_providers"),
        F.count_distinct(meaning(facts)).alias("n_values"),
        F.array_sort(F.collect_set("provider_id")).alias("provider_ids"),
        F.array_sort(F.collect_set("fact_id")).alias("fact_ids"),
    )
    return g.where("n_providers >= 2 and n_values >= 2")


def mismatch_entries(facts: DataFrame, unmapped: DataFrame, identity: Sequence[str] = IDENTITY) -> DataFrame:
    """All that blocks financial evidence as one list: providers that disagree, open facts of blocked quality, and pending
    fields without a mapping (unmapped: field_id, provider_id, source_field, status)."""
    who, none = F.array("provider_id"), [F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in identity]
    clash = mismatches(facts, identity).select(F.lit("provider_value_conflict").alias("mismatch_type"), *identity, "provider_ids", F.transform("fact_ids", lambda x: x.cast("string")).alias("related_ids"), F.lit("providers disagree on value, unit or currency").alias("reason"))
    held = facts.where("known_to is null and quality_state = 'blocked'").select(F.lit("quality_block").alias("mismatch_type"), *identity, who.alias("provider_ids"), F.array(F.col("fact_id").cast("string")).alias("related_ids"), F.concat(F.lit("quality state is "), "quality_state").alias("reason"))
    loose = unmapped.where("status = 'pending'").select(F.lit("unmapped_field").alias("mismatch_type"), *none, who.alias("provider_ids"), F.array(F.col("field_id").cast("string")).alias("related_ids"), F.concat(F.lit("unmapped provider field: "), "source_field").alias("reason"))
    return clash.unionByName(held).unionByName(loose)
