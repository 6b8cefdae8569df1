"""Valuation models as projections and grouped medians: one row per security (and ratio)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scd import contains, slab_join
from .status import columns, ratio

#: Ratio, numerator, denominator.
RATIOS = (("earnings_yield", "earnings_per_share", "price"), ("book_yield", "book_per_share", "price"), ("fcf_yield", "free_cash_flow", "market_cap"), ("ev_ebit", "enterprise_value", "ebit"))
BANK_RATIOS = ("earnings_yield", "book_yield")
INVERTED = ("ev_ebit",)


def inputs(prices: DataFrame, shares: DataFrame, ttm: DataFrame, industries: DataFrame) -> DataFrame:
    """Per-share inputs by security: TTM profit and equity over shares, log market cap, and the template by industry code.
    Each frame has one row per security."""
    x = prices.join(shares, "security_id", "left").join(ttm, "security_id", "left").join(industries, "security_id", "left")
    cap = F.col("price") * F.col("shares")
    template = F.when(F.col("industry_code").startswith("J66"), "bank").when(F.col("industry_code").startswith("C"), "manufacturing").otherwise("unsupported")
    return x.select("security_id", "price", ratio(F.col("net_profit"), F.col("shares")).alias("earnings_per_share"), ratio(F.col("equity"), F.col("shares")).alias("book_per_share"), cap.alias("market_cap"), F.when(cap > 0, F.ln(F.when(cap > 0, cap))).alias("log_market_cap"), template.alias("template"))


def ratios(x: DataFrame, keys: Sequence[str] = ("security_id",), template: str = "template") -> DataFrame:
    """Long valuation ratios; a non-positive denominator (or enterprise value) is unavailable, for a bank only the first two
    apply."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("ratio"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")) for n, a, b in RATIOS]))
    r = x.select(*keys, template, each.alias("x")).select(*keys, template, "x.*")
    inapplicable = (F.col(template) == "bank") & ~F.col("ratio").isin(*BANK_RATIOS)
    bad = (F.col("b") <= 0) | (F.col("ratio").isin(*INVERTED) & (F.col("a") <= 0))
    return r.select(*keys, template, "ratio", *columns(ratio(F.col("a"), F.col("b")), ("not_applicable", inapplicable), ("missing_input", F.col("a").isNull() | F.col("b").isNull()), ("non_positive_input", bad)))


def peers(memberships: DataFrame, subjects: DataFrame, min_peers: int = 2) -> DataFrame:
    """Each subject's newest effective industry and how many other securities are in it that day; ``members`` lists
    these, once for each industry and day. subjects: security_id, as_of."""
    day = F.col("as_of")
    m = memberships.withColumnRenamed("security_id", "_s")
    own = subjects.join(m, (F.col("security_id") == F.col("_s")) & contains(day)).withColumn("_n", F.row_number().over(Window.partitionBy("security_id", "as_of").orderBy(F.desc("valid_from"), "taxonomy", "industry_code"))).where("_n = 1").select("security_id", "as_of", "taxonomy", "industry_code")
    group = ["as_of", "taxonomy", "industry_code"]
    every = members(memberships, own.select(*group).distinct())
    g = own.join(every.groupBy(*group).agg(F.count("*").alias("_all")), group, "left").join(every.withColumn("_in", F.lit(1)), [*group, "security_id"], "left")
    n = F.coalesce("_all", F.lit(0)) - F.coalesce("_in", F.lit(0))
    return g.select("security_id", *group, n.alias("n_peers"), F.when(n >= min_peers, "quantified").otherwise("unavailable").alias("status"))


def members(memberships: DataFrame, groups: DataFrame) -> DataFrame:
    """The securities of each group (as_of, taxonomy, industry_code) on its day, each once. A subject's peers are the other
    members of its group; the pairs are left to whoever needs them."""
    p = memberships.select(F.col("taxonomy").alias("_t"), F.col("industry_code").alias("_i"), "security_id", "valid_from", "valid_to")
    hit = groups.join(p, (F.col("taxonomy") == F.col("_t")) & (F.col("industry_code") == F.col("_i")) & contains(F.col("as_of")))
    return hit.select("as_of", "taxonomy", "industry_code", "security_id").distinct()


def relative(r: DataFrame, history: DataFrame, group: str = "industry", min_group: int = 3, keys: Sequence[str] = ("security_id",)) -> DataFrame:
    """Each ratio against the medians of its own history and its group's cross-section: value / median - 1, turned round for
    ratios where less is cheaper. r: keys, group, ratio, value; history: keys, ratio, value."""
    w = r.groupBy(group, "ratio").agg(F.median("value").alias("group_median"), F.count("value").alias("n_group"))
    h = history.groupBy(*keys, "ratio").agg(F.median("value").alias("history_median"))
    x = r.join(w, [group, "ratio"], "left").join(h, [*keys, "ratio"], "left")

    def against(m: str, ok: Column) -> Column:
        v, base = F.col("value"), F.col(m)
        d = F.when(F.col("ratio").isin(*INVERTED), ratio(base, v) - 1).otherwise(ratio(v, base) - 1)
        return F.when(ok & (base > 0) & (v > 0), d)

    x = x.select(*keys, group, "ratio", "value", against("group_median", F.col("n_group") >= min_group).alias("vs_group"), against("history_median", F.lit(True)).alias("vs_history"))
    n = F.col("vs_group").isNotNull().cast("int") + F.col("vs_history").isNotNull().cast("int")
    return x.withColumn("status", F.when(n == 2, "quantified").when(n == 1, "partial").otherwise("unavailable"))


def anchor(x: DataFrame) -> DataFrame:
    """Value interval of a growing perpetuity, for banks of justified price-to-book over all corners of the input intervals.

    Columns: template, price, base_lo/hi (cash flow per share), book_lo/hi, roe_lo/hi, growth_lo/hi, rate_lo/hi."""
    lo = F.try_divide(F.col("base_lo") * (1 + F.col("growth_lo")), F.col("rate_hi") - F.col("growth_lo"))
    hi = F.try_divide(F.col("base_hi") * (1 + F.col("growth_hi")), F.col("rate_lo") - F.col("growth_hi"))
    corners = F.array(*[F.try_divide(F.col(f"book_{b}") * (F.col(f"roe_{e}") - F.col(f"growth_{g}")), F.col(f"rate_{r}") - F.col(f"growth_{g}")) for b in ("lo", "hi") for e in ("lo", "hi") for g in ("lo", "hi") for r in ("lo", "hi")])
    bank = F.col("template") == "bank"
    bad = F.col("rate_lo") <= F.col("growth_hi")
    low, high = F.when(bank, F.array_min(corners)).otherwise(lo), F.when(bank, F.array_max(corners)).otherwise(hi)
    gap = low.isNull() | high.isNull()
    ok = ~bad & ~gap & (F.col("price") > 0)
    return x.select("*", F.when(ok, low).alias("value_lo"), F.when(ok, high).alias("value_hi"), F.when(ok, ratio(low, F.col("price")) - 1).alias("return_lo"), F.when(ok, ratio(high, F.col("price")) - 1).alias("return_hi"), F.when(bad, "rate_not_above_growth").when(gap, "missing_input").when(~(F.col("price") > 0), "non_positive_price").alias("anchor_reason"))


def implied(x: DataFrame) -> DataFrame:
    """Growth that the price implies, (P r - base) / (P + base) with crossed bounds; for banks the return on equity over all
    corners of growth + (P / book) (r - growth)."""
    growth = lambda r, b: F.try_divide(F.col("price") * F.col(f"rate_{r}") - F.col(f"base_{b}"), F.col("price") + F.col(f"base_{b}"))
    corners = F.array(*[F.col(f"growth_{g}") + F.try_divide(F.col("price"), F.col(f"book_{b}")) * (F.col(f"rate_{r}") - F.col(f"growth_{g}")) for b in ("lo", "hi") for g in ("lo", "hi") for r in ("lo", "hi")])
    bank = F.col("template") == "bank"
    ok = F.col("price") > 0
    return x.select("*", F.when(ok, F.when(bank, F.array_min(corners)).otherwise(growth("lo", "hi"))).alias("implied_lo"), F.when(ok, F.when(bank, F.array_max(corners)).otherwise(growth("hi", "lo"))).alias("implied_hi"))


def gap(x: DataFrame, missing_ratios: str | None = None) -> DataFrame:
    """Expectation gap [anchor_lo - implied_hi, anchor_hi - implied_lo]: growth, for banks return on equity."""
    bank = F.col("template") == "bank"
    lo = F.when(bank, F.col("roe_lo")).otherwise(F.col("growth_lo")) - F.col("implied_hi")
    hi = F.when(bank, F.col("roe_hi")).otherwise(F.col("growth_hi")) - F.col("implied_lo")
    state = F.when(lo.isNull() | hi.isNull(), "unavailable")
    if missing_ratios:
        state = state.when(F.col(missing_ratios) > 0, "partial")
    return x.select("*", lo.alias("gap_lo"), hi.alias("gap_hi"), state.otherwise("quantified").alias("gap_status"))


def scenarios(drivers: DataFrame, keys: Sequence[str] = ("security_id",)) -> DataFrame:
    """intercept + coefficient * driver interval by scenario bear, base and bull, and whether midpoints rise in that order.
    drivers: keys, scenario, driver_lo, driver_hi, intercept, coefficient."""
    a, b = F.col("intercept") + F.col("coefficient") * F.col("driver_lo"), F.col("intercept") + F.col("coefficient") * F.col("driver_hi")
    order = F.array_position(F.array(F.lit("bear"), F.lit("base"), F.lit("bull")), F.col("scenario"))
    x = drivers.select(*keys, "scenario", F.least(a, b).alias("value_lo"), F.greatest(a, b).alias("value_hi"), order.alias("_o"))
    mid = (F.col("value_lo") + F.col("value_hi")) / 2
    w = Window.partitionBy(*keys)
    x = x.withColumn("_up", mid >= F.lag(mid).over(w.orderBy("_o")))
    return x.select(*keys, "scenario", "value_lo", "value_hi", (F.coalesce(F.min(F.col("_up").cast("int")).over(w), F.lit(1)) == 1).alias("monotone"), (F.count("*").over(w) == 3).alias("complete"))


def _all_of(steps):
    def holds(x: Column) -> Column:
        out = F.lit(True)
        for step in steps:
            out = out & step(x)
        return out

    return holds


def revision(snapshots: DataFrame, attestations: DataFrame | None = None, use: str = "strict_historical", least_trust: int = 2) -> DataFrame:
    """Analyst revision against the snapshot before of the same security, period and provider: interval and midpoint.
    snapshots: security_id, period, provider_id, observed_on, estimate_lo, estimate_hi, valid_to, and with attestations
    (provider_id, provider_use, qualified_on, valid_until, ceiling) also decision_on: the snapshot must be known by the
    decision, and the provider attested for the use at that day, up to the trust asked for."""
    w = Window.partitionBy("security_id", "period", "provider_id").orderBy("observed_on")
    lo, hi = F.lag("estimate_lo").over(w), F.lag("estimate_hi").over(w)
    expired = F.lag("valid_to").over(w) < F.col("observed_on")
    decided = [] if attestations is None else ["decision_on"]
    x = snapshots.select("security_id", "period", "provider_id", "observed_on", *decided, (F.col("estimate_lo") - hi).alias("revision_lo"), (F.col("estimate_hi") - lo).alias("revision_hi"), ((F.col("estimate_lo") + F.col("estimate_hi") - lo - hi) / 2).alias("m"), lo.isNull().alias("_first"), F.coalesce(expired, F.lit(False)).alias("_old"))
    reasons = [("no_prior_estimate", F.col("_first")), ("prior_expired", F.col("_old"))]
    if attestations is not None:
        a = attestations.groupBy("provider_id").agg(F.collect_list(F.struct("provider_use", "qualified_on", "valid_until", "ceiling")).alias("_a"))
        x = x.join(a, "provider_id", "left").withColumn("_a", F.coalesce("_a", F.array().cast(a.schema["_a"].dataType)))
        day = F.col("decision_on")
        steps = (
            ("source_not_attested", lambda s: F.lit(True)),
            ("attested_for_other_use", lambda s: s["provider_use"] == use),
            ("qualified_after_decision", lambda s: s["qualified_on"] <= day),
            ("attestation_expired", lambda s: s["valid_until"].isNull() | (s["valid_until"] >= day)),
            ("trust_ceiling", lambda s: s["ceiling"] >= least_trust),
        )
        reasons.append(("snapshot_after_decision", F.col("observed_on") > day))
        for n, (reason, _) in enumerate(steps):  # no attestation passes this step and all before it
            reasons.append((reason, ~F.exists("_a", _all_of([step for _, step in steps[: n + 1]]))))
    bad = F.lit(False)
    for _, c in reasons[1:]:
        bad = bad | F.coalesce(c, F.lit(True))
    x = x.withColumn("_bad", bad)
    return x.select("security_id", "period", "provider_id", "observed_on", F.when(~F.col("_bad"), F.col("revision_lo")).alias("revision_lo"), F.when(~F.col("_bad"), F.col("revision_hi")).alias("revision_hi"), *columns(F.col("m"), *reasons))


#: The components of an analysis, and the models of its suite.
COMPONENTS, SUITE = ("valuation", "improvement", "scenario"), ("relative", "anchor", "implied", "revision")


def analyze(parts: DataFrame, keys: Sequence[str] = ("security_id",), components: Sequence[str] = COMPONENTS, suite: Sequence[str] = SUITE) -> DataFrame:
    """Combined status over component rows (keys, component, status): all, none or part of them quantified. The models of
    the suite have a status of their own in the same way (NULL without any), which doesn't enter the combined one."""
    own, model = F.col("component").isin(*components), F.col("component").isin(*suite)
    done = lambda of: F.count_distinct(F.when(of & (F.col("status") == "quantified"), F.col("component")))
    some = lambda of: F.count_if(of & (F.col("status") == "partial"))
    open_ = lambda of: F.array_sort(F.collect_set(F.when(of & (F.col("status") != "quantified"), F.col("component"))))
    g = parts.where(own | model).groupBy(*keys).agg(done(own).alias("n"), some(own).alias("p"), open_(own).alias("open_components"), F.count_if(model).alias("models"), done(model).alias("mn"), some(model).alias("mp"), open_(model).alias("open_models"))
    status = lambda n, p, of: F.when(F.col(n) == len(of), "quantified").when((F.col(n) == 0) & (F.col(p) == 0), "unavailable").otherwise("partial")
    return g.select(*keys, F.col("n").alias("n_quantified"), "open_components", status("n", "p", components).alias("status"), "open_models", F.when(F.col("models") > 0, status("mn", "mp", suite)).alias("suite_status"))


def qualify_inputs(evidence: DataFrame, required: Sequence[str], keys: Sequence[str] = ("security_id",)) -> DataFrame:
    """Per key: distinct datasets, sources, records and content hashes, newest availability, mixed trust, missing required
    metrics and duplicate (metric, period), as sorted blockers. evidence: keys, metric, period, dataset_id, source_id,
    record_id, content_hash, trust_state, available_at. A record of two hashes is a blocker too."""
    each = evidence.groupBy(*keys, "metric", "period").agg(F.count("*").alias("c"))
    dup = each.groupBy(*keys).agg(F.count_if(F.col("c") > 1).alias("dup"))
    record = evidence.groupBy(*keys, "record_id").agg(F.count_distinct("content_hash").alias("h")).groupBy(*keys).agg(F.count("record_id").alias("n_records"), F.count_if(F.col("h") > 1).alias("torn"))
    g = evidence.groupBy(*keys).agg(*[F.count_distinct(c).alias(n) for c, n in (("dataset_id", "n_datasets"), ("source_id", "n_sources"), ("content_hash", "n_hashes"), ("trust_state", "n_trust"))], F.max("available_at").alias("latest_available"), F.array_sort(F.array_except(F.array(*[F.lit(m) for m in required]), F.collect_set("metric"))).alias("missing"))
    g = g.join(dup, list(keys)).join(record, list(keys))
    blockers = F.array_compact(F.array(F.when(F.col("dup") > 0, F.lit("duplicate_metric_period")), F.when(F.size("missing") > 0, F.concat(F.lit("missing:"), F.array_join("missing", "+"))), F.when(F.col("n_trust") > 1, F.lit("mixed_trust")), F.when(F.col("torn") > 0, F.lit("record_of_two_contents"))))
    return g.select(*keys, "n_datasets", "n_sources", "n_records", "n_hashes", "latest_available", blockers.alias("blockers"), (F.size(blockers) == 0).alias("qualified"))


def price_candidates(listings: DataFrame, partitions: DataFrame, jobs: DataFrame, capital: DataFrame) -> DataFrame:
    """Catalog of price partitions that can serve a listing on a day: partition of its exchange whose dates cover the day,
    of a succeeded job, with capital in effect. listings: listing_id, exchange, as_of. Both range joins go by time slabs:
    the exchange alone, of which there are a few, is no join key."""
    done = partitions.join(jobs.where("status = 'succeeded'").select("job_id").distinct(), "job_id", "left_semi").select("exchange", "dataset_version_id", "first_date", "last_date", "job_id")
    x = slab_join(listings, done, ["exchange"], "as_of", "first_date", "last_date", how="inner", inclusive=True)
    c = capital.groupBy("listing_id", "effective_from", "effective_to").agg(F.min("total_shares").alias("total_shares"))
    return slab_join(x, c, ["listing_id"], "as_of", "effective_from", "effective_to").select("listing_id", "as_of", "dataset_version_id", "job_id", "total_shares")
