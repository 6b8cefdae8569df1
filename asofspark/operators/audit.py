"""Coverage, lineage, readiness and health audits over jobs, checkpoints, reports and evidence."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofspark.sources.store import rested

from .status import ratio


def cohort(units: DataFrame) -> DataFrame:
    """One row per job: completed units, receipt and persisted counts, zero units, rejected rows, distinct symbols, coverage
    and quality classes, and whether all hold. units: job_id, symbol, status, receipt_rows, persisted_rows, rejected_rows, quality."""
    done = F.col("status") == "succeeded"
    g = units.groupBy("job_id").agg(
        F.count("*").alias("n_units"),
        F.count_if(done).alias("n_completed"),
        F.sum(F.when(done, F.col("receipt_rows")).otherwise(0)).alias("receipt_rows"),
        F.sum(F.when(done, F.col("persisted_rows")).otherwise(0)).alias("persisted_rows"),
        F.count_if(done & (F.col("receipt_rows") == 0)).alias("zero_units"),
        F.sum("rejected_rows").alias("rejected_rows"),
        F.count_distinct("symbol").alias("n_symbols"),
        F.count_if(F.col("quality") == "passed").alias("quality_passed"),
        F.count_if(F.col("quality") == "warned").alias("quality_warned"),
        F.count_if(F.col("quality") == "failed").alias("quality_failed"),
    )
    ok = (F.col("n_units") == F.col("n_completed")) & (F.col("receipt_rows") == F.col("persisted_rows")) & (F.col("quality_failed") == 0)
    return g.withColumn("passed", ok)


def job_coverage(units: DataFrame, expected_symbols: DataFrame, statements: int, periods: int, bucket: int) -> DataFrame:
    """Completed units of each job against statements x periods x ceil(symbols / bucket), with missing and extra symbols.
    units: job_id, unit_key, symbol, status; expected_symbols: job_id, symbol."""
    seen = units.where("status = 'succeeded'")
    got = seen.groupBy("job_id").agg(F.count_distinct("unit_key").alias("n_completed"))
    e = expected_symbols.select("job_id", "symbol").distinct().withColumn("e", F.lit(1))
    o = seen.select("job_id", "symbol").distinct().withColumn("o", F.lit(1))
    x = e.join(o, ["job_id", "symbol"], "full").groupBy("job_id").agg(F.count("e").alias("n_symbols"), F.count_if(F.col("o").isNull()).alias("n_missing"), F.count_if(F.col("e").isNull()).alias("n_extra"))
    want = F.lit(statements * periods) * F.ceil(F.col("n_symbols") / bucket)
    return x.join(got, "job_id", "left").select("job_id", "n_symbols", "n_missing", "n_extra", F.coalesce("n_completed", F.lit(0)).alias("n_completed"), want.alias("n_expected"), ((F.col("n_missing") == 0) & (F.col("n_extra") == 0) & (F.coalesce("n_completed", F.lit(0)) == want)).alias("complete"))


def issue_totals(reports: DataFrame, by: Sequence[str], issues: str = "issue_counts") -> DataFrame:
    """Totals of JSON issue maps, those above zero."""
    x = reports.select(*by, F.explode(F.from_json(issues, "map<string,int>")).alias("issue", "n"))
    return x.groupBy(*by, "issue").agg(F.sum("n").alias("total")).where("total > 0")


def role_evidence(targets: DataFrame, evidence: DataFrame, by: str = "role") -> DataFrame:
    """Evidence of each role for the target entities: rows, entities, first and last date, datasets, sources and coverage.
    The target set is aggregated once for all roles."""
    n = targets.select("entity_id").distinct()
    total = n.agg(F.count("*").alias("n_targets"))
    g = evidence.join(n, "entity_id", "left_semi").groupBy(by).agg(F.count("*").alias("n_rows"), F.count_distinct("entity_id").alias("n_entities"), F.min("at").alias("first_date"), F.max("at").alias("last_date"), F.count_distinct("dataset_id").alias("n_datasets"), F.count_distinct("source_id").alias("n_sources"))
    return g.crossJoin(F.broadcast(total)).withColumn("coverage", ratio(F.col("n_entities"), F.col("n_targets")))


def action_coverage(targets: DataFrame, actions: DataFrame, work: DataFrame) -> DataFrame:
    """Covered: the entity has events, or its work succeeded with none."""
    a = actions.groupBy("entity_id").agg(F.count("*").alias("n_events"))
    w = work.groupBy("entity_id").agg(F.max((F.col("status") == "succeeded").cast("int")).alias("ok"))
    x = targets.select("entity_id").distinct().join(a, "entity_id", "left").join(w, "entity_id", "left")
    return x.select("entity_id", F.coalesce("n_events", F.lit(0)).alias("n_events"), (F.col("n_events").isNotNull() | (F.coalesce("ok", F.lit(0)) == 1)).alias("covered"))


def counts_for(requested: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """A count for every requested id, zero included."""
    n = facts.groupBy(key).agg(F.count("*").alias("n"))
    return requested.select(key).distinct().join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n_rows"))


def readiness(requirements: DataFrame, bindings: DataFrame) -> DataFrame:
    """Sorted blockers and warnings of each study over its roles. requirements: study_id, role, min_trust, min_coverage,
    window_from, window_to; bindings: study_id, role, trust, quality_failed, coverage, first_date, last_date, lineage_ok.
    Where both have ``availability_policy`` they must agree, ``availability_enforced`` must hold, and ``quality_warned`` is a
    warning."""
    policy = "availability_policy"
    b = bindings.withColumnRenamed(policy, "_policy")
    x = requirements.join(b, ["study_id", "role"], "left")
    say = lambda c, what: F.when(c, F.concat(F.lit(what + ":"), F.col("role")))
    gone = F.col("coverage").isNull()
    rules = [say(gone, "missing"), say(F.col("trust") < F.col("min_trust"), "trust"), say(F.col("quality_failed"), "quality"), say(F.col("coverage") < F.col("min_coverage"), "coverage"), say((F.col("first_date") > F.col("window_from")) | (F.col("last_date") < F.col("window_to")), "window"), say(~F.col("lineage_ok"), "lineage")]
    if policy in requirements.columns and "_policy" in b.columns:
        rules.append(say(~gone & ~F.col("_policy").eqNullSafe(F.col(policy)), policy))
    if "availability_enforced" in b.columns:
        rules.append(say(~F.col("availability_enforced"), "availability_enforcement"))
    warned = say(F.col("quality_warned") & ~F.col("quality_failed"), "quality_warned") if "quality_warned" in b.columns else F.lit(None).cast("string")
    g = x.groupBy("study_id").agg(F.array_sort(F.flatten(F.collect_list(F.array_compact(F.array(*rules))))).alias("blockers"), F.array_sort(F.collect_list(warned)).alias("warnings"))
    return g.withColumn("permitted", F.size("blockers") == 0)


#: The checks of a factor's validation report, and those that can't be waived.
VALIDATION_CHECKS = (
    "pit_input_qualification", "ic", "rank_ic", "hac_or_block_bootstrap", "quantile_monotonicity", "decay_turnover_coverage", "industry_size_neutrality",
    "fama_macbeth", "regime_subperiod_stability", "fdr", "walk_forward_oos", "cost_capacity",
)
NON_WAIVABLE_CHECKS = ("pit_input_qualification", "walk_forward_oos")


def promotion_gate(checks: DataFrame, contexts: DataFrame | None = None, required: Sequence[str] = VALIDATION_CHECKS, non_waivable: Sequence[str] = NON_WAIVABLE_CHECKS, by: str = "report_id") -> DataFrame:
    """All required checks present and named once, none failed, the non-waivable ones passed, and evidence from history: a
    run in strict data mode at the research stage on point-in-time data. checks: report, check_name, outcome; contexts:
    report, data_mode, stage, trust_state (without any, the context does not count)."""
    if contexts is not None:
        historical = (F.col("data_mode") == "strict_historical") & (F.col("stage") == "research") & (F.col("trust_state") == "pit_verified")
        c = contexts.groupBy(by).agg(F.min(F.coalesce(historical, F.lit(False))).alias("historical"))
        gate = promotion_gate(checks, None, required, non_waivable, by).join(c, by, "left").withColumn("historical", F.coalesce("historical", F.lit(False)))
        return gate.withColumn("may_promote", F.col("may_promote") & F.col("historical"))
    # flags and counts of fixed width, which tasks add up before the shuffle; only other names than the required ones go as text
    name, passed = F.col("check_name"), F.col("outcome") == "pass"
    seen, firm = ({c: f"_{what}{k}" for k, c in enumerate(sorted(set(names)))} for what, names in (("seen", required), ("firm", non_waivable)))
    flags = [F.bool_or(name == c).alias(f) for c, f in seen.items()] + [F.bool_or((name == c) & passed).alias(f) for c, f in firm.items()]
    others = F.count_distinct(F.when(~name.isin(*seen), name) if seen else name)
    g = checks.groupBy(by).agg(*flags, F.count_if(F.col("outcome") == "fail").alias("n_failed"), F.count("check_name").alias("_named"), others.alias("_others"))
    yes = lambda f: F.coalesce(F.col(f), F.lit(False))
    n = lambda fs: sum((yes(f).cast("int") for f in fs), F.lit(0))
    missing = F.array_compact(F.array(*[F.when(~yes(f), F.lit(c)) for c, f in seen.items()])) if seen else F.array().cast("array<string>")
    g = g.select(by, missing.alias("missing"), "n_failed", (F.col("_named") - n(seen.values()) - F.col("_others")).alias("n_repeated"), n(firm.values()).alias("n_firm"))
    return g.select(by, "missing", "n_failed", "n_repeated", ((F.size("missing") == 0) & (F.col("n_failed") == 0) & (F.col("n_repeated") == 0) & (F.col("n_firm") == len(non_waivable))).alias("may_promote"))


def health(datasets: DataFrame, reports: DataFrame, by: str = "domain") -> DataFrame:
    """Datasets of each domain: total, with a quality report, failed reports, newest, and ready, partial or empty."""
    r = reports.groupBy("dataset_id").agg(F.lit(1).alias("reported"), F.max((F.col("outcome") == "failed").cast("int")).alias("failed"))
    g = datasets.join(r, "dataset_id", "left").groupBy(by).agg(F.count("dataset_id").alias("n_datasets"), F.count("reported").alias("n_reported"), F.coalesce(F.sum("failed"), F.lit(0)).alias("n_failed"), F.max("created_at").alias("latest"))
    state = F.when(F.col("n_datasets") == 0, "empty").when((F.col("n_reported") == F.col("n_datasets")) & (F.col("n_failed") == 0), "ready").otherwise("partial")
    return g.withColumn("state", state)


def desk_sections(datasets: DataFrame, reports: DataFrame, jobs: DataFrame, reviews: DataFrame, forecasts: DataFrame) -> DataFrame:
    """One row per section of a desk: its status (empty, ready or partial), how many rows it has, how many need attention,
    and its newest time. datasets: dataset_id, created_at; reports: dataset_id, checks_failed; jobs: job_id, status,
    failure_reasons (array), updated_at; reviews: review_id, decided_at; forecasts: forecast_id, effective_session,
    passive_exposure. Jobs fail by status or by a reason; reviews and the passive timing baseline are never complete."""
    r = reports.groupBy("dataset_id").agg(F.count_if(F.col("checks_failed") > 0).alias("failed"))
    d = datasets.join(r, "dataset_id", "left").agg(F.count("*").alias("n"), F.count_if(F.col("failed").isNull()).alias("bare"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"), F.max("created_at").cast("timestamp").alias("newest"))
    health = d.select(F.lit("data_health").alias("section"), F.when(F.col("n") == 0, "empty").when((F.col("bare") == 0) & (F.col("failed") == 0), "ready").otherwise("partial").alias("status"), F.col("n").alias("n_rows"), (F.col("bare") + F.col("failed")).alias("n_flagged"), "newest")

    def listed(section: str, rows: DataFrame, newest: str, flagged: Column) -> DataFrame:
        g = rows.agg(F.count("*").alias("n_rows"), F.count_if(flagged).alias("n_flagged"), F.max(newest).cast("timestamp").alias("newest"))
        return g.select(F.lit(section).alias("section"), F.when(F.col("n_rows") == 0, "empty").otherwise("partial").alias("status"), "n_rows", "n_flagged", "newest")

    failing = jobs.where((F.col("status") == "failed") | (F.coalesce(F.size("failure_reasons"), F.lit(0)) > 0))
    sections = [health, listed("active_failures", failing, "updated_at", F.lit(True)), listed("pending_tasks", reviews, "decided_at", F.lit(False)), listed("timing_shadow", forecasts, "effective_session", F.col("passive_exposure").isNull())]
    out = sections[0]
    for x in sections[1:]:
        out = out.unionByName(x)
    return out


def batch_reports(batches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Coverage min(1, observed / expected) per batch, NULL without an expectation, and its class."""
    g = batches.groupBy(*by).agg(F.sum("rows_observed").alias("observed"), F.sum("rows_expected").alias("expected"), F.count_if(F.col("status") == "failed").alias("n_failed"))
    share = ratio(F.col("observed"), F.col("expected"))
    c = F.when(share.isNotNull(), F.least(F.lit(1.0), share))
    return g.withColumn("coverage", c).withColumn("coverage_class", F.when(F.col("coverage").isNull(), "unknown").when(F.col("coverage") >= 1, "full").when(F.col("coverage") > 0, "partial").otherwise("zero"))


def status_counts(rows: DataFrame, by: Sequence[str], status: str = "status") -> DataFrame:
    return rows.groupBy(*by, status).agg(F.count("*").alias("n_rows"))


def qualify_plan(plan: DataFrame, policies: DataFrame) -> DataFrame:
    """Plan lines (plan_id, domain, field, market, trust) against provider policies (domain, field, market, allowed, ceiling):
    sorted blockers and whether the plan may run."""
    x = plan.join(policies, ["domain", "field", "market"], "left")
    say = lambda c, what: F.when(c, F.concat_ws(":", F.lit(what), "domain", "field", "market"))
    found = F.array_compact(F.array(say(F.col("allowed").isNull(), "missing_capability"), say(~F.col("allowed"), "use_not_allowed"), say(F.col("ceiling") < F.col("trust"), "trust_ceiling")))
    g = x.groupBy("plan_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(found)))).alias("blockers"))
    return g.withColumn("permitted", F.size("blockers") == 0)


def qualify_financial_plan(plans: DataFrame, profiles: DataFrame, scopes: DataFrame, statements: DataFrame) -> DataFrame:
    """Blockers of each plan of statements against the profile of its provider. plans: plan_id, provider_id, profile_version,
    bucket_size, bulk_acknowledged; profiles: provider_id, version, row_limit, bulk_allowed; scopes: provider_id, market,
    statement; statements: plan_id, market, statement. A plan without a profile has no provider."""
    p = plans.join(profiles.withColumnRenamed("version", "_version"), "provider_id", "left")
    none = F.col("_version").isNull()
    rules = [(none, "provider_unknown"), (F.col("_version") != F.col("profile_version"), "profile_version"), (~F.coalesce("bulk_acknowledged", F.lit(False)), "bulk_not_acknowledged"), (F.col("bucket_size") > F.col("row_limit"), "bucket_exceeds_row_limit"), (~F.col("bulk_allowed"), "bulk_not_allowed")]
    own = p.select("plan_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))).alias("blocker"))
    asked = statements.distinct().join(plans.select("plan_id", "provider_id"), "plan_id").join(scopes.distinct(), ["provider_id", "market", "statement"], "left_anti")
    gaps = asked.select("plan_id", F.concat_ws(":", F.lit("not_covered"), "market", "statement").alias("blocker"))
    g = own.unionByName(gaps).groupBy("plan_id").agg(F.array_sort(F.collect_set("blocker")).alias("blockers"))
    return plans.select("plan_id").join(g, "plan_id", "left").select("plan_id", F.coalesce("blockers", F.array().cast("array<string>")).alias("blockers"), F.col("blockers").isNull().alias("permitted"))


def dashboard(jobs: DataFrame, checkpoints: DataFrame, reports: DataFrame) -> DataFrame:
    """Jobs with their checkpoints and reports as rows (job_id, kind, item, state, n): a row for each job, checkpoint and
    report, and counts by state. A job of any number of checkpoints stays spread over rows."""
    row = lambda df, kind, item, state, n: df.select("job_id", F.lit(kind).alias("kind"), item.cast("string").alias("item"), state.cast("string").alias("state"), n.cast("long").alias("n"))
    none = F.lit(None)
    c = checkpoints.groupBy("job_id", F.col("status").alias("state")).agg(F.count("*").alias("n"))
    r = reports.groupBy("job_id", F.col("outcome").alias("state")).agg(F.count("*").alias("n"))
    parts = [row(checkpoints, "checkpoint", F.col("checkpoint_key"), F.col("status"), none), row(reports, "report", F.col("report_id"), F.col("outcome"), none)]
    parts += [row(c, "checkpoints", none, F.col("state"), F.col("n")), row(r, "reports", none, F.col("state"), F.col("n"))]
    out = row(jobs, "job", none, none, none)
    for p in parts:
        out = out.unionByName(p)
    return out


def timeline(df: DataFrame, order: Sequence[Column | str], limit: int | None = None) -> DataFrame:
    """The rows in order of stable keys, or the first ``limit`` of them."""
    ordered = df.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def reconcile_symbols(expected: DataFrame, observed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Symbols that only one side has."""
    e = expected.select(*by, "symbol").distinct().withColumn("e", F.lit(True))
    o = observed.select(*by, "symbol").distinct().withColumn("o", F.lit(True))
    return e.join(o, [*by, "symbol"], "full").where("e is null or o is null").select(*by, "symbol", F.when(F.col("o").isNull(), "missing").otherwise("extra").alias("kind"))


def shared_components(rows: DataFrame, component: str, owner: str) -> DataFrame:
    """Components that more than one owner has."""
    return rows.groupBy(component).agg(F.count_distinct(owner).alias("n_owners")).where("n_owners > 1")


def id_union(*frames: DataFrame) -> DataFrame:
    """Distinct union of (kind, id) frames."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def lineage_closure(used: DataFrame, approved: DataFrame, by: str) -> DataFrame:
    """Datasets each artifact uses without approval. Uses and approvals meet by artifact and dataset; only what is left
    without approval is gathered by artifact."""
    row = lambda df, is_used: df.select(by, "dataset_id", F.lit(is_used).alias("_used"))
    x = row(used, True).unionByName(row(approved.where(F.col(by).isNotNull()), False)).groupBy(by, "dataset_id").agg(F.bool_or("_used").alias("_used"), F.bool_and("_used").alias("_bare"))
    g = x.where("_used").groupBy(by).agg(F.array_sort(F.collect_list(F.when(F.col("_bare"), F.col("dataset_id")))).alias("unapproved"))
    return g.withColumn("closed", F.size("unapproved") == 0)


def evidence_closure(used: DataFrame, approved: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """Datasets without approval among those that each artifact uses and all that they were derived from."""
    rests = upstream_closure(edges, used.select(F.col("dataset_id").alias("id")))
    below = used.select(by, F.col("dataset_id").alias("id")).distinct().join(rests, "id").select(by, F.col("ancestor_id").alias("dataset_id"))
    return lineage_closure(used.select(by, "dataset_id").unionByName(below), approved, by)


def upstream(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """One hop: the edges that lead to the given ids."""
    return edges.join(ids.select(F.col("id").alias("downstream_id")).distinct(), "downstream_id", "left_semi")


#: Edges that are small enough to go several at a round, and not to be made fewer any more.
FEW_EDGES = 100_000


def upstream_closure(edges: DataFrame, ids: DataFrame, hops: int = 4) -> DataFrame:
    """All ancestors of the given ids: (id, ancestor_id, depth), depth being the least number of edges, and ``cyclic``: the
    id is its own ancestor. edges: upstream_id, downstream_id.

    Each round goes one edge on from what the round before was first to reach (``hops`` edges where few are left), and leaves
    out what is known, so that it ends on cycles too; the number of rounds follows the longest way. After a round, edges that
    no other edge leads to can't be met any more and go, as long as that leaves out a quarter of them, so that later rounds
    read fewer and fewer. Rounds and edges rest in the shared scratch folder."""
    e = rested(edges.select(F.col("downstream_id").alias("_at"), F.col("upstream_id").alias("_up")).where("_at is not null and _up is not null"), "edges")
    front = ids.select("id", F.col("id").alias("ancestor_id")).where("id is not null").distinct()
    n_edges, n_front, n_reached, depth, fewer, reached = e.count(), 0, 0, 0, True, None
    if n_edges <= FEW_EDGES:
        e = rested(e.distinct(), "edges")
    while True:
        # in a round of several edges, all but its last depth have been gone on from
        front = front.select("id", "ancestor_id") if reached is None else front.where(F.col("depth") == depth).select("id", "ancestor_id")
        step, steps = front, []
        for k in range(1 if n_edges > FEW_EDGES else hops):
            step = step.join(e, F.col("ancestor_id") == F.col("_at")).select("id", F.col("_up").alias("ancestor_id"))
            steps.append(step.withColumn("depth", F.lit(depth + k + 1)))
        new = reduce(DataFrame.unionByName, steps).groupBy("id", "ancestor_id").agg(F.min("depth").alias("depth"))
        if reached is not None:
            known = reached.select("id", "ancestor_id")
            if 4 * n_front < n_reached:  # most ids have come to their end
                known = known.join(front.select("id").distinct(), "id", "left_semi")
            new = new.join(known, ["id", "ancestor_id"], "left_anti")
        new = rested(new, "lineage")
        n_new, depth = new.count(), depth + len(steps)
        reached = new if reached is None else reached.unionByName(new)
        if not n_new:
            return reached.withColumn("cyclic", F.col("id") == F.col("ancestor_id"))
        front, n_front, n_reached = new, n_new, n_reached + n_new
        if fewer and n_edges > FEW_EDGES:
            left = e.join(e.select(F.col("_up").alias("_at")).distinct(), "_at", "left_semi")
            e = rested(left.distinct() if depth == 1 else left, "edges")
            n_before, n_edges = n_edges, e.count()
            fewer = 4 * n_edges <= 3 * n_before
