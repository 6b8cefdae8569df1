"""Security master: snapshots as of a date, code resolution and the master build."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scd import asof, contains, slab_join


def identifier_at(points: DataFrame, history: DataFrame, kind: str, out: str) -> DataFrame:
    """points (listing_id, as_of) with the identifier of ``kind``: the visible one (of several the newest), else the newest
    that began before. The visible ones are a range join, the others one sorted stream a listing."""
    p, h = points.select("listing_id", "as_of").distinct(), history.where(F.col("kind") == kind).select("listing_id", "identifier", "valid_from", "valid_to")
    seen = slab_join(p, h, ["listing_id"], "as_of").groupBy("listing_id", "as_of").agg(F.max(F.struct("valid_from", "identifier")).alias("_s"))
    before = asof(seen, h, ["listing_id"], "as_of", "valid_from", ["identifier"], tie=[F.desc("identifier")], strict=True)
    return before.select("listing_id", "as_of", F.coalesce("_s.identifier", "identifier").alias(out))


def snapshot(companies: DataFrame, securities: DataFrame, listings: DataFrame, history: DataFrame, industries: DataFrame, dates: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Listed securities on each date: company, code, name, industries, and the listing state and special treatment in
    effect (states: listing_id, valid_from, valid_to, listing_state, special_treatment; NULL without any). delisted_on is
    inclusive; of overlapping states the newest counts.

    dates (as_of) may be all sessions: a listing is looked up once in each stretch of days in which nothing about it changes,
    and the stretches are spread over their days at the end. All dates are one row there."""
    every = F.broadcast(dates.agg(F.sort_array(F.collect_set("as_of")).alias("_days")))
    inside = lambda d: (d >= F.col("_from")) & (F.col("_until").isNull() | (d < F.col("_until")))
    changes = stretches(listings, history, industries, states)
    alive = changes.crossJoin(every).where(F.exists("_days", inside)).select("listing_id", F.col("_from").alias("as_of"), "_until").join(listings, "listing_id").where("listed_on <= as_of and (delisted_on is null or as_of <= delisted_on)")
    base = alive.join(securities, "security_id").join(companies, "company_id")
    code, name = identifier_at(alive, history, "code", "code"), identifier_at(alive, history, "name", "name")
    hit = slab_join(alive.select("security_id", "as_of").distinct(), industries, ["security_id"], "as_of", how="inner").groupBy("security_id", "as_of").agg(F.array_sort(F.collect_set("industry_code")).alias("industries"))
    out = base.join(code, ["listing_id", "as_of"], "left").join(name, ["listing_id", "as_of"], "left").join(hit, ["security_id", "as_of"], "left")
    state = ["listing_state", "special_treatment"]
    if states is None:
        out = out.withColumns({c: F.lit(None).cast("string") for c in state})
    else:
        now = slab_join(alive.select("listing_id", "as_of"), states, ["listing_id"], "as_of", how="inner").groupBy("listing_id", "as_of").agg(F.max(F.struct("valid_from", *state)).alias("s"))
        out = out.join(now.select("listing_id", "as_of", *[F.col(f"s.{c}").alias(c) for c in state]), ["listing_id", "as_of"], "left")
    out = out.select(F.col("as_of").alias("_from"), "_until", "listing_id", "security_id", "company_id", "company_name", "exchange", "code", "name", F.coalesce("industries", F.array().cast("array<string>")).alias("industries"), *state)
    # few and short rows grow by hundreds: they are dealt to all tasks by number, which adaptive execution leaves as it is
    dealt = out.repartition(int(dates.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("listing_id", "_from"))
    return dealt.crossJoin(every).select(F.explode(F.filter("_days", inside)).alias("as_of"), *out.columns[2:])


def stretches(listings: DataFrame, history: DataFrame, industries: DataFrame, states: DataFrame | None) -> DataFrame:
    """The days from which something about a listing may differ (listing_id, _from) and the next such day (_until, NULL for
    none). An identifier also changes on the day after its first, when it has begun before."""
    after = lambda c: F.date_add(c, 1)
    marks = listings.select("listing_id", F.array("listed_on", after("delisted_on")).alias("_at"))
    marks = marks.unionByName(history.where("kind in ('code', 'name')").select("listing_id", F.array("valid_from", after("valid_from"), "valid_to").alias("_at")))
    own = industries.select("security_id", F.array("valid_from", "valid_to").alias("_at")).join(listings.select("security_id", "listing_id"), "security_id")
    marks = marks.unionByName(own.select("listing_id", "_at"))
    if states is not None:
        marks = marks.unionByName(states.select("listing_id", F.array("valid_from", "valid_to").alias("_at")))
    days = marks.select("listing_id", F.explode("_at").alias("_from")).where("listing_id is not null and _from is not null").distinct()
    return days.withColumn("_until", F.lead("_from").over(Window.partitionBy("listing_id").orderBy("_from")))


def resolve_listing(requests: DataFrame, listings: DataFrame, history: DataFrame) -> DataFrame:
    """requests (exchange, code, as_of): the one listing that has the code that day, or why there is none."""
    h = history.where("kind = 'code'").join(listings.select("listing_id", F.col("exchange").alias("_e")), "listing_id").select("listing_id", F.col("_e").alias("exchange"), F.col("identifier").alias("code"), "valid_from", "valid_to")
    return resolved(requests, h.where("exchange is not null and code is not null"), ["exchange", "code"])


def resolved(requests: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """requests (keys, as_of) with the one listing whose span (listing_id, a whole number; valid_from, valid_to) holds the day.

    Spans become steps: how many listings hold a key from a day on, and the exclusive or of their ids, which is the id where
    it is one. A request meets the last step before it, so that a key of any number of listings is one sorted stream."""
    own = Window.partitionBy(*keys, "listing_id").orderBy("valid_from", F.asc_nulls_last("valid_to"))
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    never = F.lit("9999-12-31").cast("date")
    s = spans.where("valid_from is not null and (valid_to is null or valid_from < valid_to)").select(*keys, "listing_id", "valid_from", "valid_to").distinct()
    # overlapping spans of one listing count once
    s = s.withColumn("_new", F.coalesce(F.max(F.coalesce("valid_to", never)).over(before) < F.col("valid_from"), F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.groupBy(*keys, "listing_id", "_run").agg(F.min("valid_from").alias("on"), F.max(F.coalesce("valid_to", never)).alias("off"), F.count_if(F.col("valid_to").isNull()).alias("open"))
    step = lambda c, by: F.struct(F.col(c).alias("at"), F.lit(by).alias("by"))
    moves = s.select(*keys, "listing_id", F.inline(F.array_compact(F.array(step("on", 1), F.when(F.col("open") == 0, step("off", -1))))))
    steps = moves.groupBy(*keys, "at").agg(F.sum("by").alias("by"), F.bit_xor(F.col("listing_id").cast("long")).alias("ids"))
    so_far = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select(*keys, "at", F.sum("by").over(so_far).alias("n"), F.bit_xor("ids").over(so_far).alias("l"))
    g = asof(requests.select(*keys, "as_of").distinct(), steps, keys, "as_of", "at", ["n", "l"]).withColumn("n", F.coalesce("n", F.lit(0)))
    kind = spans.schema["listing_id"].dataType
    return g.select(*keys, "as_of", F.when(F.col("n") == 1, F.col("l").cast(kind)).alias("listing_id"), F.when(F.col("n") == 1, "resolved").when(F.col("n") == 0, "not_found").otherwise("ambiguous").alias("status"))


def resolve(requests: DataFrame, corrections: DataFrame, aliases: DataFrame, history: DataFrame, current: DataFrame, allow_current: bool = True) -> DataFrame:
    """requests (provider, code, as_of) by precedence: provider correction, official alias, identifier history, then the
    currently known listing with a warning. A correction or alias that exists but isn't effective that day is an error.

    Each source is counted by request first, so the four joins add no rows."""
    key, day = ["provider", "code", "as_of"], F.col("as_of")
    asked = requests.select(*key).distinct()

    def look(table: DataFrame, name: str, by_provider: bool) -> DataFrame:
        t = table.select(*([F.col("provider").alias("_p")] if by_provider else []), F.col("code").alias("_c"), "listing_id", "valid_from", "valid_to")
        on = (F.col("code") == F.col("_c")) & (F.col("provider") == F.col("_p") if by_provider else F.lit(True))
        live = F.when(contains(day), F.col("listing_id"))
        return asked.join(t, on).groupBy(*key).agg(F.count_distinct(live).alias(f"n_{name}"), F.min(live).alias(name), F.lit(True).alias(f"has_{name}"))

    tables = [look(corrections, "correction", True), look(aliases, "alias", False), look(history, "history", False)]
    now = current.groupBy("code").agg(F.count_distinct("listing_id").alias("n_current"), F.min("listing_id").alias("current"))
    x = asked
    for t in tables:
        x = x.join(t, key, "left")
    x = x.join(now, "code", "left")
    has = lambda n: F.coalesce(F.col(f"has_{n}"), F.lit(False))
    count = lambda n: F.coalesce(F.col(f"n_{n}"), F.lit(0))
    named = lambda n: F.when(count(n) == 1, F.lit(n)).when(count(n) > 1, F.lit("ambiguous"))
    how = (
        F.when(has("correction"), F.coalesce(named("correction"), F.lit("correction_not_effective")))
        .when(has("alias"), F.coalesce(named("alias"), F.lit("alias_not_effective")))
        .when(count("history") > 0, named("history"))
        .when(F.lit(allow_current) & (count("current") > 0), named("current"))
        .otherwise("not_found")
    )
    x = x.withColumn("how", how)
    picked = F.when(F.col("how") == "correction", F.col("correction")).when(F.col("how") == "alias", F.col("alias")).when(F.col("how") == "history", F.col("history")).when(F.col("how") == "current", F.col("current"))
    return x.select(*key, picked.alias("listing_id"), "how", F.when(F.col("how") == "current", "resolved_by_current_listing").alias("warning"))


def build_master(basic: DataFrame, industry: DataFrame, min_coverage: float) -> DataFrame:
    """Basic rows with their industry. A classification with only one of code and name is nulled and flagged; rows without
    a legal name are rejected and flagged; ``coverage_ok`` says whether enough accepted rows are classified."""
    x = basic.join(industry, "code", "left")
    half = F.col("industry_code").isNull() != F.col("industry_name").isNull()
    x = x.select(*basic.columns, F.when(~half, F.col("industry_code")).alias("industry_code"), F.when(~half, F.col("industry_name")).alias("industry_name"), half.alias("partial_classification"), F.col("legal_name").isNull().alias("rejected"))
    share = x.where("not rejected").agg(F.avg(F.col("industry_code").isNotNull().cast("double")).alias("classified_share"))
    return x.crossJoin(F.broadcast(share)).withColumn("coverage_ok", F.coalesce(F.col("classified_share") >= min_coverage, F.lit(False))).drop("classified_share")


