"""Merges of new rows into keyed tables of a store: each reads and rewrites only the hash buckets of its rows, and what
several merges leave is what one call over all rows gives, in whatever order they come.

``mark`` is a stream's name and batch number: a batch that runs again changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from asofspark.operators import pit, scd

from .ingest import ledger_labels
from .store import Commit, Store

Mark = tuple[str, int] | None


# -- slowly changing tables ----------------------------------------------------------------------------------------


def scd2(store: Store, name: str, observations: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], mark: Mark = None) -> bool:
    """Observations into intervals. The table keeps one row a key and date, so that a late observation cuts the interval
    that it falls into."""
    new = observations.select(*keys, at, *values).withColumn("conflict", F.lit(False))

    def make(commit: Commit):
        touched = store.touched(new, keys)
        old = store.read(name, new.schema, touched, commit).select(*new.columns)
        return {name: (scd.scd2_starts(scd.scd2_days(old.unionByName(new), keys, at, values), keys, at, values), keys, touched)}

    return store.update(make, mark)


def scd2_intervals(store: Store, name: str, keys: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """The intervals, as ``operators.scd.scd2`` gives them."""
    return store.read(name).where("starts").select(*keys, *values, F.col(at).alias("valid_from"), "valid_to", "conflict")


def latest(store: Store, name: str, rows: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], mark: Mark = None) -> bool:
    """The newest row of each key stays, ties by value."""
    new = rows.select(*keys, at, *values)

    def make(commit: Commit):
        touched = store.touched(new, keys)
        old = store.read(name, new.schema, touched, commit).select(*new.columns)
        return {name: (scd.latest_wins(old.unionByName(new), keys, at, values), keys, touched)}

    return store.update(make, mark)


def coalesced(store: Store, name: str, rows: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], mark: Mark = None) -> bool:
    """For each value column the newest non-null one stays, with its own time (``<column>_<at>``)."""
    timed = [(v, f"{v}_{at}") for v in values]
    new = rows.select(*keys, at, *values, *[F.when(F.col(v).isNotNull(), F.col(at)).alias(t) for v, t in timed])

    def make(commit: Commit):
        touched = store.touched(new, keys)
        every = store.read(name, new.schema, touched, commit).select(*new.columns).unionByName(new)
        newest = [F.max(F.when(F.col(v).isNotNull(), F.struct(F.col(t).alias("t"), F.col(v).alias("v")))).alias(v) for v, t in timed]
        g = every.groupBy(*keys).agg(F.max(at).alias(at), *newest)
        return {name: (g.select(*keys, at, *[F.col(f"{v}.v").alias(v) for v in values], *[F.col(f"{v}.t").alias(t) for v, t in timed]), keys, touched)}

    return store.update(make, mark)


# -- ledgers -------------------------------------------------------------------------------------------------------


def ledger(store: Store, name: str, rows: DataFrame, key: str = "id", content: str = "content_hash", mark: Mark = None) -> DataFrame | None:
    """Append to a ledger of which each id has one content and each content one id; the label of every new (id, content), as
    of the ledger before. Two tables hold the ledger, by id and by content, and change together; a call reads only the
    buckets of its ids and of its contents. New pairs and labels are made once and rest in the store, until ``Store.vacuum()``."""
    rests: dict[str, DataFrame] = {}

    def make(commit: Commit):
        if "new" not in rests:
            rests["new"] = store.rested(rows.dropDuplicates([key, content]), f"{name}_new")
        new = rests["new"]
        some = new.where(F.col(key).isNotNull() & F.col(content).isNotNull())
        by_id, by_content = store.touched(some, [key]), store.touched(some, [content])
        have = store.read(f"{name}_ids", new.schema, by_id, commit)
        bound = store.read(f"{name}_contents", new.select(content, key).schema, by_content, commit)
        rests["labels"] = store.rested(ledger_labels(have, new.select(key, content), key, content, bound), f"{name}_labels")
        fresh = rests["labels"].where("action = 'insert'").select(key, content)
        if len(new.columns) > 2:
            fresh = new.join(fresh, [key, content], "left_semi")
        return {f"{name}_ids": (have.unionByName(fresh), [key], by_id), f"{name}_contents": (bound.unionByName(fresh.select(content, key)), [content], by_content)}

    return rests["labels"] if store.update(make, mark) else None


def pairs(store: Store, name: str, rows: DataFrame, key: str = "id", content: str = "content_hash", mark: Mark = None) -> bool:
    """Every (id, content) ever seen, once, with ``conflict``: the id has other contents, or the content other ids. That
    depends on the set of pairs alone, so a pair that stood well may come into conflict by a later batch; the ids that a new
    pair's content was bound to are touched with the batch's own. Other columns keep their least values. Rows without id or
    content are in conflict, in a table of their own (``<name>_broken``)."""
    others = [c for c in rows.columns if c not in (key, content)]
    rest = F.min(F.struct(F.lit(0).alias("_"), *others)).alias("_rest")
    opened = [F.col(f"_rest.{c}").alias(c) for c in others]
    ids, contents, broken = f"{name}_ids", f"{name}_contents", f"{name}_broken"

    def make(commit: Commit):
        whole = F.col(key).isNotNull() & F.col(content).isNotNull()
        sound = rows.where(whole).withColumns({"shared": F.lit(False), "conflict": F.lit(False)})
        by_id, by_content = store.touched(sound, [key]), store.touched(sound, [content])
        bound = store.read(contents, sound.select(content, key).schema, by_content, commit)
        every = bound.withColumn("old", F.lit(1)).unionByName(sound.select(content, key).distinct().withColumn("old", F.lit(0)))
        g = every.groupBy(content).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.min(F.when(F.col("old") == 1, F.col(key))).alias("lo_old"), F.max(F.when(F.col("old") == 1, F.col(key))).alias("hi_old"))
        shared = g.where("lo <> hi")
        alone = shared.where("lo_old = hi_old").select(F.col("lo_old").alias(key))  # bound to one id until now
        touched = sorted({*by_id, *store.touched(alone, [key])})
        have = store.read(ids, sound.schema, touched, commit).select(*sound.columns)
        met = have.unionByName(sound).groupBy(key, content).agg(rest, F.max("shared").alias("shared")).join(shared.select(content, F.lit(True).alias("now")), content, "left")
        met = met.select(key, content, *opened, (F.col("shared") | F.coalesce("now", F.lit(False))).alias("shared"))
        own = F.count("*").over(Window.partitionBy(key))
        out = {ids: (met.withColumn("conflict", F.col("shared") | (own > 1)).select(*sound.columns), [key], touched), contents: (every.select(content, key).distinct(), [content], by_content)}
        bad = rows.where(~whole)
        by_both = store.touched(bad, [key, content])
        if by_both or broken not in commit.schemas:
            old = store.read(broken, bad.schema, by_both, commit).select(*bad.columns)
            out[broken] = (old.unionByName(bad).groupBy(key, content).agg(rest).select(key, content, *opened), [key, content], by_both)
        return out

    return store.update(make, mark)


def pairs_by_kind(store: Store, name: str, key: str = "id", content: str = "content_hash") -> DataFrame:
    """All pairs with ``kind``: ledger or conflict."""
    sound = store.read(f"{name}_ids").withColumn("kind", F.when(F.col("conflict"), "conflict").otherwise("ledger")).drop("shared", "conflict")
    return sound.unionByName(store.read(f"{name}_broken").withColumn("kind", F.lit("conflict")))


# -- bitemporal facts ----------------------------------------------------------------------------------------------


def revisions(store: Store, name: str, facts: DataFrame, keys: Sequence[str], mark: Mark = None) -> bool:
    """Facts into system intervals: a newer known_from of the same keys closes the open one, and a late one cuts the closed
    interval that it falls into. The known_to that a fact came with is kept beside (``given_to``)."""

    def make(commit: Commit):
        touched = store.touched(facts, keys)
        new = facts.withColumn("given_to", F.col("known_to"))
        old = store.read(name, StructType([*new.schema]), touched, commit).select(*new.columns).withColumn("known_to", F.col("given_to"))
        return {name: (pit.close_intervals(distinct_by(old.unionByName(new), keys, store.buckets), keys), keys, touched)}

    return store.update(make, mark)


def distinct_by(rows: DataFrame, keys: Sequence[str], parts: int) -> DataFrame:
    """Distinct rows, dealt by the keys to a fixed number of tasks: repeats meet after the shuffle, so that no task holds its whole part of a batch as
    candidates, and what is windowed by the keys next needs no shuffle of its own."""
    return rows.repartition(parts, *keys).distinct()
