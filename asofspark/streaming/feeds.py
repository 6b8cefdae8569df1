"""Streaming forms of ingestion: append with conflict routing, late revisions, and outcome maturity."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from asofspark.sources import merge
from asofspark.sources.store import BUCKETS, Store

#: Microseconds of a day, and a price time that no price has.
DAY, NEVER = 86_400_000_000, 1 << 62
#: Microseconds of a slab of state.
SLAB = 32 * DAY
#: Groups of securities that hold the state.
GROUPS = 1024
#: What the stream writes of views.
TOLD = "view string, price double, priced long, close double, security string"


def append_stream(source: DataFrame, root: str, checkpoint: str, key: str = "id", content: str = "content_hash", buckets: int = BUCKETS) -> StreamingQuery:
    """Observations into a ledger that is cut by a hash of the id: a micro-batch reads and rewrites only the buckets of its
    ids, of its contents, and of ids that it brings into conflict.

    An id of two contents, or a content of two ids, is a conflict whichever came first and in however many batches; a pair
    that stood in the ledger leaves it then. Repeats are dropped however late they come. ``appended`` reads the result. A
    micro-batch that runs again after a failure finds its mark and changes nothing.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        own = batch.persist()
        merge.pairs(Store(batch.sparkSession, root, buckets), "pairs", own, key, content, mark=(checkpoint, batch_id))
        own.unpersist()

    return source.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended(spark: SparkSession, root: str, key: str = "id", content: str = "content_hash") -> DataFrame:
    """All pairs seen so far with ``kind``: ledger or conflict."""
    return merge.pairs_by_kind(Store(spark, root), "pairs", key, content)


def revision_stream(source: DataFrame, root: str, checkpoint: str, keys: list[str], buckets: int = BUCKETS) -> StreamingQuery:
    """Revisions close the system intervals of the facts before them, in whatever order they arrive: a late known_from cuts
    the interval that it falls into in two. A micro-batch reads and rewrites only the buckets of its keys, and ends as one
    commit; run again, it changes nothing."""

    def store(batch: DataFrame, batch_id: int) -> None:
        own = batch.persist()
        merge.revisions(Store(batch.sparkSession, root, buckets), "facts", own, keys, mark=(checkpoint, batch_id))
        own.unpersist()

    return source.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_intervals(spark: SparkSession, root: str) -> DataFrame:
    """All facts with their intervals so far."""
    return Store(spark, root).read("facts").drop("given_to")


class Maturing(StatefulProcessor):
    """The views and prices of the securities of one key. State: prices by slab of their times, and by slab of their targets
    the views that may still get an earlier price. A micro-batch reads a key's slabs at once and writes those that change, as
    every call of the state costs a round trip.

    A view is told to wait when it comes, and its first price so far is told whenever that changes, so that the least price
    time told of a view is right at any moment. Timers clean up as the watermark passes: a view goes when its slab's prices
    have passed, after which no earlier one can come, and a slab of prices when every later view must look behind it.
    """

    def __init__(self, horizon_days: int):
        self.horizon = horizon_days * DAY

    def init(self, handle) -> None:
        self.handle = handle
        self.prices = handle.getMapState("prices", "slab int", "security array<string>, at array<long>, close array<double>")
        self.views = handle.getMapState("views", "slab int", "security array<string>, view array<string>, target array<long>, price array<double>, priced array<long>")

    def _timer(self, us: int) -> None:
        """At the first millisecond after ``us``."""
        self.handle.registerTimer(us // 1000 + 1)

    @staticmethod
    def _slabs(state) -> dict[int, list[list]]:
        """Slab -> the columns of its rows, as lists."""
        return {slab: [list(c) for c in columns] for (slab,), columns in list(state.iterator())}

    def handleInputRows(self, key, rows, timerValues):
        """The rows of one security, its key."""
        for told in self._mature((df.assign(security=key[0]) for df in rows)):
            yield told.drop(columns="security")

    def _mature(self, rows):
        fresh, came = {}, {}
        for df in rows:
            for security, view, at, price, close in zip(*(df[c].tolist() for c in ("security", "view", "us", "price", "close")), strict=True):
                at = int(at)
                if close == close and close is not None:  # a price; of equal times the least counts
                    fresh[security, at] = min(float(close), fresh.get((security, at), float(close)))
                else:
                    came.setdefault((security, view), (at + self.horizon, float(price)))
        prices = {slab: dict(zip(zip(*columns[:2], strict=True), columns[2], strict=True)) for slab, columns in self._slabs(self.prices).items()}
        for (security, at), close in fresh.items():
            own = prices.setdefault(at // SLAB, {})
            own[security, at] = min(close, own.get((security, at), close))
        for slab in {at // SLAB for _, at in fresh}:
            self.prices.updateValue((slab,), (*map(list, zip(*prices[slab], strict=True)), list(prices[slab].values())))
            self._timer(max(at for _, at in prices[slab]) - self.horizon)
        told, changed, views, news = [], set(), self._slabs(self.views), _times(fresh)
        for slab, columns in views.items():
            priced = columns[4]
            for n, (security, view, target, price, known) in enumerate(zip(*columns, strict=True)):
                at = _first(news, security, target)
                if at <= known and at != NEVER:
                    priced[n] = at
                    changed.add(slab)
                    told.append((view, price, at, prices[at // SLAB][security, at], security))
        known = {(security, view) for columns in views.values() for security, view in zip(*columns[:2], strict=True)}
        came = {k: v for k, v in came.items() if k not in known}
        every = _times(k for own in prices.values() for k in own) if came else {}
        for (security, view), (target, price) in came.items():
            at, slab = _first(every, security, target), target // SLAB
            for column, value in zip(views.setdefault(slab, [[], [], [], [], []]), (security, view, target, price, at), strict=True):
                column.append(value)
            changed.add(slab)
            told.append((view, price, None, None, security))
            if at != NEVER:
                told.append((view, price, at, prices[at // SLAB][security, at], security))
        for slab in changed:
            self.views.updateValue((slab,), tuple(views[slab]))
            passed = [t for t in views[slab][4] if t != NEVER]
            if passed:
                self._timer(max(passed))
        if told:
            view, price, priced, close, security = zip(*told, strict=True)
            yield pd.DataFrame({"view": view, "price": price, "priced": pd.array(priced, dtype="Int64"), "close": pd.Series(close, dtype="float64"), "security": security})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        for slab, columns in self._slabs(self.views).items():
            rest = [row for row in zip(*columns, strict=True) if row[4] >= now]
            if not rest:
                self.views.removeKey((slab,))
            elif len(rest) < len(columns[0]):
                self.views.updateValue((slab,), tuple(map(list, zip(*rest, strict=True))))
        for slab, (_, times, _) in self._slabs(self.prices).items():
            if max(times) < now + self.horizon:
                self.prices.removeKey((slab,))
        yield from ()

    def close(self) -> None:
        pass


class MaturingGroup(Maturing):
    """``Maturing`` for rows with their security, of any number of them; it tells the security with each row."""

    def handleInputRows(self, key, rows, timerValues):
        yield from self._mature(rows)


def _times(keys) -> dict[str, list[int]]:
    """Sorted times by security, of (security, time)."""
    found: dict[str, list[int]] = {}
    for security, at in keys:
        found.setdefault(security, []).append(at)
    for own in found.values():
        own.sort()
    return found


def _first(times: dict[str, list[int]], security: str, target: int) -> int:
    """The security's first time at or after the target, or NEVER."""
    own = times.get(security, ())
    k = bisect.bisect_left(own, target)
    return own[k] if k < len(own) else NEVER


def maturity_stream(views: DataFrame, prices: DataFrame, root: str, checkpoint: str, horizon_days: int, lateness: str = "365 days", groups: int = GROUPS) -> StreamingQuery:
    """Views wait for the first price at or after their horizon as both arrive, in whatever order. views: view_id (unique),
    security_id, decision_at, price; prices: p_security_id, priced_at, close.

    The state is kept by ``groups`` of securities (by their hash), with event-time timers (``Maturing``): a micro-batch costs
    what the groups of its securities hold. Choose the number so that a group has up to some thousand rows at a time. Rows that are later than ``lateness`` behind the newest are left out, as Spark does with
    late rows. ``maturity`` reads the result.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias("us")
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias("security")
    v = views.select(key("security_id"), F.col("decision_at").cast("timestamp").alias("at"), us("decision_at"), F.col("view_id").cast("string").alias("view"), F.col("price").cast("double").alias("price"), F.lit(None).cast("double").alias("close"))
    p = prices.where("close is not null and p_security_id is not null").select(key("p_security_id"), F.col("priced_at").cast("timestamp").alias("at"), us("priced_at"), F.lit(None).cast("string").alias("view"), F.lit(None).cast("double").alias("price"), F.col("close").cast("double").alias("close"))
    both = v.unionByName(p).withWatermark("at", lateness)
    told = both.withColumn("group", F.pmod(F.xxhash64("security"), F.lit(groups)).cast("int")).groupBy("group").transformWithStateInPandas(MaturingGroup(horizon_days), TOLD, "Append", "EventTime")
    spark, provider = views.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return told.writeStream.format("parquet").option("path", f"{root}/told").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)


def maturity(spark: SparkSession, root: str) -> DataFrame:
    """One row a view with its security: matured with its price's time and return, or pending."""
    told = spark.read.schema(TOLD).parquet(f"{root}/told")
    first = told.groupBy("view").agg(F.max("price").alias("price"), F.max("security").alias("security"), F.min(F.when(F.col("priced").isNotNull(), F.struct("priced", "close"))).alias("first"))
    at = F.timestamp_micros(F.col("first.priced"))
    return first.select(F.col("view").alias("view_id"), F.when(F.col("security") != "", F.substr("security", F.lit(2))).alias("security_id"), at.alias("priced_at"), (F.col("first.close") / F.col("price") - 1).alias("realized_return"), F.when(F.col("first").isNull(), "pending").otherwise("mature").alias("status"))
