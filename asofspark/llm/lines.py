"""Line dedup: a suffix array over line ids by distributed prefix doubling, and its longest-common-prefix intervals.

A run is a number of consecutive lines of one document. Positions are ordered by (doc_id, text hash, line). Of every
position, the longest run that also begins at an earlier position is a later copy; copies of at least ``min_words``
words are deleted, line by line.

* Up: the ranks of runs of 1, 2, 4 ... lines, each from pairs of ranks of half the length, sorted as in a suffix
  array. Runs that come once are finished and drop out, so that the rounds end with the longest repeated run.
* Down: the intervals of suffixes with a common prefix are refined from the longest power of two to single lines. A
  member that goes on into a deeper interval with others leaves the upper one, but for the first of them; so the
  rows never exceed twice the repeated positions. What is left are the intervals of maximal repeated runs.

Counts are combined before shuffling, and joins on a hot run or line are ordinary joins that Spark may split.

Defined results: null text has no lines and stays null; an empty text is one empty line; blank lines are lines of no
words; rows that share doc_id and text count once and get one result, other rows that share a doc_id are documents
of their own; null doc_id comes last; an empty table gives no rows. A document may lose all its lines: its text is
then empty. A very long text is one row in one task when it is split and when it is put together. Lines are compared by
MD5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import KEY, beside, discard, kept_arrays, keyed, keyed_columns, map_batches, stash

MIN_WORDS = 10


def _ranked(named: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys with an order-preserving rank; at rest, as ranges may be drawn anew on a retry."""
    parts = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = named.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return stash(ordered.select(*keys, F.monotonically_increasing_id().alias("r")), "ranks")


def suffix_ranks(lines: DataFrame) -> list[DataFrame]:
    """lines: (d, p, m), a line's content ``m`` at place ``p`` of document ``d``. For k = 0, 1, ...: rows (d, p, r),
    the rank of the run of 2^k lines from there among all repeated runs of that length; runs that come once are absent."""
    named = _ranked(lines.groupBy("m").agg(F.count("*").alias("c")).where("c > 1"), "m")
    ranks = [stash(lines.join(named, "m").select("d", "p", "r"), "rank-0")]
    discard(named)
    while not ranks[-1].isEmpty():
        step = 1 << (len(ranks) - 1)
        later = ranks[-1].select("d", (F.col("p") - step).alias("p"), F.col("r").alias("r2"))
        pairs = stash(ranks[-1].withColumnRenamed("r", "r1").join(later, ["d", "p"]), "pairs")
        named = _ranked(pairs.groupBy("r1", "r2").agg(F.count("*").alias("c")).where("c > 1"), "r1", "r2")
        ranks.append(stash(pairs.join(named, ["r1", "r2"]).select("d", "p", "r"), f"rank-{len(ranks)}"))
        discard(pairs, named)
    discard(ranks.pop())
    return ranks


def prefix_intervals(ranks: list[DataFrame]) -> DataFrame:
    """Rows (c, n, d, p): position (d, p) is in interval ``c`` of suffixes that share their first ``n`` lines. Members
    that share more appear in the deeper interval, and the first of them here too."""
    state, before = None, ()
    for b in reversed(range(len(ranks))):
        here = ranks[b].select("d", F.col("p").alias("q"), "r")
        # from the root, where nothing is shared yet: all that has a repeated run of 2^b lines but is not yet deeper
        root = ranks[b].select(F.lit(0).cast("long").alias("c"), F.lit(0).alias("n"), "d", "p", "r")
        if b + 1 < len(ranks):
            firsts = ranks[b + 1].groupBy("r").agg(F.min(F.struct("d", "p")).alias("at")).select("at.d", "at.p")
            deeper = ranks[b + 1].select("d", "p").join(firsts, ["d", "p"], "left_anti")
            root = root.join(deeper, ["d", "p"], "left_anti").select("c", "n", "d", "p", "r")
        rows = root
        if state is not None:
            rows = state.withColumn("q", F.col("p") + F.col("n")).join(here, ["d", "q"], "left").select("c", "n", "d", "p", "r").unionByName(root)
        rows = stash(rows, "refine")
        if before:
            discard(*before)
        split = rows.where("r is not null").groupBy("c", "r").agg(F.count("*").alias("k"), F.min(F.struct("d", "p")).alias("first")).where("k > 1")
        split = stash(split, "split")
        before = (rows, split)
        joined = rows.join(split, ["c", "r"], "left").select("c", "n", "d", "p", "r", F.col("first").isNotNull().alias("on"), (F.col("first") == F.struct("d", "p")).alias("is_first"))
        deeper = F.struct(F.xxhash64("c", "r", F.lit(b)).alias("c"), (F.col("n") + (1 << b)).alias("n"))
        stay = F.struct("c", "n")
        places = F.when(~F.col("on"), F.array(stay)).when(F.col("is_first"), F.array(deeper, stay)).otherwise(F.array(deeper))
        state = joined.select(F.explode(places).alias("x"), "d", "p").where("x.n > 0").select("x.c", "x.n", "d", "p")
    out = stash(state, "intervals")
    discard(*before)
    return out


def repeated_runs(docs: DataFrame) -> DataFrame:
    """docs: (_id, _h, text). For each document with later copies: ``runs``, an array of (p, n): n lines from p on
    also begin at an earlier position."""
    hashes = F.transform(F.split("text", "\n"), lambda x: F.unhex(F.md5(x)))
    each = stash(docs.where("text is not null").select("_id", "_h", F.posexplode(hashes).alias("p", "m")), "lines")
    # counts are at rest wherever they are joined, so that Spark can split the join at a hot line or interval
    repeated = stash(each.groupBy("m").agg(F.count("*").alias("c")).where("c > 1").select("m"), "repeated")
    some = stash(each.join(repeated, "m").distinct(), "repeated-lines")
    discard(each, repeated)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = some.select("_id", "_h").distinct().repartitionByRange(parts, "_id", "_h").sortWithinPartitions("_id", "_h")
    numbered = stash(numbered.select("_id", "_h", F.monotonically_increasing_id().alias("d")), "numbered")
    lines = some.join(numbered, ["_id", "_h"]).select("d", "p", "m")
    ranks = suffix_ranks(lines)
    if not ranks:
        discard(some)
        return numbered.select("_id", "_h", F.array().cast("array<struct<p:int,n:int>>").alias("runs")).limit(0)
    discard(some)
    members = prefix_intervals(ranks)
    discard(*ranks)
    first = stash(members.groupBy("c").agg(F.min(F.struct("d", "p")).alias("first")), "first")
    copies = members.join(first, "c").where(F.col("first") < F.struct("d", "p")).groupBy("d", "p").agg(F.max("n").alias("n"))
    return copies.join(numbered, "d").groupBy("_id", "_h").agg(F.collect_list(F.struct("p", "n")).alias("runs"))


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs`` (doc_id, text and others), the text without later copies, and n_lines and n_removed."""
    names = dict(zip(("_id", "_h"), KEY, strict=True))
    runs = repeated_runs(keyed(docs.select("doc_id", "text")).select("_id", "_h", "text")).withColumnsRenamed(names)
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    others = [c for c in columns if c != "text"]
    rows = beside(docs, others, doc_id=F.col("doc_id"), text=F.col("text"))
    marked = keyed_columns(rows).join(runs, list(KEY), "left").select("text", "runs", "kept")
    schema = StructType([docs.schema["text"] if c == "text" else docs.schema[c] for c in columns]).add("n_lines", "long").add("n_removed", "long")

    def cut(text: str | None, runs: list[dict] | None) -> tuple[str | None, int, int]:
        if text is None:
            return None, 0, 0
        lines = text.split("\n")
        if not runs:
            return text, len(lines), 0
        total = np.concatenate([[0], np.cumsum([len(x.split()) for x in lines])])
        edge = np.zeros(len(lines) + 1, np.int32)
        for r in runs:
            if total[r["p"] + r["n"]] - total[r["p"]] >= min_words:
                edge[r["p"]] += 1
                edge[r["p"] + r["n"]] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        return "\n".join([x for x, g in zip(lines, gone.tolist(), strict=True) if not g]), len(lines), int(gone.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [cut(t, r) for t, r in zip(b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True)]
            own = dict(zip(others, kept_arrays(b), strict=True)) | {"text": pa.array([x[0] for x in done], pa.string())}
            yield pa.RecordBatch.from_arrays([own[c] for c in columns] + [pa.array([x[k] for x in done], pa.int64()) for k in (1, 2)], [*columns, "n_lines", "n_removed"])

    return map_batches(marked, run, schema)
