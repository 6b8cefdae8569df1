"""Substring dedup: exact removal of word windows that an earlier document has, by super-k-mer partitioning.

1. Every window of 50 words has a minimiser, the least hash among its runs of 8 words. Consecutive windows with the
   same minimiser form a super-k-mer. Equal windows have equal minimisers, so a minimiser that only one document
   has holds no repeated window: such super-k-mers stay where they are.
2. The others travel as one packed string each to their minimiser's bucket, equal strings as one. There the windows
   are sorted, and each learns the smallest doc_id it starts in.
3. Minimisers with more than ``bucket_rows`` different strings would make large buckets. Their strings are split again
   into super-k-mers by minimisers of longer runs, which go as packed strings to buckets of their own, and so on for
   those that are still hot, up to runs as long as a window: there all strings of a bucket are one and the same.
4. Each document drops the words of its windows that a smaller doc_id has.

Defined results: null text has no words; a document below 50 words keeps everything; null doc_id comes after all
ids, and rows with null doc_id don't remove from each other; neither do windows within one document or in rows that
share a doc_id; very long texts are one row in one task, never cut; a text that repeats one word or a short period is
packed in strings of at most MOST_WINDOWS windows; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, discard, keyed, map_batches, stash

WINDOW = 50
#: Words of the runs whose least hash is a window's minimiser: at first, and again for minimisers that are hot.
RUNS = (8, 26, 38, 45, 48, 50)
BUCKET_ROWS = 256
#: Windows of a packed string at most; runs of so many windows with one minimiser come from periodic texts only.
MOST_WINDOWS = 64
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def minimisers(words: list[bytes], window: int = WINDOW, run: int = RUNS[0]) -> np.ndarray:
    """The minimiser of each window of consecutive words: the least hash among its runs of ``run`` words."""
    x = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    k = 1
    while k < run:
        step = min(k, run - k)  # two hashes of k words, the second ``step`` words on, make one of k + step
        x = (x[:-step] * np.uint64(0xBF58476D1CE4E5B9)) + x[step:]
        x ^= x >> np.uint64(31)
        k += step
    x *= np.uint64(0x94D049BB133111EB)
    span, k = window - run + 1, 1
    while 2 * k <= span:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (span - k)], x[span - k :]) if span > k else x


def super_kmers(words: list[bytes], window: int = WINDOW, run: int = RUNS[0]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each run of at most MOST_WINDOWS windows with one minimiser."""
    if len(words) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    m = minimisers(words, window, run)
    first = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1])
    n = np.diff(np.concatenate([first, [len(m)]]))
    if (n > MOST_WINDOWS).any():
        parts = -(-n // MOST_WINDOWS)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first = np.repeat(first, parts) + nth * MOST_WINDOWS
    return first, np.diff(np.concatenate([first, [len(m)]])), m[first].view(np.int64)


def first_in_bucket(rows: list[tuple], window: int) -> Iterator[tuple]:
    """rows: (sid, packed, least id, greatest id) of one minimiser. Yields (sid, off, n, first) lists of window runs
    with the smallest id that each starts in, for strings where that can remove something."""
    windows = []
    for k, (_, packed, least, _) in enumerate(rows):
        words = packed.split(b" ")
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        starts = [0, *ends]
        windows += [(packed[starts[i] : ends[i + window - 1] - 1], least, k, i) for i in range(len(words) - window + 1)]
    windows.sort()
    found: list[list] = [[] for _ in rows]
    for _, same in groupby(windows, key=lambda w: w[0]):
        first = None
        for _, least, k, i in same:
            first = least if first is None else first
            found[k].append((i, first))
    for (sid, _, least, most), got in zip(rows, found, strict=True):
        if any(first < most for _, first in got):
            yield (sid, *window_runs(sorted(got)))


def window_runs(got: list[tuple[int, int]]) -> tuple[list[int], list[int], list[int]]:
    off, n, firsts = [], [], []
    for i, first in got:
        if off and firsts[-1] == first and off[-1] + n[-1] == i:
            n[-1] += 1
        else:
            off.append(i)
            n.append(1)
            firsts.append(first)
    return off, n, firsts


FOUND = "sid binary, off array<int>, n array<int>, first array<long>"
_FOUND = [pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]


def _found(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_FOUND)], ["sid", "off", "n", "first"])


def repeated_windows(docs: DataFrame, window: int = WINDOW, runs: tuple[int, ...] = RUNS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """For every document key (_id, _h) with windows that also start in a smaller id: ``spans``, an array of
    (start, off[], n[], first[]), where windows start+off .. start+off+n-1 first occur in document ``first``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [super_kmers(t.split(), window, min(runs[0], window)) for t in binaries(b.column("text"))]
            n = np.repeat(np.arange(len(out)), [len(x[0]) for x in out])
            cols = [np.concatenate([x[k] for x in out]) if out else np.empty(0, np.int64) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column("_id").take(n), b.column("_h").take(n), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2])], ["_id", "_h", "start", "n", "minimiser"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, h, text, spans in zip(b.column("_id").to_pylist(), b.column("_h").to_pylist(), binaries(b.column("text")), b.column("found").to_pylist(), strict=True):
                words = text.split()
                for s in spans:
                    packed = b" ".join(words[s["start"] : s["start"] + s["n"] + window - 1])
                    rows.append((i, h, s["start"], s["minimiser"], hashlib.blake2b(packed, digest_size=16).digest(), packed))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["_id", "_h", "start", "minimiser", "sid", "packed"])

    at = map_batches(docs.select("_id", "_h", "text"), find, "_id long, _h long, start int, n int, minimiser long")
    at = stash(at, "super-kmer-places")
    shared = stash(at.groupBy("minimiser").agg(F.min("_id").alias("a"), F.max("_id").alias("z")).where("a < z").select("minimiser"), "shared-minimisers")  # at rest, so that the join can be split where a minimiser is hot
    marks = at.join(shared, "minimiser").groupBy("_id", "_h").agg(F.collect_set(F.struct("start", "n", "minimiser")).alias("found"))
    places = map_batches(docs.select("_id", "_h", "text").join(marks, ["_id", "_h"]), cut, "_id long, _h long, start int, minimiser long, sid binary, packed binary")
    places = stash(places, "super-kmers")
    discard(at, shared)

    strings = places.select("minimiser", "sid", "packed", F.col("_id").alias("least"), F.col("_id").alias("most"))
    hot = _hot(places, bucket_rows)
    found = _in_buckets(_apart(strings, hot, "left_anti"), window)
    origin = None
    for run in sorted({min(r, window) for r in (*runs[1:], window)}):
        if hot is None:
            break
        hot_strings = stash(_apart(strings, hot, "left_semi").select("sid", "packed", "least", "most"), "hot-super-kmers")
        inner = _split(hot_strings, window, run)
        discard(hot_strings)
        step = inner.select(F.col("sid").alias("outer"), "i", F.col("inner").alias("sid"))
        # where the strings of this level lie in those of the first
        origin = step if origin is None else origin.select(F.col("outer"), F.col("i").alias("i0"), F.col("sid").alias("between")).join(step.withColumnRenamed("outer", "between"), "between").select("outer", (F.col("i0") + F.col("i")).alias("i"), "sid")
        origin = stash(origin, "origins")
        strings = inner.select("minimiser", F.col("inner").alias("sid"), "packed", "least", "most")
        hot = _hot(strings, bucket_rows) if run < window else None
        here = _in_buckets(_apart(strings, hot, "left_anti"), window)
        runs_of = F.collect_list(F.struct(F.transform("off", lambda x: x + F.col("i")).alias("off"), "n", "first"))
        here = origin.join(here, "sid").groupBy("outer").agg(runs_of.alias("r"))
        found = found.unionByName(here.select(F.col("outer").alias("sid"), *[F.flatten(f"r.{c}").alias(c) for c in ("off", "n", "first")]))
    return places.select("_id", "_h", "start", "sid").join(found, "sid").where("array_min(first) < _id").groupBy("_id", "_h").agg(F.collect_set(F.struct("start", "off", "n", "first")).alias("spans"))


def _hot(strings: DataFrame, bucket_rows: int) -> DataFrame | None:
    """The minimisers with more than ``bucket_rows`` different strings, or None without any."""
    hot = stash(strings.select("minimiser", "sid").distinct().groupBy("minimiser").agg(F.count("*").alias("c")).where(F.col("c") > bucket_rows).select("minimiser"), "hot-minimisers")
    return None if hot.isEmpty() else hot


def _apart(strings: DataFrame, hot: DataFrame | None, how: str) -> DataFrame:
    """The different strings of the minimisers that are hot (left_semi), or that are not (left_anti)."""
    own = strings if hot is None else strings.join(hot, "minimiser", how)
    return own.groupBy("minimiser", "sid", "packed").agg(F.min("least").alias("least"), F.max("most").alias("most"))


def _in_buckets(strings: DataFrame, window: int) -> DataFrame:
    """strings: (minimiser, sid, packed, least, most). Every bucket sorts its windows: rows of FOUND."""

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None
        for b in batches:
            out: list[tuple] = []
            for m, *row in zip(*(b.column(c).to_pylist() for c in ("minimiser", "sid", "packed", "least", "most")), strict=True):
                if m != now:
                    out += first_in_bucket(held, window)
                    now, held = m, []
                held.append(tuple(row))
            yield _found(out)
        yield _found(list(first_in_bucket(held, window)))

    parts = int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = strings.select("minimiser", "sid", "packed", "least", "most").repartition(parts, "minimiser").sortWithinPartitions("minimiser")
    return map_batches(dealt, buckets, FOUND)


def _split(strings: DataFrame, window: int, run: int) -> DataFrame:
    """Super-k-mers of strings (sid, packed, least, most) by a longer run, where two documents share the minimiser: rows
    (sid, i, minimiser, inner, packed, least, most), ``inner`` being the id of the string of windows from ``i`` on."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [super_kmers(t.split(b" "), window, run) for t in b.column("packed").to_pylist()]
            n = np.repeat(np.arange(len(out)), [len(x[0]) for x in out])
            cols = [np.concatenate([x[k] for x in out]) if out else np.empty(0, np.int64) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[2]), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *[b.column(c).take(n) for c in ("sid", "least", "most")]], ["minimiser", "i", "n", "sid", "least", "most"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for sid, packed, least, most, parts in zip(*(b.column(c).to_pylist() for c in ("sid", "packed", "least", "most", "parts")), strict=True):
                words = packed.split(b" ")
                for p in parts:
                    inner = b" ".join(words[p["i"] : p["i"] + p["n"] + window - 1])
                    rows.append((sid, p["i"], p["minimiser"], hashlib.blake2b(inner, digest_size=16).digest(), inner, least, most))
            types = [pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["sid", "i", "minimiser", "inner", "packed", "least", "most"])

    at = stash(map_batches(strings, find, "minimiser long, i int, n int, sid binary, least long, most long"), "inner-places")
    shared = stash(at.groupBy("minimiser").agg(F.min("least").alias("a"), F.max("most").alias("z")).where("a < z").select("minimiser"), "shared-minimisers")
    worth = at.join(shared, "minimiser").groupBy("sid").agg(F.collect_list(F.struct("i", "n", "minimiser")).alias("parts"))
    inner = stash(map_batches(strings.join(worth, "sid"), cut, "sid binary, i int, minimiser long, inner binary, packed binary, least long, most long"), "inner-super-kmers")
    discard(at, shared)
    return inner


def remove_repeats(docs: DataFrame, window: int = WINDOW, runs: tuple[int, ...] = RUNS, bucket_rows: int = BUCKET_ROWS, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_words, n_removed, kept_sha256 and, if asked, the kept text."""
    docs = keyed(docs, id_col, text_col)
    spans = repeated_windows(docs, window, runs, bucket_rows)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, i, text, found in zip(b.column("doc_id").to_pylist(), b.column("_id").to_pylist(), binaries(b.column("text")), b.column("spans").to_pylist(), strict=True):
                words = text.split()
                gone = np.zeros(len(words) + 1, np.int32)
                for s in found or ():
                    for off, n, first in zip(s["off"], s["n"], s["first"], strict=True):
                        if first < i:
                            gone[s["start"] + off] += 1
                            gone[s["start"] + off + n + window - 1] -= 1
                out = np.cumsum(gone[:-1]) > 0
                kept = b" ".join([w for w, o in zip(words, out.tolist(), strict=True) if not o]) if found else b" ".join(words)
                rows.append((doc_id, len(words), int(out.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            names, types = ["doc_id", "n_words", "n_removed", "kept_sha256", "text"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            n = 4 + keep_text
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[k]) for k in range(n)], names[:n])

    return map_batches(docs.join(spans, ["_id", "_h"], "left").select("doc_id", "_id", "text", "spans"), finish, RESULT + (", text string" if keep_text else ""))
