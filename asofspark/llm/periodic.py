"""Periodic runs of words: block convolution at dyadic scales.

A run is a stretch of words in which words ``q`` apart are identical, of at least ``max(12, 2 * q)`` words, that no
neighbouring word extends; ``q`` is its smallest period. At each scale B = 2, 4, 8, ... the words are cut into blocks of B.
A run whose period lies in the scale's range holds a whole block and that block's copy one period later, so it is enough
to look for the blocks in the windows that follow them: exact integer number theoretic transforms give, for all distances
at once, the sums of squared differences of a block and its window, and a sum of zero is an occurrence. The distances seed
extensions, word by word, to whole runs.

Blocks that cannot occur again in their window are left out before: those that hold a word whose next occurrence lies
beyond it. Blocks and distances inside a run that is known from a smaller scale, of a period no longer than the block, are
left out too: another run could only share so much with it by having its period.

Spark deals documents to tasks; a task takes some megabytes of documents as one row of words, in which no two documents
share a word's number, so that all their blocks of a scale are transformed together.

Defined results: null text has no words; repeated rows are rows of their own; other columns stay as they are, but for those
named like a result; a very long text is one row, searched as a whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import map_batches

#: The definition of a run; a prime with transforms of up to 2**27 numbers, and a generator of its group.
LEAST, TWICE = 12, 2
PRIME, ROOT = 2013265921, 31
#: Numbers that are transformed together.
CHUNK = 1 << 20
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RESULT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def transform(rows: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number theoretic transforms of rows of 2**k numbers below PRIME, as uint64."""
    m, n = rows.shape
    root = pow(ROOT, (PRIME - 1) // n, PRIME)
    if inverse:
        root = pow(root, -1, PRIME)
    x, p = rows.astype(np.uint64), np.uint64(PRIME)
    size, step, order = n, root, np.zeros(1, np.int64)
    while size > 1:  # halves of ever shorter stretches are added and subtracted
        half = size // 2
        powers, k = np.ones(1, np.uint64), 1
        while k < half:
            powers = np.concatenate([powers, powers * np.uint64(pow(step, k, PRIME)) % p])
            k *= 2
        y = x.reshape(m, n // size, 2, half)
        low, high = y[:, :, 0], y[:, :, 1]
        x = np.stack([(low + high) % p, (low + p - high) % p * powers % p], axis=2).reshape(m, n)
        order = np.concatenate([2 * order, 2 * order + 1])
        step, size = step * step % PRIME, half
    x = x[:, order]
    return x * np.uint64(pow(n, -1, PRIME)) % p if inverse else x


def occurrences(words: np.ndarray, starts: np.ndarray, size: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of every block words[start : start + size] and distance from ``low`` to ``high`` at which it occurs
    again. The sum of (x - y)**2 over a block is the sum of x*x and of y*y less twice that of x*y: prefix sums give the
    first two, a product of transforms the third, modulo PRIME; where the sum is zero the words are compared."""
    reach = high - low + size
    n = 1 << (reach - 1).bit_length()
    padded = np.concatenate([words, np.arange(-1, -high - size - 1, -1, dtype=np.int64)]) + (high + size + 1)  # numbers that occur once
    squares = np.concatenate([[0], np.cumsum(padded * padded % PRIME, dtype=np.int64)])  # below 2**63 for 2**32 words
    found_starts, found = [], []
    lags = np.arange(low, high + 1)
    for at in range(0, len(starts), max(1, CHUNK // n)):
        own = starts[at : at + max(1, CHUNK // n)]
        block, window = np.zeros((len(own), n), np.int64), np.zeros((len(own), n), np.int64)
        block[:, :size] = padded[own[:, None] + np.arange(size)] % PRIME
        window[:, :reach] = padded[own[:, None] + low + np.arange(reach)] % PRIME
        block[:, 1:] = block[:, :0:-1].copy()  # a correlation
        product = transform(transform(block) * transform(window) % np.uint64(PRIME), inverse=True)[:, : high - low + 1].astype(np.int64)
        fixed = (squares[own + size] - squares[own])[:, None]
        moving = squares[own[:, None] + lags + size] - squares[own[:, None] + lags]
        k, d = np.nonzero((fixed + moving - 2 * product) % PRIME == 0)
        found_starts.append(own[k])
        found.append(d + low)
    s, d = np.concatenate(found_starts or [starts[:0]]), np.concatenate(found or [starts[:0]])
    same = np.ones(len(s), bool)
    width = min(size, max(1, CHUNK // max(1, len(s))))
    for k in range(0, size, width):  # zero modulo PRIME may be a multiple of it
        i = s[:, None] + np.arange(k, min(k + width, size))
        same &= (padded[i] == padded[i + d[:, None]]).all(axis=1)
    return s[same], d[same]


def extended(words: np.ndarray, at: np.ndarray, distance: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``at`` on, forwards or backwards, equal those ``distance`` further, in stretches that double."""
    n, length = len(words), np.zeros(len(at), np.int64)
    live, reach = np.arange(len(at)), 4
    while len(live):
        rows = max(1, CHUNK // reach)
        going = []
        for lo in range(0, len(live), rows):
            own = live[lo : lo + rows]
            i = at[own, None] + step * (length[own, None] + np.arange(reach))
            j = i + distance[own, None]
            equal = (i >= 0) & (j < n) & (i < n)
            equal &= words[np.clip(i, 0, n - 1)] == words[np.clip(j, 0, n - 1)]
            more = np.where(equal.all(axis=1), reach, equal.argmin(axis=1))
            length[own] += more
            going.append(own[more == reach])
        live, reach = np.concatenate(going), min(2 * reach, CHUNK)
    return length


class Known:
    """Runs found so far, to ask whether a stretch lies inside one of them."""

    def __init__(self):
        self.starts = self.ends = self.periods = np.zeros(0, np.int64)

    def add(self, starts: np.ndarray, ends: np.ndarray, periods: np.ndarray) -> None:
        self.starts, self.ends, self.periods = (np.concatenate(x) for x in ((self.starts, starts), (self.ends, ends), (self.periods, periods)))

    def inside(self, starts: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
        """Which stretches lie inside a run whose period is at most ``most``."""
        own = self.periods <= most
        order = np.argsort(self.starts[own], kind="stable")
        begins, furthest = self.starts[own][order], np.maximum.accumulate(self.ends[own][order])
        k = np.searchsorted(begins, starts, side="right") - 1
        return (k >= 0) & (furthest[np.maximum(k, 0)] >= ends) if len(begins) else np.zeros(len(starts), bool)


def scale_range(size: int) -> tuple[int, int]:
    """The periods of runs that hold a whole block and its copy: at least 2 * size - 1 words match, one period apart."""
    return {2: (6, 6), 4: (1, 14)}.get(size, (2 * size - 1, 4 * size - 2))


def find_runs(words: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, periods) of all runs of a row of numbers in which no run is longer than ``longest``."""
    n, known = len(words), Known()
    order = np.argsort(words, kind="stable")
    again = np.full(n, n, np.int64)  # distance of the next occurrence
    same = words[order[1:]] == words[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    size = 2
    while n and scale_range(size)[0] * TWICE <= longest:
        low, high = scale_range(size)
        blocks = n // size
        furthest = again[: blocks * size].reshape(blocks, size).max(axis=1)
        starts = np.flatnonzero(furthest <= high) * size
        starts = starts[~known.inside(starts, np.minimum(starts + size + high, n), size)]
        s, d = occurrences(words, starts, size, low, high)
        fresh = ~known.inside(s, s + size + d, size)
        s, d = s[fresh], d[fresh]
        order = np.lexsort((s, d))
        s, d = s[order], d[order]
        first = np.ones(len(s), bool)  # blocks in a row at one distance are one seed
        first[1:] = (np.diff(s) != size) | (np.diff(d) != 0)
        head = np.flatnonzero(first)
        tail = np.concatenate([head[1:], [len(s)]])[: len(head)] - 1
        begin = s[head] - extended(words, s[head] - 1, d[head], -1)
        end = s[tail] + size + extended(words, s[tail] + size, d[head], 1) + d[head]
        runs = np.unique(np.stack([begin, end, d[head]], axis=1), axis=0)
        runs = runs[runs[:, 1] - runs[:, 0] >= np.maximum(LEAST, TWICE * runs[:, 2])]
        known.add(*runs.T)
        size *= 2
    runs = np.unique(np.stack([known.starts, known.ends, known.periods], axis=1), axis=0)
    return tuple(smallest_periods(runs).T)


def smallest_periods(runs: np.ndarray) -> np.ndarray:
    """Without the runs that lie in a run of smaller period, which is then their own. In order of start (longest first),
    a run is compared with those that still reach over it."""
    keep, over = np.ones(len(runs), bool), []
    for k in np.lexsort((runs[:, 2], -runs[:, 1], runs[:, 0])).tolist():
        start, end, period = runs[k].tolist()
        over = [(e, q) for e, q in over if e > start]
        keep[k] = not any(e >= end and q < period for e, q in over)
        over.append((end, period))
    return runs[keep]


def search(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, n_words, runs (ordered by start, then period) and the collapsed text: without the
    words that a run holds after its first period, joined by one space."""
    names = [x.split()[0] for x in ("n_words", "runs", "collapsed")]
    others = [c for c in docs.columns if c not in (text_col, *names)]
    kept = F.struct(F.lit(None).alias("none"), *[F.col(f"`{c}`") for c in others])
    rows = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), kept.alias("kept"))
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = [WORD.findall(t) for t in b.column("text").to_pylist()]
            sizes = np.array([len(w) for w in split], np.int64)
            first, numbers, used = np.concatenate([[0], np.cumsum(sizes)]), np.empty(int(sizes.sum()), np.int64), 0
            for k, found in enumerate(split):
                own: dict[str, int] = {}
                numbers[first[k] : first[k + 1]] = [own.setdefault(w, used + len(own)) for w in found]
                used += len(own)
            starts, ends, periods = find_runs(numbers, int(sizes.max(initial=0)))
            gone = np.zeros(len(numbers) + 1, np.int64)
            np.add.at(gone, starts + periods, 1)
            np.add.at(gone, ends, -1)
            kept = np.cumsum(gone)[:-1] == 0
            of = np.searchsorted(first, starts, side="right") - 1
            listed = [[] for _ in split]
            for k, s, e, q in zip(of.tolist(), starts.tolist(), ends.tolist(), periods.tolist(), strict=True):
                listed[k].append({"start": s - int(first[k]), "length": e - s, "period": q})
            texts = [" ".join(w if kept[lo:hi].all() else [x for x, stays in zip(w, kept[lo:hi].tolist(), strict=True) if stays]) for w, lo, hi in zip(split, first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.column("kept").flatten()[1:], pa.array(sizes), pa.array(listed, kinds), pa.array(texts, pa.string())], [*others, *names])

    schema = StructType([StructField(f.name, f.dataType) for f in rows.schema["kept"].dataType][1:])
    for f in docs.sparkSession.createDataFrame([], RESULT).schema:
        schema = schema.add(f)
    return map_batches(rows, run, schema)


def plant(docs: DataFrame) -> DataFrame:
    """The contract's planted runs: with h the crc32 of the decimal doc_id and g = h / 10, in documents of h % 10 = 0 each word
    i from a = g % n on becomes word a + (i - a) % p, for p = 1 + (n - a) / (3 + g % 8). A null doc_id plants none."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    marked = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w"))
    marked = marked.withColumn("a", F.expr("case when n > 0 then g % n end")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    planted = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, element_at(w, cast(1 + a + (i - a) % p as int)))), ' ')")
    return marked.select("doc_id", F.when(F.col("p").isNotNull(), planted).otherwise(F.col("text")).alias("text"))
