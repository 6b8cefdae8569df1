"""Benchmark decontamination: passages of a benchmark in documents, exact or with edits, by q-gram lemma filtering.

Texts are lower-cased, white space is one blank. An item of L characters may be met with up to k = error * L edits. A
region that holds it shares at least L - q + 1 - k * q of its q-grams, on diagonals at most k apart; so shared
q-grams are counted in overlapping bands of 2k diagonals, regions that reach the bound are kept, and a banded
alignment of the item against each decides. Short items have a smaller q where the bound would not be positive; items
shorter than Q are sought as they are, between blanks.

The benchmark is the stated query set. It goes to the tasks in blocks of a bounded number of characters; documents
are scanned where they lie, without a shuffle, long ones in overlapping slices. Usually there is one block; with more,
each block's finds are written before the next one is read.

Defined results: null or empty texts and items match nothing; items that repeat are each reported; repeated document
rows are each reported; a null doc_id or item_id is reported as null; empty tables give no rows. A pair is reported
once, by its least distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, kept_columns, map_batches, stash

Q, ERROR = 7, 0.1
#: Characters of a block of items, and of a slice of a document.
BLOCK_CHARS, SLICE_CHARS = 8_000_000, 1_000_000
#: Characters that are scanned at a time: few enough for the arrays to stay in a core's cache.
GROUP_CHARS = 60_000
FOUND = "doc_id long, item_id long, distance long, shared_qgrams long, region_start long"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def gram_hashes(c: np.ndarray, q: int = Q) -> np.ndarray:
    """32-bit hashes of the q-grams at every position, by doubling: two hashes of k characters, the second ``step`` on,
    make one of k + step. Equal hashes of unequal q-grams only let a region pass that the alignment then turns down."""
    if len(c) < q:
        return np.empty(0, np.uint32)
    h, k = c, 1
    while k < q:
        step = min(k, q - k)
        h = h[:-step] * np.uint32((0x9E3779B1 * k + 0x7F4A7C16) & 0xFFFFFFFF | 1) + h[step:]
        h ^= h >> np.uint32(15)
        k += step
    return h


def block(rows: list[tuple[int | None, str]], q: int = Q, error: float = ERROR) -> list[Items]:
    """The items by the q-gram length that leaves their lemma a positive bound: ``q``, but for short items."""
    by_q: dict[int, list] = {q: []}
    for i, t in rows:
        if t:
            by_q.setdefault(q if len(t) < q else max(1, min(q, len(t) // (int(len(t) * error) + 1))), []).append((i, t))
    return [Items(own, k, error, shortest=q) for k, own in sorted(by_q.items())]


class Items:
    """Items of one q, with their q-grams in hash order; those below ``shortest`` characters apart."""

    def __init__(self, rows: list[tuple[int | None, str]], q: int = Q, error: float = ERROR, shortest: int = Q):
        self.q = q
        self.short = [(i, f" {t} ") for i, t in rows if len(t) < shortest]
        rows = [(i, t) for i, t in rows if len(t) >= shortest]
        self.ids, self.texts, self.codes = [i for i, _ in rows], [t for _, t in rows], [codes(t) for _, t in rows]
        size = np.array([len(c) for c in self.codes], np.int64)
        self.k = (size * error).astype(np.int64)
        self.least = size - q + 1 - self.k * q
        self.longest = int(size.max(initial=0))
        self.step = np.maximum(self.k, 1)
        grams = [gram_hashes(c, q) for c in self.codes]
        every = np.concatenate([*grams, np.empty(0, np.uint32)])
        order = np.argsort(every, kind="stable")
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.place = np.concatenate([*(np.arange(len(g)) for g in grams), np.empty(0, np.int64)])[order].astype(np.int64)
        self.grams, self.first = np.unique(every[order], return_index=True)
        self.count = np.diff(np.concatenate([self.first, [len(every)]]))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.grams & np.uint32((1 << 20) - 1)] = True

    def regions(self, c: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first diagonal of the band, shared q-grams) that meet the lemma's bound in one slice of text."""
        h = gram_hashes(c, self.q)
        at = np.flatnonzero(self.seen[h & np.uint32((1 << 20) - 1)])
        if not len(at) or not len(self.grams):
            return []
        g = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        same = self.grams[g] == h[at]
        at, g = at[same], g[same]
        n = self.count[g]
        width = (len(c) + 2 * self.longest) + 2
        found, total = [], np.cumsum(n)
        for lo, hi in self._portions(total):
            own = n[lo:hi]
            post = np.repeat(self.first[g[lo:hi]] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
            item, diagonal = self.item[post], np.repeat(at[lo:hi], own) - self.place[post] + self.longest
            band = item * width + diagonal // self.step[item]
            hits = band * self.longest + self.place[post]
            found.append(np.concatenate([hits, hits - self.longest]))
            if hi < len(n) or lo:  # a q-gram that comes again and again in text and item: each (band, place) once
                found = [np.unique(np.concatenate(found))]
        if not found:
            return []
        hits = found[0]
        keys = hits // self.longest
        key, which, count = np.unique(keys, return_inverse=True, return_counts=True)
        held = (count >= self.least[key // width])[which]
        # the bound holds for the item's own q-grams: one that comes repeatedly in a band counts once
        key, count = np.unique(np.unique(hits[held]) // self.longest, return_counts=True)
        ok = count >= self.least[key // width]
        return [(int(i), int((b * self.step[i]) - self.longest), int(s)) for i, b, s in zip(key[ok] // width, key[ok] % width, count[ok], strict=True)]


    @staticmethod
    def _portions(total: np.ndarray, most: int = 2_000_000) -> list[tuple[int, int]]:
        """Stretches of positions with about ``most`` postings each; total: their running number."""
        if not len(total):
            return []
        cuts = np.searchsorted(total, np.arange(most, int(total[-1]), most))
        return [(int(a), int(b)) for a, b in zip([0, *cuts], [*cuts, len(total)], strict=True) if a < b]


def aligned(item: np.ndarray, text: np.ndarray, diagonal: int, width: int) -> int:
    """Least edits between ``item`` and a piece of ``text``, over alignments within ``width`` diagonals from the first."""
    j = np.arange(width)
    big = len(item) + len(text) + 9
    at = diagonal + j
    row = np.where((at >= 0) & (at <= len(text)), 0, big)
    padded = np.concatenate([np.full(width + len(item) + 1, 0xFFFFFFFF, np.uint32), text, np.full(width + len(item) + 1, 0xFFFFFFFF, np.uint32)])
    base = width + len(item) + 1 + diagonal
    for i in range(len(item)):
        # band place j of row i + 1 ends at text position diagonal + i + 1 + j
        lo = max(base + i, 0)
        chars = padded[lo : lo + width]
        if len(chars) < width:
            chars = np.concatenate([chars, np.full(width - len(chars), 0xFFFFFFFF, np.uint32)])
        new = row + (chars != item[i])
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        end = at + i + 1
        new = np.where((end >= 0) & (end <= len(text)), new, big)
        row = np.minimum.accumulate(new - j) + j
    return int(row.min())


def matches(index: list[Items], texts: list[str]) -> list[list[tuple]]:
    """For each normalised text, (item_id, distance, shared q-grams, region start) of each item met in it."""
    return [[m for found in own for m in found] for own in zip(*(_matches(items, texts) for items in index), strict=True)]


def _matches(items: Items, texts: list[str]) -> list[list[tuple]]:
    """Those of the items of one q.

    Texts are scanned together, parted by characters that no item has; a long one in overlapping slices.
    """
    best: list[dict[int, tuple]] = [{} for _ in texts]
    overlap = 2 * items.longest + 2
    pieces = [(n, lo, t[lo : lo + SLICE_CHARS + overlap]) for n, t in enumerate(texts) for lo in range(0, max(1, len(t) - overlap), SLICE_CHARS) if t]
    group, size = [], 0
    for piece in [*pieces, None]:
        if piece:
            group.append(piece)
            size += len(piece[2])
        if group and (piece is None or size >= GROUP_CHARS):
            _scan(items, group, best)
            group, size = [], 0
    out = []
    for t, found in zip(texts, best, strict=True):
        padded = f" {t} " if items.short and t else ""
        out.append([(items.ids[i], d, -s, at) for i, (d, s, at) in found.items()] + [(i, 0, 0, padded.index(x)) for i, x in items.short if x in padded])
    return out


def _scan(items: Items, pieces: list[tuple[int, int, str]], best: list[dict[int, tuple]]) -> None:
    gap = "\0" * items.q
    start = np.cumsum([0] + [len(t) + items.q for _, _, t in pieces])
    whole = codes(gap.join(t for _, _, t in pieces))
    for i, diagonal, shared in items.regions(whole):
        k, length = int(items.k[i]), len(items.codes[i])
        first = max(0, int(np.searchsorted(start, diagonal, "right")) - 1)
        last = int(np.searchsorted(start, diagonal + 2 * int(items.step[i]) + length))
        for number in range(first, min(last, len(pieces))):
            n, lo, t = pieces[number]
            if len(t) < length - k:
                continue
            at = diagonal - int(start[number])
            distance = 0 if items.texts[i] in t else aligned(items.codes[i], codes(t), at - k, int(2 * items.step[i]) + 2 * k + 1)
            if distance <= k and (i not in best[n] or (distance, -shared) < best[n][i][:2]):
                best[n][i] = (distance, -shared, lo + max(0, at))


def _blocks(benchmark: DataFrame, q: int, error: float, block_chars: int) -> Iterator[list[Items]]:
    """Indexes of about ``block_chars`` characters each; they travel with the functions that use them."""
    size = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = size // block_chars + 1
    for k in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else benchmark
        yield block(sorted(((r["item_id"], normal(r["text"])) for r in part.select("item_id", "text").collect()), key=str), q, error)


def find(docs: DataFrame, benchmark: DataFrame, q: int = Q, error: float = ERROR, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document row and item found in it."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def scan(index: list[Items]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found_in = matches(index, [normal(t) for t in b.column(1).to_pylist()])
                out = [(d, *m) for d, ms in zip(b.column(0).to_pylist(), found_in, strict=True) for m in ms]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(5)], [x.split()[0] for x in FOUND.split(", ")])

        return map_batches(texts, run, FOUND)

    written, last = [], None
    for index in _blocks(benchmark, q, error, block_chars):
        if last is not None:
            written.append(stash(last, "finds"))
        last = scan(index)
    for found in written:
        last = last.unionByName(found)
    return last


def remove(docs: DataFrame, benchmark: DataFrame, q: int = Q, error: float = ERROR, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents (all columns) in which no item is found."""

    def clean(rows: DataFrame, index: list[Items]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = pa.array([not m for m in matches(index, [normal(t) for t in b.column("text").to_pylist()])], pa.bool_())
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in b.columns], b.schema.names)

        return map_batches(rows, run, rows.schema)

    rows = beside(docs, docs.columns, text=F.col("text"))
    for k, index in enumerate(_blocks(benchmark, q, error, block_chars)):
        rows = clean(stash(rows, "clean") if k else rows, index)
    return rows.select(*kept_columns(docs.columns))
