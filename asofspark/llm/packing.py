"""Packing: best-fit decreasing of token pieces into windows, by a segment tree over remaining capacities.

``token_pieces`` cuts every document into full windows and a rest; ``best_fit`` places the pieces. Pieces are dealt
evenly to groups of a few thousand, which are packed apart: at that size a group leaves about one window partly
filled, so that the padding stays near 0.1 % however many groups there are, and no task sees more than its groups.

Defined results: a null or empty text has the end id alone; repeated rows are packed each for itself; pieces of equal
length go by doc_id, start, checksum and number; an empty table gives no rows; a document of exactly k windows has k
full pieces and no rest; a very long text is one row in one task, its pieces are packed apart.
"""

from __future__ import annotations

import os
import re
import sys
import types
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stash

WINDOW = 4096
GROUP_PIECES = 4000
#: Bound of what a worker remembers of words.
KEEP_BYTES = 96_000_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Capacities:
    """Segment tree whose leaves count the open windows by remaining capacity."""

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.count = [0] * (2 * self.width)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, window: int, capacity: int, sign: int = 1) -> None:
        if sign > 0:
            self.open[capacity].append(window)
        i = self.width + capacity
        while i:
            self.count[i] += sign
            i >>= 1

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """Remove and return (window, capacity) of the smallest capacity that holds ``need``."""
        i, count = self.width + need, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up to the first subtree further right that has a window
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.width:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.width
        window = self.open[capacity].pop()
        self.add(window, capacity, -1)
        return window, capacity


class WordIds:
    """Token ids of texts as little-endian 32-bit bytes.

    A blank or line break always parts tokens here, so that a text's ids are those of its words in a row. A word's ids are
    looked up, else put together from its parts (runs of letters, digits, other signs), else made by the tokenizer's model.
    What was looked up or made is remembered in two generations, bounded in bytes: when the younger is full the older goes.

    Words of Latin-1 characters are parted here, as the tokenizer's own rules would part them; all other words, and words
    that might hold a special token, go through the whole tokenizer.
    """

    LETTER, DIGIT, SPACE = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
    PART = f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^{SPACE}{LETTER}{DIGIT}]+"
    #: What an entry takes beside its characters: two objects' headers and a dictionary's slot.
    ENTRY = 160

    def __init__(self, path: str, keep_bytes: int = KEEP_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts_of = re.compile(self.PART).findall
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.keep_bytes = self.room = keep_bytes // 2
        # the printable stand-ins of bytes in the vocabulary: printable Latin-1 stands for itself, others follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.signs = "".join(chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256))

    @staticmethod
    def of(path: str) -> WordIds:
        """The worker process's own, which outlives its tasks."""
        held = sys.modules.setdefault("_word_ids_of_this_worker", types.ModuleType("_word_ids_of_this_worker")).__dict__
        if path not in held:
            held[path] = WordIds(path)
        return held[path]

    def _plain(self, text: str) -> bool:
        """Lower case and parts are known without the tokenizer: Latin-1 characters, which all are in normal form, and no special token."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return False
        return "<|" not in text and not any(s in text for s in self.special)

    def _part(self, part: str) -> bytes:
        signs = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.signs)
        ids = self.known[part] = array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()
        self.room -= self.ENTRY + len(part) + len(ids)
        return ids

    def _learn(self, words: set[str], plain: bool) -> None:
        known, older, parts_of, entry = self.known, self.older, self.parts_of, self.ENTRY
        for word in words:
            ids = older.get(word)
            if ids is None:
                if plain or self._plain(word):
                    parts = parts_of(word if plain else word.lower())
                    if len(parts) == 1 and parts[0] == word:
                        self._part(word)
                        continue
                    ids = b"".join([known.get(p) or older.get(p) or self._part(p) for p in parts])
                else:
                    ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
            known[word] = ids
            self.room -= entry + len(word) + len(ids)

    def encode(self, text: str) -> bytes:
        plain = self._plain(text)
        split = (text.lower() if plain else text).replace("\n", " ").split(" ")
        known = self.known
        if new := set(split).difference(known):
            self._learn(new, plain)
        ids = b"".join(map(known.__getitem__, split))
        if self.room < 0:
            self.older, self.known, self.room = known, {"": b""}, self.keep_bytes
        return ids


def token_pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = 2, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its place in the document, its length and the checksum (and, if asked, bytes) of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = WordIds.of(tokenizer_path), array("I", [end_id]).tobytes()
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                view = memoryview(words.encode(text or "") + end)
                n = len(view) // 4
                for s in range(0, n, window):
                    ids = view[4 * s : 4 * (s + window)]
                    rows.append((doc_id, s, len(ids) // 4, zlib.crc32(ids), n, bytes(ids) if keep_ids else None))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + ([pa.array(cols[5], pa.binary())] if keep_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * keep_ids)

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, PIECES + (", ids binary" if keep_ids else ""))


def best_fit(pieces: DataFrame, window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """All columns and sequence_id and offset (in place of columns of these names) of rows that have a ``length`` from 1 to
    ``window``. The pieces are numbered at rest and dealt by a hash of their numbers, so that a retried task packs alike and
    repeated rows spread evenly."""
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    numbered = stash(pieces.select(*[F.col(f"`{c}`") for c in columns], F.monotonically_increasing_id().alias("__row")), "pieces")
    groups = numbered.count() // group_pieces + 1
    dealt = numbered.withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(groups)))
    parts = min(groups, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ties = [c for c in ("doc_id", "start", "ids_crc32") if c in columns]
    dealt = dealt.repartition(parts, "__group").sortWithinPartitions("__group", F.desc("length"), *ties, "__row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, tree, opened = None, None, 0
        for b in batches:
            seq, off = [], []
            for g, n in zip(b.column("__group").to_pylist(), b.column("length").to_pylist(), strict=True):
                if g != group:
                    group, tree, opened = g, Capacities(window), 0
                found = tree.take_tightest(n)
                if found is None:
                    found, opened = (opened, window), opened + 1
                w, room = found
                seq.append((g << 32) + w)
                off.append(window - room)
                if room > n:
                    tree.add(w, room - n)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in columns] + [pa.array(seq, pa.int64()), pa.array(off, pa.int64())], [*columns, "sequence_id", "offset"])

    schema = numbered.select(*[F.col(f"`{c}`") for c in columns]).schema.add("sequence_id", "long").add("offset", "long")
    return map_batches(dealt, run, schema)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack; the pieces rest in the shared scratch folder between the two steps."""
    return best_fit(token_pieces(docs, tokenizer_path, window, end_id, keep_ids), window)
