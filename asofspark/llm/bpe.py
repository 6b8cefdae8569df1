"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

``encode``: texts are exploded into pre-tokens with their positions, packed by block: a block is some megabytes of one
task's documents, its words are numbered by first occurrence and its positions hold those numbers. A block's distinct
words go, packed by a checksum, to the task of that checksum, which encodes each distinct word once and sends its ids
back to every block that asked. There the ids are put in place by position. A word goes out once a block however often it
occurs, so that the most frequent word is no larger a load than any other.

``decode`` explodes ids with positions and joins the table of token bytes.

Defined results: null text is empty and has no ids; a document is one row, repeated rows are rows of their own; other
columns don't travel, whatever their names; a very long text is a block, and in the end a row, of its own; a very long
pre-token is a word like any other; an empty table gives no rows; null ids arrays decode to no bytes; ids outside the
vocabulary are an error.
"""

from __future__ import annotations

import base64
import re
import sys
import types
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import BATCH_BYTES, map_batches

#: Characters of a block's texts, and bound of what a worker remembers of words.
BLOCK_CHARS, KEEP_BYTES = 16_000_000, 64_000_000
#: Numbers or bytes that are packed or unpacked at a time.
CHUNK = 1 << 18
BLOCK_IDS = 1_000_000
#: A token table of more entries than this isn't broadcast.
BROADCAST_TOKENS = 1_000_000
PACKED = "part int, block long, kind int, data binary, words binary, ids array<long>, sizes array<int>"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 in seven-bit groups, the lowest first, deflated."""
    deflate, out = zlib.compressobj(1), []
    for lo in range(0, len(numbers), CHUNK):
        v = numbers[lo : lo + CHUNK].astype(np.uint32)
        n = np.ones(len(v), np.int32)
        for k in range(1, 5):
            n += v >= np.uint32(1 << (7 * k))
        at = np.cumsum(n) - n
        groups = np.zeros(int(n.sum()), np.uint8)
        for k in range(5):
            m = n > k
            groups[at[m] + k] = ((v[m] >> np.uint32(7 * k)) & np.uint32(127)) | ((n[m] > k + 1).astype(np.uint32) << np.uint32(7))
        out.append(deflate.compress(groups.tobytes()))
    return b"".join([*out, deflate.flush()])


def unpack_numbers(data: bytes) -> np.ndarray:
    inflate, rest, out = zlib.decompressobj(), b"", []
    while not inflate.eof:
        b = np.frombuffer(rest + inflate.decompress(data, CHUNK), np.uint8)
        data = inflate.unconsumed_tail
        ends = np.flatnonzero(b < 128)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        rest = b[ends[-1] + 1 :].tobytes() if len(ends) else b.tobytes()
        n, v = ends - starts + 1, np.zeros(len(ends), np.uint32)
        for k in range(5):
            m = n > k
            v[m] |= (b[starts[m] + k] & 127).astype(np.uint32) << np.uint32(7 * k)
        out.append(v)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


class Splitter:
    """The pre-tokens of a text, as the tiktoken library's own pattern engine finds them.

    Texts of Latin-1 characters go through ``re`` with the classes written out, others through ``regex``. Characters that
    this Python's Unicode tables don't know are asked of the library, once each, and stand-ins of their class take their
    place while the text is parted.
    """

    def __init__(self, pattern: str):
        import regex

        pick = lambda kind: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == kind)
        letters, numbers, blanks = pick("L"), pick("N"), "\t-\r \x85\xa0"
        latin = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{blanks}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\s", f"[{blanks}]").replace(r"\S", f"[^{blanks}]")
        self.pattern, self.every, self.latin = pattern, regex.compile(pattern), re.compile(latin).findall
        self.classed: dict[str, str] = {}

    def _stand_in(self, c: str) -> str:
        """``c`` itself if known, else a letter, digit or sign: that with which the library keeps it in one pre-token."""
        if unicodedata.category(c) != "Cn":
            return c
        import tiktoken

        lead = c.encode()[:1]
        for known in "a1!":
            ranks = {bytes([b]): b for b in range(256)} | {known.encode() + lead: 256}
            if 256 in tiktoken.Encoding("probe", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(known + c):
                return known
        return c

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.latin(text)
        try:
            text.encode("latin-1")
            return self.latin(text)
        except UnicodeEncodeError:
            pass
        strange = []
        for c in set(text):
            if c not in self.classed:
                self.classed[c] = self._stand_in(c)
            if self.classed[c] != c:
                strange.append(c)
        if not strange:
            return self.every.findall(text)
        seen = text.translate({ord(c): self.classed[c] for c in strange})
        return [text[m.start() : m.end()] for m in self.every.finditer(seen)]


class Numbers(dict):
    """Words numbered by first occurrence."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class WordEncoder:
    """Ids of words by ranks. What was encoded is remembered in two generations, bounded in bytes."""

    def __init__(self, path: str, pattern: str, keep_bytes: int = KEEP_BYTES):
        import tiktoken

        ranks = read_ranks(path)
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.keep_bytes = self.room = keep_bytes // 2

    @staticmethod
    def of(path: str, pattern: str) -> WordEncoder:
        """The worker process's own, which outlives its tasks."""
        held = sys.modules.setdefault("_word_encoder_of_this_worker", types.ModuleType("_word_encoder_of_this_worker")).__dict__
        if (path, pattern) not in held:
            held[path, pattern] = WordEncoder(path, pattern)
        return held[path, pattern]

    def __call__(self, word: bytes) -> bytes:
        """32-bit ids."""
        ids = self.known.get(word)
        if ids is None:
            ids = self.older.get(word)
            if ids is None:
                ids = array("I", self.encode(word.decode())).tobytes()
            self.known[word] = ids
            self.room -= 200 + len(word) + len(ids)
            if self.room < 0:
                self.older, self.known, self.room = self.known, {}, self.keep_bytes
        return ids


def _blocks(batches: Iterator[pa.RecordBatch], split: Splitter, block_chars: int) -> Iterator[tuple[list, list, Numbers, list[np.ndarray]]]:
    """(doc ids, pre-token counts, words, word number of each position) of each block."""
    ids, sizes, words, places, chars = [], [], Numbers(), [], 0
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if ids and chars + len(text or "") > block_chars:
                yield ids, sizes, words, places
                ids, sizes, words, places, chars = [], [], Numbers(), [], 0
            found = split(text or "")
            ids.append(doc_id)
            sizes.append(len(found))
            places.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
            chars += len(text or "")
    if ids:
        yield ids, sizes, words, places


def _record(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


ROWS = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("data", pa.binary()), ("words", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])


def explode_words(docs: DataFrame, pattern: str, parts: int, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Packed rows: of each block one for each part of its distinct words (``kind`` = part: lengths, bytes), and one with
    its documents and positions (``kind`` = parts: positions, and the part of each word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, task = Splitter(pattern), TaskContext.get().partitionId()
        for n, (ids, sizes, words, places) in enumerate(_blocks(batches, split, block_chars)):
            block = (task << 32) + n
            texts = [w.encode() for w in words]
            part = np.fromiter((zlib.crc32(w) % parts for w in texts), np.uint32, len(texts))
            order, ends = np.argsort(part, kind="stable"), np.cumsum(np.bincount(part, minlength=parts))
            lo = 0
            for p, hi in enumerate(ends.tolist()):
                if hi > lo:
                    own = [texts[k] for k in order[lo:hi].tolist()]
                    yield _record(ROWS, [(p, block, p, pack_numbers(np.array([len(w) for w in own])), zlib.compress(b"".join(own), 1), None, None)])
                lo = hi
            words.clear()
            del texts
            yield _record(ROWS, [(zlib.crc32(b"%d" % block) % parts, block, parts, pack_numbers(np.concatenate(places)), pack_numbers(part), ids, sizes)])

    return map_batches(docs, run, PACKED)


def encode_words(packed: DataFrame, ranks_path: str, pattern: str, parts: int) -> DataFrame:
    """The words of each row replaced by their ids (``data``: counts, ``words``: ids); rows of positions pass. A part's rows
    of all blocks meet in one task, in which each distinct word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(ranks_path, pattern)
        for b in batches:
            for k, kind in enumerate(b.column("kind").to_pylist()):
                row = b.slice(k, 1)
                if kind == parts:
                    yield pa.RecordBatch.from_arrays([row.column(f.name).cast(f.type) for f in ROWS], schema=ROWS)
                    continue
                one = row.to_pylist()[0]
                ends = np.cumsum(unpack_numbers(one["data"]), dtype=np.int64).tolist()
                text, lo, counts, ids = zlib.decompress(one["words"]), 0, [], []
                for hi in ends:
                    found = encoder(text[lo:hi])
                    counts.append(len(found) // 4)
                    ids.append(found)
                    lo = hi
                yield _record(ROWS, [(one["part"], one["block"], kind, pack_numbers(np.array(counts)), pack_numbers(np.frombuffer(b"".join(ids), np.uint32)), None, None)])

    return map_batches(packed.repartitionById(parts, "part"), run, PACKED)


def place_ids(encoded: DataFrame, parts: int) -> DataFrame:
    """(doc_id, ids) of every document: a block's word ids meet its positions."""
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, ids = [], []
        for b in batches:
            for k, kind in enumerate(b.column("kind").to_pylist()):
                one = b.slice(k, 1).to_pylist()[0]
                if kind < parts:
                    counts.append((kind, unpack_numbers(one["data"])))
                    ids.append(unpack_numbers(one["words"]))
                    continue
                part, places = unpack_numbers(one["words"]), unpack_numbers(one["data"])
                n_ids = np.concatenate([c for _, c in counts]) if counts else np.zeros(0, np.uint32)
                held = np.repeat([p for p, _ in counts], [len(c) for _, c in counts]) if counts else part
                order = np.argsort(part, kind="stable")
                if not np.array_equal(held, part[order]):
                    raise ValueError("words and positions of a block differ: the input has changed while it was read")
                pool = np.concatenate(ids) if ids else n_ids
                many, begin = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
                many[order], begin[order] = n_ids, np.cumsum(n_ids, dtype=np.int64) - n_ids
                yield from _documents(one["ids"], one["sizes"], places, many, begin, pool)
                counts, ids = [], []

    def _documents(doc_ids: list, sizes: list, places: np.ndarray, many: np.ndarray, begin: np.ndarray, pool: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Some documents at a time, so that their ids stay within a few batches' bytes."""
        ends = np.cumsum(sizes, dtype=np.int64)
        lo = 0
        while lo < len(sizes):
            first = int(ends[lo] - sizes[lo])
            hi = max(lo + 1, int(np.searchsorted(ends, first + BATCH_BYTES // 16, side="right")))
            at = places[first : int(ends[hi - 1])]
            n = many[at]
            total = np.concatenate([[0], np.cumsum(n)])
            values = pool[np.repeat(begin[at] - total[:-1], n) + np.arange(total[-1])].astype(np.int32)
            offsets = total[np.concatenate([[0], ends[lo:hi] - first])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids[lo:hi], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], schema=out)
            lo = hi

    return map_batches(encoded.repartition("block").sortWithinPartitions("block", "kind"), run, "doc_id long, ids array<int>")


def encode(docs: DataFrame, ranks_path: str, pattern: str, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, ids) of every row. ``parts`` is in how many parts distinct words are dealt, by default as many as the session's
    shuffle partitions."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return place_ids(encode_words(explode_words(rows, pattern, parts, block_chars), ranks_path, pattern, parts), parts)


def token_table(spark: SparkSession, ranks_path: str) -> DataFrame:
    """(token, bytes) of the vocabulary."""
    ranks = read_ranks(ranks_path)
    return spark.createDataFrame(pa.table({"token": pa.array(ranks.values(), pa.int32()), "bytes": pa.array(ranks.keys(), pa.binary())}))


def decode(encoded: DataFrame, tokens: DataFrame, n_tokens: int, ids_col: str = "ids") -> DataFrame:
    """All columns but the ids, and ``decoded`` (binary, in place of a column of that name).

    Rows are packed in blocks of about BLOCK_IDS ids: each distinct id of a block is exploded once and joined with the token
    table (token, bytes) of ``n_tokens`` rows, beside it go the positions. A table of up to BROADCAST_TOKENS rows is broadcast;
    then a block's ids stay in order in their task, which is verified. Larger tables are joined by shuffle, and the rows are
    sorted back by block and id.
    """
    columns = [c for c in encoded.columns if c not in ("decoded", ids_col)]
    rows = encoded.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("kept"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    shape = StructType().add("block", "long").add("tokens", ArrayType(IntegerType())).add("places", "binary").add("sizes", ArrayType(IntegerType())).add("kept", ArrayType(rows.schema["kept"].dataType))
    packed = map_batches(rows, _pack_ids, shape)
    each = packed.select("block", "places", "sizes", "kept", F.posexplode("tokens").alias("pos", "token"))
    first = lambda c: F.when(F.col("pos") == 0, F.col(c)).alias(c)
    each = each.select("block", "pos", "token", first("places"), first("sizes"), first("kept"))
    small = n_tokens <= BROADCAST_TOKENS
    joined = each.join(F.broadcast(tokens) if small else tokens, "token", "left").select("block", "pos", "token", "bytes", "places", "sizes", "kept")
    if not small:
        joined = joined.repartition("block").sortWithinPartitions("block", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, head, table = None, None, []
        for b in batches:
            for k, (own, pos, token, value) in enumerate(zip(*(b.column(c).to_pylist() for c in ("block", "pos", "token", "bytes")), strict=True)):
                if own != block:
                    if block is not None:
                        yield _place_bytes(head, table, columns)
                    block, head, table = own, b.slice(k, 1).select(["places", "sizes", "kept"]), []
                if pos != len(table):
                    raise ValueError("ids are out of order")
                if value is None and token is not None:
                    raise ValueError(f"id {token} is not in the token table")
                table.append(value)
        if block is not None:
            yield _place_bytes(head, table, columns)

    schema = StructType([StructField(f.name, f.dataType) for f in rows.schema["kept"].dataType]).add("decoded", "binary")
    return joined.mapInArrow(run, schema)  # rows of one id: Spark's batches are small enough


def _pack_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: its distinct ids (none at least once, as NULL), the place of each id among them, and its rows."""
    task, held, n, blocks = TaskContext.get().partitionId(), [], 0, 0

    def packed() -> pa.RecordBatch:
        ids = pa.concat_arrays([b.column("ids") for b in held])
        kept = pa.concat_arrays([b.column("kept") for b in held])
        tokens, places = np.unique(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), return_inverse=True)
        sizes = pa.compute.fill_null(pa.compute.list_value_length(ids), 0).cast(pa.int32())
        listed = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        found = pa.array(tokens, pa.int32()) if len(tokens) else pa.array([None], pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([(task << 32) + blocks], pa.int64()), listed(found), pa.array([places.astype(np.uint32).tobytes()], pa.binary()), listed(sizes), listed(kept)], ["block", "tokens", "places", "sizes", "kept"])

    for b in batches:
        held.append(b)
        n += len(b.column("ids").flatten())
        if n > BLOCK_IDS:
            yield packed()
            held, n, blocks = [], 0, blocks + 1
    if held:
        yield packed()


def _place_bytes(head: pa.RecordBatch, table: list[bytes], columns: list[str]) -> pa.RecordBatch:
    places, texts, lo = np.frombuffer(head.column("places")[0].as_py(), np.uint32).tolist(), [], 0
    for n in head.column("sizes")[0].as_py():
        texts.append(b"".join(map(table.__getitem__, places[lo : lo + n])))
        lo += n
    return pa.RecordBatch.from_arrays([*head.column("kept").flatten().flatten(), pa.array(texts, pa.binary())], [*columns, "decoded"])
