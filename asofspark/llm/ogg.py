"""Media columns: texts as 8-bit sample streams in Ogg pages, written, verified, demultiplexed and read back.

``to_media`` makes a binary column in the Ogg container from a text column; ``read_media`` verifies and reads such
a column. Both run row by row within Arrow batches and need no shuffle, so that tasks hold one batch at a time.

Timestamps come from the granule positions: a page that ends a packet ends at its granule, and begins where the one
before ended; packets of samples are dated back from there by their own lengths.

Defined results: a null text is an empty one (one padding block of 64 zero bytes); equal texts give equal bytes,
as stream serials come from the payload; a null media value gives nulls; a damaged container raises ``OggError``
in ``parse`` and gives ``valid`` false, with its error, from ``read_media``; a sound container of other streams is valid,
its streams are listed and the columns of the payload are null; repeated rows are read each for itself; a very long
text is one row, of which a worker holds a few copies; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import binaries, map_batches

HEAD = "<4sBBqIIIB"
HEAD_SIZE = struct.calcsize(HEAD)
BLOCK = 64
PACKET = 4096
RATE = 8000
_SWAP = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))


class OggError(ValueError):
    """The bytes are no sound Ogg container."""


def page_checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, unreflected, from 0: zlib's reflected one over bit-swapped bytes."""
    crc = zlib.crc32(page.translate(_SWAP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{crc:032b}"[::-1], 2)


def _page(serial: int, sequence: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    raw = struct.pack(HEAD, b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing + body
    return raw[:22] + struct.pack("<I", page_checksum(raw)) + raw[26:]


def stream_pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """The pages of one logical stream. packets: data and the granule position at the end of each.

    The first packet has the first page to itself. Others fill pages of up to 255 lacing values and run on over
    page borders; a page on which no packet ends has granule -1.
    """
    pages = [_page(serial, 0, 2 | (4 if len(packets) == 1 else 0), packets[0][1], _lacing(packets[0][0]), packets[0][0])]
    lacing, body, granule, goes_on = bytearray(), [], -1, False

    def flush(last: bool, cut: bool) -> None:
        nonlocal lacing, body, granule, goes_on
        pages.append(_page(serial, len(pages), (1 if goes_on else 0) | (4 if last else 0), granule, bytes(lacing), b"".join(body)))
        lacing, body, granule, goes_on = bytearray(), [], -1, cut

    for k, (data, at) in enumerate(packets[1:], 2):
        values, done = _lacing(data), 0
        while values:
            part, values = values[: 255 - len(lacing)], values[255 - len(lacing) :]
            lacing += part
            body.append(data[done : done + sum(part)])
            done += sum(part)
            if not values:
                granule = at
            if len(lacing) == 255 or (not values and k == len(packets)):
                flush(not values and k == len(packets), bool(values))
    return pages


def _lacing(packet: bytes) -> bytes:
    return b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])


def encode(data: bytes, rate: int = RATE) -> bytes:
    """One container of two multiplexed logical streams: the padded samples and a note of the true length."""
    payload = data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))
    serial = zlib.crc32(payload)
    first = b"PCM8" + struct.pack("<IBQ", rate, 1, len(payload))
    sound = [(first, 0)] + [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    note = [(b"NOTE" + struct.pack("<Q", len(data)), 0), (b"bytes=%d" % len(data), len(payload))]
    a, b = stream_pages(serial, sound), stream_pages(serial ^ 0x5A5A5A5A, note)
    return b"".join([a[0], b[0], *a[1:2], *b[1:], *a[2:]])


def parse(media: bytes) -> dict[int, dict]:
    """Logical streams by serial: packets, last granule, page count, and for each page that ends packets (granule, how
    many, sequence number). Checksums, sequence and lacing are verified."""
    streams: dict[int, dict] = {}
    at = 0
    while at < len(media):
        if at + HEAD_SIZE > len(media):
            raise OggError("truncated page header")
        magic, version, flags, granule, serial, sequence, crc, n = struct.unpack_from(HEAD, media, at)
        lacing = media[at + HEAD_SIZE : at + HEAD_SIZE + n]
        begin = at + HEAD_SIZE + n
        end = begin + sum(lacing)
        if magic != b"OggS" or version != 0 or len(lacing) < n or end > len(media):
            raise OggError("broken page")
        if page_checksum(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != crc:
            raise OggError("wrong page checksum")
        if bool(flags & 2) == (serial in streams):
            raise OggError("stream begins twice or not at all")
        s = streams.setdefault(serial, {"packets": [], "open": None, "granule": 0, "pages": 0, "times": [], "ended": False})
        if sequence != s["pages"] or s["ended"] or bool(flags & 1) != (s["open"] is not None):
            raise OggError("page out of order")
        held = [s["open"]] if s["open"] is not None else []
        s["open"] = None
        run, before = 0, len(s["packets"])
        for value in lacing:
            run += value
            if value < 255:
                s["packets"].append(b"".join([*held, media[begin : begin + run]]))
                begin, run, held = begin + run, 0, []
        if run or (lacing and lacing[-1] == 255):
            s["open"] = b"".join([*held, media[begin : begin + run]])
        if granule != -1:
            if granule < s["granule"]:
                raise OggError("granule position goes back")
            s["granule"] = granule
            s["times"].append((granule, len(s["packets"]) - before, sequence))
        s["pages"] += 1
        s["ended"] = bool(flags & 4)
        at = end
    if any(s["open"] is not None or not s["ended"] for s in streams.values()):
        raise OggError("stream not ended")
    return streams


def packet_ends(stream: dict) -> list[int]:
    """The granule at which each packet of 8-bit samples ends: the last of a page at the page's, those before it by the
    lengths of the packets between. A stream's first packet is its header."""
    ends, at = [], 0
    for granule, n, _ in stream["times"]:
        own = stream["packets"][at : at + n]
        after = [0, *np.cumsum([len(p) for p in own[:0:-1]]).tolist()][::-1]
        ends += [granule - a for a in after[:n]]
        at += n
    return ends[1:]


def listed(streams: dict[int, dict]) -> list[dict]:
    """Each logical stream: its serial, the first bytes of its header, and counts."""
    return [{"serial": k, "kind": s["packets"][0][:8].decode("latin-1") if s["packets"] else "", "pages": s["pages"], "packets": len(s["packets"]), "granule": s["granule"]} for k, s in sorted(streams.items())]


def page_times(streams: dict[int, dict], rate: int) -> list[dict]:
    """When the pages that end packets begin and end, in milliseconds."""
    out = []
    for k, s in sorted(streams.items()):
        begin = 0
        for granule, n, sequence in s["times"]:
            out.append({"serial": k, "sequence": sequence, "packets": n, "start_ms": begin * 1000 // rate, "end_ms": granule * 1000 // rate})
            begin = granule
    return out


def decode(media: bytes, streams: dict[int, dict] | None = None) -> dict:
    """What ``encode`` stored: payload, true length, timestamps in milliseconds and counts."""
    sound = note = None
    streams = streams or parse(media)
    for s in streams.values():
        kind = s["packets"][0][:4] if s["packets"] else b""
        sound, note = (s, note) if kind == b"PCM8" else (sound, s) if kind == b"NOTE" else (sound, note)
    if sound is None or note is None:
        raise OggError("a logical stream is missing")
    rate, _, size = struct.unpack("<IBQ", sound["packets"][0][4:17])
    payload = b"".join(sound["packets"][1:])
    if len(payload) != size or sound["granule"] != size:
        raise OggError("payload and granule position differ")
    return {"payload": payload, "n_bytes": struct.unpack("<Q", note["packets"][0][4:12])[0], "pages": sum(s["pages"] for s in streams.values()), "packets": sum(len(s["packets"]) for s in streams.values()), "streams": len(streams), "ms": sound["granule"] * 1000 // rate, "page_times": page_times(streams, rate), "packet_end_ms": [g * 1000 // rate for g in packet_ends(sound)]}


def feature(x: dict) -> str:
    """Container counts, duration, and mean, deviation and level crossings of the samples."""
    v = np.frombuffer(x["payload"], np.uint8)
    level = v >= 96
    return f"streams={x['streams']};pages={x['pages']};packets={x['packets']};ms={x['ms']};mean={v.mean():.4f};sd={v.std():.4f};crossings={int((level[1:] != level[:-1]).sum())}"


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE) -> DataFrame:
    """(doc_id, media binary) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encode(t, rate) for t in binaries(b.column(1))], pa.binary())], ["doc_id", "media"])

    from pyspark.sql import functions as F

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, media binary")


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_ms long, valid boolean, error string"
#: Further columns: the logical streams, the times of pages and of sample packets.
TIMES = "streams array<struct<serial:long,kind:string,pages:long,packets:long,granule:long>>, page_times array<struct<serial:long,sequence:long,packets:long,start_ms:long,end_ms:long>>, packet_end_ms array<long>"
_STRUCTS = [pa.list_(pa.struct([(n, pa.string() if n == "kind" else pa.int64()) for n in names])) for names in (("serial", "kind", "pages", "packets", "granule"), ("serial", "sequence", "packets", "start_ms", "end_ms"))]


def read_media(media: DataFrame) -> DataFrame:
    """Verify and read a column from ``to_media``; a damaged row has ``valid`` false and its error."""
    names = [x.split()[0] for x in f"{READ}, {TIMES}".split(", ")]

    def row(doc_id: int | None, m: bytes | None) -> tuple:
        if m is None:
            return (doc_id, *[None] * 13)
        own = (len(m), hashlib.sha256(m).hexdigest())
        try:
            streams = parse(m)
            found = listed(streams)
            if not {"PCM8", "NOTE"} & {s["kind"][:4] for s in found}:
                return (doc_id, None, None, None, None, *own, None, None, True, None, found, None, None)
            x = decode(m, streams)
        except (OggError, struct.error) as e:
            return (doc_id, None, None, None, None, *own, None, None, False, str(e), None, None, None)
        p = x["payload"]
        return (doc_id, x["n_bytes"], len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-BLOCK:]), *own, feature(x), x["ms"], True, None, found, x["page_times"], x["packet_end_ms"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string(), *_STRUCTS, pa.list_(pa.int64())]
        for b in batches:
            rows = list(map(row, b.column(0).to_pylist(), b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(len(names))], names)

    return map_batches(media.select("doc_id", "media"), run, f"{READ}, {TIMES}")
