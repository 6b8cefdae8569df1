"""Hashed text features in numpy: words and subwords of a batch of texts, all positions at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: ASCII letters, digits and all bytes of non-ASCII characters belong to words.
_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
PREFIXES = (3, 4, 5, 6)
FEATURES = len(PREFIXES) + 1


def chunks(texts: list[str | None], size: int = 1_000_000) -> Iterator[list[str]]:
    """Lists of whole texts of about ``size`` characters; null is empty."""
    held, n = [], 0
    for t in texts:
        held.append(t or "")
        n += len(held[-1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def word_features(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features (words x FEATURES: prefixes of 3 to 6 bytes, the whole word) of lower-cased words, and the
    number of words of each text."""
    raw = [t.lower().encode() for t in texts]
    buf = np.frombuffer(b"\0".join(raw) + bytes(9), np.uint8)
    edge = np.diff(_WORD[buf].astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    stop = np.cumsum([len(r) + 1 for r in raw])
    n_words = np.diff(np.searchsorted(start, stop), prepend=0)
    size = end - start
    eight = lambda at: np.lib.stride_tricks.sliding_window_view(buf, 8)[at].copy().view(np.uint64)[:, 0]
    keep = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    head = eight(start) & keep[np.minimum(size, 8)]
    tail = eight(np.maximum(end - 8, start)) & keep[np.minimum(size, 8)]
    out = np.empty((len(start), FEATURES), np.int32)
    shift = np.uint64(64 - bits)
    for k, p in enumerate(PREFIXES):
        out[:, k] = (((head & keep[p]) + np.uint64(k)) * _MIX[k]) >> shift
    out[:, -1] = ((head * _MIX[4]) ^ (tail * _MIX[5]) ^ (size.astype(np.uint64) * _MIX[0])) * _MIX[1] >> shift
    return out, n_words


def gram_features(texts: list[str], bits: int, orders: tuple[int, ...] = (1, 2, 3, 4)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, hashed byte n-grams at every position of the lower-cased texts (all that parts words is one
    blank), and where each text begins. Every text is padded by blanks, so that none is without n-grams and none reaches
    into the next."""
    raw = [b" " + t.lower().encode() + b"   " for t in texts]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    buf = np.where(_WORD[buf], buf, np.uint8(32)).astype(np.uint32)
    size = np.array([len(r) - 3 for r in raw], np.int64)
    begin = np.cumsum(size) - size
    at = np.arange(size.sum()) + np.repeat(3 * np.arange(len(raw)), size)  # not from the last three blanks
    code = np.zeros(len(at), np.uint32)
    for k in range(max(orders)):
        code = code | (buf[at + k] << np.uint32(8 * k))
        if k + 1 in orders:
            yield ((code * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15 * (k + 1) & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits), begin
