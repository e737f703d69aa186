"""Vectorised text helpers for the Arrow operators of this subpackage.

Words are ``[^\\x20\\x09-\\x0D]+`` over the UTF-8 bytes of a text.  A word's hash is a multilinear
64-bit hash (one fixed odd random weight per byte position, words over 64 bytes through xxh3), so
all words of an Arrow batch are hashed in a few numpy passes without a Python object per word.
Batches are worked on in slices of a few MB, which bounds the memory of a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20
_LONG = 64
_RNG = np.random.default_rng(20240607)
_WEIGHT = _RNG.integers(0, 2**63, _LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POSITION_WEIGHT = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches the high bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The column's texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first, end, texts) of runs of a batch's texts that hold about ``limit`` bytes; a longer text is a
    run of its own.  Only one run at a time is turned into Python objects."""
    sizes = pc.fill_null(pc.binary_length(column.cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
    first = size = 0
    for i, n in enumerate(sizes.tolist()):
        if size and size + n > limit:
            yield first, i, text_bytes(column.slice(first, i - first))
            first, size = i, 0
        size += n
    if first < len(column):
        yield first, len(column), text_bytes(column.slice(first))
    pa.default_memory_pool().release_unused()  # workers stay alive between tasks: what they keep adds up


class Words:
    """Words of some texts: hashes, byte spans in ``buf`` and, per text, first word (``first[i]:first[i+1]``).

    ``buf`` holds the texts with one line feed behind each, so every word is followed by white space."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        raw = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
        self.buf = _LOWER[raw] if lower else raw
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        space = _SPACE[self.buf]
        before = np.empty_like(space)
        if len(space):
            before[0] = True
            before[1:] = space[:-1]
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(space & ~before)
        self.first = np.searchsorted(self.start, self.at)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), dtype=np.uint64)
        size = self.end - self.start
        lo = 0
        while lo < len(out):  # in pieces, for one very long text
            hi = max(lo + 1, int(np.searchsorted(self.start, self.start[lo] + SLICE_BYTES)))
            a, b = int(self.start[lo]), int(self.end[hi - 1])
            piece = self.buf[a:b].astype(np.uint64) + np.uint64(1)
            piece[_SPACE[self.buf[a:b]]] = 0
            begin = self.start[lo:hi] - a
            gap = np.diff(np.append(begin, b - a))
            place = np.arange(b - a) - np.repeat(begin, gap)
            np.minimum(place, _LONG - 1, out=place)
            piece *= _WEIGHT[place]
            out[lo:hi] = np.add.reduceat(piece, begin)
            lo = hi
        out = mix(out + size.astype(np.uint64))
        for i in np.flatnonzero(size > _LONG):
            out[i] = xxhash.xxh3_64_intdigest(self.buf[self.start[i]:self.end[i]].tobytes())
        return out

    def text_of_word(self) -> np.ndarray:
        """Index of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def place(self) -> np.ndarray:
        """Index of each word in its text."""
        return np.arange(len(self.hash)) - np.repeat(self.first[:-1], np.diff(self.first))

    def kept_texts(self, keep: np.ndarray) -> list[str]:
        """Each text's kept words, joined by one space."""
        step = np.zeros(len(self.buf) + 1, dtype=np.int8)
        step[self.start[keep]] += 1
        step[self.end[keep] + 1] -= 1
        mask = np.cumsum(step[:-1], dtype=np.int8) > 0
        out = np.where(_SPACE[self.buf], np.uint8(0x20), self.buf)[mask].tobytes()
        cut = np.concatenate([[0], np.cumsum(mask)])[self.at]
        return [out[a:max(a, b - 1)].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:])]


def windows(h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` word hashes that begin at each index of ``at``."""
    out = np.zeros(len(at), dtype=np.uint64)
    for j in range(length):
        out += h[at + j] * POSITION_WEIGHT[j]
    return mix(out)


def binary(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def joined(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Packed arrays of a binary column behind each other, and each one's length."""
    parts = [np.frombuffer(x, dtype=dtype) for x in column.to_pylist()]
    return (np.concatenate(parts) if parts else np.empty(0, dtype)), np.array([len(x) for x in parts], dtype=np.int64)


def by_bucket(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings the hashes of a bucket together, and the bounds of the buckets in it."""
    b = (mix(h ^ np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    return order, np.searchsorted(b[order], np.arange(buckets + 1))
