"""Vectorised words and rolling hashes over Arrow text columns.

Texts are handled as UTF-8 bytes in pieces of bounded size; no loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at once (one longer document is handled alone).
PIECE_BYTES = 1 << 19
_U = np.uint64
_WORD_BASE, _SEQ_BASE = _U(0x9E3779B97F4A7C15 | 5), _U(0xD6E8FEB86659FD93 | 3)
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: What map stages keep in a worker between tasks, such as the pieces of words met before.
HELD: dict[str, object] = {}


def held(key: str, make):
    """The worker's own object of that key; there is one at a time, so that stages of one job don't pile up."""
    if key not in HELD:
        HELD.clear()
        _POWERS.clear()
        HELD[key] = make()
    return HELD[key]


def _lut(sep: Iterator[int]) -> np.ndarray:
    word = np.ones(256, bool)
    word[list(sep)] = False
    return word


#: Bytes of words that end at ASCII white space.
SPACED = _lut([0x20, *range(0x09, 0x0E)])
#: Bytes of words of ASCII letters and digits and of everything beyond ASCII.
ALNUM = _lut([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near values become unrelated ones."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n or more."""
    key = int(base)
    if key not in _POWERS or len(_POWERS[key][0]) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        inverse = _U(pow(key, -1, 1 << 64))
        both = []
        for b in (base, inverse):
            out = np.empty(size, np.uint64)
            out[0] = 1
            have = 1
            with np.errstate(over="ignore"):
                while have < size:
                    out[have : 2 * have] = out[:have] * _U(pow(int(b), have, 1 << 64))
                    have *= 2
            both.append(out)
        _POWERS[key] = (both[0], both[1])
    up, down = _POWERS[key]
    return up[:n], down[:n]


@dataclass
class Piece:
    """Some documents of a batch: rows lo..hi, their bytes, and their words as byte ranges."""

    lo: int
    hi: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # index of each document's first word; one more entry at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        up, down = _powers(_WORD_BASE, len(self.data) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTES[self.data] * up[:-1], out=total[1:])
            return mix((total[self.ends] - total[self.starts]) * down[self.starts])

    def doc_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), self.counts)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1 + column.offset)[column.offset :].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def spans(offsets: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges that hold up to ``limit`` bytes (PIECE_BYTES if none is given), or one row."""
    limit = limit or PIECE_BYTES
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi


def pieces(column: pa.Array, word: np.ndarray, lower: bool) -> Iterator[Piece]:
    HELD.clear()  # a stage over words has no use for what others keep
    raw, offsets = text_buffers(column)
    for lo, hi in spans(offsets):
        edge = offsets[lo : hi + 1] - offsets[lo]
        data = raw[offsets[lo] : offsets[hi]]
        if lower:
            data = _LOWER[data]
        inside = word[data]
        before = np.empty(len(data) + 1, bool)  # is the byte before a word byte of the same document?
        before[0] = False
        before[1:] = inside
        cuts = edge[:-1]
        after = before[1:].copy()  # copy of inside, to be shifted left
        starts_at = before[:-1]
        starts_at = starts_at.copy()
        starts_at[cuts[cuts < len(data)]] = False
        starts = np.flatnonzero(inside & ~starts_at)
        after[:-1] = inside[1:]
        if len(data):
            after[-1] = False
        last = edge[1:] - 1
        after[last[(last >= 0)]] = False
        ends = np.flatnonzero(inside & ~after) + 1
        yield Piece(lo, hi, data, starts, ends, np.searchsorted(starts, edge))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive words, by prefix sums; entry i starts at word i."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(_SEQ_BASE, len(hashes) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[:-1], out=total[1:])
        return mix((total[width:] - total[:-width]) * down[:n])


def inside_docs(first: np.ndarray, width: int) -> np.ndarray:
    """Starts of windows that do not cross a document's end."""
    total = int(first[-1])
    ok = np.ones(max(0, total - width + 1), bool)
    for k in range(1, width):  # the last width-1 starts of each document
        at = first[1:] - k
        at = at[(at >= 0) & (at < len(ok))]
        ok[at] = False
    return ok


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
