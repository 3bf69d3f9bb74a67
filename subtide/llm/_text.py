"""Whole-batch text primitives over Arrow string buffers (numpy, no per-word Python).

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. Every function
takes whole texts; a null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts worked on at a time; a task holds some tens of times as much in arrays.
SLICE_BYTES = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads a 64-bit value over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_SEEDS = mix(np.arange(1, 513, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE = _SEEDS[:256] | np.uint64(1)
_PLACE = _SEEDS[256:] | np.uint64(1)
#: Bases of two independent hashes.
_R = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The first n powers; those that a common slice needs are kept, longer ones are made anew."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base & 0xFFFFFFFFFFFFFFFF, np.uint64)
        p[0] = 1
        have = np.multiply.accumulate(p)
        if n <= SLICE_BYTES + 1:
            _powers[base] = have
    return have[:n]


@dataclass
class Texts:
    """Consecutive texts in one byte buffer; ``off[i]:off[i + 1]`` is text i."""

    buf: np.ndarray
    off: np.ndarray

    def __len__(self) -> int:
        return len(self.off) - 1


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # index of each text's first word, and the total at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def texts_of(col: pa.Array | pa.ChunkedArray) -> Texts:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if len(col) == 0:
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(buf[off[0] : off[-1]], off - off[0])


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Cut a batch into runs of rows whose texts have about ``most`` bytes together."""
    whole = texts_of(batch.column(column))
    at, n = 0, len(whole)
    while at < n:
        to = max(at + 1, int(np.searchsorted(whole.off, whole.off[at] + most, "right")) - 1)
        to = min(to, n)
        off = whole.off[at : to + 1]
        yield batch.slice(at, to - at), Texts(whole.buf[off[0] : off[-1]], off - off[0])
        at = to


def runs_of(mask: np.ndarray, off: np.ndarray) -> Words:
    """Maximal true runs that do not cross a text's bounds."""
    n = len(mask)
    if n == 0:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64))
    before = np.zeros(n, bool)
    before[1:] = mask[:-1]
    before[off[:-1][off[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = mask[1:]
    cut = off[:-1][off[:-1] > 0] - 1
    after[cut] = False
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, off))


def words_of(t: Texts) -> Words:
    return runs_of(~IS_SPACE[t.buf], t.off)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span, independent of where the span stands; ``which`` of two."""
    acc = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_BYTE[buf] ^ np.uint64(which << 40)) * _power(_R[which], len(buf)), out=acc[1:])
    back = _power(pow(_R[which], -1, 1 << 64), len(buf) + 1)
    return mix((acc[ends] - acc[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(h: np.ndarray, m: int) -> np.ndarray:
    """Hash of ``h[i : i + m]`` for each i with so many values left."""
    n = max(0, len(h) - m + 1)
    out = np.zeros(n, np.uint64)
    for j in range(m):
        out += h[j : j + n] * _PLACE[j]
    return mix(out)


def full_windows(w: Words, m: int) -> np.ndarray:
    """Whether the m words from each word on belong to one text (over ``len - m + 1`` starts)."""
    n = max(0, len(w.starts) - m + 1)
    last = np.repeat(w.first[1:], w.counts)[:n]
    return np.arange(n) + m <= last


def per_text_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    acc = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=acc[1:])
    return acc[first[1:]] - acc[first[:-1]]


def joined_words(buf: np.ndarray, w: Words, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The kept words of each text, one space between them: (all texts' bytes, bounds of each text)."""
    at = np.flatnonzero(keep)
    size = w.ends[at] - w.starts[at] + 1  # with a space after each
    upto = np.concatenate([[0], np.cumsum(size)])
    # of each text, the space after its last word is left out
    n_before = np.concatenate([[0], np.cumsum(keep)])[w.first]
    some = np.diff(n_before) > 0
    take = np.repeat(w.starts[at] - upto[:-1], size) + np.arange(upto[-1])
    ends = upto[1:] - 1
    out = np.where(np.isin(np.arange(upto[-1]), ends, assume_unique=True), np.uint8(32), buf[np.minimum(take, len(buf) - 1)]) if len(at) else np.zeros(0, np.uint8)
    last = upto[n_before[1:]][some] - 1
    out = np.delete(out, last)
    bounds = upto[n_before] - np.concatenate([[0], np.cumsum(some)])
    return out.tobytes(), bounds
