"""Encoding texts chunk by chunk, each distinct chunk once.

Tokenizers that never merge across the start of a run of blanks give the same
ids for a text as for its chunks one after the other. Chunks get 128-bit keys
all at once with numpy, are looked up in a bounded cache, and only the new ones
go to the tokenizer.

A key of up to 15 bytes is those bytes and their number, so equal keys mean
equal chunks. Longer chunks are known by 120 bits of their BLAKE2 digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are looked up at once; bounds the memory of the tables below.
PIECE = 1 << 21
#: Bytes of a key that are text.
EXACT = 15
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_LONG = np.uint64(0xFF << 56)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    x = x.astype(np.uint64)
    for shift, k in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(k)
    return x ^ (x >> np.uint64(31))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit keys of byte spans, as two 64-bit numbers each."""
    size = ends - starts
    padded = np.concatenate([data, np.zeros(2 * EXACT + 2, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    low = eight[starts] & _MASKS[np.minimum(size, 8)]
    high = (eight[starts + 8] & _MASKS[np.clip(size - 8, 0, EXACT - 8)]) | (np.minimum(size, EXACT).astype(np.uint64) << np.uint64(56))
    long = np.flatnonzero(size > EXACT)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True))
        found = np.frombuffer(digests, "<u8").reshape(-1, 2)
        low[long], high[long] = found[:, 0], found[:, 1] | _LONG
    return low, high


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans."""
    low, high = span_keys(data, starts, ends)
    return _mixed(_mixed(low) + high)


def distinct_keys(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first of each distinct key, number of each key's own)."""
    _, first, back = np.unique(_mixed(low) + high, return_index=True, return_inverse=True)
    if ((low[first][back] != low) | (high[first][back] != high)).any():  # two keys of one sum
        keys = np.empty(len(low), [("low", np.uint64), ("high", np.uint64)])
        keys["low"], keys["high"] = low, high
        _, first, back = np.unique(keys, return_index=True, return_inverse=True)
    return first, back


def by_bytes(column: pa.Array, most: int, rows: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of runs of texts that hold ``most`` bytes together, or one longer text alone."""
    sizes = np.nan_to_num(np.asarray(pc.binary_length(column).to_numpy(zero_copy_only=False), float)).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = int(ends[at] - sizes[at])
        to = min(max(at + 1, int(np.searchsorted(ends, before + most, side="right"))), at + rows)
        yield at, to - at
        at = to


#: Places of the cache's table and how many of them a key may take.
TABLE_BITS, PROBES = 21, 4


class ChunkCache:
    """ids of chunks. ``encode`` maps a list of byte strings to (all ids, number of ids of each).

    The table is three flat arrays with a few probes per key; where all are taken
    an older entry is overwritten and, if met again, encoded again. So memory is
    bounded by the table and ``limit``, at which everything is forgotten.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = 1_000_000):
        self.encode_new, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.low, self.high, self.slot = np.zeros(1 << TABLE_BITS, np.uint64), np.zeros(1 << TABLE_BITS, np.uint64), np.zeros(1 << TABLE_BITS, np.int32)
        self.pool, self.size, self.count = np.zeros(1 << 20, np.int32), 0, 0
        self.start, self.length = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)

    @staticmethod
    def _place(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        x = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Number of each key's entry, -1 where there is none. No key has a high part of 0."""
        at = self._place(low, high)
        same = (self.low[at] == low) & (self.high[at] == high)
        found = np.where(same, self.slot[at], -1).astype(np.int64)
        rest = np.flatnonzero(~same)
        for probe in range(1, PROBES):
            if not len(rest):
                break
            there = (at[rest] + probe) & ((1 << TABLE_BITS) - 1)
            same = (self.low[there] == low[rest]) & (self.high[there] == high[rest])
            found[rest[same]] = self.slot[there[same]]
            rest = rest[~same & (self.high[there] != 0)]
        return found

    def _insert(self, low: np.ndarray, high: np.ndarray, slots: np.ndarray) -> None:
        for probe in [*range(PROBES), None]:
            at = (self._place(low, high) + (probe or 0)) & ((1 << TABLE_BITS) - 1)
            free = np.flatnonzero(self.high[at] == 0) if probe is not None else np.arange(len(at))
            _, first = np.unique(at[free], return_index=True)
            take = free[first]
            self.low[at[take]], self.high[at[take]], self.slot[at[take]] = low[take], high[take], slots[take]
            left = np.ones(len(low), bool)
            left[take] = False
            low, high, slots = low[left], high[left], slots[left]

    def _add(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Numbers of new entries with these ids."""
        while self.count + len(n) > len(self.start):
            self.start, self.length = np.append(self.start, self.start), np.append(self.length, self.length)
        if self.size + len(ids) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros(max(len(ids), len(self.pool)), np.int32))
        new = np.arange(self.count, self.count + len(n))
        self.start[new], self.length[new] = self.size + np.cumsum(n) - n, n
        self.pool[self.size : self.size + len(ids)] = ids
        self.size, self.count = self.size + len(ids), self.count + len(n)
        return new

    def __call__(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks one after the other, number of ids of each chunk)."""
        ends = np.append(starts[1:], len(data))
        ids, counts, i = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, side="right")))
            got, n = self._piece(data[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i])
            ids.append(got)
            counts.append(n)
            i = j
        return (ids[1], counts[1]) if len(ids) == 2 else (np.concatenate(ids), np.concatenate(counts))

    def _piece(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.count > self.limit or self.size > 16 * self.limit:
            self.clear()
        low, high = span_keys(data, starts, ends)
        at = self._find(low, high)
        lost = np.flatnonzero(at < 0)
        if len(lost):
            first, back = distinct_keys(low[lost], high[lost])
            where = lost[first]
            raw = memoryview(np.ascontiguousarray(data))
            new = self._add(*self.encode_new([bytes(raw[a:b]) for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]))
            self._insert(low[where], high[where], new.astype(np.int32))
            at[lost] = new[back]
        n = self.length[at].astype(np.int64)
        return self.pool[ragged(self.start[at].astype(np.int64), n)], n
