"""Words, lines and shingles of Arrow text columns as numpy arrays.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. These bytes are never
part of a longer UTF-8 character, so all work is done on bytes, a chunk of whole rows at
a time. A key of a span of bytes is made of its length and of the values of its
polynomial at two bases modulo the prime 2**31 - 1, spread over 64 bits. Two different
spans of up to n bytes that were not chosen with the bases in mind have the same key with
a probability of about 2**-62, and of (n / 2**31)**2 at most.

Memory is about 60 bytes for each byte of a chunk, and a chunk is one row where a row is
longer than CHUNK bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
PRIME, BITS = np.uint64(2**31 - 1), np.uint64(31)
BASES = (1103515245, 1566083941)
STEPS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values, one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x & PRIME) + (x >> BITS)
    x = (x & PRIME) + (x >> BITS)
    return np.where(x >= PRIME, x - PRIME, x)


def powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0..n-1 modulo PRIME."""
    run = _powers.get(base, np.ones(1, dtype=np.uint64))
    while len(run) < n:
        run = np.concatenate([run, reduced(run * np.uint64(pow(base, len(run), int(PRIME))))])
    _powers[base] = run
    return run[:n]


@dataclass
class Chunk:
    """Whole rows of a text column: their bytes, and words in order with the row of each."""

    first: int
    rows: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    sums: tuple[np.ndarray, ...]

    def keys(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A key for the bytes of each span."""
        out = np.zeros(len(starts), dtype=np.uint64)
        for base, sums in zip(BASES, self.sums, strict=True):
            down = powers(pow(base, -1, int(PRIME)), len(self.data) + 1)
            out = (out << np.uint64(32)) | reduced(reduced(sums[ends] - sums[starts]) * down[starts])
        return mix(out + (ends - starts).astype(np.uint64) * STEPS[4])

    def word_keys(self) -> np.ndarray:
        return self.keys(self.starts, self.ends)

    def per_row(self, rows: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """How many of the given rows' marks, or the sum of their weights, each row has."""
        out = np.bincount(rows, weights, self.rows)
        return out if weights is not None else out.astype(np.int64)


def chunks(column: pa.Array, lower: bool = False, size: int = CHUNK) -> Iterator[Chunk]:
    """The rows of a text column in chunks of about size bytes; null is empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1)
        yield _chunk(raw[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], first, lower)
        first = last


def _chunk(data: np.ndarray, offsets: np.ndarray, first: int, lower: bool) -> Chunk:
    n = len(data)
    data = LOWER[data] if lower else data
    inside = ~SEPARATOR[data]
    heads = offsets[:-1][offsets[:-1] < n]
    breaks = np.ones(n + 1, dtype=bool)  # whether a word ends before this byte
    breaks[1:n] = ~inside[:-1]
    breaks[heads] = True
    starts = np.flatnonzero(inside & breaks[:n])
    ends = np.flatnonzero(inside & (breaks[1:] | np.append(~inside[1:], True)[:n])) + 1
    sums = tuple(_summed(data, powers(base, n + 1)) for base in BASES)
    row = np.searchsorted(offsets, starts, "right") - 1
    return Chunk(first, len(offsets) - 1, data, offsets, starts, ends, row, sums)


def _summed(data: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Sums of the bytes, each plus 1, times powers, before each place. They fit in 64 bits: a text has fewer than 2**31 bytes."""
    terms = up[: len(data)] * (data + np.uint64(1))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(terms if len(data) < 1 << 24 else reduced(terms), out=out[1:])
    return out


def runs(keys: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each n consecutive words of one row, and the position of their first word."""
    if len(keys) < n:
        return keys[:0], np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
    out = keys[at] * STEPS[0]
    for i in range(1, n):
        out += keys[at + i] * STEPS[i % 5] * np.uint64(2 * (i // 5) + 1)
    return mix(out), at


def repeated(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more in their row, and which have occurred before in it."""
    own = keys ^ mix(row.astype(np.uint64) + STEPS[2])
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    many, later = np.zeros(len(own), dtype=bool), np.zeros(len(own), dtype=bool)
    many[order[1:][same]] = True
    many[order[:-1][same]] = True
    later[order[1:][same]] = True
    return many, later


def passed(batch: pa.RecordBatch, names: list[str], more: dict[str, pa.Array]) -> pa.RecordBatch:
    """The named columns of a batch and further ones."""
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *more.values()], [*names, *more])


class Tally:
    """Counts of keys within a task: add() gives what no longer fits, rest() what is left. Memory is bounded by limit."""

    def __init__(self, limit: int = 1 << 20):
        self.limit, self.parts, self.size = limit, [], 0

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([np.zeros(0, np.int64), *(k for k, _ in self.parts)])
        n = np.concatenate([np.zeros(0, np.int64), *(n for _, n in self.parts)])
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.add.reduceat(n, first) if len(first) else n

    def add(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        part = np.unique(keys, return_counts=True)
        self.parts.append(part)
        self.size += len(part[0])
        if self.size > self.limit:
            keys, n = self._merged()
            self.parts, self.size = [(keys, n)], len(keys)
            if self.size > self.limit * 3 // 4:
                yield from self.rest()

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        keys, n = self._merged()
        self.parts, self.size = [], 0
        if len(keys):
            yield keys, n


class Index:
    """The places of keys, found by the keys' upper bits. Keys are spread evenly, as those above are; order tells where each sorted key was."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys.view(np.uint64))
        self.keys = keys[self.order]
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        heads = (self.keys.view(np.uint64) >> self.shift).astype(np.int64)
        self.first = np.searchsorted(heads, np.arange((1 << bits) + 1))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key among the sorted ones, or -1."""
        head = (keys.view(np.uint64) >> self.shift).astype(np.int64)
        at, end = self.first[head], self.first[head + 1]
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            hit = self.keys[here] == keys[left]
            out[left[hit]] = here[hit]
            left = left[~hit & (here + 1 < end[left])]
            at[left] += 1
        return out
