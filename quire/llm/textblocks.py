"""Vectorised views of Arrow text batches: bytes, words and word hashes.

A word is a maximal run of bytes other than space and ``\\t \\n \\v \\f \\r``
(``[^\\x20\\x09-\\x0D]+``); UTF-8 keeps those six bytes out of every multi-byte
character, so words are found on bytes. Null texts count as empty. All work is
numpy over one block of a few MB, so memory is bounded by the block (or by the
single text that exceeds it), never by a partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20  # an 8-byte array over a block's bytes is 8 MB

_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SOLID = np.zeros(256, bool)  # ASCII letters and all bytes beyond ASCII
_SOLID[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32  # A-Z only


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)  # the lowest k bytes


@dataclass
class Block:
    """Some texts of a batch. ``bounds``: n + 1 byte offsets into ``data``."""

    first: int  # row of the batch that text 0 is
    data: np.ndarray
    bounds: np.ndarray

    @property
    def n(self) -> int:
        return len(self.bounds) - 1

    def row_of(self, at: np.ndarray) -> np.ndarray:
        """The text that holds each byte position (positions ascending or not)."""
        return np.searchsorted(self.bounds, at, side="right") - 1

    def text(self, start: int, end: int) -> str:
        return self.data[start:end].tobytes().decode("utf-8", "replace")

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # n + 1 word offsets by text
    hashes: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES, rows: int = 1 << 16) -> Iterator[Block]:
    """Cut a string column into blocks of about ``limit`` bytes and at most ``rows``
    texts (one text at least)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    sizes = np.diff(off)
    if texts.null_count:
        sizes = np.where(np.asarray(texts.is_valid()), sizes, 0)
        if (np.diff(off) != sizes).any():  # a null slot may own bytes
            texts = texts.fill_null("")
            yield from blocks(texts, limit, rows)
            return
    at = 0
    while at < n:
        end = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1), at + rows)
        yield Block(at, raw[off[at] : off[end]], off[at : end + 1] - off[at])
        at = end


def words(block: Block, hashed: bool = True, lower: bool = True) -> Words:
    """The words of a block; ``hashes``: 64 bits of each word's bytes
    (A-Z lowered first when ``lower``)."""
    data, bounds = block.data, block.bounds
    blank = _IS_BLANK[data]
    begins = ~blank
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = True
        before[1:] = blank[:-1]
        inner = bounds[:-1][bounds[:-1] < len(data)]
        before[inner] = True
        starts = np.flatnonzero(begins & before)
        after = np.empty(len(data), bool)
        after[-1] = True
        after[:-1] = blank[1:]
        last = bounds[1:]
        after[last[last > 0] - 1] = True
        ends = np.flatnonzero(begins & after) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    per = np.searchsorted(starts, bounds)
    out = Words(starts, ends, per)
    if hashed:
        out.hashes = hash_spans(_LOWER[data] if lower else data, starts, ends)
    return out


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes at a step."""
    sizes = ends - starts
    out = mix64(sizes.astype(np.uint64))
    if len(starts) == 0:
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))  # the 8 bytes from each place on
    live, done = np.arange(len(starts)), 0
    while len(live):
        left = sizes[live] - done
        part = eight[np.minimum(starts[live] + done, len(data))] & _KEEP[np.clip(left, 0, 8)]
        out[live] = mix64(out[live] ^ part)
        live = live[left > 8]
        done += 8
    return out


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def letter_ends(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the closing run of ASCII non-letters of each word begins, if it follows
    a letter of ASCII or Latin-1; else the word's end."""
    solid = np.where(_SOLID[data], np.arange(len(data)), -1)
    last = np.maximum.accumulate(solid)[ends - 1]
    inside = last >= starts
    byte = data[np.maximum(last, 0)]
    latin = (last > starts) & (data[np.maximum(last - 1, 0)] == 0xC3) & (byte != 0x97) & (byte != 0xB7)
    return np.where(inside & ((byte < 0x80) | latin), last + 1, ends)


def grams(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows that stay inside one text, and the index of
    the word each starts at."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        value = mix64(value ^ hashes[j : n - k + 1 + j])
    end = np.repeat(bounds[1:], np.diff(bounds))[: n - k + 1]
    at = np.flatnonzero(np.arange(n - k + 1) + k <= end)
    return value[at], at


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated index ranges ``starts[i] .. starts[i] + sizes[i]``."""
    total = int(sizes.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    first = np.zeros(len(sizes), np.int64)
    np.cumsum(sizes[:-1], out=first[1:])
    return np.arange(total) + np.repeat(starts - first, sizes)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of a sorted stream: the values of its first ``keys`` columns and the
    rows that share them (a group may span batches)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        change = np.zeros(batch.num_rows, bool)
        for c in batch.columns[:keys]:
            code = np.asarray(c.dictionary_encode().indices.fill_null(-1))
            change[1:] |= code[1:] != code[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = tuple(c[a].as_py() for c in batch.columns[:keys])
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)
