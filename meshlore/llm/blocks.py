"""Vectorised text access for the Arrow-batched operators.

An Arrow string column is one byte buffer with offsets.  The helpers here cut a
column into slices of bounded size and find words, word hashes and shingle
hashes for a whole slice with numpy, so that no operator loops over words in
Python.  A single text larger than the slice bound forms a slice of its own:
texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once by one worker (a longer text is a slice alone).
SLICE_BYTES = 1 << 18

#: The white space of the contracts: space and the bytes 0x09 to 0x0D.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

#: Lower-cases the letters A to Z and leaves all other bytes alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(256, 1 << (n - 1).bit_length())
        table = np.full(size, _BASE, dtype=np.uint64)
        table[0] = 1
        _powers = np.multiply.accumulate(table)
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Block:
    """Texts of one slice: bytes, and where each text begins and ends."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


@dataclass
class Words:
    """Words of a block in order: byte spans, hashes, and each text's first word."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def doc(self) -> np.ndarray:
        """For each word the index of its text in the block."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def blocks(column: pa.Array | pa.ChunkedArray, slice_bytes: int = SLICE_BYTES) -> Iterator[Block]:
    """Slices of a string column, in order; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + slice_bytes, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield Block(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def words(block: Block, lower: bool = True) -> Words:
    """Every maximal run of bytes outside ``WHITE``; a word never crosses texts."""
    data = LOWER[block.data] if lower else block.data
    n = len(data)
    inside = ~WHITE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    edges = block.offsets[:-1]
    edges = edges[edges < n]
    begin[edges] = inside[edges]
    last = block.offsets[1:] - 1
    last = last[last >= 0]
    stop[last] = inside[last]
    start = np.flatnonzero(begin)
    end = np.flatnonzero(stop) + 1
    lengths = end - start
    if len(start):
        body = data[inside].astype(np.uint64)
        body += np.uint64(1)
        at = np.cumsum(lengths) - lengths
        place = np.arange(len(body)) - np.repeat(at, lengths)
        body *= _powers_to(int(lengths.max()))[place]
        hashed = mix64(np.add.reduceat(body, at))
    else:
        hashed = np.zeros(0, np.uint64)
    return Words(start, end, hashed, np.searchsorted(start, block.offsets))


def windows(found: Words, coefficients: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``len(coefficients)`` words inside one text.

    A window's hash is the mixed sum of word hash times coefficient; a
    coefficient 0 ignores its position.  Returns the hashes and the index of
    each window's first word.
    """
    k = len(coefficients)
    total = len(found.hash)
    if total < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(total - k + 1, dtype=np.uint64)
    for place, c in enumerate(coefficients):
        if c:
            out += found.hash[place : total - k + 1 + place] * np.uint64(c)
    ends = np.repeat(found.first[1:], np.diff(found.first))[: total - k + 1]
    whole = np.flatnonzero(np.arange(total - k + 1) + k <= ends)
    return mix64(out[whole]), whole


def shingle_coefficients(k: int) -> np.ndarray:
    """Odd multipliers for ordered windows of ``k`` words."""
    return mix64(np.arange(1, k + 1, dtype=np.uint64) * _BASE) | np.uint64(1)


def shingles(found: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word shingles, and for each its text's index, in order.

    A text of fewer than ``k`` words (and one at least) has one shingle, all its words.
    """
    hashed, at = windows(found, shingle_coefficients(k))
    doc = np.searchsorted(found.first, at, side="right") - 1
    n = np.diff(found.first)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        own = sequence_digests(found)[0][short]
        order = np.argsort(np.concatenate([doc, short]), kind="stable")
        return np.concatenate([hashed, own])[order], np.concatenate([doc, short])[order]
    return hashed, doc


def sequence_digests(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's sequence of words (0 for a text without words)."""
    n = np.diff(found.first)
    some = np.flatnonzero(n)
    out = np.zeros((2, len(n)), dtype=np.uint64)
    if len(some):
        place = np.arange(len(found.hash)) - np.repeat(found.first[:-1], n)
        power = _powers_to(int(n.max()))[place]
        out[0, some] = mix64(np.add.reduceat(found.hash * power, found.first[some]))
        out[1, some] = mix64(np.add.reduceat(mix64(found.hash ^ np.uint64(0x5851F42D4C957F2D)) * power, found.first[some]))
    return out[0], out[1]
