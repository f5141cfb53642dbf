"""Benchmark decontamination with spaced seeds.

A spaced seed is a fixed mask over consecutive words; its hash ignores the
positions marked 0, so a replaced word at such a position doesn't hide an
overlap.  The hashes of all windows of the benchmark and of the documents are
joined; each hit gives a diagonal (document position less benchmark position)
along which the words are compared.  The best stretch of a diagonal, a match
counting 1 and a difference -1, is the overlap.  It counts as contamination from
``LEAST_WORDS`` matching words on, or from the share ``LEAST_SHARE`` of a shorter
item on.

Words are maximal runs outside space and 0x09 to 0x0D, A-Z lower-cased.  The
benchmark is handed to the workers in blocks of at most ``BLOCK_WORDS`` words:
one block if it is small, and else one pass over the documents for each block,
so what is broadcast has a fixed bound.

Repeated words make many hits.  Of hits that follow each other on a diagonal only
the first counts, found for each distinct pair of neighbouring windows; diagonals
are compared in blocks of ``CELLS`` words, and a pair of text and item is done when
a diagonal has the whole item.

Defined cases: null and empty texts overlap with nothing, items without words
neither.  Items too short for a seed are searched by all their words, and have to
be there whole if they have fewer than ``SHORT`` words.  Items with a null id are
searched and reported with a null item_id.  Repeated rows of either table are rows
of their own.  Of equal overlaps of a pair the one first in the text is reported.
Columns of ``docs`` of any name are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .blocks import Words, blocks, shingle_coefficients, windows, words

#: The masks.  They tolerate a replaced word in every fifth, fourth and third place.
MASKS = ("1101111011", "101110111", "11011011")

SHORT = 5
CELLS = 1 << 20
LEAST_WORDS = 13
LEAST_SHARE = 0.8
BLOCK_WORDS = 1_000_000

_FILTER_BITS = 22


def _seeds() -> list[np.ndarray]:
    out = []
    for mask in MASKS:
        c = shingle_coefficients(len(mask)) * np.uint64(len(mask) * 2 + 1)
        out.append(np.where(np.frombuffer(mask.encode(), np.uint8) == ord("1"), c, np.uint64(0)))
    return out


@dataclass
class Index:
    """Seed hashes of a block of benchmark items, sorted, with where they stand."""

    seeds: list[np.ndarray]
    hash: np.ndarray
    at: np.ndarray
    maybe: np.ndarray
    words: np.ndarray
    item: np.ndarray
    first: np.ndarray
    ids: list

    @classmethod
    def build(cls, rows: list[tuple]) -> Index:
        found = [words(b) for b in blocks(pa.array([t for _, t in rows], pa.large_string()), 1 << 40)]
        hashed, first = found[0].hash, found[0].first
        n = np.diff(first)
        short = sorted({int(x) for x in n if 0 < x < max(map(len, MASKS))})
        seeds = _seeds() + [shingle_coefficients(k) * np.uint64(2 * k + 1001) for k in short]
        item = np.repeat(np.arange(len(rows)), n)
        hashes, places = [], []
        for k, seed in enumerate(seeds):
            h, at = windows(found[0], seed)
            own = n[item[at]] == len(seed) if k >= len(MASKS) else np.ones(len(at), dtype=bool)
            hashes.append(h[own])
            places.append(at[own])
        h, at = np.concatenate(hashes), np.concatenate(places)
        order = np.lexsort((at, h))
        h, at = h[order], at[order]
        maybe = np.zeros(1 << _FILTER_BITS, dtype=bool)
        maybe[h >> np.uint64(64 - _FILTER_BITS)] = True
        return cls(seeds, h, at, maybe, hashed, item, first, [i for i, _ in rows])

    def _hits(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows of a text and places of the benchmark with equal hashes, the first of each run along a diagonal.

        ``h`` and ``at`` are the hashes and first words of windows, in order.
        """
        near = self.maybe[h >> np.uint64(64 - _FILTER_BITS)]
        low, high = np.searchsorted(self.hash, h[near], "left"), np.searchsorted(self.hash, h[near], "right")
        some = high > low
        at, low, high = at[near][some], low[some], high[some]
        follows = np.zeros(len(at), dtype=bool)
        follows[1:] = at[1:] == at[:-1] + 1
        before = np.where(follows, np.append(0, low[:-1]), -1)
        # What begins at a window depends on it and the one before: one search for each distinct pair.
        pair, first, of = np.unique(np.stack([before, low]), axis=1, return_index=True, return_inverse=True)
        begun = []
        for k, i in enumerate(first.tolist()):
            places = self.at[low[i] : high[i]]
            if pair[0, k] >= 0:
                goes_on = np.isin(places - 1, self.at[low[i - 1] : high[i - 1]], assume_unique=True)
                places = places[~goes_on | (places == self.first[self.item[places]])]
            begun.append(places)
        n = np.array([len(x) for x in begun], dtype=np.int64)
        start = np.cumsum(n) - n
        every = np.concatenate(begun) if begun else np.zeros(0, np.int64)
        many = n[of]
        at = np.repeat(at, many)
        return at, every[np.repeat(start[of], many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)]

    def overlaps(self, found: Words) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, words compared, words equal): the best of each pair."""
        if not len(self.hash):
            return []
        diagonals = []
        doc_of = found.doc()
        for seed in self.seeds:
            at, place = self._hits(*windows(found, seed))
            if len(at):
                item = self.item[place]
                diagonals.append(np.unique(np.stack([doc_of[at], item, at - (place - self.first[item])], axis=1), axis=0))
        if not diagonals:
            return []
        every = np.unique(np.concatenate(diagonals), axis=0)
        cuts = np.flatnonzero((np.diff(every[:, :2], axis=0) != 0).any(axis=1)) + 1
        out = []
        for part in np.split(every, cuts):
            best = self._best(found, int(part[0, 0]), int(part[0, 1]), part[:, 2])
            if best:
                out.append((int(part[0, 0]), int(part[0, 1]), *best))
        return out

    def _best(self, found: Words, d: int, i: int, starts: np.ndarray) -> tuple[int, int, int] | None:
        """(first word, words compared, words equal) of the best stretch on the diagonals of a text and an item."""
        item = self.words[self.first[i] : self.first[i + 1]]
        n, low, high = len(item), int(found.first[d]), int(found.first[d + 1])
        need, best = min(LEAST_WORDS, n, max(SHORT, int(np.ceil(LEAST_SHARE * n)))), None
        step = max(1, CELLS // n)
        for k in range(0, len(starts), step):
            own = starts[k : k + step]
            at = own[:, None] + np.arange(n)
            inside = (at >= low) & (at < high)
            equal = inside & (found.hash[np.clip(at, low, high - 1)] == item)
            run = np.zeros((len(own), n + 1), dtype=np.int32)
            np.cumsum(np.where(equal, 1, np.where(inside, -1, 0)), axis=1, out=run[:, 1:])
            gain = run - np.minimum.accumulate(run, axis=1)
            end = gain.argmax(axis=1)
            rows = np.arange(len(own))
            # The last least value before the end.
            lowest = run[rows, end] - gain[rows, end]
            begin = np.where((run == lowest[:, None]) & (np.arange(n + 1) <= end[:, None]), np.arange(n + 1), -1).max(axis=1)
            matched = np.append(np.zeros((len(own), 1), np.int32), np.cumsum(equal, axis=1, dtype=np.int32), axis=1)
            count = matched[rows, end] - matched[rows, begin]
            top = int(count.argmax())
            if count[top] >= need and (best is None or count[top] > best[2]):
                best = (int(own[top] + begin[top]) - low, int(end[top] - begin[top]), int(count[top]))
                if count[top] == n:
                    break
        return best


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[Index]:
    """The benchmark in blocks of about ``block_words`` words."""
    items = benchmark.select(F.col(id_col).cast("bigint").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = max(1, -(-int(total) // (2 * block_words)))  # a word and a space are two characters at least
    for k in range(parts):
        part = items if parts == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
        rows = sorted(((r["i"], r["t"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if rows:
            yield Index.build(rows)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that overlap.

    Columns: doc_id, item_id, first_word (in the document), words_compared,
    words_equal and item_words.
    """
    spark = docs.sparkSession
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("item_id", T.LongType())] + [T.StructField(c, T.LongType()) for c in ("first_word", "words_compared", "words_equal", "item_words")])
    out = None
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                for block in blocks(batch.column(text_col)):
                    hits = own.overlaps(words(block))
                    if hits:
                        d, i, start, compared, equal = (list(x) for x in zip(*hits, strict=True))
                        ids = batch.column(id_col).take(pa.array([block.first + x for x in d]))
                        items = [own.ids[x] for x in i]
                        n = [int(own.first[x + 1] - own.first[x]) for x in i]
                        yield pa.RecordBatch.from_arrays([ids] + [pa.array(x, pa.int64()) for x in (items, start, compared, equal, n)], schema.names)

        part = docs.select(id_col, text_col).transform(common.arrow(run, schema))
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that overlap with no benchmark item, all columns kept."""
    for index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for block in blocks(batch.column(text_col)):
                    for hit in own.overlaps(words(block)):
                        keep[block.first + hit[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.transform(common.arrow(run, docs.schema))
    return docs
