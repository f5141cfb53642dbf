"""Substring dedup by content-defined chunking with a gear rolling hash.

A chunk ends where the gear hash of the last 16 bytes has four given bits 0, or
after 128 bytes, so chunks depend on nearby content and an insertion shifts no
chunk beyond the next cut.  What is looked up is the digest of two neighbouring
chunks (some ten words, so that common phrases don't meet by chance).  For every
digest the corpus's smallest document id that has it is found, and where; in any
other document the two chunks are a repeat.

Repeats that follow each other in a text and at their keeper are a run.  A run that
may be long enough is compared byte by byte with its keeper's text beyond both
ends, so a passage has its exact extent, in whole words: it is reported from
``PASSAGE`` words on.

Slices of the corpus ask buckets of digests, and then the slices of the keepers (see
``exchange``): bounded memory per task, one entry per slice for a passage however
often it occurs.

Defined cases: null and empty texts have no chunks.  Repeats inside one document
don't count.  Rows with a null id lose what any row with an id has, and keep what
only rows with null ids have.  Rows that repeat an id are one document.  Ids have
to be integers.  A passage with one chunk boundary or none, as in text of one short
word over and over whose 128-byte cuts fall differently, isn't seen.  Columns of
any other name go along in ``deduplicated``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, exchange
from .blocks import WHITE, Block, _powers_to, blocks, mix64
from .exchange import Arrays, Mail

PASSAGE = 50

#: Bytes compared beyond each end of a run; a passage ends within two chunks of its run.
LOOK = 512
WINDOW, CUT_BITS, LEAST_GAP, LONGEST = 16, np.uint32(0xF000), 8, 128
SLICE = 8 << 20

_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_NOBODY = np.iinfo(np.int64).max


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The sum over k < 16 of gear[byte k places back] << k, at every position."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def chunks(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ends, digests, words begun, text index) of all chunks of a block, in order."""
    data, n = block.data, len(block.data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    of = np.repeat(np.arange(len(block)), np.diff(block.offsets))
    cut = np.flatnonzero((gear_hash(data) & CUT_BITS) == 0)
    cut = cut[cut - block.offsets[of[cut]] >= WINDOW - 1]
    cut = cut[np.diff(cut, prepend=-LEAST_GAP) >= LEAST_GAP] + 1
    lasts = block.offsets[1:][np.diff(block.offsets) > 0]
    ends = np.union1d(cut, lasts)
    size = np.diff(ends, prepend=0)
    if (size > LONGEST).any():  # as in periodic text, whose hash never cuts
        more = (size - 1) // LONGEST
        k = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        ends = np.union1d(ends, np.repeat(ends - size, more) + k * LONGEST)
    starts = np.append(0, ends[:-1])
    place = np.arange(n) - np.repeat(starts, ends - starts)
    body = (data.astype(np.uint64) + np.uint64(1)) * _powers_to(int((ends - starts).max()))[place]
    digest = mix64(np.add.reduceat(body, starts) + (ends - starts).astype(np.uint64))
    white = WHITE[data]
    begin = ~white
    begin[1:] &= white[:-1]
    first = block.offsets[:-1][np.diff(block.offsets) > 0]
    begin[first] = ~white[first]
    return ends, digest, np.add.reduceat(begin.astype(np.int64), starts), of[starts]


def corpus_slices(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(slice, state, texts, chunks): chunks of all texts, and the texts themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for big in blocks(batch.column("text"), SLICE):
                part = batch.slice(big.first, len(big))
                keys, sizes, begun, owner = [], [], [], []
                for block in blocks(part.column("text")):
                    ends, digest, n_words, of = chunks(block)
                    if not len(ends):
                        continue
                    follower = np.append(digest[1:], np.uint64(0))
                    follower[np.append(of[1:] != of[:-1], True)] = 0
                    keys.append(mix64(digest * _PAIR + mix64(follower)))
                    sizes.append(np.diff(ends, prepend=0))
                    begun.append(n_words)
                    owner.append(of + block.first)
                key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
                of = np.concatenate(owner) if owner else np.zeros(0, np.int64)
                numbers = part.column("id").fill_null(_NOBODY).to_numpy()
                distinct, place = np.unique(key, return_inverse=True)
                order = np.lexsort((np.arange(len(key)), numbers[of], place))
                least = order[np.searchsorted(place[order], np.arange(len(distinct)))]
                most = np.full(len(distinct), np.iinfo(np.int64).min)
                np.maximum.at(most, place, numbers[of])
                state = {
                    "key": distinct,
                    "lowest": numbers[of][least],
                    "at": least.astype(np.uint32),
                    "many": (most != numbers[of][least]).astype(np.uint8),
                    "place": place.astype(np.uint32),
                    "size": (np.concatenate(sizes) if sizes else of).astype(np.uint32),
                    "words": (np.concatenate(begun) if begun else of).astype(np.uint32),
                    "of": np.diff(of, prepend=0).astype(np.uint32),
                    "id": numbers,
                    "length": np.diff(big.offsets).astype(np.uint64),
                }
                packed = zstandard.ZstdCompressor(level=1).compress(big.data.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([exchange.pack(state)], pa.binary()), pa.array([packed], pa.binary()), pa.array([len(key)])], ["state", "texts", "chunks"])

    rows = docs.select(common.integer_ids(docs, id_col).alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.transform(common.arrow(run, "state binary, texts binary, chunks bigint")).withColumn("slice", F.monotonically_increasing_id())


def _bucket_of(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)


def _ask(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Each slice's distinct digests, with the least id that has one and where, to the buckets of digests."""
    for batch in batches:
        for i in range(batch.num_rows):
            state = exchange.unpack(batch.column("state")[i].as_py())
            yield from exchange.mail(batch.column("slice")[i].as_py(), _bucket_of(state["key"], bits), {n: state[n] for n in ("key", "lowest", "at", "many")})


def _answer(bucket: int, found: Mail) -> Iterator[pa.RecordBatch]:
    """Who keeps each digest (id, slice, chunk) that two documents have; nobody for the others."""
    keys, entry = np.unique(exchange.joined(found, "key"), return_inverse=True)
    lowest, at = exchange.joined(found, "lowest"), exchange.joined(found, "at")
    slices = np.repeat([s for s, _ in found], [len(a["key"]) for _, a in found])
    order = np.lexsort((slices, lowest, entry))
    first = order[np.searchsorted(entry[order], np.arange(len(keys)))]
    many = np.zeros(len(keys), dtype=bool)
    many[entry[(exchange.joined(found, "many") > 0) | (lowest != lowest[first][entry])]] = True
    many = many[entry]
    keeper, of, chunk = (np.where(many, x[first][entry], none) for x, none in ((lowest, _NOBODY), (slices, 0), (at, 0)))
    cut = np.cumsum([0, *(len(a["key"]) for _, a in found)]).tolist()
    payloads = [exchange.pack({"keeper": keeper[low:high], "of": of[low:high], "at": chunk[low:high].astype(np.uint32)}) for low, high in zip(cut[:-1], cut[1:], strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int64()), pa.array([bucket] * len(found), pa.int64()), pa.array(payloads, pa.binary())], ["receiver", "sender", "payload"])


@dataclass
class Runs:
    """Runs of a slice: first and last chunk here, the keeper's id, slice and first chunk there."""

    first: np.ndarray
    last: np.ndarray
    keeper: np.ndarray
    slice: np.ndarray
    chunk: np.ndarray
    of: np.ndarray  # the slice's texts, by chunk
    begin: np.ndarray  # byte where a chunk begins

    @staticmethod
    def found(state: Arrays, answers: Mail) -> Runs:
        keeper, at_slice, at = (exchange.joined(answers, n)[state["place"]] if len(state["place"]) else np.zeros(0, np.int64) for n in ("keeper", "of", "at"))
        of = np.cumsum(state["of"].astype(np.int64))
        begin = np.append(0, np.cumsum(state["size"].astype(np.int64)))
        total = np.append(0, np.cumsum(state["words"].astype(np.int64)))
        repeated = keeper < state["id"][of] if len(of) else np.zeros(0, dtype=bool)
        edge = np.diff(of, prepend=-1) != 0
        ends = np.append(edge[1:], True)
        follows = np.zeros(len(of), dtype=bool)
        follows[1:] = repeated[1:] & repeated[:-1] & ~edge[1:]
        # A stretch of repeats, whoever keeps them, has to hold PASSAGE words with the two chunks around it.
        stretch = np.cumsum(repeated & ~follows) - 1
        low = np.flatnonzero(repeated & ~follows)
        high = np.flatnonzero(repeated & ~np.append(follows[1:], False))
        text_low = np.maximum.accumulate(np.where(edge, np.arange(len(of)), 0))
        text_high = np.minimum.accumulate(np.where(ends, np.arange(len(of)), len(of))[::-1])[::-1]
        outer = total[np.minimum(high + 3, text_high[high]) + 1] - total[np.maximum(low - 2, text_low[low])]
        long = np.zeros(len(of), dtype=bool)
        long[repeated] = (outer >= PASSAGE)[stretch[repeated]]
        same = follows.copy()
        same[1:] &= (keeper[1:] == keeper[:-1]) & (at_slice[1:] == at_slice[:-1]) & (at[1:].astype(np.int64) == at[:-1].astype(np.int64) + 1)
        first = np.flatnonzero(long & ~same)
        last = np.flatnonzero(long & ~np.append(same[1:], False))
        # The pair's second chunk belongs to the run, unless the pair is a text's last chunk alone.
        return Runs(first, np.where(ends[last], last, last + 1), keeper[first], at_slice[first], at[first].astype(np.int64), of, begin)


def _request(row: pa.Table, number: int, found: list[Mail]) -> Iterator[pa.RecordBatch]:
    """To the keepers' slices: which chunks' surroundings are wanted, each once."""
    runs = Runs.found(exchange.unpack(row.column("state")[0].as_py()), found[0])
    wanted = np.unique(np.stack([runs.slice, runs.chunk, runs.chunk + runs.last - runs.first]), axis=1)
    yield from exchange.mail(number, wanted[0], {"first": wanted[1].astype(np.uint32), "last": wanted[2].astype(np.uint32)})


def _texts(row: pa.Table) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(row.column("texts")[0].as_py()), dtype=np.uint8)


def _surroundings(row: pa.Table, number: int, found: list[Mail]) -> Iterator[pa.RecordBatch]:
    """Up to ``LOOK`` bytes before and after the chunks asked about, within their text."""
    if not found[0]:
        return
    state, data = exchange.unpack(row.column("state")[0].as_py()), _texts(row)
    of = np.cumsum(state["of"].astype(np.int64))
    begin = np.append(0, np.cumsum(state["size"].astype(np.int64)))
    edge = np.append(0, np.cumsum(state["length"].astype(np.int64)))
    for asker, asked in found[0]:
        first, last = asked["first"].astype(np.int64), asked["last"].astype(np.int64)
        low, high = begin[first], begin[last + 1]
        before, after = np.maximum(low - LOOK, edge[of[first]]), np.minimum(high + LOOK, edge[of[first] + 1])
        raw = [data[a:b] for pair in zip(zip(before, low, strict=True), zip(high, after, strict=True), strict=True) for a, b in pair]
        said = {"before": (low - before).astype(np.uint16), "after": (after - high).astype(np.uint16), "bytes": np.concatenate(raw) if raw else np.zeros(0, np.uint8)}
        yield pa.RecordBatch.from_arrays([pa.array([asker], pa.int64()), pa.array([number], pa.int64()), pa.array([exchange.pack(said)], pa.binary())], ["receiver", "sender", "payload"])


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many first bytes of ``a`` and ``b`` are equal."""
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    return int(differ.argmax()) if differ.any() else n


def _passages(row: pa.Table, number: int, found: list[Mail]) -> Iterator[tuple[int, bytes, list[tuple[int, int]], int, list[int]]]:
    """(text, its bytes, byte spans, words, keepers) of the texts of a slice that have repeated passages."""
    state = exchange.unpack(row.column("state")[0].as_py())
    runs = Runs.found(state, found[0])
    if not len(runs.first):
        return
    data = _texts(row)
    edge = np.append(0, np.cumsum(state["length"].astype(np.int64)))
    wanted, place = np.unique(np.stack([runs.slice, runs.chunk, runs.chunk + runs.last - runs.first]), axis=1, return_inverse=True)
    place = place.reshape(-1)
    sent = [(a["before"].astype(np.int64), a["after"].astype(np.int64), a["bytes"]) for _, a in found[1]]
    before, after = (np.concatenate([x[k] for x in sent]) for k in (0, 1))
    raw = np.concatenate([x[2] for x in sent])
    at = np.cumsum(before + after) - (before + after)
    white = WHITE[data]
    spans: dict[int, list[tuple[int, int]]] = {}
    keepers: dict[int, set[int]] = {}
    for k, p in enumerate(place.tolist()):
        text = int(runs.of[runs.first[k]])
        low, high = int(runs.begin[runs.first[k]]), int(runs.begin[runs.last[k] + 1])
        start, stop = int(edge[text]), int(edge[text + 1])
        there = raw[at[p] : at[p] + before[p] + after[p]]
        left, right = there[: before[p]][::-1], there[before[p] :]
        back, on = _equal(data[start:low][::-1][:LOOK], left), _equal(data[high:stop][:LOOK], right)
        low, high = low - back, high + on
        # A word that isn't whole here and there doesn't count.
        if (low > start and not white[low - 1]) or (back < len(left) and not WHITE[left[back]]):
            while low < high and not white[low]:
                low += 1
        if (high < stop and not white[high]) or (on < len(right) and not WHITE[right[on]]):
            while low < high and not white[high - 1]:
                high -= 1
        while low < high and white[low]:
            low += 1
        while low < high and white[high - 1]:
            high -= 1
        if _words(white[low:high]) >= PASSAGE:
            spans.setdefault(text, []).append((low - start, high - start))
            keepers.setdefault(text, set()).add(int(runs.keeper[k]))
    for text, own in sorted(spans.items()):
        merged: list[tuple[int, int]] = []
        for low, high in sorted(own):
            if merged and low <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], high))
            else:
                merged.append((low, high))
        start, stop = int(edge[text]), int(edge[text + 1])
        yield text, data[start:stop].tobytes(), merged, sum(_words(white[start + a : start + b]) for a, b in merged), sorted(keepers[text])


def _words(white: np.ndarray) -> int:
    """Words that begin in a stretch, given where white space is."""
    return int((~white[:1]).sum() + (white[:-1] & ~white[1:]).sum())


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each text with repeated passages.

    Columns: id, n_passages, repeated_words, kept_in (ids of the documents that
    keep the passages, sorted), spans (array of byte start and end) and
    text_sha256 (binary, of the whole text).
    """
    scratch = common.Scratch(docs.sparkSession)

    def run(row: pa.Table, number: int, found: list[Mail]) -> Iterator[pa.RecordBatch]:
        rows = list(_passages(row, number, found))
        if rows:
            numbers = exchange.unpack(row.column("state")[0].as_py())["id"]
            ids = [None if numbers[t] == _NOBODY else int(numbers[t]) for t, *_ in rows]
            spans = pa.array([[{"start": a, "end": b} for a, b in x] for _, _, x, _, _ in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(x) for _, _, x, _, _ in rows], pa.int64()), pa.array([n for *_, n, _ in rows], pa.int64()), pa.array([k for *_, k in rows], pa.list_(pa.int64())), spans, pa.array([hashlib.sha256(raw).digest() for _, raw, *_ in rows], pa.binary())],
                [id_col, "n_passages", "repeated_words", "kept_in", "spans", "text_sha256"],
            )

    try:
        slices, name = exchange.kept(corpus_slices(docs, id_col, text_col), "slice")
        scratch.tables.append(name)
        size = slices.agg(F.sum("chunks").alias("chunks")).first()
        bits = exchange.buckets_for(int(size["chunks"] or 0))
        asked = slices.select("slice", "state").transform(common.arrow(partial(_ask, bits=bits), exchange.MESSAGE))
        answers = scratch.written(exchange.gathered(asked, _answer, 1 << bits, exchange.MESSAGE))
        requests = scratch.written(exchange.toured(slices.select("slice", "state"), "slice", [answers], _request, exchange.MESSAGE))
        replies = scratch.written(exchange.toured(slices.select("slice", "state", "texts"), "slice", [requests], _surroundings, exchange.MESSAGE))
        schema = f"`{id_col}` bigint, n_passages bigint, repeated_words bigint, kept_in array<bigint>, spans array<struct<start:bigint,end:bigint>>, text_sha256 binary"
        return common.written(exchange.toured(slices.select("slice", "state", "texts"), "slice", [answers, replies], run, schema))
    finally:
        scratch.close()


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` with their columns, repeated passages cut out of the texts.

    Only texts that lose something are shuffled.
    """
    found = repeats(docs, id_col, text_col).toDF("id", "n_passages", "repeated_words", "kept_in", "spans", "sha")
    cuts = common.durable(found.groupBy("id", "sha").agg(F.first("spans").alias("spans")).withColumn("key", F.xxhash64("id", "sha")))
    raw = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    sha = F.unhex(F.sha2(raw, 256))
    told = common.KeySet(cuts, "key").marked(docs, F.xxhash64(common.integer_ids(docs, id_col), sha))
    raw = F.col(f"row.`{text_col}`").cast("binary")
    some = told.where("inside").select("row", F.col(f"row.`{id_col}`").cast("bigint").alias("id"), F.unhex(F.sha2(F.coalesce(raw, F.lit(b"")), 256)).alias("sha")).withColumn("hash", F.xxhash64("id", "sha"))
    joined = common.salted_left_join(some, cuts.select(F.col("key").alias("hash"), "spans"), "hash")
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(b"").alias("out"))

    def cut(done, span):
        piece = F.substring(raw, (done["at"] + 1).cast("int"), (span["start"] - done["at"]).cast("int"))
        return F.struct(span["end"].alias("at"), F.concat(done["out"], piece).alias("out"))

    left = F.aggregate("spans", begin, cut, lambda done: F.concat(done["out"], F.substring(raw, (done["at"] + 1).cast("int"), F.length(raw))))
    text = F.when(F.col("spans").isNull(), F.col(f"row.`{text_col}`")).otherwise(F.decode(left, "UTF-8"))
    changed = joined.withColumn("row", F.col("row").withField(f"`{text_col}`", text))
    return told.where("NOT inside").select("row.*").unionAll(changed.select("row.*"))
