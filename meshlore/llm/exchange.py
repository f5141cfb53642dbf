"""Packed questions and answers between slices of a corpus and buckets of hashed keys.

A slice asks about its distinct 64-bit keys and sends a few numbers with each; all
entries of a key meet in one bucket, where a function sees them together and answers
each entry.  The answers come back in the order of the entries.  What travels are
compressed arrays: one message for each slice and bucket that share keys, so never
more messages than entries.  With slices and buckets of fixed size messages get
smaller as the corpus grows; from some hundred TB on they hold few entries each, and
traffic nears that of a plain shuffle of the entries.

Keys are uniform hashes, and a slice has each of its keys once, so buckets are
even however often a key occurs in the corpus.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from . import common

#: Entries that a bucket has about.
BUCKET_ENTRIES = 1_000_000

Arrays = dict[str, np.ndarray]

#: Unsigned arrays that ascend, wholly or in runs (differences wrap around).
SORTED = {"key", "word", "context", "of_word", "of_context", "entry", "asked"}

#: A packed message; ``receiver`` and ``sender`` number slices or buckets.
MESSAGE = "receiver bigint, sender bigint, payload binary"

#: What arrived for one receiver: senders, ascending, with their arrays.
Mail = list[tuple[int, Arrays]]


def buckets_for(entries: int) -> int:
    """A power of two (the exponent) so that buckets have about ``BUCKET_ENTRIES``."""
    return max(0, int(entries // BUCKET_ENTRIES).bit_length())


def pack(arrays: Arrays) -> bytes:
    """Arrays as compressed byte planes; those named in ``SORTED`` as differences."""
    parts = []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        if name in SORTED and len(a):
            a = np.concatenate([a[:1], a[1:] - a[:-1]])
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""
        head = f"{name}:{a.dtype.str}:{len(a)}".encode()
        parts.append(len(head).to_bytes(2, "little") + head + planes)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(raw: bytes) -> Arrays:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    out, at = {}, 0
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 2], "little")
        name, kind, n = raw[at + 2 : at + 2 + size].decode().split(":")
        at += 2 + size
        dtype = np.dtype(kind)
        length = int(n) * dtype.itemsize
        planes = np.frombuffer(raw, dtype=np.uint8, count=length, offset=at).reshape(dtype.itemsize, int(n))
        a = np.ascontiguousarray(planes.T).reshape(-1).view(dtype)
        out[name] = np.cumsum(a, dtype=dtype) if name in SORTED else a
        at += length
    return out


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows of a sorted stream, those of a key together."""
    held: list[dict] = []
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
            if held and held[0][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def mail(sender: int, to: np.ndarray, arrays: Arrays) -> Iterator[pa.RecordBatch]:
    """Messages (see ``MESSAGE``): the entries of ``arrays`` cut where ``to``, which ascends, changes."""
    if len(to):
        cut = np.append(np.flatnonzero(np.diff(to.astype(np.int64), prepend=-1)), len(to))
        payloads = [pack({n: a[low:high] for n, a in arrays.items()}) for low, high in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(to[cut[:-1]].astype(np.int64)), pa.array([sender] * len(payloads), pa.int64()), pa.array(payloads, pa.binary())], ["receiver", "sender", "payload"])


def joined(found: Mail, name: str) -> np.ndarray:
    """An array of all senders, one after another."""
    return np.concatenate([a[name] for _, a in found])


def gathered(asked: DataFrame, visitor: Callable[[int, Mail], Iterator[pa.RecordBatch]], parts: int, schema: str) -> DataFrame:
    """What ``visitor`` makes of all messages of a receiver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "receiver"):
            found = [(r["sender"], unpack(r["payload"])) for r in rows]
            number = rows[0]["receiver"]
            rows.clear()
            yield from visitor(number, found)

    return asked.repartition(max(1, parts), "receiver").sortWithinPartitions("receiver", "sender").transform(common.arrow(run, schema))


def kept(table: DataFrame, key: str, parts: int | None = None) -> tuple[DataFrame, str]:
    """``table`` stored in the shared folder, bucketed by ``key`` so that visits don't shuffle it; and its name, for ``dropped``."""
    spark = table.sparkSession
    name = f"meshlore_kept_{uuid.uuid4().hex}"
    parts = max(parts or 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table.write.format("parquet").option("path", f"{common.checkpoint_dir(spark)}/{name}").bucketBy(parts, key).saveAsTable(name)
    return spark.table(name), name


def toured(table: DataFrame, key: str, mails: list[DataFrame], visitor: Callable[[pa.Table, int, list[Mail]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``visitor`` makes of each row of ``table`` (as a table of one row), its number ``key`` and its messages, one list for each of ``mails``."""
    if not mails:

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield from visitor(pa.Table.from_batches([batch.slice(i, 1)]), batch.column(key)[i].as_py(), [])

        return table.transform(common.arrow(alone, schema))
    rows = None
    for k, messages in enumerate(mails):
        part = messages.select(F.col("receiver").alias(key), F.lit(k).alias("kind"), "sender", "payload")
        rows = part if rows is None else rows.unionAll(part)
    kinds = len(mails)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kind, sender = right.column("kind").to_numpy(), right.column("sender").to_numpy()
        payloads = right.column("payload")
        found: list[Mail] = [[] for _ in range(kinds)]
        for i in np.lexsort((sender, kind)).tolist():
            found[kind[i]].append((int(sender[i]), unpack(payloads[i].as_py())))
        out = [b for i in range(left.num_rows) for b in visitor(left.slice(i, 1), left.column(key)[i].as_py(), found)]
        found.clear()
        common.release_memory()
        return pa.Table.from_batches(out, empty) if out else empty.empty_table()

    empty = to_arrow_schema(_parse_datatype_string(schema))
    return table.groupBy(key).cogroup(rows.groupBy(key)).applyInArrow(run, schema)
