"""Token ids in training order: a keyed permutation of all sequences, in shards of fixed stride.

1. Documents are tokenised once; the ids, with an end id after each document, are
   written to a table in the shared folder, together with each row's place among
   the rows of its task.  One number per task (its tokens) comes to the driver.
2. The stream of all tokens in table order is cut into sequences of ``length``
   ids; the last is filled up with the end id.  Sequence s goes to the global
   slot that a keyed Feistel network over the next even power of two gives it,
   walking the cycle until the slot is below the number of sequences.
3. Sequences are dealt to their range of slots, sorted and written: shard k holds
   the slots from k * per_shard on.  A record is the ids as little-endian unsigned
   16-bit integers and one byte 0x0A, so slot j of a shard begins at j * stride and
   reading on from any slot is a seek.  Shards are written by Spark's committer: a
   lost task leaves no part of a shard.

A manifest beside the shards holds tokens, length, records per shard, key and a
digest of the stream, so a reader needs the folder only.  ``write`` puts it there
first.  In a folder that has one it goes on where the last run stopped: shards that
are whole stay, shards of a wrong size are removed and written again; a folder of
another stream or key is refused.  The stream follows the order of the table as it
was read when ``token_table`` was written, so keep that table for a restart.

Defined cases: a null text counts as empty and gives the end id alone.  The strings of
special tokens are ordinary text.  An empty table gives no shard and no rows.
Rows that repeat are tokenised as often as they occur.  Other columns are not read.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .blocks import blocks, mix64

LENGTH = 2048

#: Records of a shard, unless that makes more than ``MOST_SHARDS`` shards.
PER_SHARD, MOST_SHARDS = 4096, 1 << 16
MANIFEST = "_manifest.json"
KEY = 20240229
END_ID = 50256
ROUNDS = 4

_encodings: dict = {}


def encoding(path: str):
    """The tiktoken encoding of a ranks file, read once by each worker."""
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


@dataclass(frozen=True)
class Feistel:
    """A keyed permutation of the integers from 0 to ``n`` - 1."""

    n: int
    key: int = KEY

    @property
    def half(self) -> int:
        return max(1, -(-max(1, self.n - 1).bit_length() // 2))

    def _round(self, r: int, x: np.ndarray) -> np.ndarray:
        return mix64(x + mix64(np.array([self.key * ROUNDS + r], dtype=np.uint64))) & np.uint64((1 << self.half) - 1)

    def _walk(self, x: np.ndarray, once) -> np.ndarray:
        x = once(x.astype(np.uint64))
        while (beyond := x >= np.uint64(self.n)).any():
            x[beyond] = once(x[beyond])
        return x.astype(np.int64)

    def slot(self, sequence: np.ndarray) -> np.ndarray:
        h, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)

        def once(x: np.ndarray) -> np.ndarray:
            left, right = x >> h, x & mask
            for r in range(ROUNDS):
                left, right = right, left ^ self._round(r, right)
            return left << h | right

        return self._walk(sequence, once)

    def sequence(self, slot: np.ndarray) -> np.ndarray:
        h, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)

        def once(x: np.ndarray) -> np.ndarray:
            left, right = x >> h, x & mask
            for r in reversed(range(ROUNDS)):
                left, right = right ^ self._round(r, left), left
            return left << h | right

        return self._walk(slot, once)


def token_table(docs: DataFrame, path: str, text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(part, row, start, n, ids): the token stream; ``start`` counts tokens before it in its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        pack = zstandard.ZstdCompressor(level=9).compress
        row = start = 0
        for batch in batches:
            texts = batch.column(text_col)
            for block in blocks(texts, 4 << 20):
                ids: list[int] = []
                for text in texts.slice(block.first, len(block)).to_pylist():
                    ids += encode(text or "")
                    ids.append(end_id)
                yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([start]), pa.array([len(ids)]), pa.array([pack(np.array(ids, dtype="<u2").tobytes())])], ["row", "start", "n", "ids"])
                row, start = row + 1, start + len(ids)

    coded = docs.select(text_col).transform(common.arrow(run, "row bigint, start bigint, n bigint, ids binary"))
    return common.written(coded.withColumn("part", F.spark_partition_id()))


@dataclass(frozen=True)
class Plan:
    """Where every sequence goes."""

    tokens: int
    length: int
    per_shard: int
    key: int
    digest: str = ""

    @property
    def sequences(self) -> int:
        return -(-self.tokens // self.length)

    @property
    def shards(self) -> int:
        return -(-self.sequences // self.per_shard)

    @property
    def stride(self) -> int:
        return 2 * self.length + 1

    def records(self, shard: int) -> int:
        return min(self.per_shard, self.sequences - shard * self.per_shard)


def _place(spark: SparkSession, path: str):
    """A path and the file system it is on."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> Plan | None:
    """The plan by which a folder of shards was begun; none if it has none."""
    place, files = _place(spark, f"{path}/{MANIFEST}")
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return Plan(**json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def _begin(spark: SparkSession, path: str, plan: Plan) -> None:
    known = manifest(spark, path)
    if known is None:
        place, files = _place(spark, path)
        if files.exists(place) and len(files.listStatus(place)):
            raise ValueError(f"{path} has files but no {MANIFEST}")
        place, files = _place(spark, f"{path}/{MANIFEST}")
        stream = files.create(place, True)
        stream.write(bytearray(json.dumps(asdict(plan)).encode()))
        stream.close()
    elif known != plan:
        raise ValueError(f"{path} holds shards of another stream or order: {known}, not {plan}")


def _finished(spark: SparkSession, path: str, plan: Plan) -> list[int]:
    """Shards of a folder that are whole already; files that are not, or too many, are removed."""
    place, files = _place(spark, path)
    if not any(x.getPath().getName().startswith("part-") for x in files.listStatus(place)):
        return []
    found: dict[int, list] = {}
    for r in files_of(spark, path).select("shard", "length", "path").collect():
        found.setdefault(r["shard"], []).append(r)
    done = []
    for shard, own in found.items():
        if len(own) == 1 and 0 <= shard < plan.shards and own[0]["length"] == plan.stride * plan.records(shard):
            done.append(shard)
        else:
            for r in own:
                files.delete(spark._jvm.org.apache.hadoop.fs.Path(r["path"]), False)
    return sorted(done)


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """(shard, path, length, content) of each shard's file."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"part-(\d+)-", 1).cast("int").alias("shard"), "path", "length", "content")


def write(table: DataFrame, path: str, length: int = LENGTH, per_shard: int | None = None, key: int = KEY, end_id: int = END_ID) -> Plan:
    """Write the shards of a token table to the folder ``path``, those still missing."""
    spark = table.sparkSession
    totals = table.groupBy("part").agg(F.sum("n").alias("n"), F.sum(F.xxhash64("part", "row", "start", "n", "ids").cast("decimal(38,0)")).alias("h")).orderBy("part").collect()  # one row per task that wrote
    base, tokens = {}, 0
    for r in totals:
        base[r["part"]] = tokens
        tokens += r["n"]
    if per_shard is None:
        per_shard = max(PER_SHARD, -(-tokens // (length * MOST_SHARDS)))
    plan = Plan(tokens, length, per_shard, key, f"{sum(int(r['h']) for r in totals) % (1 << 64):016x}")
    _begin(spark, path, plan)
    if not tokens:
        return plan
    done = set(_finished(spark, path, plan))
    if len(done) == plan.shards:
        return plan
    bases, finished = spark.sparkContext.broadcast(base), spark.sparkContext.broadcast(done)
    order = Feistel(plan.sequences, key)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part, start, n, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "start", "n", "ids")), strict=True):
                begin = bases.value[part] + start
                raw = unpack(ids)
                sequence = np.arange(begin // length, (begin + n - 1) // length + 1)
                low = np.maximum(sequence * length, begin) - begin
                high = np.minimum((sequence + 1) * length, begin + n) - begin
                slot = order.slot(sequence)
                shard = slot // per_shard
                own = [i for i, s in enumerate(shard.tolist()) if s not in finished.value]
                pieces = [pack(raw[2 * low[i] : 2 * high[i]]) for i in own]
                offset = (low + begin) % length
                yield pa.RecordBatch.from_arrays([pa.array(shard[own].astype(np.int32)), pa.array(slot[own]), pa.array(offset[own].astype(np.int32)), pa.array(pieces, pa.binary())], ["shard", "slot", "offset", "piece"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        end = np.array([end_id], dtype="<u2").tobytes()
        held, held_slot = b"", None
        for batch in batches:
            records = []
            for slot, piece in zip(batch.column("slot").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                if slot != held_slot and held_slot is not None:
                    records.append(held + end * (length - len(held) // 2))
                    held = b""
                held, held_slot = held + unpack(piece), slot
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["record"])
        if held_slot is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held + end * (length - len(held) // 2)], pa.binary())], ["record"])

    pieces = table.select("part", "start", "n", "ids").transform(common.arrow(cut, "shard int, slot bigint, offset int, piece binary"))
    records = pieces.repartitionById(plan.shards, F.col("shard")).sortWithinPartitions("slot", "offset").select("slot", "piece").transform(common.arrow(join, "record binary"))
    records.select(F.col("record").cast("string")).write.mode("append").option("lineSep", "\n").option("compression", "none").text(path)
    return plan


def records(spark: SparkSession, path: str, plan: Plan | None = None) -> DataFrame:
    """(shard, slot, byte_offset, ids) of every record, read back from the shards; the plan is that of the manifest."""
    plan = plan or manifest(spark, path)
    if plan is None:
        raise ValueError(f"{path} has no {MANIFEST}")
    if not plan.tokens:
        return spark.createDataFrame([], "shard int, slot bigint, byte_offset bigint, ids binary")
    stride, per_shard = plan.stride, plan.per_shard

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                view = memoryview(content.as_buffer())
                at = np.arange(0, len(view), stride)
                ids = pa.array([bytes(view[j : j + stride - 1]) for j in at.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(at), pa.int32()), pa.array(shard * per_shard + at // stride), pa.array(at), ids], ["shard", "slot", "byte_offset", "ids"])

    return files_of(spark, path).where("length > 0").select("shard", "content").transform(common.arrow(cut, "shard int, slot bigint, byte_offset bigint, ids binary"))
