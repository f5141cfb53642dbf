"""What the operators share: durable intermediates, salted joins, bounded samples."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Salts over which the rows of one key are dealt in a salted join.
SALTS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set a temporary one on a single machine, and else one in the warehouse."""
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if not known:
        known = spark.conf.get("spark.checkpoint.dir", None)
        if not known:
            alone = context.master.startswith("local") and not context.master.startswith("local-cluster")
            known = tempfile.mkdtemp(prefix="meshlore-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/_meshlore"
        context.setCheckpointDir(known)
    return known


def integer_ids(docs: DataFrame, id_col: str) -> Column:
    """The id as a bigint; ids of another type are refused, as a cast would lose them."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{id_col} has to be an integer, not {kind.simpleString()}")
    return F.col(f"`{id_col}`").cast("bigint")


def release_memory() -> None:
    """Hand back to the system what the allocators hold of freed memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> Callable[[DataFrame], DataFrame]:
    """For ``DataFrame.transform``: ``mapInArrow``, with memory handed back after each task.

    Workers live on between tasks and share an executor's memory with the JVM.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            release_memory()

    return lambda df: df.mapInArrow(run, schema)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def salted_left_join(left: DataFrame, right: DataFrame, key: str, salts: int = SALTS) -> DataFrame:
    """Left join on ``key`` where one key may hold a large share of ``left``.

    ``right`` has at most one row per key.  Rows of ``left`` are dealt over
    ``salts`` parts by their position, ``right`` is repeated once per part.
    """
    salt = "__salt"
    dealt = left.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    spread = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(spread, [key, salt], "left").drop(salt)


def crc_mod(column: Column, mod: int) -> Column:
    """crc32 of the value as text, modulo ``mod``; a null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


#: Longer texts aren't taken into a sample that models are fitted on, so a sample is bounded in bytes.
SAMPLE_CHARS = 1 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, folds: int = 5) -> list[tuple[int, str, int]]:
    """Up to ``bound`` labelled rows of the training folds, half of each class.

    Rows of fold 0 (crc32 of the id as text modulo ``folds``) are never taken.
    Of each class the rows with the smallest hash of their id are taken, so the
    sample does not depend on partitioning.  Only the ids are broadcast, and
    there are at most ``bound`` of them; of rows that repeat an id one is taken,
    texts that repeat count once, and texts beyond ``SAMPLE_CHARS`` not at all.
    Returns (doc_id, text, label) sorted by hash.
    """
    ranked = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("__y"))
        .where(F.col("__y").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), folds) != 0))
        .groupBy("doc_id")
        .agg(F.max("__y").alias("__y"))
        .withColumn("__h", F.xxhash64("doc_id"))
    )
    picked = []
    for y in (0, 1):
        picked += ranked.where(F.col("__y") == y).orderBy("__h", "doc_id").limit(bound // 2).collect()
    if not picked:
        return []
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r["doc_id"], r["__y"]) for r in picked], "doc_id bigint, __y int")
    rows = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .where(F.length("text") <= SAMPLE_CHARS)
        .join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id", "__y")
        .agg(F.min("text").alias("text"))
        .collect()
    )
    first: dict[str, tuple[int, str, int]] = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        first.setdefault(r["text"], (r["doc_id"], r["text"], r["__y"]))
    return list(first.values())


#: Bits of a filter for each key, the bits of one bitmap, and the most bits in all (16 MB): more keys are joined instead.
FILTER_BITS, BITMAP, MOST_BITS = 16, 1 << 15, 1 << 27


class KeySet:
    """A set of keys that rows are tested against.

    A set whose filter fits ``MOST_BITS`` is held as bitmaps, sized by the counted
    keys and broadcast; these have false members (one row in 16 at most), but no
    missing ones.  A larger set is joined, salted for hot keys, and exact.
    """

    def __init__(self, keys: DataFrame, key: str):
        """``keys`` may repeat; ``key`` is hashed as it is."""
        distinct = durable(keys.select(F.xxhash64(key).alias("key")).distinct())
        bits = max(BITMAP, 1 << (FILTER_BITS * max(1, distinct.count()) - 1).bit_length())
        self.maps = bits // BITMAP if bits <= MOST_BITS else None
        self.keys = distinct
        if self.maps:
            bucket, bit = self._slot(F.col("key"))
            self.keys = durable(distinct.select(bucket.alias("bucket"), bit.cast("long").alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")))

    def _slot(self, hashed: Column) -> tuple[Column, Column]:
        place = F.pmod(hashed, F.lit(self.maps * BITMAP))
        return F.shiftright(place, 15).cast("int"), place.bitwiseAND(BITMAP - 1).cast("int")

    def marked(self, rows: DataFrame, key: Column) -> DataFrame:
        """(row, inside): each row of ``rows`` as a struct, and whether its key may be in the set."""
        hashed = F.xxhash64(key)
        if not self.maps:
            rows = rows.select(F.struct("*").alias("row"), hashed.alias("key"))
            return salted_left_join(rows, self.keys.withColumn("found", F.lit(True)), "key").select("row", F.coalesce("found", F.lit(False)).alias("inside"))
        bucket, bit = self._slot(hashed)
        rows = rows.select(F.struct("*").alias("row"), bucket.alias("bucket"), bit.alias("bit"))
        byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright("bit", 3) + 1, F.lit(1))), 16, 10).cast("int")
        inside = F.coalesce(F.getbit(byte, F.col("bit").bitwiseAND(7)), F.lit(0)) == 1
        return rows.join(F.broadcast(self.keys), "bucket", "left").select("row", inside.alias("inside"))


class Scratch:
    """Intermediate tables of one call in the shared folder; ``close`` removes them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []
        self.tables: list[str] = []

    def written(self, df: DataFrame) -> DataFrame:
        path = f"{checkpoint_dir(self.spark)}/table-{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def dropped(self, *paths: str) -> None:
        for path in paths:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def close(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.dropped(f"{checkpoint_dir(self.spark)}/{name}")
        self.dropped(*self.paths)
        self.paths, self.tables = [], []


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it from there."""
    return Scratch(df.sparkSession).written(df)
