"""Intermediate results that survive lost executors, and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast once it has been counted.
BROADCAST_ROWS = 200_000

#: Whether a query's shuffles are deleted once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


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


def durable(df: DataFrame) -> DataFrame:
    """Write to the shared folder and cut the lineage there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, *by: str) -> DataFrame:
    """The same as Parquet, whose columns are packed: for what is large, or made anew every round (see ``forget``).

    Rows lie in folders ``by`` columns of numbers, so that a reader of some values opens no others' files.

    The shuffles that made it go with the write; by themselves they stay for as long as the driver's garbage holds their plan.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/meshlore-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    out._stored = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more, and let go of the shuffles that nothing refers to."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    path = jvm.org.apache.hadoop.fs.Path(df._stored)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    jvm.System.gc()


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A durable copy of ``df``, marked for broadcast only if it has few rows and few bytes; otherwise the join shuffles."""
    kept = durable(df)
    if kept.limit(rows + 1).count() > rows:
        return kept
    wide = [F.coalesce(F.size(c), F.lit(0)) if t.startswith("array") else F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c, t in kept.dtypes if t.startswith("array") or t in ("string", "binary")]
    if wide and (kept.agg(F.sum(sum(wide[1:], wide[0])).alias("n")).first()["n"] or 0) > 16 * rows:
        return kept
    return F.broadcast(kept)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` dealt by columns over as many partitions as a join of it needs tasks, however few its bytes."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *columns)


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """Inner join with at most one row of ``right`` per key, where one key may hold most of ``left``."""
    dealt = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [key, "__salt"]).drop("__salt")
