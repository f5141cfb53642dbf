"""Worlds to test and measure with: chains, rings, stars, fans, and seeded random ones, with their engines."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..streaming.engine import Engine, InfluenceKind, Program
from ..world import World

KIND = InfluenceKind(1, "influence", decay=0.9)


def _loci(spark: SparkSession, n: int, dims: int = 1) -> World:
    rows = spark.range(n).select(F.col("id").alias("locus_id"), F.col("id").alias("kind"), F.array_repeat(F.lit(0.0), dims).alias("state"))
    return World.of(spark, 0, loci=rows)


def chain_world(spark: SparkSession, n: int, gain: float) -> tuple[World, Engine]:
    """0 -> 1 -> ... -> n - 1; the last does nothing."""
    return _loci(spark, n), Engine((KIND,), tuple(Program(i, 1, gain, (i + 1,)) for i in range(n - 1)))


def cyclic_pair_world(spark: SparkSession, gain: float) -> tuple[World, Engine]:
    return _loci(spark, 2), Engine((KIND,), (Program(0, 1, gain, (1,)), Program(1, 1, gain, (0,))))


def star_world(spark: SparkSession, arms: int, gain: float) -> tuple[World, Engine]:
    """0 broadcasts to 1 to ``arms``."""
    return _loci(spark, arms + 1), Engine((KIND,), (Program(0, 1, gain, tuple(range(1, arms + 1))),))


def accumulator_world(spark: SparkSession, gain: float) -> tuple[World, Engine]:
    return _loci(spark, 1), Engine((KIND,), (Program(0, 1, gain),))


def ring_world(spark: SparkSession, n: int, gain: float) -> tuple[World, Engine]:
    return _loci(spark, n), Engine((KIND,), tuple(Program(i, 1, gain, ((i + 1) % n,)) for i in range(n)))


def fan_in_world(spark: SparkSession, sources: int, sinks: int, dims: int, gain: float) -> tuple[World, Engine]:
    """Every source feeds every sink."""
    to = tuple(range(sources, sources + sinks))
    return _loci(spark, sources + sinks, dims), Engine((KIND,), tuple(Program(i, 1, gain, to) for i in range(sources)))


class Lcg:
    """A linear congruential generator (fixed values: multiplier and increment of the common 64-bit one)."""

    def __init__(self, seed: int):
        self.state = seed

    def next(self) -> int:
        self.state = (self.state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        return self.state

    def integer(self, low: int, high: int) -> int:
        return low + self.next() % (high - low)

    def number(self, low: float, high: float) -> float:
        return low + (self.next() >> 11) / (1 << 53) * (high - low)


def random_chain_world(spark: SparkSession, seed: int) -> tuple[World, Engine]:
    r = Lcg(seed)
    return chain_world(spark, r.integer(2, 12), r.number(0.1, 0.95))


def random_star_world(spark: SparkSession, seed: int) -> tuple[World, Engine]:
    r = Lcg(seed)
    return star_world(spark, r.integer(2, 12), r.number(0.1, 0.95))
