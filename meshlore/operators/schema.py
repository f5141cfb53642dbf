"""The declared schema: named entities beside facts, and partitions of the loci."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import durable
from ..world import World

DECLARED = "entity_id bigint, name string, members array<bigint>"


@dataclass(frozen=True)
class SchemaWorld:
    """Declared entities of a world: ids in order of declaration."""

    declared: DataFrame

    @staticmethod
    def of(world: World) -> SchemaWorld:
        return SchemaWorld(world.spark.createDataFrame([], DECLARED))

    def declare_entity(self, name: str, members: list[int]) -> tuple[SchemaWorld, int]:
        top = self.declared.agg(F.max("entity_id")).first()[0]
        number = 0 if top is None else top + 1
        row = self.declared.sparkSession.createDataFrame([(number, name, list(members))], DECLARED)
        return SchemaWorld(durable(self.declared.unionAll(row))), number

    def entity_by_name(self, name: str) -> DataFrame:
        return self.declared.where(F.col("name") == name).orderBy("entity_id").limit(1)

    def entities_containing(self, locus: int) -> DataFrame:
        return self.declared.where(F.array_contains("members", locus))

    def update_entity_members(self, entity: int, members: list[int]) -> tuple[SchemaWorld, bool]:
        """The schema with an entity's members replaced, and whether there is such an entity."""
        own = F.col("entity_id") == entity
        new = F.when(own, F.array(*[F.lit(m).cast("bigint") for m in members]).cast("array<bigint>")).otherwise(F.col("members"))
        return SchemaWorld(durable(self.declared.withColumn("members", new))), not self.declared.where(own).isEmpty()


def retract_between(world: World, subject: int, predicate: str, obj: int) -> tuple[World, int]:
    """The world with all active facts of a subject, predicate and object retracted, one after another, and how many."""
    from .entities import version

    own = (F.col("subject") == subject) & (F.col("predicate") == predicate) & (F.col("object") == obj) & F.col("retracted_at").isNull()
    ids = [r["fact_id"] for r in world.facts.where(own).select("fact_id").orderBy("fact_id").limit(100_000).collect()]
    if not ids:
        return world, 0
    now = version(world)
    when = world.spark.createDataFrame([(i, now + k) for k, i in enumerate(ids)], "fact_id bigint, gone_at bigint")
    facts = world.facts.join(when, "fact_id", "left").withColumn("retracted_at", F.coalesce("gone_at", "retracted_at")).select(*world.facts.columns)
    return world.with_tables(facts=durable(facts)), len(ids)


def predicates_between(world: World, a: int, b: int) -> DataFrame:
    """(predicate) of the active facts between two loci, either way."""
    forth, back = (F.col("subject") == a) & (F.col("object") == b), (F.col("subject") == b) & (F.col("object") == a)
    return world.facts.where(F.col("retracted_at").isNull() & (forth | back)).select("predicate")


@dataclass(frozen=True)
class PartitionIndex:
    """Loci by the bucket that a rule gives them: (locus_id, bucket)."""

    rule: Column
    buckets: DataFrame

    @staticmethod
    def of(world: World, rule: Column) -> PartitionIndex:
        """``rule`` is an expression of a locus (locus_id, kind, state)."""
        return PartitionIndex(rule, durable(world.loci.select("locus_id", rule.cast("bigint").alias("bucket"))))

    def repartition(self, world: World) -> PartitionIndex:
        """The same rule over the loci as they are now."""
        return PartitionIndex.of(world, self.rule)

    def bucket_of(self, locus: int) -> int | None:
        row = self.buckets.where(F.col("locus_id") == locus).first()
        return row["bucket"] if row else None

    def loci_in(self, bucket: int) -> DataFrame:
        return self.buckets.where(F.col("bucket") == bucket).select("locus_id")

    def sizes(self) -> DataFrame:
        return self.buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("loci"))
