"""Entities: history as of a batch, deviations, causes; declared facts against observed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable
from ..world import World
from . import causality

UPSTREAM_LIMIT = 256


def layers_at(world: World, batch: int) -> DataFrame:
    """Each entity's layer as of a batch, the last one up to it."""
    newest = Window.partitionBy("entity_id").orderBy(F.desc("batch"), F.desc("seq"))
    return world.entity_layers.where(F.col("batch") <= batch).withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def layers_in_range(world: World, entity: int, first: int, last: int) -> DataFrame:
    return world.entity_layers.where((F.col("entity_id") == entity) & F.col("batch").between(first, last - 1)).orderBy("batch", "seq")


def entity_transition_cause(world: World, entity: int, batch: int) -> DataFrame:
    return layers_at(world, batch).where(F.col("entity_id") == entity).select("entity_id", "batch", "transition", "cause")


def cause_seed_changes(world: World, rels: list[int], before: int) -> DataFrame:
    """(rel_id, change_id): the last change before a batch of each of a cause's relationships."""
    rows = world.relationship_changes().where(F.col("subject_id").isin(*rels) & (F.col("batch") < before)) if rels else world.relationship_changes().limit(0)
    return rows.groupBy(F.col("subject_id").alias("rel_id")).agg(F.max("change_id").alias("change_id"))


def entity_upstream_transitions(world: World, entity: int, batch: int) -> DataFrame:
    """(entity_id, batch): other entities, each with its latest layer before the batch that has a locus among the causes.

    The causes are the seeds and all their ancestors, by one search.  The result ends
    at ``UPSTREAM_LIMIT`` rows, least id first: the limit belongs to the query.
    """
    cause = entity_transition_cause(world, entity, batch).select("cause").first()
    rels = list(cause["cause"]["rels"] or []) if cause and cause["cause"] else []
    seeds = durable(cause_seed_changes(world, rels, batch).select(F.col("change_id").alias("node")))
    found = seeds.unionAll(causality.causal_ancestors(world, seeds).select("change_id"))
    loci = world.locus_changes().join(found.select(F.col("node").alias("change_id")).distinct(), "change_id", "left_semi").select(F.col("subject_id").alias("locus_id")).distinct()
    layers = world.entity_layers.where((F.col("entity_id") != entity) & (F.col("batch") < batch) & (F.col("compression") != "Skeleton"))
    hit = layers.select("entity_id", "batch", F.explode("members").alias("locus_id")).join(loci, "locus_id", "left_semi")
    return hit.groupBy("entity_id").agg(F.max("batch").alias("batch")).orderBy("entity_id").limit(UPSTREAM_LIMIT)


def entity_deviations_since(world: World, baseline: int) -> DataFrame:
    """(entity_id, coherence_at_baseline, coherence_now, members_at_baseline, members_now, layers_since, lifecycle): entities with later layers."""
    before = layers_at(world, baseline).select("entity_id", F.col("coherence").alias("coherence_at_baseline"), F.col("member_count").alias("members_at_baseline"))
    since = world.entity_layers.where(F.col("batch") > baseline).groupBy("entity_id").agg(F.count(F.lit(1)).alias("layers_since"), F.count_if(~F.col("transition").isin("MembershipDelta", "CoherenceShift")).alias("lifecycle"))
    now = world.entities.select("entity_id", F.col("coherence").alias("coherence_now"), F.size("members").cast("bigint").alias("members_now"))
    return since.join(now, "entity_id").join(before, "entity_id", "left").select("entity_id", "coherence_at_baseline", "coherence_now", "members_at_baseline", "members_now", "layers_since", "lifecycle")


def weather(age: Column) -> Column:
    """What the default policy does with a layer of an age in batches."""
    return F.when(age < 50, "Preserved").when(age < 200, "Compress").when(age < 1000, "Skeleton").otherwise(F.when(F.col("transition").isin("Born", "Split", "Merged"), "Skeleton").otherwise("Remove"))


def weather_entities(world: World, now: int | None = None) -> World:
    """The world with old layers compressed, reduced to skeletons or removed."""
    action = weather(F.lit(world.current_batch if now is None else now) - F.col("batch"))
    empty = F.array().cast("array<bigint>")
    rows = world.entity_layers.withColumn("__a", action).where("__a <> 'Remove'")
    faint = F.col("__a").isin("Compress", "Skeleton")
    rows = rows.withColumns(
        {
            "compression": F.when(F.col("__a") == "Compress", "Compressed").when(F.col("__a") == "Skeleton", "Skeleton").otherwise(F.col("compression")),
            "members": F.when(faint, empty).otherwise(F.col("members")),
            "member_rels": F.when(faint, empty).otherwise(F.col("member_rels")),
            "coherence": F.when(F.col("__a") == "Skeleton", F.lit(None).cast("double")).otherwise(F.col("coherence")),
        }
    )
    return world.with_tables(entity_layers=rows.drop("__a"))


# Declared facts.


def facts_at(world: World, version: int | None = None) -> DataFrame:
    """Facts active at a version (asserted up to it, not retracted yet), or active now."""
    if version is None:
        return world.facts.where("retracted_at IS NULL")
    return world.facts.where((F.col("asserted_at") <= version) & (F.col("retracted_at").isNull() | (F.col("retracted_at") > version)))


def facts_between(world: World, subject: int | None = None, obj: int | None = None, predicate: str | None = None) -> DataFrame:
    rows = facts_at(world)
    for column, value in (("subject", subject), ("object", obj), ("predicate", predicate)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows


def version(world: World) -> int:
    """Asserts and retractions so far."""
    return world.facts.agg(F.count(F.lit(1)) + F.count("retracted_at")).first()[0]


def assert_fact(world: World, subject: int, predicate: str, obj: int) -> World:
    row = world.facts.agg(F.max("fact_id")).first()[0]
    new = world.spark.createDataFrame([((-1 if row is None else row) + 1, subject, predicate, obj, version(world), None)], world.facts.schema)
    return world.with_tables(facts=world.facts.unionAll(new))


def retract_fact(world: World, fact_id: int) -> World:
    now = version(world)
    gone = F.when((F.col("fact_id") == fact_id) & F.col("retracted_at").isNull(), F.lit(now)).otherwise(F.col("retracted_at"))
    return world.with_tables(facts=world.facts.withColumn("retracted_at", gone.cast("bigint")))


def boundary(world: World, threshold: float = 0.1, mode: str = "activity") -> DataFrame:
    """(status, subject, object, predicate, fact_id, rel_id, signal).

    Active facts with an edge between their loci whose magnitude is above the
    threshold are confirmed, other facts ghosts; active edges that confirm nothing
    are shadows.  A pair's facts confirm its edge of the lowest id only.
    """
    value = {"activity": F.abs("activity"), "strength": F.abs(F.col("activity") + F.col("weight")), "weight": F.abs("weight")}[mode]
    u, v = F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")
    edges = world.edges.select(u, v, "rel_id", "src", "dst", value.alias("signal")).where(F.col("signal") > F.lit(float(threshold)))
    facts = facts_at(world).select(F.least("subject", "object").alias("u"), F.greatest("subject", "object").alias("v"), "subject", "predicate", "object", "fact_id")
    declared = facts.select("u", "v").distinct()
    first = edges.join(declared, ["u", "v"], "left_semi").groupBy("u", "v").agg(F.min_by(F.struct("rel_id", "signal"), "rel_id").alias("e"))
    matched = facts.join(first, ["u", "v"], "left").select(F.when(F.col("e").isNotNull(), "confirmed").otherwise("ghost").alias("status"), "subject", "object", "predicate", "fact_id", "e.rel_id", "e.signal")
    covered = first.select(F.col("e.rel_id").alias("rel_id"))
    none = F.lit(None)
    shadow = edges.join(covered, "rel_id", "left_anti").select(F.lit("shadow"), F.col("src"), F.col("dst"), none.cast("string"), none.cast("bigint"), "rel_id", "signal")
    return matched.unionAll(shadow)


def boundary_summary(report: DataFrame) -> DataFrame:
    """One row: confirmed, ghosts, shadows and tension, the share that isn't confirmed."""
    n = lambda s: F.count_if(F.col("status") == s)
    return report.agg(n("confirmed").alias("confirmed"), n("ghost").alias("ghosts"), n("shadow").alias("shadows"), F.coalesce((n("ghost") + n("shadow")) / F.count(F.lit(1)), F.lit(0.0)).alias("tension"))


def locus_tension(report: DataFrame) -> DataFrame:
    """(locus_id, confirmed, ghosts, shadows, tension): most unexplained first."""
    ends = report.select("status", F.explode(F.array_distinct(F.array("subject", "object"))).alias("locus_id"))
    n = lambda s: F.count_if(F.col("status") == s)
    rows = ends.groupBy("locus_id").agg(n("confirmed").alias("confirmed"), n("ghost").alias("ghosts"), n("shadow").alias("shadows"))
    rows = rows.withColumn("tension", (F.col("ghosts") + F.col("shadows")) / (F.col("confirmed") + F.col("ghosts") + F.col("shadows")))
    return rows.orderBy((F.col("ghosts") + F.col("shadows")).desc(), F.desc("tension"), "locus_id")


def layer_tension(world: World, kind_map: dict[str, int], threshold: float = 0.1) -> DataFrame:
    """(predicate, confirmed, ghosts, shadows) of each declared predicate against the edges of its kind."""
    out = None
    for predicate, kind in sorted(kind_map.items()):
        own = world.with_tables(facts=world.facts.where(F.col("predicate") == predicate), relationships=world.relationships.where(F.col("kind") == kind))
        row = boundary_summary(boundary(own, threshold)).select(F.lit(predicate).alias("predicate"), "confirmed", "ghosts", "shadows", "tension")
        out = row if out is None else out.unionAll(row)
    return out


def prescribe_updates(world: World, report: DataFrame, min_ghost_age: int = 5, min_shadow_signal: float = 0.1) -> DataFrame:
    """(action, fact_id, rel_id, subject, object, severity): retract old ghosts, assert strong shadows; retractions first."""
    now = version(world)
    age = F.lit(now) - F.col("asserted_at")
    ghosts = report.where("status = 'ghost'").join(world.facts.select("fact_id", "asserted_at"), "fact_id").where(age >= min_ghost_age)
    retract = ghosts.select(F.lit("retract").alias("action"), "fact_id", F.lit(None).cast("bigint").alias("rel_id"), "subject", "object", (age / (age + min_ghost_age)).alias("severity"))
    shadows = report.where((F.col("status") == "shadow") & (F.col("signal") >= F.lit(float(min_shadow_signal))))
    declare = shadows.select(F.lit("assert"), F.lit(None).cast("bigint"), "rel_id", "subject", "object", F.col("signal") / (F.col("signal") + 1))
    return retract.unionAll(declare).orderBy(F.desc("action"), F.desc("severity"), "fact_id", "rel_id")


def apply_prescriptions(world: World, actions: DataFrame) -> World:
    """The world with the retractions marked and the assertions added as ``inferred_influence``."""
    from ..streaming.engine import numbered

    now = version(world)
    gone = actions.where("action = 'retract'").select("fact_id", F.lit(True).alias("__gone"))
    kept = world.facts.join(gone, "fact_id", "left").withColumn("retracted_at", F.when(F.col("__gone") & F.col("retracted_at").isNull(), F.lit(now)).otherwise(F.col("retracted_at")).cast("bigint")).select(*world.facts.columns)
    top = world.facts.agg(F.coalesce(F.max("fact_id"), F.lit(-1))).first()[0]
    new = actions.where("action = 'assert'").select("subject", "object").distinct()
    # A fact's id is its position in order of subject and object, counted by ranges.
    placed = numbered(new, [F.col("subject"), F.col("object")], top + 1, "fact_id")
    added = placed.select(F.col("fact_id").cast("bigint").alias("fact_id"), "subject", F.lit("inferred_influence").alias("predicate"), "object", F.lit(now).cast("bigint").alias("asserted_at"), F.lit(None).cast("bigint").alias("retracted_at"))
    return world.with_tables(facts=kept.unionByName(added))
