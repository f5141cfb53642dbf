"""Recognition: groups of loci become entities with a history, groups of entities cohere."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import durable
from ..operators.traversal import components
from ..world import SCHEMAS, World
from .engine import numbered

ROUNDS = 15
COHERENCE_STEP = 0.05


def auto_activity_threshold(world: World) -> float:
    """Just above the value below the widest ratio gap (two or more) in the lower three quarters of |activity|; 0 without one.

    The values are numbered by ranges; a value's neighbour is the one of the next number.
    """
    values = world.edges.select(F.abs("activity").alias("a")).where("a > 0")
    placed = durable(numbered(values, [F.col("a")], 0, "place"))
    n = placed.count()
    if n < 4:
        return 0.0
    low = placed.where((F.col("place") < n * 3 // 4) & (F.col("a") >= 1e-6))
    gaps = low.join(placed.select((F.col("place") - 1).alias("place"), F.col("a").alias("b")), "place").select((F.col("b") / F.col("a")).alias("g"), "a")
    best = gaps.where("g >= 2").agg(F.max(F.struct(F.col("g"), (-F.col("a")).alias("a"))).alias("m")).first()["m"]
    return -best["a"] * 1.0001 if best else 0.0


def find_communities(world: World, threshold: float, rounds: int = ROUNDS) -> DataFrame:
    """(locus_id, community): label propagation over edges of |activity| >= threshold, weighted by activity + weight.

    A locus takes the label with the largest summed weight (negative weights repel;
    ties go to the lower label).  Labels move one after another in id order within a
    connected component, the unit of parallel work.
    """
    rows = world.edges.where((F.abs("activity") >= F.lit(float(threshold))) & (F.col("src") != F.col("dst")))
    pairs = durable(rows.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(F.col("activity") + F.col("weight")).alias("w")))
    part = components(world, nodes=world.loci.select("locus_id").limit(0), steps=pairs.select("a", "b"))

    def spread(table: pd.DataFrame) -> pd.DataFrame:
        ids, place = np.unique(np.concatenate([table["a"], table["b"]]), return_inverse=True)
        near: list[list[tuple[int, float]]] = [[] for _ in ids]
        for i, j, w in zip(place[: len(table)].tolist(), place[len(table) :].tolist(), table["w"].tolist(), strict=True):
            near[i].append((j, w))
            near[j].append((i, w))
        label = list(range(len(ids)))
        for _ in range(rounds):
            moved = False
            for i, edges in enumerate(near):
                votes: dict[int, float] = {}
                for j, w in edges:
                    votes[label[j]] = votes.get(label[j], 0.0) + w
                best = min(votes, key=lambda c: (-votes[c], c))
                if votes[best] > 0 and best != label[i]:
                    label[i], moved = best, True
            if not moved:
                break
        return pd.DataFrame({"locus_id": ids, "community": ids[label]})

    return pairs.join(part.withColumnRenamed("locus_id", "a"), "a").groupBy("component").applyInPandas(spread, "locus_id bigint, community bigint")


def component_stats(world: World, labels: DataFrame, threshold: float) -> DataFrame:
    """(community, members, member_rels, coherence) of groups of two or more."""
    own = labels.select(F.col("locus_id").alias("src"), F.col("community").alias("c1"))
    other = labels.select(F.col("locus_id").alias("dst"), F.col("community").alias("c2"))
    inside = world.edges.where(F.abs("activity") >= F.lit(float(threshold))).join(own, "src").join(other, "dst").where("c1 = c2")
    rels = inside.groupBy(F.col("c1").alias("community")).agg(F.array_sort(F.collect_set("rel_id")).alias("member_rels"), F.avg(F.abs("activity")).alias("mean"), F.count(F.lit(1)).alias("n_rels"))
    members = labels.groupBy("community").agg(F.array_sort(F.collect_set("locus_id")).alias("members")).where(F.size("members") >= 2)
    n = F.size("members")
    coherence = F.col("mean") * F.least(F.col("n_rels") / (n * F.log(n + 1.0) / 2), F.lit(1.0))
    return members.join(rels, "community").select("community", "members", "member_rels", coherence.alias("coherence"))


def proposals(world: World, found: DataFrame) -> DataFrame:
    """(type, community, entity_id, others): what the groups mean for the entities there are.

    Members of an active entity flow to groups.  Two or more groups with two
    members each split it; none leaves it dormant; otherwise the largest claims it.
    A group nobody claims is born (or revives a dormant entity with most of its
    members), one claimed once is a deposit, more often a merge into the least id.
    """
    flow = world.entities.select("entity_id", "status", F.explode("members").alias("locus_id")).join(found.select("community", F.explode("members").alias("locus_id")), "locus_id", "left")
    buckets = flow.groupBy("entity_id", "status", "community").count()
    per = buckets.groupBy("entity_id", "status").agg(
        F.count_if(F.col("community").isNotNull() & (F.col("count") >= 2)).alias("large"), F.sum("count").alias("size"), F.sum(F.when(F.col("community").isNull(), F.col("count")).otherwise(0)).alias("lost"),
        F.max_by("community", F.when(F.col("community").isNotNull(), F.struct("count", (-F.col("community")).alias("c")))).alias("best"), F.max(F.when(F.col("community").isNotNull(), F.col("count"))).alias("held"),
        F.array_sort(F.collect_set(F.when(F.col("community").isNotNull() & (F.col("count") >= 2), F.col("community")))).alias("parts"),
    )
    active = durable(per.where("status = 'Active'"))
    none = F.lit(None).cast("bigint")
    split = active.where("large >= 2").select(F.lit("Split").alias("type"), none.alias("community"), "entity_id", F.col("parts").alias("others"))
    dormant = active.where("large < 2 AND (held IS NULL OR lost > held)").select(F.lit("Dormant"), none, "entity_id", F.array().cast("array<bigint>"))
    claims = active.where("large < 2 AND held IS NOT NULL AND lost <= held").select("entity_id", F.col("best").alias("community"))
    claimed = claims.groupBy("community").agg(F.array_sort(F.collect_set("entity_id")).alias("by"))
    taken = split.select(F.explode("others").alias("community"))
    revive = per.where("status = 'Dormant' AND held IS NOT NULL AND lost <= held").groupBy(F.col("best").alias("community")).agg(F.min("entity_id").alias("revived"))
    fate = found.select("community").join(taken, "community", "left_anti").join(claimed, "community", "left").join(revive, "community", "left")
    size = F.coalesce(F.size("by"), F.lit(0))
    kind = F.when(size >= 2, "Merge").when(size == 1, "Deposit").when(F.col("revived").isNotNull(), "Revive").otherwise("Born")
    own = F.when(size >= 1, F.element_at("by", 1)).otherwise(F.col("revived"))
    rest = F.when(size >= 2, F.slice("by", 2, size - 1)).otherwise(F.array().cast("array<bigint>"))
    return split.unionAll(dormant).unionAll(fate.select(kind, "community", own, rest))


def exclusive(world: World, found: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups without the loci that another entity owns, and the plan without those that this leaves too small.

    Loci of an entity that claims a group are its own: a group that is born or
    revived loses all of them, a claimed one those of other entities; a merge takes all.
    """
    claims = plan.where("type IN ('Deposit', 'Merge')").select(F.explode(F.concat(F.array("entity_id"), "others")).alias("owner")).distinct()
    owned = world.entities.join(claims, F.col("entity_id") == F.col("owner"), "left_semi").select(F.explode("members").alias("locus_id"), F.col("entity_id").alias("owner"))
    fate = plan.where("type IN ('Born', 'Revive', 'Deposit')").select("community", F.when(F.col("type") == "Deposit", F.col("entity_id")).alias("own"))
    members = found.join(fate, "community").select("community", "own", F.explode("members").alias("locus_id"))
    mine = world.entities.select(F.col("entity_id").alias("own"), F.explode("members").alias("locus_id"), F.lit(True).alias("mine"))
    foreign = members.join(owned.select("locus_id").distinct(), "locus_id", "left_semi").join(mine, ["own", "locus_id"], "left").where("mine IS NULL")
    lost = durable(foreign.groupBy("community").agg(F.collect_set("locus_id").alias("lost")))
    left = found.join(lost, "community", "left").withColumn("members", F.when(F.col("lost").isNull(), F.col("members")).otherwise(F.array_except("members", "lost")))
    rels = left.where("lost IS NOT NULL").select("community", "members", F.explode("member_rels").alias("rel_id")).join(world.relationships.select("rel_id", "src", "dst"), "rel_id")
    inside = rels.where(F.array_contains("members", F.col("src")) & F.array_contains("members", F.col("dst"))).groupBy("community").agg(F.array_sort(F.collect_set("rel_id")).alias("inside"))
    none = F.array().cast("array<bigint>")
    left = left.join(inside, "community", "left").withColumn("member_rels", F.when(F.col("lost").isNull(), F.col("member_rels")).otherwise(F.coalesce("inside", none)))
    groups = durable(left.select("community", "members", "member_rels", "coherence"))
    small = groups.where(F.size("members") < 2).select("community")
    gone = F.col("type").isin("Born", "Revive", "Deposit")
    kept = plan.where(~gone | F.col("community").isNull()).unionByName(plan.where(gone & F.col("community").isNotNull()).join(small, "community", "left_anti").select(*plan.columns))
    return groups, durable(kept)


def recognize_entities(world: World, threshold: float | None = None) -> tuple[World, DataFrame]:
    """One pass of recognition: the world with entities and layers, and the lifecycle events."""
    threshold = auto_activity_threshold(world) if threshold is None else threshold
    found = durable(component_stats(world, find_communities(world, threshold), threshold))
    found, plan = exclusive(world, found, durable(proposals(world, found)))
    batch = world.current_batch
    empty = F.array().cast("array<bigint>")
    top = world.entities.agg(F.coalesce(F.max("entity_id"), F.lit(-1))).first()[0]
    # New entities: born groups, and the parts of splits.
    fresh = plan.where("type = 'Born'").select("community", F.lit("Born").alias("type"), empty.alias("parents")).unionAll(plan.where("type = 'Split'").select(F.explode("others"), F.lit("Born"), F.array("entity_id")))
    fresh = durable(numbered(fresh.groupBy("community", "type").agg(F.flatten(F.collect_list("parents")).alias("parents")), ["community"], top + 1, "entity_id"))
    groups = found.select("community", "members", "member_rels", "coherence")
    born = fresh.join(groups, "community").select("entity_id", F.lit("Active").alias("status"), "members", "member_rels", "coherence", "parents", empty.alias("children"))
    offspring = fresh.select("entity_id", F.explode("parents").alias("p")).groupBy(F.col("p").alias("entity_id")).agg(F.array_sort(F.collect_set("entity_id")).alias("kids"))
    updates = plan.where("type IN ('Deposit', 'Revive', 'Merge')").join(groups.withColumnsRenamed({"members": "g_members", "member_rels": "g_rels", "coherence": "g_coherence"}), "community").select("entity_id", "type", "g_members", "g_rels", "g_coherence", "others")
    asleep = plan.where("type IN ('Dormant', 'Split')").select("entity_id").unionAll(plan.where("type = 'Merge'").select(F.explode("others"))).select("entity_id", F.lit(True).alias("__sleep"))
    now = world.entities.join(updates, "entity_id", "left").join(asleep, "entity_id", "left").join(offspring, "entity_id", "left")
    entities = now.select(
        "entity_id", F.when(F.col("__sleep"), "Dormant").when(F.col("type").isNotNull(), "Active").otherwise(F.col("status")).alias("status"), F.coalesce("g_members", "members").alias("members"), F.coalesce("g_rels", "member_rels").alias("member_rels"),
        F.coalesce("g_coherence", "coherence").alias("coherence"), "parents", F.array_distinct(F.concat(F.coalesce("children", empty), F.coalesce("kids", empty), F.coalesce("others", empty))).alias("children"),
    )
    changed = (F.col("type") != "Deposit") | (F.abs(F.col("g_coherence") - F.col("coherence")) > COHERENCE_STEP) | (F.col("g_members") != F.col("members"))
    names = {"Deposit": "MembershipDelta", "Revive": "Revived", "Merge": "Merged"}
    transition = F.lit(None).cast("string")
    for k, v in names.items():
        transition = F.when(F.col("type") == k, v).otherwise(transition)
    transition = F.when(F.col("type") == "Deposit", F.when(F.col("g_members") != F.col("members"), "MembershipDelta").otherwise("CoherenceShift")).otherwise(transition)
    touched = now.where(F.col("type").isNotNull() & changed).select("entity_id", transition.alias("transition"), F.array_except("g_members", "members").alias("added"), F.array_except("members", "g_members").alias("removed"), F.coalesce("others", empty).alias("absorbed"), F.col("coherence").alias("coh_from"), F.col("g_coherence").alias("coherence"), F.col("g_members").alias("members"), F.col("g_rels").alias("member_rels"), empty.alias("offspring"))
    slept = now.where("__sleep").select("entity_id", F.when(F.col("kids").isNotNull(), "Split").otherwise("BecameDormant"), empty, empty, empty, "coherence", "coherence", "members", "member_rels", F.coalesce("kids", empty))
    first = born.select("entity_id", F.lit("Born"), "members", empty, empty, F.lit(None).cast("double"), "coherence", "members", "member_rels", empty)
    seq = world.entity_layers.groupBy("entity_id").agg((F.max("seq") + 1).alias("__seq"))
    layers = touched.unionAll(slept).unionAll(first).join(seq, "entity_id", "left")
    cause = F.struct(F.lit("RelationshipCluster").alias("type"), F.col("member_rels").alias("rels"), F.col("absorbed").alias("entities"))
    layers = durable(layers.select("entity_id", F.coalesce("__seq", F.lit(0)).cast("bigint").alias("seq"), F.lit(batch).cast("bigint").alias("batch"), "transition", "added", "removed", "offspring", "absorbed", "coh_from", F.col("coherence").alias("coh_to"), F.lit("Full").alias("compression"), "coherence", F.size("members").cast("bigint").alias("member_count"), "members", "member_rels", cause.alias("cause")))
    events = layers.select("batch", F.concat(F.lit("Entity"), "transition").alias("type"), F.col("entity_id").alias("subject"), F.lit(None).cast("string").alias("payload"))
    return world.with_tables(entities=durable(entities.unionByName(born)), entity_layers=world.entity_layers.unionByName(layers), world_events=world.world_events.unionByName(events)), events


def extract_cohere(world: World, perspective: str = "default", min_bridge: float | None = None) -> World:
    """Active entities linked by summed |activity| of the edges between their members, single linkage.

    The threshold is given, or the upper median of the positive bridges.  A
    cluster's strength is the number of bridges over its pairs, at most 1.
    """
    member = world.entities.where("status = 'Active'").select("entity_id", F.explode("members").alias("locus_id"))
    own = member.select(F.col("locus_id").alias("src"), F.col("entity_id").alias("x"))
    other = member.select(F.col("locus_id").alias("dst"), F.col("entity_id").alias("y"))
    bridges = durable(world.edges.join(own, "src").join(other, "dst").where("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum(F.abs("activity")).alias("w")).where("w > 0"))
    if min_bridge is None:
        median = numbered(bridges.select("w"), [F.col("w")], 0, "place").where(F.col("place") == bridges.count() // 2).first()
        min_bridge = median["w"] if median else None
    strong = durable(bridges.where(F.col("w") >= F.lit(float(min_bridge or 0.0))))
    label = components(world, nodes=member.select(F.col("entity_id").alias("locus_id")).limit(0), steps=strong.select("a", "b"))
    total = strong.count()
    groups = label.groupBy("component").agg(F.array_sort(F.collect_set("locus_id")).alias("entity_ids")).where(F.size("entity_ids") >= 2)
    n = F.size("entity_ids")
    strength = F.least(F.lit(float(total)) / (n * (n - 1) / 2), F.lit(1.0))
    new = groups.select(F.lit(perspective).alias("perspective"), F.lit(world.current_batch).cast("bigint").alias("batch"), F.col("component").alias("cohere_id"), "entity_ids", F.array().cast("array<bigint>").alias("relationship_ids"), strength.alias("strength"))
    kept = world.coheres.where(F.col("perspective") != perspective)
    assert set(new.columns) == {c.strip().split()[0] for c in SCHEMAS["coheres"].split(",")}
    return world.with_tables(coheres=durable(kept.unionByName(new)))
