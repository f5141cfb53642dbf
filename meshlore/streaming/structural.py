"""Structural proposals, interactions of kinds, and pair prediction with its learner."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable
from ..functions.vectors import activity
from ..world import World
from .engine import PENDING, Engine, numbered

#: One row per proposal; columns that an action doesn't use are null.
PROPOSALS = "action string, kind bigint, src bigint, dst bigint, directed boolean, activity double, state array<double>, rel_id bigint, locus_id bigint, subscriber bigint, anchor bigint"

SCOPES = {"subscribe": "Specific", "subscribe_to_kind": "AllOfKind", "subscribe_to_anchor_kind": "TouchingLocus"}


def proposals(world: World, rows: list[dict]) -> DataFrame:
    names = [c.split()[0] for c in PROPOSALS.split(", ")]
    return world.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], PROPOSALS)


def apply_structural(world: World, given: DataFrame) -> tuple[World, DataFrame]:
    """The world after proposals, and pending tombstone changes for subscribers of deleted edges.

    Actions: create_relationship (an edge that exists takes the activity instead),
    delete_relationship, create_locus, delete_locus (with its edges, subscriptions,
    properties and names), subscribe / unsubscribe with their _from_kind /
    _to_kind / anchor forms.  Creations come first, then subscriptions, then deletions.
    """
    given, batch = durable(given), world.current_batch
    of = lambda *actions: given.where(F.col("action").isin(*actions))
    top = world.loci.agg(F.coalesce(F.max("locus_id"), F.lit(-1))).first()[0]
    new_loci = of("create_locus")
    named = new_loci.where("locus_id IS NOT NULL").select("locus_id", "kind", F.coalesce("state", F.array().cast("array<double>")).alias("state"))
    minted = numbered(new_loci.where("locus_id IS NULL").select("kind", "state"), ["kind"], top + 1, "locus_id").select("locus_id", "kind", F.coalesce("state", F.array().cast("array<double>")).alias("state"))
    loci = world.loci.unionByName(named.unionByName(minted).join(world.loci.select("locus_id"), "locus_id", "left_anti"))
    # Edges: one per kind and key; what exists is touched.
    key = ["kind", "directed", "src", "dst"]
    sym = ~F.col("directed")
    wanted = of("create_relationship").select("kind", "directed", F.when(sym, F.least("src", "dst")).otherwise(F.col("src")).alias("src"), F.when(sym, F.greatest("src", "dst")).otherwise(F.col("dst")).alias("dst"), F.coalesce("activity", F.lit(0.0)).alias("a"), "state")
    wanted = wanted.groupBy(*key).agg(F.sum("a").alias("a"), F.first("state", ignorenulls=True).alias("given_state"))
    old = world.relationships.join(wanted.select(*key, "a"), key, "left")
    touched = F.concat(F.array(activity() + F.col("a")), F.slice("state", 2, F.greatest(F.size("state") - 1, F.lit(0))))
    kept = old.withColumn("state", F.when(F.col("a").isNotNull(), touched).otherwise(F.col("state"))).select(*world.relationships.columns)
    high = world.relationships.agg(F.coalesce(F.max("rel_id"), F.lit(-1))).first()[0]
    none = F.lit(None)
    fresh = numbered(wanted.join(world.relationships.select(*key), key, "left_anti"), key, high + 1, "rel_id").select(
        "rel_id", *key, F.coalesce("given_state", F.array("a", F.lit(0.0))).alias("state"), none.cast("bigint").alias("created_by"), none.cast("bigint").alias("last_touched_by"), F.lit(0).cast("bigint").alias("change_count"),
        F.array(F.struct(F.col("kind").alias("kind"), F.lit(0).cast("bigint").alias("touch_count"), F.lit(batch).cast("bigint").alias("last_batch"))).alias("kinds_observed"), F.lit(batch).cast("bigint").alias("created_batch"), F.lit(batch).cast("bigint").alias("last_decayed_batch"), none.cast("string").alias("metadata"),
    )
    relationships = durable(kept.unionByName(fresh))
    # Subscriptions.
    scope = F.lit(None).cast("string")
    for action, name in SCOPES.items():
        scope = F.when(F.col("action").isin(action, "un" + action, action.replace("subscribe_to", "unsubscribe_from")), name).otherwise(scope)
    columns = [F.col("subscriber"), scope.alias("scope"), F.col("rel_id"), F.col("kind"), F.col("anchor")]
    added = of(*SCOPES).select(*columns)
    removed = given.where(F.col("action").startswith("unsubscribe")).select(*columns)
    same = lambda df: df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"__{c}") for c in ("subscriber", "scope", "rel_id", "kind", "anchor")])
    every = world.subscriptions.unionByName(added).distinct()
    subscriptions = every.withColumns({f"__{c}": F.coalesce(F.col(c).cast("string"), F.lit("")) for c in every.columns}).join(same(removed), [f"__{c}" for c in every.columns], "left_anti").select(*every.columns)
    # Deletions cascade.
    dead = durable(of("delete_locus").select("locus_id").distinct())
    by_end = relationships.join(dead.withColumnRenamed("locus_id", "src"), "src", "left_semi").select("rel_id").unionAll(relationships.join(dead.withColumnRenamed("locus_id", "dst"), "dst", "left_semi").select("rel_id"))
    gone = durable(of("delete_relationship").select("rel_id").unionAll(by_end).distinct())
    told = subscriptions.where("scope = 'Specific'").join(gone, "rel_id", "left_semi").join(dead.withColumnRenamed("locus_id", "subscriber"), "subscriber", "left_anti")
    tombstones = told.join(relationships.select("rel_id", F.col("kind").alias("rel_kind")), "rel_id").select(
        F.lit("Locus").alias("subject_type"), F.col("subscriber").alias("subject_id"), F.col("rel_kind").alias("kind"), F.array().cast("array<bigint>").alias("predecessors"), F.array(F.lit(0.0)).alias("after"), none.cast("bigint").alias("wall_time"),
        F.to_json(F.struct(F.lit(True).alias("tombstone"), "rel_id")).alias("metadata"),
    )
    left = subscriptions.join(gone, "rel_id", "left_anti")
    for column in ("subscriber", "anchor"):
        left = left.join(dead.withColumnRenamed("locus_id", column), column, "left_anti")
    drop = lambda df, c="locus_id": df.join(dead.withColumnRenamed("locus_id", c), c, "left_anti").select(*df.columns)
    pruned = world.pruned_log.unionByName(gone.select("rel_id", F.lit(batch).cast("bigint").alias("batch")))
    tombstones = durable(world.spark.createDataFrame([], PENDING).unionByName(tombstones))
    world = world.with_tables(
        loci=durable(drop(loci)), relationships=durable(relationships.join(gone, "rel_id", "left_anti").select(*relationships.columns)), subscriptions=durable(left.select(*every.columns)), properties=drop(world.properties), names=drop(world.names), pruned_log=durable(pruned)
    )
    return world, tombstones


def apply_interactions(world: World, engine: Engine, batch: int) -> World:
    """Edges between the same loci touched in a batch by kinds that interact: the activity of both takes the factor.

    ``engine.interactions``: (kind, kind) to factor, above 1 synergistic, below 1 antagonistic.
    """
    if not engine.interactions:
        return world
    rules = world.spark.createDataFrame([(min(k), max(k), float(f)) for k, f in engine.interactions.items()], "k1 bigint, k2 bigint, factor double")
    u, v = F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")
    touched = world.relationships.where(F.col("last_decayed_batch") == batch).select(u, v, "kind").distinct()
    pairs = touched.withColumnRenamed("kind", "k1").join(touched.withColumnRenamed("kind", "k2"), ["u", "v"]).where("k1 < k2").join(F.broadcast(rules), ["k1", "k2"])
    per = pairs.select("u", "v", F.explode(F.array("k1", "k2")).alias("kind"), "factor").groupBy("u", "v", "kind").agg(F.product("factor").alias("factor"))
    rows = world.relationships.withColumns({"u": F.least("src", "dst"), "v": F.greatest("src", "dst")}).join(per, ["u", "v", "kind"], "left")
    hit = F.col("factor").isNotNull() & (F.col("last_decayed_batch") == batch)
    state = F.when(hit, F.transform("state", lambda x, i: F.when(i == 0, x * F.col("factor")).otherwise(x))).otherwise(F.col("state"))
    return world.with_tables(relationships=durable(rows.withColumn("state", state).select(*world.relationships.columns)))


# Pair prediction.


def rank_pairs(world: World, signal: str = "strength", kind: int | None = None) -> DataFrame:
    """(a, b, score) of symmetric edges; most likely first."""
    rows = world.edges.where("NOT directed AND src <> dst")
    rows = rows if kind is None else rows.where(F.col("kind") == kind)
    value = {"strength": F.col("activity") + F.col("weight"), "activity": F.col("activity"), "weight": F.col("weight")}[signal]
    return rows.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(value).alias("score"))


def pairs_of_events(events: DataFrame) -> DataFrame:
    """(a, b): pairs that met, from (event_id, member)."""
    one = events.select("event_id", F.col("member").alias("a")).distinct()
    return one.join(one.select("event_id", F.col("a").alias("b")), "event_id").where("a < b").select("a", "b").distinct()


def evaluate_prediction(ranking: DataFrame, observed: DataFrame, k: int, population: int) -> DataFrame:
    """One row: hits among the first k pairs, precision, recall, lift over chance, and loss (1 - precision)."""
    top = ranking.orderBy(F.desc("score"), "a", "b").limit(k)
    hits = top.join(observed.select("a", "b").distinct(), ["a", "b"], "left_semi").count()
    seen, taken = observed.distinct().count(), top.count()
    precision, recall = hits / taken if taken else 0.0, hits / seen if seen else 0.0
    chance = seen / (population * (population - 1) / 2) if population > 1 else 0.0
    row = (hits, precision, recall, precision / chance if chance else 0.0, 1.0 - precision)
    return ranking.sparkSession.createDataFrame([row], "hits bigint, precision double, recall double, lift double, loss double")


@dataclass
class PlasticityLearners:
    """A scale of the learning rate for each kind: up while the prediction does well, down otherwise, in [0.1, 3]."""

    step: float = 0.1
    scales: dict[int, float] = field(default_factory=dict)

    def observe(self, kind: int, precision: float, recall: float, confidence: float = 1.0) -> float:
        signal = (precision + recall) / 2 - 0.5
        self.scales[kind] = min(3.0, max(0.1, self.scales.get(kind, 1.0) * (1 + self.step * confidence * 2 * signal)))
        return self.scales[kind]

    def current(self, kind: int) -> float:
        return self.scales.get(kind, 1.0)

    def reset(self, kind: int | None = None) -> None:
        if kind is None:
            self.scales.clear()
        else:
            self.scales.pop(kind, None)


def kind_flow_diversity() -> Column:
    """Kinds seen over changes, 0 without changes."""
    return F.when(F.col("change_count") > 0, F.size("kinds_observed") / F.col("change_count")).otherwise(0.0)


def kind_transition_rate() -> Column:
    """Changes of kind over changes: one less than the kinds seen, over one less than the changes."""
    return F.when(F.col("change_count") > 1, (F.size("kinds_observed") - 1) / (F.col("change_count") - 1)).otherwise(0.0)


def slot_history(world: World, rel_id: int, index: int, steps: int) -> DataFrame:
    """(change_id, batch, value) of a relationship's slot over its newest changes, oldest first."""
    rows = world.relationship_changes().where(F.col("subject_id") == rel_id).select("change_id", "batch", F.try_element_at("after", F.lit(index + 1)).alias("value"))
    newest = rows.withColumn("__n", F.row_number().over(Window.partitionBy(F.lit(rel_id)).orderBy(F.desc("change_id"))))
    return newest.where(F.col("__n") <= steps).drop("__n").orderBy("change_id")
