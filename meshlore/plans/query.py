"""Serializable queries: one value names an operator and its arguments, ``execute`` runs it, ``explain`` tells how."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import causality, centrality, entities, find, topology, traversal
from ..operators.find import EntityPredicate, LocusPredicate, RelationshipPredicate
from ..world import World


@dataclass(frozen=True)
class Query:
    """A variant and its arguments; predicates are (name, arguments) pairs, so it can be written as JSON."""

    variant: str
    args: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"variant": self.variant, "args": self.args}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Query:
        d = json.loads(text)
        return cls(d["variant"], d["args"])


@dataclass(frozen=True)
class PlanStep:
    stage: str
    cost: str


@dataclass(frozen=True)
class QueryPlan:
    query: Query
    steps: tuple[PlanStep, ...]
    physical: str | None = None

    def __str__(self) -> str:
        lines = [f"{self.query.variant}"] + [f"  {i}. {s.stage} [{s.cost}]" for i, s in enumerate(self.steps, 1)]
        return "\n".join(lines + ([self.physical] if self.physical else []))


def _predicates(kind, given) -> list:
    return [getattr(kind, name)(*args) for name, args in given or []]


def _one(world: World, name: str, value, kind: str) -> DataFrame:
    return world.spark.createDataFrame([(value,)], f"{name} {kind}")


def _scores(df: DataFrame, ascending: bool = False) -> DataFrame:
    return df.orderBy(F.col("score").asc() if ascending else F.col("score").desc(), "locus_id")


def _for(df: DataFrame, locus: int) -> DataFrame:
    return df.where(F.col("locus_id") == locus)


Run = Callable[..., DataFrame]

#: Every variant: what runs it, and the class of its cost.
VARIANTS: dict[str, tuple[Run, str]] = {
    "PathBetween": (lambda w, source, target: traversal.shortest_path(w, source, target), "hops"),
    "PathBetweenOfKind": (lambda w, source, target, kind: traversal.shortest_path(w, source, target, kind=kind), "hops"),
    "DirectedPath": (lambda w, source, target: traversal.shortest_path(w, source, target, "out"), "hops"),
    "ReachableFrom": (lambda w, start, depth: traversal.reachable(w, start, depth), "hops"),
    "DownstreamOf": (lambda w, start, depth: traversal.reachable(w, start, depth, "out"), "hops"),
    "UpstreamOf": (lambda w, start, depth: traversal.reachable(w, start, depth, "in"), "hops"),
    "ConnectedComponents": (lambda w: traversal.components(w), "rounds"),
    "ConnectedComponentsOfKind": (lambda w, kind: traversal.components(w, kind), "rounds"),
    "ReachableFromActive": (lambda w, start, depth, min_activity: traversal.reachable(w, start, depth, "both", None, min_activity), "hops"),
    "DownstreamOfActive": (lambda w, start, depth, min_activity: traversal.reachable(w, start, depth, "out", None, min_activity), "hops"),
    "UpstreamOfActive": (lambda w, start, depth, min_activity: traversal.reachable(w, start, depth, "in", None, min_activity), "hops"),
    "PathBetweenActive": (lambda w, source, target, min_activity: traversal.shortest_path(w, source, target, min_activity=min_activity), "hops"),
    "NeighborsOf": (lambda w, locus: topology.neighbors_of(w, locus), "scan"),
    "IsolatedLoci": (lambda w: topology.isolated_loci(w), "join"),
    "HubLoci": (lambda w, min_degree: topology.hub_loci(w, min_degree), "aggregate"),
    "ReciprocOf": (lambda w, rel_id: topology.reciprocal_of(w, rel_id), "join"),
    "ReciprocPairs": (lambda w: topology.reciprocal_pairs(w).select(F.explode(F.array("rel_a", "rel_b")).alias("rel_id")), "join"),
    "HasCycle": (lambda w: _one(w, "value", traversal.has_cycle(w), "boolean"), "rounds"),
    "StrongestPath": (lambda w, source, target: traversal.strongest_path(w, source, target), "rounds"),
    "PageRank": (lambda w, **k: _scores(centrality.pagerank(w, **k)), "rounds"),
    "PageRankFor": (lambda w, locus, **k: _for(centrality.pagerank(w, **k), locus), "rounds"),
    "AllBetweenness": (lambda w: _scores(centrality.all_betweenness(w)), "all sources"),
    "BetweennessFor": (lambda w, locus: _for(centrality.all_betweenness(w), locus), "all sources"),
    "AllCloseness": (lambda w: _scores(centrality.all_closeness(w)), "all sources"),
    "ClosenessFor": (lambda w, locus: centrality.closeness_for(w, locus), "hops"),
    "AllConstraints": (lambda w: _scores(centrality.all_constraints(w)), "triangles"),
    "ConstraintFor": (lambda w, locus: centrality.constraint_for(w, locus), "two-hop join"),
    "Louvain": (lambda w: centrality.louvain(w), "components"),
    "LouvainWithResolution": (lambda w, resolution: centrality.louvain(w, resolution), "components"),
    "Modularity": (lambda w, resolution=1.0: centrality.modularity(w, centrality.louvain(w, resolution)), "components"),
    "CausalAncestors": (lambda w, target: causality.causal_ancestors(w, target), "hops"),
    "CausalDescendants": (lambda w, root: causality.causal_descendants(w, root), "hops"),
    "CausalDepth": (lambda w, target: _one(w, "value", causality.causal_depth(w, target), "int"), "hops"),
    "IsAncestorOf": (lambda w, ancestor, descendant: _one(w, "value", causality.is_ancestor_of(w, ancestor, descendant), "boolean"), "hops"),
    "RootStimuli": (lambda w, target: causality.root_stimuli(w, target), "hops"),
    "ChangesToLocusInRange": (lambda w, locus, first, last: causality.changes_to(w, "Locus", locus, first, last), "scan"),
    "ChangesToRelationshipInRange": (lambda w, rel_id, first, last: causality.changes_to(w, "Relationship", rel_id, first, last), "scan"),
    "LociChangedInBatch": (lambda w, batch: causality.changed_in_batch(w, "Locus", batch), "aggregate"),
    "RelationshipsChangedInBatch": (lambda w, batch: causality.changed_in_batch(w, "Relationship", batch), "aggregate"),
    "FindLoci": (lambda w, predicates=(), sort=None, limit=None: find.find_loci(w, _predicates(LocusPredicate, predicates), tuple(sort) if isinstance(sort, list) else sort, limit), "scan"),
    "FindRelationships": (lambda w, predicates=(), sort=None, limit=None: find.find_relationships(w, _predicates(RelationshipPredicate, predicates), sort, limit), "scan"),
    "FindEntities": (lambda w, predicates=(), sort=None, limit=None: find.find_entities(w, _predicates(EntityPredicate, predicates), sort, limit), "scan"),
    "LocusStateSlot": (lambda w, locus, slot: w.loci.where(F.col("locus_id") == locus).select(F.try_element_at("state", F.lit(slot + 1)).alias("value")), "scan"),
    "RelationshipProfile": (lambda w, a, b: find.relationship_profile(w, a, b), "scan"),
    "ActivityTrend": (lambda w, rel_id, first, last, threshold=0.05: causality.trends(w, first, last, threshold).where(F.col("rel_id") == rel_id), "window"),
    "EntityDeviationsSince": (lambda w, baseline: entities.entity_deviations_since(w, baseline), "join"),
    "RelationshipsAbsentWithout": (lambda w, changes: causality.CounterfactualQuery(w).with_stimuli(changes).relationships_absent_without(), "hops"),
    "Coheres": (lambda w: find.coheres(w, "default").rows, "scan"),
    "CoheresNamed": (lambda w, perspective: find.coheres(w, perspective).rows, "scan"),
    "WorldMetrics": (lambda w: find.world_metrics(w), "rounds"),
    "CausalDirection": (lambda w, a, b, kind: causality.causal_direction(w, a, b, kind), "scan"),
    "DominantCauses": (lambda w, locus, kind, n: causality.dominant(w, locus, kind, n, True), "scan"),
    "DominantEffects": (lambda w, locus, kind, n: causality.dominant(w, locus, kind, n, False), "scan"),
    "CausalInStrength": (lambda w, locus, kind: causality.causal_strength(w, locus, kind, True), "scan"),
    "CausalOutStrength": (lambda w, locus, kind: causality.causal_strength(w, locus, kind, False), "scan"),
    "FeedbackPairs": (lambda w, kind, min_weight, min_balance: causality.feedback_pairs(w, kind, min_weight, min_balance), "join"),
    "GrangerScore": (lambda w, cause, effect, lag: causality.granger(w, w.spark.createDataFrame([(cause, effect)], "cause bigint, effect bigint"), lag), "join"),
    "GrangerDominantCauses": (lambda w, locus, kind, lag, n: causality.granger_dominant(w, locus, kind, lag, n, True), "join"),
    "GrangerDominantEffects": (lambda w, locus, kind, lag, n: causality.granger_dominant(w, locus, kind, lag, n, False), "join"),
    "TimeTravel": (lambda w, target: causality.time_travel(w, target), "join"),
    "CounterfactualReplay": (lambda w, changes: causality.CounterfactualQuery(w).with_stimuli(changes).replay(), "hops"),
    "EntityTransitionCause": (lambda w, entity, batch: entities.entity_transition_cause(w, entity, batch), "window"),
    "EntityUpstreamTransitions": (lambda w, entity, batch: entities.entity_upstream_transitions(w, entity, batch), "hops"),
    "EntityLayersInRange": (lambda w, entity, first, last: entities.layers_in_range(w, entity, first, last), "scan"),
}


def execute(world: World, query: Query) -> DataFrame:
    return VARIANTS[query.variant][0](world, **query.args)


def explain(query: Query, world: World | None = None) -> QueryPlan:
    """The query's stages and their cost classes; with a world also Spark's plan (hops and rounds run to make it)."""
    cost = VARIANTS[query.variant][1]
    steps = [PlanStep(f"predicate {name}({', '.join(map(str, args))})", "pushed to the scan" if name not in ("min_degree", "reachable_from", "downstream_of", "upstream_of") else "semi join") for name, args in query.args.get("predicates", ())]
    if query.args.get("sort"):
        steps.append(PlanStep(f"sort by {query.args['sort']}" + (f", first {query.args['limit']}" if query.args.get("limit") else ""), "top k" if query.args.get("limit") else "range sort"))
    elif query.args.get("limit"):
        steps.append(PlanStep(f"first {query.args['limit']}", "limit"))
    physical = execute(world, query)._jdf.queryExecution().explainString(world.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")) if world is not None else None
    return QueryPlan(query, (PlanStep(query.variant, cost), *steps), physical)
