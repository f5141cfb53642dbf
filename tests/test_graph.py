import math
import random

import numpy as np
import pytest
from meshlore import durable
from meshlore.functions import vectors as V
from meshlore.operators import causality, centrality, emergence, entities, equivalence, find, topology, traversal
from meshlore.operators.find import EntityPredicate, LocusPredicate, RelationshipPredicate
from meshlore.plans.query import VARIANTS, Query, execute, explain
from meshlore.world import World
from pyspark.sql import functions as F
from worlds import edge, micro


@pytest.fixture(scope="module")
def world(spark):
    return micro(spark).durable("loci", "relationships", "changes")


def ids(df, c="locus_id"):
    return sorted(r[c] for r in df.collect())


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, 2.0], [3.0], None)], "a array<double>, b array<double>, n array<double>")
    got = row.select(
        V.add("a", "b").alias("add"), V.dot("a", "b").alias("dot"), V.euclidean_distance("a", "b").alias("dist"), V.cosine_similarity("a", "b").alias("cos"), V.cosine_similarity("a", "n").alias("zero"),
        V.with_slot("b", 2, 7.0).alias("slot"), V.with_slot_delta("a", 1, 0.5).alias("delta"), V.stabilize("a", "b", 0.25).alias("stab"), V.slot("a", 5).alias("none"), V.dim("n").alias("dim"), V.l2_norm("a").alias("norm"),
    ).first()
    assert got["add"] == [4.0, 2.0] and got["dot"] == 3.0 and got["dist"] == pytest.approx(math.sqrt(8)) and got["cos"] == pytest.approx(3 / (3 * math.sqrt(5))) and got["zero"] == 0
    assert got["slot"] == [3.0, 0.0, 7.0] and got["delta"] == [1.0, 2.5] and got["stab"] == [1.5, 1.5] and got["none"] is None and got["dim"] == 0 and got["norm"] == pytest.approx(math.sqrt(5))


def test_monoids(spark):
    df = spark.createDataFrame([(0.5,), (0.25,), (float("nan"),)], "x double")
    got = df.select("x").agg(V.evidence_max("x").alias("m"), V.evidence_min("x").alias("l")).first()
    clean = df.where("NOT isnan(x)").agg(V.evidence_sum("x").alias("s"), V.evidence_bounded_sum("x", 0.6).alias("b"), V.evidence_probability("x").alias("p")).first()
    assert (got["m"], got["l"]) == (0.5, 0.25) and clean["s"] == 0.75 and clean["b"] == 0.6 and clean["p"] == pytest.approx(1 - 0.5 * 0.75)
    assert df.limit(0).agg(V.evidence_sum("x").alias("s")).first()["s"] == 0


def test_topology(world):
    assert sorted((r.locus_id, r.rel_id) for r in topology.neighbors_of(world, 1).collect()) == [(1, 10), (2, 1), (2, 11)]
    assert ids(topology.isolated_loci(world)) == [9]
    assert {r.locus_id: r.degree for r in topology.degrees(world).collect()}[1] == 3
    assert ids(topology.source_loci(world)) == [] and ids(topology.sink_loci(world)) == [4]
    assert [(r.rel_a, r.rel_b) for r in topology.reciprocal_pairs(world).orderBy("rel_a").collect()] == [(8, 9), (10, 10)]
    assert [tuple(r)[:3] for r in topology.all_triangles(world).collect()] == [(10, 11, 12)]
    assert topology.balance_index(world, 0.0).first()["balance_index"] == 0.0 and topology.unstable_triangles(world, 0.0).count() == 1


def test_traversal(world):
    assert ids(traversal.reachable(world, 1, 2)) == [2, 3] and ids(traversal.reachable(world, 3, 1, "in")) == [2] and ids(traversal.reachable(world, 1, 0)) == []
    assert ids(traversal.reachable(world, 1, 9, "out")) == [2, 3, 4, 5] and ids(traversal.reachable(world, 1, 9, "both", None, 0.5)) == [2]
    assert traversal.shortest_path(world, 5, 1).first()["path"] == [5, 4, 3, 2, 1] and traversal.shortest_path(world, 4, 1, "out").count() == 0
    assert traversal.shortest_path(world, 77, 77).first()["path"] == [77]
    assert traversal.strongest_path(world, 1, 3).first()["cost"] == pytest.approx(1 / 0.9 + 1 / 0.2)
    comp = {r.locus_id: r.component for r in traversal.components(world).collect()}
    assert comp == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 9: 9, 10: 10, 11: 10, 12: 10, 20: 20, 21: 20}
    assert traversal.has_cycle(world) and not traversal.has_cycle(world.with_tables(relationships=world.relationships.where("rel_id < 8")))
    assert traversal.infer_transitive(world, 1, 4, 1, "product") == pytest.approx(0.9 * 0.2 * 0.6) and traversal.infer_transitive(world, 1, 1, 1) is None
    assert ids(traversal.induced_subgraph(world, world.loci.where("locus_id IN (1, 2, 3)")), "rel_id") == [1, 2, 10, 11]


def test_search_by_hops_equals_local_search(world, monkeypatch):
    here = sorted(tuple(r) for r in traversal.reachable(world, 1, 9).collect())
    monkeypatch.setattr(traversal, "LOCAL_STEPS", 0)
    assert sorted(tuple(r) for r in traversal.reachable(world, 1, 9).collect()) == here
    assert causality.causal_depth(world, 3) == 2


def random_world(spark, n=40, m=70, seed=3):
    r = random.Random(seed)
    rels = [edge(i, 1, r.randrange(n), r.randrange(n), round(r.uniform(0.1, 1), 3), round(r.uniform(0, 0.5), 3), r.random() < 0.5) for i in range(m)]
    return World.from_rows(spark, 1, loci=[(i, 1, [0.0]) for i in range(n)], relationships=rels), rels


def brute_distances(n, rels):
    near = {i: set() for i in range(n)}
    for r in rels:
        if r[3] != r[4]:
            near[r[3]].add(r[4])
            near[r[4]].add(r[3])
    out = {}
    for s in range(n):
        d, todo = {s: 0}, [s]
        for x in todo:
            for y in near[x]:
                if y not in d:
                    d[y] = d[x] + 1
                    todo.append(y)
        out[s] = d
    return near, out


def test_closeness_and_betweenness(spark):
    world, rels = random_world(spark)
    near, dist = brute_distances(40, rels)
    got = {r.locus_id: r.score for r in centrality.all_closeness(world).collect()}
    for s in range(40):
        assert got[s] == pytest.approx(sum(1 / d for d in dist[s].values() if d) / 39)
    count = {s: {s: 1} for s in range(40)}
    for s in range(40):
        for x in sorted(dist[s], key=dist[s].get):
            if x != s:
                count[s][x] = sum(count[s][y] for y in near[x] if dist[s].get(y, -9) == dist[s][x] - 1)
    between = {r.locus_id: r.score for r in centrality.all_betweenness(world).collect()}
    for v in range(40):
        total = sum(count[s][v] * count[v][t] / count[s][t] for s in range(40) for t in dist[s] if s != t and v not in (s, t) and v in dist[s] and t in dist[v] and dist[s][v] + dist[v][t] == dist[s][t])
        assert between[v] == pytest.approx(total / (39 * 38))


def test_pagerank_sums_to_one(spark):
    world, _ = random_world(spark)
    scores = [r.score for r in centrality.pagerank(world, iterations=30).collect()]
    assert len(scores) == 40 and sum(scores) == pytest.approx(1.0)


def test_louvain_and_modularity(spark):
    clique = lambda b, i: [edge(i + 10 * x + y, 1, b + x, b + y, 1.0, 0.0, False) for x in range(4) for y in range(x + 1, 4)]
    rels = clique(0, 0) + clique(10, 100) + [edge(999, 1, 0, 10, 0.1, 0.0, False)]
    world = World.from_rows(spark, 1, loci=[(i, 1, [0.0]) for i in [0, 1, 2, 3, 10, 11, 12, 13, 50]], relationships=rels)
    part = centrality.louvain(world)
    assert {r.locus_id: r.community for r in part.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 10: 10, 11: 10, 12: 10, 13: 10, 50: 50}
    m = 2 * 12.1
    want = (2 * 12 - 2 * (12.1**2) / m) / m
    assert centrality.modularity(world, part).first()[0] == pytest.approx(want)
    c = {r.locus_id: r.score for r in centrality.all_constraints(world).collect()}
    assert 50 not in c and c[1] == pytest.approx(c[2]) and c[0] < c[1]
    e = {r.locus_id: r.score for r in centrality.effective_network_size(world).collect()}
    assert e[0] > e[1]


def test_log(world):
    assert ids(causality.causal_ancestors(world, 3), "change_id") == [0, 1, 2] and ids(causality.causal_descendants(world, 0), "change_id") == [1, 2, 3, 5, 6, 7]
    assert causality.causal_depth(world, 3) == 2 and causality.is_ancestor_of(world, 0, 3) and not causality.is_ancestor_of(world, 4, 3)
    assert ids(causality.root_stimuli(world, 3), "change_id") == [0] and causality.root_stimuli(world, 0).count() == 0
    assert ids(causality.common_ancestors(world, 1, 2), "change_id") == [0] and ids(causality.root_stimuli_for_relationship(world, 11), "change_id") == [0]
    assert [r.change_id for r in causality.changes_to(world, "Relationship", 1, 0, 1).collect()] == [6, 5]
    t = causality.trends(world, 0, 2).first()
    assert t["trend"] == "Rising" and t["slope"] == pytest.approx(0.35) and causality.trends(world, 0, 2, parity=True).first()["trend"] == "Falling"
    assert causality.volatility(world).first()["volatility"] == pytest.approx(float(np.std([0.2, 0.4, 0.9])))
    assert {r.subject_id: r.state for r in causality.state_at(world, "Locus", 2).collect()}[1] == [1.0]
    sections = {(r.section, r.id) for r in causality.world_diff(world, 1, 3).collect()}
    assert ("relationship_strengthened", 1) in sections and ("relationship_created", 11) in sections and ("entity_born", 2) in sections
    travel = {(r.action, r.id) for r in causality.time_travel(world, 1).collect()}
    assert ("remove", 11) in travel and ("irrecoverable", 99) in travel and ("approximate", 2) in travel
    g = causality.granger(world, world.spark.createDataFrame([(1, 2), (2, 1), (1, 9)], "cause bigint, effect bigint"), 3)
    assert {(r.cause, r.effect): r.score for r in g.collect()} == {(1, 2): 0.5, (2, 1): 1.0, (1, 9): 0.5}
    trace, truncated = causality.causal_trace(world, 4, 9)
    assert {(r.change_id, r.depth) for r in trace.collect()} == {(3, 0), (1, 1), (2, 1), (0, 2)} and not truncated


def test_trimmed_log(world):
    cut = world.with_tables(changes=world.changes.where("change_id > 0"), trim_summaries=world.spark.createDataFrame([(2, 0, 0, 1, [1.0], [1])], world.trim_summaries.schema))
    assert ids(causality.causal_ancestors(cut, 3), "change_id") == [1, 2]
    fine, coarse = causality.causal_coarse_trail(cut, 3)
    assert ids(coarse) == [2] and causality.causal_trace(cut, 4, 9)[1]


def test_counterfactual(world):
    q = causality.CounterfactualQuery(world).with_stimuli([0])
    assert ids(q.relationships_absent_without(), "rel_id") == [11] and ids(q.relationships_caused(), "rel_id") == [1, 11]
    replay = {(r.what, r.id) for r in q.replay().collect()}
    assert ("divergence_batch", 0) in replay and ("absent_relationship", 11) in replay
    assert ids(causality.CounterfactualQuery(world).stimuli_from_batch(3).suppressed(), "change_id") == [4, 8]


def test_find(world):
    assert ids(find.find_relationships(world, [RelationshipPredicate.activity_above(0.6)]), "rel_id") == [1, 8, 9]
    assert [r.rel_id for r in find.find_relationships(world, [RelationshipPredicate.of_kind(1)], "strength", 2).collect()] == [8, 1]
    assert ids(find.find_loci(world, [LocusPredicate.str_property_eq("name", "two")])) == [2] and ids(find.find_loci(world, [LocusPredicate.f64_property_above("confidence", 0.5)])) == [1, 2]
    assert ids(find.find_loci(world, [LocusPredicate.downstream_of(1, 1), LocusPredicate.of_kind(1)])) == [2]
    assert ids(find.find_entities(world, [EntityPredicate.has_member(1)]), "entity_id") == [1]
    assert find.loci(world, [1, 2, 777]).ids() == [1, 2] or sorted(find.loci(world, [1, 2, 777]).ids()) == [1, 2]
    q = find.loci(world).of_kind(1).where_state(0, lambda c: c <= 2).outgoing_relationships()
    assert sorted(q.ids()) == [1, 2, 10, 11] and sorted(q.target_loci().ids()) == [1, 2, 3]
    assert sorted(find.entities(world).active().member_loci().ids()) == [1, 2, 3] and find.entities(world).born_in_range(1).ids() == [2] and find.entities(world).with_min_layer_count(2).ids() == [1]
    assert find.coheres(world, "other").ids() == [2] and find.coheres(world).with_min_entity_count(2).ids() == [1]
    p = find.relationship_profile(world, 1, 2).orderBy("kind").collect()
    assert [(r.kind, r.edges, round(r.net_influence, 6)) for r in p] == [(1, 1, 0.9), (2, 1, 0.1)]
    assert find.net_activity_with_interactions(world, 1, 2, {(1, 2): ("synergistic", 2.0)}) == pytest.approx(2.0)
    assert [r.rel_id for r in find.most_similar_relationships(world, 8, 1).collect()] == [3]
    m = find.world_metrics(world).first()
    assert (m["relationships"], m["loci"], m["components"], m["active_entities"]) == (11, 11, 4, 1)


def test_metrics_make_no_more_than_was_asked_for(world, monkeypatch):
    """Some columns are those of the whole row, without components and without edges written out."""
    whole = find.world_metrics(world).first().asDict()
    degree = {r.locus_id: r.degree for r in topology.degrees(world).collect()}
    activity = [r.activity for r in world.edges.collect()]
    assert whole["max_degree"] == max(degree.values()) and whole["mean_degree"] == pytest.approx(sum(degree.values()) / len(degree))
    assert (whole["total_activity"], whole["max_activity"], whole["mean_activity"]) == pytest.approx((sum(activity), max(activity), sum(activity) / len(activity)))
    assert [tuple(r) for r in whole["top_loci_by_degree"]] == sorted(degree.items(), key=lambda x: (-x[1], x[0]))[:10]
    kept, stored = [], find.stored
    monkeypatch.setattr(traversal, "components", None)
    monkeypatch.setattr(find, "stored", lambda df: kept.append(df.columns) or stored(df))
    some = ["max_degree", "relationships", "total_activity", "changes"]
    assert find.world_metrics(world, some).first().asDict() == pytest.approx({k: whole[k] for k in some})
    assert not any("rel_id" in columns for columns in kept)


def test_entities_and_boundary(world):
    assert {(r.entity_id, r.batch) for r in entities.layers_at(world, 2).collect()} == {(1, 0), (2, 1)}
    d = entities.entity_deviations_since(world, 1).first()
    assert (d["entity_id"], d["coherence_at_baseline"], d["coherence_now"], d["layers_since"]) == (1, 0.4, 0.6, 1)
    report = entities.boundary(world, 0.1)
    status = {(r.status, r.fact_id, r.rel_id) for r in report.collect()}
    assert ("confirmed", 0, 1) in status and ("ghost", 1, None) in status and ("shadow", None, 2) in status and not any(s[1] == 2 for s in status)
    actions = entities.prescribe_updates(world, report, min_ghost_age=3)
    assert [(r.action, r.fact_id) for r in actions.where("action = 'retract'").collect()] == [("retract", 1)]
    after = entities.apply_prescriptions(world, actions)
    assert entities.facts_at(after).where("predicate = 'inferred_influence'").count() == actions.where("action = 'assert'").select("subject", "object").distinct().count()
    more = entities.retract_fact(entities.assert_fact(world, 4, "feeds", 5), 0)
    assert ids(entities.facts_at(more), "fact_id") == [1, 3] and entities.version(more) == 6
    old = entities.weather_entities(world, 300)
    assert {r.compression for r in old.entity_layers.collect()} == {"Skeleton"}
    assert entities.layer_tension(world, {"feeds": 1}).first()["confirmed"] == 1


def test_equivalence(spark):
    rels = [edge(i, 1, 0, i, 0.5) for i in range(1, 5)]
    world = World.from_rows(spark, 1, loci=[(i, 1, [0.0]) for i in range(6)], relationships=rels)
    part = {r.locus_id: r.block for r in equivalence.behavioral_partition(world, None).collect()}
    assert part == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 5} and equivalence.behaviorally_equivalent(world, 1, 4)
    d = {(r.a, r.b): r.distance for r in equivalence.behavioral_distances(world, 3).collect()}
    assert d[1, 2] == 0 and d[0, 0] == 0 and d[0, 5] == pytest.approx(0.9) and all(d[a, b] == pytest.approx(d[b, a]) for a, b in d)


def test_emergence(spark):
    r = random.Random(1)
    log, c = [], 0
    for b in range(12):
        for rel in (1, 2, 3):
            log.append((c, "Relationship", rel, 1, [], [], [round(r.random(), 3)], b))
            c += 1
    world = World.from_rows(spark, 12, loci=[(i, 1, [0.0]) for i in range(3)], relationships=[edge(1, 1, 0, 1), edge(2, 1, 1, 2), edge(3, 1, 0, 2)], changes=log, entities=[(1, "Active", [0, 1, 2], [1, 2, 3], 0.5), (2, "Dormant", [0], [1], 0.1), (3, "Active", [0], [], 0.1)])
    dense = {r.batch: r.coherence for r in emergence.coherence_dense_series(world).where("entity_id = 1").collect()}
    first = [x[6][0] for x in log if x[7] == 0]
    assert dense[0] == pytest.approx(sum(first) / 3 * min(1, 3 / (3 * math.log(4) / 2)))
    report = {x.entity_id: x for x in emergence.emergence_report(world).collect()}
    assert report[1].verdict in ("emergent", "spurious") and report[2].verdict == "unmeasured: dormant" and report[3].verdict.startswith("unmeasured")
    v = np.array([dense[b] for b in range(12)])
    mi = lambda x, y: -0.5 * math.log(1 - np.corrcoef(x, y)[0, 1] ** 2)
    parts = [np.array([x[6][0] for x in log if x[2] == k]) for k in (1, 2, 3)]
    assert report[1].psi == pytest.approx(mi(v[:-1], v[1:]) - sum(mi(p[:-1], v[1:]) for p in parts))
    assert emergence.emergence_report(world, leave_one_out=True).where("dropped IS NOT NULL").count() == 3
    assert "emergent" in emergence.render_markdown(emergence.emergence_report(world)) or "spurious" in emergence.render_markdown(emergence.emergence_report(world))


ARGS = {
    "PathBetween": {"source": 1, "target": 4}, "PathBetweenOfKind": {"source": 1, "target": 4, "kind": 1}, "DirectedPath": {"source": 1, "target": 4}, "ReachableFrom": {"start": 1, "depth": 2}, "DownstreamOf": {"start": 1, "depth": 2},
    "UpstreamOf": {"start": 4, "depth": 2}, "ConnectedComponentsOfKind": {"kind": 1}, "ReachableFromActive": {"start": 1, "depth": 2, "min_activity": 0.1}, "DownstreamOfActive": {"start": 1, "depth": 2, "min_activity": 0.1},
    "UpstreamOfActive": {"start": 4, "depth": 2, "min_activity": 0.1}, "PathBetweenActive": {"source": 1, "target": 4, "min_activity": 0.1}, "NeighborsOf": {"locus": 1}, "HubLoci": {"min_degree": 2}, "ReciprocOf": {"rel_id": 8},
    "StrongestPath": {"source": 1, "target": 4}, "PageRank": {"iterations": 2}, "PageRankFor": {"locus": 1, "iterations": 2}, "BetweennessFor": {"locus": 1}, "ClosenessFor": {"locus": 1}, "ConstraintFor": {"locus": 1}, "LouvainWithResolution": {"resolution": 0.5},
    "CausalAncestors": {"target": 3}, "CausalDescendants": {"root": 0}, "CausalDepth": {"target": 3}, "IsAncestorOf": {"ancestor": 0, "descendant": 3}, "RootStimuli": {"target": 3}, "ChangesToLocusInRange": {"locus": 1, "first": 0, "last": 9},
    "ChangesToRelationshipInRange": {"rel_id": 1, "first": 0, "last": 9}, "LociChangedInBatch": {"batch": 1}, "RelationshipsChangedInBatch": {"batch": 1}, "FindLoci": {"predicates": [["of_kind", [1]]], "sort": ["state", 0], "limit": 3},
    "FindRelationships": {"predicates": [["touching", [1]]], "sort": "activity", "limit": 3}, "FindEntities": {"predicates": [["min_members", [2]]]}, "LocusStateSlot": {"locus": 1, "slot": 0}, "RelationshipProfile": {"a": 1, "b": 2},
    "ActivityTrend": {"rel_id": 1, "first": 0, "last": 9}, "EntityDeviationsSince": {"baseline": 1}, "RelationshipsAbsentWithout": {"changes": [0]}, "CoheresNamed": {"perspective": "other"}, "CausalDirection": {"a": 20, "b": 21, "kind": 1},
    "DominantCauses": {"locus": 21, "kind": 1, "n": 3}, "DominantEffects": {"locus": 21, "kind": 1, "n": 3}, "CausalInStrength": {"locus": 21, "kind": 1}, "CausalOutStrength": {"locus": 21, "kind": 1}, "FeedbackPairs": {"kind": 1, "min_weight": 0.1, "min_balance": 0.5},
    "GrangerScore": {"cause": 1, "effect": 2, "lag": 2}, "GrangerDominantCauses": {"locus": 2, "kind": 1, "lag": 2, "n": 3}, "GrangerDominantEffects": {"locus": 1, "kind": 1, "lag": 2, "n": 3}, "TimeTravel": {"target": 1}, "CounterfactualReplay": {"changes": [0]},
    "EntityTransitionCause": {"entity": 1, "batch": 4}, "EntityUpstreamTransitions": {"entity": 1, "batch": 4}, "EntityLayersInRange": {"entity": 1, "first": 0, "last": 4},
}


def test_there_are_64_variants():
    assert len(VARIANTS) == 64


@pytest.mark.parametrize("variant", sorted(VARIANTS))
def test_every_variant_runs(world, variant):
    query = Query.from_json(Query(variant, ARGS.get(variant, {})).to_json())
    assert execute(world, query).count() >= 0
    assert variant in str(explain(query))


def test_explain_with_plan(world):
    plan = explain(Query("FindRelationships", ARGS["FindRelationships"]), world)
    assert "TakeOrderedAndProject" in plan.physical and [s.cost for s in plan.steps] == ["scan", "pushed to the scan", "top k"]


def test_empty_world(spark):
    world = World.of(spark)
    for variant, args in ARGS.items():
        if variant not in ("TimeTravel",):
            execute(world, Query(variant, args)).count()
    assert find.world_metrics(world).first()["components"] == 0 and F is not None


@pytest.mark.parametrize(("variant", "more"), [("DirectedPath", {}), ("PathBetween", {}), ("PathBetweenActive", {"min_activity": 0.3})])
def test_equal_paths_by_their_text(spark, variant, more):
    """As their SQL, which orders paths joined with hyphens: 5-10-3 comes before 5-9-3, and 5-10-3 before 5-100-3."""
    ends = [(5, 9), (9, 3), (5, 100), (100, 3), (5, 10), (10, 3)]
    world = World.from_rows(spark, 1, loci=[(i, 1, [0.0]) for i in (3, 5, 9, 10, 100)], relationships=[edge(i, 1, a, b) for i, (a, b) in enumerate(ends)])
    assert execute(world, Query(variant, {"source": 5, "target": 3, **more})).first()["path"] == [5, 10, 3]


def test_trend_at_the_threshold_is_stable(spark):
    """As the SQL, which rounds slopes to six places first: 29.32 - 29.27 is 0.05 and some bits."""
    log = [(i, "Relationship", r, 1, [], [], [v], i) for i, (r, v) in enumerate([(1, 29.27), (1, 29.32), (2, 29.32), (2, 29.27), (3, 29.27), (3, 29.33), (4, 1.0)])]
    got = {r.rel_id: r.trend for r in causality.trends(World.from_rows(spark, 9, changes=log), 0, 9).collect()}
    assert got == {1: "Stable", 2: "Stable", 3: "Rising", 4: "Insufficient"}


@pytest.mark.parametrize("tiled", [True, False])
def test_shares_by_tiles_and_by_triangles(spark, tiled, monkeypatch):
    """Constraint and effective size against their definition, with loops, negative totals and more loci than a tile has."""
    monkeypatch.setattr(centrality, "TILE", 4)
    monkeypatch.setattr(centrality, "_many_wedges", lambda p: tiled)
    draw = random.Random(5)
    ends = sorted({tuple(sorted((draw.randrange(18) * 7, draw.randrange(18) * 7))) for _ in range(90)})
    rels = [edge(i, 3, a, b, draw.choice([0.25, 0.5, -0.75]), 0.125, False) for i, (a, b) in enumerate(ends)]
    near: dict = {}
    for _, _, _, a, b, (x, y), *_ in rels:
        for u, v in {(a, b), (b, a)}:
            near.setdefault(u, {}).setdefault(v, 0.0)
            near[u][v] += x + y
    total = {i: sum(row.values()) for i, row in near.items()}
    assert any(i in row for i, row in near.items()) and any(t < 0 for t in total.values()) and len(near) > 8
    p = {i: {j: s / total[i] for j, s in row.items()} for i, row in near.items() if total[i]}
    via = lambda i, j: sum(x * p[q].get(j, 0.0) for q, x in p[i].items() if q != j and total[q] > 0)
    world = World.from_rows(spark, 1, loci=[(i, 1, [0.0]) for i in near], relationships=rels)
    assert {r.locus_id: r.score for r in centrality.all_constraints(world).collect()} == pytest.approx({i: sum((x + via(i, j)) ** 2 for j, x in row.items()) for i, row in p.items()})
    assert {r.locus_id: r.score for r in centrality.effective_network_size(world).collect()} == pytest.approx({i: len(row) - sum(via(i, j) for j in row if j != i) for i, row in p.items()})


def test_all_similar_relationships_without_a_top_k(spark, world, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    few, every = find.most_similar_relationships(world, 8, 3), find.most_similar_relationships(world, 8)
    assert "TakeOrdered" in plan(few) and "TakeOrdered" not in plan(every) and every.count() == world.relationships.count() - 1
    monkeypatch.setattr(find, "BROADCAST_ROWS", 2)
    many = find.most_similar_relationships(world, 8, 3)
    assert "TakeOrdered" not in plan(many) and [tuple(r) for r in many.collect()] == [tuple(r) for r in few.collect()]


def test_closure_in_blocks(spark, monkeypatch):
    """Against plain search: steps in any order, and a chain whose hops are many more than the rounds."""
    monkeypatch.setattr(traversal, "LOCAL_STEPS", 40)
    rounds, search = [], traversal._local_search
    monkeypatch.setattr(traversal, "_local_search", lambda *args: rounds.append(1) or search(*args))
    draw = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 300)]
    for steps, starts in ((chain, [150]), ([(draw.randrange(90), draw.randrange(90)) for _ in range(110)], [7, 200])):
        want, todo = set(starts), list(starts)
        while todo:
            a = todo.pop()
            for b in {y for x, y in steps if x == a} - want:
                want.add(b)
                todo.append(b)
        rounds.clear()
        got = traversal.closure(spark.createDataFrame(steps, "a bigint, b bigint"), spark.createDataFrame([(s,) for s in starts], "node bigint"))
        assert sorted(r.node for r in got.collect()) == sorted(want) and rounds
        assert steps is not chain or len(rounds) < 12


def test_closure_searches_a_block_of_a_log_once(spark, monkeypatch):
    """A block is searched after all that lead into it; ends that nothing goes on from are handed to none."""
    monkeypatch.setattr(traversal, "LOCAL_STEPS", 40)
    seeds, search = [], traversal._local_search
    monkeypatch.setattr(traversal, "_local_search", lambda steps, starts, depth: seeds.append(starts.distinct().count()) or search(steps, starts, depth))
    log = [(i, j) for i in range(100, 300) for j in (i + 1, i + 50, i + 1000)]
    start = spark.createDataFrame([(110,)], "node bigint")
    for steps, first in ((log, 110), ([(-a, -b) for a, b in log], -110)):
        want, todo = {first}, [first]
        while todo:
            a = todo.pop()
            for b in {y for x, y in steps if x == a} - want:
                want.add(b)
                todo.append(b)
        seeds.clear()
        got = traversal.closure(spark.createDataFrame(steps, "a bigint, b bigint"), start if first > 0 else start.selectExpr("-node AS node"))
        assert sorted(r.node for r in got.collect()) == sorted(want)
        assert 10 < len(seeds) <= 15 and sum(seeds) < len(want) - 190


def test_absent_relationships_in_blocks_of_the_log(spark, world, monkeypatch):
    """The same edges are absent, and each block is searched once at most, when the log is more than a task takes."""
    query = lambda: causality.CounterfactualQuery(world).with_stimuli([r.change_id for r in world.changes.where(F.size("predecessors") == 0).collect()])
    absent, caused = query().relationships_absent_without().collect(), query().relationships_caused().collect()
    searches, search = [], traversal._local_search
    monkeypatch.setattr(traversal, "_local_search", lambda *args: searches.append(1) or search(*args))
    monkeypatch.setattr(traversal, "LOCAL_STEPS", 1)
    assert sorted(query().relationships_absent_without().collect()) == sorted(absent) and absent
    assert 1 < len(searches) <= world.change_edges.select("pred").distinct().count()
    assert sorted(query().relationships_caused().collect()) == sorted(caused)


def test_rounds_of_components_leave_one_table(spark, monkeypatch):
    """What a round made is deleted once the next has been written, so disk doesn't grow with the rounds."""
    kept, forgotten, stored, forget = [], [], traversal.stored, traversal.forget
    monkeypatch.setattr(traversal, "stored", lambda df: kept.append(stored(df)) or kept[-1])
    monkeypatch.setattr(traversal, "forget", lambda df: forgotten.append(df._stored) or forget(df))
    world = World.from_rows(spark, 1, loci=[(i, 1, [0.0]) for i in range(40)], relationships=[edge(i, 1, i, i + 1) for i in range(30)])
    got = {r.locus_id: r.component for r in traversal.components(world).collect()}
    assert got == {i: 0 if i < 31 else i for i in range(40)}
    assert len(kept) > 2 and {df._stored for df in kept} - set(forgotten) == {kept[-1]._stored}


@pytest.mark.parametrize(("listed", "long"), [(0.0, 100), (0.0, 0), (1e9, 100)])
def test_products_of_sparse_tiles_go_through_lists(monkeypatch, listed, long):
    """Few entries in many tiles: both ways give the product of the whole matrices at its entries, lists without a dense tile."""
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(centrality, "TILE", 4)
    monkeypatch.setattr(centrality, "LISTED", listed)
    monkeypatch.setattr(centrality, "SPAN", 3)
    monkeypatch.setattr(centrality, "LONG", long)
    monkeypatch.setattr(centrality, "_listed" if listed else "_dense", None)  # that way isn't taken
    draw = np.random.default_rng(7)
    there = draw.random((14, 14)) < 0.3
    there |= there.T
    p, positive = there * draw.normal(size=(14, 14)), there * draw.random((14, 14)) * (1 - np.eye(14))
    table = pd.DataFrame([(int(x) // 4, int(y) // 4, x % 4, y % 4, p[x, y], positive[x, y], x) for x, y in np.argwhere(there)], columns=["a", "b", "x", "y", "p", "p_positive", "i"])
    tiles = pd.concat([centrality._pack(t) for _, t in table.groupby(["a", "b"])])
    held: dict = {}
    for q, b, tile in tiles[tiles["b"].isin([1, 3])][["a", "b", "tile"]].itertuples(index=False):
        x, y, _, second, _ = centrality._unpack(tile)
        held.setdefault(q, []).append((b, x, y, second))
    got = pd.concat(list(centrality._products(iter([tiles]), centrality._Held(held)))).groupby("i")[["n", "c", "r"]].sum()
    inside = there & np.isin(np.arange(14) // 4, [1, 3])
    via = p @ positive
    want = pd.DataFrame({"n": inside.sum(1), "c": ((p + via) ** 2 * inside).sum(1), "r": (via * inside * (1 - np.eye(14))).sum(1)})
    assert np.allclose(got, want.loc[got.index]) and not want.drop(got.index).to_numpy().any()


def test_tiles_are_moved_once_a_round(spark, monkeypatch):
    """Products join no tiles with tiles: a round deals each tile of a row once, and the sums are those of a single round."""
    monkeypatch.setattr(centrality, "TILE", 4)
    monkeypatch.setattr(centrality, "_many_wedges", lambda p: True)
    dealt, spread = [], centrality.spread
    monkeypatch.setattr(centrality, "spread", lambda df, *by: dealt.append(df.count()) or spread(df, *by))
    world = World.from_rows(spark, 1, relationships=[edge(100 * a + b, 3, a, b, 0.25 + (a * b) % 5, 0.125, False) for a in range(18) for b in range(a, 18) if (a + b) % 3])
    scores = lambda: {r.locus_id: r.score for r in centrality.all_constraints(world).collect()}
    one = scores()
    assert dealt == [25]  # five by five tiles
    monkeypatch.setattr(centrality, "COLUMNS", 2)
    assert scores() == pytest.approx(one) and dealt[1:] == [25, 25, 25]


def test_louvain_moves_as_one_by_one(spark, monkeypatch, tmp_path):
    """Against plain moving with every locus looked at in every pass; edges in any order, parallel ones too; without components."""
    draw = random.Random(11)
    ends = [tuple(draw.sample(range(12 * b, 12 * b + 12), 2)) if draw.random() < 0.7 else tuple(draw.sample(range(60), 2)) for b in range(5) for _ in range(45)]
    edges = [(a * 1000, b * 1000, draw.choice([0.1, 0.2, 0.7])) for a, b in ends]
    ids = np.unique([x[:2] for x in edges])

    def plain(resolution):
        near = {int(i): {} for i in ids}
        for a, b, w in edges:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
        degree = {i: sum(x.values()) for i, x in near.items()}
        group, held, total, moved = {i: i for i in near}, dict(degree), sum(degree.values()), True
        while moved:
            moved = False
            for i in near:
                toward = {group[i]: 0.0}
                for j, w in near[i].items():
                    toward[group[j]] = toward.get(group[j], 0.0) + w
                now = best = group[i]
                most = toward[now] - resolution * degree[i] * (held[now] - degree[i]) / total
                for c in sorted(toward):
                    if c != now and (score := toward[c] - resolution * degree[i] * held[c] / total) > most + 1e-12:
                        best, most = c, score
                if best != now:
                    held[now], held[best], group[i], moved = held[now] - degree[i], held[best] + degree[i], best, True
        least = {}
        for i, c in group.items():
            least[c] = min(i, least.get(c, i))
        return {i: least[c] for i, c in group.items()}

    monkeypatch.setattr(traversal, "components", None)
    world = World.from_rows(spark, 1, loci=[(7, 1, [0.0])], relationships=[edge(i, 1, a, b, w, 0.0, False) for i, (a, b, w) in enumerate(edges)])
    n = np.unique([x[:2] for x in edges], return_counts=True)[1]
    for resolution in (0.5, 1.0, 2.0):
        want = plain(resolution)
        assert {r.locus_id: r.community for r in centrality.louvain(world, resolution).collect()} == want | {7: 7}
        for places in (centrality.PLACES, 0):
            monkeypatch.setattr(centrality, "PLACES", places)
            draw.shuffle(edges)
            arcs = centrality.arcs_on_disk(([np.array(x) for x in zip(*edges[k : k + 9], strict=True)] for k in range(0, len(edges), 9)), ids, n, str(tmp_path), rows=30)
            group = centrality.settled(*arcs, resolution)
            assert len(set(zip(group, want.values(), strict=True))) == len(set(want.values())) == len(set(group))


def test_stored_leaves_no_shuffles(spark):
    """What a write shuffled is deleted with its end, not when the driver happens to collect garbage; later queries keep theirs."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllBlocks()
        names = (str(found.apply(i)) for i in range(found.size()))
        return {x for x in names if x.startswith("shuffle_")}

    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before = files()
    kept = durable.stored(df)
    assert not files() - before and spark.conf.get(durable.CLEANUP, "false") == "false"
    assert sorted(r["count"] for r in kept.collect()) == [142] + [143] * 6
    df.collect()
    assert files() - before
