"""Rules of the engine on small worlds, with the values that the model's definition gives."""

import random

import pytest
from meshlore.operators import centrality, entities, traversal
from meshlore.operators.find import coheres
from meshlore.streaming import recognition
from meshlore.streaming.engine import Engine, InfluenceKind, Program, regimes, stimulus, tick
from meshlore.streaming.stream import Simulation, subscribe
from meshlore.world import World
from pyspark.sql import functions as F
from worlds import edge, micro


def regimes_of(spark, energies):
    rows = spark.createDataFrame([(i, float(e)) for i, e in enumerate(energies)], "batch bigint, energy double")
    return [r.regime for r in regimes(rows).orderBy("batch").collect()]


@pytest.mark.parametrize(
    ("energies", "want"),
    [
        ([9, 8, 7, 6, 5, 4, 3, 2], ["Initializing"] * 7 + ["Settling"]),
        ([5] * 9, ["Initializing"] * 7 + ["Settling"] * 2),
        ([1, 1, 2, 2, 3, 3, 4, 4], ["Initializing"] * 7 + ["Diverging"]),
        ([50, 20, 30, 7, 1, 2, 1, 2], ["Initializing"] * 7 + ["LimitCycleSuspect"]),
        ([1, 5, 2, 6, 3, 7, 4, 9], ["Initializing"] * 7 + ["Oscillating"]),
        ([1e-5] * 8, ["Initializing"] * 7 + ["Quiescent"]),
        ([1, 5, 2, 6, 3, 7, 4, 2000], ["Initializing"] * 7 + ["Diverging"]),
    ],
)
def test_regimes(spark, energies, want):
    assert regimes_of(spark, energies) == want


def test_subscribers_by_kind_and_anchor_are_told(spark):
    world = World.from_rows(spark, 1, loci=[(i, i, [0.0]) for i in range(1, 8)], relationships=[edge(0, 5, 1, 2)])
    told = {3: ("Specific", 0, None, None), 4: ("AllOfKind", None, 5, None), 5: ("TouchingLocus", None, 5, 2), 6: ("TouchingLocus", None, 5, 7), 7: ("AllOfKind", None, 6, None)}
    world = subscribe(world, [(who, scope, rel, kind, anchor) for who, (scope, rel, kind, anchor) in told.items()])
    engine = Engine((InfluenceKind(5), InfluenceKind(9)), tuple(Program(k, 9, 1.0) for k in told))
    change = spark.createDataFrame([("Relationship", 0, 5, [], [2.0, 0.0], None, None)], stimulus(world, []).schema)
    after = tick(world, Engine(engine.kinds, engine.programs, batch_cap=2), change).world
    assert {r.locus_id: r.state[0] for r in after.loci.collect() if r.state[0]} == {3: 2.0, 4: 2.0, 5: 2.0}


def test_a_locus_rests_after_it_fired(spark):
    world = World.from_rows(spark, 0, loci=[(0, 1, [0.0]), (1, 2, [0.0])])
    programs = lambda rest: (Program(1, 1, 1.0, (1,), refractory=rest), Program(2, 1, 1.0, (0,)))
    free = tick(world, Engine((InfluenceKind(1),), programs(0), batch_cap=6), stimulus(world, [(0, 1, [1.0])]))
    resting = tick(world, Engine((InfluenceKind(1),), programs(4), batch_cap=6), stimulus(world, [(0, 1, [1.0])]))
    # 0 fires in the first batch, is told again two batches later, and has to rest until the fifth.
    assert free.hit_batch_cap and (resting.batches, resting.hit_batch_cap) == (3, False)


def test_flows_between_undeclared_kinds_are_noted(spark):
    world = World.from_rows(spark, 0, loci=[(0, 1, [0.0]), (1, 2, [0.0]), (2, 3, [0.0])])
    engine = Engine((InfluenceKind(1, applies_between=((1, 2),)),), (Program(1, 1, 1.0, (1,)), Program(2, 1, 1.0, (2,))))
    after = tick(world, engine, stimulus(world, [(0, 1, [1.0])])).world
    assert after.relationships.count() == 2
    ids = {(r.src, r.dst): r.rel_id for r in after.relationships.collect()}
    assert [(r.type, r.subject) for r in after.world_events.collect()] == [("SchemaViolation", ids[1, 2])]


def test_a_step_applies_demotion(spark):
    rels = [edge(0, 1, 1, 2, 0.01), edge(1, 1, 2, 3, -0.5), edge(2, 2, 1, 3, 0.01), edge(3, 3, 1, 2, 0.9, batch=1), edge(4, 3, 2, 3, 0.9, batch=2)]
    world = World.from_rows(spark, 3, loci=[(i, 1, [0.0]) for i in (1, 2, 3)], relationships=rels)
    sim = Simulation(world, Engine((InfluenceKind(1, demote_floor=0.1), InfluenceKind(2), InfluenceKind(3, demote_capacity=1))))
    sim.step()
    assert sorted(r.rel_id for r in sim.world.relationships.collect()) == [1, 2, 4]


def test_a_locus_belongs_to_one_claiming_entity(spark):
    """The group 1, 2, 3, 4 is claimed by the entity of 1, 2, 3; 4 and 5 are another's, which claims the group 5, 6."""
    pairs = [(1, 2), (2, 3), (1, 3), (3, 4), (1, 4), (2, 4), (5, 6)]
    world = World.from_rows(
        spark, 2, loci=[(i, 1, [0.0]) for i in range(1, 7)], relationships=[edge(i, 1, a, b, 0.9, 0.0, False) for i, (a, b) in enumerate(pairs)],
        entities=[(0, "Active", [1, 2, 3], [], 0.5), (1, "Active", [4, 5, 6], [], 0.5)],
    )
    after, _ = recognition.recognize_entities(world, 0.1)
    got = {r.entity_id: (r.members, r.member_rels) for r in after.entities.collect()}
    assert got[0] == ([1, 2, 3], [0, 1, 2]) and got[1][0] == [5, 6]


def test_upstream_takes_the_latest_overlapping_layer(spark):
    w = micro(spark)
    layer = lambda e, seq, batch, members: (e, seq, batch, "Born", [], [], [], [], None, None, "Full", 0.5, len(members), members, [], ("RelationshipCluster", [], []))
    extra = [layer(7, 0, 0, [1, 9]), layer(7, 1, 1, [2, 9]), layer(7, 2, 2, [9, 20]), layer(8, 0, 1, [20, 21]), layer(9, 0, 4, [1])]
    own = World.from_rows(spark, 5, entity_layers=extra).entity_layers
    world = w.with_tables(entity_layers=w.entity_layers.unionByName(own))
    assert [(r.entity_id, r.batch) for r in entities.entity_upstream_transitions(world, 1, 3).collect()] == [(7, 1)]


def test_thresholds_are_exact(spark):
    values = [0.01 + i * 1e-5 for i in range(60)] + [0.5 + i * 1e-3 for i in range(40)]
    world = World.from_rows(spark, 0, loci=[(i, 1, []) for i in range(101)], relationships=[edge(i, 1, i, i + 1, v) for i, v in enumerate(values)])
    assert recognition.auto_activity_threshold(world) == pytest.approx(values[59] * 1.0001)
    members = [(e, "Active", [2 * e, 2 * e + 1], [], 0.5) for e in range(5)]
    bridges = [edge(i, 1, 2 * i, 2 * i + 2, w) for i, w in enumerate((0.1, 0.2, 0.3, 0.4))]
    cohered = recognition.extract_cohere(World.from_rows(spark, 0, loci=[(i, 1, []) for i in range(10)], relationships=bridges, entities=members))
    assert [r.entity_ids for r in cohered.coheres.collect()] == [[2, 3, 4]]  # the upper median is 0.3


def test_coheres_are_those_of_the_latest_batch(spark):
    w = micro(spark)
    world = w.with_tables(coheres=w.coheres.unionAll(spark.createDataFrame([("default", 3, 9, [1], [], 0.9)], w.coheres.schema)))
    assert sorted(r.cohere_id for r in coheres(world).rows.collect()) == [2, 9]


def test_long_paths_and_closures_are_whole(spark, monkeypatch):
    n = 40
    world = World.from_rows(spark, 0, loci=[(i, 1, []) for i in range(n)], relationships=[edge(i, 1, i, i + 1) for i in range(n - 1)])
    monkeypatch.setattr(traversal, "LOCAL_STEPS", 0)
    assert traversal.frontier_loop(traversal.arcs(world, "out"), [0]).agg(F.max("depth")).first()[0] == n - 1
    assert traversal.components(world).agg(F.max("component")).first()[0] == 0
    monkeypatch.setattr(traversal, "MOST_ROUNDS", 1)
    with pytest.raises(RuntimeError, match="no fixpoint"):
        traversal.components(world)


def test_cycles_found_by_one_task_and_by_rounds(spark, monkeypatch):
    base = [edge(i, 1, i, i + 1) for i in range(6)] + [edge(20, 1, 3, 9), edge(21, 1, 9, 5)]
    worlds = {False: base, True: [*base, edge(30, 1, 9, 1)]}
    for most in (traversal.LOCAL_STEPS, 0):
        monkeypatch.setattr(traversal, "LOCAL_STEPS", most)
        for want, rels in worlds.items():
            assert traversal.has_cycle(World.from_rows(spark, 0, relationships=rels)) is want


def some_world(spark, n=25, m=45, loops=True):
    r = random.Random(5)
    ends = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
    rels = [edge(i, 1, a, b, round(r.uniform(-0.3, 1), 3), round(r.uniform(0, 0.5), 3), r.random() < 0.5) for i, (a, b) in enumerate(ends) if loops or a != b]
    return World.from_rows(spark, 1, loci=[(i, 1, []) for i in range(n)], relationships=rels), rels


def test_constraint_and_size_with_loops(spark):
    world, rels = some_world(spark)
    s = {}
    for r in rels:
        for i, j in {(r[3], r[4]), (r[4], r[3])}:
            s[i, j] = s.get((i, j), 0.0) + sum(r[5])
    total = {i: sum(v for (a, _), v in s.items() if a == i) for i, _ in s}
    p = {k: v / total[k[0]] for k, v in s.items() if total[k[0]] != 0}
    plus = {k: v / total[k[0]] if total[k[0]] > 0 else 0.0 for k, v in s.items()}
    constraint, size = {}, {}
    for i, j in p:
        more = sum(p[i, q] * plus.get((q, j), 0.0) for a, q in p if a == i and q != j)
        constraint[i] = constraint.get(i, 0.0) + (p[i, j] + more) ** 2
    for i in {a for a, _ in p}:
        near = [j for a, j in p if a == i]
        size[i] = len(near) - sum(p[i, q] * plus.get((q, j), 0.0) for q in near for j in near if q != j and i != j)
    assert {r.locus_id: r.score for r in centrality.all_constraints(world).collect()} == pytest.approx(constraint)
    assert {r.locus_id: r.score for r in centrality.effective_network_size(world).collect()} == pytest.approx(size)


def test_scores_of_one_locus(spark):
    world, _ = some_world(spark)
    for every, one in ((centrality.all_closeness, centrality.closeness_for), (centrality.all_constraints, centrality.constraint_for)):
        want = {r.locus_id: r.score for r in every(world).collect()}
        for locus in (3, 11, 777):
            assert {r.locus_id: r.score for r in one(world, locus).collect()} == pytest.approx({locus: want[locus]} if locus in want else {})


def test_all_source_searches_by_joins(spark, monkeypatch):
    world, _ = some_world(spark, 12, 16, False)
    want = [{r.locus_id: r.score for r in f(world).collect()} for f in (centrality.all_closeness, centrality.all_betweenness)]
    monkeypatch.setattr(centrality, "CSR_EDGES", 3)
    got = [{r.locus_id: r.score for r in f(world).collect()} for f in (centrality.all_closeness, centrality.all_betweenness)]
    assert got == [pytest.approx(x) for x in want]
