import pytest
from meshlore.sources import fixtures
from meshlore.streaming import structural as S
from meshlore.streaming.engine import Engine, InfluenceKind, check_invariants, stimulus, tick
from meshlore.streaming.stream import subscribe
from meshlore.world import World
from worlds import edge, micro


def test_proposals(spark):
    world = subscribe(micro(spark), [(9, "Specific", 1, None, None), (2, "AllOfKind", None, 1, None)])
    given = S.proposals(world, [
        {"action": "create_locus", "kind": 5}, {"action": "create_locus", "kind": 5, "locus_id": 77}, {"action": "create_relationship", "kind": 1, "src": 1, "dst": 2, "directed": True, "activity": 0.5},
        {"action": "create_relationship", "kind": 3, "src": 5, "dst": 3, "directed": False, "activity": 0.25}, {"action": "subscribe", "subscriber": 3, "rel_id": 8}, {"action": "unsubscribe_from_kind", "subscriber": 2, "kind": 1},
        {"action": "delete_relationship", "rel_id": 1}, {"action": "delete_locus", "locus_id": 10},
    ])
    after, tombstones = S.apply_structural(world, given)
    assert {22, 77} <= {r.locus_id for r in after.loci.collect()} and 10 not in {r.locus_id for r in after.loci.collect()}
    assert sorted(r.rel_id for r in after.relationships.collect()) == [2, 3, 4, 6, 8, 9, 10, 11, 12]
    assert [(r.src, r.dst, r.state) for r in after.relationships.where("rel_id = 12").collect()] == [(3, 5, [0.25, 0.0])]
    assert [(r.subscriber, r.rel_id) for r in after.subscriptions.collect()] == [(3, 8)]
    assert [(r.subject_id, r.metadata) for r in tombstones.collect()] == [(9, '{"tombstone":true,"rel_id":1}')]
    assert {1, 5, 7} <= {r.rel_id for r in after.pruned_log.collect()}


def test_interactions(spark):
    world = World.from_rows(spark, 1, loci=[(1, 1, [0.0]), (2, 1, [0.0])], relationships=[edge(1, 1, 1, 2, 1.0), edge(2, 2, 2, 1, 0.5), edge(3, 3, 1, 2, 0.25)])
    got = S.apply_interactions(world, Engine((InfluenceKind(1),), interactions={(1, 2): 2.0}), 0)
    assert {r.rel_id: r.state[0] for r in got.relationships.collect()} == {1: 2.0, 2: 1.0, 3: 0.25}


def test_prediction(spark):
    world = World.from_rows(spark, 1, relationships=[edge(1, 1, 1, 2, 0.9, 0.0, False), edge(2, 1, 3, 2, 0.8, 0.0, False), edge(3, 1, 1, 3, 0.1, 0.0, False)])
    met = S.pairs_of_events(spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "event_id bigint, member bigint"))
    row = S.evaluate_prediction(S.rank_pairs(world), met, 2, 4).first()
    assert (row["hits"], row["precision"], row["recall"]) == (1, 0.5, 1.0) and row["lift"] == pytest.approx(3.0)
    learners = S.PlasticityLearners()
    assert learners.observe(1, 1.0, 1.0) == pytest.approx(1.1) and learners.observe(1, 0.0, 0.0) < 1.1 and learners.current(2) == 1.0
    assert [r.value for r in S.slot_history(micro(spark), 1, 0, 2).collect()] == [0.4, 0.9]


@pytest.mark.parametrize("seed", [2])
def test_random_worlds_keep_the_invariants(spark, seed):
    for build in (fixtures.random_chain_world, fixtures.random_star_world):
        world, engine = build(spark, seed)
        result = tick(world, engine, stimulus(world, [(0, 1, [1.0])]))
        assert all(check_invariants(result.world).values()) and not result.hit_batch_cap
        assert result.world.relationships.count() == world.loci.count() - 1


def test_fan_in(spark):
    world, engine = fixtures.fan_in_world(spark, 3, 2, 4, 0.5)
    result = tick(world, engine, stimulus(world, [(i, 1, [1.0, 0, 0, 0]) for i in range(3)]))
    assert result.world.relationships.count() == 6
