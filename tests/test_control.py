"""Control, observation, incremental storage, declared schema and partitions."""

import pytest
from meshlore.operators import find, schema
from meshlore.sources.storage import Storage
from meshlore.streaming.control import DROP_NEWEST, DROP_OLDEST, EngineController, StimulusQueue, TickPolicy
from meshlore.streaming.engine import Engine, InfluenceKind, Program, stimulus
from meshlore.streaming.stream import Simulation
from meshlore.world import World
from pyspark.sql import functions as F
from worlds import micro


def chain(spark, n=3):
    world = World.from_rows(spark, 0, loci=[(i, 10 + i, [0.0]) for i in range(n)])
    return world, Engine((InfluenceKind(1, "push"),), tuple(Program(10 + i, 1, 1.0, (i + 1,)) for i in range(n - 1)))


def test_controller_and_history(spark):
    world, engine = chain(spark)
    controller = EngineController(Simulation(world, engine), history=1)
    handle = controller.handle()
    assert handle.ingest(stimulus(world, [(0, 1, [1.0])])) and controller.handles == 1
    seen = handle.flush_ingested()
    assert (seen.batches, seen.changes, handle.current_batch()) == (3, 3, 3)
    summary = controller.history.last()
    assert (summary.tick_id, summary.relationships_emerged, summary.batch_stats.count(), summary.loci_changed.count()) == (1, 2, 3, 3)
    handle.step()
    assert len(controller.history) == 1 and controller.history.last().changes == 0
    assert handle.relationship_between(1, 0).count() == 1 and handle.loci_of_kind(11).first()["locus_id"] == 1 and handle.influence_kind_id("push") == 1
    assert [TickPolicy.manual().needs_background_loop(), TickPolicy.clock_driven(0).needs_background_loop(), TickPolicy.change_driven(1).needs_background_loop()] == [False, False, True]


def test_queue_under_pressure(spark):
    world, _ = chain(spark)
    one = stimulus(world, [(0, 1, [1.0])])
    queue = StimulusQueue(1)
    assert queue.offer(one)
    with pytest.raises(OverflowError):
        queue.offer(one)
    assert StimulusQueue(1, DROP_NEWEST, [(one, 1)]).offer(one) is False
    oldest = StimulusQueue(2, DROP_OLDEST, [(one, 1), (one, 1)])
    assert oldest.offer(stimulus(world, [(1, 1, [2.0])])) and oldest.take().count() == 2 and oldest.take() is None


def test_commits_write_what_changed(spark, tmp_path):
    world, engine = chain(spark)
    store = Storage(spark, str(tmp_path / "store"))
    store.save(world)
    sim = Simulation(world, engine, store)
    sim.step(stimulus(world, [(0, 1, [1.0])]))
    parts = lambda v: sorted(p.name for p in (tmp_path / "store" / f"v{v}").iterdir())
    assert "changes-more" in parts(1) and "loci-rows" in parts(1) and "properties-whole" not in parts(1) and "loci-whole" not in parts(1)
    sim.step()
    assert not (tmp_path / "store" / "v2").exists() or "changes-more" not in parts(2)
    again = Storage(spark, str(tmp_path / "store")).load()
    for name in ("loci", "relationships", "changes"):
        assert sorted(map(str, getattr(again, name).collect())) == sorted(map(str, getattr(sim.world, name).collect()))
    store.commit(sim.world.with_tables(relationships=sim.world.relationships.where("src <> 0")))
    assert store.load().relationships.count() == sim.world.relationships.count() - 1
    store.save(sim.world)
    assert [p.name for p in (tmp_path / "store").iterdir() if p.name.startswith("v")] == [f"v{store._meta()['version']}"]
    assert Storage.open_or_reset(spark, str(tmp_path / "store")).load().loci.count() == 3


def test_declared_schema_and_partitions(spark):
    world = micro(spark)
    declared, a = schema.SchemaWorld.of(world).declare_entity("pair", [1, 2])
    declared, b = declared.declare_entity("other", [2, 9])
    assert (a, b) == (0, 1) and declared.entity_by_name("other").first()["members"] == [2, 9]
    declared, known = declared.update_entity_members(0, [3])
    assert known and [r.entity_id for r in declared.entities_containing(2).collect()] == [1] and declared.update_entity_members(7, [])[1] is False
    after, n = schema.retract_between(world, 1, "feeds", 2)
    assert n == 1 and [r.predicate for r in schema.predicates_between(world, 2, 1).collect()] == ["feeds"] and schema.predicates_between(after, 1, 2).count() == 0
    index = schema.PartitionIndex.of(world, F.col("kind"))
    assert index.bucket_of(10) == 2 and index.bucket_of(777) is None and sorted(r.loci for r in index.repartition(world).sizes().collect()) == [5, 6]


def test_metrics_and_profiles(spark):
    world = micro(spark)
    row = find.world_metrics(world).first()
    assert row["top_loci_by_degree"][0] == (1, 3) or row["top_loci_by_degree"][0]["degree"] >= 3
    assert row["top_relationships_by_activity"][0]["rel_id"] == 1 and row["largest_component"] == 5 and row["changes"] == 9
    assert find.dominant_kind(world, 1, 2).first()["kind"] == 1
    assert find.profile_trend_similarity(world, (1, 2), (2, 1), 0, 2).first()["similarity"] == pytest.approx(1.0)
    assert sorted(r.locus_id for r in find.top_entity_members(world, 1).collect()) == [1, 2, 3]
