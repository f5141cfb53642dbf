import json

import pytest
from meshlore.narration import CapturingClient, MockClient, Narrator
from meshlore.sources import export, ingest
from meshlore.sources.storage import Storage, evict_cold, promote
from meshlore.streaming import recognition
from meshlore.streaming.engine import Engine, InfluenceKind, Program, check_invariants, decayed, demoted, flush_decay, guard_rail, numbered, regimes, stimulus, tick, trim_change_log
from meshlore.streaming.stream import Simulation, evidence_sessions, read_events, simulate_stream, subscribe, subscribers_of, windowed_activity
from meshlore.world import World
from pyspark.sql import functions as F
from worlds import edge, micro


def chain(spark, n=4, gain=0.8, **kind):
    world = World.from_rows(spark, 0, loci=[(i, 10 + i, [0.0]) for i in range(n)])
    return world, Engine((InfluenceKind(1, "push", decay=0.9, **kind),), tuple(Program(10 + i, 1, gain, (i + 1,)) for i in range(n - 1)))


def test_tick_runs_down_a_chain(spark):
    world, engine = chain(spark)
    r = tick(world, engine, stimulus(world, [(0, 1, [1.0])]))
    assert (r.batches, r.changes, r.hit_batch_cap) == (4, 4, False)
    assert {x.locus_id: round(x.state[0], 6) for x in r.world.loci.collect()} == {0: 1.0, 1: 0.8, 2: 0.64, 3: 0.512}
    rels = sorted((x.src, x.dst, round(x.state[0], 6), x.created_batch) for x in r.world.relationships.collect())
    assert rels == [(0, 1, 1.0, 1), (1, 2, 0.8, 2), (2, 3, 0.64, 3)]
    assert check_invariants(r.world) == {"dense": True, "unique": True, "antecedent": True, "edge_keys": True}
    again = tick(r.world, engine, stimulus(r.world, [(0, 1, [1.0])]))
    got = {(x.src, x.dst): x.state[0] for x in again.world.relationships.collect()}
    assert got[0, 1] == pytest.approx(1.0 * 0.9**4 + 1.0) and again.world.relationships.count() == 3


def test_cycle_hits_the_cap(spark):
    world = World.from_rows(spark, 0, loci=[(0, 1, [0.0]), (1, 2, [0.0])])
    engine = Engine((InfluenceKind(1),), (Program(1, 1, 1.0, (1,)), Program(2, 1, 1.0, (0,))), batch_cap=3)
    assert tick(world, engine, stimulus(world, [(0, 1, [1.0])])).hit_batch_cap


def test_threshold_gathers_evidence(spark):
    world, engine = chain(spark, 2, 1.0, min_evidence=1.5, evidence_window=10)
    first = tick(world, engine, stimulus(world, [(0, 1, [1.0])])).world
    assert first.relationships.count() == 0 and first.pending_evidence.first()["signal"] == 1.0
    second = tick(first, engine, stimulus(first, [(0, 1, [1.0])])).world
    assert second.relationships.first()["state"][0] == 2.0 and second.pending_evidence.count() == 0


def test_learning_decay_and_policies(spark):
    world, engine = chain(spark, 2, 1.0, learning_rate=0.5, max_weight=0.4)
    w = tick(world, engine, stimulus(world, [(0, 1, [1.0])])).world
    w = tick(w, engine, stimulus(w, [(0, 1, [1.0])])).world
    assert w.relationships.first()["state"][1] == pytest.approx(0.4)
    later = w.with_tables(current_batch=w.current_batch + 10)
    a = w.relationships.first()
    assert flush_decay(later, engine).relationships.first()["state"][0] == pytest.approx(a["state"][0] * 0.9 ** (later.current_batch - a["last_decayed_batch"]))
    strict = Engine((InfluenceKind(1, demote_idle=5),))
    assert demoted(later, strict).count() == 1 and demoted(w, strict).count() == 0 and decayed("state", strict, F.lit(1)) is not None


def test_trim_and_numbers(spark):
    w = micro(spark)
    t = trim_change_log(w, 3)
    assert t.changes.agg(F.min("batch")).first()[0] == 2 and {r.locus_id: r.change_count for r in t.trim_summaries.collect()} == {1: 1, 2: 1, 3: 1}
    rows = numbered(spark.range(100).repartition(7), [F.col("id")], 5, "n").collect()
    assert all(r.n == r.id + 5 for r in rows)


def test_regimes_and_guard_rail(spark):
    series = spark.createDataFrame(list(enumerate([1.0, 2.0, 3.0, 2.0, 1.0, 0.5])), "batch bigint, energy double")
    got = {r.batch: r.regime for r in regimes(series, 3).collect()}
    assert (got[0], got[2], got[3], got[5]) == ("Initializing", "Diverging", "Oscillating", "Settling")
    assert guard_rail(1.0, "Diverging") == 0.5 and guard_rail(1.0, "Quiescent") == 1.0 and guard_rail(0.12, "Diverging") == 0.1


def cliques(spark, bridge=0.05):
    rels = [edge(100 * b + 10 * x + y, 1, b + x, b + y, 1.0, 0.0, False) for b in (0, 20) for x in range(4) for y in range(x + 1, 4)] + [edge(9000, 1, 0, 20, bridge, 0.0, False)]
    return World.from_rows(spark, 3, loci=[(i, 1, [0.0]) for i in (0, 1, 2, 3, 20, 21, 22, 23)], relationships=rels)


def test_recognition_lifecycle(spark):
    world = cliques(spark)
    assert recognition.auto_activity_threshold(world) == pytest.approx(0.05 * 1.0001)
    born, events = recognition.recognize_entities(world)
    members = sorted(tuple(r.members) for r in born.entities.collect())
    assert members == [(0, 1, 2, 3), (20, 21, 22, 23)] and events.count() == 2
    same, _ = recognition.recognize_entities(born)
    assert same.entity_layers.count() == 2
    gone, _ = recognition.recognize_entities(born.with_tables(relationships=born.relationships.where("src < 20 AND dst < 20")))
    assert sorted(r.status for r in gone.entities.collect()) == ["Active", "Dormant"]
    cohered = recognition.extract_cohere(born, min_bridge=0.01)
    assert [sorted(r.entity_ids) for r in cohered.coheres.collect()] == [sorted(r.entity_id for r in born.entities.collect())]
    one = born.with_tables(entities=spark.createDataFrame([(7, "Active", [0, 1, 20, 21], [], 0.5, [], [])], born.entities.schema))
    split, _ = recognition.recognize_entities(one)
    assert {r.entity_id: r.status for r in split.entities.collect()}[7] == "Dormant" and split.entities.count() == 3


def test_simulation_and_triggers(spark, tmp_path):
    world, engine = chain(spark, 3)
    sim = Simulation(world, engine, Storage(spark, str(tmp_path / "store")))
    seen = []
    sim.add_observer(seen.append, once=True)
    sim.add_trigger(lambda o: stimulus(sim.world, [(0, 1, [1.0])]) if o.step == 0 else None, once=True)
    a, b = sim.step_n(2, stimulus(world, [(0, 1, [1.0])]))
    assert a.changes == 3 and b.changes == 3 and len(seen) == 1 and not sim.triggers
    loaded = sim.storage.load()
    assert loaded.current_batch == sim.world.current_batch and loaded.changes.count() == 6 and sim.storage.table_counts()["loci"] == 3
    assert sim.storage.changes_for_batch(0).count() == 1 and sim.storage.relationships_for_locus(1).count() == 2 and sim.storage.get("loci", "locus_id", 2).count() == 1
    sim.storage.reset()
    assert sim.storage.load().loci.count() == 0


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(200)
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    live = read_events(spark, str(tmp_path / "in"))
    query = windowed_activity(live, "1 day", "60 days").writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = windowed_activity(events.withColumn("ts", F.col("ts").cast("timestamp")), "1 day")
    assert sorted(map(tuple, spark.table("daily").select("window_start", "event_type", "events").collect())) == sorted(map(tuple, batch.select("window_start", "event_type", "events").collect()))
    assert evidence_sessions(events.withColumn("ts", F.col("ts").cast("timestamp"))).agg(F.sum("events")).first()[0] == 200
    users = [r[0] for r in events.select("user_id").distinct().collect()]
    world = World.from_rows(spark, 0, loci=[(u, 1, [0.0]) for u in users])
    sim = Simulation(world, Engine((InfluenceKind(1),)))
    none = F.lit(None)
    to = lambda rows: rows.select(F.lit("Locus").alias("subject_type"), F.col("user_id").alias("subject_id"), F.lit(1).cast("bigint").alias("kind"), F.array().cast("array<bigint>").alias("predecessors"), F.array("value").alias("after"), none.cast("bigint").alias("wall_time"), none.cast("string").alias("metadata"))
    simulate_stream(sim, live, to, str(tmp_path / "c2")).awaitTermination(300)
    assert len(sim.history) == 2 and sim.world.changes.count() == 200 and check_invariants(sim.world)["dense"]


def test_ingest(spark):
    world = micro(spark)
    rows = spark.createDataFrame([("one", "node", '{"confidence": 0.9, "new": "x"}'), ("fresh", "node", '{"_state": [1.0, 2.0]}')], "name string, kind string, props string")
    after, stimuli = ingest.ingest(world, rows, {"node": 1}, 5)
    assert after.loci.where("locus_id = 22").first()["state"] == [1.0, 2.0] and stimuli.count() == 2
    props = json.loads(after.properties.where("locus_id = 1").first()["props"])
    assert props["name"] == "one" and props["confidence"] == "0.9" and props["new"] == "x"
    with pytest.raises(ingest.IngestError):
        ingest.ingest(world, spark.createDataFrame([("a", "what", "{}")], rows.schema), {"node": 1}, 5)
    pending = ingest.cooccurrence(world, spark.createDataFrame([(1, 1), (1, 2), (1, 9)], "group_id bigint, locus_id bigint"), 5)
    assert {r.subject_id: r.predecessors for r in pending.collect()} == {1: [1, 4], 2: [4, 8], 9: [1, 8]}


def test_edge_list(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# head\n1 2 10\n2 1 20\n3 3 30\n1 2 700000\n")
    assert sorted(map(tuple, ingest.read_edge_list(spark, str(tmp_path / "e.txt")).collect())) == [(0, 1, 2), (1, 1, 2)]


def test_text_extraction(spark):
    answer = json.dumps([{"name": "Ada", "kind": "person", "properties": {"confidence": 1}}, {"name": "x", "kind": "unknown"}])
    got = ingest.extract_from_text(spark.createDataFrame([("Ada wrote",), (None,)], "text string"), lambda: MockClient(answer), ["person"])
    assert [(r.name, r.kind) for r in got.collect()] == [("Ada", "person")] * 2


def test_export_and_tiers(spark):
    world = micro(spark)
    lines = [r.line for r in export.dot_lines(world).collect()]
    assert lines[0] == "digraph world {" and lines[-1] == "}" and '  n1 [label="one\\n1.000"];' in lines and any("n4 -> n5" in x and "dir=none" in x for x in lines)
    assert export.relationship_list(world).where("rel_id = 1").first()["text"] == "one -> two (kind 1, activity 0.900)"
    assert export.entities_summary(world).where("entity_id = 1").first()["names"] == ["locus_3", "one", "two"]
    hot, cold = evict_cold(world, 0.25, 3)
    assert sorted(r.rel_id for r in cold.collect()) == [2, 11] and promote(hot, cold, [3]).relationships.count() == hot.relationships.count() + 1


def test_subscriptions(spark):
    world = subscribe(micro(spark), [(9, "Specific", 1, None, None), (10, "AllOfKind", None, 3, None), (11, "TouchingLocus", None, 1, 20), (9, "Specific", 1, None, None)])
    got = sorted((r.rel_id, r.subscriber) for r in subscribers_of(world).collect())
    assert got == [(1, 9), (5, 10), (6, 10), (7, 10), (8, 11), (9, 11)]


def test_narration(spark):
    client = CapturingClient("ok")
    narrator = Narrator(micro(spark), client)
    assert narrator.ask("What feeds two?") == "ok" and "one -> two" in client.calls[0][1]
    narrator.narrate_boundary()
    narrator.narrate_entity_deviations(1)
    assert "confirmed" in client.calls[1][1] and Narrator(micro(spark), MockClient('{"decay": 0.5}')).configure("influence", "slow") == {"decay": 0.5}
