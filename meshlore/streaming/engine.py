"""The batch loop: pending changes become changes, edges emerge and decay, programs answer.

A tick is a loop of batches; each batch is a DataFrame transformation of the
world, written to the shared folder before the next one reads it.  Programs that
are declared (forward, broadcast, accumulate) are joins and sums; a custom one is
a grouped pandas function over a locus's inbox.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import broadcast_if_small, durable
from ..functions.vectors import activity, slot, weight
from ..world import World

PENDING = "subject_type string, subject_id bigint, kind bigint, predecessors array<bigint>, after array<double>, wall_time bigint, metadata string"

BATCH_CAP = 64


@dataclass(frozen=True)
class InfluenceKind:
    """What is configured for a kind of influence."""

    kind: int
    name: str = ""
    parent: int | None = None
    decay: float = 1.0
    weight_decay: float = 1.0
    alpha: float = 1.0
    symmetric: bool = False
    activity_contribution: float = 1.0
    extra_slots: tuple[float, ...] = ()
    min_evidence: float | None = None
    evidence_window: int = 1
    learning_rate: float = 0.0
    max_weight: float = 1.0
    demote_floor: float | None = None
    demote_idle: int | None = None
    demote_capacity: int | None = None
    applies_between: tuple[tuple[int, int], ...] = ()  # kinds of loci; a flow between others is noted as a violation


@dataclass(frozen=True)
class Program:
    """What loci of a kind do with their inbox: gains on the summed first slots of what came in."""

    locus_kind: int
    influence: int
    gain: float = 1.0
    to: tuple[int, ...] | None = None  # forward to these; none: accumulate in the locus itself
    only_locus: int | None = None
    custom: Callable | None = None  # pandas inbox of a locus -> rows (subject_id, kind, after)
    refractory: int = 0  # batches of a tick for which a locus of the kind rests after it fired


@dataclass(frozen=True)
class Engine:
    kinds: tuple[InfluenceKind, ...]
    programs: tuple[Program, ...] = ()
    interactions: dict[tuple[int, int], float] = field(default_factory=dict)
    batch_cap: int = BATCH_CAP

    def per_kind(self, attribute: str, column: str = "kind", default=None) -> Column:
        """The configured value for a kind column; a kind without the setting inherits nothing."""
        out = F.lit(default)
        for k in self.kinds:
            if (value := getattr(k, attribute)) is not None:
                out = F.when(F.col(column) == k.kind, F.lit(value)).otherwise(out)
        return out

    def ancestors_of(self, kind: int) -> list[int]:
        parents = {k.kind: k.parent for k in self.kinds}
        out, seen = [], {kind}
        while (kind := parents.get(kind)) is not None and kind not in seen:
            out.append(kind)
            seen.add(kind)
        return out

    def kind_and_descendants(self, kind: int) -> list[int]:
        return [kind, *(k.kind for k in self.kinds if kind in self.ancestors_of(k.kind))]


@dataclass
class TickResult:
    world: World
    batches: int
    changes: int
    hit_batch_cap: bool


def numbered(rows: DataFrame, order: list, start: int, name: str) -> DataFrame:
    """Dense numbers from ``start`` in the given order: ranges are counted, not gathered."""
    sorted_rows = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33).alias("__part")
    counts = sorted_rows.groupBy(part).count().orderBy("__part").collect()  # one row per partition
    base, rows_before = [], start
    for r in counts:
        base.append((r["__part"], rows_before))
        rows_before += r["count"]
    bases = rows.sparkSession.createDataFrame(base, "__part bigint, __base bigint")
    placed = sorted_rows.withColumn("__part", F.shiftright("__id", 33)).join(F.broadcast(bases), "__part")
    return placed.withColumn(name, F.col("__base") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id", "__part", "__base")


def decayed(state: Column | str, engine: Engine, batches: Column) -> Column:
    """A relationship's state after some batches without a touch."""
    state = F.col(state) if isinstance(state, str) else state
    return F.transform(state, lambda x, i: F.when(i == 0, x * F.pow(engine.per_kind("decay", default=1.0), batches)).when(i == 1, x * F.pow(engine.per_kind("weight_decay", default=1.0), batches)).otherwise(x))


def flush_decay(world: World, engine: Engine) -> World:
    """Apply the decay that edges are due up to the current batch."""
    due = F.greatest(F.lit(world.current_batch) - F.col("last_decayed_batch"), F.lit(0))
    rows = world.relationships.withColumn("state", decayed("state", engine, due)).withColumn("last_decayed_batch", F.greatest(F.col("last_decayed_batch"), F.lit(world.current_batch).cast("bigint")))
    return world.with_tables(relationships=rows)


def demoted(world: World, engine: Engine) -> DataFrame:
    """(rel_id) that the kinds' policies demote: faint, idle, or beyond capacity by last use."""
    idle = F.lit(world.current_batch) - F.col("last_decayed_batch")
    faint = F.abs("activity") < engine.per_kind("demote_floor", default=-1.0)
    rest = idle > engine.per_kind("demote_idle", default=1 << 60)
    out = world.edges.where(faint | rest).select("rel_id")
    for k in engine.kinds:
        if k.demote_capacity is not None:  # numbered by ranges: a kind may hold most edges
            own = world.relationships.where(F.col("kind") == k.kind).select("rel_id", "last_decayed_batch")
            out = out.unionAll(numbered(own, [F.desc("last_decayed_batch"), F.desc("rel_id")], 1, "place").where(F.col("place") > k.demote_capacity).select("rel_id"))
    return out.distinct()


def without_demoted(world: World, engine: Engine) -> World:
    """The world after its demotion policies; the edges stay in the store, if there is one."""
    if all(k.demote_floor is None and k.demote_idle is None and k.demote_capacity is None for k in engine.kinds):
        return world
    return world.with_tables(relationships=durable(world.relationships.join(durable(demoted(world, engine)), "rel_id", "left_anti").select(*world.relationships.columns)))


def commit_batch(world: World, engine: Engine, pending: DataFrame) -> tuple[World, DataFrame]:
    """Turn pending changes into changes of the current batch; gives the world and the new changes."""
    batch = world.current_batch
    state = world.loci.select(F.lit("Locus").alias("subject_type"), F.col("locus_id").alias("subject_id"), F.col("state").alias("before")).unionAll(
        world.relationships.select(F.lit("Relationship"), "rel_id", "state")
    )
    known = pending.join(state, ["subject_type", "subject_id"])  # changes to missing subjects go
    alpha = engine.per_kind("alpha", default=1.0)
    after = F.when(alpha == 1.0, F.col("after")).otherwise(F.zip_with(F.col("before"), F.col("after"), lambda b, a: (1 - alpha) * F.coalesce(b, F.lit(0.0)) + alpha * F.coalesce(a, F.lit(0.0))))
    built = known.withColumn("after", after)
    idle = (F.size("predecessors") > 0) & (F.col("before") == F.col("after")) & F.col("metadata").isNull() & (F.col("subject_type") == "Locus")
    crossing = F.exists("predecessors", lambda p: p.isNotNull())
    built = built.where(~(idle & ~crossing))
    top = world.changes.agg(F.max("change_id")).first()[0]
    made = numbered(built.withColumn("__key", F.to_json(F.struct("after", "metadata"))), ["subject_type", "subject_id", "kind", "__key"], 0 if top is None else top + 1, "change_id").drop("__key")
    changes = durable(made.withColumn("batch", F.lit(batch).cast("bigint")).select(*world.changes.columns))
    new_state = changes.groupBy("subject_type", "subject_id").agg(F.max_by("after", "change_id").alias("__new"))
    loci = world.loci.join(new_state.where("subject_type = 'Locus'").select(F.col("subject_id").alias("locus_id"), "__new"), "locus_id", "left").select("locus_id", "kind", F.coalesce("__new", "state").alias("state"))
    rels = world.relationships.join(new_state.where("subject_type = 'Relationship'").select(F.col("subject_id").alias("rel_id"), "__new"), "rel_id", "left")
    rels = rels.withColumn("state", F.coalesce("__new", "state")).select(*world.relationships.columns)
    world = world.with_tables(loci=durable(loci), relationships=rels, changes=world.changes.unionByName(changes))
    world = _emerge(world, engine, changes, batch)
    if engine.interactions:
        from .structural import apply_interactions

        world = apply_interactions(world, engine, batch)
    return world.with_tables(changes=durable(world.changes), relationships=durable(world.relationships), current_batch=batch + 1), changes


def _emerge(world: World, engine: Engine, changes: DataFrame, batch: int) -> World:
    """Edges from the loci of predecessors to the loci that changed.

    An edge's state after a batch is a0 * decay^age + sum of contributions: the sum
    doesn't depend on order.  A kind with a threshold gathers evidence first.
    """
    source = world.changes.where("subject_type = 'Locus'").select(F.col("change_id").alias("__p"), F.col("subject_id").alias("src"), slot("after", 0).alias("pre"))
    touched = changes.where("subject_type = 'Locus'").select("change_id", F.col("subject_id").alias("dst"), "kind", slot("after", 0).alias("post"), F.explode("predecessors").alias("__p"))
    flows = touched.join(source, "__p").where("src <> dst")
    symmetric = engine.per_kind("symmetric", default=False)
    c = engine.per_kind("activity_contribution", default=1.0)
    flows = flows.select("kind", (~symmetric).alias("directed"), F.when(symmetric, F.least("src", "dst")).otherwise(F.col("src")).alias("src"), F.when(symmetric, F.greatest("src", "dst")).otherwise(F.col("dst")).alias("dst"), "change_id", (c * F.coalesce("pre", F.lit(0.0))).alias("signal"), (F.coalesce("pre", F.lit(0.0)) * F.coalesce("post", F.lit(0.0))).alias("hebb"))
    key = ["kind", "directed", "src", "dst"]
    summed = durable(flows.groupBy(*key).agg(F.sum("signal").alias("signal"), F.max_by("hebb", "change_id").alias("hebb"), F.min("change_id").alias("first"), F.max("change_id").alias("last"), F.count(F.lit(1)).alias("touches"), F.collect_set("change_id").alias("ids")))
    # Existing edges: fade, then add; weights learn from the last observation.
    age = F.greatest(F.lit(batch) - F.col("last_decayed_batch"), F.lit(0))
    old = world.relationships.join(summed, key, "left")
    rate, most = engine.per_kind("learning_rate", default=0.0), engine.per_kind("max_weight", default=1.0)
    faded = decayed("state", engine, age)
    w = F.coalesce(F.try_element_at(faded, F.lit(2)), F.lit(0.0))
    learned = F.when(rate > 0, F.least(F.greatest(w + rate * F.col("hebb"), F.lit(0.0)), most)).otherwise(w)
    updated = F.concat(F.array(F.coalesce(F.try_element_at(faded, F.lit(1)), F.lit(0.0)) + F.col("signal"), learned), F.slice(faded, 3, F.greatest(F.size(faded) - 2, F.lit(0))))
    hit = F.col("signal").isNotNull()
    seen = F.struct(F.col("kind").alias("kind"), F.col("touches").cast("bigint").alias("touch_count"), F.lit(batch).cast("bigint").alias("last_batch"))
    observed = F.when(F.exists(F.coalesce("kinds_observed", F.array()), lambda k: k["kind"] == F.col("kind")), F.transform("kinds_observed", lambda k: F.when(k["kind"] == F.col("kind"), F.struct(k["kind"].alias("kind"), (k["touch_count"] + F.col("touches")).alias("touch_count"), F.lit(batch).cast("bigint").alias("last_batch"))).otherwise(k))).otherwise(F.concat(F.coalesce("kinds_observed", F.array().cast("array<struct<kind:bigint,touch_count:bigint,last_batch:bigint>>")), F.array(seen)))
    kept = old.select(
        "rel_id", "kind", "directed", "src", "dst", F.when(hit, updated).otherwise(F.col("state")).alias("state"), "created_by", F.when(hit, F.col("last")).otherwise(F.col("last_touched_by")).alias("last_touched_by"),
        (F.col("change_count") + F.coalesce("touches", F.lit(0))).alias("change_count"), F.when(hit, observed).otherwise(F.col("kinds_observed")).alias("kinds_observed"), "created_batch", F.when(hit, F.lit(batch).cast("bigint")).otherwise(F.col("last_decayed_batch")).alias("last_decayed_batch"), "metadata",
    )
    fresh = summed.join(world.relationships.select(*key), key, "left_anti")
    # Evidence: a window since the first sight; reset when it has passed, promoted from the threshold on.
    held = world.pending_evidence.withColumnsRenamed({"signal": "h_signal", "first_seen": "h_first", "change_ids": "h_ids"}).drop("last_touched")
    both = fresh.join(held, key, "left")
    window, need = engine.per_kind("evidence_window", default=1), engine.per_kind("min_evidence", default=None).cast("double")
    fresh_window = F.col("h_first").isNull() | (F.lit(batch) - F.col("h_first") > window)
    both = both.withColumns({"total": F.col("signal") + F.when(fresh_window, 0.0).otherwise(F.col("h_signal")), "since": F.when(fresh_window, F.lit(batch)).otherwise(F.col("h_first")).cast("bigint"), "all_ids": F.when(fresh_window, F.col("ids")).otherwise(F.concat("h_ids", "ids"))})
    promoted = need.isNull() | (F.abs("total") >= need)
    both = durable(both.withColumn("__up", promoted))
    extras = F.array().cast("array<double>")
    for k in engine.kinds:
        if k.extra_slots:
            extras = F.when(F.col("kind") == k.kind, F.array(*[F.lit(float(x)) for x in k.extra_slots])).otherwise(extras)
    top = world.relationships.agg(F.max("rel_id")).first()[0]
    born = numbered(both.where("__up"), key, 0 if top is None else top + 1, "rel_id").select(
        "rel_id", "kind", "directed", "src", "dst", F.concat(F.array(F.col("total"), F.lit(0.0)), extras).alias("state"), F.col("first").alias("created_by"), F.col("last").alias("last_touched_by"), F.col("touches").cast("bigint").alias("change_count"),
        F.array(seen).alias("kinds_observed"), F.lit(batch).cast("bigint").alias("created_batch"), F.lit(batch).cast("bigint").alias("last_decayed_batch"), F.lit(None).cast("string").alias("metadata"),
    )
    waiting = both.where("NOT __up").select("src", "dst", "directed", "kind", F.col("total").alias("signal"), F.col("since").alias("first_seen"), F.lit(batch).cast("bigint").alias("last_touched"), F.col("all_ids").alias("change_ids"))
    rest = world.pending_evidence.join(summed.select(*key), key, "left_anti").select(*waiting.columns)
    after = world.with_tables(relationships=kept.unionByName(born), pending_evidence=durable(rest.unionByName(waiting)))
    return _note_violations(after, engine, touched.join(source, "__p").where("src <> dst"), batch)


def _note_violations(world: World, engine: Engine, flows: DataFrame, batch: int) -> World:
    """Flows between kinds of loci that their kind isn't declared for: edges all the same, and an event each."""
    allowed = [(k.kind, a, b) for k in engine.kinds for a, b in k.applies_between]
    if not allowed:
        return world
    rules = F.broadcast(world.spark.createDataFrame(allowed, "kind bigint, from_kind bigint, to_kind bigint"))
    ends = [world.loci.select(F.col("locus_id").alias(end), F.col("kind").alias(name)) for end, name in (("src", "from_kind"), ("dst", "to_kind"))]
    bad = flows.where(F.col("kind").isin(*{k for k, *_ in allowed})).join(ends[0], "src").join(ends[1], "dst").join(rules, ["kind", "from_kind", "to_kind"], "left_anti")
    symmetric = engine.per_kind("symmetric", default=False)
    u, v = (F.when(symmetric, f("src", "dst")).otherwise(F.col(c)) for f, c in ((F.least, "src"), (F.greatest, "dst")))
    bad = bad.select("kind", u.alias("src"), v.alias("dst"), "from_kind", "to_kind").join(world.relationships.select("rel_id", "kind", "src", "dst"), ["kind", "src", "dst"])
    payload = F.to_json(F.struct("kind", "from_kind", "to_kind"))
    return world.with_tables(world_events=durable(world.world_events.unionByName(bad.select(F.lit(batch).cast("bigint").alias("batch"), F.lit("SchemaViolation").alias("type"), F.col("rel_id").alias("subject"), payload.alias("payload")))))


def subscribers_of(world: World, relationships: DataFrame | None = None) -> DataFrame:
    """(rel_id, subscriber): by relationship, by kind, and by anchor and kind; each pair once."""
    s, r = world.subscriptions, (world.relationships if relationships is None else relationships).select("rel_id", "kind", "src", "dst")
    specific = s.where("scope = 'Specific'").join(r.select("rel_id"), "rel_id", "left_semi").select("rel_id", "subscriber")
    # Subscribers of a kind are repeated for each edge of it; edges are dealt over salts, as a kind may hold most.
    salts = 16
    dealt = r.select("rel_id", "kind", F.pmod(F.xxhash64("rel_id"), F.lit(salts)).cast("int").alias("salt"))
    told = s.where("scope = 'AllOfKind'").select("kind", "subscriber", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    kind = dealt.join(told, ["kind", "salt"]).select("rel_id", "subscriber")
    ends = r.select("rel_id", "kind", F.col("src").alias("anchor")).unionAll(r.select("rel_id", "kind", "dst"))
    anchored = ends.join(s.where("scope = 'TouchingLocus'").select("anchor", "kind", "subscriber"), ["anchor", "kind"]).select("rel_id", "subscriber")
    return specific.unionAll(kind).unionAll(anchored).distinct()


def dispatch(world: World, engine: Engine, changes: DataFrame, resting: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What programs propose after a batch (pending changes of the next one), and the loci that fired.

    Loci hear of their own changes and of those of relationships that they subscribe
    to, by id, by kind or by anchor.  Those in ``resting`` don't answer.
    """
    inbox = changes.where("subject_type = 'Locus'").select(F.col("subject_id").alias("locus_id"), "change_id", F.coalesce(slot("after", 0), F.lit(0.0)).alias("signal"))
    changed = changes.where("subject_type = 'Relationship'").select(F.col("subject_id").alias("rel_id"), "change_id", F.coalesce(slot("after", 0), F.lit(0.0)).alias("signal"))
    edges = world.relationships.join(changed.select("rel_id").distinct(), "rel_id", "left_semi")
    told = changed.join(subscribers_of(world, edges), "rel_id").select(F.col("subscriber").alias("locus_id"), "change_id", "signal")
    inbox = inbox.unionAll(told).join(broadcast_if_small(world.loci.select("locus_id", F.col("kind").alias("locus_kind"), "state")), "locus_id")
    if resting is not None:
        inbox = inbox.join(resting, "locus_id", "left_anti")
    none = F.lit(None)
    # One join with the table of programs, whatever their number.
    declared = [(p.locus_kind, p.only_locus, p.influence, float(p.gain), list(p.to) if p.to is not None else None) for p in engine.programs if p.custom is None]
    programs = world.spark.createDataFrame(declared, "locus_kind bigint, only_locus bigint, influence bigint, gain double, to array<bigint>")
    sums = inbox.groupBy("locus_id", "locus_kind").agg(F.sum("signal").alias("signal"), F.array_sort(F.collect_set("change_id")).alias("predecessors"), F.first("state").alias("state"))
    value = F.col("gain") * F.col("signal")
    fired = sums.join(F.broadcast(programs), "locus_kind").where((F.col("only_locus").isNull() | (F.col("only_locus") == F.col("locus_id"))) & (F.abs(value) > 1e-9))
    after = F.when(F.col("to").isNull(), F.array(F.coalesce(slot("state", 0), F.lit(0.0)) + value)).otherwise(F.array(value))
    out = fired.select(
        F.lit("Locus").alias("subject_type"), F.explode(F.coalesce("to", F.array("locus_id"))).alias("subject_id"), F.col("influence").alias("kind"), "predecessors", after.alias("after"), none.cast("bigint").alias("wall_time"), none.cast("string").alias("metadata"),
        "locus_id",
    )
    for p in engine.programs:
        if p.custom is not None:
            own = inbox.where(F.col("locus_kind") == p.locus_kind)
            own = own if p.only_locus is None else own.where(F.col("locus_id") == p.only_locus)
            made = own.groupBy("locus_id").applyInPandas(_answering(p.custom), "subject_id bigint, kind bigint, predecessors array<bigint>, after array<double>, locus_id bigint")
            out = out.unionByName(made.select(F.lit("Locus").alias("subject_type"), "subject_id", "kind", "predecessors", "after", none.cast("bigint").alias("wall_time"), none.cast("string").alias("metadata"), "locus_id"))
    out = durable(out)
    return out.drop("locus_id"), out.select("locus_id").distinct()


def _answering(program: Callable) -> Callable:
    """A custom program whose rows also say who answered."""

    def run(inbox):
        rows = program(inbox)
        return rows[["subject_id", "kind", "predecessors", "after"]].assign(locus_id=inbox["locus_id"].iloc[0])

    return run


def tick(world: World, engine: Engine, stimuli: DataFrame) -> TickResult:
    """Batches until nothing is pending, or the cap."""
    pending, batches, total = durable(stimuli), 0, 0
    rests = {p.locus_kind: p.refractory for p in engine.programs if p.refractory > 0}
    last = world.spark.createDataFrame([], "locus_id bigint, fired_at int")
    while not pending.isEmpty():
        if batches == engine.batch_cap:
            return TickResult(world, batches, total, True)
        world, changes = commit_batch(world, engine, pending)
        batches, total = batches + 1, total + changes.count()
        resting = None
        if rests:
            kinds = F.create_map(*[F.lit(x).cast("bigint") for item in rests.items() for x in item])
            since = F.lit(batches) - F.col("fired_at")
            resting = last.join(world.loci, "locus_id").where(since < F.coalesce(kinds[F.col("kind")], F.lit(0))).select("locus_id")
        pending, fired = dispatch(world, engine, changes, resting)
        if rests:
            last = durable(fired.withColumn("fired_at", F.lit(batches)).unionAll(last).groupBy("locus_id").agg(F.max("fired_at").alias("fired_at")))
    return TickResult(world, batches, total, False)


def stimulus(world: World, rows: list[tuple[int, int, list[float]]]) -> DataFrame:
    """Pending changes without causes from (locus, kind, after)."""
    return world.spark.createDataFrame([("Locus", s, k, [], [float(x) for x in a], None, None) for s, k, a in rows], PENDING)


def trim_change_log(world: World, retention: int) -> World:
    """Roll changes older than the retention up by locus, then drop them."""
    keep_from = max(0, world.current_batch - retention)
    gone = world.locus_changes().where(F.col("batch") < keep_from)
    summary = gone.groupBy(F.col("subject_id").alias("locus_id")).agg(
        F.min("batch").alias("batch_from"), F.max("batch").alias("batch_to"), F.count(F.lit(1)).alias("change_count"),
        F.zip_with(F.max_by("after", "change_id"), F.min_by("before", "change_id"), lambda a, b: F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))).alias("net_delta"), F.array_sort(F.collect_set("kind")).alias("kinds_observed"),
    )
    return world.with_tables(changes=durable(world.changes.where(F.col("batch") >= keep_from)), trim_summaries=durable(world.trim_summaries.unionByName(summary)))


def check_invariants(world: World) -> dict[str, bool]:
    """Log invariants: dense ids, antecedent predecessors, one id per change, one edge per key and kind."""
    c = world.changes.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("change_id").alias("d"), F.min("change_id").alias("a"), F.max("change_id").alias("b")).first()
    late = world.change_edges.where("pred >= succ").limit(1).count()
    twice = world.relationships.groupBy("kind", "directed", F.when(F.col("directed"), F.col("src")).otherwise(F.least("src", "dst")).alias("u"), F.when(F.col("directed"), F.col("dst")).otherwise(F.greatest("src", "dst")).alias("v")).count().where("count > 1").limit(1).count()
    return {"dense": not c["n"] or c["b"] - c["a"] + 1 == c["n"], "unique": c["n"] == c["d"], "antecedent": not late, "edge_keys": not twice}


def energy(world: World) -> DataFrame:
    """(batch, energy): summed absolute activity of what changed."""
    return world.changes.groupBy("batch").agg(F.sum(F.abs(activity("after"))).alias("energy"))


def regimes(energies: DataFrame, window: int = 8) -> DataFrame:
    """(batch, energy, regime) by the energies of the last ``window`` batches.

    Initializing until there are that many; Quiescent below 1e-4; Diverging beyond
    1e3, or never falling and higher at the end; Settling if never rising;
    LimitCycleSuspect if any four in a row repeat at distance two; else Oscillating.
    """
    from pyspark.sql import Window

    last = Window.orderBy("batch").rowsBetween(-(window - 1), 0)  # batches of a log are few
    rows = energies.withColumn("h", F.collect_list("energy").over(last))
    steps = F.arrays_zip(F.slice("h", 1, F.greatest(F.size("h") - 1, F.lit(0))).alias("x"), F.slice("h", 2, F.size("h")).alias("y"))
    up, down = F.forall(steps, lambda p: p["y"] >= p["x"]), F.forall(steps, lambda p: p["y"] <= p["x"])
    at = lambda i: F.try_element_at("h", i.cast("int"))
    repeats = F.exists(F.sequence(F.lit(1), F.greatest(F.size("h") - 3, F.lit(1))), lambda i: (F.abs(at(i) - at(i + 2)) < 1e-3) & (F.abs(at(i + 1) - at(i + 3)) < 1e-3))
    regime = (
        F.when(F.size("h") < window, "Initializing").when(F.array_max("h") < 1e-4, "Quiescent")
        .when((F.array_max("h") > 1e3) | (up & (F.element_at("h", -1) > F.element_at("h", 1))), "Diverging")
        .when(down, "Settling").when(repeats, "LimitCycleSuspect").otherwise("Oscillating")
    )
    return rows.select("batch", "energy", regime.alias("regime"))


def guard_rail(scale: float, regime: str) -> float:
    """The next scale of a kind's learning: half when diverging, a tenth more when quiescent, within [0.1, 1]."""
    return min(1.0, max(0.1, scale * {"Diverging": 0.5, "Quiescent": 1.1}.get(regime, 1.0)))


__all__ = ["Engine", "InfluenceKind", "Program", "TickResult", "tick", "stimulus", "flush_decay", "demoted", "trim_change_log", "check_invariants", "regimes", "energy", "guard_rail", "numbered", "weight"]
