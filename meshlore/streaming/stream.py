"""Structured Streaming: event streams with watermarks and windows, sessions of evidence, and the simulation as a sink."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import durable
from ..world import World
from .engine import PENDING, Engine, TickResult, energy, flush_decay, regimes, subscribers_of, tick, without_demoted

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of Parquet files of the events table, with an event time."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_activity(events: DataFrame, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, events, total): event-time windows; later than the watermark is dropped."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def evidence_sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day", min_evidence: float = 0.0) -> DataFrame:
    """(user_id, started, ended, events, evidence): sessions that end after a gap, with enough evidence."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("evidence"))
    return out.where(F.abs("evidence") >= F.lit(float(min_evidence))).select("user_id", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "events", "evidence")


@dataclass
class StepObservation:
    step: int
    batches: int
    changes: int
    relationships: int
    active_entities: int
    regime: str
    hit_batch_cap: bool


@dataclass
class Simulation:
    """The world with its engine: steps, triggers, observers and ingestion."""

    world: World
    engine: Engine
    storage: object | None = None
    history: list[StepObservation] = field(default_factory=list)
    triggers: list[tuple[Callable, bool]] = field(default_factory=list)
    observers: list[tuple[Callable, bool]] = field(default_factory=list)
    queued: list[DataFrame] = field(default_factory=list)

    def step(self, stimuli: DataFrame | None = None) -> StepObservation:
        """Queued stimuli and the given ones through one tick; triggers queue for the next step."""
        pending = self.world.spark.createDataFrame([], PENDING)
        for part in [*self.queued, *([stimuli] if stimuli is not None else [])]:
            pending = pending.unionByName(part)
        self.queued = []
        result: TickResult = tick(self.world, self.engine, pending)
        self.world = without_demoted(result.world, self.engine)
        last = regimes(energy(self.world)).orderBy(F.desc("batch")).select("regime").first()
        seen = StepObservation(len(self.history), result.batches, result.changes, self.world.relationships.count(), self.world.entities.where("status = 'Active'").count(), last[0] if last else "Initializing", result.hit_batch_cap)
        self.history.append(seen)
        self._fire(seen)
        if self.storage is not None:
            self.storage.commit(self.world)
        return seen

    def _fire(self, seen: StepObservation) -> None:
        for call, _ in self.observers:
            call(seen)
        self.observers = [x for x in self.observers if not x[1]]
        left = []
        for call, once in self.triggers:
            made = call(seen)
            if made is not None:
                self.queued.append(made)
            if not (once and made is not None):
                left.append((call, once))
        self.triggers = left

    def step_n(self, n: int, stimuli: DataFrame | None = None) -> list[StepObservation]:
        return [self.step(stimuli if i == 0 else None) for i in range(n)]

    def step_until(self, done: Callable[[StepObservation, World], bool], most: int, stimuli: DataFrame | None = None) -> tuple[list[StepObservation], bool]:
        out = []
        for i in range(most):
            out.append(self.step(stimuli if i == 0 else None))
            if done(out[-1], self.world):
                return out, True
        return out, False

    def add_trigger(self, call: Callable[[StepObservation], DataFrame | None], once: bool = False) -> None:
        self.triggers.append((call, once))

    def watch_once(self, condition: Callable[[StepObservation], bool], handler: Callable[[StepObservation], DataFrame | None]) -> None:
        self.triggers.append((lambda seen: handler(seen) if condition(seen) else None, True))

    def add_observer(self, call: Callable[[StepObservation], None], once: bool = False) -> None:
        self.observers.append((call, once))

    def flush_decay(self) -> None:
        self.world = self.world.with_tables(relationships=durable(flush_decay(self.world, self.engine).relationships))


def simulate_stream(simulation: Simulation, events: DataFrame, to_stimuli: Callable[[DataFrame], DataFrame], checkpoint: str):
    """A streaming query that makes one step of every micro-batch; ``to_stimuli`` maps its rows."""

    def write(rows: DataFrame, _: int) -> None:
        simulation.step(durable(to_stimuli(rows)))

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def subscribe(world: World, rows: Iterable[tuple[int, str, int | None, int | None, int | None]], batch: int | None = None) -> World:
    """Add subscriptions (subscriber, scope, rel_id, kind, anchor), each once, and note them in the audit."""
    new = world.spark.createDataFrame(list(rows), world.subscriptions.schema)
    events = new.where("scope = 'Specific'").select(F.lit(world.current_batch if batch is None else batch).cast("bigint").alias("batch"), "subscriber", "rel_id", F.lit(True).alias("subscribed"))
    return world.with_tables(subscriptions=world.subscriptions.unionByName(new).distinct(), subscription_events=world.subscription_events.unionByName(events))


__all__ = ["Simulation", "StepObservation", "read_events", "windowed_activity", "evidence_sessions", "simulate_stream", "subscribe", "subscribers_of", "subscription_audit"]


def subscription_audit(world: World, first: int, last: int) -> DataFrame:
    return world.subscription_events.where(F.col("batch").between(first, last - 1))
