"""Observation and control of a simulation: summaries of steps, their history, and handles under a tick policy."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import causality
from ..world import World
from . import recognition
from .engine import PENDING
from .stream import Simulation, StepObservation

REJECT, DROP_OLDEST, DROP_NEWEST = "reject", "drop_oldest", "drop_newest"


@dataclass
class TickSummary:
    """What a step did: counts on the driver, rows as DataFrames of the batches committed in it."""

    tick_id: int
    batches: int
    changes: int
    hit_batch_cap: bool
    batch_stats: DataFrame
    loci_changed: DataFrame
    relationships_emerged: int
    relationships_pruned: int
    entities_born: int
    entities_dormant: int
    entities_revived: int
    events: DataFrame

    @staticmethod
    def of(seen: StepObservation, before: int, world: World) -> TickSummary:
        """The summary of the batches from ``before`` to the world's current one."""
        inside = F.col("batch").between(before, world.current_batch - 1)
        own = world.with_tables(changes=world.changes.where(inside))
        events = world.world_events.where(inside)
        count = {r["type"]: r["count"] for r in events.groupBy("type").count().collect()}  # a few types
        return TickSummary(
            seen.step + 1, seen.batches, seen.changes, seen.hit_batch_cap, causality.batch_stats(own), own.locus_changes().select(F.col("subject_id").alias("locus_id")).distinct(),
            world.relationships.where(F.col("created_batch").between(before, world.current_batch - 1)).count(), world.pruned_log.where(inside).count(),
            count.get("EntityBorn", 0), count.get("EntityBecameDormant", 0), count.get("EntityRevived", 0), events,
        )


class EventHistory:
    """The last summaries, oldest first."""

    def __init__(self, most: int):
        self._kept: deque[TickSummary] = deque(maxlen=most)

    def push(self, summary: TickSummary) -> None:
        self._kept.append(summary)

    def __iter__(self) -> Iterator[TickSummary]:
        return iter(self._kept)

    def __len__(self) -> int:
        return len(self._kept)

    def last(self) -> TickSummary | None:
        return self._kept[-1] if self._kept else None


@dataclass
class StimulusQueue:
    """Pending stimuli, with a bound on their rows and what happens beyond it.

    ``reject`` raises and takes nothing; ``drop_newest`` leaves the offered ones out;
    ``drop_oldest`` lets whole earlier offers go until there is room.
    """

    most: int | None = None
    policy: str = REJECT
    parts: list[tuple[DataFrame, int]] = field(default_factory=list)

    def offer(self, stimuli: DataFrame) -> bool:
        n = stimuli.count()
        held = sum(x for _, x in self.parts)
        if self.most is not None and held + n > self.most:
            if self.policy == REJECT:
                raise OverflowError(f"{held} stimuli pending, {n} more exceed {self.most}")
            if self.policy == DROP_NEWEST or n > self.most:
                return False
            while sum(x for _, x in self.parts) + n > self.most:
                self.parts.pop(0)
        self.parts.append((stimuli, n))
        return True

    def take(self) -> DataFrame | None:
        out = None
        for part, _ in self.parts:
            out = part if out is None else out.unionByName(part)
        self.parts = []
        return out


@dataclass(frozen=True)
class TickPolicy:
    """When steps are made: by hand, when stimuli wait (or a heartbeat is due), or by the clock."""

    kind: str = "manual"
    seconds: float = 0.0

    @staticmethod
    def manual() -> TickPolicy:
        return TickPolicy()

    @staticmethod
    def change_driven(heartbeat: float) -> TickPolicy:
        return TickPolicy("change", heartbeat)

    @staticmethod
    def clock_driven(interval: float) -> TickPolicy:
        return TickPolicy("clock", interval)

    def needs_background_loop(self) -> bool:
        return self.kind != "manual" and self.seconds > 0


class LocalHandle:
    """A simulation as its users see it: one call at a time, results as values or DataFrames."""

    def __init__(self, controller: EngineController):
        self._controller = controller
        controller.handles += 1

    def step(self, stimuli: DataFrame | None = None) -> StepObservation:
        return self._controller.step(stimuli)

    def step_n(self, n: int, stimuli: DataFrame | None = None) -> list[StepObservation]:
        return [self.step(stimuli if i == 0 else None) for i in range(n)]

    def ingest(self, stimuli: DataFrame) -> bool:
        """Queue stimuli for the next step, and wake a background loop."""
        with self._controller.lock:
            taken = self._controller.queue.offer(stimuli.select(*[f.split()[0] for f in PENDING.split(", ")]))
        self._controller.wake.set()
        return taken

    def flush_ingested(self) -> StepObservation:
        return self.step()

    @property
    def world(self) -> World:
        return self._controller.simulation.world

    def current_batch(self) -> int:
        return self.world.current_batch

    def locus(self, locus: int) -> DataFrame:
        return self.world.loci.where(F.col("locus_id") == locus)

    def relationship(self, rel: int) -> DataFrame:
        return self.world.relationships.where(F.col("rel_id") == rel)

    def relationship_between(self, a: int, b: int) -> DataFrame:
        ends = ((F.col("src") == a) & (F.col("dst") == b)) | ((F.col("src") == b) & (F.col("dst") == a))
        return self.world.relationships.where(ends).orderBy("rel_id").limit(1)

    def loci_of_kind(self, kind: int) -> DataFrame:
        return self.world.loci.where(F.col("kind") == kind)

    def influence_kind_id(self, name: str) -> int | None:
        return next((k.kind for k in self._controller.simulation.engine.kinds if k.name == name), None)

    def recognize_entities(self, threshold: float | None = None) -> DataFrame:
        with self._controller.lock:
            sim = self._controller.simulation
            sim.world, events = recognition.recognize_entities(sim.world, threshold)
        return events

    def extract_cohere(self, perspective: str = "default", min_bridge: float | None = None) -> None:
        with self._controller.lock:
            sim = self._controller.simulation
            sim.world = recognition.extract_cohere(sim.world, perspective, min_bridge)


class EngineController:
    """Owns a simulation, its queue and its history; under a policy that asks for it, a thread makes the steps."""

    def __init__(self, simulation: Simulation, policy: TickPolicy | None = None, most_pending: int | None = None, backpressure: str = REJECT, history: int = 64):
        self.simulation, self.policy = simulation, policy or TickPolicy.manual()
        self.queue, self.history = StimulusQueue(most_pending, backpressure), EventHistory(history)
        self.lock, self.wake, self._stop = threading.RLock(), threading.Event(), threading.Event()
        self.handles, self._thread = 0, None
        if self.policy.needs_background_loop():
            self._thread = threading.Thread(target=self._run, daemon=True)
            self._thread.start()

    def handle(self) -> LocalHandle:
        return LocalHandle(self)

    def step(self, stimuli: DataFrame | None = None) -> StepObservation:
        with self.lock:
            before = self.simulation.world.current_batch
            waiting = self.queue.take()
            if waiting is not None:
                self.simulation.queued.append(waiting)
            seen = self.simulation.step(stimuli)
            self.history.push(TickSummary.of(seen, before, self.simulation.world))
        return seen

    def _run(self) -> None:
        while not self._stop.is_set():
            if self.policy.kind == "clock":
                self._stop.wait(self.policy.seconds)
            else:
                self.wake.wait(self.policy.seconds)
                self.wake.clear()
            if not self._stop.is_set():
                self.step()

    def close(self) -> None:
        self._stop.set()
        self.wake.set()
        if self._thread is not None:
            self._thread.join()
