"""Language model narration over query results: prompts are assembled here, clients are pluggable."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import functions as F

from .operators import entities as _entities
from .sources.export import entities_summary, relationship_list
from .world import World


class Client(Protocol):
    def complete(self, system: str, user: str) -> str: ...


@dataclass
class MockClient:
    """Gives the same answer to everything."""

    answer: str = ""

    def complete(self, system: str, user: str) -> str:
        return self.answer


@dataclass
class CapturingClient:
    """Gives an answer and keeps what it was asked."""

    answer: str = ""
    calls: list[tuple[str, str]] = field(default_factory=list)

    def complete(self, system: str, user: str) -> str:
        self.calls.append((system, user))
        return self.answer


@dataclass
class Narrator:
    world: World
    client: Client
    top_k: int = 20

    def ask(self, question: str) -> str:
        """Answer from the edges and groups whose names occur in the question, strongest first."""
        words = [w.lower() for w in question.replace("?", " ").split() if len(w) > 2]
        text = F.lower("text")
        score = sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))
        rows = relationship_list(self.world).withColumn("score", score).orderBy(F.desc("score"), "rel_id").limit(self.top_k).collect()
        groups = entities_summary(self.world).orderBy(F.desc("coherence"), "entity_id").limit(self.top_k).collect()
        facts = "\n".join([r["text"] for r in rows] + [f"group {g['entity_id']}: {', '.join(g['names'][:10])}" for g in groups])
        return self.client.complete("Answer from these facts only.", f"{facts}\n\nQuestion: {question}")

    def narrate_counterfactual(self, removed: list[tuple[str, str]]) -> str:
        return self.client.complete("Tell what would not have come about.", "\n".join(f"{a} -> {b}" for a, b in removed) or "nothing")

    def narrate_entity_deviations(self, baseline: int) -> str:
        rows = _entities.entity_deviations_since(self.world, baseline).orderBy("entity_id").limit(self.top_k).collect()
        return self.client.complete("Tell how these groups changed.", "\n".join(str(r.asDict()) for r in rows))

    def narrate_boundary(self, threshold: float = 0.1) -> str:
        row = _entities.boundary_summary(_entities.boundary(self.world, threshold)).first()
        return self.client.complete("Compare what is declared with what is observed.", str(row.asDict()))

    def narrate_prescriptions(self, actions) -> str:
        rows = actions.limit(self.top_k).collect()
        return self.client.complete("Explain these corrections.", "\n".join(str(r.asDict()) for r in rows))

    def score_prediction(self, task: str, truth: str, prediction: str, metrics: str) -> str:
        return self.client.complete("Score the prediction.", f"{task}\ntruth: {truth}\nprediction: {prediction}\n{metrics}")

    def configure(self, what: str, description: str) -> dict:
        """Settings of an influence, recognition or coherence as the client's JSON names them."""
        import json

        return json.loads(self.client.complete(f"Give the settings of {what} as JSON.", description) or "{}")
