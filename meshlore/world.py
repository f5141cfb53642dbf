"""The world: an immutable bundle of DataFrames, one for each layer of the model."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import durable
from .functions.vectors import activity, weight

#: Schemas of the tables (FIXTURES.md, part A4).
SCHEMAS = {
    "loci": "locus_id bigint, kind bigint, state array<double>",
    "relationships": "rel_id bigint, kind bigint, directed boolean, src bigint, dst bigint, state array<double>, created_by bigint, last_touched_by bigint, change_count bigint, "
    "kinds_observed array<struct<kind:bigint,touch_count:bigint,last_batch:bigint>>, created_batch bigint, last_decayed_batch bigint, metadata string",
    "changes": "change_id bigint, subject_type string, subject_id bigint, kind bigint, predecessors array<bigint>, before array<double>, after array<double>, batch bigint, wall_time bigint, metadata string",
    "entities": "entity_id bigint, status string, members array<bigint>, member_rels array<bigint>, coherence double, parents array<bigint>, children array<bigint>",
    "entity_layers": "entity_id bigint, seq bigint, batch bigint, transition string, added array<bigint>, removed array<bigint>, offspring array<bigint>, absorbed array<bigint>, coh_from double, coh_to double, "
    "compression string, coherence double, member_count bigint, members array<bigint>, member_rels array<bigint>, cause struct<type:string,rels:array<bigint>,entities:array<bigint>>",
    "coheres": "perspective string, batch bigint, cohere_id bigint, entity_ids array<bigint>, relationship_ids array<bigint>, strength double",
    "properties": "locus_id bigint, props string",
    "names": "name string, locus_id bigint, is_alias boolean",
    "facts": "fact_id bigint, subject bigint, predicate string, object bigint, asserted_at bigint, retracted_at bigint",
    "subscriptions": "subscriber bigint, scope string, rel_id bigint, kind bigint, anchor bigint",
    "subscription_events": "batch bigint, subscriber bigint, rel_id bigint, subscribed boolean",
    "trim_summaries": "locus_id bigint, batch_from bigint, batch_to bigint, change_count bigint, net_delta array<double>, kinds_observed array<bigint>",
    "pruned_log": "rel_id bigint, batch bigint",
    "pending_evidence": "src bigint, dst bigint, directed boolean, kind bigint, signal double, first_seen bigint, last_touched bigint, change_ids array<bigint>",
    "world_events": "batch bigint, type string, subject bigint, payload string",
}


@dataclass(frozen=True)
class World:
    spark: SparkSession
    loci: DataFrame
    relationships: DataFrame
    changes: DataFrame
    entities: DataFrame
    entity_layers: DataFrame
    coheres: DataFrame
    properties: DataFrame
    names: DataFrame
    facts: DataFrame
    subscriptions: DataFrame
    subscription_events: DataFrame
    trim_summaries: DataFrame
    pruned_log: DataFrame
    pending_evidence: DataFrame
    world_events: DataFrame
    #: Logical time: the batch that comes next.
    current_batch: int = 0
    _own: dict = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def of(cls, spark: SparkSession, current_batch: int = 0, **tables: DataFrame) -> World:
        """A world of the given tables; the others are empty."""
        return cls(spark, **{n: tables[n] if n in tables else spark.createDataFrame([], s) for n, s in SCHEMAS.items()}, current_batch=current_batch)

    @classmethod
    def from_rows(cls, spark: SparkSession, current_batch: int = 0, **rows: list) -> World:
        """A world of literal rows: tuples in the order of the schemas, padded with nulls, or dicts."""
        tables = {}
        for name, given in rows.items():
            columns = [c.strip().split(" ", 1)[0] for c in _split(SCHEMAS[name])]
            full = [tuple(r.get(c) for c in columns) if isinstance(r, dict) else tuple(r) + (None,) * (len(columns) - len(r)) for r in given]
            tables[name] = spark.createDataFrame(full, SCHEMAS[name])
        return cls.of(spark, current_batch, **tables)

    def with_tables(self, **tables) -> World:
        return replace(self, **tables, _own={})

    def durable(self, *names: str) -> World:
        """The same world with some tables written to the shared folder."""
        return self.with_tables(**{n: durable(getattr(self, n)) for n in names})

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name in SCHEMAS}

    # Views; expressions only, so the optimiser sees through them.

    @cached_property
    def edges(self) -> DataFrame:
        """Relationships with ``activity`` and ``weight`` as columns."""
        return self.relationships.withColumns({"activity": activity(), "weight": weight()})

    @cached_property
    def incidence(self) -> DataFrame:
        """(locus, other, rel_id, kind, directed, outgoing, incoming, activity, weight): one row per locus and incident edge; a self-loop once."""
        base = ["rel_id", "kind", "directed", "activity", "weight"]
        out = self.edges.select(F.col("src").alias("locus"), F.col("dst").alias("other"), *base, F.lit(True).alias("outgoing"), (~F.col("directed") | (F.col("src") == F.col("dst"))).alias("incoming"))
        into = self.edges.where("src <> dst").select(F.col("dst").alias("locus"), F.col("src").alias("other"), *base, (~F.col("directed")).alias("outgoing"), F.lit(True).alias("incoming"))
        return out.unionAll(into)

    @cached_property
    def change_edges(self) -> DataFrame:
        """(succ, pred): predecessors that the log still has, or not."""
        return self.changes.select(F.col("change_id").alias("succ"), F.explode("predecessors").alias("pred"))

    def locus_changes(self) -> DataFrame:
        return self.changes.where("subject_type = 'Locus'")

    def relationship_changes(self) -> DataFrame:
        return self.changes.where("subject_type = 'Relationship'")


def _split(ddl: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:i])
            start = i + 1
    return [*out, ddl[start:]]
