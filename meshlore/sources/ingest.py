"""Ingestion: named records become loci, properties and stimuli; co-occurrence becomes edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import durable
from ..streaming.engine import PENDING, numbered
from ..world import World


class IngestError(ValueError):
    """A record names a kind that isn't registered."""


def passthrough_state(props: str = "props") -> Column:
    """The default encoding: ``_state`` if it is a list of numbers, else [confidence] (0 without one)."""
    parsed = F.try_parse_json(props)
    given = F.try_variant_get(parsed, "$._state", "array<double>")
    return F.coalesce(given, F.array(F.coalesce(F.try_variant_get(parsed, "$.confidence", "double"), F.lit(0.0))))


def ingest(world: World, records: DataFrame, kinds: dict[str, int], influence: int, encoder: Callable[[str], Column] = passthrough_state) -> tuple[World, DataFrame]:
    """Upsert records (name, kind, props): the world with loci, names and properties, and the stimuli.

    Known names keep their locus and merge their properties, new keys over old;
    new names get the next ids in order of name.  Of repeated names the last in
    order of properties counts.
    """
    given = durable(records.groupBy("name").agg(F.max_by("kind", "props").alias("kind"), F.max("props").alias("props")))
    unknown = [r[0] for r in given.select("kind").distinct().where(~F.col("kind").isin(*kinds)).limit(5).collect()]
    if unknown:
        raise IngestError(f"unknown kinds: {', '.join(map(str, unknown))}")
    known = given.join(world.names.select("name", "locus_id"), "name", "left")
    top = world.loci.agg(F.coalesce(F.max("locus_id"), F.lit(-1))).first()[0]
    fresh = numbered(known.where("locus_id IS NULL").drop("locus_id"), ["name"], top + 1, "locus_id")
    kind = F.lit(None).cast("bigint")
    for name, number in kinds.items():
        kind = F.when(F.col("kind") == name, F.lit(number).cast("bigint")).otherwise(kind)
    every = durable(known.where("locus_id IS NOT NULL").unionByName(fresh).withColumn("state", encoder("props")))
    loci = world.loci.unionByName(every.join(world.loci.select("locus_id"), "locus_id", "left_anti").select("locus_id", kind.alias("kind"), "state"))
    names = world.names.unionByName(fresh.select("name", "locus_id", F.lit(False).alias("is_alias")))
    as_map = lambda c: F.from_json(c, "map<string,string>")
    merged = world.properties.join(every.select("locus_id", F.col("props").alias("new")), "locus_id", "full")
    old_only = F.map_filter(as_map(F.coalesce("props", F.lit("{}"))), lambda k, _: ~F.map_contains_key(as_map(F.coalesce("new", F.lit("{}"))), k))
    props = merged.select("locus_id", F.when(F.col("new").isNull(), F.col("props")).when(F.col("props").isNull(), F.col("new")).otherwise(F.to_json(F.map_concat(old_only, as_map("new")))).alias("props"))
    none = F.lit(None)
    stimuli = every.select(F.lit("Locus").alias("subject_type"), F.col("locus_id").alias("subject_id"), F.lit(influence).cast("bigint").alias("kind"), F.array().cast("array<bigint>").alias("predecessors"), F.col("state").alias("after"), none.cast("bigint").alias("wall_time"), none.cast("string").alias("metadata"))
    return world.with_tables(loci=durable(loci), names=durable(names), properties=durable(props)), stimuli


def cooccurrence(world: World, groups: DataFrame, influence: int) -> DataFrame:
    """Pending activations of groups (group_id, locus_id): each is caused by the last changes of the others in its group."""
    last = world.locus_changes().groupBy(F.col("subject_id").alias("locus_id")).agg(F.max("change_id").alias("last"))
    member = groups.select("group_id", "locus_id").distinct()
    others = member.join(member.join(last, "locus_id").select("group_id", F.col("locus_id").alias("other"), "last"), "group_id").where("locus_id <> other")
    causes = others.groupBy("locus_id").agg(F.array_sort(F.collect_set("last")).alias("predecessors"))
    none = F.lit(None)
    rows = member.select("locus_id").distinct().join(causes, "locus_id", "left")
    return rows.select(F.lit("Locus").alias("subject_type"), F.col("locus_id").alias("subject_id"), F.lit(influence).cast("bigint").alias("kind"), F.coalesce("predecessors", F.array().cast("array<bigint>")).alias("predecessors"), F.array(F.lit(1.0)).alias("after"), none.cast("bigint").alias("wall_time"), none.cast("string").alias("metadata"))


def read_edge_list(spark, path: str, bucket_seconds: int = 604_800) -> DataFrame:
    """(batch, a, b) of a text file of "from to seconds": loops dropped, unordered pairs once a bucket; # begins a comment."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    edges = rows.select(parts[0].cast("bigint").alias("x"), parts[1].cast("bigint").alias("y"), F.floor(parts[2].cast("bigint") / bucket_seconds).alias("batch")).where("x <> y")
    return edges.select("batch", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def extract_from_text(texts: DataFrame, client_factory: Callable, kinds: list[str]) -> DataFrame:
    """(name, kind, props) that a language model client finds in texts (text); the client is made on each worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        client = client_factory()
        for batch in batches:
            rows = []
            for text in batch["text"].fillna(""):
                for node in json.loads(client.complete(f"Extract entities of kinds {', '.join(kinds)} as JSON.", text) or "[]"):
                    if node.get("kind") in kinds and node.get("name"):
                        rows.append((node["name"], node["kind"], json.dumps(node.get("properties", {}), sort_keys=True)))
            yield pd.DataFrame(rows, columns=["name", "kind", "props"])

    return texts.select("text").mapInPandas(run, "name string, kind string, props string")


def empty_pending(world: World) -> DataFrame:
    return world.spark.createDataFrame([], PENDING)
