"""Persistence: a world as a folder of Parquet tables, snapshots and batch commits."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import durable
from ..world import SCHEMAS, World

SCHEMA_VERSION = 2

#: Tables with one row per key: a commit writes the rows that differ.  The others are written whole when they change.
KEYS = {"loci": "locus_id", "relationships": "rel_id", "entities": "entity_id", "properties": "locus_id", "facts": "fact_id"}

#: Parts of a table after which a commit writes the world anew.
MOST_PARTS = 16


@dataclass
class Storage:
    """A folder of table parts; the newest record in ``_meta`` names the parts that count.

    ``save`` writes all tables as one part each and removes what no record needs any
    more.  ``commit`` adds parts: the log's new batches, the rows of keyed tables that
    differ, the keys that are gone, and other tables if they are others.  Everything
    is written before the record, so a job that dies leaves the last state whole.
    """

    spark: SparkSession
    path: str
    _known: World | None = field(default=None, repr=False)

    def _place(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _meta(self) -> dict | None:
        place, files = self._place(f"{self.path}/_meta")
        if not files.exists(place):
            return None
        rows = self.spark.read.text(f"{self.path}/_meta").collect()
        return max((json.loads(r[0]) for r in rows), key=lambda m: m["version"]) if rows else None

    def _checked(self) -> dict | None:
        meta = self._meta()
        if meta and meta["schema"] != SCHEMA_VERSION:
            raise ValueError(f"schema {meta['schema']}, not {SCHEMA_VERSION}")
        return meta

    def _record(self, number: int, world: World, parts: dict, first_batch: int) -> None:
        record = json.dumps({"version": number, "schema": SCHEMA_VERSION, "current_batch": world.current_batch, "first_batch": first_batch, "parts": parts})
        self.spark.createDataFrame([(record,)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/_meta")
        self._known = world

    def _written(self, df: DataFrame, number: int, name: str, how: str) -> list:
        part = f"v{number}/{name}-{how}"
        writer = df.write.mode("overwrite")
        if name == "changes":
            writer = writer.partitionBy("batch")
        writer.parquet(f"{self.path}/{part}")
        return [part, how]

    def save(self, world: World) -> None:
        """Write all tables of a world as the next version; the parts before are removed."""
        meta = self._checked()
        number = meta["version"] + 1 if meta else 0
        parts = {name: [self._written(df, number, name, "whole")] for name, df in world.tables.items()}
        self._record(number, world, parts, 0)
        place, files = self._place(self.path)
        for old in files.listStatus(place):
            name = old.getPath().getName()
            if name.startswith("v") and name != f"v{number}":
                files.delete(old.getPath(), True)

    def commit(self, world: World) -> None:
        """Add what has changed since the last record."""
        meta = self._checked()
        if meta is None or any(len(x) >= MOST_PARTS for x in meta["parts"].values()):
            self.save(world)
            return
        number, parts, old = meta["version"] + 1, meta["parts"], self.load()
        known = self._known if self._known is not None and self._known.current_batch == meta["current_batch"] else None
        for name, df in world.tables.items():
            if known is not None and df is getattr(known, name):
                continue
            if name == "changes":
                new = df.where(F.col("batch") >= meta["current_batch"])
                if not new.isEmpty():
                    parts[name].append(self._written(new, number, name, "more"))
            elif name in KEYS:
                stored = getattr(old, name)
                differ = durable(df.exceptAll(stored))
                gone = durable(stored.select(KEYS[name]).join(df.select(KEYS[name]), KEYS[name], "left_anti"))
                if not gone.isEmpty():
                    parts[name].append(self._written(gone, number, name, "gone"))
                if not differ.isEmpty():
                    parts[name].append(self._written(differ, number, name, "rows"))
            else:
                parts[name] = [self._written(df, number, name, "whole")]
        first = world.changes.agg(F.min("batch")).first()[0]
        self._record(number, world, parts, first if first is not None else world.current_batch)

    def _table(self, name: str, parts: list, first_batch: int) -> DataFrame:
        schema, key, out = SCHEMAS[name], KEYS.get(name), None
        for part, how in parts:
            if how == "gone":
                keys = self.spark.read.schema(f"{key} bigint").parquet(f"{self.path}/{part}")
                out = out.join(keys, key, "left_anti").select(*out.columns)
                continue
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
            if how == "rows":
                out = out.join(rows.select(key), key, "left_anti").select(*rows.columns)
            out = rows if out is None or how == "whole" else out.unionByName(rows)
        return out.where(F.col("batch") >= first_batch) if name == "changes" else out

    def load(self) -> World:
        meta = self._checked()
        if meta is None:
            return World.of(self.spark)
        tables = {n: self._table(n, meta["parts"][n], meta["first_batch"]) for n in SCHEMAS}
        return World.of(self.spark, meta["current_batch"], **tables)

    def reset(self) -> None:
        place, files = self._place(self.path)
        files.delete(place, True)
        self._known = None

    @classmethod
    def open_or_reset(cls, spark: SparkSession, path: str) -> Storage:
        """The storage of a folder, emptied if its schema is another."""
        out = cls(spark, path)
        try:
            out._checked()
        except (ValueError, KeyError, json.JSONDecodeError):
            out.reset()
        return out

    # Lookups; filters on partition columns and ids reach the scan.

    def table(self, name: str) -> DataFrame:
        return getattr(self.load(), name)

    def get(self, name: str, key: str, value: int) -> DataFrame:
        return self.table(name).where(F.col(key) == value)

    def changes_for_batch(self, batch: int) -> DataFrame:
        return self.table("changes").where(F.col("batch") == batch)

    def relationships_for_locus(self, locus: int) -> DataFrame:
        return self.table("relationships").where((F.col("src") == locus) | (F.col("dst") == locus))

    def resolve_name(self, name: str) -> DataFrame:
        return self.table("names").where(F.col("name") == name).select("locus_id")

    def table_counts(self) -> dict[str, int]:
        return {n: df.count() for n, df in self.load().tables.items()}


def evict_cold(world: World, threshold: float, min_idle: int) -> tuple[World, DataFrame]:
    """(world of the hot edges, the cold ones): faint in magnitude and idle for long."""
    cold = (F.abs("activity") < F.lit(float(threshold))) & (F.greatest(F.lit(world.current_batch) - F.col("last_decayed_batch"), F.lit(0)) >= min_idle)
    columns = world.relationships.columns
    return world.with_tables(relationships=world.edges.where(~cold).select(*columns)), world.edges.where(cold).select(*columns)


def promote(world: World, cold: DataFrame, loci: list[int] | None = None) -> World:
    """Cold edges back into the world: all, or those of some loci."""
    rows = cold if loci is None else cold.where(F.col("src").isin(*loci) | F.col("dst").isin(*loci))
    return world.with_tables(relationships=world.relationships.unionByName(rows.join(world.relationships.select("rel_id"), "rel_id", "left_anti").select(*cold.columns)))
