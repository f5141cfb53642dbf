"""Export: Graphviz text and readable rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..world import World

#: Edge colours by activity, from the lower bound on.
COLORS = ((0.8, "red"), (0.5, "orange"), (0.3, "gold"), (0.1, "steelblue"), (float("-inf"), "gray"))


def _labels(world: World) -> DataFrame:
    named = world.names.where("NOT is_alias").groupBy("locus_id").agg(F.min("name").alias("name"))
    return world.loci.join(named, "locus_id", "left").select("locus_id", "state", F.coalesce("name", F.concat(F.lit("locus_"), "locus_id")).alias("name"))


def dot_lines(world: World, kind: int | None = None) -> DataFrame:
    """(part, id, line): a Graphviz document; in order of part and id."""
    state = F.concat_ws(", ", F.transform("state", lambda x: F.format_number(x, 3)))
    nodes = _labels(world).select(F.lit(1).alias("part"), F.col("locus_id").alias("id"), F.format_string('  n%d [label="%s\\n%s"];', "locus_id", "name", state).alias("line"))
    edges = world.edges if kind is None else world.edges.where(F.col("kind") == kind)
    color = F.lit(COLORS[-1][1])
    for low, name in reversed(COLORS[:-1]):
        color = F.when(F.col("activity") >= low, name).otherwise(color)
    arrows = edges.select(F.lit(2), "rel_id", F.format_string('  n%d %s n%d [label="%.3f", color=%s%s];', "src", F.lit("->"), "dst", "activity", color, F.when(F.col("directed"), "").otherwise(", dir=none")))
    frame = world.spark.createDataFrame([(0, 0, "digraph world {"), (3, 0, "}")], "part int, id bigint, line string")
    return frame.unionAll(nodes).unionAll(arrows).orderBy("part", "id")


def write_dot(world: World, path: str, kind: int | None = None) -> None:
    """Write the document as text; the parts are in order by file name."""
    dot_lines(world, kind).select("line").write.mode("overwrite").text(path)


def relationship_list(world: World) -> DataFrame:
    """(rel_id, text): every edge with its loci's names."""
    name = _labels(world).select("locus_id", "name")
    rows = world.edges.join(name.withColumnsRenamed({"locus_id": "src", "name": "a"}), "src").join(name.withColumnsRenamed({"locus_id": "dst", "name": "b"}), "dst")
    return rows.select("rel_id", F.format_string("%s %s %s (kind %d, activity %.3f)", "a", F.when(F.col("directed"), "->").otherwise("--"), "b", "kind", "activity").alias("text"))


def entities_summary(world: World) -> DataFrame:
    """(entity_id, display_name, status, coherence, n_members, names): all member names in order; the display name has three."""
    name = _labels(world).select("locus_id", "name")
    member = world.entities.select("entity_id", F.explode("members").alias("locus_id")).join(name, "locus_id")
    named = member.groupBy("entity_id").agg(F.array_sort(F.collect_list("name")).alias("names"))
    rows = world.entities.join(named, "entity_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    display = F.concat(F.array_join(F.slice("names", 1, 3), ", "), F.when(F.size("members") > 3, "…").otherwise(""))
    return rows.select("entity_id", display.alias("display_name"), "status", "coherence", F.size("members").alias("n_members"), "names")
