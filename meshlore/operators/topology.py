"""Neighbourhoods, degrees, reciprocity, triangles and structural balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import broadcast_if_small, durable, spread
from ..functions.vectors import strength
from ..world import World


def neighbors_of(world: World, locus: int, kind: int | None = None) -> DataFrame:
    """One row per incident edge: parallel edges repeat a neighbour."""
    rows = world.incidence.where(F.col("locus") == locus)
    return (rows if kind is None else rows.where(F.col("kind") == kind)).select(F.col("other").alias("locus_id"), "rel_id")


def degrees(world: World) -> DataFrame:
    """(locus_id, degree, in_degree, out_degree) of loci with edges; in and out count directed edges."""
    directed = F.col("directed")
    return world.incidence.groupBy(F.col("locus").alias("locus_id")).agg(
        F.count(F.lit(1)).alias("degree"), F.count_if(directed & F.col("incoming")).alias("in_degree"), F.count_if(directed & F.col("outgoing")).alias("out_degree")
    )


def isolated_loci(world: World) -> DataFrame:
    return world.loci.join(world.incidence.select(F.col("locus").alias("locus_id")), "locus_id", "left_anti").select("locus_id")


def hub_loci(world: World, min_degree: int) -> DataFrame:
    """Loci of that degree or more; loci without edges never."""
    return degrees(world).where(F.col("degree") >= min_degree).select("locus_id", "degree")


def most_connected_loci(world: World, n: int) -> DataFrame:
    return degrees(world).select("locus_id", "degree").orderBy(F.desc("degree"), "locus_id").limit(n)


def source_loci(world: World) -> DataFrame:
    return degrees(world).where("in_degree = 0 AND out_degree > 0").select("locus_id")


def sink_loci(world: World) -> DataFrame:
    return degrees(world).where("out_degree = 0 AND in_degree > 0").select("locus_id")


def reciprocal_of(world: World, rel_id: int) -> DataFrame:
    """The reverse directed edge of the same kind; none for symmetric edges."""
    own = world.relationships.where((F.col("rel_id") == rel_id) & F.col("directed")).select(F.col("kind"), F.col("src").alias("dst"), F.col("dst").alias("src"))
    return world.relationships.where("directed").join(F.broadcast(own.limit(1)), ["kind", "src", "dst"]).select("rel_id")


def reciprocal_pairs(world: World) -> DataFrame:
    """(rel_a, rel_b): each pair once, rel_a <= rel_b; a directed self-loop is its own."""
    directed = world.relationships.where("directed")
    a = directed.select(F.col("rel_id").alias("rel_a"), "kind", "src", "dst")
    b = directed.select(F.col("rel_id").alias("rel_b"), "kind", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return a.join(b, ["kind", "src", "dst"]).where("rel_a <= rel_b").select("rel_a", "rel_b")


def undirected_pairs(world: World, value: Column | None = None, where: Column | None = None) -> DataFrame:
    """(u, v, strength) with u < v: parallel edges added up."""
    rows = world.relationships if where is None else world.relationships.where(where)
    return rows.where("src <> dst").groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.sum(strength() if value is None else value).alias("strength"))


def triangles_of(pairs: DataFrame) -> DataFrame:
    """(x, p, q, xp, xq, pq): each triangle of ``pairs`` (u, v, value; u < v) once, with its pairs' values; p < q.

    Each pair is directed from its end of lower degree (then lower id), so a wedge
    starts where few pairs are: a hub with d pairs doesn't make d^2 rows.
    """
    pairs = durable(pairs)
    ends = pairs.select(F.col("u").alias("n")).unionAll(pairs.select(F.col("v").alias("n"))).groupBy("n").agg(F.count(F.lit(1)).alias("d"))
    ranked = pairs.join(ends.select(F.col("n").alias("u"), F.col("d").alias("du")), "u").join(ends.select(F.col("n").alias("v"), F.col("d").alias("dv")), "v")
    low = F.struct("du", "u") < F.struct("dv", "v")
    arcs = durable(ranked.select(F.when(low, F.col("u")).otherwise(F.col("v")).alias("x"), F.when(low, F.col("v")).otherwise(F.col("u")).alias("y"), "value"))
    # Few bytes of pairs may make many wedges, so the tasks are counted, not sized.
    one = spread(arcs.select("x", F.col("y").alias("p"), F.col("value").alias("xp")), "x")
    other = spread(arcs.select("x", F.col("y").alias("q"), F.col("value").alias("xq")), "x")
    wedge = one.join(other, "x").where("p < q")
    return wedge.join(broadcast_if_small(pairs.select(F.col("u").alias("p"), F.col("v").alias("q"), F.col("value").alias("pq"))), ["p", "q"])


def all_triangles(world: World, where: Column | None = None) -> DataFrame:
    """(a, b, c, s_ab, s_bc, s_ac) with a < b < c."""
    t = triangles_of(undirected_pairs(world, where=where).withColumnRenamed("strength", "value"))
    # The three corners in order; the strengths of the opposite sides go along.
    first, last = F.col("x") < F.col("p"), F.col("x") > F.col("q")
    pick = lambda low, high, middle: F.when(first, low).when(last, high).otherwise(middle)
    return t.select(
        pick(F.col("x"), F.col("p"), F.col("p")).alias("a"), pick(F.col("p"), F.col("q"), F.col("x")).alias("b"), pick(F.col("q"), F.col("x"), F.col("q")).alias("c"),
        pick(F.col("xp"), F.col("pq"), F.col("xp")).alias("s_ab"), pick(F.col("pq"), F.col("xq"), F.col("xq")).alias("s_bc"), pick(F.col("xq"), F.col("xp"), F.col("pq")).alias("s_ac"),
    )


def triangle_balance(world: World, threshold: float, where: Column | None = None) -> DataFrame:
    """Triangles with ``balanced``: the product of the signs (strength > threshold) is positive."""
    signs = [F.when(F.col(c) > threshold, 1).otherwise(-1) for c in ("s_ab", "s_bc", "s_ac")]
    return all_triangles(world, where).select("a", "b", "c", (signs[0] * signs[1] * signs[2] > 0).alias("balanced"))


def unstable_triangles(world: World, threshold: float, where: Column | None = None) -> DataFrame:
    return triangle_balance(world, threshold, where).where("NOT balanced").select("a", "b", "c")


def balance_index(world: World, threshold: float, where: Column | None = None) -> DataFrame:
    """One row: the share of balanced triangles, 0 without triangles."""
    return triangle_balance(world, threshold, where).agg(F.coalesce(F.avg(F.col("balanced").cast("double")), F.lit(0.0)).alias("balance_index"), F.count(F.lit(1)).alias("triangles"))
