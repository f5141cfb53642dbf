"""Traversal: one frontier kernel for reachability, paths, components, cycles and causal closure.

Every hop joins the frontier with the edges and removes what was visited; both are
written to the shared folder, so plans stay short and a lost executor costs one
hop.  The frontier is joined by shuffle unless it was counted small.  A graph that
was counted small is searched by one task instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import broadcast_if_small, durable, forget, salted_join, stored
from ..world import World

#: Rounds after which components give up with an error; they take the logarithm of the longest path.
MOST_ROUNDS = 100

#: Steps (two integers each, 32 MB in all) up to which one task searches by itself: a
#: graph so small isn't worth a job for every hop, however deep it is.
LOCAL_STEPS = 2_000_000


def arcs(world: World, direction: str = "both", kind: int | None = None, min_activity: float | None = None, where: Column | None = None) -> DataFrame:
    """(a, b, activity): steps that a traversal may take.

    ``direction``: both (undirected), out (with directed edges, symmetric ones
    both ways) or in.  ``min_activity`` keeps edges of that activity or more.
    """
    rows = world.incidence
    if direction == "out":
        rows = rows.where("outgoing")
    elif direction == "in":
        rows = rows.where("incoming")
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    if min_activity is not None:
        rows = rows.where(F.col("activity") >= F.lit(float(min_activity)))
    if where is not None:
        rows = rows.where(where)
    return rows.select(F.col("locus").alias("a"), F.col("other").alias("b"), "activity")


def frontier_loop(steps: DataFrame, starts: Iterable[int] | DataFrame, depth: int | None = None) -> DataFrame:
    """(node, depth): what (a, b) ``steps`` reach from the starts, which have depth 0."""
    spark = steps.sparkSession
    first = starts if isinstance(starts, DataFrame) else spark.createDataFrame([(int(s),) for s in starts], "node bigint")
    steps = steps.select("a", "b").distinct()
    if depth is None or depth > 1:
        steps = durable(steps)
        if steps.limit(LOCAL_STEPS + 1).count() <= LOCAL_STEPS:
            return _local_search(steps, first.select("node").distinct(), depth)
    frontier = durable(first.select("node").distinct().withColumn("depth", F.lit(0)))
    visited = frontier
    for hop in count(1) if depth is None else range(1, depth + 1):
        near = broadcast_if_small(frontier.select(F.col("node").alias("a")))
        reached = steps.join(near, "a").select(F.col("b").alias("node")).distinct().join(visited, "node", "left_anti")
        frontier = durable(reached.withColumn("depth", F.lit(hop)))
        if frontier.isEmpty():
            break
        visited = visited.unionAll(frontier)
        if hop % 8 == 0:
            visited = durable(visited)
    return visited


def local_search(a: np.ndarray, b: np.ndarray, starts: np.ndarray, depth: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, depths) that steps a -> b reach from the starts."""
    nodes = np.unique(np.concatenate([a, b, starts]))
    order = np.argsort(a, kind="stable")
    to = np.searchsorted(nodes, b[order])
    first = np.searchsorted(a[order], nodes, "left")
    last = np.searchsorted(a[order], nodes, "right")
    found = np.full(len(nodes), -1)
    frontier = np.searchsorted(nodes, np.unique(starts))
    hop = 0
    while len(frontier):
        found[frontier] = hop
        if hop == depth:
            break
        n = last[frontier] - first[frontier]
        at = np.repeat(first[frontier] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        near = np.unique(to[at])
        frontier, hop = near[found[near] < 0], hop + 1
    return nodes[found >= 0], found[found >= 0]


def _local_search(steps: DataFrame, starts: DataFrame, depth: int | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [x for x in batches if x.num_rows]
        if rows:
            table = pa.Table.from_batches(rows)
            a, b, start = (table.column(c).to_numpy() for c in ("a", "b", "start"))
            nodes, depths = local_search(a[~start], b[~start], a[start], depth)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(depths.astype(np.int32))], ["node", "depth"])

    marked = steps.select("a", "b", F.lit(False).alias("start")).unionAll(starts.select(F.col("node"), F.col("node"), F.lit(True)))
    return marked.coalesce(1).mapInArrow(run, "node bigint, depth int")


def closure(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """(node): the starts and all that (a, b) ``steps`` reach from them, without depths.

    More steps than one task takes are dealt into blocks by ranges of ``a``.  Blocks are
    searched one after another, each however many hops deep and from all that the ones
    before reached in it; a block is searched again only if a later one leads back into it.
    Where ids grow or fall along the steps, as in the log, every block is searched once.
    """
    starts = starts.select("node").distinct()
    steps = stored(steps.select("a", "b"))
    total, up, down, least, most = steps.agg(F.count(F.lit(1)), F.count_if(F.col("b") >= F.col("a")), F.count_if(F.col("b") <= F.col("a")), F.min("a"), F.max("a")).first()
    if total <= LOCAL_STEPS:
        return _local_search(steps, starts, None).select("node")
    n = -(-total // LOCAL_STEPS)
    bounds = sorted(set(steps.approxQuantile("a", [k / n for k in range(1, n)], 0.1 / n)))
    block = lambda c: sum((F.when(F.col(c) >= int(x), 1).otherwise(0) for x in bounds), F.lit(0)).cast("int")
    # Nothing goes on from beyond the last step: such a node is in block -1.
    placed = lambda df: df.withColumn("block", F.when(F.col("node").between(least, most), block("node")).otherwise(-1))
    dealt = stored(steps.withColumn("block", block("a")), "block")
    forget(steps)
    found, looked = [(-1, stored(placed(starts), "block"))], {}
    order = range(len(bounds) + 1) if up >= down else range(len(bounds), -1, -1)
    again = True
    while again:
        again = False
        for k in order:
            inside = [(by, t.where(F.col("block") == k).select("node")) for by, t in found]
            offered = [t for by, t in inside[looked.get(k, 0) :] if by != k]
            looked[k] = len(found)
            if not offered:
                continue
            seeds = reduce(DataFrame.unionAll, offered)
            if own := [t for by, t in inside if by == k]:  # it has gone on from these already
                seeds = seeds.join(reduce(DataFrame.unionAll, own), "node", "left_anti")
            if seeds.isEmpty():
                continue
            reached = _local_search(dealt.where(F.col("block") == k).select("a", "b"), seeds, None).select("node")
            found.append((k, stored(placed(reached), "block")))
            again = up < total and down < total
    forget(dealt)
    return reduce(DataFrame.unionAll, [t.select("node") for _, t in found]).distinct()


def reachable(world: World, start: int, depth: int, direction: str = "both", kind: int | None = None, min_activity: float | None = None) -> DataFrame:
    """(locus_id, depth) within ``depth`` hops, the start left out; depth 0 gives nothing."""
    found = frontier_loop(arcs(world, direction, kind, min_activity), [start], depth)
    return found.where("depth > 0").select(F.col("node").alias("locus_id"), "depth")


def reachable_matching(world: World, start: int, depth: int, predicate: Column) -> DataFrame:
    """Reachable loci of which a predicate holds; expansion ignores it."""
    return reachable(world, start, depth).join(world.loci, "locus_id").where(predicate).select("locus_id", "depth")


def shortest_path(world: World, source: int, target: int, direction: str = "both", kind: int | None = None, min_activity: float | None = None) -> DataFrame:
    """One row (path, hops) with a shortest path, or none; of equal paths the one whose text is least.

    ``source = target`` gives [source] whether it exists or not.  Distances to the
    target are found backwards; the path then steps to the neighbour one nearer
    whose id is least as text (10 before 9), so no join carries paths.
    """
    spark = world.spark
    if source == target:
        return spark.createDataFrame([([source], 0)], "path array<bigint>, hops int")
    steps = durable(arcs(world, direction, kind, min_activity).select("a", "b").where("a <> b").distinct())
    distance = durable(frontier_loop(steps.select(F.col("b").alias("a"), F.col("a").alias("b")), [target]))
    found = distance.where(F.col("node") == source).select("depth").first()
    if found is None:
        return spark.createDataFrame([], "path array<bigint>, hops int")
    path, hops = [source], found["depth"]
    for left in range(hops - 1, -1, -1):
        near = steps.where(F.col("a") == path[-1]).select(F.col("b").alias("node"))
        path.append(near.join(distance.where(F.col("depth") == left), "node").agg(F.min_by("node", F.col("node").cast("string")).alias("n")).first()["n"])
    return spark.createDataFrame([(path, hops)], "path array<bigint>, hops int")


def strongest_path(world: World, source: int, target: int) -> DataFrame:
    """One row (path, cost): least total 1 / max(activity, 1e-6), undirected; or none."""
    spark = world.spark
    if source == target:
        return spark.createDataFrame([([source], 0.0)], "path array<bigint>, cost double")
    cost = 1.0 / F.greatest(F.col("activity"), F.lit(1e-6))
    steps = durable(arcs(world).where("a <> b").groupBy("a", "b").agg(F.min(cost).alias("step")))
    best = durable(spark.createDataFrame([(source, 0.0, [source])], "node bigint, cost double, path array<bigint>"))
    changed = best
    while True:
        # Relax from what changed; a label beyond the target's can't improve it.
        bound = best.where(F.col("node") == target).agg(F.min("cost")).first()[0]
        live = changed if bound is None else changed.where(F.col("cost") < bound)
        offers = steps.join(broadcast_if_small(live.withColumnRenamed("node", "a")), "a").select(F.col("b").alias("node"), (F.col("cost") + F.col("step")).alias("cost"), F.concat("path", F.array("b")).alias("path"))
        offers = offers.groupBy("node").agg(F.min(F.struct("cost", "path")).alias("offer")).select("node", "offer.*")
        better = offers.join(best.select("node", F.col("cost").alias("known")), "node", "left").where("known IS NULL OR cost < known").drop("known")
        changed = durable(better)
        if changed.isEmpty():
            break
        best = durable(best.join(changed, "node", "left_anti").unionAll(changed))
    return best.where(F.col("node") == target).select("path", "cost")


def components(world: World, kind: int | None = None, nodes: DataFrame | None = None, steps: DataFrame | None = None) -> DataFrame:
    """(locus_id, component): weakly connected components by least member; loci without edges are their own.

    Alternating large and small stars: grouped minima and joins, a number of
    rounds logarithmic in the diameter; edges never grow.
    """
    steps = arcs(world, kind=kind) if steps is None else steps
    edges = stored(steps.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_least(large)
        last, edges = edges, stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        forget(last)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: no fixpoint in {MOST_ROUNDS} rounds")
    labels = edges.groupBy(F.col("u").alias("locus_id")).agg(F.min("v").alias("component"))
    nodes = world.loci.select("locus_id") if nodes is None else nodes
    everyone = nodes.unionAll(steps.select(F.explode(F.array("a", "b")).alias("locus_id"))).distinct()
    return everyone.join(labels, "locus_id", "left").select("locus_id", F.coalesce("component", "locus_id").alias("component"))


def _with_least(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return salted_join(edges, least, "u")  # the root of a large component is one key


def has_cycle(world: World) -> bool:
    """Whether directed edges (self-loops too, symmetric ones not) form a cycle.

    Loci without a way in or without a way out are peeled off, all at once in a
    round; a graph counted small is peeled by one task, since it may be deep.
    """
    edges = durable(world.relationships.where("directed").select("src", "dst").distinct())
    size = edges.count()
    if size <= LOCAL_STEPS:
        return not edges.coalesce(1).mapInArrow(_cyclic_rest, "src bigint").isEmpty()
    while size:
        left = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        edges, before = durable(left), size
        size = edges.count()
        if size == before:
            return True
    return False


def _cyclic_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One of the loci that are left after all without a way in have been peeled off."""
    rows = [x for x in batches if x.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    nodes, place = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("src", "dst")]), return_inverse=True)
    a, b = np.split(place, 2)
    order = np.argsort(a, kind="stable")
    to, first = b[order], np.searchsorted(a[order], np.arange(len(nodes) + 1))
    ways_in = np.bincount(b, minlength=len(nodes))
    free, left = np.flatnonzero(ways_in == 0), len(nodes)
    while len(free):
        left -= len(free)
        n = first[free + 1] - first[free]
        reached = to[np.repeat(first[free] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        ways_in -= np.bincount(reached, minlength=len(nodes))
        near = np.unique(reached)
        free = near[ways_in[near] == 0]
    if left:
        yield pa.RecordBatch.from_arrays([pa.array(nodes[ways_in > 0][:1])], ["src"])


def infer_transitive(world: World, source: int, target: int, kind: int, rule: str = "product") -> float | None:
    """Activity along one shortest directed path of a kind: product, min or mean of its steps; none for no path or one node."""
    found = shortest_path(world, source, target, "out", kind).first()
    if found is None or len(found["path"]) < 2:
        return None
    path = found["path"]
    hops = world.spark.createDataFrame(list(zip(path[:-1], path[1:], strict=True)), "a bigint, b bigint")
    values = arcs(world, "out", kind).join(F.broadcast(hops), ["a", "b"]).groupBy("a", "b").agg(F.max("activity").alias("x"))
    how = {"product": F.product("x"), "min": F.min("x"), "mean": F.avg("x")}[rule.lower()]
    return values.agg(how.alias("x")).first()["x"]


def induced_subgraph(world: World, loci: DataFrame) -> DataFrame:
    """Relationships with both ends in ``loci`` (locus_id)."""
    inside = loci.select("locus_id").distinct()
    return world.relationships.join(inside.withColumnRenamed("locus_id", "src"), "src", "left_semi").join(inside.withColumnRenamed("locus_id", "dst"), "dst", "left_semi").select(*world.relationships.columns)
