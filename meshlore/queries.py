"""Queries over the driver tables' world, each with the SQL that DuckDB answers it by (where SQL can)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors as V
from .operators import causality, centrality, emergence, entities, equivalence, find, topology, traversal
from .operators.find import EntityPredicate as E
from .operators.find import LocusPredicate as L
from .operators.find import RelationshipPredicate as R
from .plans.query import Query, execute
from .sources.export import dot_lines, entities_summary, relationship_list
from .sources.projection import ORACLE_WITH, project
from .streaming import engine, stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SUPPLIER, PART = 10_000_000, 20_000_000


def _query(name: str, sql: str | None = None):
    """Register a function of the world; ``sql`` follows the WITH clause of the projection."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(project(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = ORACLE_WITH + sql
        return f

    return add


def _run(name: str, variant: str, args: dict, select: list[str], sql: str | None = None) -> None:
    _query(name, sql)(lambda w: execute(w, Query(variant, args)).selectExpr(*select))


def r6(column: str) -> str:
    return f"round({column}, 6)"


EDGE = ["rel_id", "kind", "src", "dst", "round(activity, 6) AS activity", "round(weight, 6) AS weight"]
EDGE_SQL = "rel_id, kind, src, dst, round(activity, 6) AS activity, round(weight, 6) AS weight"

# Find queries, filters, top-k.

_run("find_relationships_top_strength", "FindRelationships", {"predicates": [["of_kind", [1]], ["activity_above", [0.55]]], "sort": "strength", "limit": 100}, EDGE,
     f"SELECT {EDGE_SQL} FROM (SELECT * FROM rel WHERE kind = 1 AND activity > 0.55 ORDER BY activity + weight DESC, rel_id LIMIT 100)")
_run("find_relationships_touching", "FindRelationships", {"predicates": [["touching", [SUPPLIER + 3]], ["min_change_count", [2]]]}, EDGE, f"SELECT {EDGE_SQL} FROM rel WHERE (src = {SUPPLIER + 3} OR dst = {SUPPLIER + 3}) AND change_count >= 2")
_run("find_relationships_from_created", "FindRelationships", {"predicates": [["from_locus", [SUPPLIER + 5]], ["created_in", [3, 30]], ["slot_above", [1, 0.031]]]}, EDGE, f"SELECT {EDGE_SQL} FROM rel WHERE directed AND src = {SUPPLIER + 5} AND created_batch BETWEEN 3 AND 30 AND weight >= 0.031")
_run("find_relationships_to_older", "FindRelationships", {"predicates": [["to_locus", [SUPPLIER + 7]], ["older_than", [83, 20]], ["strength_above", [0.333]]], "sort": "change_count", "limit": 50}, EDGE,
     f"SELECT {EDGE_SQL} FROM (SELECT * FROM rel WHERE directed AND dst = {SUPPLIER + 7} AND greatest(83 - created_batch, 0) >= 20 AND activity + weight > 0.333 ORDER BY change_count DESC, rel_id LIMIT 50)")
_run("find_loci_state", "FindLoci", {"predicates": [["of_kind", [1]], ["state_above", [0, 1000.5]], ["state_below", [0, 5000.5]]], "sort": ["state", 0], "limit": 40}, ["locus_id", "round(state[0], 6) AS s0"],
     "SELECT locus_id, round(s0, 6) AS s0 FROM (SELECT * FROM loci WHERE kind = 1 AND s0 >= 1000.5 AND s0 <= 5000.5 ORDER BY s0 DESC, locus_id LIMIT 40)")
_run("find_loci_degree", "FindLoci", {"predicates": [["of_kind", [2]], ["min_degree", [20]]], "sort": "degree", "limit": 30}, ["locus_id"],
     "SELECT l.locus_id FROM loci l JOIN (SELECT locus, count(*) AS d FROM inc GROUP BY locus) i ON i.locus = l.locus_id WHERE l.kind = 2 AND d >= 20 ORDER BY d DESC, l.locus_id LIMIT 30")
_run("find_loci_property", "FindLoci", {"predicates": [["str_property_eq", ["segment", "BUILDING"]], ["f64_property_above", ["balance", 2500.5]]]}, ["locus_id"], "SELECT c_custkey AS locus_id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 2500.5")
_run("find_loci_downstream", "FindLoci", {"predicates": [["of_kind", [3]], ["downstream_of", [SUPPLIER + 1, 1]]]}, ["locus_id"], f"SELECT DISTINCT other AS locus_id FROM inc JOIN loci ON locus_id = other WHERE outgoing AND locus = {SUPPLIER + 1} AND loci.kind = 3 AND other <> locus")
_run("find_entities", "FindEntities", {"predicates": [["coherence_above", [0.3]], ["min_members", [3]]], "sort": "coherence", "limit": 10}, ["entity_id", "coherence", "cast(size(members) AS bigint) AS n"],
     "SELECT entity_id, coherence, member_count AS n FROM ents WHERE status = 'Active' AND coherence >= 0.3 AND member_count >= 3 ORDER BY coherence DESC, entity_id LIMIT 10")


@_query("fluent_loci_outgoing_stats", "SELECT count(*) AS n, round(sum(activity), 6) AS total, round(avg(activity), 6) AS mean, round(min(activity), 6) AS least, round(max(activity), 6) AS most FROM rel JOIN loci ON locus_id = src WHERE directed AND loci.kind = 2 AND s0 > 3000.5 AND activity > 0.25")
def _(w):
    s = find.loci(w).of_kind(2).where_state(0, lambda c: c > 3000.5).outgoing_relationships().above_activity(0.25).activity_stats()
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("total", "mean", "least", "most")])


@_query("fluent_top_n_by_degree", "SELECT locus_id FROM (SELECT l.locus_id, coalesce(d, 0) AS d FROM loci l LEFT JOIN (SELECT locus, count(*) AS d FROM inc GROUP BY locus) i ON i.locus = l.locus_id) ORDER BY d DESC, locus_id LIMIT 25")
def _(w):
    return find.loci(w).top_n_by_degree(25).rows.select("locus_id")


@_query("fluent_target_loci_mean", "SELECT round(avg(s0), 6) AS value FROM loci WHERE locus_id IN (SELECT dst FROM rel WHERE directed AND kind = 2 AND activity > 0.4)")
def _(w):
    return find.relationships(w).of_kind(2).above_activity(0.4).target_loci().mean_state_slot(0).select(F.round("value", 6).alias("value"))


@_query("fluent_entities_members", "SELECT c_custkey AS locus_id FROM customer JOIN ents ON c_nationkey = entity_id WHERE status = 'Active' AND coherence >= 0.45")
def _(w):
    return find.entities(w).active().with_min_coherence(0.45).member_loci().rows.select("locus_id")


@_query("fluent_coheres", "SELECT perspective, cohere_id, n_entities, strength FROM cohs WHERE strength >= 0.1 AND n_entities >= 5")
def _(w):
    return find.coheres(w).with_min_strength(0.1).with_min_entity_count(5).rows.select("perspective", "cohere_id", F.size("entity_ids").cast("bigint").alias("n_entities"), "strength")


SIMILAR = """
, anchor AS (SELECT activity AS x, weight AS y FROM rel WHERE rel_id = (SELECT min(rel_id) FROM rel))
SELECT rel_id, round((activity * x + weight * y) / (sqrt(activity * activity + weight * weight) * sqrt(x * x + y * y)), 6) AS similarity
FROM rel CROSS JOIN anchor WHERE rel_id <> (SELECT min(rel_id) FROM rel)"""


@_query("most_similar_relationships", SIMILAR)
def _(w):
    anchor = w.relationships.agg(F.min("rel_id")).first()[0]
    return find.most_similar_relationships(w, anchor).select("rel_id", F.round("similarity", 6).alias("similarity"))


# Topology and aggregates.

_run("neighbors_of", "NeighborsOf", {"locus": SUPPLIER + 2}, ["locus_id", "rel_id"], f"SELECT other AS locus_id, rel_id FROM inc WHERE locus = {SUPPLIER + 2}")
_run("isolated_loci", "IsolatedLoci", {}, ["locus_id"], "SELECT locus_id FROM loci WHERE locus_id NOT IN (SELECT locus FROM inc)")
_run("hub_loci", "HubLoci", {"min_degree": 60}, ["locus_id", "degree"], "SELECT locus AS locus_id, count(*) AS degree FROM inc GROUP BY locus HAVING count(*) >= 60")
_run("reciprocal_pairs", "ReciprocPairs", {}, ["rel_id"], "SELECT unnest([a.rel_id, b.rel_id]) AS rel_id FROM rel a JOIN rel b ON a.kind = b.kind AND a.src = b.dst AND a.dst = b.src WHERE a.directed AND b.directed AND a.rel_id <= b.rel_id")


RECIPROCAL = """
SELECT b.rel_id FROM rel a JOIN rel b ON a.kind = b.kind AND a.src = b.dst AND a.dst = b.src AND b.directed
WHERE a.directed AND a.rel_id = (SELECT min(x.rel_id) FROM rel x JOIN rel y ON x.kind = y.kind AND x.src = y.dst AND x.dst = y.src AND x.directed AND y.directed)"""


@_query("reciprocal_of", RECIPROCAL)
def _(w):
    return topology.reciprocal_of(w, topology.reciprocal_pairs(w).agg(F.min("rel_a")).first()[0])


@_query("degrees", "SELECT locus AS locus_id, count(*) AS degree, count(*) FILTER (directed AND incoming) AS in_degree, count(*) FILTER (directed AND outgoing) AS out_degree FROM inc GROUP BY locus")
def _(w):
    return topology.degrees(w)


@_query("source_and_sink_loci", "SELECT 'source' AS role, locus AS locus_id FROM inc GROUP BY locus HAVING count(*) FILTER (directed AND incoming) = 0 AND count(*) FILTER (directed AND outgoing) > 0 UNION ALL SELECT 'sink', locus FROM inc GROUP BY locus HAVING count(*) FILTER (directed AND outgoing) = 0 AND count(*) FILTER (directed AND incoming) > 0")
def _(w):
    return topology.source_loci(w).select(F.lit("source").alias("role"), "locus_id").unionAll(topology.sink_loci(w).select(F.lit("sink"), "locus_id"))


@_query("activity_balance", "SELECT locus_id, round(sum(i), 6) AS incoming, round(sum(o), 6) AS outgoing, round(sum(o) - sum(i), 6) + 0.0 AS balance FROM (SELECT dst AS locus_id, activity AS i, 0.0 AS o FROM rel WHERE directed UNION ALL SELECT src, 0.0, activity FROM rel WHERE directed) GROUP BY locus_id")
def _(w):
    return find.incoming_outgoing_activity(w).select("locus_id", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("incoming", "outgoing", "balance")])


#: Strength from which an edge counts as positive: some triangles of the driver tables then are unstable.
SIGN = 1.55
PAIRS3 = "p3 AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, sum(activity + weight) AS s FROM rel WHERE kind = 3 AND activity > 0.15 GROUP BY 1, 2)"


def _kind3(w, low: float = 0.15):
    return (F.col("kind") == 3) & (V.activity() > low)


@_query("triangle_balance", f", {PAIRS3} SELECT count(*) AS triangles, round(avg(CASE WHEN (CASE WHEN a.s > {SIGN} THEN 1 ELSE -1 END) * (CASE WHEN b.s > {SIGN} THEN 1 ELSE -1 END) * (CASE WHEN c.s > {SIGN} THEN 1 ELSE -1 END) > 0 THEN 1.0 ELSE 0.0 END), 6) AS balance_index FROM p3 a JOIN p3 b ON a.v = b.u JOIN p3 c ON c.u = a.u AND c.v = b.v")
def _(w):
    return topology.balance_index(w, SIGN, _kind3(w)).select("triangles", F.round("balance_index", 6).alias("balance_index"))


@_query("unstable_triangles", f", {PAIRS3} SELECT a.u AS a, a.v AS b, b.v AS c FROM p3 a JOIN p3 b ON a.v = b.u JOIN p3 c ON c.u = a.u AND c.v = b.v WHERE (CASE WHEN a.s > {SIGN} THEN 1 ELSE -1 END) * (CASE WHEN b.s > {SIGN} THEN 1 ELSE -1 END) * (CASE WHEN c.s > {SIGN} THEN 1 ELSE -1 END) < 0")
def _(w):
    return topology.unstable_triangles(w, SIGN, _kind3(w))


NEAR = "near AS (SELECT i, j, sum(s) AS s FROM (SELECT src AS i, dst AS j, activity + weight AS s FROM rel WHERE kind = 3 UNION ALL SELECT dst, src, activity + weight FROM rel WHERE kind = 3) GROUP BY i, j), tot AS (SELECT i, sum(s) AS t FROM near GROUP BY i), sh AS (SELECT near.i, j, CASE WHEN t <> 0 THEN s / t END AS p, CASE WHEN t > 0 THEN s / t ELSE 0.0 END AS pp FROM near JOIN tot ON near.i = tot.i)"


@_query("structural_constraint", f", {NEAR}, ind AS (SELECT a.i, b.j, sum(a.p * b.pp) AS m FROM sh a JOIN sh b ON a.j = b.i WHERE a.p IS NOT NULL AND a.j <> b.j GROUP BY a.i, b.j) SELECT sh.i AS locus_id, round(sum((p + coalesce(m, 0)) ** 2), 5) AS score FROM sh LEFT JOIN ind ON sh.i = ind.i AND sh.j = ind.j WHERE p IS NOT NULL GROUP BY sh.i")
def _(w):
    return centrality.all_constraints(w, F.col("kind") == 3).select("locus_id", F.round("score", 5).alias("score"))


@_query("effective_network_size", f", {NEAR}, red AS (SELECT a.i, sum(a.p * b.pp) AS r FROM sh a JOIN sh b ON a.j = b.i JOIN sh c ON c.i = a.i AND c.j = b.j WHERE a.p IS NOT NULL AND c.p IS NOT NULL AND a.j <> b.j AND b.j <> a.i GROUP BY a.i) SELECT n.i AS locus_id, round(n.c - coalesce(r, 0), 5) AS score FROM (SELECT i, count(*) AS c FROM sh WHERE p IS NOT NULL GROUP BY i) n LEFT JOIN red ON red.i = n.i")
def _(w):
    return centrality.effective_network_size(w, F.col("kind") == 3).select("locus_id", F.round("score", 5).alias("score"))


def _modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    world = project(spark, sf_dir)
    part = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((F.col("s_suppkey") + SUPPLIER).cast("bigint").alias("locus_id"), F.col("s_nationkey").alias("community"))
    return centrality.modularity(world, part, F.col("kind") == 3).select(F.round("modularity", 5).alias("modularity"))


QUERIES["modularity_by_nation"] = _modularity
ORACLE_SQL["modularity_by_nation"] = ORACLE_WITH + ", part AS (SELECT 10000000 + s_suppkey AS locus_id, s_nationkey AS c FROM supplier), w AS (SELECT sum(CASE WHEN a.c = b.c THEN 2 * (activity + weight) ELSE 0 END) AS w FROM rel JOIN part a ON a.locus_id = src JOIN part b ON b.locus_id = dst WHERE rel.kind = 3), k AS (SELECT n, sum(s) AS k FROM (SELECT src AS n, activity + weight AS s FROM rel WHERE kind = 3 UNION ALL SELECT dst, activity + weight FROM rel WHERE kind = 3) GROUP BY n), m AS (SELECT sum(k) AS m FROM k), g AS (SELECT sum(g * g) AS g2 FROM (SELECT sum(k) AS g FROM k JOIN part ON locus_id = n GROUP BY c)) SELECT round((w - g2 / m) / m, 5) AS modularity FROM w, m, g"


@_query("world_metrics_counts", "SELECT (SELECT count(*) FROM rel) AS relationships, (SELECT count(*) FROM rel WHERE activity > 0.1) AS active_relationships, (SELECT round(sum(activity), 4) FROM rel) AS total_activity, (SELECT round(max(activity), 6) FROM rel) AS max_activity, (SELECT max(d) FROM (SELECT count(*) AS d FROM inc GROUP BY locus)) AS max_degree, (SELECT count(*) FROM loci) AS loci, (SELECT count(*) FROM ents WHERE status = 'Active') AS active_entities")
def _(w):
    m = find.world_metrics(w, ["relationships", "active_relationships", "total_activity", "max_activity", "max_degree", "loci", "active_entities"])
    return m.select("relationships", "active_relationships", F.round("total_activity", 4).alias("total_activity"), F.round("max_activity", 6).alias("max_activity"), "max_degree", "loci", "active_entities")


_run("relationship_profile", "RelationshipProfile", {"a": 8, "b": 46}, ["kind", "round(activity, 6) AS activity", "edges", "round(net_influence, 6) AS net_influence"],
     "SELECT kind, round(sum(activity), 6) AS activity, count(*) AS edges, round(sum(CASE WHEN NOT directed THEN 0 WHEN src = 8 THEN activity ELSE -activity END), 6) AS net_influence FROM rel WHERE (src = 8 AND dst = 46) OR (src = 46 AND dst = 8) GROUP BY kind")


@_query("profile_similarity", ", a AS (SELECT kind, sum(activity) AS x FROM rel WHERE (src = 8 AND dst = 46) OR (src = 46 AND dst = 8) GROUP BY kind), b AS (SELECT kind, sum(activity) AS y FROM rel WHERE (src = 7 AND dst = 21) OR (src = 21 AND dst = 7) GROUP BY kind), s AS (SELECT sum(coalesce(x, 0) * coalesce(y, 0)) AS d, sqrt(sum(coalesce(x, 0) ** 2)) AS n, sqrt(sum(coalesce(y, 0) ** 2)) AS m FROM a FULL JOIN b ON a.kind = b.kind) SELECT round(CASE WHEN coalesce(n, 0) < 1e-12 OR coalesce(m, 0) < 1e-12 THEN 0.0 ELSE d / (n * m) END, 6) AS similarity FROM s")
def _(w):
    return find.profile_similarity(w, (8, 46), (7, 21)).select(F.round("similarity", 6).alias("similarity"))


# Traversal.


def _bfs(arcs: str, start: int, depth: int) -> str:
    return f", arcs AS (SELECT DISTINCT locus AS a, other AS b FROM inc WHERE {arcs}), r AS (SELECT CAST({start} AS BIGINT) AS node, 0 AS depth UNION SELECT CAST(b AS BIGINT), depth + 1 FROM r JOIN arcs ON a = node WHERE depth < {depth}) SELECT node AS locus_id, min(depth) AS depth FROM r GROUP BY node HAVING min(depth) > 0"


HOP = ["locus_id", "depth"]
_run("reachable_from", "ReachableFrom", {"start": 5, "depth": 2}, HOP, _bfs("TRUE", 5, 2))
_run("downstream_of", "DownstreamOf", {"start": 5, "depth": 2}, HOP, _bfs("outgoing", 5, 2))
_run("upstream_of", "UpstreamOf", {"start": PART + 5, "depth": 2}, HOP, _bfs("incoming", PART + 5, 2))
_run("reachable_from_active", "ReachableFromActive", {"start": 5, "depth": 2, "min_activity": 0.75}, HOP, _bfs("activity >= 0.75", 5, 2))
_run("downstream_of_active", "DownstreamOfActive", {"start": 5, "depth": 3, "min_activity": 0.75}, HOP, _bfs("outgoing AND activity >= 0.75", 5, 3))
_run("upstream_of_active", "UpstreamOfActive", {"start": PART + 5, "depth": 2, "min_activity": 0.4}, HOP, _bfs("incoming AND activity >= 0.4", PART + 5, 2))


@_query("reachable_of_kind", _bfs("kind = 4 AND outgoing", 8, 1))
def _(w):
    return traversal.reachable(w, 8, 1, "out", 4)


def _path(steps: str, start: int, target: int, depth: int) -> str:
    """Hops and path: distances from the start, then all shortest paths, of which the least in order."""
    return f"""
, arcs AS MATERIALIZED (SELECT DISTINCT locus AS a, other AS b FROM inc WHERE {steps}),
r AS (SELECT CAST({start} AS BIGINT) AS node, 0 AS depth UNION SELECT CAST(b AS BIGINT), depth + 1 FROM r JOIN arcs ON a = node WHERE depth < {depth}),
dist AS MATERIALIZED (SELECT node, min(depth) AS d FROM r GROUP BY node),
p AS (SELECT CAST({start} AS BIGINT) AS node, 0 AS d, [CAST({start} AS BIGINT)] AS path
      UNION ALL SELECT dist.node, dist.d, list_append(path, dist.node) FROM p JOIN arcs ON a = p.node JOIN dist ON dist.node = b AND dist.d = p.d + 1 WHERE p.d < {depth} AND p.node <> {target})
SELECT d AS hops, array_to_string(path, '-') AS path FROM p WHERE node = {target} ORDER BY path LIMIT 1"""


PATH = ["hops", "array_join(transform(path, x -> cast(x AS string)), '-') AS path"]
_run("path_between", "PathBetween", {"source": 5, "target": PART + 9}, PATH, _path("TRUE", 5, PART + 9, 3))
_run("path_between_of_kind", "PathBetweenOfKind", {"source": SUPPLIER + 1, "target": SUPPLIER + 9, "kind": 2}, PATH, _path("kind = 2", SUPPLIER + 1, SUPPLIER + 9, 4))
_run("directed_path", "DirectedPath", {"source": 5, "target": PART + 9}, PATH, _path("outgoing", 5, PART + 9, 3))
_run("path_between_active", "PathBetweenActive", {"source": 5, "target": PART + 9, "min_activity": 0.3}, PATH, _path("activity >= 0.3", 5, PART + 9, 5))


def _strongest(start: int, target: int, rounds: int = 8) -> str:
    """Least costs after some rounds of relaxation, more than the strongest path has steps."""
    steps = "st AS MATERIALIZED (SELECT locus AS a, other AS b, min(1 / greatest(activity, 1e-6)) AS s FROM inc WHERE locus <> other GROUP BY 1, 2)"
    best = [f"d0 AS (SELECT CAST({start} AS BIGINT) AS node, 0.0::DOUBLE AS cost)"]
    best += [f"d{k} AS MATERIALIZED (SELECT node, min(cost) AS cost FROM (SELECT * FROM d{k - 1} UNION ALL SELECT b, cost + s FROM d{k - 1} JOIN st ON a = node) GROUP BY node)" for k in range(1, rounds + 1)]
    return f", {', '.join([steps, *best])} SELECT round(cost, 6) AS cost FROM d{rounds} WHERE node = {target}"


_run("strongest_path", "StrongestPath", {"source": SUPPLIER + 1, "target": SUPPLIER + 9}, ["round(cost, 6) AS cost"], _strongest(SUPPLIER + 1, SUPPLIER + 9))


def _labels(arcs: str, rounds: int = 8) -> str:
    """Least labels after some rounds, more than the least locus of a component is steps away from any other."""
    steps = f"arcs AS MATERIALIZED (SELECT DISTINCT locus AS a, other AS b FROM inc WHERE {arcs})"
    least = ["l0 AS (SELECT CAST(locus_id AS BIGINT) AS n, CAST(locus_id AS BIGINT) AS c FROM loci)"]
    least += [f"l{k} AS MATERIALIZED (SELECT n, min(c) AS c FROM (SELECT n, c FROM l{k - 1} UNION ALL SELECT b, c FROM l{k - 1} JOIN arcs ON a = n) GROUP BY n)" for k in range(1, rounds + 1)]
    return f", {', '.join([steps, *least])} SELECT n AS locus_id, c AS component FROM l{rounds}"


def _peeled(rounds: int = 8) -> str:
    """Whether directed edges are left after some rounds of peeling, more than the longest way to a cycle or out of it."""
    left = ["e0 AS MATERIALIZED (SELECT DISTINCT src, dst FROM rel WHERE directed)"]
    left += [f"e{k} AS MATERIALIZED (SELECT * FROM e{k - 1} WHERE src IN (SELECT dst FROM e{k - 1}) AND dst IN (SELECT src FROM e{k - 1}))" for k in range(1, rounds + 1)]
    return f", {', '.join(left)} SELECT count(*) > 0 AS value FROM e{rounds}"


_run("connected_components_of_kind", "ConnectedComponentsOfKind", {"kind": 3}, ["locus_id", "component"], _labels("kind = 3"))
_run("connected_components", "ConnectedComponents", {}, ["locus_id", "component"], _labels("TRUE"))
_run("has_cycle", "HasCycle", {}, ["value"], _peeled())


TRANSITIVE = """
, st AS MATERIALIZED (SELECT locus AS a, other AS b, max(activity) AS x FROM inc WHERE kind = 4 AND outgoing AND locus <> other GROUP BY 1, 2),
p AS (SELECT CAST(8 AS BIGINT) AS node, [CAST(8 AS BIGINT)] AS path, 1.0::DOUBLE AS x
      UNION ALL SELECT b, list_append(path, b), p.x * st.x FROM p JOIN st ON a = node WHERE len(path) < 4 AND node <> 46)
SELECT round((SELECT x FROM p WHERE node = 46 ORDER BY len(path), path LIMIT 1), 9) AS activity"""


@_query("infer_transitive", TRANSITIVE)
def _(w):
    value = traversal.infer_transitive(w, 8, 46, 4, "product")
    return w.spark.createDataFrame([(value,)], "activity double").select(F.round("activity", 9).alias("activity"))


@_query("induced_subgraph", "SELECT rel_id FROM rel WHERE src IN (SELECT locus_id FROM loci WHERE kind = 2 AND s0 > 2000.5) AND dst IN (SELECT locus_id FROM loci WHERE kind = 2 AND s0 > 2000.5)")
def _(w):
    return traversal.induced_subgraph(w, find.loci(w).of_kind(2).where_state(0, lambda c: c > 2000.5).rows).select("rel_id")


# Centrality and communities.


def _pagerank(rounds: int) -> str:
    """The scores (locus_id, s) after some rounds, as r{rounds}."""
    steps = [
        "n AS (SELECT count(*) AS n FROM loci)",
        "ln AS (SELECT locus AS a, other AS b, sum(activity) AS w FROM inc WHERE outgoing AND activity > 0 GROUP BY 1, 2)",
        "t AS MATERIALIZED (SELECT a, sum(w) AS t FROM ln GROUP BY a)",
        "p AS MATERIALIZED (SELECT ln.a, b, w / t AS p FROM ln JOIN t ON ln.a = t.a)",
        "r0 AS (SELECT locus_id, 1.0::DOUBLE / n AS s FROM loci, n)",
    ]
    for k in range(rounds):
        steps.append(f"d{k} AS (SELECT coalesce(sum(s), 0) AS f FROM r{k} WHERE locus_id IN (SELECT a FROM t))")
        came = f"(SELECT b, sum(p * s) AS c FROM p JOIN r{k} ON locus_id = a GROUP BY b)"
        steps.append(f"r{k + 1} AS MATERIALIZED (SELECT r{k}.locus_id, 0.15 / n + 0.85 * (1 - f) / n + 0.85 * coalesce(c, 0) AS s FROM r{k} CROSS JOIN n CROSS JOIN d{k} LEFT JOIN {came} x ON x.b = r{k}.locus_id)")
    return ", " + ", ".join(steps)


@_query("pagerank", _pagerank(10) + " SELECT locus_id, round(s, 9) AS score FROM r10")
def _(w):
    return centrality.pagerank(w, iterations=10, tolerance=0.0).select("locus_id", F.round("score", 9).alias("score"))


@_query("pagerank_two_rounds", _pagerank(2) + " SELECT locus_id, round(s, 9) AS score FROM r2")
def _(w):
    return centrality.pagerank(w, iterations=2).select("locus_id", F.round("score", 9).alias("score"))


_run("pagerank_for", "PageRankFor", {"locus": SUPPLIER + 4, "iterations": 5, "tolerance": 0.0}, ["locus_id", "round(score, 9) AS score"], _pagerank(5) + f" SELECT locus_id, round(s, 9) AS score FROM r5 WHERE locus_id = {SUPPLIER + 4}")

CLOSENESS = f"""
, arcs AS MATERIALIZED (SELECT DISTINCT locus AS a, other AS b FROM inc WHERE locus <> other),
r AS (SELECT CAST({SUPPLIER + 4} AS BIGINT) AS node, 0 AS depth UNION SELECT CAST(b AS BIGINT), depth + 1 FROM r JOIN arcs ON a = node WHERE depth < 7),
m AS (SELECT node, min(depth) AS d FROM r GROUP BY node)
SELECT {SUPPLIER + 4} AS locus_id, round(sum(CASE WHEN d > 0 THEN 1.0 / d ELSE 0 END) / ((SELECT count(*) FROM loci) - 1), 6) AS score FROM m"""
_run("closeness_for", "ClosenessFor", {"locus": SUPPLIER + 4}, ["locus_id", "round(score, 6) AS score"], CLOSENESS)

CONSTRAINT = f"""
, near AS MATERIALIZED (SELECT i, j, sum(s) AS s FROM (SELECT src AS i, dst AS j, activity + weight AS s FROM rel UNION ALL SELECT dst, src, activity + weight FROM rel WHERE src <> dst) GROUP BY i, j),
tot AS (SELECT i, sum(s) AS t FROM near GROUP BY i),
sh AS MATERIALIZED (SELECT near.i, j, CASE WHEN t <> 0 THEN s / t END AS p, CASE WHEN t > 0 THEN s / t ELSE 0.0 END AS pp FROM near JOIN tot ON near.i = tot.i),
own AS (SELECT * FROM sh WHERE i = {SUPPLIER + 4} AND p IS NOT NULL),
ind AS (SELECT b.j, sum(a.p * b.pp) AS m FROM own a JOIN sh b ON a.j = b.i WHERE a.j <> b.j GROUP BY b.j)
SELECT i AS locus_id, round(sum((p + coalesce(m, 0)) ** 2), 5) AS score FROM own LEFT JOIN ind ON own.j = ind.j GROUP BY i"""
_run("constraint_for", "ConstraintFor", {"locus": SUPPLIER + 4}, ["locus_id", "round(score, 5) AS score"], CONSTRAINT)
_run("louvain_with_resolution", "LouvainWithResolution", {"resolution": 0.5}, ["locus_id", "community"])


@_query("louvain")
def _(w):
    return centrality.louvain(w)


@_query("behavioral_partition")
def _(w):
    return equivalence.behavioral_partition(w)


# The causal log.


def _closure(start: str, forward: bool) -> str:
    near, far = ("pred", "succ") if forward else ("succ", "pred")
    return f", r AS (SELECT CAST({start} AS BIGINT) AS node UNION SELECT CAST({far} AS BIGINT) FROM r JOIN pred ON {near} = node)"


_run("causal_ancestors", "CausalAncestors", {"target": 400}, ["change_id"], _closure("400", False) + " SELECT node AS change_id FROM r WHERE node <> 400")


@_query("causal_descendants", _closure("(SELECT max(event_id) - 60 FROM events)", True) + " SELECT node AS change_id FROM r WHERE node <> (SELECT max(event_id) - 60 FROM events)")
def _(w):
    return causality.causal_descendants(w, w.locus_changes().agg(F.max("change_id")).first()[0] - 60).select("change_id")


_run("causal_depth", "CausalDepth", {"target": 60}, ["value"], ", lv AS (SELECT CAST(60 AS BIGINT) AS node, 0 AS d UNION SELECT CAST(pred AS BIGINT), d + 1 FROM lv JOIN pred ON succ = node) SELECT max(d) AS value FROM lv")
_run("is_ancestor_of", "IsAncestorOf", {"ancestor": 20, "descendant": 200}, ["value"], _closure("200", False) + " SELECT count(*) > 0 AS value FROM r WHERE node = 20")
_run("root_stimuli", "RootStimuli", {"target": 300}, ["change_id"], _closure("300", False) + " SELECT node AS change_id FROM r WHERE node <> 300 AND node NOT IN (SELECT succ FROM pred)")


@_query("common_ancestors", _closure("150", False) + ", q AS (SELECT CAST(170 AS BIGINT) AS node UNION SELECT CAST(pred AS BIGINT) FROM q JOIN pred ON succ = node) SELECT node AS change_id FROM r WHERE node <> 150 INTERSECT SELECT node FROM q WHERE node <> 170")
def _(w):
    return causality.common_ancestors(w, 150, 170)


_run("changes_to_locus_in_range", "ChangesToLocusInRange", {"locus": 8, "first": 3, "last": 12}, ["change_id", "batch", "kind", "round(after[0], 6) AS a0"], "SELECT change_id, batch, kind, round(a0, 6) AS a0 FROM changes WHERE subject_type = 'Locus' AND subject_id = 8 AND batch BETWEEN 3 AND 12")
_run("changes_to_relationship_in_range", "ChangesToRelationshipInRange", {"rel_id": 400000000800000046, "first": 0, "last": 40}, ["change_id", "batch", "kind", "round(after[0], 6) AS a0"],
     "SELECT change_id, batch, kind, round(a0, 6) AS a0 FROM changes WHERE subject_type = 'Relationship' AND subject_id = 400000000800000046 AND batch BETWEEN 0 AND 40")
_run("locus_state_slot", "LocusStateSlot", {"locus": SUPPLIER + 4, "slot": 0}, ["round(value, 6) AS value"], f"SELECT round(s0, 6) AS value FROM loci WHERE locus_id = {SUPPLIER + 4}")
_run("loci_changed_in_batch", "LociChangedInBatch", {"batch": 5}, ["subject_id"], "SELECT DISTINCT subject_id FROM changes WHERE subject_type = 'Locus' AND batch = 5")
_run("relationships_changed_in_batch", "RelationshipsChangedInBatch", {"batch": 5}, ["subject_id"], "SELECT DISTINCT subject_id FROM changes WHERE subject_type = 'Relationship' AND batch = 5")


@_query("last_n_changes", "SELECT subject_id, change_id FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY change_id DESC) AS n FROM changes WHERE subject_type = 'Locus') WHERE n <= 3")
def _(w):
    return causality.last_n_changes(w, "Locus", 3).select("subject_id", "change_id")


@_query("batch_stats", "SELECT batch, count(*) AS changes, count(*) FILTER (change_id NOT IN (SELECT succ FROM pred)) AS stimuli, count(DISTINCT CASE WHEN subject_type = 'Locus' THEN subject_id END) AS loci, count(DISTINCT CASE WHEN subject_type = 'Relationship' THEN subject_id END) AS relationships, round(avg(abs(a0 - coalesce(b0, 0))), 6) AS mean_abs_delta FROM changes GROUP BY batch")
def _(w):
    return causality.batch_stats(w).withColumn("mean_abs_delta", F.round("mean_abs_delta", 6))


@_query("loci_by_change_frequency", "SELECT subject_id, count(*) AS changes FROM changes WHERE subject_type = 'Locus' AND batch BETWEEN 5 AND 20 GROUP BY subject_id")
def _(w):
    return causality.change_frequency(w, "Locus", 5, 20)


@_query("locus_state_at", "SELECT subject_id, round(arg_max(a0, change_id), 6) AS s0 FROM changes WHERE subject_type = 'Locus' AND batch <= 9 GROUP BY subject_id")
def _(w):
    return causality.state_at(w, "Locus", 9).select("subject_id", F.round(F.col("state")[0], 6).alias("s0"))


@_query("relationships_at_batch", "SELECT DISTINCT rel_id FROM (SELECT subject_id AS rel_id FROM changes WHERE subject_type = 'Relationship' AND batch <= 4 UNION ALL SELECT rel_id FROM rel WHERE created_by IS NOT NULL)")
def _(w):
    return causality.relationships_at_batch(w, 4)


@_query("world_diff", ", d AS (SELECT * FROM changes WHERE batch >= 4 AND batch < 9), m AS (SELECT subject_id, coalesce(arg_min(coalesce(b0, 0), change_id), 0) AS b, arg_max(a0, change_id) AS a FROM d WHERE subject_type = 'Relationship' GROUP BY subject_id) SELECT 'relationship_created' AS section, rel_id AS id FROM rel WHERE created_batch >= 4 AND created_batch < 9 UNION ALL SELECT 'change', change_id FROM d UNION ALL SELECT DISTINCT 'locus_changed', subject_id FROM d WHERE subject_type = 'Locus' UNION ALL SELECT CASE WHEN a > b THEN 'relationship_strengthened' WHEN a < b THEN 'relationship_weakened' ELSE 'relationship_updated' END, subject_id FROM m UNION ALL SELECT DISTINCT CASE WHEN batch = (SELECT min(batch) FROM layers l2 WHERE l2.entity_id = layers.entity_id) THEN 'entity_born' ELSE 'entity_changed' END, entity_id FROM layers WHERE batch >= 4 AND batch < 9")
def _(w):
    return causality.world_diff(w, 4, 9).select("section", "id")


TIME_TRAVEL = """
SELECT 'remove' AS action, rel_id AS id, FALSE AS clamped FROM rel WHERE created_batch >= 40
UNION ALL SELECT 'irrecoverable', rel_id, FALSE FROM pruned WHERE batch >= 40 AND batch <= 84
UNION ALL SELECT DISTINCT 'approximate', entity_id, FALSE FROM layers WHERE batch <= 40 AND entity_id % 4 = 0"""


@_query("time_travel", TIME_TRAVEL)
def _(w):
    return causality.time_travel(w, 40)


def _trends(last: int) -> str:
    return f"""
, s AS (SELECT subject_id AS rel_id, a0, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY change_id) - 1 AS DOUBLE) AS i FROM changes WHERE subject_type = 'Relationship' AND batch BETWEEN 0 AND {last}),
g AS (SELECT rel_id, count(*) AS n, round(CASE WHEN count(*) > 1 THEN regr_slope(a0, i) END, 6) AS slope FROM s GROUP BY rel_id)
SELECT rel_id, n, slope, CASE WHEN n < 2 THEN 'Insufficient' WHEN slope > 0.05 THEN 'Rising' WHEN slope < -0.05 THEN 'Falling' ELSE 'Stable' END AS trend FROM g"""


TREND = ["rel_id", "n", "CASE WHEN n > 1 THEN round(slope, 6) END AS slope", "trend"]
_run("activity_trend_rows", "ActivityTrend", {"rel_id": 400000000800000046, "first": 0, "last": 40}, TREND, _trends(40) + " WHERE rel_id = 400000000800000046")


@_query("activity_trends", _trends(25))
def _(w):
    return causality.trends(w, 0, 25).selectExpr(*TREND)


@_query("relationship_volatility", "SELECT subject_id AS rel_id, round(CASE WHEN count(*) < 2 THEN 0.0 ELSE stddev_pop(a0) END, 6) AS volatility FROM changes WHERE subject_type = 'Relationship' AND batch BETWEEN 2 AND 20 GROUP BY subject_id")
def _(w):
    return causality.volatility(w, 2, 20).select("rel_id", F.round("volatility", 6).alias("volatility"))


_run("causal_direction", "CausalDirection", {"a": 8, "b": 46, "kind": 4}, ["round(score, 6) AS score"], ", s AS (SELECT coalesce(sum(CASE WHEN src = 8 AND dst = 46 THEN weight END), 0) AS ab, coalesce(sum(CASE WHEN src = 46 AND dst = 8 THEN weight END), 0) AS ba FROM rel WHERE directed AND kind = 4) SELECT round(CASE WHEN abs(ab + ba) < 1e-9 THEN 0.0 ELSE (ab - ba) / (ab + ba) END, 6) AS score FROM s")
_run("dominant_causes", "DominantCauses", {"locus": SUPPLIER + 3, "kind": 1, "n": 15}, ["locus_id", "round(score, 6) AS score"], f"SELECT src AS locus_id, round(weight, 6) AS score FROM rel WHERE directed AND kind = 1 AND dst = {SUPPLIER + 3} ORDER BY weight DESC, src LIMIT 15")
_run("dominant_effects", "DominantEffects", {"locus": 8, "kind": 4, "n": 15}, ["locus_id", "round(score, 6) AS score"], "SELECT dst AS locus_id, round(weight, 6) AS score FROM rel WHERE directed AND kind = 4 AND src = 8 ORDER BY weight DESC, dst LIMIT 15")
_run("causal_in_strength", "CausalInStrength", {"locus": SUPPLIER + 3, "kind": 1}, ["round(score, 6) AS score"], f"SELECT round(coalesce(sum(weight), 0), 6) AS score FROM rel WHERE directed AND kind = 1 AND dst = {SUPPLIER + 3}")
_run("causal_out_strength", "CausalOutStrength", {"locus": 8, "kind": 4}, ["round(score, 6) AS score"], "SELECT round(coalesce(sum(weight), 0), 6) AS score FROM rel WHERE directed AND kind = 4 AND src = 8")
_run("feedback_pairs", "FeedbackPairs", {"kind": 4, "min_weight": 0.15, "min_balance": 0.55}, ["a", "b", "round(w_ab, 6) AS w_ab", "round(w_ba, 6) AS w_ba", "round(balance, 6) AS balance"],
     "SELECT x.src AS a, x.dst AS b, round(x.weight, 6) AS w_ab, round(y.weight, 6) AS w_ba, round(least(x.weight, y.weight) / greatest(x.weight, y.weight), 6) AS balance FROM rel x JOIN rel y ON x.src = y.dst AND x.dst = y.src AND x.kind = 4 AND y.kind = 4 WHERE x.src < x.dst AND x.weight >= 0.15 AND y.weight >= 0.15 AND least(x.weight, y.weight) / greatest(x.weight, y.weight) >= 0.55")


def _granger(pairs: str, lag: int) -> str:
    return f", pr AS ({pairs}), c AS (SELECT subject_id, batch FROM changes WHERE subject_type = 'Locus'), sc AS (SELECT cause, effect, round(avg(CASE WHEN EXISTS (SELECT 1 FROM c e WHERE e.subject_id = effect AND e.batch > a.batch AND e.batch <= a.batch + {lag}) THEN 1.0 ELSE 0.0 END), 6) AS score FROM pr JOIN c a ON a.subject_id = cause GROUP BY cause, effect)"


_run("granger_score", "GrangerScore", {"cause": 8, "effect": 46, "lag": 2}, ["cause", "effect", "round(score, 6) AS score"], _granger("SELECT 8 AS cause, 46 AS effect", 2) + " SELECT cause, effect, score FROM sc")
_run("granger_dominant_causes", "GrangerDominantCauses", {"locus": 8, "kind": 4, "lag": 1, "n": 1000}, ["locus_id", "round(score, 6) AS score"], _granger("SELECT DISTINCT other AS cause, 8 AS effect FROM inc WHERE kind = 4 AND locus = 8 AND other <> 8", 1) + " SELECT cause AS locus_id, score FROM sc WHERE score > 0")
_run("granger_dominant_effects", "GrangerDominantEffects", {"locus": 8, "kind": 4, "lag": 1, "n": 1000}, ["locus_id", "round(score, 6) AS score"], _granger("SELECT DISTINCT 8 AS cause, other AS effect FROM inc WHERE kind = 4 AND locus = 8 AND other <> 8", 1) + " SELECT effect AS locus_id, score FROM sc WHERE score > 0")
_run("relationships_absent_without", "RelationshipsAbsentWithout", {"changes": [300, 301]}, ["rel_id"], ", r AS (SELECT CAST(unnest([300, 301]) AS BIGINT) AS node UNION SELECT CAST(succ AS BIGINT) FROM r JOIN pred ON pred = node) SELECT rel_id FROM rel WHERE created_by IN (SELECT node FROM r)")
_run("counterfactual_replay", "CounterfactualReplay", {"changes": [300, 301]}, ["what", "id"], ", r AS (SELECT CAST(unnest([300, 301]) AS BIGINT) AS node UNION SELECT CAST(succ AS BIGINT) FROM r JOIN pred ON pred = node) SELECT 'suppressed_change' AS what, node AS id FROM r UNION ALL SELECT 'absent_relationship', rel_id FROM rel WHERE created_by IN (SELECT node FROM r) UNION ALL SELECT 'divergence_batch', min(batch) FROM changes WHERE change_id IN (SELECT node FROM r)")

# Entities, boundary, emergence.

_run("entity_deviations_since", "EntityDeviationsSince", {"baseline": 4}, ["entity_id", "coherence_at_baseline", "coherence_now", "members_at_baseline", "members_now", "layers_since", "lifecycle"],
     ", b AS (SELECT entity_id, arg_max(coherence, batch) AS c, arg_max(member_count, batch) AS m FROM layers WHERE batch <= 4 GROUP BY entity_id), s AS (SELECT entity_id, count(*) AS n, count(*) FILTER (batch = (SELECT min(batch) FROM layers l2 WHERE l2.entity_id = layers.entity_id)) AS lc FROM layers WHERE batch > 4 GROUP BY entity_id) SELECT s.entity_id, b.c AS coherence_at_baseline, coherence AS coherence_now, b.m AS members_at_baseline, member_count AS members_now, n AS layers_since, lc AS lifecycle FROM s JOIN ents ON ents.entity_id = s.entity_id LEFT JOIN b ON b.entity_id = s.entity_id")
_run("entity_layers_in_range", "EntityLayersInRange", {"entity": 3, "first": 4, "last": 7}, ["entity_id", "batch", "coherence", "member_count"], "SELECT entity_id, batch, coherence, member_count FROM layers WHERE entity_id = 3 AND batch >= 4 AND batch < 7")
_run("entity_transition_cause", "EntityTransitionCause", {"entity": 3, "batch": 5}, ["entity_id", "batch", "transition", "cause.type AS cause"], "SELECT entity_id, max(batch) AS batch, CASE WHEN max(batch) = (SELECT min(batch) FROM layers WHERE entity_id = 3) THEN 'Born' ELSE 'MembershipDelta' END AS transition, 'ComponentMatch' AS cause FROM layers WHERE entity_id = 3 AND batch <= 5 GROUP BY entity_id")
_run("coheres_named", "CoheresNamed", {"perspective": "trade"}, ["cohere_id", "strength"], "SELECT cohere_id, strength FROM cohs WHERE perspective = 'trade'")
_run("coheres_default", "Coheres", {}, ["cohere_id", "strength"], "SELECT cohere_id, strength FROM cohs WHERE perspective = 'default'")


@_query("facts_at_version", "SELECT fact_id FROM facts WHERE asserted_at <= 6 AND (retracted_at IS NULL OR retracted_at > 6)")
def _(w):
    return entities.facts_at(w, 6).select("fact_id")


BOUNDARY = ", e AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, rel_id, abs(activity) AS signal FROM rel WHERE abs(activity) > 0.25), f AS (SELECT *, least(subject, object) AS u, greatest(subject, object) AS v FROM facts WHERE retracted_at IS NULL), c AS (SELECT e.u, e.v, min(rel_id) AS rel_id FROM e JOIN (SELECT DISTINCT u, v FROM f) d ON d.u = e.u AND d.v = e.v GROUP BY e.u, e.v)"


@_query("boundary_summary", BOUNDARY + " SELECT (SELECT count(*) FROM f JOIN c ON c.u = f.u AND c.v = f.v) AS confirmed, (SELECT count(*) FROM f LEFT JOIN c ON c.u = f.u AND c.v = f.v WHERE c.u IS NULL) AS ghosts, (SELECT count(*) FROM e WHERE rel_id NOT IN (SELECT rel_id FROM c)) AS shadows")
def _(w):
    return entities.boundary_summary(entities.boundary(w, 0.25)).drop("tension")


@_query("boundary_confirmed", BOUNDARY + " SELECT fact_id, rel_id FROM f JOIN c ON c.u = f.u AND c.v = f.v")
def _(w):
    return entities.boundary(w, 0.25).where("status = 'confirmed'").select("fact_id", "rel_id")


TENSION = BOUNDARY + """
, m AS (SELECT subject AS x, object AS y, CASE WHEN c.u IS NULL THEN 'ghost' ELSE 'confirmed' END AS status FROM f LEFT JOIN c ON c.u = f.u AND c.v = f.v
        UNION ALL SELECT u, v, 'shadow' FROM e WHERE rel_id NOT IN (SELECT rel_id FROM c)),
ends AS (SELECT x AS locus_id, status FROM m UNION ALL SELECT y, status FROM m WHERE x <> y)
SELECT locus_id, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'ghost') AS ghosts, count(*) FILTER (status = 'shadow') AS shadows,
       round(count(*) FILTER (status <> 'confirmed') / count(*)::DOUBLE, 9) AS tension FROM ends GROUP BY locus_id"""


@_query("locus_tension", TENSION)
def _(w):
    return entities.locus_tension(entities.boundary(w, 0.25)).withColumn("tension", F.round("tension", 9))


AUTOCORRELATION = """
, s AS (SELECT entity_id, coherence, lead(coherence) OVER (PARTITION BY entity_id ORDER BY batch) AS later FROM layers)
SELECT entity_id, round(corr(coherence, later), 6) AS r FROM s WHERE later IS NOT NULL GROUP BY entity_id"""


@_query("coherence_autocorrelation", AUTOCORRELATION)
def _(w):
    return emergence.coherence_autocorrelation(w.with_tables(entity_layers=w.entity_layers.withColumn("transition", F.when(F.col("transition") == "Born", "Born").otherwise("CoherenceShift"))), 1).select("entity_id", F.round("r", 6).alias("r"))


REGIMES = """
, en AS (SELECT batch, sum(abs(a0)) AS energy FROM changes GROUP BY batch),
w AS (SELECT batch, energy, list(energy) OVER (ORDER BY batch ROWS 7 PRECEDING) AS h FROM en)
SELECT batch, round(energy, 4) AS energy,
       CASE WHEN len(h) < 8 THEN 'Initializing' WHEN list_max(h) < 1e-4 THEN 'Quiescent'
            WHEN list_max(h) > 1e3 OR (h[8] > h[1] AND list_bool_and([h[i + 1] >= h[i] for i in range(1, 8)])) THEN 'Diverging'
            WHEN list_bool_and([h[i + 1] <= h[i] for i in range(1, 8)]) THEN 'Settling'
            WHEN list_bool_or([abs(h[i] - h[i + 2]) < 1e-3 AND abs(h[i + 1] - h[i + 3]) < 1e-3 for i in range(1, 6)]) THEN 'LimitCycleSuspect'
            ELSE 'Oscillating' END AS regime FROM w"""


@_query("batch_energy_regimes", REGIMES)
def _(w):
    return engine.regimes(engine.energy(w)).select("batch", F.round("energy", 4).alias("energy"), "regime")


NAMED = """
, nm AS MATERIALIZED (SELECT locus_id, kind, s0, coalesce(c_name, s_name, 'locus_' || locus_id) AS name FROM loci
                      LEFT JOIN customer ON kind = 1 AND c_custkey = locus_id LEFT JOIN supplier ON kind = 2 AND s_suppkey = locus_id - 10000000)"""


@_query("relationship_list", NAMED + """
SELECT rel_id, a.name || CASE WHEN directed THEN ' -> ' ELSE ' -- ' END || b.name || ' (kind ' || rel.kind || ')' AS text
FROM rel JOIN nm a ON a.locus_id = src JOIN nm b ON b.locus_id = dst""")
def _(w):
    """The activity's three digits are left out: halves are rounded by another rule there."""
    return relationship_list(w).select("rel_id", F.regexp_replace("text", r", activity -?[0-9.]+\)$", ")").alias("text"))


@_query("entities_summary", """
, g AS (SELECT c_nationkey AS entity_id, list_sort(list(c_name)) AS names FROM customer GROUP BY c_nationkey)
SELECT ents.entity_id, array_to_string(names[1:3], ', ') || CASE WHEN len(names) > 3 THEN '…' ELSE '' END AS display_name, status, coherence, len(names) AS n_members, array_to_string(names, ', ') AS names
FROM ents JOIN g ON g.entity_id = ents.entity_id""")
def _(w):
    return entities_summary(w).withColumns({"names": F.array_join("names", ", "), "n_members": F.col("n_members").cast("bigint")})


@_query("dot_export", NAMED + """
SELECT 0 AS part, 0 AS id, 'digraph world {' AS line UNION ALL SELECT 3, 0, '}'
UNION ALL SELECT 1, locus_id, '  n' || locus_id || ' [label="' || name || '\\n' || format('{:,.3f}', s0) || '"];' FROM nm
UNION ALL SELECT 2, rel_id, '  n' || src || ' -> n' || dst || ' [label="", color='
  || CASE WHEN activity >= 0.8 THEN 'red' WHEN activity >= 0.5 THEN 'orange' WHEN activity >= 0.3 THEN 'gold' WHEN activity >= 0.1 THEN 'steelblue' ELSE 'gray' END
  || CASE WHEN directed THEN '' ELSE ', dir=none' END || '];' FROM rel""")
def _(w):
    """The arrows' labels are left out: halves are rounded by another rule there."""
    return dot_lines(w).select("part", "id", F.when(F.col("part") == 2, F.regexp_replace("line", r'label="[^"]*"', 'label=""')).otherwise(F.col("line")).alias("line"))


@_query("lineage_scalars", "SELECT rel_id, round(change_count / CAST(greatest(83 - created_batch, 1) AS DOUBLE), 6) AS touch_rate, kind AS dominant_flow_kind, greatest(83 - created_batch, 0) AS age FROM rel")
def _(w):
    return w.relationships.select("rel_id", F.round(causality.predicate_touch_rate(83), 6).alias("touch_rate"), V.dominant_flow_kind().alias("dominant_flow_kind"), V.age_in_batches("created_batch", 83).alias("age"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the first of its label."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    first = e.groupBy("label").agg(F.min_by("v", "vec_id").alias("a"))
    return e.join(first, "label").select("vec_id", F.round(V.cosine_similarity("v", "a"), 5).alias("cosine"), F.round(V.euclidean_distance("v", "a"), 4).alias("distance"), F.round(V.l2_norm("v"), 4).alias("norm"))


QUERIES["vector_functions"] = _vectors
ORACLE_SQL["vector_functions"] = """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), f AS (SELECT label, arg_min(v, vec_id) AS a FROM e GROUP BY label)
SELECT vec_id, round(list_cosine_similarity(v, a), 5) AS cosine, round(list_distance(v, a), 4) AS distance, round(sqrt(list_dot_product(v, v)), 4) AS norm FROM e JOIN f ON e.label = f.label"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = stream.windowed_activity(events, "1 day")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "events", F.round("total", 4).alias("total"))


QUERIES["windowed_activity"] = _windows
ORACLE_SQL["windowed_activity"] = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.evidence_sessions(events, "6 hours").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("events").alias("longest"), F.round(F.sum("evidence"), 4).alias("evidence"))


QUERIES["evidence_sessions"] = _sessions
ORACLE_SQL["evidence_sessions"] = "WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events), n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS e, sum(value) AS v FROM n GROUP BY user_id, k) SELECT user_id, count(*) AS sessions, max(e) AS longest, round(sum(v), 4) AS evidence FROM c GROUP BY user_id"

FLAGSHIP = "find_relationships_top_strength"

__all__ = ["QUERIES", "ORACLE_SQL", "FLAGSHIP", "E", "L", "R"]
