"""That queries of the graph run on the whole world, and operators without a query are right on a fixture."""

import math

import pytest
from meshlore.operators import entities, equivalence
from meshlore.queries import QUERIES
from meshlore.sources.export import entities_summary
from meshlore.sources.projection import project
from meshlore.world import World

from worlds import edge

SF = "/root/testdata/sf0.001"


def plain_distances(loci, rels, rounds, discount, scale):
    """The metric by its definition, over plain lists."""
    kind, state = {i: k for i, k, _ in loci}, {i: s for i, _, s in loci}
    arms = {i: [] for i in kind}
    for _, k, directed, a, b, *_ in rels:
        arms[a].append((b, (k, "out" if directed else "both")))
        if a != b or directed:
            arms[b].append((a, (k, "in" if directed else "both")))
    own = {(a, b): min(1.0, math.dist(state[a], state[b]) / scale) for a in kind for b in kind if kind[a] == kind[b]}
    d = dict(own)
    for _ in range(rounds):

        def hausdorff(x, y, d=d):
            if not x or not y:
                return float(bool(x) != bool(y))
            cost = lambda p, q: 1.0 if p[1] != q[1] else 0.5 * d.get((p[0], q[0]), 1.0)
            return max(max(min(cost(p, q) for q in y) for p in x), max(min(cost(p, q) for p in x) for q in y))

        d = {(a, b): 0.0 if a == b else max(own[a, b], discount * hausdorff(arms[a], arms[b])) for a, b in own}
    return d


def test_behavioral_distances_against_definition(spark):
    loci = [(i, 1 if i < 6 else 2, [float(i * i % 7)]) for i in range(10)]
    ends = [(1, 0, 6, True), (1, 1, 6, True), (1, 2, 7, True), (2, 6, 7, True), (3, 0, 1, False), (3, 2, 3, False), (2, 7, 8, True), (1, 3, 3, True), (3, 8, 8, False), (1, 4, 9, True)]
    rels = [edge(i, k, a, b, directed=directed) for i, (k, a, b, directed) in enumerate(ends)]
    got = equivalence.behavioral_distances(World.from_rows(spark, 1, loci=loci, relationships=rels), 3, locus_metric=equivalence.state_metric(20.0))
    want = plain_distances(loci, rels, 3, 0.9, 20.0)
    assert {(r.a, r.b): r.distance for r in got.collect()} == {k: pytest.approx(v) for k, v in want.items()}
    assert "behavioral_distances" not in QUERIES  # quadratic: no query, so none over some of the ids


def test_locus_tension_has_every_locus(spark):
    report = entities.boundary(project(spark, SF), 0.25).select("subject", "object").collect()
    got = [r.locus_id for r in QUERIES["locus_tension"](spark, SF).collect()]
    assert len(got) == len(set(got)) > 100 and set(got) == {x for r in report for x in r}


def test_entities_summary_names_all_members(spark):
    rows = QUERIES["entities_summary"](spark, SF).collect()
    names = {r.c_custkey: r.c_name for r in spark.read.parquet(f"{SF}/customer.parquet").collect()}
    own = [(r, r.names.split(", ")) for r in rows]
    assert sorted(x for _, given in own for x in given) == sorted(names.values()) and all(len(given) == r.n_members for r, given in own)
    assert all(r.display_name == ", ".join(given[:3]) + ("…" if r.n_members > 3 else "") for r, given in own)
    many = World.from_rows(spark, 1, loci=[(i, 1, [0.0]) for i in range(12)], entities=[(1, "Active", list(range(12)), [], 0.5)])
    assert len(entities_summary(many).first().names) == 12


def test_queries_take_the_whole_world(spark):
    world = project(spark, SF)
    loci = {r.locus_id for r in world.loci.select("locus_id").collect()}
    edges = {r.rel_id: r.state for r in world.relationships.select("rel_id", "state").collect()}
    assert {r.locus_id for r in QUERIES["behavioral_partition"](spark, SF).collect()} == loci
    communities = {r.locus_id: r.community for r in QUERIES["louvain"](spark, SF).collect()}
    assert loci <= set(communities) and any(c != i for i, c in communities.items() if i < 10_000_000) and any(c != i for i, c in communities.items() if i > 20_000_000)
    lines = QUERIES["dot_export"](spark, SF).collect()
    assert {r.id for r in lines if r.part == 1} == loci and {r.id for r in lines if r.part == 2} == set(edges)
    anchor = edges.pop(min(edges))
    cosine = lambda x: sum(a * b for a, b in zip(x, anchor, strict=True)) / (math.hypot(*x) * math.hypot(*anchor) or 1.0)
    got = sorted((r.similarity for r in QUERIES["most_similar_relationships"](spark, SF).collect()), reverse=True)
    assert got == pytest.approx(sorted((round(cosine(x), 6) for x in edges.values()), reverse=True), abs=2e-6)
    assert "betweenness" not in QUERIES  # all sources over all edges: no query, so none over some of the edges
