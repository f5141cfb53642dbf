"""Small worlds for the tests, built by hand."""

from meshlore.world import World


def edge(i, kind, a, b, activity=0.5, weight=0.0, directed=True, created_by=None, batch=0, changes=1):
    return (i, kind, directed, a, b, [activity, weight], created_by, None, changes, [(kind, changes, batch)], batch, batch, None)


def micro(spark) -> World:
    """A directed chain 1-2-3-4, a symmetric edge 4-5, a triangle 10-11-12 with a negative side, a reciprocal pair, an isolated locus and a self-loop."""
    loci = [(i, 1 if i < 10 else 2, [float(i)]) for i in (1, 2, 3, 4, 5, 9, 10, 11, 12, 20, 21)]
    rels = [
        edge(1, 1, 1, 2, 0.9, 0.1), edge(2, 1, 2, 3, 0.2, 0.0), edge(3, 1, 3, 4, 0.6, 0.3), edge(4, 2, 4, 5, 0.4, 0.0, False),
        edge(5, 3, 10, 11, 0.5, 0.2, False), edge(6, 3, 11, 12, 0.5, 0.1, False), edge(7, 3, 10, 12, -0.6, 0.0, False),
        edge(8, 1, 20, 21, 0.7, 0.4), edge(9, 1, 21, 20, 0.7, 0.3), edge(10, 2, 1, 1, 0.3), edge(11, 2, 1, 2, 0.1, 0.0, True, 3, 2),
    ]
    # Diamond 0 -> 1, 2 -> 3, and a later stimulus 4; relationship 1 rises.
    log = [
        (0, "Locus", 1, 1, [], [], [1.0], 0), (1, "Locus", 2, 1, [0], [], [0.5], 1), (2, "Locus", 3, 1, [0], [], [0.5], 1), (3, "Locus", 4, 1, [1, 2], [], [0.2], 2), (4, "Locus", 9, 1, [], [], [2.0], 3),
        (5, "Relationship", 1, 1, [0], [0.1], [0.2], 0), (6, "Relationship", 1, 1, [1], [0.2], [0.4], 1), (7, "Relationship", 1, 1, [3], [0.4], [0.9], 2), (8, "Locus", 1, 1, [4], [1.0], [3.0], 4),
    ]
    layers = [(1, 0, 0, "Born", [], [], [], [], None, None, "Full", 0.4, 2, [1, 2], [1], ("RelationshipCluster", [1], [])), (1, 1, 3, "MembershipDelta", [3], [], [], [], None, None, "Full", 0.6, 3, [1, 2, 3], [1, 2], ("RelationshipCluster", [1], [])), (2, 0, 1, "Born", [], [], [], [], None, None, "Compressed", 0.7, 2, [], [], ("RelationshipCluster", [], []))]
    return World.from_rows(
        spark, 5, loci=loci, relationships=rels, changes=log,
        entities=[(1, "Active", [1, 2, 3], [1, 2], 0.6), (2, "Dormant", [10, 11], [5], 0.7)], entity_layers=layers,
        coheres=[("default", 0, 1, [1, 2], [], 0.5), ("other", 0, 2, [1], [3], 0.2)],
        properties=[(1, '{"name": "one", "confidence": 3}'), (2, '{"name": "two", "confidence": 0.5, "flag": true}'), (3, "broken")],
        names=[("one", 1, False), ("uno", 1, True), ("two", 2, False)],
        facts=[(0, 1, "feeds", 2, 0, None), (1, 3, "feeds", 1, 0, None), (2, 2, "feeds", 3, 1, 4)],
        pruned_log=[(99, 4)],
    )
