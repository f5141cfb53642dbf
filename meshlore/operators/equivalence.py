"""Behavioural equivalence: colour refinement and a pseudo-metric between loci."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import durable
from ..functions.vectors import euclidean_distance, strength
from ..world import World

ROUNDS = 4

#: Pairs of equal kind that the metric takes at most: it is quadratic by nature.
MOST_PAIRS = 20_000_000


def kind_only() -> Column:
    return F.xxhash64(F.lit("kind"), F.col("kind"))


def kind_and_quantized_state(step: float) -> Column:
    return F.xxhash64(F.lit("state"), F.col("kind"), F.transform("state", lambda x: F.floor(x / step)))


def kind_and_strength(step: float) -> Column:
    return F.xxhash64(F.lit("strength"), F.col("kind"), F.floor(strength() / step))


def _arms(world: World, edge_color: Column) -> DataFrame:
    """(locus, other, arm): an edge's colour with the direction seen from the locus."""
    rows = world.relationships.withColumn("__c", edge_color)
    own = rows.select(F.col("src").alias("locus"), F.col("dst").alias("other"), F.xxhash64(F.col("__c"), F.when(F.col("directed"), "out").otherwise("both")).alias("arm"))
    back = rows.where("src <> dst OR directed").select(F.col("dst").alias("locus"), F.col("src").alias("other"), F.xxhash64(F.col("__c"), F.when(F.col("directed"), "in").otherwise("both")).alias("arm"))
    return own.unionAll(back)


def behavior_colors(world: World, rounds: int | None = ROUNDS, locus_color: Column | None = None, edge_color: Column | None = None) -> DataFrame:
    """(locus_id, color) after refinement; ``rounds`` none: until the partition is stable.

    A round folds the multiset of (edge colour, neighbour's colour) into a
    locus's colour.  The multiset enters by its size and the sums of two hashes of
    its members, so nothing is collected however many edges a locus has.
    """
    arms = durable(_arms(world, kind_only() if edge_color is None else edge_color))
    base = durable(world.loci.select("locus_id", (kind_only() if locus_color is None else locus_color).alias("own")))
    color, classes = base.select("locus_id", F.col("own").alias("color")), None
    limit = rounds if rounds is not None else max(1, base.count())
    for _ in range(limit):
        seen = arms.join(color.select(F.col("locus_id").alias("other"), "color"), "other")
        member = F.xxhash64("arm", "color")
        folded = seen.groupBy(F.col("locus").alias("locus_id")).agg(F.count(F.lit(1)).alias("n"), F.sum(member.cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(member, F.lit(7)).cast("decimal(38,0)")).alias("b"))
        step = base.join(folded, "locus_id", "left").join(color, "locus_id")
        color = durable(step.select("locus_id", F.xxhash64("color", "own", F.coalesce("n", F.lit(0)), F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))).alias("color")))
        now = color.agg(F.count_distinct("color")).first()[0]
        if now == classes:
            break
        classes = now
    return color


def behavioral_partition(world: World, rounds: int | None = ROUNDS, **encoders) -> DataFrame:
    """(locus_id, block): loci of one behaviour, named by the least of them."""
    color = behavior_colors(world, rounds, **encoders)
    return color.join(color.groupBy("color").agg(F.min("locus_id").alias("block")), "color").select("locus_id", "block")


def behaviorally_equivalent(world: World, a: int, b: int, rounds: int | None = ROUNDS) -> bool:
    rows = behavior_colors(world, rounds).where(F.col("locus_id").isin(a, b)).select("color").distinct().count()
    return a == b or rows == 1


def behavioral_distances(world: World, rounds: int = ROUNDS, discount: float = 0.9, locus_metric: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(a, b, distance) of all pairs of loci of equal kind; other pairs have distance 1.

    d = max(d_locus, discount * Hausdorff of the neighbourhoods), where an edge
    and its neighbour are compared by half the edges' and half the neighbours'
    distance; edges of other direction or kind are at distance 1, and so are an
    empty and a filled neighbourhood.
    """
    metric = locus_metric or (lambda x, y: F.lit(0.0))
    n = world.loci.groupBy("kind").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0
    if n > MOST_PAIRS:
        raise ValueError(f"{n} pairs of equal kind; the metric takes {MOST_PAIRS}")
    left = world.loci.select(F.col("locus_id").alias("a"), "kind", F.col("state").alias("sa"))
    right = world.loci.select(F.col("locus_id").alias("b"), "kind", F.col("state").alias("sb"))
    base = durable(left.join(right, "kind").select("a", "b", metric(F.col("sa"), F.col("sb")).alias("own")))
    arms = durable(_arms(world, kind_only()).withColumnRenamed("locus", "x"))
    degree = arms.groupBy("x").count()
    distance = base.select("a", "b", F.col("own").alias("d"))
    for _ in range(rounds):
        # Arms of a against arms of b; a pair of neighbours without a row has distance 1.
        met = base.select("a", "b").join(arms.select(F.col("x").alias("a"), F.col("other").alias("p"), F.col("arm").alias("ap")), "a").join(arms.select(F.col("x").alias("b"), F.col("other").alias("q"), F.col("arm").alias("aq")), "b")
        far = met.join(distance.select(F.col("a").alias("p"), F.col("b").alias("q"), "d"), ["p", "q"], "left")
        cost = F.when(F.col("ap") != F.col("aq"), 1.0).otherwise(0.5 * F.coalesce("d", F.lit(1.0)))
        each = far.select("a", "b", "p", "ap", "q", "aq", cost.alias("c"))
        forth = each.groupBy("a", "b", "p", "ap").agg(F.min("c").alias("c")).groupBy("a", "b").agg(F.max("c").alias("f"))
        back = each.groupBy("a", "b", "q", "aq").agg(F.min("c").alias("c")).groupBy("a", "b").agg(F.max("c").alias("g"))
        both = base.join(forth, ["a", "b"], "left").join(back, ["a", "b"], "left")
        both = both.join(degree.select(F.col("x").alias("a"), F.col("count").alias("na")), "a", "left").join(degree.select(F.col("x").alias("b"), F.col("count").alias("nb")), "b", "left")
        one = F.col("na").isNull() != F.col("nb").isNull()
        hausdorff = F.when(one, 1.0).otherwise(F.coalesce(F.greatest("f", "g"), F.lit(0.0)))
        distance = durable(both.select("a", "b", F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.greatest("own", discount * hausdorff)).alias("d")))
    return distance.select("a", "b", F.col("d").alias("distance"))


def state_metric(scale: float) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.least(F.lit(1.0), euclidean_distance(a, b) / scale)
