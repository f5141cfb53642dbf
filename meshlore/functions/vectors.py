"""Scalar functions on state vectors, relationships and properties: Column in, Column out.

Vectors are arrays of doubles of any width.  Sums, differences and distances pad
the shorter one with zeros; a dot product runs over the shared prefix while
norms are of the whole vectors.  A null vector counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _vector(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.coalesce(v, F.array().cast("array<double>"))


def slot(state: Column | str, index: int) -> Column:
    """``state[index]``, null if the vector is shorter."""
    return F.try_element_at(F.col(state) if isinstance(state, str) else state, F.lit(index + 1))


def activity(state: Column | str = "state") -> Column:
    return F.coalesce(slot(state, 0), F.lit(0.0))


def weight(state: Column | str = "state") -> Column:
    return F.coalesce(slot(state, 1), F.lit(0.0))


def strength(state: Column | str = "state") -> Column:
    """Activity plus weight, signed."""
    return activity(state) + weight(state)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _zip(a: Column | str, b: Column | str, f) -> Column:
    return F.zip_with(_vector(a), _vector(b), lambda x, y: f(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))))


def add(a: Column | str, b: Column | str) -> Column:
    return _zip(a, b, lambda x, y: x + y)


def subtract(a: Column | str, b: Column | str) -> Column:
    return _zip(a, b, lambda x, y: x - y)


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(total(F.transform(_vector(v), lambda x: x * x)))


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_vector(a), _vector(b), lambda x, y: F.coalesce(x * y, F.lit(0.0))))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """0 if a norm is below 1e-12; clamped to [-1, 1]."""
    na, nb = l2_norm(a), l2_norm(b)
    return F.when((na < 1e-12) | (nb < 1e-12), F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (na * nb))))


def euclidean_distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(total(F.transform(subtract(a, b), lambda x: x * x)))


def with_slot(state: Column | str, index: int, value: Column | float) -> Column:
    """The vector with one slot set, extended with zeros as needed."""
    v = _vector(state)
    value = value if isinstance(value, Column) else F.lit(float(value))
    width = F.greatest(F.size(v), F.lit(index + 1))
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.when(i == index, value).otherwise(F.coalesce(F.try_element_at(v, i + 1), F.lit(0.0))))


def with_slot_delta(state: Column | str, index: int, delta: Column | float) -> Column:
    delta = delta if isinstance(delta, Column) else F.lit(float(delta))
    return with_slot(state, index, F.coalesce(slot(_vector(state), index), F.lit(0.0)) + delta)


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def from_slice(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def dim(state: Column | str) -> Column:
    return F.size(_vector(state))


def stabilize(before: Column | str, after: Column | str, alpha: float) -> Column:
    """(1 - alpha) * before + alpha * after."""
    return _zip(before, after, lambda x, y: (1 - alpha) * x + alpha * y)


def mean_abs_delta(before: Column | str, after: Column | str) -> Column:
    """Mean absolute difference over the slots, 0 for two empty vectors."""
    d = subtract(before, after)
    return F.when(F.size(d) == 0, F.lit(0.0)).otherwise(total(F.transform(d, F.abs)) / F.size(d))


def age_in_batches(created: Column | str, now: int) -> Column:
    created = F.col(created) if isinstance(created, str) else created
    return F.greatest(F.lit(now) - created, F.lit(0))


def other_endpoint(locus: Column | int) -> Column:
    return F.when(F.col("src") == locus, F.col("dst")).otherwise(F.col("src"))


def involves(locus: Column | int) -> Column:
    return (F.col("src") == locus) | (F.col("dst") == locus)


def endpoint_key() -> Column:
    """Directed: (src, dst); symmetric: the sorted pair."""
    return F.when(F.col("directed"), F.struct("src", "dst")).otherwise(F.struct(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")))


def is_stimulus() -> Column:
    return F.size(F.coalesce("predecessors", F.array().cast("array<bigint>"))) == 0


def get_str(props: Column | str, key: str) -> Column:
    """A property's string value; null for other types."""
    value = F.try_variant_get(F.try_parse_json(props), f"$.{key}", "string")
    return F.when(F.schema_of_variant(F.variant_get(F.try_parse_json(props), f"$.{key}", "variant")) == "STRING", value)


def get_f64(props: Column | str, key: str) -> Column:
    """A property's number, integer or float; null for other types."""
    kind = F.schema_of_variant(F.variant_get(F.try_parse_json(props), f"$.{key}", "variant"))
    return F.when(kind.isin("STRING", "BOOLEAN"), F.lit(None).cast("double")).otherwise(F.try_variant_get(F.try_parse_json(props), f"$.{key}", "double"))


def dominant_flow_kind(kinds: Column | str = "kinds_observed") -> Column:
    """Kind with the highest touch count; ties go to the lower kind."""
    kinds = F.col(kinds) if isinstance(kinds, str) else kinds
    best = F.array_max(F.transform(kinds, lambda k: F.struct(k["touch_count"].alias("n"), (-k["kind"]).alias("k"))))
    return -best["k"]


def touch_count_for(kind: int, kinds: Column | str = "kinds_observed") -> Column:
    kinds = F.col(kinds) if isinstance(kinds, str) else kinds
    return F.coalesce(F.element_at(F.transform(F.filter(kinds, lambda k: k["kind"] == kind), lambda k: k["touch_count"]), 1), F.lit(0))


def has_seen_kind(kind: int, kinds: Column | str = "kinds_observed") -> Column:
    kinds = F.col(kinds) if isinstance(kinds, str) else kinds
    return F.exists(kinds, lambda k: k["kind"] == kind)


# Evidence monoids as aggregates: the identity for no rows, NaN ignored by least and greatest.


def evidence_sum(x: Column | str) -> Column:
    return F.coalesce(F.sum(x), F.lit(0.0))


def evidence_max(x: Column | str) -> Column:
    return F.coalesce(F.max(F.when(~F.isnan(x), F.col(x) if isinstance(x, str) else x)), F.lit(float("-inf")))


def evidence_min(x: Column | str) -> Column:
    return F.coalesce(F.min(F.when(~F.isnan(x), F.col(x) if isinstance(x, str) else x)), F.lit(float("inf")))


def evidence_bounded_sum(x: Column | str, cap: float) -> Column:
    """min(sum, cap); the inputs are non-negative."""
    return F.least(evidence_sum(x), F.lit(float(cap)))


def evidence_probability(x: Column | str) -> Column:
    """1 - product of (1 - p): any of independent observations."""
    x = F.col(x) if isinstance(x, str) else x
    return 1.0 - F.coalesce(F.product(1.0 - x), F.lit(1.0))
