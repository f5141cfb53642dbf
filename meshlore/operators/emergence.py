"""Emergence measures: what a group's coherence tells beyond its parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable
from ..functions.vectors import activity
from ..world import World

LEAST_POINTS = 3
TOP_PAIRS = 5

#: Changes of membership begin a new stable window.
LIFECYCLE = ("Born", "Split", "Merged", "BecameDormant", "Revived", "MembershipDelta")


def coherence_stable_series(world: World) -> DataFrame:
    """(entity_id, batch, coherence) of the layers since the last lifecycle layer."""
    rows = world.entity_layers.where("coherence IS NOT NULL")
    start = world.entity_layers.groupBy("entity_id").agg(F.max(F.when(F.col("transition").isin(*LIFECYCLE), F.col("seq"))).alias("__s"))
    return rows.join(start, "entity_id").where(F.col("seq") >= F.coalesce("__s", F.lit(0))).select("entity_id", "batch", "coherence")


def component_series(world: World, threshold: float = 0.0, decay: dict[int, float] | None = None) -> DataFrame:
    """(entity_id, batch, rel_id, activity): member edges as of every batch in which any of them changed.

    The as-of value of an edge is carried forward along its group's batches; with
    ``decay`` (kind to rate) it fades with the batches since.
    """
    member = world.entities.select("entity_id", F.explode("member_rels").alias("rel_id"), F.size("members").alias("n_members"), "members")
    edges = member.join(world.relationships.select("rel_id", "src", "dst", F.col("kind").alias("rel_kind")), "rel_id").where(F.array_contains("members", F.col("src")) & F.array_contains("members", F.col("dst"))).drop("members", "src", "dst")
    log = world.relationship_changes().groupBy(F.col("subject_id").alias("rel_id"), "batch").agg(F.max_by(activity("after"), "change_id").alias("value"))
    changed = edges.join(log, "rel_id").select("entity_id", "rel_id", "batch", "value")
    batches = changed.select("entity_id", "batch").distinct()
    grid = edges.join(batches, "entity_id").join(changed, ["entity_id", "rel_id", "batch"], "left")
    past = Window.partitionBy("entity_id", "rel_id").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.withColumn("__last", F.last(F.when(F.col("value").isNotNull(), F.struct("value", "batch")), ignorenulls=True).over(past))
    rate = F.lit(1.0)
    for kind, r in (decay or {}).items():
        rate = F.when(F.col("rel_kind") == kind, F.lit(float(r))).otherwise(rate)
    value = F.col("__last.value") * F.pow(rate, F.col("batch") - F.col("__last.batch"))
    return filled.select("entity_id", "batch", "rel_id", "n_members", F.coalesce(value, F.lit(0.0)).alias("activity"))


def coherence_dense_series(world: World, threshold: float = 0.0, decay: dict[int, float] | None = None) -> DataFrame:
    """(entity_id, batch, coherence): mean activity of active member edges, less for a thin group."""
    active = F.col("activity") >= F.lit(float(threshold))
    n = F.first("n_members")
    reference = F.when(n <= 1, 1.0).otherwise(n * F.log(n + 1.0) / 2)
    rows = component_series(world, threshold, decay).groupBy("entity_id", "batch")
    return rows.agg((F.coalesce(F.avg(F.when(active, F.col("activity"))), F.lit(0.0)) * F.least(F.count_if(active) / reference, F.lit(1.0))).alias("coherence"))


def coherence_autocorrelation(world: World, lag: int) -> DataFrame:
    """(entity_id, r): Pearson correlation of the stable series with itself ``lag`` steps on."""
    later = F.lead("coherence", lag).over(Window.partitionBy("entity_id").orderBy("batch"))
    return coherence_stable_series(world).withColumn("later", later).where("later IS NOT NULL").groupBy("entity_id").agg(F.corr("coherence", "later").alias("r"))


def _gaussian_mi(r2: float) -> float | None:
    return None if not np.isfinite(r2) or r2 >= 1.0 else float(-0.5 * np.log(1.0 - r2))


def _r2(x: np.ndarray, y: np.ndarray) -> float:
    """Share of y's variance that least squares on x explains; NaN without variance."""
    y = y - y.mean()
    if not len(y) or float(y @ y) == 0.0:
        return float("nan")
    x = x - x.mean(axis=0)
    fit, *_ = np.linalg.lstsq(x, y, rcond=None)
    left = y - x @ fit
    return max(0.0, 1.0 - float(left @ left) / float(y @ y))


def measures(coherence: np.ndarray, parts: np.ndarray, rel_ids: list[int]) -> dict | None:
    """psi and the synergy measures of one group: coherence at n batches, parts n by k."""
    n, k = parts.shape
    if n < LEAST_POINTS:
        return None
    now, later = coherence[:-1], coherence[1:]
    own = _gaussian_mi(_r2(now[:, None], later))
    each = [_gaussian_mi(_r2(parts[:-1, [i]], later)) if parts[:-1, i].std() else 0.0 for i in range(k)]
    if own is None or any(e is None for e in each):
        return None
    out = {"psi": own - sum(each), "i_self": own, "i_parts": sum(each), "n": n, "k": k, "psi_corrected": None, "psi_pair_top": None}
    if k >= 2 and n - 1 >= k + 2:
        joint = _gaussian_mi(_r2(parts[:-1], later))
        out["psi_corrected"] = None if joint is None else own - joint
        pairs = []
        for i in range(k):
            for j in range(i + 1, k):
                both = _gaussian_mi(_r2(parts[:-1][:, [i, j]], later))
                if both is not None:
                    pairs.append((both - max(each[i], each[j]), rel_ids[i], rel_ids[j]))
        out["psi_pair_top"] = sum(p[0] for p in sorted(pairs, reverse=True)[:TOP_PAIRS]) if pairs else None
    return out


def emergence_report(world: World, threshold: float = 0.0, decay: dict[int, float] | None = None, leave_one_out: bool = False) -> DataFrame:
    """One row per entity: psi > 0 emergent, else spurious; or why it is unmeasured.

    A group's series is one entity's history: groups are independent and each is
    as long as the entity's stable window.  ``leave_one_out`` adds rows with one
    component dropped (``dropped``).
    """
    rows = component_series(world, threshold, decay)
    series = coherence_dense_series(world, threshold, decay)
    joined = durable(rows.join(series, ["entity_id", "batch"]))
    schema = "entity_id bigint, dropped bigint, psi double, i_self double, i_parts double, psi_corrected double, psi_pair_top double, n int, k int"

    def run(table: pd.DataFrame) -> pd.DataFrame:
        wide = table.pivot_table(index="batch", columns="rel_id", values="activity").fillna(0.0).sort_index()
        coherence = table.groupby("batch")["coherence"].first().sort_index().to_numpy()
        out = []
        for drop in [None, *(wide.columns if leave_one_out else [])]:
            kept = wide if drop is None else wide.drop(columns=[drop])
            if kept.shape[1] and (m := measures(coherence, kept.to_numpy(), list(kept.columns))):
                out.append((table["entity_id"].iloc[0], drop, m["psi"], m["i_self"], m["i_parts"], m["psi_corrected"], m["psi_pair_top"], m["n"], m["k"]))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
        return frame.astype({"dropped": "Int64"})

    measured = joined.groupBy("entity_id").applyInPandas(run, schema)
    points = joined.groupBy("entity_id").agg(F.count_distinct("batch").alias("points"))
    verdict = (
        F.when(F.col("status") == "Dormant", "unmeasured: dormant").when(F.col("points").isNull(), "unmeasured: no component history")
        .when(F.col("psi").isNull(), "unmeasured: insufficient stable window").when(F.col("psi") > 0, "emergent").otherwise("spurious")
    )
    rows = world.entities.select("entity_id", "status").join(points, "entity_id", "left").join(measured, "entity_id", "left")
    return rows.withColumn("verdict", verdict).drop("status").orderBy(F.desc_nulls_last("psi"), "entity_id")


def render_markdown(report: DataFrame, top: int = 10) -> str:
    """Tables of the report's first rows of each verdict."""
    lines = ["# Emergence report"]
    for verdict, n in sorted((r["verdict"], r["count"]) for r in report.groupBy("verdict").count().collect()):
        lines.append(f"\n## {verdict} ({n})\n\n| entity | psi |\n|-|-|")
        lines += [f"| {r['entity_id']} | {'' if r['psi'] is None else format(r['psi'], '.4f')} |" for r in _rows(report, verdict, top)]
    return "\n".join(lines)


def _rows(report: DataFrame, verdict: str, top: int) -> Iterator:
    yield from report.where(F.col("verdict") == verdict).orderBy(F.desc_nulls_last("psi"), "entity_id").limit(top).collect()
